"""Quality rules with suffix-array repetition.

Words are the symbols. The suffixes of a batch of documents are sorted by prefix doubling, suffixes of different documents never being equal; only groups that are still tied are sorted again. The ranks of each doubling give the longest common prefix of neighbours.
Where that is MIN_REPEAT words or more, the intervals of the prefix array are formed bottom up with a stack; an interval whose suffixes follow different words, or begin a document, is a maximal repeated substring. Each suffix starts a span as long as the deepest such interval that holds it, and the union of these spans is what repetition covers: a repeat that is not maximal lies within the span that begins a word before.
The verdict on a document that passes the base rules: the spans of repeats of at least MIN_REPEAT words cover at most MAX_COVER of its words, and the longest repeat is at most MAX_LONGEST of them.

Cases: null or empty text has no words and fails the base rules; ties and repeated rows are judged alike; very long texts are judged whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, raw, small, tidy

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_3 = (50, 100)
MIN_REPEAT = 10
MAX_COVER = 0.4
MAX_LONGEST = 0.3
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FIELDS = ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean, n_covered long, longest_repeat long, n_maximal long"


def suffixes(ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes in order, the ranks at which neighbours in it share a word or more, and how many words these share. start: where each document begins, and the end."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(start) - 1), np.diff(start))
    end = start[1:][doc]
    _, rank = np.unique(doc * np.int64(ids.max() + 1) + ids, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    tie = rank[order]
    first = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]])
    size = np.diff(np.r_[first, n])
    rank[order] = np.repeat(first, size)  # a group's rank is where it begins in the order
    levels, h = [np.r_[rank, -1]], 1
    slots = np.flatnonzero(np.repeat(size, size) > 1)  # of the order that are tied
    while len(slots):
        i = order[slots]
        j = i + h
        key = np.where(j < end[i], rank[np.minimum(j, n - 1)], -1)
        now = rank[i]
        s = np.lexsort((key, now))
        i, key, now = i[s], key[s], now[s]
        order[slots] = i
        new = np.r_[True, (now[1:] != now[:-1]) | (key[1:] != key[:-1])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(i)])
        rank[i] = np.repeat(slots[first], size)
        slots = slots[np.repeat(size, size) > 1]
        h *= 2
        levels.append(np.r_[rank, -1])
    # Longest common prefix of neighbours in the order, from the largest power down.
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[at].copy(), order[at + 1].copy()
    lcp = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a, n), np.minimum(b, n)
        same = (levels[k][x] == levels[k][y]) & (x < n) & (y < n) & (x != y)
        lcp[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, at, lcp


def repeats(order: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position the words that its suffix shares with the most similar other suffix of its document."""
    out = np.zeros(len(order), np.int64)
    np.maximum.at(out, order[at], lcp)
    np.maximum.at(out, order[at + 1], lcp)
    return out


def maximal_repeats(ids: np.ndarray, start: np.ndarray, order: np.ndarray, at: np.ndarray, lcp: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """For each position the words of the longest maximal repeat that starts there, and each maximal repeat's words, occurrences and one of its places. Only repeats of least words or more."""
    out, found = np.zeros(len(order), np.int64), []
    long = lcp >= least
    at, lcp = at[long], lcp[long]
    before = np.r_[-1, ids[:-1]]
    before[start[:-1][start[:-1] < len(ids)]] = -1  # nothing is before a document
    for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
        leaves = order[at[run[0]] : at[run[-1]] + 2].tolist()
        words = before[leaves].tolist()
        stack: list[list] = []  # words shared, word before (-1: several), occurrences, suffixes in no deeper maximal repeat

        def absorb(node: list) -> None:
            top = stack[-1]
            top[1] = node[1] if top[1] is None or top[1] == node[1] else -1
            top[2] += node[2]
            top[3] += node[3]
            top[4] = node[4]

        def close() -> list:
            depth, word, n, rest, place = stack.pop()
            if word == -1:
                out[rest] = depth
                found.append((depth, n, place))
                rest = []
            return [depth, word, n, rest, place]

        for i, word, v in zip(leaves, words, [*lcp[run].tolist(), 0], strict=True):
            node = [0, word, 1, [i], i]
            while stack and stack[-1][0] > v:
                absorb(node)
                node = close()
            if v:
                if not stack or stack[-1][0] < v:
                    stack.append([v, None, 0, [], i])
                absorb(node)
    return out, found


def covered(length: np.ndarray) -> np.ndarray:
    """Whether each position lies in a span [i, i + length[i])."""
    i = np.flatnonzero(length)
    step = np.zeros(len(length) + 1, np.int64)
    np.add.at(step, i, 1)
    np.add.at(step, i + length[i], -1)
    return np.cumsum(step[:-1]) > 0


def judge(texts: list[bytes]) -> dict[str, list]:
    known: dict[bytes, int] = {}
    ids, start, chars, symbols, dup = [], [0], [], [], []
    for t in texts:
        words = t.split()
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        start.append(start[-1] + len(words))
        b = np.frombuffer(t.translate(None, SPACE), np.uint8)
        chars.append(len(b) - int(np.count_nonzero((b & 0xC0) == 0x80)))
        symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len({*lines}))
    s = np.array(start)
    n = np.diff(s)
    ids = np.concatenate([*ids, np.zeros(0, np.int64)])
    order, at, lcp = suffixes(ids, s)
    length = repeats(order, at, lcp)
    total = lambda x: np.diff(np.r_[0, np.cumsum(x)][s])
    in3 = total(covered(np.where(length >= 3, 3, 0)))
    spans, found = maximal_repeats(ids, s, order, at, lcp, MIN_REPEAT)
    cover = total(covered(spans))
    of = np.searchsorted(s, [place for _, _, place in found], "right") - 1 if found else np.zeros(0, np.int64)
    longest = np.maximum.reduceat(np.r_[spans, 0], s[:-1]) if len(texts) else n
    longest[n == 0] = 0
    failed = (n < MIN_WORDS) | (MAX_REPEAT_3[1] * in3 > MAX_REPEAT_3[0] * n)
    kept = ~failed & (cover <= MAX_COVER * n) & (longest <= MAX_LONGEST * n)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": in3, "base_failed": failed, "kept": kept, "n_covered": cover, "longest_repeat": longest, "n_maximal": np.bincount(of, minlength=len(texts))}


def quality_rules(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts and verdicts as further columns, their names after prefix."""
    named = [f"{prefix}{f}" for f in FIELDS.split(", ")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + named)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1000, 2 << 20):
            got = judge(raw(b.column(b.schema.names.index(text))))
            kind = lambda k: pa.bool_() if k in ("base_failed", "kept") else pa.int64()
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, kind(k)) for k, v in got.items())], [*b.schema.names, *(prefix + k for k in got)])

    return docs.mapInArrow(tidy(work), schema)


def op10(docs: DataFrame) -> DataFrame:
    return quality_rules(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text")
