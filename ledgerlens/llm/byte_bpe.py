"""Byte-level BPE by a monoid tree reduction.

A byte string's tokens are computed by halves: both halves are encoded and joined. To join, a window of k tokens on either side of the seam is encoded anew, and k doubles until the outermost tokens of the window come out unchanged.
That is a proof: a sequence is the encoding of its bytes exactly if every two neighbours are the encoding of theirs; inside the window this holds by construction, outside because the halves are encodings, and at the window's edges because the edge tokens stayed.
Leaves are single bytes: every match that isn't a token itself, as the ranks' own library takes it, goes through the tree. Short windows and parts that were joined before are remembered in bounded tables.
Decoding concatenates the tokens' bytes up a tree of FAN branches.

Texts are cut into matches of the public pattern. Each match is encoded on its own, once, and remembered in a bounded table; pieces that the pattern is certain to cut are found first with a cheaper expression.

Cases: null text counts as empty: no ids; a text of any length is encoded whole; repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, small, tidy, vocabulary_path
from .token_files import pieces

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
FAN = 16
CACHE = 1_000_000
WINDOWS, WINDOW_BYTES = 1 << 16, 16  # windows remembered, and the longest of them
PARTS, PART_BYTES = 1 << 17, 6  # parts of matches remembered, and the longest of them
_MODELS: dict[tuple[str, str, int], "ByteBPE"] = {}


class ByteBPE:
    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        self.cache = cache
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.windows: dict[bytes, list[bytes]] = {}
        self.parts: dict[bytes, list[bytes]] = {}

    def merged(self, b: bytes) -> list[bytes]:
        """Tokens of b by merging the pair of lowest rank, leftmost first."""
        if len(b) > 48:
            return self._merged_long(b)
        rank, parts = self.ranks.get, [b[i : i + 1] for i in range(len(b))]
        score = [rank(b[i : i + 2], 1 << 30) for i in range(len(b) - 1)]
        while score and (low := min(score)) < 1 << 30:
            i = score.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del score[i]
            if i < len(score):
                score[i] = rank(parts[i] + parts[i + 1], 1 << 30)
            if i:
                score[i - 1] = rank(parts[i - 1] + parts[i], 1 << 30)
        return parts

    def _merged_long(self, b: bytes) -> list[bytes]:
        """The same with a heap and links, for n log n."""
        rank, n = self.ranks.get, len(b)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != e:
                continue
            end[i], alive[j] = e, False
            if e < n:
                prev[e] = i
                if (r := rank(b[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (p := prev[i]) >= 0 and (r := rank(b[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
        out, i = [], 0
        while i < n:
            out.append(b[i : end[i]])
            i = end[i]
        return out

    def window(self, b: bytes) -> list[bytes]:
        """Tokens of a window, remembered where it is short."""
        found = self.windows.get(b)
        if found is None:
            found = self.merged(b)
            if len(b) <= WINDOW_BYTES:
                if len(self.windows) >= WINDOWS:
                    self.windows.clear()
                self.windows[b] = found
        return found

    def tokens(self, b: bytes) -> list[bytes]:
        """Tokens of one match by the tree."""
        return [b] if b in self.ranks else self.tree(b)

    def tree(self, b: bytes) -> list[bytes]:
        """Tokens of a match or a part of one; those of short parts, which many matches have, are remembered. A part is no match: that it is a token does not make it one."""
        found = self.parts.get(b)
        if found is None:
            n = len(b)
            if n < 2:
                return [b] if b else []
            found = self.join(self.tree(b[: n // 2]), self.tree(b[n // 2 :]))
            if n <= PART_BYTES:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                self.parts[b] = found
        return found

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Encoding of the bytes of two encodings side by side."""
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(k, len(right))
            window = self.window(b"".join(left[i:] + right[:j]))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            k *= 2

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        cut, known = pieces(text), self.known
        for p in {*cut}.difference(known):
            if len(known) >= self.cache:
                known.clear()
            known[p] = b"".join(self.ranks[t].to_bytes(4, "little") for m in self.find(p) for t in self.tokens(m.encode()))
        try:
            return b"".join(map(known.__getitem__, cut))
        except KeyError:  # the table was emptied on the way
            return b"".join(known[p] if p in known else self.encode(p) for p in cut)

    def forget(self) -> None:
        for table in (self.known, self.windows, self.parts):
            table.clear()

    def decode(self, ids: list[int]) -> bytes:
        parts = [self.bytes_of[i] for i in ids]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
        return parts[0] if parts else b""


def model(path: str, pattern: str, cache: int = CACHE) -> ByteBPE:
    if (path, pattern, cache) not in _MODELS:
        _MODELS[path, pattern, cache] = ByteBPE(path, pattern, cache)
    return _MODELS[path, pattern, cache]


def byte_bpe(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with_ids adds the ids as an array; cache is how many pieces a worker remembers, and keep whether it does so beyond its task; both change memory and time, not results."""
    import public_tokenizers

    path, pattern = vocabulary_path(vocabulary), public_tokenizers.PATTERN

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern, cache)
        for b in small(batches):
            n, digest, back, ids = [], [], [], []
            for t in b.column("text").to_pylist():
                x = bpe.encode(t or "")
                i = np.frombuffer(x, "<u4").tolist()
                n.append(len(i))
                digest.append(hashlib.sha256(x).hexdigest())
                back.append(hashlib.sha256(bpe.decode(i)).hexdigest())
                if with_ids:
                    ids.append(i)
            out = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(digest, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))
        if not keep:
            bpe.forget()

    return id_text(docs).mapInArrow(work if keep else tidy(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
