"""Fill-in-the-middle transformation over an index of distinct texts.

Every task first groups the identical texts it reads, comparing whole texts, so a text travels once a task with the ids of its documents. Rows then meet by a hash of their text, sorted by it, and texts under one hash are told apart by their whole content. For each distinct text the byte places at which its code points begin are kept as an Elias-Fano list, made once, and joined back to the text's documents: each document selects its two seeded cuts from the list, so no text is scanned again for them.

A text that holds much of the table's bytes is dealt to several tasks by a salt. Texts count as such from 1 / HOT_SHARE of a task's mean bytes on; there are at most HOT_SHARE * tasks of them, HOT_SHARE * MOST_TASKS in all, which is what the driver holds.

Cases: null text counts as empty; an empty text, or one that holds one of the marks, stays plain; a null doc_id hashes as the text 'null'; repeated rows are answered each; a very long text is one row that is cut by the places of its list; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_count, id_text, raw, small, tidy, written

SEED, PLAIN_FROM, SPM_BELOW = "1", 90, 20
MARKS = (b"<P>", b"<S>", b"<M>")
#: Of a task's mean bytes; the number of tasks that hot texts are told by; ids a row; bytes of texts that are grouped at a time, and of a batch.
HOT_SHARE, MOST_TASKS, IDS, PIECE, BATCH = 4, 1 << 14, 256, 16 << 20, 8 << 20
GATHERED = "key long, salt int, text binary, ids array<long>"
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


class EliasFano:
    """An ascending list of integers: upper bits in unary, lower bits in planes, and the place of each STEP-th one."""

    STEP = 256

    def __init__(self, values: np.ndarray, universe: int):
        n = self.n = len(values)
        self.bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        ones = (values >> self.bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        self.high, self.at = np.packbits(high, bitorder="little"), ones[:: self.STEP].copy()
        self.planes = [np.packbits((values >> p & 1).astype(np.uint8), bitorder="little") for p in range(self.bits)]

    def __getitem__(self, i: int) -> int:
        start = int(self.at[i // self.STEP])
        first = start >> 3
        stop = int(self.at[i // self.STEP + 1]) + 1 if i // self.STEP + 1 < len(self.at) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[first : (stop + 7) >> 3], bitorder="little")[start - 8 * first :])
        value = start + int(ones[i % self.STEP]) - i << self.bits
        return value | sum((int(p[i >> 3]) >> (i & 7) & 1) << k for k, p in enumerate(self.planes))

    def __len__(self) -> int:
        return self.n

    @property
    def nbytes(self) -> int:
        return self.high.nbytes + self.at.nbytes + sum(p.nbytes for p in self.planes)


class Text:
    """A distinct text: its content and the byte places of its code points' borders, the end included."""

    def __init__(self, text: bytes):
        starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        self.text, self.n, self.marked = text, len(starts), any(m in text for m in MARKS)
        self.borders = EliasFano(np.append(starts, len(text)), len(text) + 1)


def drawn(seed: str, doc_id: int | None) -> list[int]:
    """The first four groups of eight digits of the SHA-256 of seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut(t: Text, doc_id: int | None, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> tuple:
    """form, prefix_chars, middle_chars and output of a document with this text."""
    h1, h2, h3, h4 = drawn(seed, doc_id)
    if not t.text or t.marked or h3 % 100 >= plain_from:
        return "plain", None, None, t.text
    a, b = sorted((h1 % (t.n + 1), h2 % (t.n + 1)))
    i, j = t.borders[a], t.borders[b]
    prefix, middle, suffix = t.text[:i], t.text[i:j], t.text[j:]
    p, s, m = MARKS
    if h4 % 100 < spm_below:
        return "spm", a, b - a, b"".join((s, suffix, p, prefix, m, middle))
    return "psm", a, b - a, b"".join((p, prefix, s, suffix, m, middle))


def _gathering(salts: dict[int, int]):
    """Groups a piece's identical texts by their whole content."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1 << 14, PIECE):
            texts: dict[bytes, tuple[int, list]] = {}
            for key, doc_id, text in zip(b.column("key").to_pylist(), b.column("doc_id").to_pylist(), raw(b.column("text")), strict=True):
                texts.setdefault(text, (key, []))[1].append(doc_id)
            out = [(key, ((ids[i] or 0) + i // IDS) % salts.get(key, 1), text, ids[i : i + IDS]) for text, (key, ids) in texts.items() for i in range(0, len(ids), IDS)]
            if out:
                key, salt, text, ids = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "salt": pa.array(salt, pa.int32()), "text": pa.array(text, pa.binary()), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return work


def _cutting(seed: str, plain_from: int, spm_below: int):
    """Rows come sorted by key, so only the texts of one key are held."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index, rows, held = None, {}, [], 0
        for b in small(batches, limit=BATCH):
            for key, text, ids in zip(b.column("key").to_pylist(), raw(b.column("text")), b.column("ids").to_pylist(), strict=True):
                if key != last:
                    last, index = key, {}
                t = index.get(text) or index.setdefault(text, Text(text))
                for doc_id in ids:
                    rows.append((doc_id, t.n, *cut(t, doc_id, seed, plain_from, spm_below)))
                    held += len(text) + 64
                    if held >= BATCH:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return tidy(work)


def hot_texts(texts: DataFrame, tasks: int) -> dict[int, int]:
    """How many tasks the texts of each hot key are dealt to. texts: key, text."""
    by = written(texts.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 64).alias("bytes")), "keys")
    total = by.agg(F.sum("bytes")).first()[0] or 0
    least = max(1, total // (HOT_SHARE * min(tasks, MOST_TASKS)))
    return {r.key: int(min(r.n, -(-r.bytes // least))) for r in by.where((F.col("bytes") > least) & (F.col("n") > 1)).collect()}


def fill_middle(docs: DataFrame, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n (code points), form (plain, psm, spm), prefix_chars, middle_chars, output of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = id_text(docs).select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    tasks = group_count(docs)
    gathered = rows.mapInArrow(tidy(_gathering(hot_texts(rows, tasks))), GATHERED)
    met = gathered.repartition(tasks, "key", "salt").sortWithinPartitions("key")
    out = met.mapInArrow(_cutting(seed, plain_from, spm_below), CUT)
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: F.Column, form: F.Column) -> F.Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(m.decode() for m in MARKS), -1)
    piece = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def op12(docs: DataFrame) -> DataFrame:
    out = fill_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
g AS (SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
