"""What the text operators share: scratch tables, whole-text access and words.

Every operator takes a DataFrame with at least ``doc_id`` (integer) and ``text`` (string) and ignores other columns, so extra columns with clashing names do no harm.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that all text operators split words at.
SPACE = b" \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
PARTS = "chunk int, run int, counts binary"
#: Bytes of a table's files to a group of rows that is held in memory; sizes from UNKNOWN_BYTES on are no estimates.
GROUP_BYTES, UNKNOWN_BYTES = 96 << 20, 1 << 52
FILE_ROWS = 5000
_LOCAL: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a private one only where it is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="ledgerlens-"))
        root = _LOCAL[0]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/ledgerlens-{uuid.uuid4().hex[:12]}-{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, with no lineage to lose."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes a table of written() that nothing reads any more."""
    if files := df.inputFiles():
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint; where its number of rows is known, in files of FILE_ROWS rows or more, as a small table in very many files costs more to open than to read."""
    if rows is not None:
        df = df.coalesce(max(1, rows // FILE_ROWS))
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch_path(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of bounded rows and bytes (a single row may be larger)."""
    for b in batches:
        at, step = 0, max(1, min(rows, int(b.num_rows * limit / max(1, b.nbytes)))) if b.num_rows else 1
        while at < b.num_rows:
            yield b.slice(at, step)
            at += step


def tidy(work):
    """work, a function of batches, giving unused memory back to the system when it ends, as Spark keeps its worker for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def lower_words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased. bytes.split() splits at exactly SPACE and bytes.lower() maps ASCII only."""
    return text.lower().split()


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The place of each word among the distinct ones, and these in order of their first use."""
    d = pa.array(words, pa.binary()).dictionary_encode() if words else None
    return (d.indices.to_numpy().astype(np.int64), d.dictionary.to_pylist()) if words else (np.zeros(0, np.int64), [])


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def group_count(docs: DataFrame, target: int = GROUP_BYTES) -> int:
    """How many groups a table's rows are dealt to: the session's shuffle partitions, and more where the table's files are so large that a group would hold over target bytes of them. Tables of unknown size count by the setting alone."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(shuffle_parts(docs.sparkSession), -(-size // target) if size < UNKNOWN_BYTES else 1)


def tree_sum(parts: DataFrame, add, tasks: int, fan: int = 64) -> DataFrame:
    """chunk, run, counts: the parts (chunk, run, counts) of each chunk added up in a tree, at most fan of them in a group. run: the task that a part is from."""
    while True:
        parts = parts.withColumn("run", F.floor(F.col("run") / fan).cast("int")).groupBy("chunk", "run").applyInArrow(_one_part(add), PARTS)
        tasks = -(-tasks // fan)
        if tasks <= 1:
            return parts


def _one_part(add):
    def work(t: pa.Table) -> pa.Table:
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "run": t.column("run").slice(0, 1), "counts": pa.array([add(t.column("counts").to_pylist())], pa.binary())})

    return work


def crc_mod(n: int) -> F.Column:
    """crc32 of the decimal doc_id, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(n)


def hash64(items: list[bytes]) -> np.ndarray:
    import xxhash

    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(x) for x in items), np.uint64, len(items))


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; LEDGERLENS_TOKENIZERS overrides the folder."""
    folder = os.environ.get("LEDGERLENS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


WORDS = re.compile(WORD_RE)
