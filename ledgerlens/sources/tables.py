"""Tables on shared storage: text files in, canonical tables out, snapshots of both."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The columns of the canonical table, in order.
CANONICAL = (
    ("row_id", "bigint"), ("vendor_name", "string"), ("vendor_key", "string"), ("invoice_no", "string"), ("amount", "double"), ("txn_date", "date"), ("officer_id", "string"), ("item_desc", "string"), ("item_category", "string"),
    ("quantity", "double"), ("unit_price", "double"), ("source_dataset", "string"), ("source_row_ref", "string"), ("is_injected", "boolean"), ("injection_group_id", "string"), ("injection_type", "string"),
)
AUDITED = tuple(c for c, _ in CANONICAL[:11])
RUNS = "run_id string, seed long, transactions long, detectors string, config string, created_at timestamp"
RESULTS = "run_id string, detector string, anomaly_type string, granularity string, precision double, recall double, f1 double, pr_auc double, tp long, fp long, fn long, seed long, created_at timestamp"


def headers(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("multiLine", True).csv(path).columns


def read_text_csv(spark: SparkSession, path: str, names: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """A delimited file with every column as text. Rows that are short get nulls, longer ones lose what is beyond the header, bytes that are no UTF-8 are replaced; nothing is inferred. Files without line breaks inside quotes may be read with multi_line off, in parts."""
    names = names or headers(spark, path)
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("multiLine", multi_line).option("quote", '"').option("escape", '"').csv(path)


def with_row_ids(source: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows with their place in the source, from 1, in order of file and place in it.

    Spark numbers rows within a task; the parts of files that tasks read are ordered by file and first byte, and each part's rows are numbered on from the rows before it. What is gathered is a row a part.
    """
    at = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_mid": F.monotonically_increasing_id()}
    rows = source.withColumns(at)
    parts = rows.groupBy("_file", "_start").agg(F.min("_mid").alias("_low"), F.count("*").alias("_n"))
    upto = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.withColumn("_before", upto).drop("_n")
    out = rows.join(base, ["_file", "_start"])
    return out.withColumn(name, F.col("_before") + F.col("_mid") - F.col("_low") + 1).drop("_file", "_start", "_mid", "_low", "_before")


def canonical_columns(df: DataFrame) -> DataFrame:
    """df with the canonical columns in order and type; one that lacks any is refused."""
    if lost := [c for c, _ in CANONICAL if c not in df.columns]:
        raise ValueError(f"the table lacks {', '.join(lost)}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in CANONICAL])


#: Rows of a row group, which is what a lookup reads or leaves out.
GROUP_ROWS = 100_000
LOOKED_UP = ("row_id", "vendor_key")


def write_indexed(df: DataFrame, path: str, order: tuple[str, ...] = ("vendor_key", "txn_date", "row_id"), keys: tuple[str, ...] = LOOKED_UP, group_rows: int = GROUP_ROWS, parts: int | None = None) -> None:
    """df as a table that is looked up without being read whole. Rows are dealt to ranges of the order and sorted by it, so a vendor of many rows is spread over files, and each row group's least and largest values leave out other vendors and days; Bloom filters do it for the keys, whatever their order."""
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    write = dealt.sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", group_rows)
    for key in keys:
        write = write.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", group_rows)
    write.parquet(path)


def lookup(spark: SparkSession, path: str, row_ids: list[int] | None = None, vendors: list[str] | None = None, days: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """Rows of a table of write_indexed by id, by vendor and by day, both ends included; what is given must all hold. The conditions reach the files, as they are plain comparisons."""
    rows = spark.read.parquet(path)
    for column, values in (("row_id", row_ids), ("vendor_key", vendors)):
        if values is not None:
            rows = rows.where(F.col(column).isin(values))
    return rows if days is None else rows.where((F.col("txn_date") >= F.lit(days[0])) & (F.col("txn_date") <= F.lit(days[1])))


class WriterError(RuntimeError):
    """Another writer holds the table."""


@contextlib.contextmanager
def writing(spark: SparkSession, path: str):
    """Holds a table for one writer: a second one is refused until the first is through. Readers are not held up. What holds it is a file beside the table that only one can create; if a writer died, it has to be removed by hand."""
    fs, _path = _files(spark, path)
    held = _path(f"{path}.writing")
    try:
        fs.create(held, False).close()
    except Exception as e:  # it is there already
        raise WriterError(f"{path} is being written; remove {path}.writing if its writer died") from e
    try:
        yield
    finally:
        fs.delete(held, False)


def replace_table(df: DataFrame, path: str) -> None:
    """df in place of what is at path, as write_indexed writes it. The old table is set aside, and goes when the new one is in its place; if that fails it is put back. One writer at a time."""
    with writing(df.sparkSession, path):
        _replace(df, path)


def _replace(df: DataFrame, path: str) -> None:
    new, old = (f"{path}.{x}-{uuid.uuid4().hex[:8]}" for x in ("new", "old"))
    write_indexed(canonical_columns(df), new)
    fs, _path = _files(df.sparkSession, path)
    there = fs.exists(_path(path))
    if there and not fs.rename(_path(path), _path(old)):
        raise OSError(f"cannot set the old table at {path} aside")
    if not fs.rename(_path(new), _path(path)):
        if there:
            fs.rename(_path(old), _path(path))
        raise OSError(f"cannot put the new table at {path}")
    fs.delete(_path(old), True)


def append(df: DataFrame, path: str, schema: str) -> None:
    """Rows added to a table of fixed columns."""
    names = [f.split()[0] for f in schema.split(", ")]
    df.select(*[F.col(n).cast(f.split()[1]).alias(n) for n, f in zip(names, schema.split(", "), strict=True)]).write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a whole table is at path: a write that did not end left no mark of success."""
    fs, _path = _files(spark, path)
    return bool(fs.exists(_path(f"{path}/_SUCCESS")))


def is_planted(spark: SparkSession, root: str) -> bool:
    """Whether a folder of tables records planted anomalies, which makes it an evaluation's."""
    return exists(spark, f"{root}/injection_runs")


def audit_view(df: DataFrame, name: str = "audit_transactions") -> DataFrame:
    """The columns that detectors, tools and reviewers may read, as a view: no answers among them."""
    view = df.select(*AUDITED)
    view.createOrReplaceTempView(name)
    return view


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    of = lambda p: jvm.Path(p)
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def digests(spark: SparkSession, root: str) -> DataFrame:
    """name (below root), bytes, sha256 of every file under root; each file is hashed by the task that reads it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = len(re.sub(r"^\w+:/*", "/", root).rstrip("/")) + 2
    name = F.substr(F.regexp_replace("path", r"^\w+:/*", "/"), F.lit(below))
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, root: str, seed: int) -> dict:
    """What a snapshot holds. Its files are few; tables in it are of many rows but not of many files."""
    rows = digests(spark, root).where("not startswith(name, '_') and name <> 'manifest.json'").orderBy("name").collect()
    return {"seed": seed, "frozen_at": dt.datetime.now(dt.UTC).isoformat(timespec="minutes"), "files": {r.name: r.sha256 for r in rows}}


def freeze(spark: SparkSession, tables: dict[str, DataFrame], root: str, seed: int) -> dict:
    """Tables as a snapshot at root with a manifest of their files' digests; an older snapshot there is replaced."""
    fs, _path = _files(spark, root)
    fs.delete(_path(root), True)
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
    found = manifest(spark, root, seed)
    spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.text(f"{root}/_manifest")
    return found


def verify(spark: SparkSession, root: str) -> dict:
    """A snapshot's manifest, if every file is there and as it was."""
    if not exists(spark, f"{root}/_manifest"):
        raise ValueError(f"no snapshot at {root}")
    said = json.loads(spark.read.text(f"{root}/_manifest").first().value)
    now = manifest(spark, root, said["seed"])["files"]
    if changed := sorted(k for k in said["files"] if now.get(k) != said["files"][k]):
        raise ValueError(f"changed since it was frozen: {', '.join(changed[:5])}")
    return said


def prepare(spark: SparkSession, root: str, work: str) -> dict:
    """A fresh working copy of a verified snapshot."""
    said = verify(spark, root)
    fs, _path = _files(spark, work)
    fs.delete(_path(work), True)
    names = {k.split("/")[0] for k in said["files"]}
    for name in sorted(names):
        spark.read.parquet(f"{root}/{name}").write.parquet(f"{work}/{name}")
    return said
