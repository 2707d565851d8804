"""Queries of the streaming operators over the provided tables, read as streams, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapter import line_items
from ..sources.scratch import shared_path
from ..streaming.split_runs import split_runs
from .detection import RUNS_SQL, joined

FIELDS = ("vendor_key", "officer_id", "txn_date", "row_id", "amount")
#: A day after which nothing else comes, so that every run is final; and the time that rows may be late.
END, LATENESS, BATCHES = "2100-01-01", "20000 days", 3


def run_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a stream of several batches in no order of time, and the split runs that it gives."""
    folder = shared_path(spark, "stream")
    rows = line_items(spark, sf_dir).select(*FIELDS)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    files = max(1, int(parts) // BATCHES)  # to a batch, so that no task writes a batch alone
    rows.repartition(BATCHES * files, "row_id").write.parquet(f"{folder}/in")
    end = rows.limit(1).select(F.lit("").alias("vendor_key"), F.lit("").alias("officer_id"), F.lit(END).cast("date").alias("txn_date"), F.lit(0).cast("long").alias("row_id"), F.lit(0.01).alias("amount"))
    end.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(parts), 2 * spark.sparkContext.defaultParallelism)))  # a state store each
    try:
        out = split_runs(stream, lateness=LATENESS).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out")
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return spark.read.parquet(f"{folder}/out").select("vendor_key", "officer_id", joined(), "total", "first_date", "last_date", "n_parts")


ENTRIES = {
    "stream_split_runs": (run_of_stream, f"WITH RECURSIVE {RUNS_SQL} SELECT vendor_key, officer_id, array_to_string(ids, ',') AS row_ids, total, first_date, last_date, n_parts::INT AS n_parts FROM r"),
}
