"""From messy text columns to the canonical table, with reasons for what is dropped."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stats import exact_ranks
from ..sources.tables import canonical_columns, headers, read_text_csv, with_row_ids

REASONS = ("missing_vendor_name", "unparseable_amount", "non_positive_amount", "unparseable_date", "empty_vendor_key")
TEXTS = ("vendor_name", "invoice_no", "officer_id", "item_desc", "item_category")
NUMBERS = ("amount", "quantity", "unit_price")


FIELDS = ("vendor_name", "amount", "txn_date", "invoice_no", "officer_id", "item_desc", "item_category", "quantity", "unit_price")
REQUIRED = ("vendor_name", "amount", "txn_date")
CURRENCY = "INR"


@dataclass(frozen=True)
class Mapping:
    """Canonical field to source header. Money of another currency is multiplied by a pinned positive rate whose date is known."""

    columns: dict[str, str | None]
    date_formats: tuple[str, ...] = ("yyyy-MM-dd",)
    dataset: str = "source"
    currency: str = CURRENCY
    rate: float = 1.0
    rate_date: dt.date | None = None
    row_ref: str | None = None
    description: str = ""

    def __post_init__(self) -> None:
        wrong = []
        if unknown := sorted(set(self.columns) - set(FIELDS)):
            wrong.append(f"unknown fields {', '.join(unknown)}")
        if lost := [c for c in REQUIRED if not self.columns.get(c)]:
            wrong.append(f"no source for {', '.join(lost)}")
        if not re.fullmatch("[a-z0-9_]+", self.dataset):
            wrong.append("the dataset's name may hold a-z, 0-9 and _ only")
        if not self.date_formats:
            wrong.append("no date format")
        if self.currency == CURRENCY and self.rate != 1.0:
            wrong.append(f"a source in {CURRENCY} takes no rate")
        if self.currency != CURRENCY and (self.rate <= 0 or self.rate_date is None):
            wrong.append("another currency needs a positive rate and its date")
        if wrong:
            raise ValueError(f"{self.dataset}: {'; '.join(wrong)}")

    @property
    def headers(self) -> list[str]:
        return [h for h in self.columns.values() if h] + [self.row_ref] * bool(self.row_ref)


#: Names that mapping files use, and what is read from them.
KEYS = {"dataset": "dataset", "description": "description", "source_currency": "currency", "fx_rate_to_inr": "rate", "fx_rate_date": "rate_date", "date_formats": "date_formats", "columns": "columns", "source_row_ref": "row_ref"}


def load_mapping(text: str) -> Mapping:
    """A mapping from JSON, or from YAML where a reader for it is installed. Keys that no mapping has are refused; date formats may be written the way strftime has them."""
    try:
        said = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        said = yaml.safe_load(text)
    if unknown := sorted(set(said) - set(KEYS)):
        raise ValueError(f"unknown keys {', '.join(unknown)}")
    got = {KEYS[k]: v for k, v in said.items() if v is not None}
    got["date_formats"] = tuple(spark_format(f) for f in got.get("date_formats", ()))
    got["currency"] = str(got.get("currency", CURRENCY)).strip().upper()
    if isinstance(day := got.get("rate_date"), str):
        got["rate_date"] = dt.date.fromisoformat(day)
    return Mapping(**got)


def spark_format(f: str) -> str:
    """A strftime format as Spark writes it; one that is Spark's already stays."""
    for a, b in (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%b", "MMM"), ("%B", "MMMM"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss"), ("%y", "yy")):
        f = f.replace(a, b)
    return f


def read_csv(spark: SparkSession, path: str, mapping: Mapping) -> DataFrame:
    """All columns as text with each row's place in the source (_row_id); headers are checked first."""
    have = headers(spark, path)
    if lost := sorted({h for h in mapping.headers if h not in have}):
        raise ValueError(f"source lacks headers {', '.join(lost)}; it has {', '.join(have)}")
    return with_row_ids(read_text_csv(spark, path, have), "_row_id")


def stage(source: DataFrame, mapping: Mapping, key: F.Column | None = None) -> DataFrame:
    """Cleaned fields and drop_reason, null where the row stays. key: the vendor key of the cleaned vendor_name; by default the full normal form of each distinct name."""
    every = (*TEXTS, *NUMBERS, "txn_date")
    take = [F.col(f"`{mapping.columns[c]}`").cast("string").alias(c) if mapping.columns.get(c) else F.lit(None).cast("string").alias(c) for c in every]
    kept = [c for c in source.columns if c.startswith("_row")]
    ref = F.col(f"`{mapping.row_ref}`") if mapping.row_ref else F.col(kept[0]) if kept else F.lit(None)
    rows = source.select(*kept, ref.cast("string").alias("_ref"), *take).withColumns({c: text.clean(F.col(c)) for c in every})
    rows = rows.withColumns({f"{c}_num": text.number(F.col(c)) for c in NUMBERS} | {"day": text.date(F.col("txn_date"), mapping.date_formats)})
    if key is None:
        from ..functions.names import normalize_vendor

        names = rows.select("vendor_name").distinct().withColumn("vendor_key", normalize_vendor(F.coalesce("vendor_name", F.lit(""))))
        rows = rows.join(names, rows["vendor_name"].eqNullSafe(names["vendor_name"]), "left").drop(names["vendor_name"])
    else:
        rows = rows.withColumn("vendor_key", key)
    reason = F.when(F.col("vendor_name").isNull(), REASONS[0]).when(F.col("amount_num").isNull(), REASONS[1]).when(F.col("amount_num") <= 0, REASONS[2]).when(F.col("day").isNull(), REASONS[3]).when(F.coalesce("vendor_key", F.lit("")) == "", REASONS[4])
    return rows.withColumn("drop_reason", reason)


def canonical(staged: DataFrame, mapping: Mapping) -> DataFrame:
    money = lambda c: (F.col(f"{c}_num") * mapping.rate).alias(c)
    kept = [c for c in staged.columns if c.startswith("_row")]
    return staged.where("drop_reason is null").select(*kept, "vendor_name", "vendor_key", "invoice_no", money("amount"), F.col("day").alias("txn_date"), "officer_id", "item_desc", "item_category", F.col("quantity_num").alias("quantity"), money("unit_price"), F.lit(mapping.dataset).alias("source_dataset"))


def canonical_table(staged: DataFrame, mapping: Mapping, row_id: str = "_row_id") -> DataFrame:
    """The sixteen canonical columns of the rows that stay: ids are places in the source, which dropped rows keep too, and nothing is planted."""
    money = lambda c: (F.col(f"{c}_num") * mapping.rate).alias(c)
    none = F.lit(None).cast("string")
    return canonical_columns(staged.where("drop_reason is null").select(
        F.col(row_id).alias("row_id"), "vendor_name", "vendor_key", "invoice_no", money("amount"), F.col("day").alias("txn_date"), "officer_id", "item_desc", "item_category", F.col("quantity_num").alias("quantity"), money("unit_price"),
        F.lit(mapping.dataset).alias("source_dataset"), F.col("_ref").alias("source_row_ref"), F.lit(False).alias("is_injected"), none.alias("injection_group_id"), none.alias("injection_type"),
    ))


def coerced(staged: DataFrame) -> DataFrame:
    """field, n: values of kept rows that were there but are no numbers, and so became null."""
    kept = staged.where("drop_reason is null")
    row = kept.agg(*[F.count_if(F.col(c).isNotNull() & F.col(f"{c}_num").isNull()).alias(c) for c in ("quantity", "unit_price")])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in ("quantity", "unit_price")])).alias("x")).select("x.*")


def drop_counts(staged: DataFrame) -> DataFrame:
    """Rows dropped by reason, zeros included."""
    reasons = staged.sparkSession.createDataFrame([(r,) for r in REASONS], "drop_reason string")
    return reasons.join(staged.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n")), "drop_reason", "left").fillna(0, ["n"])


def date_formats(values: DataFrame, column: str, candidates: dict[str, str], share: float = 0.95) -> DataFrame:
    """How many non-blank values each candidate format parses, and whether it fits."""
    v = text.clean(F.col(column))
    row = values.agg(F.count(v).alias("n"), *[F.count(F.try_to_timestamp(v, F.lit(f))).alias(k) for k, f in candidates.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("format"), F.col(k).alias("parsed")) for k in candidates]))
    return row.select("n", each.alias("x")).select("x.format", "x.parsed", (F.col("x.parsed") >= F.greatest(F.lit(1), F.floor(share * F.col("n")))).alias("fits"))


def card(tx: DataFrame, threshold: float) -> DataFrame:
    """One row about the dataset. p95 is the value of rank round(0.95 * (n - 1)), half to even, as nearest interpolation has it; it and the median are exact ranks."""
    s = tx.agg(
        F.count("*").alias("n_rows"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"), F.min("amount").alias("least"), F.max("amount").alias("most"),
        F.count_if(F.col("amount") >= threshold).alias("n_threshold"), F.countDistinct("vendor_name").alias("n_names"), F.countDistinct("vendor_key").alias("n_keys"), F.countDistinct("officer_id").alias("n_officers"), F.countDistinct("item_category").alias("n_categories"),
        F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"),
    )
    ranks = exact_ranks(tx, "amount", [], {"median": (0.5, "middle"), "p95": (0.95, "nearest")}).drop("n")
    return s.crossJoin(F.broadcast(ranks))  # one row


def null_rates(tx: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    row = tx.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("k")) for c in columns]))
    return row.select("n", each.alias("x")).select("x.field", F.col("x.k").alias("n_null"), (F.col("x.k") / F.col("n")).alias("rate"))


def collapsed_names(tx: DataFrame, top: int = 8, examples: int = 6) -> DataFrame:
    """Keys with the most spellings. Names are distinct before they are counted, and a key's first few are all that is gathered of it."""
    names = tx.select("vendor_key", "vendor_name").distinct()
    n = names.groupBy("vendor_key").agg(F.count("*").alias("n_names")).where("n_names > 1").orderBy(F.desc("n_names"), "vendor_key").limit(top)
    w = Window.partitionBy("vendor_key").orderBy("vendor_name")
    few = names.join(F.broadcast(n), "vendor_key").withColumn("at", F.row_number().over(w)).where(F.col("at") <= examples)  # top rows
    return few.groupBy("vendor_key", "n_names").agg(F.array_sort(F.collect_list("vendor_name")).alias("names"))
