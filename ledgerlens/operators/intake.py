"""What a file would become, decided before anything is written."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import headers, read_text_csv
from . import ingest
from .ingest import FIELDS, REQUIRED, Mapping, spark_format

# Spellings of headers by field, the surest first, and the date formats that are tried.
HINTS = {
    "vendor_name": ("suppliername", "vendorname", "payeename", "supplier", "vendor", "payee"),
    "amount": ("totalprice", "totalamount", "grossamount", "linetotal", "amount", "value"),
    "txn_date": ("transactiondate", "invoicedate", "orderdate", "postingdate", "date"),
    "invoice_no": ("invoicenumber", "invoiceno", "billno", "documentno", "ponumber", "invoice"),
    "officer_id": ("officerid", "department", "requisitioner", "buyer", "costcentre", "office"),
    "item_desc": ("itemdescription", "description", "lineitem", "particulars", "item"),
    "item_category": ("itemcategory", "category", "commodity", "class", "segment"),
    "quantity": ("quantity", "qty", "units"),
    "unit_price": ("unitprice", "rateperunit", "priceperunit", "rate", "price"),
}
DATE_FORMATS = ("%Y-%m-%d", "%d-%m-%Y", "%m-%d-%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%b-%Y", "%d %b %Y", "%b %d, %Y", "%d.%m.%Y", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S")
DAY_FIRST, MONTH_FIRST = {"%d-%m-%Y", "%d/%m/%Y", "%d.%m.%Y"}, {"%m-%d-%Y", "%m/%d/%Y", "%m/%d/%Y %H:%M:%S"}


def plain(header: str) -> str:
    return re.sub("[^a-z0-9]", "", header.lower())


def guess(names: list[str]) -> dict[str, str | None]:
    """Which header is which field, as far as can be told. First every field takes the header that is one of its spellings; then those left, required ones first, take the only free header that holds one. A header serves once."""
    by_plain = {plain(h): h for h in names}
    found: dict[str, str | None] = dict.fromkeys(FIELDS)

    def free(h: str) -> bool:
        return h not in found.values()

    for field in FIELDS:
        found[field] = next((by_plain[k] for k in HINTS[field] if k in by_plain and free(by_plain[k])), None)
    for field in (*REQUIRED, *(f for f in FIELDS if f not in REQUIRED)):
        if found[field] is None:
            holding = ([h for k, h in by_plain.items() if hint in k and free(h)] for hint in HINTS[field])
            found[field] = next((hits[0] for hits in holding if len(hits) == 1), None)
    return found


def near(field: str, names: list[str]) -> list[str]:
    """Headers that hold any spelling of a field."""
    return [h for h in names if any(hint in plain(h) for hint in HINTS[field])]


def ambiguous(fits: set[str]) -> bool:
    """Whether formats fit that take different numbers for the month."""
    return bool(fits & DAY_FIRST and fits & MONTH_FIRST)


def parses(value: Column, strftime: str) -> Column:
    """Whether a text is a date of a format, as a lenient reader has it: days and months of one digit count."""
    f = spark_format(strftime).replace("dd", "d").replace("MM", "M") if "%b" not in strftime else spark_format(strftime).replace("dd", "d")
    return F.try_to_timestamp(value, F.lit(f)).isNotNull()


def fitting(values: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """format, parsed, fits for every candidate format, over all values."""
    v = text.clean(F.col(column))
    row = values.agg(F.count(v).alias("n"), *[F.count_if(parses(v, f)).alias(f"f{i}") for i, f in enumerate(DATE_FORMATS)])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("format"), F.col(f"f{i}").alias("parsed")) for i, f in enumerate(DATE_FORMATS)]))
    return row.select("n", each.alias("x")).select("x.format", "x.parsed", ((F.col("n") > 0) & (F.col("x.parsed") >= F.greatest(F.lit(1), F.floor(share * F.col("n"))))).alias("fits"))


def unparseable(values: DataFrame, column: str) -> Column:
    """How many texts that are not empty are no number after all but digits, points and signs is dropped."""
    v = F.col(f"`{column}`")
    return F.count_if(v.isNotNull() & (v != "") & F.regexp_replace(v, r"[^0-9.\-]", "").try_cast("double").isNull())


def preview(source: DataFrame, names: list[str] | None = None) -> dict:
    """What the columns would be taken for, what is missing, which date formats fit, how many amounts are no numbers, and whether it can be used: every required field has a header, there are rows, and exactly one date format fits. All rows are read; what reaches the driver is one row of counts."""
    names = names or source.columns
    found = guess(names)
    missing = [f for f in REQUIRED if not found[f]]
    counts = [F.count("*").alias("rows")]
    if found["amount"]:
        counts.append(unparseable(source, found["amount"]).alias("bad_amounts"))
    if found["txn_date"]:
        v = text.clean(F.col(f"`{found['txn_date']}`"))
        counts += [F.count(v).alias("dates"), *[F.count_if(parses(v, f)).alias(f"f{i}") for i, f in enumerate(DATE_FORMATS)]]
    r = source.agg(*counts).first().asDict()
    need = max(1, int(r.get("dates", 0) * 0.95))
    fits = [f for i, f in enumerate(DATE_FORMATS) if r.get("dates") and r[f"f{i}"] >= need]
    problems = ["no data"] * (not r["rows"])
    for f in missing:
        like = near(f, names)
        problems.append(f"{f} could be any of {', '.join(like)}" if like else f"no column looks like {f}")
    if bad := r.get("bad_amounts", 0):
        problems.append(f"{bad} of {r['rows']} amounts are no numbers" + "; the column is probably wrong" * (bad == r["rows"]))
    if found["txn_date"] and not fits:
        problems.append(f"no date format fits {found['txn_date']}")
    elif ambiguous(set(fits)):
        problems.append(f"{found['txn_date']} reads as day-month and as month-day")
    return {
        "rows": r["rows"], "suggested": found, "unmapped": sorted(h for h in names if h not in found.values()), "missing": missing, "bad_amounts": bad, "date_formats": fits, "problems": problems,
        "usable": not missing and r["rows"] > 0 and len(fits) == 1,
    }


def preview_file(spark: SparkSession, path: str) -> dict:
    """The same of a delimited file; rows of other widths are read as far as the header goes."""
    names = headers(spark, path)
    return preview(read_text_csv(spark, path, names), names)


def mapping_from(dataset: str, columns: dict[str, str | None], formats: tuple[str, ...] = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%b-%Y")) -> Mapping:
    """A mapping for a file that has none written for it."""
    return Mapping({f: columns.get(f) for f in FIELDS}, tuple(map(spark_format, formats)), dataset)


def target(root: str, dataset: str, protected: tuple[str, ...] = ()) -> str:
    """Where a dataset's own table goes; one that is being served is refused."""
    path = f"{root.rstrip('/')}/{dataset}"
    if path in {p.rstrip("/") for p in protected}:
        raise ValueError(f"{path} is in use")
    return path


def load(spark: SparkSession, path: str, mapping: Mapping, table: str) -> dict:
    """A file into its canonical table; counts of rows read, kept, dropped by reason and values coerced."""
    from ..sources.scratch import written
    from ..sources.tables import replace_table

    told = Observation()
    rows = ingest.stage(ingest.read_csv(spark, path, mapping), mapping)
    lost = [F.count_if(F.col("drop_reason").isNull() & F.col(c).isNotNull() & F.col(f"{c}_num").isNull()).alias(f"lost_{c}") for c in ("quantity", "unit_price")]
    gone = [F.count_if(F.col("drop_reason") == r).alias(r) for r in ingest.REASONS]
    # The counts come with the one pass that stores the rows.
    staged = written(rows.observe(told, F.count("*").alias("read"), *gone, *lost), "staged")
    replace_table(ingest.canonical_table(staged, mapping), table)
    n = told.get
    reasons = {r: n[r] for r in ingest.REASONS}
    return {"read": n["read"], "loaded": n["read"] - sum(reasons.values()), "dropped": reasons, "coerced": {c: n[f"lost_{c}"] for c in ("quantity", "unit_price")}}
