"""A policy document as clauses and thresholds."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.text import to_prose
from .retrieval import bm25

DASHES = "\u2014\u2013-"
# Which row of a policy's table is which threshold.
MIRRORED = {"principal_control_threshold": "approval", "split_detection_window": "split_days", "heightened_scrutiny_windows": "scrutiny_days", "duplicate_amount_tolerance": "dup_tolerance", "duplicate_date_window": "dup_days", "new_vendor_period": "new_vendor_days"}


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))


def _section(line: Column) -> Column:
    """The title of a line that heads a section ('## title'), else null."""
    return F.when(line.startswith("## "), F.nullif(F.trim(F.substr(line, F.lit(4))), F.lit("")))


def _clause(line: Column, prefix: str) -> Column:
    """id and title of a line that heads a clause, in bold: the prefix with numbers, a dash, a title that may end in a stop; else null."""
    bold = F.rtrim(line)
    inner = F.substr(bold, F.lit(3), F.length(bold) - 4)
    name = F.split_part(inner, F.lit(" "), F.lit(1))
    rest = F.ltrim(F.substr(inner, F.length(name) + 1))
    numbered = F.translate(F.substr(name, F.lit(len(prefix) + 2)), "0123456789.", "") == ""
    title = F.rtrim(F.ltrim(rest, F.lit(DASHES + " ")), F.lit(". "))
    fits = bold.startswith(f"**{prefix}-") & bold.endswith("**") & numbered & F.instr(F.lit(DASHES), F.substr(rest, F.lit(1), F.lit(1))).between(1, len(DASHES)) & (title != "")
    return F.when(fits, F.struct(name.alias("id"), title.alias("title")))


def clauses(docs: DataFrame, prefix: str = "SG-PP") -> DataFrame:
    """doc_id, clause_id, title, section, text, prose of each clause: its heading's body up to the next clause or section, never cut by length. A clause without a body is none. docs: doc_id, text."""
    lines = _lines(docs).withColumns({"_section": _section(F.col("line")), "_clause": _clause(F.col("line"), prefix)})
    is_clause, is_section = F.col("_clause").isNotNull(), F.col("_section").isNotNull()
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # What each line is under: the last heading of either kind.
    marked = lines.withColumns({
        "section": F.last("_section", ignorenulls=True).over(before), "under": F.last(F.when(is_section, F.lit(-1)).when(is_clause, F.col("at")), ignorenulls=True).over(before),
        "clause_id": F.last("_clause.id", ignorenulls=True).over(before), "title": F.last("_clause.title", ignorenulls=True).over(before),
    })
    body = marked.where((F.col("under") >= 0) & (F.col("under") < F.col("at")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    out = body.groupBy("doc_id", "under", "clause_id", "title", F.coalesce("section", F.lit("Procurement policy")).alias("section")).agg(text.alias("text"))
    out = out.withColumn("text", F.regexp_replace(F.regexp_replace("text", "\n{3,}", "\n\n"), r"^\s+|\s+$", "")).where("text <> ''")
    whole = F.concat_ws(". ", "section", F.trim("title"), "text")
    return out.select("doc_id", "clause_id", F.trim("title").alias("title"), "section", "text", to_prose(whole).alias("prose"))


def threshold(raw: Column) -> Column:
    """The numbers of a cell of the summary table: '3 and 7 days', '0.5%', '14 days', '₹2,50,000'. Words that hold a digit are read as numbers, a hundredth of them where they end in a per cent sign; null where there is none, or more than a unit follows the last."""
    words = F.filter(F.split(F.translate(raw, "*`", ""), " "), lambda w: w != "")
    numbers = F.filter(words, lambda w: F.translate(w, "0123456789", "") != w)
    last = F.element_at(numbers, -1)
    read = F.transform(numbers, lambda w: F.regexp_replace(w, "[^0-9.]", "").try_cast("double") / F.when(w.endswith("%"), 100.0).otherwise(1.0))
    clear = (F.size(numbers) > 0) & (F.size(words) - F.array_position(words, last) <= 1) & F.forall(read, lambda x: x.isNotNull())
    return F.when(F.size(numbers) > 0, F.when(clear, read))


def thresholds(docs: DataFrame, heading: str = "## Threshold summary") -> DataFrame:
    """doc_id, key, raw_value, value, clause, used_by: rows of four cells in the table under the heading."""
    lines = _lines(docs)
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(F.when(F.col("line").startswith("## "), F.trim("line") == heading), ignorenulls=True).over(before)
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(F.regexp_replace(x, r"\*\*|`", "")))
    rows = lines.withColumn("_in", inside).where(F.col("_in") & F.trim("line").startswith("|")).select("doc_id", cells.alias("c")).where(F.size("c") == 4)
    rows = rows.where((F.lower(F.col("c")[0]) != "parameter") & ~F.col("c")[0].rlike("^[-:]+$"))
    key = F.regexp_replace(F.regexp_replace(F.lower(F.col("c")[0]), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return rows.select("doc_id", key.alias("key"), F.col("c")[1].alias("raw_value"), threshold(F.col("c")[1]).alias("value"), F.col("c")[2].alias("clause"), F.col("c")[3].alias("used_by"))


def mismatches(found: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Keys where a policy's table and the configuration differ: key, policy, configured. A key that the table lacks has no policy value."""
    own = {k: asdict(t)[f] for k, f in MIRRORED.items()}
    rows = [(k, [float(x) for x in (v if isinstance(v, tuple) else (v,))]) for k, v in own.items()]
    config = found.sparkSession.createDataFrame(rows, "key string, configured array<double>")
    return config.join(found.select("key", F.col("value").alias("policy")), "key", "left").where(~F.col("policy").eqNullSafe(F.col("configured")))


def fingerprint(found: DataFrame, model: str) -> DataFrame:
    """doc_id, fingerprint: a digest of the very texts that are looked up, in order, and of the model's name; what is kept under it is good until either changes."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clause_id", "prose"))), lambda x: F.concat_ws("\t", x["clause_id"], x["prose"])), "\n")
    return found.groupBy("doc_id").agg(F.sha2(F.concat_ws("\n", F.lit(model), texts), 256).alias("fingerprint"))


def lookup(found: DataFrame, words: list[str], k: int = 3) -> DataFrame:
    """The k clauses that say most about the words, whole and with their ids."""
    named = found.select(F.concat_ws("/", F.col("doc_id").cast("string"), "clause_id").alias("doc_id"), F.col("prose").alias("text"))
    best = bm25(named, words, k)
    return best.join(named, "doc_id").select(F.col("doc_id").alias("clause"), "score", "text")
