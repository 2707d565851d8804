"""Duplicate records: comparison vectors and a Fellegi-Sunter model fitted on their counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Thresholds
from ..functions.names import identity_name, name_similarity
from ..functions.text import core_numbers
from ..sources.scratch import cleaned, discard, written
from .bands import at_most, band

# Where the share of each level among duplicates starts.
FIELDS = (("name", (0.70, 0.20, 0.10)), ("invoice", (0.45, 0.45, 0.05, 0.05)), ("context", (0.85, 0.08, 0.05, 0.02)), ("date_gap", (0.40, 0.35, 0.25)))
#: What pairs are compared by.
COMPARED = ("row_id", "vendor_name", "invoice_no", "amount", "txn_date", "officer_id", "item_category", "quantity")
#: So many pairs, at most, are counted by names and levels in one round; what a round shuffles is no more than a line a pair.
ROUND_PAIRS = 1 << 29
STRENGTH, SMOOTH, PRIOR = 50.0, 1e-3, (2.0, 38.0)


def comparable(tx: DataFrame, named: bool = True) -> DataFrame:
    """The columns that pairs are compared by, and what is worked out once a row rather than once a pair, stored: the view is read once. name_id: a number for each vendor_name, which pairs carry in its place (left out unless named); only: the single digit group of an invoice number that has one."""
    core = core_numbers(F.col("invoice_no"), F.col("txn_date"))
    rows = tx.select(*COMPARED).withColumns({"invoice": F.lower(F.trim("invoice_no")), "core": core}).drop("invoice_no").withColumn("only", F.when(F.size("core") == 1, F.col("core")[0]))
    rows = written(rows, "compared")
    if not named:
        return rows
    names = written(rows.select("vendor_name").where("vendor_name is not null").distinct().withColumn("name_id", F.monotonically_increasing_id()), "named")
    return written(rows.join(names, "vendor_name", "left"), "compared")


def levels(pairs: DataFrame) -> DataFrame:
    """invoice, context and date_gap levels of pairs of comparable rows from bands.band; 0 is the strongest agreement."""
    same = lambda c: F.col(f"p_{c}") == F.col(f"q_{c}")
    sure = lambda c: F.coalesce(c, F.lit(False))
    # Nearly all numbers have one group, for which no set has to be made.
    one = F.col("p_only").isNotNull() & F.col("q_only").isNotNull()
    shared = F.when(one, same("only")).otherwise(F.arrays_overlap("p_core", "q_core"))
    invoice = F.when(F.col("p_invoice").isNull() | F.col("q_invoice").isNull(), 3).when(same("invoice"), 0).when(shared, 1).otherwise(2)
    officer, item = sure(same("officer_id")), sure(same("item_category")) & F.col("p_quantity").eqNullSafe(F.col("q_quantity"))
    context = F.when(officer & item & same("amount"), 0).when(officer & item, 1).when(officer | item, 2).otherwise(3)
    gap = F.when(F.col("gap") <= 3, 0).when(F.col("gap") <= 7, 1).otherwise(2)
    return pairs.withColumns({"invoice": invoice, "context": context, "date_gap": gap})


def may_be_alike(a: F.Column, b: F.Column, shared: F.Column, least: float) -> F.Column:
    """Whether two texts, of which so many letters are shared, can be alike by least of 100: their longest common subsequence is no longer than that, nor than the shorter text."""
    both = F.length(a) + F.length(b)
    return 200.0 * F.least(shared, F.length(a), F.length(b)) >= least * both


def similar_names(pairs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """p_vendor_name, q_vendor_name, name (its level) of the distinct pairs of names that are alike enough. Lengths and shared letters rule out pairs before they are compared in Python; a name's own form is made once."""
    names = pairs.select("p_vendor_name", "q_vendor_name").distinct()
    each = names.select(F.explode(F.array("p_vendor_name", "q_vendor_name")).alias("vendor_name")).distinct().withColumn("form", identity_name("vendor_name"))
    # The n-th of a letter gets the number n, so that a set's overlap counts letters.
    ordered = F.array_sort(F.split("form", ""))
    told = written(each.withColumn("ordered", ordered).withColumn("letters", F.transform("ordered", lambda c, i: F.concat(c, (i - F.array_position(F.col("ordered"), c)).cast("string")))).drop("ordered"), "names")
    side = lambda x: told.select(F.col("vendor_name").alias(f"{x}_vendor_name"), F.col("form").alias(f"{x}_form"), F.col("letters").alias(f"{x}_letters"))
    both = names.join(side("p"), "p_vendor_name").join(side("q"), "q_vendor_name")
    shared = F.size(F.array_intersect("p_letters", "q_letters"))
    left = both.where(may_be_alike(F.col("p_form"), F.col("q_form"), shared, t.name_confirm)).select("p_vendor_name", "q_vendor_name")
    sim = left.withColumn("sim", name_similarity("p_vendor_name", "q_vendor_name")).where(F.col("sim") >= t.name_confirm)
    alike = written(sim.select("p_vendor_name", "q_vendor_name", "sim", F.when(F.col("sim") >= 95, 0).when(F.col("sim") >= 88, 1).otherwise(2).alias("name")), "alike")
    discard(told)
    return alike


def fit(counts: dict[tuple[int, ...], int], reference: dict[tuple[int, ...], int] | None = None, t: Thresholds = DEFAULT) -> tuple[dict[tuple[int, ...], float], list, list]:
    """MAP-EM over the distinct vectors (144 at most): posterior of each, and the level shares m and u."""
    n = sum(counts.values())
    m = [list(p) for _, p in FIELDS]

    def shares(c: dict[tuple[int, ...], int], j: int, smooth: float) -> list[float]:
        x = [smooth + sum(k for v, k in c.items() if v[j] == level) for level in range(len(FIELDS[j][1]))]
        return [y / sum(x) for y in x]

    fixed = reference is not None and sum(reference.values()) >= t.min_reference_pairs and n > 0
    # The date gap of reference pairs is of another window, so its shares come from the candidates.
    source = lambda f: counts if f == "date_gap" else reference
    u = [shares(source(f), j, SMOOTH * sum(source(f).values())) if fixed else shares(counts, j, SMOOTH) for j, (f, _) in enumerate(FIELDS)]
    prior = 0.1

    def posterior(v: tuple[int, ...]) -> float:
        z = math.log(prior / (1 - prior)) + sum(math.log(m[j][x]) - math.log(u[j][x]) for j, x in enumerate(v))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

    for _ in range(t.em_rounds if n >= 20 else 0):
        w = {v: k * posterior(v) for v, k in counts.items()}
        total = sum(w.values())
        old = prior, [*map(list, m)], [*map(list, u)]
        prior = min(1 - 1e-4, max(1e-4, (total + PRIOR[0]) / (n + sum(PRIOR))))
        for j, (_, start) in enumerate(FIELDS):
            x = [sum(k for v, k in w.items() if v[j] == level) + STRENGTH * s + SMOOTH for level, s in enumerate(start)]
            m[j] = [y / sum(x) for y in x]
            if not fixed:
                x = [sum(counts[v] - k for v, k in w.items() if v[j] == level) + SMOOTH for level in range(len(start))]
                u[j] = [y / sum(x) for y in x]
        if abs(prior - old[0]) + max(abs(a - b) for new, was in ((m, old[1]), (u, old[2])) for p, q in zip(new, was, strict=True) for a, b in zip(p, q, strict=True)) < 1e-6:
            break
    return {v: posterior(v) for v in counts}, m, u


def vector_counts(vectors: DataFrame) -> dict[tuple[int, ...], int]:
    """How many pairs have each vector: 144 at most. vectors: the levels and n."""
    names = [f for f, _ in FIELDS]
    return {tuple(r[f] for f in names): r["n"] for r in vectors.groupBy(*names).agg(F.sum("n").alias("n")).collect()}


def weights(m: list, u: list) -> list[tuple[str, int, float, float, float]]:
    """field, level, m, u and match weight (binary logarithm of m / u) of every level."""
    return [(f, i, float(m[j][i]), float(u[j][i]), round(math.log2(m[j][i] / u[j][i]), 2)) for j, (f, start) in enumerate(FIELDS) for i in range(len(start))]


ALIKE = ("p_name_id", "q_name_id", "invoice", "context", "date_gap")


def names_of(rows: DataFrame, pairs: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """p_name_id, q_name_id, sim, name of the pairs of names in pairs that are alike enough. A pair of names is compared once, whichever comes first."""
    names = written(rows.select("name_id", "vendor_name").where("name_id is not null").distinct(), "named")
    side = lambda x: names.select(F.col("name_id").alias(f"{x}_name_id"), F.col("vendor_name").alias(f"{x}_vendor_name"))
    met = pairs.select(F.least("p_name_id", "q_name_id").alias("p_name_id"), F.greatest("p_name_id", "q_name_id").alias("q_name_id")).where("p_name_id is not null").distinct()
    told = written(met.join(side("p"), "p_name_id").join(side("q"), "q_name_id"), "met")
    found = similar_names(told, t)
    alike = written(told.join(found, ["p_vendor_name", "q_vendor_name"]).select("p_name_id", "q_name_id", "sim", "name"), "alike")
    discard(names, told, found)
    other = alike.where("p_name_id <> q_name_id").select(F.col("q_name_id").alias("p_name_id"), F.col("p_name_id").alias("q_name_id"), "sim", "name")
    return alike.unionByName(other)


def candidates(rows: DataFrame, t: Thresholds = DEFAULT, vectors: list[tuple[int, ...]] | None = None) -> DataFrame:
    """a_row_id, b_row_id, sim and the four levels of pairs close in amount and time whose names pass, whatever the vendor keys. vectors: only pairs that have one of these; of the others nothing is stored and no name is compared."""
    names = [f for f, _ in FIELDS]
    pairs = levels(band(rows, t.dup_tolerance, (0, t.dup_days)))
    if vectors is not None:
        table = rows.sparkSession.createDataFrame(vectors, ", ".join(f"{f} int" for f in names))  # 144 rows at most
        pairs = pairs.join(F.broadcast(table.select(*names[1:]).distinct()), names[1:], "left_semi")
    pairs = written(pairs.select(F.least("p_row_id", "q_row_id").alias("a_row_id"), F.greatest("p_row_id", "q_row_id").alias("b_row_id"), *ALIKE), "pairs")
    found = pairs.join(names_of(rows, pairs, t), ["p_name_id", "q_name_id"]).select("a_row_id", "b_row_id", "sim", *names)
    return found if vectors is None else found.join(F.broadcast(table), names, "left_semi")


def counted(rows: DataFrame, days: tuple[int, int], t: Thresholds = DEFAULT) -> DataFrame:
    """The vectors, with their numbers n, of pairs close in amount and days[0]..days[1] apart whose names pass.

    Pairs are counted by names and levels as they are met, in rounds over the names that come first: no pair is stored, and what a round shuffles is gone when the next begins, so disk does not grow with the square of the rows. A vector's line a round reaches the driver.
    """
    rounds = max(1, -(-at_most(rows, t.dup_tolerance, days) // ROUND_PAIRS))
    first, second = F.least("p_name_id", "q_name_id").alias("p_name_id"), F.greatest("p_name_id", "q_name_id").alias("q_name_id")
    total: dict[tuple[int, ...], int] = {}
    for k in range(rounds):
        some = F.col("name_id").isNotNull() & (F.pmod(F.xxhash64("name_id"), F.lit(rounds)) == k)
        lines = written(levels(band(rows, t.dup_tolerance, days, some=some)).where("q_name_id is not null").select(first, second, *ALIKE[2:]).groupBy(*ALIKE).agg(F.count("*").alias("n")), "counted")
        alike = names_of(rows, lines, t)
        with cleaned(rows.sparkSession):
            for v, n in vector_counts(lines.join(alike, ["p_name_id", "q_name_id"])).items():
                total[v] = total.get(v, 0) + n
        discard(lines, alike)
    return rows.sparkSession.createDataFrame([(*map(int, v), n) for v, n in total.items()], ", ".join(f"{f} int" for f, _ in FIELDS) + ", n long")


def reference(rows: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The vectors, with their numbers n, of pairs that pass the same checks but are too far apart in time to be duplicates."""
    return counted(rows, t.reference_days, t)


def model(tx: DataFrame, t: Thresholds = DEFAULT) -> tuple[dict[tuple[int, ...], float], list, list, DataFrame]:
    """Posteriors of the vectors, m, u and the rows compared; u is of the reference. Only counts reach the driver."""
    rows = comparable(tx)
    post, m, u = fit(vector_counts(counted(rows, (0, t.dup_days), t)), vector_counts(reference(rows, t)), t)
    return post, m, u, rows


def linked(tx: DataFrame, t: Thresholds = DEFAULT, least: float = 0.0) -> DataFrame:
    """Every candidate pair with its posterior of being a duplicate, if that is least or more."""
    post, _, _, rows = model(tx, t)
    names = [f for f, _ in FIELDS]
    table = rows.sparkSession.createDataFrame([(*map(int, v), float(p)) for v, p in post.items() if p >= least], ", ".join(f"{f} int" for f in names) + ", posterior double")  # 144 rows at most
    near = candidates(rows, t, [tuple(map(int, v)) for v, p in post.items() if p >= least] if least > 0 else None)
    return near.join(F.broadcast(table), names)


def model_frame(tx: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """The fitted model: field, level, m, u, match_weight."""
    _, m, u, rows = model(tx, t)
    return rows.sparkSession.createDataFrame(weights(m, u), "field string, level int, m double, u double, match_weight double")
