"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def number(c: Column) -> Column:
    """Money-like text to a number, or null. Currency marks, grouping commas and white space are dropped."""
    return F.regexp_replace(c, r"(?i)rs\.?|inr|usd|₹|\$|,|\s", "").try_cast("double")


def date(c: Column, formats: tuple[str, ...]) -> Column:
    """The first format that parses wins."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def core_numbers(invoice: Column, day: Column) -> Column:
    """Digit groups of an invoice number, without those that are a year next to the date's."""
    y = F.year(day).cast("long")
    years = F.array(*[e for k in (-1, 0, 1) for e in (y + k, (y + k) % 100)])
    found = F.transform(F.regexp_extract_all(F.coalesce(invoice, F.lit("")), F.lit(r"(\d+)"), 1), lambda x: x.try_cast("long"))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull() & ~F.array_contains(years, x)))


def indian_money(amount: Column) -> Column:
    """Lakh and crore grouping with two decimals."""
    text = F.format_string("%.2f", F.abs(amount.cast("double")))
    whole, rest = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    head = F.when(F.length(whole) > 3, F.concat(F.regexp_replace(F.left(whole, F.length(whole) - 3), r"(?<=\d)(?=(\d\d)+$)", ","), F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    sign = F.when((amount < 0) & (text != "0.00"), "-").otherwise("")
    return F.concat(sign, F.lit("₹"), head, F.lit("."), rest)


def retrieval_tokens(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9₹.,]+)"), 1), lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", "")), lambda w: w != "")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID of name in a namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def same_text(a: Column, b: Column) -> Column:
    """Equality of what two texts say: case, blanks and enclosing marks aside."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), r"\s+", " "), r"""^[ .'"]+|[ .'"]+$""", "")
    return plain(a) == plain(b)


#: How dates are written in notes.
NOTE_DATES = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy")


def stated_date(c: Column) -> Column:
    """A date as a note states it; a time after an ISO date is left out."""
    text = F.trim(c)
    iso = F.try_to_timestamp(F.substring(text, 1, 10), F.lit(NOTE_DATES[0])).cast("date")
    return F.coalesce(iso, date(text, NOTE_DATES[1:]))


def stated_number(c: Column) -> Column:
    """A number as a note states it, as an exact decimal; null where it is none."""
    text = F.regexp_replace(c, r"(?i)₹|\brs\.?|\binr\b|,|\s", "")
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), text.cast("decimal(30,8)"))


def places(c: Column) -> Column:
    """How many decimals a stated number has."""
    return F.length(F.regexp_extract(F.regexp_replace(c, r"\s", ""), r"\.(\d*)$", 1))


def same_number(stated: Column, actual: Column) -> Column:
    """Whether a stated number is the actual one, rounded half up to as many places as are stated."""
    scale = F.pow(F.lit(10), F.least(places(stated), F.lit(8))).cast("decimal(10,0)")
    exact = actual.cast("string").cast("decimal(30,8)")
    scaled = F.abs(exact).cast("decimal(24,8)") * scale
    rounded = F.floor(scaled + F.lit("0.5").cast("decimal(2,1)")) * F.signum(actual).cast("int")
    return F.coalesce((stated_number(stated).cast("decimal(24,8)") * scale).cast("decimal(30,8)") == rounded.cast("decimal(30,8)"), F.lit(False))


def to_prose(c: Column) -> Column:
    """Markdown as sentences: rows of a table are lists, bullets are sentences, rules and marks go."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^[|\-: ]+$"))
    cells = lambda x: F.array_join(F.filter(F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), lambda y: F.trim(y)), lambda y: y != ""), ", ")
    said = F.transform(lines, lambda x: F.when(x.startswith("|"), cells(x)).when(x.rlike(r"^[-*+]"), F.trim(F.regexp_replace(x, r"^[-*+ ]+", ""))).otherwise(x))
    ended = F.transform(said, lambda x: F.concat(F.regexp_replace(x, r"\.+$", ""), F.lit(".")))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(ended, " "), r"\*\*|__|`", ""), r"\s+", " "))


def bump_invoice(invoice: Column, step: Column) -> Column:
    """The number step further in an invoice's series: its last run of digits grows and keeps its width; without digits the step is appended."""
    head, digits, tail = (F.regexp_extract(invoice, r"(?s)^(.*?)(\d+)(\D*)$", i) for i in (1, 2, 3))
    bumped = (digits.cast("decimal(38,0)") + step).cast("string")
    width = F.greatest(F.length(digits), F.length(bumped))
    return F.when(invoice.isNull(), None).when(digits == "", F.concat_ws("-", invoice, step.cast("string"))).otherwise(F.concat(head, F.lpad(bumped, width, "0"), tail))


def reformatted_invoices(invoice: Column, day: Column) -> Column:
    """Other ways to write an invoice's number, without the way it is written."""
    core = F.when(invoice.rlike(r"\d"), F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(invoice, r"(\d+)\D*$", 1), "^0+", ""), F.lit("")), F.lit("0"))).otherwise(invoice)
    turned = F.when(invoice.contains("-"), F.replace(invoice, F.lit("-"), F.lit("/"))).otherwise(F.replace(invoice, F.lit("/"), F.lit("-")))
    ways = F.array(core, F.concat_ws("/", core, F.year(day).cast("string")), turned, F.concat_ws("/", core, F.lpad((F.year(day) % 100).cast("string"), 2, "0")))
    return F.filter(ways, lambda x: x != invoice)


def fiscal_year(day: Column) -> Column:
    """The financial year from April to March, as 24-25."""
    first = F.year(day) - F.when(F.month(day) < 4, 1).otherwise(0)
    return F.concat_ws("-", *[F.lpad((x % 100).cast("string"), 2, "0") for x in (first, first + 1)])
