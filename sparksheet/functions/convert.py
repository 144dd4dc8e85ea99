"""Turning text into numbers, dates and booleans without guessing wrong, and typing whole columns without loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import SheetError, col, text_form

#: Layouts by the shape of the text; day first or month first where the text does not say.
ISO = (("yyyy-MM-dd", r"\d{4}-\d{1,2}-\d{1,2}"), ("yyyy/MM/dd", r"\d{4}/\d{1,2}/\d{1,2}"), ("yyyy.MM.dd", r"\d{4}\.\d{1,2}\.\d{1,2}"))
CLOCK = (("", ""), (" HH:mm:ss", r" \d{1,2}:\d{2}:\d{2}"), (" HH:mm", r" \d{1,2}:\d{2}"))
NAMED = (
    ("d MMM yyyy", r"\d{1,2} [A-Za-z]{3} \d{4}"), ("d MMMM yyyy", r"\d{1,2} [A-Za-z]{4,} \d{4}"), ("d-MMM-yyyy", r"\d{1,2}-[A-Za-z]{3}-\d{4}"), ("d-MMMM-yyyy", r"\d{1,2}-[A-Za-z]{4,}-\d{4}"),
    ("MMM d, yyyy", r"[A-Za-z]{3} \d{1,2}, \d{4}"), ("MMMM d, yyyy", r"[A-Za-z]{4,} \d{1,2}, \d{4}"), ("MMM d yyyy", r"[A-Za-z]{3} \d{1,2} \d{4}"), ("MMMM d yyyy", r"[A-Za-z]{4,} \d{1,2} \d{4}"),
)
COMPACT = (("yyyyMMdd", r"(19|20)\d{6}"), ("yyyyMMddHHmmss", r"(19|20)\d{12}"))
#: Marks that stand about a number, and currency codes as a word before or after it.
MARKS = "$€£¥₪₹%'’ \t\u00a0\u202f"
CODES = ("USD", "EUR", "GBP", "ILS", "NIS", "JPY", "CHF", "CAD", "AUD", "INR", "CNY", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "MXN", "BRL", "ZAR")
DIGITS = "0123456789"


def _stamp(t: Column, pattern: str, shape: str) -> Column:
    if "MMM" not in pattern and pattern[4:6] != "MM":  # one or two digits each
        pattern = pattern.replace("MM", "M").replace("dd", "d").replace("HH", "H")
    return F.when(t.rlike(f"^{shape}$"), F.try_to_timestamp(t, F.lit(pattern)))


def _short_year(t: Column) -> Column:
    """3-Mar-24 and 3 Mar 24, read like two-digit years elsewhere (69 to 99: 19xx)."""
    m = r"^(\d{1,2}[ -][A-Za-z]{3})[ -](\d{2})$"
    year = F.regexp_extract(t, m, 2).try_cast("int")
    text = F.concat(F.translate(F.regexp_extract(t, m, 1), "-", " "), F.lit(" "), F.when(year >= 69, year + 1900).otherwise(year + 2000).cast("string"))
    return F.when(t.rlike(m), F.try_to_timestamp(text, F.lit("d MMM yyyy")))


def day_month(t: Column, day_first: bool) -> Column:
    """d/m/y or m/d/y with / - or . between, a four- or two-digit year (69 to 99: 19xx), a time or none."""
    m = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})((?: \d{1,2}:\d{2}(?::\d{2})?)?)$"
    part = lambda i: F.regexp_extract(t, m, i)
    year = part(3).try_cast("int")
    full = F.when(F.length(part(3)) == 4, year).when(year >= 69, year + 1900).otherwise(year + 2000)
    day, month = (part(1), part(2)) if day_first else (part(2), part(1))
    text = F.concat(F.lpad(full.cast("string"), 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.when(part(4) == "", " 0:00:00").when(F.length(part(4)) < 7, F.concat(part(4), F.lit(":00"))).otherwise(part(4)))
    return F.when(t.rlike(m), F.try_to_timestamp(text, F.lit("yyyy-MM-dd H:mm:ss")))


def to_timestamp(t: Column, day_first: bool | None = None, layout: str | None = None) -> Column:
    """Null where no layout fits.  day_first None: day first where that is a date, else month first."""
    t = F.trim(t)
    if layout:
        return F.try_to_timestamp(t, F.lit(layout))
    tries = [_stamp(t, p + c, s + r) for p, s in ISO for c, r in CLOCK] + [F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(T| \d{2}:\d{2}:\d{2}\.\d)"), t.try_cast("timestamp"))]
    tries += [day_month(t, True), day_month(t, False)] if day_first is None else [day_month(t, day_first)]
    tries += [_stamp(t, p, s) for p, s in NAMED + COMPACT] + [_short_year(t)]
    return F.coalesce(*tries)


def _in_threes(whole: Column, mark: str) -> Column:
    """Whether the mark cuts a whole number into a first group of one to three digits and further ones of three."""
    groups = F.split(whole, "\\" + mark)
    return F.length(F.get(groups, F.lit(0))).between(1, 3) & F.forall(F.slice(groups, F.lit(2), F.size(groups)), lambda g: F.length(g) == 3)


def to_number(t: Column) -> Column:
    """Marks and currency codes about the number go; (x) and x- are negative.  The last of its separators is the decimal
    one if it stands once: 1.234,56, 1,234.56, 12,5.  Marks that only part groups of three are none: 1,234 and 1.234.567."""
    s = F.trim(t)
    s = F.when(F.substring_index(s, " ", 1).isin(*CODES), F.regexp_replace(s, r"^\S+\s+", "")).otherwise(s)
    s = F.when(F.substring_index(s, " ", -1).isin(*CODES), F.regexp_replace(s, r"\s+\S+$", "")).otherwise(s)
    s = F.translate(s, MARKS, "")
    bracketed, behind = F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")")), F.endswith(s, F.lit("-"))
    s = F.when(bracketed, F.btrim(s, F.lit("()"))).when(behind, F.rtrim(s, F.lit("-"))).otherwise(s)
    body = F.when(F.substring(s, 1, 1).isin("+", "-"), F.substring(s, 2, 1 << 20)).otherwise(s)
    marks = F.translate(body, DIGITS, "")
    commas, dots = F.replace(marks, F.lit(","), F.lit("")) == "", F.replace(marks, F.lit("."), F.lit("")) == ""
    before, last = F.substring(marks, F.lit(1), F.length(marks) - 1), F.right(marks, F.lit(1))
    fraction = lambda mark: F.length(F.substring_index(body, mark, -1)) > 0
    bare = F.replace(s, F.lit(","), F.lit(""))
    plain = (
        F.when(marks == "", s)
        .when(commas & _in_threes(body, ","), bare)
        .when(marks == ",", F.when(fraction(","), F.translate(s, ",", ".")))
        .when(dots & (F.length(marks) > 1), F.when(_in_threes(body, "."), F.replace(s, F.lit("."), F.lit(""))))
        .when((last == ".") & (F.length(before) > 0) & (F.replace(before, F.lit(","), F.lit("")) == ""), F.when(fraction(".") & _in_threes(F.substring_index(body, ".", 1), ","), bare))
        .when((last == ",") & (F.length(before) > 0) & (F.replace(before, F.lit("."), F.lit("")) == ""), F.when(fraction(",") & _in_threes(F.substring_index(body, ",", 1), "."), F.translate(F.replace(s, F.lit("."), F.lit("")), ",", ".")))
        .when(F.translate(marks, ".+-eE", "") == "", s)
    )
    n = plain.try_cast("double")
    return F.when(bracketed | behind, -F.abs(n)).otherwise(n)


def converted(df: DataFrame, name: str, to: str, day_first: bool | None = None, layout: str | None = None) -> Column:
    """The column as text, number, integer, date, datetime or boolean; null where that fails."""
    t = text_form(df, name)
    made = {
        "text": lambda: t,
        "number": lambda: to_number(t),
        "integer": lambda: F.round(to_number(t)).try_cast("bigint"),
        "date": lambda: to_timestamp(t, day_first, layout).cast("date"),
        "datetime": lambda: to_timestamp(t, day_first, layout),
        "boolean": lambda: F.trim(t).try_cast("boolean"),
    }
    if to not in made:
        raise SheetError(f"cannot convert to {to!r}")
    return made[to]()


def preview(df: DataFrame, name: str, to: str) -> DataFrame:
    """One row: rows, filled, converted, failed, blank, ambiguous (dates that read differently day or month first)."""
    c, t = converted(df, name, to), text_form(df, name)
    filled = t.isNotNull() & (F.trim(t) != "")
    both = ~day_month(F.trim(t), True).eqNullSafe(day_month(F.trim(t), False)) & day_month(F.trim(t), True).isNotNull() & day_month(F.trim(t), False).isNotNull() if to in ("date", "datetime") else F.lit(False)
    count = lambda p: F.count(F.when(p, 1))
    return df.agg(F.count(F.lit(1)).alias("rows"), count(filled).alias("filled"), count(c.isNotNull()).alias("converted"), count(filled & c.isNull()).alias("failed"), count(~F.coalesce(filled, F.lit(False))).alias("blank"), count(both).alias("ambiguous"))


def failures(df: DataFrame, name: str, to: str, day_first: bool | None = None, layout: str | None = None, limit: int = 12) -> DataFrame:
    """value, n: what a conversion would lose, the most frequent first (ties by value)."""
    t = text_form(df, name)
    lost = df.where(t.isNotNull() & (F.trim(t) != "") & converted(df, name, to, day_first, layout).isNull())
    return lost.groupBy(t.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def samples(df: DataFrame, name: str, to: str, day_first: bool | None = None, layout: str | None = None, limit: int = 5) -> DataFrame:
    """before, after (text): different values that convert, the least first."""
    made = df.select(text_form(df, name).alias("before"), converted(df, name, to, day_first, layout).cast("string").alias("after"))
    return made.where("after is not null").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n")).orderBy("before").limit(limit).select("before", "after")


#: What a column must look like throughout to take a type without losing a digit or a zero.
_WHOLE, _REAL = r"^\s*[+-]?[0-9]{1,19}(\.0*)?\s*$", r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_DATE, _STAMP = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"


def _long(c: Column) -> Column:
    return F.when(c.contains("."), F.regexp_replace(F.trim(c), r"\.0*$", "")).otherwise(F.trim(c)).try_cast("bigint")


def _same_double(c: Column) -> Column:
    """Whether a number text (of the shape _REAL) is the same number as a double: 15 digits always are, more only if the double prints them back."""
    digits = F.length(F.ltrim(F.regexp_replace(F.regexp_replace(c, r"[eE].*$", ""), r"[^0-9]", ""), F.lit("0")))
    d, exact = F.trim(c).try_cast("double"), F.trim(c).try_cast("decimal(38,18)")
    return (F.abs(d) < float("inf")) & ((digits <= 15) | (F.length(F.regexp_extract(c, r"\.([0-9]*)", 1)).between(0, 18) & F.coalesce(exact == d.try_cast("decimal(38,18)"), F.lit(False))))


def lossless(df: DataFrame, names: list[str] | None = None, layout: str | None = None) -> DataFrame:
    """Types text columns: the first of bigint, double, date, timestamp that fits every value of all rows without
    changing any; values with leading zeros keep a column text.  One aggregate over all columns decides, after one over the first rows.
    layout: one pattern that dates are written in, tried beside the usual two."""
    return typed(df, names, layout)[0]


def typed(df: DataFrame, names: list[str] | None = None, layout: str | None = None) -> tuple[DataFrame, int, dict[str, int]]:
    """lossless(df), how many rows there are, and for each column that stays text how many of its dates could be day or month first: by the same aggregate."""
    names = names or [n for n, t in df.dtypes if t == "string"]
    day = lambda c: F.when(c.rlike(_DATE), c.try_cast("date"))
    stamp = lambda c: F.when(c.rlike(_STAMP) | c.rlike(_DATE), c.try_cast("timestamp"))
    given = lambda c: F.try_to_timestamp(F.trim(c), F.lit(layout))
    midnight = lambda c: F.date_trunc("day", given(c)) == given(c)
    real = lambda c: F.when(F.length(c) <= 15, F.abs(F.trim(c).try_cast("double")) < float("inf")).otherwise(_same_double(c))
    # What is behind `when` runs for values of the right shape only.
    forms = [("a", lambda c: F.when(c.rlike(_WHOLE), _long(c).isNotNull()), _long), ("b", lambda c: F.when(c.rlike(_REAL), real(c)), lambda c: F.trim(c).try_cast("double")), ("c", lambda c: day(c).isNotNull(), day), ("d", lambda c: stamp(c).isNotNull(), stamp)]
    if layout:
        forms += [("e", lambda c: F.coalesce(midnight(c), F.lit(False)), lambda c: given(c).cast("date")), ("f", lambda c: given(c).isNotNull(), given)]
    both = lambda t: F.coalesce(day_month(t, True) != day_month(t, False), F.lit(False))

    def test(rows: DataFrame, kinds: list[str], dates: bool) -> dict:
        """Rows, filled cells (n), leading zeros (z), dates of two readings (m), and of each type asked for a column the cells that do not fit."""
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, n in enumerate(names):
            c = col(df, n)
            aggs += [F.count(c).alias(f"n{i}"), F.count(F.when(c.rlike("^[+-]?0[0-9]"), 1)).alias(f"z{i}")]
            aggs += [F.count(F.when(c.rlike(r"^\s*\d{1,2}[/.-]\d{1,2}[/.-]\d{2}"), F.when(both(F.trim(c)), 1))).alias(f"m{i}")] * dates
            aggs += [F.count(F.when(c.isNotNull() & ~F.coalesce(fits(c), F.lit(False)), 1)).alias(f"{k}{i}") for k, fits, _ in forms if k in kinds[i]]
        return rows.agg(*aggs).first().asDict()

    def possible(row: dict, kinds: list[str]) -> list[str]:
        return ["".join(k for k in kinds[i] if not row[f"{k}{i}"] and (k in "cdef" or not row[f"z{i}"])) for i in range(len(names))]

    # The first rows rule most types out; all rows are tested for the others.
    every = ["".join(k for k, _, _ in forms)] * len(names)
    kinds = possible(test(df.limit(1000), every, False), every)
    row = test(df, kinds, True)
    left = possible(row, kinds)
    make = {k: f for k, _, f in forms}
    out = {n: make[left[i][0]](col(df, n)) for i, n in enumerate(names) if row[f"n{i}"] and left[i]}
    two_ways = {n: row[f"m{i}"] for i, n in enumerate(names) if n not in out and row[f"m{i}"]}
    return df.withColumns(out) if out else df, row["rows"], two_ways
