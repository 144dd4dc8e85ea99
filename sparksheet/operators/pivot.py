"""Pivot tables: subtotals and totals from base rows, overflow headers in an Other column, shares, running totals, ranks.

A table is made in two steps.  Base rows are first summed up by row keys and header: one shuffle, of partial sums, however
many headers there are.  Most measures get their subtotals from these.  Medians and distinct counts need the different values:
base rows are summed up by row keys, header and value, and levels are made of these sums, so base rows are read
and shuffled once and never copied for a level.  A median is found by its rank among the values' counts, by ranges of values
where a group has many, so that no task holds a group (`medians`).  Only what is left after that, a row for each
group and header, is spread into columns.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import SheetError, col, kind
from ..scratch import cut as written
from .paging import ROW_KEY, running, sorted_copy
from .predicates import keep

GROUPS = ("year", "quarter", "month", "week", "day", "hour")
CARRIED = ("sum", "count", "count_all", "avg", "min", "max", "stddev", "first")
BY_VALUE = ("median", "count_distinct")
#: Medians of groups of more different values than this are looked for by ranges of values.
FEW = 200_000
LABELS = {"sum": "Sum", "count": "Count Numbers", "count_all": "Count", "count_distinct": "Distinct Count", "avg": "Average", "min": "Min", "max": "Max", "median": "Median", "stddev": "StdDev", "first": "First"}


def field(df: DataFrame, spec: str | dict) -> Column:
    """A row or column field: a name, or {column, group} for dates, {column, bin} for numbers."""
    spec = {"column": spec} if isinstance(spec, str) else spec
    c, t = col(df, spec["column"]), df.schema[spec["column"]].dataType
    if group := spec.get("group"):
        if group not in GROUPS or kind(t) != "date":
            raise SheetError(f"cannot group {spec['column']!r} by {group!r}")
        if isinstance(t, (T.DateType, T.TimestampNTZType)) and group != "hour":  # whole days need no clock and no zone
            day = c.cast("date")
            return (day if group == "day" else F.trunc(day, group)).cast(t)
        cut = F.date_trunc(group, c)
        return cut.cast("date") if isinstance(t, T.DateType) else cut.cast(t)
    if "bin" in spec and spec["bin"] is not None:
        if kind(t) != "number" or not spec["bin"] > 0:
            raise SheetError("bands need a number column and a positive width")
        return (F.floor(c.cast("double") / float(spec["bin"])) * float(spec["bin"])).cast("double")
    return c


def _partials(agg: str, c: Column | None, key: Column | None, shift: float) -> list[Column]:
    """What a measure that can be carried on is summed up from.  Deviations are summed from `shift`, a value of the column, so that squares lose no digits."""
    d = c.cast("double") - F.lit(shift) if agg == "stddev" else c
    return {
        "sum": lambda: [F.sum(c)], "count": lambda: [F.count(c)], "count_all": lambda: [F.count(F.lit(1))], "min": lambda: [F.min(c)], "max": lambda: [F.max(c)], "avg": lambda: [F.sum(c.cast("double")), F.count(c)],
        "stddev": lambda: [F.count(d), F.sum(d), F.sum(d * d)], "first": lambda: [F.first(c) if key is None else F.min(F.struct(key.alias("k"), c.alias("x")))],
    }[agg]()


def _carried(agg: str, parts: list[Column], ordered: bool) -> Column:
    """The measure, from such partial results; first goes by the row key, if there is one."""
    if agg == "avg":
        return F.try_divide(F.sum(parts[0]), F.sum(parts[1]))
    if agg in ("count", "count_all"):
        return F.coalesce(F.sum(parts[0]), F.lit(0)).cast("bigint")
    if agg == "stddev":
        n, total, squares = (F.sum(p).cast("double") for p in parts)
        return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1))))
    if agg == "first":
        return F.min(parts[0])["x"] if ordered else F.first(parts[0], ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[agg](parts[0])


def medians(cells: DataFrame, group: list[str]) -> DataFrame:
    """group.., x: the exact medians of groups of numbers v that occur k times each (cells of group.., v, k).

    If no group has more than FEW different values, each group's are gathered.  Else cells are dealt by ranges of (group, value):
    counts of the ranges tell in which one or two of a group's ranges its middle ranks are, and only these are numbered."""
    held = written(cells.withColumn("v", F.col("v").cast("double")))
    if (held.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= FEW:
        return held.groupBy(*group).agg(F.percentile("v", F.lit(0.5), F.col("k")).alias("x"))
    of = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in group]).alias("g")
    placed = written(held.select(of, "v", "k").repartitionByRange("g", "v").select("*", F.spark_partition_id().alias("p")))
    ranges, every = placed.groupBy("g", "p").agg(F.sum("k").alias("n")), W.partitionBy("g")
    before = F.coalesce(F.sum("n").over(every.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("g", "p", "n", before.alias("before"), F.sum("n").over(every).alias("all"))
    ranges = ranges.select("g", "p", "n", "before", F.expr("(all - 1) div 2").alias("low"), F.expr("all div 2").alias("high")).where((F.col("before") <= F.col("high")) & (F.col("before") + F.col("n") > F.col("low")))
    upto = F.col("before") + F.sum("k").over(W.partitionBy("g", "p").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    hit = lambda rank: F.when((F.col("upto") - F.col("k") <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.col("v") / 2)
    found = placed.join(ranges.drop("n"), ["g", "p"]).withColumn("upto", upto).groupBy("g").agg((F.sum(hit("low")) + F.sum(hit("high"))).alias("x"))
    return found.select(*[F.col("g")[c].alias(c) for c in group], "x")


def _finite(df: DataFrame) -> DataFrame:
    """Measures that are no number become null."""
    out = {f.name: F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)) for f in df.schema if f.name[0] == "v" and isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(out) if out else df


def label(spec: dict) -> str:
    return spec.get("label") or (LABELS[spec.get("agg", "sum")] + (f" of {spec['column']}" if spec.get("column") else ""))


def headers(base: DataFrame, n: int, max_columns: int) -> tuple[list[tuple], bool]:
    """The most frequent header combinations in display order (by text, blanks last), and whether there are more."""
    names = [f"c{i}" for i in range(n)]
    top = base.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *[F.asc_nulls_last(F.col(c).cast("string")) for c in names]).limit(max_columns + 1).collect()
    kept = [tuple(r[c] for c in names) for r in top[:max_columns]]
    return sorted(kept, key=lambda k: [(v is None, str(v)) for v in k]), len(top) > max_columns


def pivot(df: DataFrame, rows: list, columns: list = (), values: list[dict] = (), filters: list[dict] = (), max_columns: int = 40, subtotals: bool = True) -> DataFrame:
    """r0.. (row keys), _depth (0 detail, up to len(rows) the grand total), v0.. (one for each header and value, then
    Other, then the row's total).  At most 200 headers visit the driver."""
    if not 1 <= max_columns <= 200:
        raise SheetError("max_columns must be 1 to 200")
    values = list(values) or [{"agg": "count_all"}]
    rows, columns = list(rows), list(columns)
    picked = [field(df, f).alias(f"r{i}") for i, f in enumerate(rows)] + [field(df, f).alias(f"c{i}") for i, f in enumerate(columns)]
    for j, v in enumerate(values):
        if v.get("agg", "sum") not in CARRIED + BY_VALUE:
            raise SheetError(f"unknown aggregate {v.get('agg')!r}")
        if v.get("column"):
            c = col(df, v["column"])
            picked.append((c.cast("decimal(20,0)") if v.get("agg", "sum") == "sum" and isinstance(df.schema[v["column"]].dataType, T.LongType) else c).alias(f"m{j}"))
    ordered = ROW_KEY in df.columns and any(v.get("agg") == "first" for v in values)
    base = keep(df, list(filters)).select(*picked, *[F.col(ROW_KEY)] * ordered, F.lit(0).alias("_at"))
    n_headers = 0
    if columns:
        kept, more = headers(base, len(columns), max_columns)
        match = [reduce(lambda a, b: a & b, [F.col(f"c{i}").eqNullSafe(F.lit(v)) for i, v in enumerate(k)]) for k in kept]
        base = base.withColumn("_at", F.coalesce(*[F.when(m, i) for i, m in enumerate(match)], F.lit(len(kept))))
        n_headers = len(kept) + more
    keys, n_values = [f"r{i}" for i in range(len(rows))], len(values)
    of = lambda j: F.col(f"m{j}") if values[j].get("column") else None
    kinds = [v.get("agg", "sum") for v in values]
    levels = [keys[:n] for n in range(len(keys), -1 if subtotals or not keys else len(keys) - 1, -1)]
    key = F.col(ROW_KEY) if ordered else None
    shifts = [_some(base, f"m{j}") if k == "stddev" else 0.0 for j, k in enumerate(kinds)]
    plain = [j for j, k in enumerate(kinds) if k in CARRIED]
    parts = {j: [p.alias(f"p{j}_{i}") for i, p in enumerate(_partials(kinds[j], of(j), key, shifts[j]))] for j in plain}
    partials = [p for ps in parts.values() for p in ps]
    if len(plain) == n_values:
        fine = base.groupBy(*keys, "_at").agg(*partials)
        where = [F.col("_at") == i for i in range(n_headers)] + [F.lit(True)]
        aggs = [_carried(k, [F.when(w, F.col(f"p{j}_{i}")) for i in range(len(parts[j]))], ordered).alias(f"v{at * n_values + j}") for at, w in enumerate(where) for j, k in enumerate(kinds)]
        found = fine.groupingSets([[F.col(k) for k in level] for level in levels], *keys) if keys else fine.groupBy()
        depth = sum((F.grouping(k).cast("int") for k in keys), F.lit(0))
        return _finite(found.agg(depth.alias("_depth"), *aggs).select(*keys, "_depth", *[f"v{i}" for i in range(len(aggs))]))
    group = [*keys, *["_at"] * bool(n_headers)]
    sets = [[F.col(k) for k in level] + own for level in levels for own in (([F.col("_at")], []) if n_headers else ([],))]
    flags = [F.grouping(k).cast("int").alias(f"g_{k}") for k in group]
    depth = sum((F.col(f"g_{k}") for k in keys), F.lit(0)).cast("int").alias("_depth")
    at = (F.when(F.col("g__at") == 1, n_headers).otherwise(F.col("_at")) if n_headers else F.lit(0)).alias("_at")

    def by_level(table: DataFrame, aggs: list[Column], more: tuple = ()) -> DataFrame:
        """The table's groups of every level, with flags; more: further columns to group by."""
        return table.groupingSets([[*s, *map(F.col, more)] for s in sets], *group, *more).agg(*aggs, *flags) if group else table.groupBy(*more).agg(*aggs)

    # One table of sums by group and value for each column whose values count; the first one has the other measures' sums too.
    first, long = True, None
    for name in dict.fromkeys(values[j]["column"] for j in range(n_values) if j not in plain):
        js = [j for j in range(n_values) if j not in plain and values[j]["column"] == name]
        summed = written(base.groupBy(*group, F.col(f"m{js[0]}").alias("v")).agg(F.count(F.lit(1)).alias("k"), *(partials if first else [])))
        cells = by_level(summed.where("v is not null").select(*group, "v", "k"), [F.sum("k").alias("k")], ("v",))
        names = [*group, *[f"g_{k}" for k in group]]
        made = [by_level(summed, [F.sum("k").alias("_rows"), *[_carried(kinds[j], [F.col(f"p{j}_{i}") for i in range(len(parts[j]))], ordered).alias(f"x{j}") for j in plain]])] if first else []
        if any(kinds[j] == "median" for j in js):
            cells = written(cells)
        made += [medians(cells, names).withColumnRenamed("x", f"x{j}") if kinds[j] == "median" else cells.groupBy(*names).agg(F.count(F.lit(1)).alias(f"x{j}")) for j in js]
        for x in made:
            x = x.select(*keys, depth, at, *[c for c in x.columns if c[0] == "x"])
            long = x if long is None else long.unionByName(x, allowMissingColumns=True)
        first = False
    spread = [F.max(F.when(F.col("_at") == place, F.col(f"x{j}"))) for place in range(n_headers + 1) for j in range(n_values)]
    # A group has no row of its own for a header or values that it lacks: counts are 0 there.
    spread = [F.coalesce(s, F.lit(0)) if kinds[i % n_values].startswith("count") else s for i, s in enumerate(spread)]
    out = long.groupBy(*keys, "_depth").agg(*[s.alias(f"v{i}") for i, s in enumerate(spread)])
    return _finite(out.select(*keys, "_depth", *[f"v{i}" for i in range(len(spread))]))


def _some(base: DataFrame, name: str) -> float:
    """A value of a column, 0 if it has none that is a number."""
    d = F.col(name).cast("double")
    row = base.select(d.alias("d")).where(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))).limit(1).first()
    return row["d"] if row else 0.0


def sort_rows(result: DataFrame, key: str | None = None, direction: str = "desc") -> DataFrame:
    """A pivot's rows in order: by keys, each subtotal under what it totals; by a row field (r0..), then the other keys; or by a measure (v0..) within each depth."""
    keys = [c for c in result.columns if c[0] == "r"]
    plain = [F.asc_nulls_last(k) for k in keys]
    if key is None:
        return result.orderBy(*[x for k, order in zip(keys, plain, strict=True) for x in (F.col("_depth") >= len(keys) - keys.index(k), order)], "_depth")
    if key not in result.columns or key == "_depth":
        raise SheetError(f"no column {key!r} to sort by")
    own = F.desc_nulls_last(key) if direction.lower().startswith("d") else F.asc_nulls_last(key)
    if key in keys:
        return result.orderBy(own, *[o for k, o in zip(keys, plain, strict=True) if k != key], "_depth")
    return result.orderBy("_depth", own, *plain)


def first_rows(result: DataFrame, limit: int = 2000, key: str | None = None, direction: str = "desc") -> tuple[DataFrame, bool]:
    """The first rows in order, and whether there are more; the grand total always stays and does not count."""
    if not 1 <= limit <= 50_000:
        raise SheetError("limit must be 1 to 50000")
    deep = len([c for c in result.columns if c[0] == "r"])
    body = result.where(F.col("_depth") < deep) if deep else result
    top = sort_rows(body, key, direction).limit(limit)
    more = body.limit(limit + 1).count() > limit
    return sort_rows(top.unionByName(result.where(F.col("_depth") == deep)), key, direction) if deep else top, more


def field_label(spec: str | dict) -> str:
    """X, X (month), X (bands of 10)."""
    spec = {"column": spec} if isinstance(spec, str) else spec
    if spec.get("group"):
        return f"{spec['column']} ({spec['group']})"
    return f"{spec['column']} (bands of {spec['bin']:g})" if spec.get("bin") else spec["column"]


def key_label(df: DataFrame, spec: str | dict, key: Column) -> Column:
    """A key as it is shown: a period, a band from low to high, the text form; (blank) for null."""
    spec = {"column": spec} if isinstance(spec, str) else spec
    if spec.get("group"):
        return period_label(key, spec["group"])
    plain = lambda c: F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
    shown = F.concat(plain(key), F.lit(" – "), plain(key + float(spec["bin"]))) if spec.get("bin") else key.cast("string")
    return F.coalesce(shown, F.lit("(blank)"))


def tabular(df: DataFrame, result: DataFrame, rows: list) -> DataFrame:
    """The pivot as it is read: one text column for each row field, parents first, each label at its own level only, the grand total last; then _level and v0.. ."""
    keys, n = [f"r{i}" for i in range(len(rows))], len(rows)
    level = F.lit(n) - F.col("_depth")  # how many keys a row has
    labels = [F.when(level == i + 1, key_label(df, f, F.col(k))).when((level == 0) & (F.lit(i) == 0), F.lit("Grand Total")).otherwise(F.lit("")).alias(field_label(f)) for i, (f, k) in enumerate(zip(rows, keys, strict=True))]
    order = [(level == 0).asc()] + [x for i, k in enumerate(keys) for x in ((level > i).asc(), F.asc_nulls_last(k))]
    return result.orderBy(*order).select(*labels, level.alias("_level"), *[c for c in result.columns if c[0] == "v"])


def with_totals(df: DataFrame, result: DataFrame, rows: list) -> DataFrame:
    """The pivot as a flat table in order: every row with its parents' labels, Total in the first key that a subtotal sums over, Grand total last."""
    keys, n = [f"r{i}" for i in range(len(rows))], len(rows)
    level = F.lit(n) - F.col("_depth")
    labels = [F.when(level > i, key_label(df, f, F.col(k))).when(level == i, F.lit("Total" if i else "Grand total")).otherwise(F.lit("")).alias(field_label(f)) for i, (f, k) in enumerate(zip(rows, keys, strict=True))]
    order = [x for i, k in enumerate(keys) for x in ((level <= i).asc(), F.asc_nulls_last(k))]
    return result.orderBy(*order).select(*labels, *[c for c in result.columns if c[0] == "v"])


def value_labels(kept: list[tuple], more: bool, values: list[dict]) -> list[str]:
    """What v0.. are called, header by header (those of headers(), then Other and the row's total)."""
    heads = [", ".join("(blank)" if x is None else str(x) for x in k) for k in kept] + ["Other"] * more
    return [f"{h} — {label(v)}" for h in heads for v in values] + [f"Total — {label(v)}" if heads else label(v) for v in values]


def to_csv(table: DataFrame, path: str, overwrite: bool = False) -> None:
    """A tabular pivot as one file for spreadsheet programs: UTF-8 with a byte-order mark, lines ended by CR LF, the header first."""
    quoted = lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    names = [c for c in table.columns if c != "_level"]
    line = F.concat_ws(",", *[quoted(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in names])
    head = table.sparkSession.createDataFrame([tuple(names)], ", ".join(f"`h{i}` string" for i in range(len(names))))
    first = head.select(F.lit(-1).cast("long").alias("at"), F.concat(F.lit("\ufeff"), F.concat_ws(",", *[quoted(F.col(f"h{i}")) for i in range(len(names))])).alias("value"))
    lines = first.unionByName(table.select(F.monotonically_increasing_id().alias("at"), line.alias("value")))
    one = lines.coalesce(1).sortWithinPartitions("at").select("value")  # a report: sorted and limited before
    one.write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", "\r\n").text(path)


def show_as(result: DataFrame, value: str, how: str, total: str | None = None, out: str | None = None) -> DataFrame:
    """A value column as pct_total, pct_column (of the grand row's same column), pct_row (of the row's total column), running or rank."""
    keys = [c for c in result.columns if c.startswith("r")]
    deep, v, out = len(keys), F.col(value), out or value
    if how == "pct_row":
        return result.withColumn(out, F.try_divide(v.cast("double"), F.when(F.col(total) != 0, F.col(total)).cast("double")))
    if how in ("pct_total", "pct_column"):
        grand = result.where(F.col("_depth") == deep).select(F.col(total if how == "pct_total" and total else value).cast("double").alias("_grand"))
        return result.join(F.broadcast(grand), how="left").withColumn(out, F.try_divide(v.cast("double"), F.when(F.col("_grand") != 0, F.col("_grand")))).drop("_grand")
    if how not in ("running", "rank"):
        raise SheetError(f"cannot show as {how!r}")
    display = [F.asc_nulls_last(k) for k in keys]
    mine, rest = (F.col("_depth") == 0) & v.isNotNull(), (F.col("_depth") != 0) | v.isNull()
    if how == "running":
        return running(result.where(mine), display, value, out).unionByName(result.where(rest).withColumn(out, v))
    ranked = sorted_copy(result.where(mine), [v.desc_nulls_last(), *display]).numbered()
    return ranked.withColumn(out, (F.col("_at") + 1).cast("int")).drop("_at").unionByName(result.where(rest).withColumn(out, F.lit(None).cast("int")))


#: How long a period lasts.
SPANS = {"year": {"years": 1}, "quarter": {"months": 3}, "month": {"months": 1}, "week": {"weeks": 1}, "day": {"days": 1}, "hour": {"hours": 1}}


def drill(df: DataFrame, rows: list, keys: list, filters: list[dict] = ()) -> DataFrame:
    """The base rows behind a cell: row and column fields with their keys, null for blank.  Periods and bands become ranges of the column itself, which reach the scan."""
    out = keep(df, list(filters))
    for f, k in zip(rows, keys, strict=True):
        spec = {"column": f} if isinstance(f, str) else f
        field(df, spec)  # a field that cannot be is refused here
        c, t = col(df, spec["column"]), df.schema[spec["column"]].dataType
        if k is None or not (spec.get("group") or spec.get("bin")):
            out = out.where(c.isNull() if k is None else c.eqNullSafe(F.lit(k)))
        elif spec.get("group"):
            low = F.lit(str(k)).cast(t)
            out = out.where((c >= low) & (c < (low + F.make_interval(**{n: F.lit(v) for n, v in SPANS[spec["group"]].items()})).cast(t)))
        else:
            out = out.where((c >= F.lit(float(k))) & (c < F.lit(float(k) + float(spec["bin"]))))
    return out


def drill_other(df: DataFrame, columns: list, max_columns: int, filters: list[dict] = ()) -> DataFrame:
    """The rows behind the Other column."""
    base = keep(df, list(filters)).select("*", *[field(df, f).alias(f"c{i}") for i, f in enumerate(columns)])
    kept, _ = headers(base, len(columns), max_columns)
    any_kept = reduce(or_, [reduce(lambda a, b: a & b, [F.col(f"c{i}").eqNullSafe(F.lit(v)) for i, v in enumerate(k)]) for k in kept], F.lit(False))
    return base.where(~any_kept).drop(*[f"c{i}" for i in range(len(columns))])


#: How a period is shown.
PERIODS = {"year": "yyyy", "quarter": "'Q'q yyyy", "month": "MMM yyyy", "week": "'Week of' MMM d, yyyy", "day": "d MMM yyyy", "hour": "HH:'00'"}


def period_label(c: Column, group: str) -> Column:
    """2024, Q1 2024, Mar 2024, Week of Mar 4, 2024, 4 Mar 2024, 09:00; (blank) for null."""
    return F.coalesce(F.date_format(c, PERIODS[group]), F.lit("(blank)"))


def auto_layout(df: DataFrame, names: list[str]) -> dict:
    """Where fields go by default: numbers to values, dates to rows by month, the rest to rows."""
    kinds = {n: kind(df.schema[n].dataType) for n in names}
    return {"rows": [{"column": n, "group": "month"} if k == "date" else n for n, k in kinds.items() if k != "number"], "values": [{"column": n, "agg": "sum"} for n, k in kinds.items() if k == "number"]}
