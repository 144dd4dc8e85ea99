"""Column summaries: all columns in one pass, histograms in a second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import SheetError, col, kind, text_form


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


#: The bounds of a median are looked for this far about it, by rank; different values between bounds are gathered when they are about this few.
NEAR, FEW = 0.002, 20_000


def median_within(values: DataFrame, n: int, low: float, high: float) -> float:
    """The exact median of n values (column v, no nulls) of which it is thought to lie between two bounds.  Bounds are narrowed
    by sketches and checked by counts until few values are left between them: no task ever holds or sorts them all."""
    ranks, margin, v = ((n - 1) // 2, n // 2), NEAR, F.col("v")
    # Mostly the first bounds are right and few different values are between them: one count of these, and of what is below, tells all.
    side = F.when(v < low, 0).when(v > high, 2).otherwise(1)
    held = values.groupBy(side.alias("side"), F.when(side == 1, v).alias("v")).agg(F.count(F.lit(1)).alias("k")).limit(FEW + 3).collect()
    if len(held) <= FEW + 2:
        below, inside = sum(r["k"] for r in held if r["side"] == 0), sorted((r["v"], r["k"]) for r in held if r["side"] == 1)
        if below <= ranks[0] and ranks[1] < below + sum(k for _, k in inside):
            return _middle(inside, below, ranks)
    lo, hi, below, m, kinds = -float("inf"), float("inf"), 0, n, n
    for _ in range(12):
        inside = F.when(v.between(low, high), v)
        row = values.agg(F.count(F.when(v < low, 1)).alias("under"), F.count(inside).alias("inside"), F.approx_count_distinct(inside).alias("kinds")).first()
        if row["under"] <= ranks[0] and ranks[1] < row["under"] + row["inside"]:
            lo, hi, below, m, kinds = low, high, row["under"], row["inside"], row["kinds"]
        else:
            margin *= 8
        if min(m, kinds) <= FEW or lo == hi:
            break
        p = [min(max((r - below) / m + d, 0.0), 1.0) for r, d in zip(ranks, (-margin, margin), strict=True)]
        low, high = values.where(v.between(lo, hi)).agg(F.percentile_approx("v", p, 10_000)).first()[0]
    else:
        return values.agg(F.median("v")).first()[0]
    if lo == hi:
        return lo
    return _middle(sorted(map(tuple, values.where(v.between(lo, hi)).groupBy("v").count().collect())), below, ranks)


def _middle(held: list[tuple[float, int]], seen: int, ranks: tuple[int, int]) -> float:
    """Of values in order with their counts, of which the first has rank `seen`, the mean of those of two ranks."""
    found = []
    for x, k in held:
        found += [x for r in ranks if seen <= r < seen + k]
        seen += k
    return sum(found) / 2


def summary(df: DataFrame, name: str) -> DataFrame:
    """One row: rows, count, empty, and for numbers sum, average, minimum, maximum, median; else approx_distinct and the least and greatest text."""
    c = col(df, name)
    base = [F.count(F.lit(1)).alias("rows"), F.count(c).alias("count"), F.count(F.when(c.isNull(), 1)).alias("empty")]
    if kind(df.schema[name].dataType) == "number":
        d = c.cast("double")
        ranked = F.when(F.isnan(d), float("inf")).otherwise(d)  # as the greatest, like everywhere
        made = df.agg(*base, *[finite(f(d)).alias(n) for n, f in (("sum", F.sum), ("average", F.avg), ("minimum", F.min), ("maximum", F.max))], F.percentile_approx(ranked, [0.5 - NEAR, 0.5 + NEAR], 2_000).alias("near"))
        row = made.first()
        middle = median_within(df.select(ranked.alias("v")).where("v is not null"), row["count"], *row["near"]) if row["count"] else None
        middle = None if middle is None or abs(middle) == float("inf") or middle != middle else middle
        return df.sparkSession.createDataFrame([(*row[:-1], middle)], made.drop("near").withColumn("median", F.lit(None).cast("double")).schema)
    t = text_form(df, name)
    return df.agg(*base, F.approx_count_distinct(c).alias("approx_distinct"), F.min(t).alias("minimum"), F.max(t).alias("maximum"))


def profile(df: DataFrame, names: list[str]) -> DataFrame:
    """column, rows, count, empty, minimum, maximum (as text) of many columns by one aggregate."""
    n = F.count(F.lit(1)).alias("rows")
    aggs = [a for i, name in enumerate(names) for a in (F.count(col(df, name)).alias(f"c{i}"), F.min(col(df, name)).cast("string").alias(f"a{i}"), F.max(col(df, name)).cast("string").alias(f"z{i}"))]
    row = df.agg(n, *aggs)
    parts = F.array(*[F.struct(F.lit(name).alias("column"), F.col("rows"), F.col(f"c{i}").alias("count"), (F.col("rows") - F.col(f"c{i}")).alias("empty"), F.col(f"a{i}").alias("minimum"), F.col(f"z{i}").alias("maximum")) for i, name in enumerate(names)])
    return row.select(F.explode(parts).alias("x")).select("x.*")


def histogram(df: DataFrame, name: str, bins: int = 24) -> DataFrame:
    """bin, low, n: equal bins, the last one closed, empty ones with 0; a constant column has one."""
    values = df.select(finite(col(df, name).cast("double")).alias("v")).where("v is not null")
    edges = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null")
    edges = edges.select("lo", ((F.col("hi") - F.col("lo")) / bins).alias("w"), F.when(F.col("hi") > F.col("lo"), bins).otherwise(1).alias("k"))
    place = F.when(F.col("w") > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.col("k") - 1)).otherwise(0)
    counts = values.join(F.broadcast(edges)).select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    slots = edges.select("lo", "w", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    return slots.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def histograms(df: DataFrame, names: list[str], bins: int = 24) -> DataFrame:
    """column, bin, low, n for many number columns: their bounds by one aggregate, then one count of (column, bin)."""
    cs = [finite(col(df, n).cast("double")) for n in names]
    bounds = df.agg(*[f(c).alias(f"{p}{i}") for i, c in enumerate(cs) for p, f in (("a", F.min), ("z", F.max))])
    edges = bounds.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"a{i}").alias("lo"), ((F.col(f"z{i}") - F.col(f"a{i}")) / bins).alias("w"), F.when(F.col(f"z{i}") > F.col(f"a{i}"), bins).otherwise(1).alias("k")) for i, n in enumerate(names)])).alias("e")).select("e.*").where("lo is not null")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c.alias("v")) for n, c in zip(names, cs, strict=True)])).alias("x")).select("x.*").where("v is not null")
    place = F.when(F.col("w") > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.col("k") - 1)).otherwise(0)
    counted = values.join(F.broadcast(edges), "column").groupBy("column", place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    slots = edges.select("column", "lo", "w", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    return slots.join(counted, ["column", "bin"], "left").select("column", "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


#: Values a sketch tracks for each column, and how many of the most frequent are counted again.
TRACKED, CANDIDATES = 10_000, 100


def frequent(df: DataFrame, names: list[str], limit: int = 12) -> DataFrame:
    """column, value (text form), n: each column's most frequent values with their exact counts, ties by value (blanks last).

    Two scans for all columns: sketches name candidates, which the second scan counts.  A value that is none of them occurs no more often than
    the last candidate's estimate and the sketch's error allow; a column whose counts do not exceed that is counted in full."""
    if not 1 <= limit <= CANDIDATES // 2:
        raise SheetError(f"limit must be 1 to {CANDIDATES // 2}")
    spark, texts = df.sparkSession, [text_form(df, n) for n in names]
    base = df.select(*[t.alias(f"t{i}") for i, t in enumerate(texts)])
    row = base.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"approx_top_k(t{i}, {CANDIDATES}, {TRACKED})").alias(f"k{i}") for i in range(len(names))]).first()
    found = [[(x["item"], x["count"]) for x in row[f"k{i}"]] for i in range(len(names))]
    held = lambda i: F.coalesce(F.col(f"t{i}").isin(*[v for v, _ in found[i] if v is not None]), F.lit(False)) | F.col(f"t{i}").isNull()
    some = base.select(F.explode(F.filter(F.array(*[F.when(held(i), F.struct(F.lit(i).alias("c"), F.col(f"t{i}").alias("value"))) for i in range(len(names))]), lambda x: x.isNotNull())).alias("x")).select("x.*")
    exact: dict[int, dict] = {i: {} for i in range(len(names))}
    for r in some.groupBy("c", "value").agg(F.count(F.lit(1)).alias("n")).collect():  # CANDIDATES rows a column
        exact[r["c"]][r["value"]] = r["n"]
    rows, rest = [], []
    for i, name in enumerate(names):
        top = sorted(exact[i].items(), key=lambda x: (-x[1], x[0] is None, x[0] or ""))
        other = max(found[i][-1][1] if len(found[i]) == CANDIDATES else 0, -(-7 * row["n"] // (2 * TRACKED)))
        if sum(exact[i].values()) == row["n"] or (len(top) >= limit and top[limit - 1][1] > other):
            rows += [(name, v, n) for v, n in top[:limit]]
        else:
            rest.append(i)
    out = spark.createDataFrame(rows, "column string, value string, n long")
    if rest:
        full = base.select(F.explode(F.array(*[F.struct(F.lit(names[i]).alias("column"), F.col(f"t{i}").alias("value")) for i in rest])).alias("x")).select("x.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value")))
        out = out.unionByName(full.withColumn("place", place).where(F.col("place") <= limit).drop("place"))
    return out
