"""The library's registered queries and their SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adhoc, sinks
from .functions.convert import failures, lossless, preview, samples
from .operators import clean, paging, pivot, predicates, profile
from .scratch import fresh_path
from .sources import folder, text, workbook

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(name: str):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, table: str, make, sql: str | None) -> None:
    QUERIES[name] = lambda spark, d: make(_table(table)(spark, d))
    if sql:
        ORACLES[name] = sql


_FILTERS = {
    "in": ("customer", {"column": "c_mktsegment", "values": ["BUILDING", "MACHINERY", None]}, "c_mktsegment IN ('BUILDING','MACHINERY') OR c_mktsegment IS NULL"),
    "not_in": ("customer", {"column": "c_mktsegment", "values": ["BUILDING"]}, "c_mktsegment NOT IN ('BUILDING') OR c_mktsegment IS NULL"),
    "between": ("customer", {"column": "c_acctbal", "value": 0, "value2": 5000}, "c_acctbal BETWEEN 0 AND 5000"),
    "not_between": ("customer", {"column": "c_acctbal", "value": 0, "value2": 5000}, "c_acctbal NOT BETWEEN 0 AND 5000"),
    "contains": ("customer", {"column": "c_mktsegment", "value": "uil"}, "c_mktsegment ILIKE '%uil%'"),
    "not_contains": ("customer", {"column": "c_mktsegment", "value": "uil"}, "c_mktsegment IS NULL OR c_mktsegment NOT ILIKE '%uil%'"),
    "starts_with": ("customer", {"column": "c_mktsegment", "value": "bu"}, "c_mktsegment ILIKE 'bu%'"),
    "ends_with": ("customer", {"column": "c_mktsegment", "value": "ng"}, "c_mktsegment ILIKE '%ng'"),
    "equals_text": ("customer", {"column": "c_nationkey", "value": "7"}, "CAST(c_nationkey AS VARCHAR) = '7'"),
    "not_equals_text": ("customer", {"column": "c_nationkey", "value": "7"}, "c_nationkey IS NULL OR CAST(c_nationkey AS VARCHAR) <> '7'"),
    "regex": ("customer", {"column": "c_mktsegment", "value": "^[A-H].*G$"}, "regexp_matches(c_mktsegment, '^[A-H].*G$')"),
    "eq": ("customer", {"column": "c_nationkey", "value": 3}, "c_nationkey = 3"),
    "ne": ("customer", {"column": "c_nationkey", "value": 3}, "c_nationkey IS NULL OR c_nationkey <> 3"),
    "gt": ("customer", {"column": "c_acctbal", "value": 1000}, "c_acctbal > 1000"),
    "gte": ("customer", {"column": "c_acctbal", "value": 1000}, "c_acctbal >= 1000"),
    "lt": ("customer", {"column": "c_acctbal", "value": 1000}, "c_acctbal < 1000"),
    "lte": ("customer", {"column": "c_acctbal", "value": 1000}, "c_acctbal <= 1000"),
    "any_contains": ("customer", {"columns": ["c_name", "c_mktsegment"], "value": "auto"}, "c_name ILIKE '%auto%' OR c_mktsegment ILIKE '%auto%'"),
}
#: The tables have no nulls and no blanks: two market segments become that.
_HOLES = "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END AS segment FROM customer"
for _op, _where in (("is_null", "segment IS NULL"), ("is_not_null", "segment IS NOT NULL"), ("is_blank", "segment IS NULL OR segment = ''"), ("is_not_blank", "segment <> ''")):
    _add(f"filter_{_op}", "customer", lambda df, op=_op: predicates.keep(df.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", None).when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.col("c_mktsegment")).alias("segment")), [{"op": op, "column": "segment"}]), f"SELECT * FROM ({_HOLES}) WHERE {_where}")
for _op, (_t, _spec, _where) in _FILTERS.items():
    _add(f"filter_{_op}", _t, lambda df, s={"op": _op, **_spec}: predicates.keep(df, [s]), f"SELECT * FROM {_t} WHERE {_where}")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to 2 places, stamps as text: what both engines print alike."""
    return df.select(*[F.round(F.col(f.name), 2).alias(f.name) if f.dataType.simpleString() == "double" else F.date_format(f.name, "yyyy-MM-dd").alias(f.name) if "timestamp" in f.dataType.simpleString() else F.col(f.name) for f in df.schema])


_add("count_filtered", "orders", lambda df: predicates.keep(df, [{"op": "gt", "column": "o_totalprice", "value": 100000}]).agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
_add("page_sorted", "orders", lambda df: paging.select(paging.page(df, 0, 200, [{"column": "o_totalprice", "direction": "desc"}], tiebreak=["o_orderkey"]), ["o_orderkey", "o_totalprice"]), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 200")
_add("page_offset", "orders", lambda df: paging.select(paging.page(df, 500, 100, [{"column": "o_orderpriority"}], tiebreak=["o_orderkey"]), ["o_orderkey", "o_orderpriority"]), "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority NULLS LAST, o_orderkey LIMIT 100 OFFSET 500")
_add("top_values", "customer", lambda df: paging.top_values(df, "c_nationkey"), "SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
_add("checklist_search", "customer", lambda df: paging.top_values(df, "c_mktsegment", 1000, "a"), "SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment ILIKE '%a%' GROUP BY 1")
_add("summary_number", "lineitem", lambda df: _rounded(profile.summary(df, "l_extendedprice")), "SELECT count(*) AS rows, count(l_extendedprice) AS count, count(*) - count(l_extendedprice) AS empty, round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 2) AS average, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum, round(median(l_extendedprice), 2) AS median FROM lineitem")
_add("summary_text", "customer", lambda df: profile.summary(df, "c_mktsegment").drop("approx_distinct"), "SELECT count(*) AS rows, count(c_mktsegment) AS count, count(*) - count(c_mktsegment) AS empty, min(c_mktsegment) AS minimum, max(c_mktsegment) AS maximum FROM customer")
_add("approx_distinct", "events", lambda df: df.agg(F.approx_count_distinct("user_id").alias("n")), None)
_add("profile_histogram", "lineitem", lambda df: profile.histogram(df, "l_quantity").select("bin", F.round("low", 4).alias("low"), "n"), "WITH e AS (SELECT min(l_quantity) lo, (max(l_quantity)-min(l_quantity))/24 w FROM lineitem), b AS (SELECT CAST(least(floor((l_quantity-lo)/w), 23) AS INT) AS bin, count(*) n FROM lineitem, e WHERE l_quantity IS NOT NULL GROUP BY 1) SELECT CAST(s.i AS INT) AS bin, round(lo + s.i*w, 4) AS low, coalesce(n, 0) AS n FROM range(24) s(i) CROSS JOIN e LEFT JOIN b ON b.bin = s.i")
_add("profile_all", "orders", lambda df: profile.profile(df, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS count, count(*)-count({c}) AS empty, CAST(min({c}) AS VARCHAR) AS minimum, CAST(max({c}) AS VARCHAR) AS maximum FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))

_MONTH = {"column": "l_shipdate", "group": "month"}
_SUM = {"column": "l_extendedprice", "agg": "sum"}
_add(
    "pivot_month_by_flag", "lineitem", lambda df: _rounded(pivot.pivot(df, [_MONTH], ["l_returnflag"], [_SUM])),
    "WITH f AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) AS i FROM (SELECT DISTINCT l_returnflag FROM lineitem)) SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS r0, CAST(grouping(date_trunc('month', l_shipdate)) AS INT) AS _depth, round(sum(l_extendedprice) FILTER (WHERE i=1),2) AS v0, round(sum(l_extendedprice) FILTER (WHERE i=2),2) AS v1, round(sum(l_extendedprice) FILTER (WHERE i=3),2) AS v2, round(sum(l_extendedprice),2) AS v3 FROM lineitem JOIN f USING (l_returnflag) GROUP BY ROLLUP(date_trunc('month', l_shipdate))",
)
_add(
    "pivot_other_bucket", "lineitem", lambda df: _rounded(pivot.pivot(df, ["l_returnflag"], ["l_suppkey"], [_SUM], max_columns=3)),
    "WITH h AS (SELECT l_suppkey, row_number() OVER (ORDER BY CAST(l_suppkey AS VARCHAR)) AS i FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, CAST(l_suppkey AS VARCHAR) LIMIT 3)) SELECT l_returnflag AS r0, CAST(grouping(l_returnflag) AS INT) AS _depth, round(sum(l_extendedprice) FILTER (WHERE i=1),2) AS v0, round(sum(l_extendedprice) FILTER (WHERE i=2),2) AS v1, round(sum(l_extendedprice) FILTER (WHERE i=3),2) AS v2, round(sum(l_extendedprice) FILTER (WHERE i IS NULL),2) AS v3, round(sum(l_extendedprice),2) AS v4 FROM lineitem LEFT JOIN h USING (l_suppkey) GROUP BY ROLLUP(l_returnflag)",
)
_ALL = ("sum", "count", "count_all", "count_distinct", "avg", "min", "max", "median", "stddev")
_SQL = {"sum": "sum({})", "count": "count({})", "count_all": "count(*)", "count_distinct": "count(DISTINCT {})", "avg": "avg({})", "min": "min({})", "max": "max({})", "median": "median({})", "stddev": "stddev_samp({})"}
_add("pivot_all_aggs", "orders", lambda df: _rounded(pivot.pivot(df, ["o_orderpriority"], values=[{"column": "o_totalprice", "agg": a} if a != "count_all" else {"agg": a} for a in _ALL])), "SELECT o_orderpriority AS r0, CAST(grouping(o_orderpriority) AS INT) AS _depth, " + ", ".join(("{0} AS v{1}" if "count" in a else "round({0},2) AS v{1}").format(_SQL[a].format("o_totalprice"), i) for i, a in enumerate(_ALL)) + " FROM orders GROUP BY ROLLUP(o_orderpriority)")
_add("pivot_bands", "part", lambda df: _rounded(pivot.pivot(df, [{"column": "p_retailprice", "bin": 100}])), "SELECT CAST(floor(p_retailprice/100)*100 AS DOUBLE) AS r0, CAST(grouping(floor(p_retailprice/100)*100) AS INT) AS _depth, count(*) AS v0 FROM part GROUP BY ROLLUP(floor(p_retailprice/100)*100)")
_add("pivot_two_row_fields", "lineitem", lambda df: _rounded(pivot.pivot(df, ["l_returnflag", "l_linestatus"], values=[_SUM])), "SELECT l_returnflag AS r0, l_linestatus AS r1, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS INT) AS _depth, round(sum(l_extendedprice),2) AS v0 FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
_add("pivot_date_grains", "lineitem", lambda df: _rounded(pivot.pivot(df, [{"column": "l_shipdate", "group": "year"}, {"column": "l_shipdate", "group": "quarter"}], values=[_SUM])), "SELECT strftime(date_trunc('year', l_shipdate), '%Y-%m-%d') AS r0, strftime(date_trunc('quarter', l_shipdate), '%Y-%m-%d') AS r1, CAST(grouping(date_trunc('year', l_shipdate)) + grouping(date_trunc('quarter', l_shipdate)) AS INT) AS _depth, round(sum(l_extendedprice),2) AS v0 FROM lineitem GROUP BY ROLLUP(date_trunc('year', l_shipdate), date_trunc('quarter', l_shipdate))")
_PRIORITY = lambda df: pivot.pivot(df, ["o_orderpriority"], values=[{"column": "o_totalprice", "agg": "sum"}])
_BASE = "WITH p AS (SELECT o_orderpriority AS r0, CAST(grouping(o_orderpriority) AS INT) AS _depth, sum(o_totalprice) AS v FROM orders GROUP BY ROLLUP(o_orderpriority)) "
_add("pivot_pct_total", "orders", lambda df: pivot.show_as(_PRIORITY(df), "v0", "pct_total").withColumn("v0", F.round("v0", 6)), _BASE + "SELECT r0, _depth, round(v / (SELECT v FROM p WHERE _depth = 1), 6) AS v0 FROM p")
_add("pivot_running", "orders", lambda df: _rounded(pivot.show_as(_PRIORITY(df), "v0", "running")), _BASE + "SELECT r0, _depth, round(CASE WHEN _depth = 0 THEN sum(v) OVER (PARTITION BY _depth ORDER BY r0 NULLS LAST ROWS UNBOUNDED PRECEDING) ELSE v END, 2) AS v0 FROM p")
_add("pivot_rank", "orders", lambda df: pivot.show_as(_PRIORITY(df), "v0", "rank"), _BASE + "SELECT r0, _depth, CASE WHEN _depth = 0 THEN CAST(row_number() OVER (PARTITION BY _depth ORDER BY v DESC NULLS LAST, r0 NULLS LAST) AS INT) END AS v0 FROM p")
_add("pivot_pct_row", "orders", lambda df: pivot.show_as(pivot.pivot(df, ["o_orderpriority"], ["o_orderstatus"], [{"column": "o_totalprice", "agg": "sum"}]), "v0", "pct_row", total="v3").select("r0", "_depth", F.round("v0", 6).alias("v0")), "SELECT o_orderpriority AS r0, CAST(grouping(o_orderpriority) AS INT) AS _depth, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = (SELECT min(o_orderstatus) FROM orders)) / sum(o_totalprice), 6) AS v0 FROM orders GROUP BY ROLLUP(o_orderpriority)")
_add("pivot_report_filter", "orders", lambda df: _rounded(pivot.pivot(df, ["o_orderpriority"], values=[{"column": "o_totalprice", "agg": "sum"}], filters=[{"op": "in", "column": "o_orderstatus", "values": ["F"]}, {"op": "gt", "column": "o_totalprice", "value": 1000}])), "SELECT o_orderpriority AS r0, CAST(grouping(o_orderpriority) AS INT) AS _depth, round(sum(o_totalprice), 2) AS v0 FROM orders WHERE o_orderstatus IN ('F') AND o_totalprice > 1000 GROUP BY ROLLUP(o_orderpriority)")
_add("pivot_labels", "orders", lambda df: df.select(pivot.period_label(F.col("o_orderdate"), "quarter").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "SELECT coalesce('Q' || quarter(o_orderdate) || ' ' || year(o_orderdate), '(blank)') AS label, count(*) AS n FROM orders GROUP BY 1")
_add("drill_band", "part", lambda df: pivot.drill(df, [{"column": "p_retailprice", "bin": 100}], [900.0]).select("p_partkey", "p_retailprice"), "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 900 AND p_retailprice < 1000")
_add("drill_month", "orders", lambda df: pivot.drill(df, ["o_orderstatus"], ["F"], [{"op": "between", "column": "o_orderdate", "value": "1995-03-01", "value2": "1995-03-31"}]).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-03-31'")
_add("drill_other", "lineitem", lambda df: pivot.drill_other(df, ["l_suppkey"], 3).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")), "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, CAST(l_suppkey AS VARCHAR) LIMIT 3) GROUP BY 1")

for _name, _last in (("dedupe_first", False), ("dedupe_last", True)):
    _add(_name, "orders", lambda df, last=_last: clean.remove_duplicates(df, ["o_custkey"], last, ["o_orderkey"]).select("o_custkey", "o_orderkey"), f"SELECT o_custkey, {'max' if _last else 'min'}(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
_add("find_replace_ci", "part", lambda df: clean.find_replace(df.select("p_partkey", "p_type"), "steel", "IRON", ["p_type"]), "SELECT p_partkey, regexp_replace(p_type, 'steel', 'IRON', 'gi') AS p_type FROM part")
_add("find_replace_regex", "part", lambda df: clean.find_replace(df.select("p_partkey", "p_brand"), r"([A-Za-z]+)#(\d)", r"\2-\1", ["p_brand"], match_case=True, regex=True), r"SELECT p_partkey, regexp_replace(p_brand, '([A-Za-z]+)#(\d)', '\2-\1', 'g') AS p_brand FROM part")
_add("find_replace_whole_cell", "customer", lambda df: clean.find_replace(df.select("c_custkey", "c_mktsegment"), "building", "B", ["c_mktsegment"], whole_cell=True), "SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN 'B' ELSE c_mktsegment END AS c_mktsegment FROM customer")
_add("clean_text", "part", lambda df: clean.clean_text(df.select("p_partkey", "p_name"), ["p_name"], case="upper"), r"SELECT p_partkey, upper(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS p_name FROM part")
_add("split_column", "part", lambda df: clean.split_column(df.select("p_partkey", "p_type"), "p_type", " ", 3), "SELECT p_partkey, p_type, string_split(p_type, ' ')[1] AS p_type_1, string_split(p_type, ' ')[2] AS p_type_2, string_split(p_type, ' ')[3] AS p_type_3 FROM part")
_add("convert_number", "orders", lambda df: clean.change_type(df.select("o_orderkey", F.concat(F.lit("$"), F.format_number(F.col("o_orderkey"), 0)).alias("x")), "x", "number"), "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS x FROM orders")
_add("convert_date", "orders", lambda df: clean.change_type(df.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("x")), "x", "date", day_first=True), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS x FROM orders")
_add("convert_boolean", "orders", lambda df: clean.change_type(df.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "yes").otherwise("maybe").alias("x")), "x", "boolean"), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN true END AS x FROM orders")
_add("preview_convert", "orders", lambda df: preview(df, "o_orderstatus", "number"), "SELECT count(*) AS rows, count(o_orderstatus) AS filled, CAST(0 AS BIGINT) AS converted, count(o_orderstatus) AS failed, count(*) - count(o_orderstatus) AS blank, CAST(0 AS BIGINT) AS ambiguous FROM orders")
_add("rename", "nation", lambda df: clean.rename(df, "n_name", "Name"), 'SELECT n_nationkey, n_name AS "Name", n_regionkey FROM nation')
_add("remove_columns", "customer", lambda df: clean.remove_columns(df, ["c_name", "c_acctbal"]), "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
_add("fill_blanks", "customer", lambda df: clean.fill_blanks(df.select("c_custkey", F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).alias("x")), "x", 0), "SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN c_nationkey ELSE 0 END AS x FROM customer")
_add("delete_filtered", "customer", lambda df: clean.delete(df, [{"op": "gt", "column": "c_acctbal", "value": 100}]), "SELECT * FROM customer WHERE c_acctbal <= 100 OR c_acctbal IS NULL")
_add("recipe_replay", "customer", lambda df: clean.apply_recipe(df, [{"op": "keep", "params": {"filters": [{"op": "gte", "column": "c_acctbal", "value": 0}]}}, {"op": "find_replace", "params": {"find": "BUILDING", "replace": "B", "columns": ["c_mktsegment"]}}, {"op": "remove_columns", "params": {"columns": ["c_name"]}}]), "SELECT c_custkey, c_nationkey, c_acctbal, regexp_replace(c_mktsegment, 'BUILDING', 'B', 'gi') AS c_mktsegment FROM customer WHERE c_acctbal >= 0")
_add("lossless_types", "orders", lambda df: lossless(df.select(F.col("o_orderkey").cast("string").alias("k"), F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))), "SELECT o_orderkey AS k, lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS code, CAST(o_orderdate AS DATE) AS day FROM orders")
_add("export_parts", "orders", lambda df: sinks.split_parts(df, ["o_orderkey"], 1000).groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high")).withColumnRenamed("_part", "part"), "SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS INT) AS part, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY ALL".replace("SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS INT) AS part, count(*)", "SELECT part, count(*)").replace("FROM orders", "FROM (SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS INT) AS part FROM orders)"))
_add("precision_guard", "orders", lambda df: sinks.precise(df.select("o_orderkey", (F.col("o_orderkey").cast("decimal(20,0)") * F.lit(Decimal(10**13))).alias("big")))[0], "SELECT o_orderkey, CAST(o_orderkey * 10000000000000 AS VARCHAR) AS big FROM orders")
_add("cell_rules", "documents", lambda df: sinks.cell_rules(df.select("doc_id", "text")), "SELECT doc_id, CASE WHEN length(replace(text, chr(13)||chr(10), chr(10))) > 32767 THEN left(replace(text, chr(13)||chr(10), chr(10)), 32766) || '…' ELSE replace(text, chr(13)||chr(10), chr(10)) END AS text FROM documents")
_add("adhoc_sql", "lineitem", lambda df: adhoc.query(df, "SELECT l_returnflag, count(*) AS n FROM data GROUP BY l_returnflag"), "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")


#: Tables as files hold them: what has no order by a column follows file order.
_IN_ORDER = "(SELECT *, row_number() OVER () AS place FROM {})"
_add("page_file_order", "lineitem", lambda df: paging.page(paging.keyed(df), 1000, 100), "SELECT * FROM lineitem LIMIT 100 OFFSET 1000")
_add("page_deep", "lineitem", lambda df: paging.page(df, 40_000, 200, [{"column": "l_extendedprice", "direction": "desc"}], tiebreak=["l_orderkey", "l_linenumber"]), "SELECT * FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 200 OFFSET 40000")
_LINES = ["l_orderkey", "l_linenumber"]


def _two_pages(df: DataFrame) -> DataFrame:
    """Two deep pages of one order: the second is read from what the first has sorted."""
    pages, sort = paging.Pages(df), [{"column": "l_extendedprice", "direction": "desc"}]
    return pages.page(40_000, 100, sort, tiebreak=_LINES).unionByName(pages.page(12_000, 100, sort, tiebreak=_LINES))


_add("page_index", "lineitem", _two_pages, "(SELECT * FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100 OFFSET 40000) UNION ALL (SELECT * FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100 OFFSET 12000)")
_add("page_by_rows", "lineitem", lambda df: paging.Pages(paging.keyed(df)).page(30_000, 200), "SELECT * FROM lineitem LIMIT 200 OFFSET 30000")
_add("page_counts", "orders", lambda df: paging.counts(df, [{"op": "gt", "column": "o_totalprice", "value": 250000}]), "SELECT count(*) AS total_rows, count(*) FILTER (WHERE o_totalprice > 250000) AS filtered_rows FROM orders")
_add("checklist_first", "customer", lambda df: paging.checklist(df, "c_nationkey", 5)[0], "SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
_add("dedupe_file_order", "orders", lambda df: paging.shown(clean.remove_duplicates(paging.keyed(df), ["o_custkey", "o_orderstatus"])), "SELECT * EXCLUDE (place) FROM " + _IN_ORDER.format("orders") + " QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY place) = 1")
_add("pivot_first", "orders", lambda df: pivot.pivot(paging.keyed(df), ["o_orderpriority"], ["o_orderstatus"], [{"column": "o_totalprice", "agg": "first"}]), "WITH s AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS i FROM (SELECT DISTINCT o_orderstatus FROM orders)) SELECT o_orderpriority AS r0, CAST(grouping(o_orderpriority) AS INT) AS _depth, " + ", ".join(f"arg_min(o_totalprice, place) FILTER (WHERE i = {i + 1}) AS v{i}" for i in range(3)) + ", arg_min(o_totalprice, place) AS v3 FROM " + _IN_ORDER.format("orders") + " JOIN s USING (o_orderstatus) GROUP BY ROLLUP(o_orderpriority)")
_add("pivot_median_by_column", "orders", lambda df: pivot.pivot(df, ["o_orderpriority"], ["o_orderstatus"], [{"column": "o_totalprice", "agg": "median"}, {"column": "o_custkey", "agg": "count_distinct"}]).withColumns({f"v{i}": F.round(f"v{i}", 4) for i in (0, 2, 4, 6)}), "WITH s AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS i FROM (SELECT DISTINCT o_orderstatus FROM orders)) SELECT o_orderpriority AS r0, CAST(grouping(o_orderpriority) AS INT) AS _depth, " + ", ".join(f"round(median(o_totalprice) FILTER (WHERE i = {i + 1}), 4) AS v{2 * i}, count(DISTINCT o_custkey) FILTER (WHERE i = {i + 1}) AS v{2 * i + 1}" for i in range(3)) + ", round(median(o_totalprice), 4) AS v6, count(DISTINCT o_custkey) AS v7 FROM orders JOIN s USING (o_orderstatus) GROUP BY ROLLUP(o_orderpriority)")
_add("pivot_many_columns", "lineitem", lambda df: _rounded(pivot.pivot(df, ["l_returnflag"], ["l_linenumber", "l_linestatus"], [_SUM, {"column": "l_quantity", "agg": "avg"}, {"agg": "count_all"}])).select("r0", "_depth", *[f"v{i}" for i in range(42, 45)]), "SELECT l_returnflag AS r0, CAST(grouping(l_returnflag) AS INT) AS _depth, round(sum(l_extendedprice), 2) AS v42, round(avg(l_quantity), 2) AS v43, count(*) AS v44 FROM lineitem GROUP BY ROLLUP(l_returnflag)")
_add("pivot_fine_grains", "events", lambda df: pivot.pivot(df, [{"column": "ts", "group": g} for g in ("week", "day", "hour")]).select(*[F.date_format(f"r{i}", "yyyy-MM-dd HH:mm").alias(f"r{i}") for i in range(3)], "_depth", "v0"), "SELECT " + ", ".join(f"strftime(date_trunc('{g}', ts), '%Y-%m-%d %H:%M') AS r{i}" for i, g in enumerate(("week", "day", "hour"))) + ", CAST(" + " + ".join(f"grouping(date_trunc('{g}', ts))" for g in ("week", "day", "hour")) + " AS INT) AS _depth, count(*) AS v0 FROM events GROUP BY ROLLUP(" + ", ".join(f"date_trunc('{g}', ts)" for g in ("week", "day", "hour")) + ")")
_add("pivot_wide_sum", "orders", lambda df: pivot.pivot(df.select("o_orderpriority", (F.col("o_orderkey") + 9_000_000_000_000_000_000).alias("big")), ["o_orderpriority"], values=[{"column": "big", "agg": "sum"}]).withColumn("v0", F.col("v0").cast("string")), "SELECT o_orderpriority AS r0, CAST(grouping(o_orderpriority) AS INT) AS _depth, CAST(sum(CAST(o_orderkey AS HUGEINT) + 9000000000000000000) AS VARCHAR) AS v0 FROM orders GROUP BY ROLLUP(o_orderpriority)")
_add("pivot_non_finite", "orders", lambda df: _rounded(pivot.pivot(df.withColumn("x", F.when(F.col("o_orderstatus") == "F", float("inf")).when(F.col("o_orderstatus") == "P", float("nan")).otherwise(F.col("o_totalprice"))), ["o_orderstatus"], values=[{"column": "x", "agg": "sum"}, {"column": "x", "agg": "max"}])), "SELECT o_orderstatus AS r0, CAST(grouping(o_orderstatus) AS INT) AS _depth, CASE WHEN o_orderstatus = 'O' THEN round(sum(o_totalprice), 2) END AS v0, CASE WHEN o_orderstatus = 'O' THEN round(max(o_totalprice), 2) END AS v1 FROM orders GROUP BY ROLLUP(o_orderstatus)")
_add("pivot_first_rows", "lineitem", lambda df: _rounded(pivot.first_rows(pivot.pivot(df, ["l_suppkey"], values=[_SUM]), 10, "v0")[0]), "WITH p AS (SELECT l_suppkey AS r0, CAST(grouping(l_suppkey) AS INT) AS _depth, round(sum(l_extendedprice), 2) AS v0 FROM lineitem GROUP BY ROLLUP(l_suppkey)) (SELECT * FROM p WHERE _depth = 0 ORDER BY v0 DESC, r0 LIMIT 10) UNION ALL SELECT * FROM p WHERE _depth = 1")
_QUARTERS = [{"column": "o_orderdate", "group": "quarter"}, "o_orderstatus"]
_add("pivot_tabular", "orders", lambda df: _rounded(pivot.tabular(df, pivot.pivot(df, _QUARTERS, values=[{"column": "o_totalprice", "agg": "sum"}]), _QUARTERS)), "WITH p AS (SELECT date_trunc('quarter', o_orderdate) AS a, o_orderstatus AS b, CAST(2 - grouping(date_trunc('quarter', o_orderdate)) - grouping(o_orderstatus) AS INT) AS _level, round(sum(o_totalprice), 2) AS v0 FROM orders GROUP BY ROLLUP(date_trunc('quarter', o_orderdate), o_orderstatus)) SELECT CASE _level WHEN 0 THEN 'Grand Total' WHEN 1 THEN coalesce('Q' || quarter(a) || ' ' || year(a), '(blank)') ELSE '' END AS \"o_orderdate (quarter)\", CASE _level WHEN 2 THEN coalesce(b, '(blank)') ELSE '' END AS o_orderstatus, _level, v0 FROM p")
_BANDS = [{"column": "p_retailprice", "bin": 12.5}]
_add("pivot_band_labels", "part", lambda df: pivot.tabular(df, pivot.pivot(df, _BANDS), _BANDS), "WITH p AS (SELECT CAST(floor(p_retailprice / 12.5) * 12.5 AS DOUBLE) AS a, CAST(1 - grouping(floor(p_retailprice / 12.5) * 12.5) AS INT) AS _level, count(*) AS v0 FROM part GROUP BY ROLLUP(floor(p_retailprice / 12.5) * 12.5)) SELECT CASE _level WHEN 0 THEN 'Grand Total' ELSE regexp_replace(CAST(a AS VARCHAR), '\\.0$', '') || ' – ' || regexp_replace(CAST(a + 12.5 AS VARCHAR), '\\.0$', '') END AS \"p_retailprice (bands of 12.5)\", _level, v0 FROM p")
_add("pivot_pct_column", "orders", lambda df: pivot.show_as(pivot.pivot(df, ["o_orderpriority"], ["o_orderstatus"], [{"column": "o_totalprice", "agg": "sum"}]), "v1", "pct_column").select("r0", "_depth", F.round("v1", 6).alias("v1")), "WITH s AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS i FROM (SELECT DISTINCT o_orderstatus FROM orders)), p AS (SELECT o_orderpriority AS r0, CAST(grouping(o_orderpriority) AS INT) AS _depth, sum(o_totalprice) FILTER (WHERE i = 2) AS v FROM orders JOIN s USING (o_orderstatus) GROUP BY ROLLUP(o_orderpriority)) SELECT r0, _depth, round(v / (SELECT v FROM p WHERE _depth = 1), 6) AS v1 FROM p")
_add("pivot_running_fine", "lineitem", lambda df: _rounded(pivot.show_as(pivot.pivot(df, ["l_suppkey", {"column": "l_shipdate", "group": "month"}], values=[{"column": "l_quantity", "agg": "sum"}]), "v0", "running")), "WITH p AS (SELECT l_suppkey AS r0, date_trunc('month', l_shipdate) AS r1, CAST(grouping(l_suppkey) + grouping(date_trunc('month', l_shipdate)) AS INT) AS _depth, sum(l_quantity) AS v FROM lineitem GROUP BY ROLLUP(l_suppkey, date_trunc('month', l_shipdate))) SELECT r0, strftime(r1, '%Y-%m-%d') AS r1, _depth, round(CASE WHEN _depth = 0 THEN sum(v) OVER (PARTITION BY _depth ORDER BY r0 NULLS LAST, r1 NULLS LAST ROWS UNBOUNDED PRECEDING) ELSE v END, 2) AS v0 FROM p")
_add("drill_period", "orders", lambda df: pivot.drill(df, [{"column": "o_orderdate", "group": "quarter"}], ["1995-04-01"]).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE date_trunc('quarter', o_orderdate) = DATE '1995-04-01'")
_add("profile_histograms", "lineitem", lambda df: profile.histograms(df, ["l_quantity", "l_discount"]).select("column", "bin", F.round("low", 4).alias("low"), "n"), " UNION ALL ".join(f"(WITH e AS (SELECT min({c}) lo, (max({c})-min({c}))/24 w FROM lineitem), b AS (SELECT CAST(least(floor(({c}-lo)/w), 23) AS INT) AS bin, count(*) n FROM lineitem, e WHERE {c} IS NOT NULL GROUP BY 1) SELECT '{c}' AS \"column\", CAST(s.i AS INT) AS bin, round(lo + s.i*w, 4) AS low, coalesce(n, 0) AS n FROM range(24) s(i) CROSS JOIN e LEFT JOIN b ON b.bin = s.i)" for c in ("l_quantity", "l_discount")))
_FREQUENT = ["l_suppkey", "l_orderkey", "l_returnflag", "l_shipdate"]
_add("profile_frequent", "lineitem", lambda df: profile.frequent(df.withColumn("l_shipdate", F.col("l_shipdate").cast("date")), _FREQUENT), " UNION ALL ".join(f"(SELECT '{c}' AS \"column\", CAST({e} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, value LIMIT 12)" for c, e in zip(_FREQUENT, ["l_suppkey", "l_orderkey", "l_returnflag", "CAST(l_shipdate AS DATE)"], strict=True)))
_add("approx_distinct_error", "events", lambda df: df.agg(F.count_distinct("user_id").alias("n"), (F.abs(F.approx_count_distinct("user_id") - F.count_distinct("user_id")) <= 0.15 * F.count_distinct("user_id")).alias("within")), "SELECT count(DISTINCT user_id) AS n, true AS within FROM events")
_add("pivot_distinct_levels", "lineitem", lambda df: pivot.pivot(df, ["l_returnflag", "l_linestatus"], values=[{"column": "l_suppkey", "agg": "count_distinct"}, {"column": "l_suppkey", "agg": "median"}, {"column": "l_quantity", "agg": "stddev"}]).withColumn("v2", F.round("v2", 6)), "SELECT l_returnflag AS r0, l_linestatus AS r1, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS INT) AS _depth, count(DISTINCT l_suppkey) AS v0, median(l_suppkey) AS v1, round(stddev_samp(l_quantity), 6) AS v2 FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
_add("pivot_flat_totals", "orders", lambda df: _rounded(pivot.with_totals(df, pivot.pivot(df, ["o_orderstatus", "o_orderpriority"], values=[{"column": "o_totalprice", "agg": "sum"}]), ["o_orderstatus", "o_orderpriority"])), "SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'Grand total' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderstatus) = 1 THEN '' WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority, round(sum(o_totalprice), 2) AS v0 FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)")
_add("convert_failures", "orders", lambda df: failures(df.select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("x")), "x", "number"), "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
_add("convert_samples", "orders", lambda df: samples(df.select(F.date_format("o_orderdate", "MMM d yyyy").alias("x")), "x", "date"), "SELECT DISTINCT strftime(o_orderdate, '%b %-d %Y') AS before, strftime(o_orderdate, '%Y-%m-%d') AS after FROM orders ORDER BY before LIMIT 5")
_add("convert_ambiguous", "orders", lambda df: preview(df.select(F.date_format("o_orderdate", "MM/dd/yyyy").alias("x")), "x", "date").select("rows", "converted", "ambiguous"), "SELECT count(*) AS rows, count(o_orderdate) AS converted, count(*) FILTER (WHERE day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)) AS ambiguous FROM orders")
_add("convert_marked_numbers", "orders", lambda df: clean.change_type(df.select("o_orderkey", F.concat(F.lit("("), F.translate(F.format_number("o_totalprice", 2), ",.", ".,"), F.lit(") EUR")).alias("x")), "x", "number"), "SELECT o_orderkey, -o_totalprice AS x FROM orders")
_add("clean_proper", "part", lambda df: clean.clean_text(df.select("p_partkey", F.concat(F.lit("\t "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" \r\n")).alias("p_name")), ["p_name"], case="proper"), "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS p_name FROM part")
_add("cut_cells", "documents", lambda df: sinks.cut_cells(df.select("text")), "SELECT count(*) FILTER (WHERE length(replace(text, chr(13)||chr(10), chr(10))) > 32767) AS text FROM documents")
_add("adhoc_subquery", "orders", lambda df: adhoc.query(df, "WITH big AS (SELECT * FROM data WHERE o_totalprice > (SELECT avg(o_totalprice) FROM data)) SELECT o_orderpriority, count(*) AS n FROM big GROUP BY 1 HAVING count(*) > 1"), "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY 1 HAVING count(*) > 1")


def _file(read, sql: str, lines, **options) -> tuple:
    """A query that writes lines of customers as a text file of one kind, and the sheet read back from it."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = fresh_path(spark, "text")
        made = lines(spark.read.parquet(f"{d}/customer.parquet"))
        made.write.options(**options).text(path)
        return read(spark, path)

    return run, sql


def _line(sep: str, *parts, first: str | None = None):
    """Lines in order of the key, below a header line."""

    def make(df: DataFrame) -> DataFrame:
        body = df.select("c_custkey", F.concat_ws(sep, *[p(df) for p in parts]).alias("value"))
        head = df.sparkSession.createDataFrame([(-1, first)] if first else [], "c_custkey long, value string")
        return head.unionByName(body).repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").select("value")

    return make


_key, _name, _money = lambda df: F.col("c_custkey").cast("string"), lambda df: F.col("c_name"), lambda df: F.format_string("%.2f", F.col("c_acctbal"))
_comma = lambda df: F.replace(_money(df), F.lit("."), F.lit(","))
_SOURCES = {
    # Quoted fields with delimiters and quotes in them.
    "source_csv": _file(lambda s, p: text.read_text(s, p, header=False).toDF("k", "quoted", "v"), "SELECT c_custkey AS k, c_name || ', \"' || c_mktsegment || '\"' AS quoted, round(c_acctbal, 2) AS v FROM customer", _line(",", _key, lambda df: F.concat(F.lit('"'), F.col("c_name"), F.lit(', ""'), F.col("c_mktsegment"), F.lit('"""')), _money)),
    "source_tsv_gz": _file(lambda s, p: text.read_text(s, p, header=False).toDF("k", "name"), "SELECT c_custkey AS k, c_name AS name FROM customer", _line("\t", _key, _name), compression="gzip"),
    "source_bz2_all_text": _file(lambda s, p: text.read_text(s, p, header=False, all_text=True).toDF("k", "name"), "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name FROM customer", _line("|", _key, _name), compression="bzip2"),
    "source_ragged": _file(lambda s, p: text.read_text(s, p, header=False).toDF("k", "name", "extra"), "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment END AS extra FROM customer", _line(";", _key, _name, lambda df: F.when(F.col("c_custkey") % 7 == 0, F.col("c_mktsegment")))),
    "source_leading_zeros": _file(lambda s, p: text.read_text(s, p, header=False).toDF("k", "code", "day"), "SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS code, DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT) AS day FROM customer", _line(",", _key, lambda df: F.lpad(F.col("c_custkey").cast("string"), 12, "0"), lambda df: F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")).cast("string"))),
    "source_given_layout": _file(lambda s, p: lossless(text.read_text(s, p, header=False, all_text=True), layout="dd/MM/yyyy").toDF("k", "day"), "SELECT c_custkey AS k, DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT) AS day FROM customer", _line(",", _key, lambda df: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")), "dd/MM/yyyy"))),
    "source_decimal_comma": _file(lambda s, p: clean.change_type(text.read_text(s, p, ";", header=False).toDF("k", "v"), "v", "number"), "SELECT c_custkey AS k, round(c_acctbal, 2) AS v FROM customer", _line(";", _key, _comma)),
    # Quoted fields that go on over line ends.
    "source_multiline": _file(lambda s, p: text.read_text(s, p, header=False).toDF("k", "quoted", "v"), "SELECT c_custkey AS k, c_name || chr(10) || '\"' || c_mktsegment || '\",' || chr(10) AS quoted, round(c_acctbal, 2) AS v FROM customer", _line(",", _key, lambda df: F.concat(F.lit('"'), F.col("c_name"), F.lit('\n""'), F.col("c_mktsegment"), F.lit('"",\n"')), _money)),
    "source_line_numbers": _file(lambda s, p: text.numbered_lines(s, p).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("low"), F.max("line").alias("high"), F.count_distinct("line").alias("different")).agg(F.sum("n").alias("n"), F.max("low").alias("low"), (F.sum("high") == F.sum("different")).alias("dense")), "SELECT count(*) AS n, CAST(1 AS BIGINT) AS low, true AS dense FROM customer", _line(",", _key, _name)),
}
for _k, (_run, _sql) in _SOURCES.items():
    QUERIES[_k], ORACLES[_k] = _run, _sql


def _jsonl(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "text") + ".jsonl"
    sinks.write(spark.read.parquet(f"{d}/nation.parquet").select("n_name", "n_nationkey"), path, "jsonl")
    return text.read_any(spark, path)


QUERIES["source_jsonl"], ORACLES["source_jsonl"] = _jsonl, "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation"


def _header(spark: SparkSession, d: str) -> DataFrame:
    """One file with a header line of clashing names."""
    path, df = fresh_path(spark, "text"), spark.read.parquet(f"{d}/nation.parquet")
    _line(",", lambda x: F.col("n_nationkey").cast("string"), lambda x: F.col("n_name"), lambda x: F.col("n_regionkey").cast("string"), first="Key,name,KEY")(df.withColumnRenamed("n_nationkey", "c_custkey").withColumn("n_nationkey", F.col("c_custkey"))).coalesce(1).write.text(path)
    return text.read_text(spark, path)


QUERIES["source_header"], ORACLES["source_header"] = _header, "SELECT CAST(n_nationkey AS BIGINT) AS \"Key\", n_name AS name, CAST(n_regionkey AS BIGINT) AS \"KEY_2\" FROM nation"


def _rejects(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth line written in Latin-1: its accent is no UTF-8."""
    path, df = fresh_path(spark, "text"), spark.read.parquet(f"{d}/customer.parquet")
    lines = _line(",", _key, lambda df: F.when(F.col("c_custkey") % 9 == 4, F.encode(F.lit("Genève"), "ISO-8859-1").cast("string")).otherwise(F.lit("Genève")))(df)
    lines.coalesce(1).write.text(path)
    return text.rejected(spark, path).select("rejected", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


QUERIES["source_rejects"], ORACLES["source_rejects"] = _rejects, "SELECT count(*) AS rejected, array_to_string(list_slice(list(c_custkey + 1 ORDER BY c_custkey), 1, 5), ',') AS lines FROM customer WHERE c_custkey % 9 = 4"


def _folder(spark: SparkSession, d: str) -> DataFrame:
    """Customers in three files: UTF-8 with commas, windows-1252 with semicolons and other columns first, UTF-8 with tabs and a column more."""
    at, df = fresh_path(spark, "folder"), spark.read.parquet(f"{d}/customer.parquet")
    key, name = F.col("c_custkey").cast("string"), F.concat(F.lit("Café "), F.col("c_name"))
    kinds = [("key,name", F.concat_ws(",", key, name)), ("NAME;key", F.encode(F.concat_ws(";", name, key), "ISO-8859-1").cast("string")), ("key\tname\tsegment", F.concat_ws("\t", key, name, "c_mktsegment"))]
    for i, (head, line) in enumerate(kinds):
        body = df.where(F.col("c_custkey") % 3 == i).select(F.lit(1).alias("n"), line.alias("value"))
        first = spark.createDataFrame([(0, head)], "n int, value string")
        first.unionByName(body).coalesce(1).sortWithinPartitions("n").select("value").write.mode("append").text(at)
    return folder.read_folder(spark, at)


QUERIES["source_folder"], ORACLES["source_folder"] = _folder, "SELECT c_custkey AS key, 'Café ' || c_name AS name, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment END AS segment FROM customer"


def _roundtrip(form: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        path, df = fresh_path(spark, "export"), spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
        sinks.write(df, path, form)
        if form == "parquet":
            return spark.read.parquet(path)
        if form == "jsonl":
            return spark.read.schema(df.schema).json(path)
        return lossless(spark.read.option("header", "true").option("sep", "\t" if form == "tsv" else ",").option("escape", '"').csv(path))

    return run


for _form in ("csv", "tsv", "parquet", "jsonl"):
    QUERIES[f"flat_roundtrip_{_form}"] = _roundtrip(_form)
    ORACLES[f"flat_roundtrip_{_form}"] = "SELECT c_custkey, c_name, c_acctbal FROM customer"


def _workbooks(spark: SparkSession, d: str) -> DataFrame:
    path, df = fresh_path(spark, "export"), spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    sinks.write_workbooks(df, ["o_orderkey"], path, "orders", 5_000)
    return workbook.read_workbooks(spark, path)


QUERIES["xlsx_roundtrip"] = _workbooks
ORACLES["xlsx_roundtrip"] = "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders"
