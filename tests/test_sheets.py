"""Pages of kept orders, cleaning with undo, scoped names in queries, medians by ranges, writes that count."""

import datetime
import statistics
import uuid

import pytest
from pyspark.sql import functions as F

from sparksheet import adhoc, sinks
from sparksheet.functions.columns import SheetError, unique_names
from sparksheet.operators import clean, paging, pivot

SF = "/root/testdata/sf0.01"


def jobs(spark, run):
    """The result of run, and how many stages it started."""
    sc = spark.sparkContext
    group = uuid.uuid4().hex
    sc.setJobGroup(group, group)
    out = run()
    stages = [s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(stages)


def test_second_deep_page_sorts_nothing(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    pages, sort = paging.Pages(df), [{"column": "l_extendedprice", "direction": "desc"}]
    tie = ["l_orderkey", "l_linenumber"]
    want = df.orderBy(F.desc_nulls_last("l_extendedprice"), *tie).collect()
    for offset in (30_000, 12_345):
        got, stages = jobs(spark, lambda o=offset: pages.page(o, 100, sort, tiebreak=tie).collect())
        assert got == want[offset : offset + 100]
    copy = next(iter(pages.copies.values()))
    plan = pages.page(20_000, 50, sort, tiebreak=tie)._jdf.queryExecution().toString()
    assert stages <= 2 and "rangepartitioning(l_extendedprice" not in plan and len(pages.copies) == 1
    for i in range(5):
        pages.page(11_000, 10, [{"column": "l_partkey"}], [{"op": "gt", "column": "l_quantity", "value": i}], tie).collect()
    assert len(pages.copies) == 4 and copy not in pages.copies.values()
    pages.close()
    with pytest.raises(SheetError):
        pages.page(-1)


def test_pages_in_file_order(spark, tmp_path):
    spark.range(50_000).withColumn("x", F.xxhash64("id")).repartitionByRange(4, "id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    pages = paging.Pages(paging.keyed(df))
    for offset, limit in ((0, 10), (12_490, 30), (49_990, 200), (60_000, 5)):
        got = [r["id"] for r in pages.page(offset, limit).collect()]
        assert got == list(range(offset, min(offset + limit, 50_000))) and pages.page(offset, limit).columns == ["id", "x"]
    some = [r["id"] for r in pages.page(20_000, 5, filters=[{"op": "gte", "column": "id", "value": 7}]).collect()]
    assert some == list(range(20_007, 20_012))


def test_undo_is_the_table_before(spark):
    df = spark.read.parquet(f"{SF}/customer.parquet")
    steps = [
        {"op": "keep", "params": {"filters": [{"op": "gte", "column": "c_acctbal", "value": 0}]}}, {"op": "find_replace", "params": {"find": "BUILDING", "replace": "B", "columns": ["c_mktsegment"]}}, {"op": "remove_duplicates", "params": {"columns": ["c_nationkey", "c_mktsegment"], "order": ["c_custkey"]}},
        {"op": "rename", "params": {"column": "c_name", "to": "Name"}}, {"op": "remove_columns", "params": {"columns": ["c_acctbal"]}}, {"op": "delete", "params": {"filters": [{"op": "eq", "column": "c_nationkey", "value": 3}]}},
    ]
    shown = lambda x: (x.columns, sorted(map(tuple, x.collect())))
    history = clean.History(df, every=2)
    for i, s in enumerate(steps):
        history.apply(s["op"], **s["params"])
        assert shown(history.table) == shown(clean.apply_recipe(df, steps[: i + 1]))
    assert [v.rows for v in history.versions[1:]] == [clean.apply_recipe(df, steps[: i + 1]).count() for i in range(6)] and history.recipe() == steps
    for i in range(5, -1, -1):
        assert shown(history.undo()) == shown(clean.apply_recipe(df, steps[:i]))
    with pytest.raises(SheetError):
        history.undo()


def test_history_frees_what_no_version_reads(spark):
    import os

    df, there = spark.range(100).withColumn("t", F.lit("a")), lambda x: os.path.isdir(x._scratch)
    history = clean.History(df, most=3, every=2)
    for i in range(2):
        history.apply("find_replace", find="a", replace=f"a{i}")
    first = history.versions[-1].base
    for i in range(6):
        history.apply("find_replace", find="a", replace=f"b{i}a")
    assert not there(first) and len(history.versions) == 4 and len(history.recipe()) == 3
    last = history.versions[-1].base
    before = history.undo().first()["t"]
    assert before.count("b") == 5 and there(history.versions[-1].base)
    history.close()
    assert not there(last)


def test_names_have_scopes(spark):
    spark.range(2).createOrReplaceTempView("other")
    for sql in (
        "SELECT o.id FROM other o CROSS JOIN (WITH other AS (SELECT 1 AS z) SELECT * FROM other) x", "SELECT id FROM other WHERE EXISTS (WITH other AS (SELECT 1 AS z) SELECT * FROM other)",
        "WITH a AS (SELECT * FROM other), other AS (SELECT 1 AS z) SELECT * FROM a", "WITH other AS (SELECT * FROM other) SELECT * FROM other",
    ):
        with pytest.raises(SheetError):
            adhoc.query(spark.range(3), sql)
    got = adhoc.query(spark.range(3), "WITH a AS (SELECT id FROM data), b AS (SELECT id + 1 AS id FROM a WHERE EXISTS (WITH c AS (SELECT max(id) AS m FROM a) SELECT m FROM c WHERE m > 1)) SELECT sum(id) AS s FROM b")
    assert got.first()["s"] == 6
    spark.range(7).createOrReplaceTempView("data")
    assert adhoc.query(spark.range(3), "SELECT count(*) AS n FROM data").first()["n"] == 3 and spark.table("data").count() == 7
    spark.catalog.dropTempView("data")
    adhoc.query(spark.range(3), "SELECT 1 FROM data")
    assert not spark.catalog.tableExists("data")
    some, more = adhoc.answer(spark.range(30), "SELECT id FROM data", 10)
    assert some.count() == 10 and more.count() == 11


@pytest.mark.parametrize("few", [200_000, 5])
def test_pivot_measures_by_value(spark, monkeypatch, few):
    """Medians, distinct counts, deviations and firsts of every level, with blanks, no numbers and groups without values; by brute force."""
    import random

    monkeypatch.setattr(pivot, "FEW", few)
    r = random.Random(3)
    rows = [(r.choice(["x", "y", None]), r.choice(["p", None]), r.choice(["h", "i", None]), r.choice([None, 1e9 + r.gauss(0, 3), float(r.randrange(5))]) if i % 9 else None, r.randrange(40)) for i in range(700)]
    rows += [("only", "blank", "h", None, 1)]
    df = spark.createDataFrame(rows, "a string, b string, h string, v double, n int").repartition(5)
    values = [{"column": "v", "agg": "median"}, {"column": "v", "agg": "count_distinct"}, {"column": "v", "agg": "stddev"}, {"column": "n", "agg": "median"}, {"column": "n", "agg": "sum"}, {"agg": "count_all"}]
    got = {(x["r0"], x["r1"], x["_depth"]): [x[f"v{i}"] for i in range(24)] for x in pivot.pivot(df, ["a", "b"], ["h"], values).collect()}

    def measures(part):
        vs, ns = [x[3] for x in part if x[3] is not None], [x[4] for x in part]
        return [statistics.median(vs) if vs else None, len(set(vs)), statistics.stdev(vs) if len(vs) > 1 else None, statistics.median(ns) if ns else None, sum(ns) if ns else None, len(part)]

    keys = {(x[0], x[1], 0) for x in rows} | {(x[0], None, 1) for x in rows} | {(None, None, 2)}
    assert set(got) == keys
    for a, b, depth in keys:
        part = [x for x in rows if depth == 2 or x[0] == a and (depth == 1 or x[1] == b)]
        want = [m for h in ("h", "i", None) for m in measures([x for x in part if x[2] == h])] + measures(part)
        for x, y in zip(got[a, b, depth], want, strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9)), (a, b, depth)


def test_pivot_of_values_alone(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (4.0, None)], "v double, t string")
    got = pivot.pivot(df, [], values=[{"column": "v", "agg": "median"}, {"column": "t", "agg": "count_distinct"}, {"column": "v", "agg": "stddev"}]).collect()
    assert [tuple(r) for r in got] == [(0, 2.0, 1, pytest.approx(statistics.stdev([1, 2, 4])))]
    by_header = pivot.pivot(df, [], ["t"], [{"column": "v", "agg": "median"}]).collect()
    assert [tuple(r) for r in by_header] == [(0, 1.5, 4.0, 2.0)]


def test_flat_pivot_with_totals(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, "x"), ("a", 5, "x, y"), ("a", 2, None), (None, 4, "x")], "g string, n long, h string")
    made = pivot.pivot(df, ["g", "h"], values=[{"column": "n", "agg": "sum"}])
    pivot.to_csv(pivot.with_totals(df, made, ["g", "h"]), str(tmp_path / "p"))
    body = next((tmp_path / "p").glob("part-*")).read_bytes().decode()
    assert body == '﻿g,h,v0\r\na,"x, y",5\r\na,(blank),2\r\na,Total,7\r\nb,x,1\r\nb,Total,1\r\n(blank),x,4\r\n(blank),Total,4\r\nGrand total,,12\r\n'
    assert pivot.value_labels([("x", None)], True, [{"column": "n", "agg": "sum"}]) == ["x, (blank) — Sum of n", "Other — Sum of n", "Total — Sum of n"]


def test_writes_count_on_the_way(spark, tmp_path):
    df = spark.createDataFrame([("a" * 40_000, "b"), ("c", None), (None, "d" * 32_767)], "t string, u string")
    assert sinks.write(df, str(tmp_path / "w"), "jsonl") == {"rows": 3, "long_cells": {"t": 1}}
    assert sinks.write(spark.range(5), str(tmp_path / "n"), "csv") == {"rows": 5, "long_cells": {}}


def test_names_are_free():
    assert unique_names(["a", "A_2", "a", "a", ""]) == ["a", "A_2", "a_3", "a_4", "column5"]


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    """A task that dies midway: no file of it or of others is left; then the same write goes through."""
    from sparksheet.sources import workbook

    def boom(batches):
        for b in batches:
            if b["n"].max() >= 900:
                raise RuntimeError("lost")
            yield b

    df, folder = spark.range(1000).select(F.col("id").alias("n"), F.lit(datetime.date(2024, 1, 2)).alias("day")), tmp_path / "out"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    original = sinks.numbered
    try:
        sinks.numbered = lambda x, order: original(x, order).mapInPandas(boom, "n long, day date, _at long")
        with pytest.raises(Exception, match="lost"):
            sinks.write_workbooks(df, ["n"], str(folder), "t", 100)
    finally:
        sinks.numbered = original
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert list(folder.iterdir()) == []
    done = sinks.write_workbooks(df, ["n"], str(folder), "t", 300, style="padded").orderBy("part").collect()
    assert [(r["part"], r["rows"]) for r in done] == [(0, 300), (1, 300), (2, 300), (3, 100)] and all(r["bytes"] > 0 for r in done)
    assert sorted(x.name for x in folder.iterdir()) == ["t_1.xlsx", "t_2.xlsx", "t_3.xlsx", "t_4.xlsx"]
    assert [r["n"] for r in workbook.read_workbooks(spark, str(folder)).orderBy("n").collect()] == list(range(1000))


@pytest.mark.parametrize("tracked, candidates", [(10_000, 100), (64, 30)])
def test_frequent_values(spark, monkeypatch, tracked, candidates):
    """Skewed, flat, all-different and blank columns, with sketches that hold all values and ones that do not; by full counts."""
    import random
    from collections import Counter

    from sparksheet.operators import profile

    monkeypatch.setattr(profile, "TRACKED", tracked)
    monkeypatch.setattr(profile, "CANDIDATES", candidates)
    r = random.Random(2)
    rows = [(int(r.paretovariate(0.7)), r.randrange(60), i, None if i % 3 else "x", r.choice("ab")) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b int, c int, d string, e string").repartition(6)
    got = {}
    for x in profile.frequent(df, list("abcde"), 10).collect():
        got.setdefault(x["column"], set()).add((x["value"], x["n"]))
    for i, name in enumerate("abcde"):
        counts = Counter(None if row[i] is None else str(row[i]) for row in rows)
        assert got[name] == set(sorted(counts.items(), key=lambda x: (-x[1], x[0] is None, x[0] or ""))[:10]), name


def test_wide_keys_times_a_factor_are_exact(spark, tmp_path):
    """Products beyond 64 bits: the keys of larger tables times 10**13."""
    from sparksheet import queries

    keys = [0, 150_000, 922_338, 8_999_999, 54_000_000, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: r["big"] for r in queries.QUERIES["precision_guard"](spark, str(tmp_path)).collect()}
    assert got == {k: None if k is None else str(k * 10**13) for k in keys}
