"""Text sources, conversions and errors on small files."""

import random
import statistics

import pytest

from sparksheet import adhoc, sinks
from sparksheet.functions.columns import SheetError, unique_names
from sparksheet.functions.convert import converted, failures, lossless, samples
from sparksheet.operators import clean, pivot, predicates, profile
from sparksheet.sources import sheet, text


def test_typing_changes_no_value(spark, tmp_path):
    p = tmp_path / "stock.csv"
    p.write_text("part,weight,shelf,serial,ratio\nbolt,0.25,0031,9007199254740993001,12345678901234567\nnut,4,0107,-17,1.5\n")
    df = text.read_text(spark, str(p))
    assert dict(df.dtypes) == {"part": "string", "weight": "double", "shelf": "string", "serial": "bigint", "ratio": "string"}
    assert [r["serial"] for r in df.orderBy("part").collect()] == [9007199254740993001, -17]


def test_typing_by_a_given_layout(spark):
    df = spark.createDataFrame([("07/04/2021", "1"), (None, "2")], "d string, n string")
    assert [tuple(map(str, r)) for r in lossless(df, layout="MM/dd/yyyy").collect()] == [("2021-07-04", "1"), ("None", "2")]


def test_uneven_rows_lose_nothing(spark, tmp_path):
    p = tmp_path / "uneven.csv"
    p.write_text("city,people\nBonn,3\nGent,5,harbour\nPisa\n")
    rows = [tuple(r) for r in text.read_text(spark, str(p)).collect()]
    assert rows == [("Bonn", 3, None), ("Gent", 5, "harbour"), ("Pisa", None, None)]


def test_paths_are_literal(spark, tmp_path):
    for name, body in (("sales{q1}.csv", "k|v\n7|8\n"), ("salesq1.csv", "k|v\n0|0\n")):
        (tmp_path / name).write_text(body)
    assert [tuple(r) for r in text.read_text(spark, str(tmp_path / "sales{q1}.csv")).collect()] == [(7, 8)]


@pytest.mark.parametrize("body, want", [('x;y\n"1,5;2,5";3\n4,0;5\n', ";"), ("x\ty\n1,2\t3\n", "\t"), ("one\ntwo\n", ","), ('n,t\n1,"a;b;c"\n2,"d;e;f"\n', ",")])
def test_delimiters_outside_quotes_count(body, want):
    assert text.sniff_delimiter(body.splitlines()) == want


def test_rejects_have_their_line_numbers(spark, tmp_path):
    lines = [b"k,v"] + [b"%d,x" % i for i in range(400)]
    lines[7], lines[391] = b"6,\xff\xfe", b"390,\xc3("
    (tmp_path / "broken.csv").write_bytes(b"\n".join(lines) + b"\n")
    (tmp_path / "fine.csv").write_text("k,v\n1,\ufffd\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = text.rejected(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["rejected"], r["lines"]) for r in got] == [(2, [8, 392])]


def test_sniffing(spark, tmp_path):
    p = tmp_path / "menu.csv"
    p.write_bytes("dish;price\nCrème;4\n".encode("cp1252"))
    got = text.sniff(spark, str(p))
    assert (got["encoding"], got["delimiter"], got["header"], got["columns"], got["sample"]) == ("windows-1252", ";", True, ["dish", "price"], [("Crème", "4")])
    assert len(got["notes"]) == 1


def test_numbers(spark):
    values = {
        "7,25": 7.25, "3.141.592,65": 3141592.65, "(2.718,28)": -2718.28, "8,640": 8640.0, "USD 19.5": 19.5, "19,5 EUR": 19.5, "LOT-9": None, "USD-9": None, "9 864,5": 9864.5, "£6,000.75": 6000.75, "17": 17.0, "8f": None,
        "12-": -12.0, "-4.5": -4.5, "1.000.000": 1e6, "1,00,0": None, "1.2.3": None, "6.02e23": 6.02e23, ",5": 0.5, "25 %": 25.0, "1,234.": None, "": None, "NaN": None, "1,2,3": None, "88.123": 88.123, "₪\u202f5": 5.0,
    }
    df = spark.createDataFrame([(k,) for k in values], "v string")
    assert {r["v"]: r["n"] for r in df.select("v", converted(df, "v", "number").alias("n")).collect()} == values


def test_dates(spark):
    values = {"2 Nov 2023": "2023-11-02", "Nov 2 2023": "2023-11-02", "November 2 2023": "2023-11-02", "2-November-2023": "2023-11-02", "2-Nov-23": "2023-11-02", "2 Nov 71": "1971-11-02", "20231102": "2023-11-02", "20231102101112": "2023-11-02", "2023-11-02 10:11:12.5": "2023-11-02", "31 Feb 2023": None, "soon": None}
    df = spark.createDataFrame([(k,) for k in values], "v string")
    assert {r["v"]: r["d"] and str(r["d"]) for r in df.select("v", converted(df, "v", "date").alias("d")).collect()} == values


def test_what_a_conversion_loses(spark):
    df = spark.createDataFrame([(v,) for v in ("4", "n.v.", "n.v.", "tbd", "5", None, " ")], "v string")
    assert [tuple(r) for r in failures(df, "v", "number").collect()] == [("n.v.", 2), ("tbd", 1)]
    assert [tuple(r) for r in samples(df, "v", "number").collect()] == [("4", "4.0"), ("5", "5.0")]


def test_opening_says_what_it_did(spark, tmp_path):
    p = tmp_path / "visits.csv"
    p.write_text("day,n\n04/05/2022,1\n05/04/2022,2\n31/12/2022,3\n")
    got = sheet.open_sheet(spark, str(p))
    assert got.rows == 3 and dict(got.df.dtypes)["day"] == "string" and len(got.warnings) == 1 and "2 dates" in got.warnings[0]
    got = sheet.open_sheet(spark, str(p), layout="dd/MM/yyyy")
    assert dict(got.df.dtypes) == {"day": "date", "n": "bigint"} and not got.warnings and len(got.notes) == 1
    (tmp_path / "none.csv").write_text("a,b\n")
    assert sheet.open_sheet(spark, str(tmp_path / "none.csv"), encoding="klingon").warnings == ["no rows"]
    p.write_bytes(b"a,b\n1,\xff\n2,x\n" + "3,ü\n".encode() * 600)
    assert "line 2" in sheet.open_sheet(spark, str(p), encoding="UTF-8").warnings[0]


def test_exports_are_reported_and_spare_their_source(spark, tmp_path):
    df = spark.range(100).repartition(2)
    sinks.write(df, str(tmp_path / "out"), "csv")
    got = sinks.report(spark, str(tmp_path / "out"), 100, 10_000)
    assert len(got["files"]) == 2 and got["bytes"] == sum(n for _, n in got["files"]) and 0.9 < got["compression_ratio"] < 1
    with pytest.raises(SheetError):
        sinks.write(spark.read.csv(str(tmp_path / "out")), str(tmp_path / "out"), "csv", overwrite=True)


@pytest.mark.parametrize("sql", ["SHOW TABLES", "REFRESH TABLE data", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect('java.util.UUID', 'randomUUID') FROM data", "SELECT * FROM other", "INSERT INTO data VALUES (1)", "SELECT 1; SELECT 2", "SELECT (SELECT max(x) FROM parquet.`/tmp/x`) FROM data"])
def test_only_queries_run(spark, sql):
    with pytest.raises(SheetError):
        adhoc.query(spark.range(3), sql)


def test_queries_run(spark):
    got = adhoc.query(spark.range(5), "WITH a AS (SELECT id FROM data WHERE id IN (SELECT max(id) FROM data)) SELECT a.id, x.n FROM a CROSS JOIN (SELECT count(*) AS n FROM data) x UNION ALL SELECT 0, 0 ORDER BY 1")
    assert [tuple(r) for r in got.collect()] == [(0, 0), (4, 5)]


def test_patterns_are_those_that_run(spark):
    df = spark.createDataFrame([("foo",)], "t string")
    with pytest.raises(SheetError):
        clean.find_replace(df, "(?P<n>o)", "x", regex=True)
    assert clean.find_replace(df, "(?<n>o)+", "0", regex=True).first()[0] == "f0"


def test_pivots_sort_cut_and_print(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, "x"), ("a", 5, "x, y"), ("a", 2, None), (None, 4, "x")], "g string, n long, h string")
    made = pivot.pivot(df, ["g", "h"], values=[{"column": "n", "agg": "sum"}])
    top, more = pivot.first_rows(made, 2, "v0")
    assert more and [tuple(r) for r in top.select("r0", "r1", "v0").collect()] == [("a", "x, y", 5), (None, "x", 4), (None, None, 12)]
    by_key = [tuple(r)[:2] for r in pivot.sort_rows(made).collect()]
    assert by_key == [("a", "x, y"), ("a", None), ("a", None), ("b", "x"), ("b", None), (None, "x"), (None, None), (None, None)]
    pivot.to_csv(pivot.tabular(df, made, ["g", "h"]), str(tmp_path / "p"))
    body = next((tmp_path / "p").glob("part-*")).read_bytes()
    assert body.decode() == '\ufeffg,h,v0\r\na,,7\r\n,"x, y",5\r\n,(blank),2\r\nb,,1\r\n,x,1\r\n(blank),,4\r\n,x,4\r\nGrand Total,,12\r\n'
    with pytest.raises(SheetError):
        pivot.sort_rows(made, "nope")


@pytest.mark.parametrize("few", [20_000, 3])
def test_medians(spark, monkeypatch, few):
    monkeypatch.setattr(profile, "FEW", few)
    r = random.Random(5)
    for values in ([1.0], [1.0, 4.0], [7.0] * 50, [r.gauss(0, 1) for _ in range(999)], [float(r.randrange(4)) for _ in range(1000)], [1.0] * 500 + [2.0] * 500, [float("nan"), 1.0, float("inf"), 2.0, 3.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        want = statistics.median(float("inf") if v != v else v for v in values)
        assert profile.summary(df, "v").first()["median"] == pytest.approx(want, rel=1e-12)
    assert profile.summary(df.where("v is null"), "v").first()["median"] is None


def test_names():
    assert unique_names(["Key", "KEY", "x", "x", "x_2", " "]) == ["Key", "KEY_2", "x", "x_2", "x_2_2", "column6"]


def test_refusals(spark):
    df = spark.range(3)
    for bad in ({"op": "nope", "column": "id"}, {"op": "eq", "column": "id"}, {"op": "eq", "column": "x", "value": 1}, {"op": "in", "column": "id", "values": list(range(10_001))}):
        with pytest.raises(SheetError):
            predicates.keep(df, [bad])
    with pytest.raises(SheetError):
        adhoc.query(df, "DROP TABLE x")
    assert sinks.plan(2_500, 3, 1_000)["parts"] == 3 and sinks.part_name("a:b", 27, 30) == "a_b_ab"
