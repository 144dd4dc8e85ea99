"""Workbooks, zip members and encodings on small files."""

import datetime
import zipfile

import pytest

from sparksheet import sinks
from sparksheet.functions.columns import SheetError
from sparksheet.sources import text, workbook

MAIN = sinks._MAIN


def book(path, sheets, styles="", strings=None):
    """A workbook of the given sheets (name -> rows as XML)."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{sinks._RELATIONS}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{sinks._PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{x}</si>" for x in strings) + "</sst>")


def test_reads_offsets_blank_rows_dates_and_shared_texts(spark, tmp_path):
    rows = '<row r="2"><c r="B2"/></row><row r="4"><c r="C4" t="s"><v>0</v></c><c r="D4" t="inlineStr"><is><t>day</t></is></c><c r="E4" t="inlineStr"><is><t>ok</t></is></c></row><row r="5"><c r="C5" t="s"><v>1</v></c><c r="D5" s="1"><v>45366</v></c><c r="E5" t="b"><v>1</v></c></row><row r="6"/><row r="7"><c r="C7" t="s"><v>2</v></c></row>'
    book(tmp_path / "offset.xlsx", {"First": rows, "Second": ""}, '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf/><xf numFmtId="170"/></cellXfs>', ["<t>code</t>", "<t>007</t>", "<r><t>a</t></r><r><t>b</t></r>"])
    at = str(tmp_path / "offset.xlsx")
    df = workbook.read_workbooks(spark, at)
    assert dict(df.dtypes)["day"] == "date"
    assert [tuple(r)[-3:] for r in df.orderBy("code").collect()] == [("007", datetime.date(2024, 3, 15), "TRUE"), ("ab", None, None)]
    assert [r["sheet"] for r in workbook.sheet_names(spark, at).orderBy("at").collect()] == ["First", "Second"]
    for bad in ("Second", "Third"):
        with pytest.raises(SheetError):
            workbook.read_workbooks(spark, at, bad)


def test_workbooks_keep_values_in_exact_parts(spark, tmp_path):
    day, at = datetime.date(2024, 3, 15), datetime.datetime(2024, 3, 15, 10, 30, 5)
    rows = [(i, f"=1+{i}", i / 4, day, at, 1234567890123456789, i % 2 == 0) for i in range(10)] + [(10, "a<b & \x01c", float("nan"), None, None, None, None)]
    df = spark.createDataFrame(rows, "n int, note string, x double, day date, at timestamp, big long, flag boolean")
    done = sinks.write_workbooks(df, ["n"], str(tmp_path / "out"), "t", 4).orderBy("part").collect()
    assert [(r["part"], r["file"].rsplit("/", 1)[1], r["rows"]) for r in done] == [(0, "t_a.xlsx", 4), (1, "t_b.xlsx", 4), (2, "t_c.xlsx", 3)]
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["t_a.xlsx", "t_b.xlsx", "t_c.xlsx"]
    got = [tuple(r) for r in workbook.read_workbooks(spark, str(tmp_path / "out")).orderBy("n").collect()]
    flag = ["TRUE", "FALSE"]
    assert got == [(i, f"=1+{i}", i / 4, day, at, 1234567890123456789, flag[i % 2]) for i in range(10)] + [(10, "a<b & c", None, None, None, None, None)]
    with pytest.raises(SheetError):
        sinks.write_workbooks(df, ["n"], str(tmp_path / "out"), "t", 4)
    assert sinks.write_workbooks(df.where("n < 0"), ["n"], str(tmp_path / "none"), "t").collect()[0]["rows"] == 0


def test_encodings(spark, tmp_path):
    for name in ("utf-8", "utf-8-sig", "cp1252", "utf-16"):
        p = tmp_path / f"{name}.csv"
        p.write_bytes("id,näme,price\n1,café “x”,£5\n2,ü,€6\n".encode(name))
        df = text.read_text(spark, str(p))
        assert df.columns == ["id", "näme", "price"], name
        assert [tuple(r) for r in df.collect()] == [(1, "café “x”", "£5"), (2, "ü", "€6")], name


def test_zip_members(spark, tmp_path):
    p = str(tmp_path / "data.zip")
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("book.xlsx", b"")
        z.writestr("data.csv", "id,region,amount\r\n1,é,1.5\r\n2,W,2.5,extra\r\n".encode("cp1252"))
    assert [tuple(r) for r in text.read_any(spark, p).collect()] == [(1, "é", 1.5, None), (2, "W", 2.5, "extra")]


def test_other_sheets_are_named_and_files_share_the_work(spark, tmp_path):
    from sparksheet.sources import sheet

    cells = lambda *xs: "<row>" + "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' for x in xs) + "</row>"
    for k in range(5):
        book(tmp_path / f"{k}.xlsx", {"Main": cells("id", "v") + "".join(cells(f"{k + 1}{i}", i) for i in range(4)), "Extra": cells("z"), "More": cells("y")})
    got = sheet.open_sheet(spark, str(tmp_path / "0.xlsx"))
    assert got.rows == 4 and got.notes == ["sheet 'Main' was read; the others are 'Extra', 'More'"]
    assert workbook._cells(spark, str(tmp_path), None, workbook._files(spark, str(tmp_path))).rdd.getNumPartitions() == 5
    assert sorted(r["id"] for r in workbook.read_workbooks(spark, str(tmp_path)).collect()) == [10 * k + i for k in range(1, 6) for i in range(4)]
    assert workbook.sheet_names(spark, str(tmp_path)).count() == 15


def test_files_that_only_spark_opens(spark, tmp_path, monkeypatch):
    """Where pyarrow does not know the store, content comes from Spark's own reader."""
    cells = lambda *xs: "<row>" + "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' for x in xs) + "</row>"
    for k in range(2):
        book(tmp_path / f"{k}.xlsx", {"S": cells("id") + cells(k)})
    monkeypatch.setattr(workbook.workbook_source, "opens", lambda path: False)
    assert sorted(r["id"] for r in workbook.read_workbooks(spark, str(tmp_path)).collect()) == [0, 1]


def test_many_workbooks_share_tasks(spark, tmp_path, monkeypatch):
    """Tasks take several small files each, and none gets the list of all of them."""
    import pickle

    from pyspark.sql import functions as F

    monkeypatch.setattr(sinks, "PARTS_ALONE", 4)
    monkeypatch.setattr(workbook, "FILES_ALONE", 4)
    df = spark.range(400).select("id", F.concat(F.lit("<&> "), "id").alias("note"))
    done = sinks.write_workbooks(df, ["id"], str(tmp_path / "out"), "t", 4).orderBy("part").collect()
    assert [r["rows"] for r in done] == [4] * 100
    files = workbook._files(spark, str(tmp_path / "out"))
    cells = workbook._cells(spark, str(tmp_path / "out"), None, files)
    assert len(files) == 100 and cells.rdd.getNumPartitions() == max(4, 3 * spark.sparkContext.defaultParallelism)
    assert sorted(map(tuple, workbook.read_workbooks(spark, str(tmp_path / "out")).collect())) == [(i, f"<&> {i}") for i in range(400)]
    sizes = []
    for n in (10, 1000):
        source = workbook.workbook_source.Workbooks({"sheets": str([[f"/{i}.xlsx", "S"] for i in range(n)]).replace("'", '"'), "tasks": "5"})
        reader = source.reader(None)
        sizes.append(len(pickle.dumps((source, reader))))
        assert sorted(x for p in reader.partitions() for x, _ in p.sheets) == sorted(f"/{i}.xlsx" for i in range(n))
    assert sizes[0] == sizes[1]


def test_odd_cells_are_read_as_written(tmp_path):
    """Prefixed names, comments, character data sections, phonetic hints, cells without values or places."""
    rows = '<x:row xmlns:x="u"><x:c r="A1"><!-- no --><x:v>1</x:v></x:c><x:c r="C1" t="str"><x:f>A1</x:f><x:v><![CDATA[a<b]]>&amp;c</x:v></x:c></x:row>'
    rows += '<row><c t="inlineStr"><is><r><t>a</t></r><rPh sb="0" eb="1"><t>hint</t></rPh><r><rPr><b/></rPr><t xml:space="preserve"> b</t></r></is></c><c t="inlineStr"/><c t="n"><v>1E3</v></c><c t="b"><v>0</v></c><c t="str"><v></v></c><c t="e"><v>#N/A</v></c></row>'
    rows += '<row><c r="AB3" s="1"><v>45366.5</v></c><c r="AB3" s="0"><v>-2.50</v></c></row><row><c t="inlineStr"><is><t>  </t></is></c></row>'
    book(tmp_path / "odd.xlsx", {"S": rows}, '<cellXfs><xf/><xf numFmtId="22"/></cellXfs>')
    got = list(workbook.sheet_rows(str(tmp_path / "odd.xlsx"), None))
    assert got == [["1", None, "a<b&c"], ["a b", None, "1000.0", "FALSE", None, "#N/A"], [None] * 27 + ["2024-03-15 12:00:00", "-2.50"]]


def test_columns_of_cells_equal_single_cells():
    import decimal
    import math

    import pyarrow as pa

    day, at = datetime.date, datetime.datetime
    columns = [pa.array([1, None, -(2**63)], pa.int64()), pa.array([0.1, math.nan, math.inf, -0.0, 1e300, None]), pa.array(["a<b>&\x01\uffff", "", " x ", None]), pa.array([day(1900, 3, 1), day(1900, 2, 28), day(1, 1, 1), day(9999, 12, 31), None])]
    columns += [pa.array([True, None, False]), pa.array([decimal.Decimal("1.50"), None]), pa.array([at(2024, 1, 2, 3, 4, 5), at(1899, 1, 1), None])]
    for c in columns:
        assert sinks.cells_of(c) == [sinks.cell(v) for v in c.to_pylist()]
