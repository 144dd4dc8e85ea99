"""Quoted fields over several lines, in files cut into many splits; rejected lines; notes on uneven rows."""

import csv
import io
import random
import zipfile

import numpy as np
import pytest

from sparksheet.sources import records, sheet, text


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(r, n, delimiter):
    """Rows whose texts hold quotes, delimiters and line breaks anywhere, also at their ends and next to one another."""
    bits = ["a", "bc", '"', '""', "\n", "\n\n", delimiter, f'"{delimiter}"', f'{delimiter}"', f'"\n{delimiter}', " ", "é", f'5" pipe{delimiter} x']
    cell = lambda: "".join(r.choice(bits) for _ in range(r.randrange(0, 7)))
    return [(str(i), cell(), cell() if r.random() < 0.9 else "z" * 2000 + "\n" + "y" * 900) for i in range(n)]


@pytest.mark.parametrize("delimiter", [",", "\t", "|"])
def test_records_over_many_splits(spark, tmp_path, small_splits, delimiter):
    r = random.Random(ord(delimiter))
    want = []
    for k in range(3):
        rows = made(r, 400, delimiter)
        with open(tmp_path / f"{k}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, delimiter=delimiter, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
            out.writerow(["id", "a\nb", "c"])
            out.writerows([(f"{k}-{i}", *rest) for i, *rest in rows])
        want += [(f"{k}-{i}", *rest) for i, *rest in rows]
    df = text.read_text(spark, str(tmp_path), delimiter=delimiter, all_text=True)
    assert df.columns == ["id", "a\nb", "c"]
    got = sorted(tuple(x or "" for x in row) for row in df.collect())
    assert got == sorted(want)
    lines = records.lines_of(spark, str(tmp_path), delimiter)
    assert lines.select("file", "block").distinct().count() > 100


def test_line_functions_compose():
    """Composed functions, and states within a split, are those of a walk line by line."""
    r = np.random.default_rng(1)
    for _ in range(200):
        codes = r.integers(0, 4, r.integers(1, 30)).astype(np.int32)
        for start in (0, 1):
            state, walk = start, []
            for c in codes.tolist():
                state = c >> state & 1
                walk.append(state)
            assert records.states(codes, start).tolist() == walk and records.composed(codes) >> start & 1 == state


@pytest.mark.parametrize("line", ['a,"b', 'a,b"c', '"a""b",c', '"a"",b', '"', '""', '","', ',"a,b",', '"x"y,"z', 'x"', '","a', '"""', '""""', 'a", "b'])
def test_what_a_line_does(spark, line):
    """Against a walk over the line's characters."""

    def walk(inside: bool) -> bool:
        at, fresh = 0, True
        while at < len(line):
            c = line[at]
            if inside and c == '"' and line[at + 1 : at + 2] == '"':
                at += 1
            elif inside and c == '"':
                inside, fresh = False, False
            elif not inside:
                if c == '"' and fresh:
                    inside = True
                fresh = c == ","
            at += 1
        return inside

    from pyspark.sql import functions as F

    code = spark.createDataFrame([(line,)], "value string").select(records.effect(F.col("value"), ",")).first()[0]
    assert (bool(code & 1), bool(code & 2)) == (walk(False), walk(True))


def test_a_quote_that_never_ends(spark, tmp_path, small_splits):
    """Such a file is read line by line, and its line is named; other files keep their records."""
    rows = [f"{i},plain {i}" for i in range(200)]
    rows[120] = '120,"never closed'
    (tmp_path / "bad.csv").write_text("k,v\n" + "\n".join(rows) + "\n")
    (tmp_path / "good.csv").write_text('k,v\n900,"two\nlines"\n')
    got = {r["k"]: r["v"] for r in text.read_text(spark, str(tmp_path), all_text=True).collect()}
    assert len(got) == 201 and got["900"] == "two\nlines" and got["199"] == "plain 199"
    bad = text.rejected(spark, str(tmp_path)).collect()
    assert [(r["file"].rpartition("/")[2], r["rejected"], r["lines"], r["reasons"]) for r in bad] == [("bad.csv", 1, [122], ["quotes"])]


def test_opening_tells_of_uneven_rows_and_members(spark, tmp_path):
    p = tmp_path / "uneven.csv"
    p.write_text("city,people\nBonn,3\nGent,5,harbour\nPisa\nRome,\"1\n2\"\n")
    got = sheet.open_sheet(spark, str(p))
    assert got.rows == 4 and got.df.columns == ["city", "people", "column3"] and len(got.notes) == 3 and "1 rows have more" in got.notes[0] and "1 rows have fewer" in got.notes[1]
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.csv", "x,y\n1,2\n")
        z.writestr("b.csv", "x,y\n3,4\n")
    assert sheet.open_sheet(spark, str(tmp_path / "two.zip")).notes == ["2 files in the archive: a.csv was opened"]
    p.write_text("a,b\n1,2\n")
    assert sheet.open_sheet(spark, str(p)).notes == []


def test_quotes_within_fields_open_nothing(spark, tmp_path):
    body = 'k,v\n1,5" pipe\n2,"6"" pipe"\n3,x"y"z\n'
    (tmp_path / "pipes.csv").write_text(body)
    got = [tuple(r) for r in text.read_text(spark, str(tmp_path / "pipes.csv")).orderBy("k").collect()]
    assert got == [(int(a), b) for a, b in list(csv.reader(io.StringIO(body)))[1:]]


def test_each_file_by_its_own_verdict(spark, tmp_path, small_splits):
    from sparksheet.functions.columns import SheetError
    from sparksheet.sources import folder

    body = lambda sep, n, extra="": "".join(f"{i}{sep}né {i}{extra}\n" for i in range(n))
    (tmp_path / "a.csv").write_bytes(("id,name\n" + body(",", 100)).encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes(("\nID;Name;price\n" + body(";", 90, ";“1,5”")).encode("cp1252"))
    (tmp_path / "c.tsv").write_bytes(("1\t2\r\n" + "3\t4\t5\r\n" * 50).encode())
    (tmp_path / "d.csv").write_bytes(b'name|id\n"x|y"|7\nname|id\n')
    (tmp_path / "empty.csv").write_bytes(b"")
    seen = {r["file"].rpartition("/")[2]: (r["encoding"], r["delimiter"], r["header"], r["names"]) for r in folder.verdicts(spark, str(tmp_path)).collect()}
    assert seen == {"a.csv": ("UTF-8", ",", True, ["id", "name"]), "b.csv": ("windows-1252", ";", True, ["ID", "Name", "price"]), "c.tsv": ("UTF-8", "\t", False, ["column1", "column2", "column3"]), "d.csv": ("UTF-8", "|", True, ["name", "id"])}
    df = folder.read_folder(spark, str(tmp_path), all_text=True, file_col="file")
    assert [c.lower() for c in df.columns] == ["column1", "id", "name", "column2", "column3", "price", "file"]
    by = {}
    for r in df.collect():
        by.setdefault(r["file"].rpartition("/")[2], []).append(tuple(r)[:-1])
    assert sorted(by["a.csv"], key=str) == sorted([(None, str(i), f"né {i}", None, None, None) for i in range(100)], key=str)
    assert sorted(by["b.csv"], key=str) == sorted([(None, str(i), f"né {i}", None, None, "“1,5”") for i in range(90)], key=str)
    assert sorted(by["c.tsv"], key=str) == sorted([("1", None, None, "2", None, None)] + [("3", None, None, "4", "5", None)] * 50, key=str)
    assert sorted(by["d.csv"], key=str) == [(None, "7", "x|y", None, None, None), (None, "id", "name", None, None, None)]
    (tmp_path / "w.csv").write_bytes("a,b\n1,2\n".encode("utf-16"))
    with pytest.raises(SheetError):
        folder.read_folder(spark, str(tmp_path))
