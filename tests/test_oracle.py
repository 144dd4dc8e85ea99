"""Every registered query of the library against its SQL, as the driver compares them."""

import duckdb
import pytest

from sparksheet import queries as library

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.execute(library.ORACLES[name])
    assert sorted(d[0] for d in want.description) == names
    at = [[d[0] for d in want.description].index(n) for n in names]
    key = lambda r: tuple(str(x) for x in r)
    expected = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    assert got == expected
