"""Every registered query outside the training-data subpackage that has SQL, against it."""

from pathlib import Path

import duckdb
import pytest

from tidewell.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.skipif(not DATA.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_gives_its_sql(spark, tables, name):
    found = tables.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    df = registry.QUERIES[name](spark, str(DATA))
    assert sorted(df.columns) == sorted(names)
    assert sorted((plain(tuple(r)) for r in df.select(*names).collect()), key=repr) == sorted((plain(r) for r in found.fetchall()), key=repr)
