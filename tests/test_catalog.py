"""Every registered query of the reference tables against its SQL."""

import math
import os

import duckdb
import pytest

from quern import catalog, catalog_plans, catalog_sources  # noqa: F401


def same(a, b):
    """Equal values; floats as near as sums in another order and a rounding on the sixth place allow."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return type(a) is type(b) and a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda rs: sorted((tuple(r) for r in rs), key=lambda r: [repr(x) for x in r if not isinstance(x, float)] + [repr(x) for x in r if isinstance(x, float)])
    ours, theirs = rows(got.select(*cols).collect()), rows(con.sql(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLE_SQL[name]})").fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(map(same, a, b)), (a, b)
