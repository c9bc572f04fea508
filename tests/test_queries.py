"""Every registered query with SQL gives the same rows as its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tremorlake.plans import registry
from tremorlake import plans  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents labels pages benchmark embeddings conversations".split()
SLOW = {"h14_walk_forward", "h13_decluster", "h17_bootstrap_auroc", "h22_seasonal_residuals", "h24_strain"}


@pytest.fixture(scope="module")
def con():
    if not DATA.exists():
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-4)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    cur = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    got = [tuple(r) for r in df.select(*cols).collect()]
    exact = lambda x: (x is None, "" if x is None or isinstance(x, float) else str(x))
    key = lambda r: ([exact(x) for x in r], [round(x, 3) + 0.0 for x in r if isinstance(x, float)])
    got.sort(key=key)
    want.sort(key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(near(x, y) for x, y in zip(a, b, strict=True)), (a, b)
