"""Every query beside its oracle in DuckDB, over the smallest tables, and the entry point's contract."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))
sys.path.insert(0, str(ROOT))

from compare import plain  # noqa: E402

from marginalia.plans import registry  # noqa: E402

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, tables, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in ORACLES:
        rel = tables.execute(ORACLES[name])
        their = [d[0] for d in rel.description]
        assert sorted(their) == cols
        assert got == Counter(tuple(plain(r[their.index(c)]) for c in cols) for r in rel.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
