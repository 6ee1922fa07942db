"""Every core query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from chorale.plans import core_queries, oracle

DATA = Path("/root/testdata/sf0.001")
SQL = oracle.oracle_sql()


def rows(names, data):
    def one(v):
        return f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([one(r[i]) for i in order] for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core_queries.queries()))
def test_query(spark, con, name):
    df = core_queries.queries()[name](spark, str(DATA))
    got = rows(df.columns, df.collect())
    if name in SQL:
        c = con.execute(SQL[name])
        assert got == rows([d[0] for d in c.description], c.fetchall())
    else:
        assert got


def test_sql_has_a_query():
    assert set(SQL) <= set(core_queries.queries())


def test_core_never_imports_the_subpackage():
    root = Path(core_queries.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert ".llm" not in f.read_text(), f


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_intervals_read_no_texts(spark):
    plan = core_queries.p3_found(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "segments:array<struct<start:double,end:double>>" in plan and "full_text" not in plan


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["segments_flatten", "segments_count", "segment_projection", "transcript_full_text", "report_lines", "json_record"])
def test_repeats_move_no_text(spark, name):
    """No exchange before the rows are taken apart: only the few repeated keys are broadcast."""
    plan = core_queries.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("BroadcastHashJoin") :]
    assert "Exchange hashpartitioning" not in below


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["segment_clock", "chunk_30s"])
def test_times_are_read_without_texts(spark, name):
    plan = core_queries.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "segments:array<struct<start:double,end:double>>" in plan
