"""Every query of the subpackage on the smallest tables, against its SQL where there is one."""

import math
from pathlib import Path

import duckdb
import pytest

from chorale.llm import queries, tokens

DATA = Path("/root/testdata/sf0.001")
SQL = queries.oracle_sql()
pytestmark = pytest.mark.skipif(not DATA.exists() or not Path(tokens.VOCABULARY).exists(), reason="no test tables or vocabulary")


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


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    # two dozen labels at the smallest scale are too few for any rule of problem 9
    df = queries.queries()[name](spark, str(DATA.parent / "sf0.01" if name.startswith("p9") else DATA))
    got = rows(df.columns, df.collect())
    assert got
    if name in SQL:
        c = con.execute(SQL[name])
        assert got == rows([d[0] for d in c.description], c.fetchall())
    elif name.endswith("_found"):
        assert len(got) == len({tuple(r) for r in got})


COLUMNS = {
    "p2_found": "result_id bigint, seg_no bigint, lang string",
    "p4_found": "result_id_a bigint, result_id_b bigint",
    "p5_found": "result_id bigint, piece_no bigint, start_cs bigint, end_cs bigint",
    "p8_found": "doc_id bigint, item_id bigint",
    "p9_found": "doc_id bigint, subject string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.queries()[name](spark, str(DATA))
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]


def test_sql_has_a_query():
    assert set(SQL) <= set(queries.queries())
