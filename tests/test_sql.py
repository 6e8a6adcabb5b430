"""Every query of the core with SQL, against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from verify import norm

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def modules():
    from lodeseam.plans import answer_queries, core_queries, index_queries, ingest_queries, retrieval_queries, stream_queries, text_queries

    return [core_queries, text_queries, ingest_queries, retrieval_queries, index_queries, answer_queries, stream_queries]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name,module", [(n, m) for m in modules() for n in m.QUERIES if n in m.SQL])
def test_query(spark, con, name, module):
    df = module.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(module.SQL[name])
    head = [x[0] for x in cur.description]
    order = sorted(range(len(head)), key=lambda i: head[i])
    assert sorted(head) == cols
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
