"""Queries against their SQL on the given tables."""

import duckdb
import pytest
from given import DATA

from tickledger.llm.queries import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(CHECKS[name])
    cols = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(cols)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in got.collect())
    assert rows == sorted(repr(tuple(r)) for r in want.fetchall())


def test_every_operator_has_a_query():
    from corpus_pipeline import STAGES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and len(STAGES) == 5
