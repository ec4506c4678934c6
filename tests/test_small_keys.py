"""Keys that fit one task are sorted once; larger ones are cut in blocks, with the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from tickledger.operators import scan as S


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    key = lambda: rng.choice(["a", "b", "c", None])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(200)]
    right = [(key(), rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.random()) for _ in range(200)]
    return spark.createDataFrame(left, "id long, key string, tick long"), spark.createDataFrame(right, "key string, rt long, v long, w double")


def both(monkeypatch, make):
    """Rows with small keys and with every key cut in blocks."""
    out = []
    for bound in (S.KEY_ROWS, 0):
        monkeypatch.setattr(S, "KEY_ROWS", bound)
        rows = make()
        out.append(sorted(map(str, rows.select(*sorted(rows.columns)).collect())))
    return out


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True), ("nearest", False)])
def test_asof_small_and_cut(tables, monkeypatch, direction, strict):
    left, right = tables
    small, cut = both(monkeypatch, lambda: S.asof(left, right, ["key"], "tick", "rt", ["v", "w"], width=7, direction=direction, strict=strict, right_tick="m"))
    assert small == cut and len(small) == 200


def test_scans_small_and_cut(tables, monkeypatch):
    left = tables[0].where("key is not null and tick is not null")
    runs = [S.Run("n", "sum", F.lit(1)), S.Run("later", "min", F.col("id"), past=False, inclusive=False), S.Run("odd", "last", F.when(F.col("id") % 2 == 1, F.col("id")))]
    small, cut = both(monkeypatch, lambda: S.scan(left, ["key"], ["tick", "id"], runs, 7))
    assert small == cut
    small, cut = both(monkeypatch, lambda: S.sessionize(left, ["key"], "tick", 2, "g", 7, tie=["id"]))
    assert small == cut
    small, cut = both(monkeypatch, lambda: S.chain_spans(left.withColumn("end", F.col("tick") + F.col("id") % 3), ["key"], "tick", "end", "chain", 7))
    assert small == cut


def test_small_keys_are_shuffled_once(tables):
    left, right = tables
    assert shuffles(S.asof(left, right, ["key"], "tick", "rt", ["v"], width=7)) == 1
    assert shuffles(S.scan(left, ["key"], ["tick"], [S.Run("n", "sum", F.lit(1))], 7)) == 1
    assert shuffles(S.sessionize(left, ["key"], "tick", 5, "g", 7)) == 1


def test_feed_parses_events_once(spark):
    from tickledger.plans.projection import feed

    for name, table in feed(spark, "/root/testdata/sf0.001").tables.items():
        assert "get_json_object" not in table._jdf.queryExecution().optimizedPlan().toString(), name
