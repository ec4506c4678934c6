"""Work that a single task holds stays bounded."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickledger.operators import neighbours as K
from tickledger.operators import splits as P


def test_distances_are_held_in_strips():
    rng = np.random.default_rng(1)
    n = K.BLOCK_ROWS
    f = pd.DataFrame({"id": np.arange(n), "vec": list(rng.normal(size=(n, 16))), "_ex": [str(i % 50) for i in range(n)]})
    tracemalloc.start()
    got = K.nearest(f, f, 3, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20 and len(got) == 3 * n
    x = np.stack(f["vec"])
    for q in (0, 255, 256, n - 1):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[np.arange(n) % 50 == q % 50] = np.inf
        assert got[got["qid"] == q]["id"].tolist() == np.argsort(d, kind="stable")[:3].tolist()


def test_a_histogram_does_not_gather_a_column(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 2).alias("g"))
        h = P.histogram(df, ["x"], bins=10)
        assert "BroadcastHashJoin" in h._jdf.queryExecution().executedPlan().toString()
        assert {(r["bin"], r["n"]) for r in h.collect()} == {(i, 100) for i in range(10)}
        by = {(r["g"], r["bin"]): r["n"] for r in P.histogram(df, ["x"], ["g"], bins=5).collect()}
        assert by == {(g, i): 100 for g in (0, 1) for i in range(5)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
