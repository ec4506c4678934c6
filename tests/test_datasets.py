"""Dense numbers, histories, stratified samples and dataset builds."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tickledger.operators.scan import history, least_rows, numbered, shared_folder
from tickledger.sources import datasets as S


def test_numbers_are_consecutive_in_every_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(1000), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    got = {r.i: r.rank for r in numbered(df, ["g"], ["v", "i"]).collect()}
    for g in ("a", "b", None):
        want = [i for _, i in sorted((v, i) for k, v, i in rows if k == g)]
        assert [got[i] for i in want] == list(range(len(want)))
    assert sorted(r.n for r in numbered(df, [], ["i"], "n", 5).collect()) == list(range(5, 2005))
    assert numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_history_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, t, float(rng.randrange(50))) for k in ("x", "y") for t in sorted(rng.sample(range(3000), 200))]
    got = {(r.k, r.t): [(h.tick, h.value) for h in r.history] for r in history(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v", 300, 256).collect()}
    assert got == {(k, t): [(u, w) for j, u, w in rows if j == k and t - 300 <= u <= t] for k, t, _ in rows}


def test_least_rows_of_each_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([rng.randrange(1 << 40), 5]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, h long, i long")
    got = sorted((r.g, r.h, r.i) for r in least_rows(df, ["g"], F.col("h"), ["i"], 70).collect())
    assert got == sorted(x for g in "abc" for x in sorted(r for r in rows if r[0] == g)[:70])
    assert "RangePartitioning" not in least_rows(df, [], F.col("h"), ["i"], 10)._jdf.queryExecution().toString()


def flat(spark):
    return spark.createDataFrame([(f"m{i % 5}", i, "abc"[i % 3] if i % 5 else "z", float(i)) for i in range(100)], "match_key string, tick int, kind string, x double")


def splits(spark):
    return spark.createDataFrame([("m0", "val"), ("m1", "train"), ("m2", "train"), ("m3", "test"), ("m4", "other")], "match_key string, split string")


def test_dataset_build_and_read(spark):
    base = f"{shared_folder(spark)}/set-{uuid.uuid4().hex}"
    args = {"order": ["tick"], "categories": ["kind"], "numbers": ["x"], "shard_size": 15}
    index = S.build_dataset(flat(spark), splits(spark), base, **args)
    got = {(r.split, r.shard): (r.n, r.first.tick) for r in index.collect()}
    assert got == {("train", 0): (15, 1), ("train", 1): (15, 37), ("train", 2): (10, 76), ("val", 0): (15, 0), ("val", 1): (5, 75), ("test", 0): (15, 3), ("test", 1): (5, 78)}
    assert len(spark.read.parquet(f"{base}/shards/split=train/shard=0").inputFiles()) == 1
    rows = S.read_dataset(spark, base, "val", vocab_hash=index.first().vocab_hash)
    assert {r.kind_id for r in rows.collect()} == {0} and rows.count() == 20  # val has kinds that the train split lacks
    assert [r.tick for r in S.take(S.read_dataset(spark, base), "train", 14, 3, 15).orderBy("place").collect()] == [36, 37, 41]
    with pytest.raises(FileExistsError):
        S.build_dataset(flat(spark), splits(spark), base, **args)
    with pytest.raises(ValueError, match="built with"):
        S.read_dataset(spark, base, layout_hash="foreign")
    with pytest.raises(ValueError, match="no split"):
        S.read_dataset(spark, base, "dev")


def test_dataset_refuses_before_it_writes(spark):
    base = f"{shared_folder(spark)}/set-{uuid.uuid4().hex}"
    args = {"order": ["tick"], "categories": ["kind"], "numbers": ["x"]}
    for bad, change in ((ValueError, {"shard_size": 0}), (ValueError, {"where": F.col("tick") < 0})):
        with pytest.raises(bad):
            S.build_dataset(flat(spark), splits(spark), base, **args, **change)
    assert not S.exists(spark, base)


def test_thinning_keeps_what_is_not_grid(spark):
    rows = spark.createDataFrame([(["grid"], 0.5), (["grid"], 0.25), (["grid", "boundary_pre"], 0.3), (["terminal"], 9.9)], "kinds array<string>, t_s double")
    assert sorted(r.t_s for r in S.thin(rows, 2.0).collect()) == [0.3, 0.5, 9.9] and S.thin(rows, None).count() == 4


def test_fit_store(spark):
    from tickledger.operators import model as G
    from tickledger.operators.splits import layout_hash
    from tickledger.sources.fits import FitStore, NotAdopted

    store = FitStore(spark, f"{shared_folder(spark)}/fits-{uuid.uuid4().hex}")
    with pytest.raises(NotAdopted):
        store.table("shrinkage")
    a, b = (spark.createDataFrame([("x", float(i))], "cls string, k double") for i in range(2))
    assert [store.put_table("shrinkage", a, {"n": 1}), store.put_table("shrinkage", b, {"n": 2})] == [1, 2]
    store.adopt("shrinkage", 1)
    store.adopt("shrinkage", 2)
    assert store.table("shrinkage").first().k == 1.0 and store.table("shrinkage", 1).first().k == 0.0
    store.adopt("shrinkage", 2, "rejected")
    assert store.adopted("shrinkage") == 1 and store.table("shrinkage", layout=layout_hash(a)).first().k == 0.0
    with pytest.raises(ValueError, match="layout"):
        store.table("shrinkage", layout="foreign")
    with pytest.raises(ValueError, match="no version"):
        store.adopt("shrinkage", 9)
    rows = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 2)) for i in range(80)], "p double, q double, label double")
    fitted = G.train_head(rows, ["p", "q"], "label", max_iter=2)
    version = store.put_model("hazard", fitted, rows.select("p", "q"), {"auc": 0.8})
    again = store.model("hazard", version, rows.select("p", "q"))
    score = lambda m: [r.probability[1] for r in m.transform(rows).select("probability").collect()]
    assert score(again) == score(fitted)
    with pytest.raises(ValueError, match="layout"):
        store.model("hazard", version, rows.select("p"))
    assert {(r.kind, r.version, r.in_use) for r in store.models("shrinkage", "hazard").collect()} == {("shrinkage", 1, True), ("shrinkage", 2, False), ("hazard", 1, False)}
