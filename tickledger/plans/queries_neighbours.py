"""Queries for neighbour search, panels and outlier distances over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbours as K
from .registry import query, table

EMB = """e AS (SELECT vec_id AS id, embedding AS vec, label AS map, vec_id % 2 AS side, vec_id % 50 AS mk, vec_id % 7 AS dk, (vec_id % 100) / 100.0 AS V FROM embeddings),
p AS (SELECT q.id AS qid, x.id, x.dk, x.V, round(list_cosine_distance(q.vec::DOUBLE[], x.vec::DOUBLE[]), 9) AS d FROM e q JOIN e x ON q.map = x.map AND q.side = x.side AND q.mk <> x.mk),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM p QUALIFY rank <= 20)"""


def _emb(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("map"), (F.col("vec_id") % 2).alias("side"), (F.col("vec_id") % 50).alias("mk"),
                    (F.col("vec_id") % 7).cast("string").alias("descriptor_key"), ((F.col("vec_id") % 100) / 100.0).alias("V"), F.col("vec_id").cast("string").alias("action_id"))


@query("knn_neighbours", f"WITH {EMB} SELECT qid, CAST(count(*) AS BIGINT) AS n, round(max(d), 5) AS far, round(sum(d), 4) AS total FROM n GROUP BY qid")
def knn_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty nearest of the same side and map outside the own match."""
    e = _emb(spark, sf)
    n = K.knn_cosine(e, e, ["map", "side"], 20, "mk")
    d = F.lit(1.0) - F.col("cosine")
    return n.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(d), 5).alias("far"), F.round(F.sum(d), 4).alias("total"))


@query("knn_panel", f"""WITH {EMB}, g AS (SELECT qid, CAST(dk AS VARCHAR) AS key, count(*) AS n, avg(V) AS mv FROM n GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY qid) AS t, row_number() OVER (PARTITION BY qid ORDER BY n DESC, key) AS pos FROM g)
SELECT qid, key, n, CAST(pos AS INT) AS pos, round(mv, 6) AS mean_V, round(n / CAST(t AS DOUBLE), 6) AS freq FROM r WHERE pos <= 3""")
def knn_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The three most frequent actions of the neighbours."""
    e = _emb(spark, sf)
    n = K.knn_cosine(e, e, ["map", "side"], 20, "mk")
    entries, _ = K.panels(n, e.select("id", "action_id", "descriptor_key", "V"), top=3)
    return entries.select("qid", "key", "n", "pos", F.round("mean_V", 6).alias("mean_V"), F.round("freq", 6).alias("freq"))


@query("ood_threshold", """
WITH t AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 5 <> 0), h AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 5 = 0),
d AS (SELECT h.id AS qid, list_distance(h.vec, t.vec) AS d, row_number() OVER (PARTITION BY h.id ORDER BY list_distance(h.vec, t.vec)) AS r FROM h, t QUALIFY r <= 10),
s AS (SELECT qid, max(d) AS score FROM d GROUP BY qid), c AS (SELECT quantile_cont(score, 0.9) AS threshold FROM s)
SELECT qid, round(score, 4) AS score, score > threshold AS flag FROM s, c""")
def ood_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out vectors by their distance to the tenth training vector."""
    e = _emb(spark, sf)
    s = K.kth_distance(e.where("id % 5 = 0"), e.where("id % 5 <> 0"), 10)
    return K.ood_flags(s, K.ood_threshold(s, 90.0)).select("qid", F.round("score", 4).alias("score"), "flag")


@query("pairwise_distance", """
WITH e AS (SELECT vec_id // 10 AS st, CAST(vec_id % 10 AS INT) AS slot, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings)
SELECT a.st, a.slot AS a_slot, b.slot AS b_slot, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 5) AS dist_units, CASE WHEN (a.slot < 5) = (b.slot < 5) THEN 1.0 ELSE 0.0 END AS same_team
FROM e a JOIN e b ON a.st = b.st AND a.slot < b.slot""")
def pairwise_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of the 45 pairs of ten players."""
    from ..operators.feed import Feed
    from ..operators.state import state_pairs

    e = table(spark, sf, "embeddings")
    xyz = [(F.get("embedding", F.lit(i)).cast("double") * s).alias(c) for i, (c, s) in enumerate((("x", 1000), ("y", 1000), ("z", 100)))]
    t = e.select(F.lit("m").alias("match_key"), F.lit(1).alias("round_num"), F.floor(F.col("vec_id") / 10).cast("bigint").alias("tick"), (F.col("vec_id") % 10).cast("int").alias("slot"), *xyz)
    t = t.withColumns({"side": F.when(F.col("slot") < 5, "ct").otherwise("t"), "alive": F.lit(1), "is_ducking": F.lit(0), "nav_area": F.lit(None).cast("bigint")})
    u = t.limit(0).select("match_key", "round_num", "tick", F.lit(None).cast("array<struct<kind:string,x:double,y:double,z:double,time_left_s:double,owner_side:string,owner_id:bigint,radius_units:double>>").alias("utility"))
    p = state_pairs(Feed({}), t, u)
    return p.select(F.col("tick").alias("st"), "a_slot", "b_slot", F.round("dist_units", 5).alias("dist_units"), "same_team")
