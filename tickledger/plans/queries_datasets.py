"""Queries for dense numbers and dataset builds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import durable, numbered, shared_folder
from ..sources import datasets as S
from .projection import feed, with_sql
from .registry import query, table


@query("dense_numbers", "SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS place FROM lineitem")
def dense_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive numbers of the lines of each return flag by date; few large groups, spread over all tasks."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return numbered(rows, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"], "place").drop("l_shipdate")


SIZE = 500
NUMBERS = ["x", "health", "armor", "money"]
_SPLIT = "CASE CAST(substr(match_key, 2) AS INT) % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'unused' ELSE 'train' END"

DATASET_SQL = f"""
d AS (SELECT *, {_SPLIT} AS split FROM ticks WHERE is_alive),
dv AS (SELECT field, value, row_number() OVER (PARTITION BY field ORDER BY value) + 2 AS id FROM (
  SELECT 'active_weapon' AS field, active_weapon AS value, count(*) AS n FROM d WHERE split = 'train' GROUP BY ALL UNION ALL SELECT 'side', side, count(*) FROM d WHERE split = 'train' GROUP BY ALL) WHERE value IS NOT NULL AND n >= 3),
dm AS (SELECT {', '.join(f'avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END AS {c}_s' for c in NUMBERS)} FROM d WHERE split = 'train'),
dp AS (SELECT d.*, row_number() OVER (PARTITION BY split ORDER BY match_key, round_num, tick, steamid) - 1 AS place, coalesce(w.id, 0) AS wid, coalesce(s.id, 0) AS sid
  FROM d LEFT JOIN dv w ON w.field = 'active_weapon' AND w.value = active_weapon LEFT JOIN dv s ON s.field = 'side' AND s.value = side WHERE split <> 'unused')"""


@query("dataset_build", with_sql(f"""SELECT split, CAST(place // {SIZE} AS INT) AS shard, count(*) AS n, min(place) AS first_place, sum(wid)::BIGINT AS weapon_ids, sum(sid)::BIGINT AS side_ids,
  {', '.join(f'round(sum(({c} - {c}_m) / {c}_s), 4) AS {c}_norm' for c in NUMBERS)} FROM dp, dm GROUP BY split, place // {SIZE}""", DATASET_SQL))
def dataset_build(spark: SparkSession, sf: str) -> DataFrame:
    """A dataset of living players' ticks, built and read again: rows, ids and normalised sums of every shard."""
    ticks = durable(feed(spark, sf)["ticks"].where("is_alive").select("match_key", "round_num", "tick", "steamid", "side", "active_weapon", *NUMBERS))
    split_of = ticks.select("match_key").distinct().withColumn("split", F.expr(_SPLIT))
    base = f"{shared_folder(spark).rstrip('/')}/dataset-{uuid.uuid4().hex}"
    index = S.build_dataset(ticks, split_of, base, order=["match_key", "round_num", "tick", "steamid"], categories=["active_weapon", "side"], numbers=NUMBERS, shard_size=SIZE, first_id=3, min_count=3)
    marks = index.first()
    rows = S.read_dataset(spark, base, layout_hash=marks.layout_hash, vocab_hash=marks.vocab_hash, norm_hash=marks.norm_hash)
    known = S.P.normalize(rows, spark.read.parquet(f"{base}/norm"), NUMBERS)
    return known.groupBy("split", "shard").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place"), F.sum("active_weapon_id").alias("weapon_ids"), F.sum("side_id").alias("side_ids"), *[F.round(F.sum(c), 4).alias(f"{c}_norm") for c in NUMBERS])
