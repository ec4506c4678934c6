"""Queries for histories, scores that read them, and stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import past_features
from ..operators.scan import history, least_rows
from .projection import WIDTH, events, feed, with_sql
from .registry import query

PAST, HALF, SAMPLE = 7200, 600.0, 40


@query("history_scores", with_sql(f"""SELECT match_key, round_num, tick, count(*) AS n, round(avg(pv), 6) AS mean, round(sum(pv * w) / sum(w), 6) AS recent, round(any_value(v) - min_by(pv, pt), 6) AS change,
  round(1 / (1 + exp(-(0.02 * (any_value(v) - avg(pv)) + 0.01 * (sum(pv * w) / sum(w) - 50)))), 6) AS score
  FROM (SELECT a.match_key, a.round_num, a.tick, a.v, b.tick AS pt, b.v AS pv, 1 / (1 + (a.tick - b.tick) / {HALF}) AS w FROM hv a JOIN hv b ON b.match_key = a.match_key AND b.round_num = a.round_num AND b.tick BETWEEN a.tick - {PAST} AND a.tick)
  GROUP BY match_key, round_num, tick""", "hv AS (SELECT match_key, round_num, tick, avg(health) AS v FROM ticks GROUP BY ALL)"))
def history_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score of every state from the sequence of the states of its last two hours, carried along the sorted ticks."""
    v = feed(spark, sf)["ticks"].groupBy("match_key", "round_num", "tick").agg(F.avg("health").alias("v"))
    h = history(v, ["match_key", "round_num"], "tick", "v", PAST, WIDTH).withColumns(past_features(F.col("history"), HALF, "p"))
    score = 1 / (1 + F.exp(-(0.02 * (F.col("v") - F.col("p_mean")) + 0.01 * (F.col("p_recent") - 50))))
    return h.select("match_key", "round_num", "tick", F.col("p_n").cast("long").alias("n"), F.round("p_mean", 6).alias("mean"), F.round("p_recent", 6).alias("recent"), F.round("p_change", 6).alias("change"), F.round(score, 6).alias("score"))


@query("stratified_sample", with_sql(f"""SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY substr(md5(CAST(event_id AS VARCHAR)), 1, 10), event_id) AS r FROM ev) WHERE r <= {SAMPLE}"""))
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The cases of each kind with the least hashes: a seeded sample of every stratum without a sort of all rows."""
    h = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 10), 16, 10).cast("long")
    return least_rows(events(spark, sf).select("event_type", "event_id"), ["event_type"], h, ["event_id"], SAMPLE)
