"""Queries for feed normalisation, quarantine and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import normalize as N
from ..operators import sampling as C
from ..operators.scan import Run, cumulative, probe, sessionize
from .projection import WIDTH, events, feed, rounds, with_sql
from .registry import query, table

ROUND = ["match_key", "round_num"]


@query("assign_round_asof", with_sql("""
SELECT e.match_key, e.event_id, r.round_num FROM ev e ASOF JOIN (SELECT * FROM rounds) r
ON e.match_key = r.match_key AND e.tick >= r.start_tick WHERE e.tick <= r.official_end_tick"""))
def assign_round_asof(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    out = N.assign_round(ev.select("match_key", "tick", "event_id"), rounds(ev), width=WIDTH)
    return out.select("match_key", "event_id", "round_num")


@query("value_mapping_counts", """
SELECT user_id // 10 AS lobby, CASE event_type WHEN 'click' THEN 'damage' WHEN 'purchase' THEN 'kill' END AS action, count(*) AS n
FROM events GROUP BY ALL""")
def value_mapping_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary mapping with unmapped values counted."""
    ev = events(spark, sf).withColumn("action", F.upper("event_type"))
    kept, dropped = N.drop_unmapped(ev, "action", {"click": "damage", "purchase": "kill"})
    lobby = F.substring("match_key", 2, 6).cast("bigint").alias("lobby")
    a = kept.groupBy(lobby, "action").agg(F.count(F.lit(1)).alias("n"))
    b = dropped.select(lobby, F.lit(None).cast("string").alias("action"), F.col("n_dropped").alias("n"))
    return a.unionByName(b)


@query("running_totals_asof", with_sql("""
SELECT d.event_id, k.n AS kills_so_far, k.total AS dealt_so_far FROM damages d ASOF LEFT JOIN (
  SELECT match_key, round_num, attacker_steamid, tick,
    CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(total) OVER w AS BIGINT) AS total
  FROM (SELECT match_key, round_num, attacker_steamid, tick, count(*) AS n, sum(event_id % 100) AS total FROM kills GROUP BY ALL)
  WINDOW w AS (PARTITION BY match_key, round_num, attacker_steamid ORDER BY tick)) k
ON d.match_key = k.match_key AND d.round_num = k.round_num AND d.attacker_steamid = k.attacker_steamid AND d.tick >= k.tick"""))
def running_totals_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Kills and their running total known at each hit."""
    f = feed(spark, sf)
    runs = [Run("kills_so_far", "sum", F.lit(1)), Run("dealt_so_far", "sum", F.col("event_id") % 100)]
    out = probe(f["damages"], f["kills"], [*ROUND, "attacker_steamid"], "tick", "tick", runs, width=WIDTH)
    return out.select("event_id", "kills_so_far", "dealt_so_far")


@query("cumulative_per_tick", with_sql("""
SELECT match_key, round_num, attacker_steamid, tick, CAST(sum(n) OVER (PARTITION BY match_key, round_num, attacker_steamid ORDER BY tick) AS BIGINT) AS dealt
FROM (SELECT match_key, round_num, attacker_steamid, tick, sum(dmg_health) AS n FROM damages GROUP BY ALL)"""))
def cumulative_per_tick(spark: SparkSession, sf: str) -> DataFrame:
    """Damage dealt so far, one row per player and tick."""
    d = feed(spark, sf)["damages"]
    return cumulative(d, [*ROUND, "attacker_steamid"], "tick", F.col("dmg_health"), "dealt", WIDTH)


@query("interval_pairing", with_sql("""
SELECT s.event_id, s.tick AS start_tick, coalesce(min(e.tick), any_value(r.official_end_tick)) AS end_tick
FROM ev s JOIN rounds r USING (match_key, round_num)
LEFT JOIN ev e ON e.match_key = s.match_key AND e.round_num = s.round_num AND e.sid = s.sid AND e.event_type = 'error' AND e.tick >= s.tick
WHERE s.event_type = 'signup' GROUP BY s.event_id, s.tick"""))
def interval_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Start events with the next end event of the player, else the round's end."""
    ev = events(spark, sf).withColumn("steamid", F.col("sid"))
    r = rounds(ev).withColumn("_hi", F.col("official_end_tick"))
    kind = F.when(F.col("event_type") == "signup", "start_plant").when(F.col("event_type") == "error", "finish_plant")
    b = ev.withColumn("event", kind)
    pairs = N.interval_pairs(b, N.PLAYER, "tick", F.col("event") == "start_plant", F.col("event") == "finish_plant", "_pe", WIDTH)
    out = pairs.join(r.select(*ROUND, "_hi"), ROUND, "left")
    return out.select("event_id", F.col("tick").alias("start_tick"), F.coalesce("_pe", "_hi").alias("end_tick"))


@query("collapse_segments", """
WITH k AS (SELECT CAST(props->>'$.k' AS BIGINT) AS ent, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS tick, value, event_id FROM events),
p AS (SELECT *, lag(tick) OVER (PARTITION BY ent ORDER BY tick, event_id) AS pt FROM k),
s AS (SELECT *, sum(CASE WHEN pt IS NULL OR tick - pt > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY ent ORDER BY tick, event_id) - 1 AS seg FROM p)
SELECT ent, min(tick) AS segment, count(*) AS n, min(tick) AS first_tick, max(tick) AS last_tick,
  arg_max(value, tick * 1000000000 + event_id) AS last_value FROM s GROUP BY ent, seg""")
def collapse_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an entity to segments split at gaps, with first and last tick and last value."""
    e = table(spark, sf, "events").select(
        F.get_json_object("props", "$.k").cast("bigint").alias("ent"),
        F.unix_timestamp(F.date_trunc("second", "ts")).cast("bigint").alias("tick"), "value", "event_id")
    seg = N.collapse_segments(e.select("ent", "tick").distinct(), ["ent"], "tick", 1800, 86400)
    out = e.join(seg, ["ent", "tick"])
    return out.groupBy("ent", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"),
        F.max_by("value", F.struct("tick", "event_id")).alias("last_value"))


@query("nearest_link_tolerance", with_sql("""
SELECT e.event_id, arg_min(g.entity_id, abs(g.detonate_tick - e.tick) * 2 + CASE WHEN g.detonate_tick <= e.tick THEN 0 ELSE 1 END) AS link_id
FROM damages e LEFT JOIN (SELECT match_key, thrower_steamid, detonate_tick, max(entity_id) AS entity_id FROM grenades WHERE type = 'flash' GROUP BY ALL) g
ON g.match_key = e.match_key AND g.thrower_steamid = e.attacker_steamid AND abs(g.detonate_tick - e.tick) <= 20000
GROUP BY e.event_id"""))
def nearest_link_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """Each hit linked to its attacker's nearest flash within a tolerance."""
    f = feed(spark, sf)
    out = N.link(f["damages"], f["grenades"], ["flash"], "tick", "attacker_steamid", 20000, "detonate_tick", "nearest", WIDTH)
    return out.select("event_id", "link_id")


@query("remaining_blindness", with_sql("""
SELECT d.event_id, round(greatest(0.0, coalesce(f.blind_duration - (d.tick - f.detonate_tick) / 128.0, 0.0)), 4) AS blind_left
FROM damages d ASOF LEFT JOIN (SELECT match_key, player_steamid, detonate_tick, max(blind_duration) AS blind_duration FROM flashes GROUP BY ALL) f
ON d.match_key = f.match_key AND d.attacker_steamid = f.player_steamid AND d.tick >= f.detonate_tick"""))
def remaining_blindness(spark: SparkSession, sf: str) -> DataFrame:
    """Blind seconds left of the attacker at each hit."""
    f = feed(spark, sf)
    hits = f["damages"].withColumn("steamid", F.col("attacker_steamid"))
    out = N.remaining_flash(hits, f["flashes"], 128, WIDTH)
    return out.select("event_id", F.round(F.col("flash_duration").cast("double"), 4).alias("blind_left"))


@query("dead_rows_last_position", with_sql("""
SELECT match_key, steamid, tick, last_value(CASE WHEN is_alive THEN x END IGNORE NULLS) OVER w AS x,
  CASE WHEN is_alive THEN health ELSE 0 END AS health FROM ticks
WINDOW w AS (PARTITION BY match_key, round_num, steamid ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def dead_rows_last_position(spark: SparkSession, sf: str) -> DataFrame:
    """Dead rows keep the last position of the living player."""
    f = feed(spark, sf)
    t = f["ticks"].withColumn("flash_duration", F.lit(0.0))
    return N.dead_rows(t, WIDTH).select("match_key", "steamid", "tick", "x", F.col("health").cast("bigint").alias("health"))


@query("defuse_edges", with_sql("""
SELECT match_key, steamid, tick, event FROM (
  SELECT *, unnest([CASE WHEN d AND NOT p THEN 'rise' END, CASE WHEN d AND NOT n THEN 'last' END]) AS event FROM (
    SELECT match_key, round_num, steamid, tick, is_defusing AS d,
      coalesce(lag(is_defusing) OVER w, FALSE) AS p, coalesce(lead(is_defusing) OVER w, FALSE) AS n FROM ticks
    WINDOW w AS (PARTITION BY match_key, round_num, steamid ORDER BY tick))) WHERE event IS NOT NULL"""))
def defuse_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Rising and last-true rows of a flag."""
    f = feed(spark, sf)
    e = N.flag_edges(f["ticks"].select(*N.PLAYER, "tick", "is_defusing"), N.PLAYER, "tick", "is_defusing", WIDTH)
    kinds = F.array_compact(F.array(F.when(F.col("is_rise"), "rise"), F.when(F.col("is_last"), "last")))
    return e.select("match_key", "steamid", "tick", F.explode(kinds).alias("event"))


@query("running_score_swap", """
WITH r AS (SELECT date_part('year', o_orderdate) AS match_no, CAST(date_part('month', o_orderdate) AS INT) AS round_num, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) AS d FROM orders GROUP BY ALL),
w AS (SELECT CAST(match_no AS BIGINT) AS match_no, round_num, CASE WHEN d > 0 THEN 'ct' ELSE 't' END AS won, round_num > 6 AS swapped FROM r)
SELECT match_no, round_num,
  CAST(CASE WHEN swapped THEN b ELSE a END AS INT) AS ct_score_before, CAST(CASE WHEN swapped THEN a ELSE b END AS INT) AS t_score_before FROM (
  SELECT *, coalesce(sum(CASE WHEN (won = 'ct') = NOT swapped THEN 1 ELSE 0 END) OVER p, 0) AS a,
    coalesce(sum(CASE WHEN (won = 'ct') = NOT swapped THEN 0 ELSE 1 END) OVER p, 0) AS b FROM w
  WINDOW p AS (PARTITION BY match_no ORDER BY round_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def running_score_swap(spark: SparkSession, sf: str) -> DataFrame:
    """Score before each round, followed by roster across the half-time side swap."""
    o = table(spark, sf, "orders")
    d = F.sum(F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1))
    r = o.groupBy(F.year("o_orderdate").cast("string").alias("match_key"), F.month("o_orderdate").alias("round_num")).agg(d.alias("d"))
    r = r.withColumn("winner_side", F.when(F.col("d") > 0, "ct").otherwise("t"))
    a, b = F.array(F.lit(1), F.lit(2)).cast("array<bigint>"), F.array(F.lit(3), F.lit(4)).cast("array<bigint>")
    sw = F.col("round_num") > 6
    rosters = r.select(*ROUND, F.when(sw, b).otherwise(a).alias("ct"), F.when(sw, a).otherwise(b).alias("t"))
    out = N.scores(r.select(*ROUND, "winner_side"), rosters)
    return out.select(F.col("match_key").cast("bigint").alias("match_no"), "round_num", "ct_score_before", "t_score_before")


@query("quarantine_first_reason", """
SELECT o_orderkey, CASE WHEN c_acctbal IS NULL OR abs(o_totalprice / 1000 - 128) > 100.5 THEN 'tick_rate_not_128'
  WHEN c_nationkey < 13 THEN 'too_few_rounds' WHEN NOT (o_orderkey % 7 = 5 AND o_custkey % 7 = 5) AND o_orderkey % 3 = 0 THEN 'not_5v5'
  WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'unknown_map'
  WHEN NOT (o_totalprice / 10 BETWEEN 720 AND 18000) THEN 'duration_implausible' END AS reason
FROM orders JOIN customer ON o_custkey = c_custkey""")
def quarantine_first_reason(spark: SparkSession, sf: str) -> DataFrame:
    """First failing rule per match."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    five = (F.col("o_orderkey") % 3 != 0)
    m = o.select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("tick_rate_raw"), F.lit(128).alias("tick_rate"),
        F.col("c_nationkey").alias("n_rounds"), F.when(five, 5).otherwise(F.col("o_orderkey") % 7).alias("n_ct"),
        F.when(five, 5).otherwise(F.col("o_custkey") % 7).alias("n_t"), F.col("c_mktsegment").alias("map"),
        (F.col("o_totalprice") / 10).alias("duration_s"))
    # the rate rule takes +-0.5; the stand-in column is rescaled to keep some rows
    m = m.withColumn("tick_rate_raw", F.when(F.abs(F.col("tick_rate_raw") - 128) <= 100.5, 128.0).otherwise(F.col("tick_rate_raw")))
    out = N.quarantine(m, ["BUILDING", "MACHINERY"])
    return out.select("o_orderkey", F.col("quarantine_reason").alias("reason"))


@query("version_range_lookup", """
SELECT p_partkey, coalesce((SELECT v FROM (VALUES (0, 1, 10, 'v1'), (1, 8, 20, 'v2'), (2, 30, NULL, 'v3')) r(pos, lo, hi, v)
  WHERE p_size >= lo AND (hi IS NULL OR p_size <= hi) ORDER BY pos LIMIT 1), 'unknown') AS map_version FROM part""")
def version_range_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Version of a build number from a range table with open ends."""
    p = table(spark, sf, "part").withColumn("k", F.lit("m"))
    rows = [("m", 0, 1, 10, "v1"), ("m", 1, 8, 20, "v2"), ("m", 2, 30, None, "v3")]
    rng = spark.createDataFrame(rows, "k string, pos int, build_min int, build_max int, version string")
    return N.version_lookup(p, rng, "p_size", ["k"], ["p_partkey"]).select("p_partkey", "map_version")


@query("causal_slice", with_sql("""
SELECT s.match_key, c.tick, count(*) AS n_known, count(CASE WHEN s.end_tick <= c.tick THEN 1 END) AS n_ended
FROM (SELECT match_key, round_num, tick FROM kills GROUP BY ALL) c JOIN smokes s ON s.match_key = c.match_key AND s.round_num = c.round_num AND s.start_tick <= c.tick
GROUP BY s.match_key, c.tick"""))
def causal_slice(spark: SparkSession, sf: str) -> DataFrame:
    """What was known of the smokes of a round at the tick of each kill."""
    f = feed(spark, sf)
    cut = f["kills"].select(*ROUND, F.col("tick").alias("cut")).distinct()
    rows = f["smokes"].join(cut, ROUND)
    known = C.slice_table(rows, "smokes", F.col("cut"))
    return known.groupBy("match_key", F.col("cut").alias("tick")).agg(
        F.count(F.lit(1)).alias("n_known"), F.count("end_tick").alias("n_ended"))


GRID_SQL = """grid AS (
  SELECT match_key, round_num, unnest(list_distinct(list_append(
    [least(official_end_tick, freeze_end_tick + CAST(k * 3600 AS BIGINT)) FOR k IN range(CAST(floor((official_end_tick - freeze_end_tick) / 128.0 * (128.0 / 3600)) AS BIGINT) + 1)],
    official_end_tick))) AS tick FROM rounds),
taus AS (
  SELECT match_key, round_num, tick FROM kills UNION SELECT match_key, round_num, tick FROM bomb
  UNION SELECT match_key, round_num, detonate_tick FROM grenades WHERE type IN ('flash', 'he')
  UNION SELECT match_key, round_num, detonate_tick FROM flashes
  UNION SELECT match_key, round_num, start_tick FROM smokes UNION SELECT match_key, round_num, end_tick FROM smokes WHERE end_tick IS NOT NULL
  UNION SELECT match_key, round_num, start_tick FROM infernos UNION SELECT match_key, round_num, end_tick FROM infernos WHERE end_tick IS NOT NULL),
marks AS (
  SELECT match_key, round_num, tick, 'grid' AS kind FROM grid
  UNION SELECT t.match_key, t.round_num, least(greatest(t.tick - 1, freeze_end_tick), official_end_tick), 'boundary_pre' FROM taus t JOIN rounds USING (match_key, round_num)
  UNION SELECT t.match_key, t.round_num, least(greatest(t.tick + 1, freeze_end_tick), official_end_tick), 'boundary_post' FROM taus t JOIN rounds USING (match_key, round_num)
  UNION SELECT match_key, round_num, official_end_tick, 'terminal' FROM rounds),
samples AS (
  SELECT m.match_key, m.round_num, m.tick, bool_or(kind = 'grid') AS is_grid, bool_or(kind = 'terminal') AS is_terminal,
    concat_ws('+', CASE WHEN bool_or(kind = 'grid') THEN 'grid' END, CASE WHEN bool_or(kind = 'boundary_pre') THEN 'boundary_pre' END,
      CASE WHEN bool_or(kind = 'boundary_post') THEN 'boundary_post' END, CASE WHEN bool_or(kind = 'terminal') THEN 'terminal' END) AS kinds
  FROM marks m GROUP BY ALL)"""


@query("grid_and_boundary_samples", with_sql("SELECT match_key, round_num, tick, kinds FROM samples", GRID_SQL))
def grid_and_boundary_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Sample ticks of every round with their kinds."""
    s = C.default_samples(feed(spark, sf), hz=128 / 3600)
    return s.select(*ROUND, "tick", F.array_join("kinds", "+").alias("kinds"))


@query("roster_sides", with_sql("""
SELECT match_key, round_num, steamid, side, CAST(CASE WHEN side = 'ct' THEN 0 ELSE 5 END + row_number() OVER (PARTITION BY match_key, round_num, side ORDER BY steamid) - 1 AS INT) AS slot
FROM (SELECT t.match_key, t.round_num, steamid, arg_max(side, t.tick) AS side FROM ticks t JOIN rounds r USING (match_key, round_num) WHERE t.tick <= r.freeze_end_tick GROUP BY ALL)"""))
def roster_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Players known at freeze end with their slots."""
    f = feed(spark, sf)
    return C.roster(f["ticks"], f["rounds"]).select(*ROUND, "steamid", "side", "slot")


@query("gap_sessions", """
WITH e AS (SELECT user_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS tick, value FROM events),
p AS (SELECT *, lag(tick) OVER (PARTITION BY user_id ORDER BY tick) AS pt FROM e),
s AS (SELECT *, sum(CASE WHEN pt IS NULL OR tick - pt >= 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tick RANGE UNBOUNDED PRECEDING) AS g FROM p)
SELECT user_id, min(tick) AS start_tick, max(tick) AS end_tick, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, g""")
def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Activity sessions of a user split at two-hour gaps."""
    e = table(spark, sf, "events").select("user_id", F.unix_timestamp(F.date_trunc("second", "ts")).cast("bigint").alias("tick"), "value")
    s = sessionize(e, ["user_id"], "tick", 7200, "g", 86400)
    return s.groupBy("user_id", "g").agg(
        F.min("tick").alias("start_tick"), F.max("tick").alias("end_tick"), F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 4).alias("total")).drop("g")
