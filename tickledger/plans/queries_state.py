"""Queries for point-in-time state, labels, movement spans and attribution arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution as T
from ..operators import dataset as P
from ..operators import movement as M
from ..operators import sampling as C
from ..operators import state as D
from ..operators import windows as W
from ..operators.scan import durable, range_join
from .projection import WIDTH, events, feed, with_sql
from .queries_actions import _instants
from .registry import query

ROUND = ["match_key", "round_num"]
ROSTER = """ros AS (SELECT t.match_key, t.round_num, steamid, arg_max(side, t.tick) AS side FROM ticks t JOIN rounds r USING (match_key, round_num) WHERE t.tick <= r.freeze_end_tick GROUP BY ALL),
smp AS (SELECT DISTINCT match_key, round_num, tick FROM kills)"""


def _samples(spark: SparkSession, sf: str):
    """Feed, roster and samples at the ticks of the kills."""
    f = feed(spark, sf)
    f = f.with_tables(ticks=durable(f["ticks"]))  # read by every step
    r = durable(C.with_terminal(f["rounds"]))
    return f, r, durable(C.roster(f["ticks"], r)), durable(f["kills"].select(*ROUND, "tick").distinct())


@query("state_features_pit", with_sql("""
, p AS (SELECT s.match_key, s.round_num, s.tick, r.steamid, r.side FROM smp s JOIN ros r USING (match_key, round_num)),
k AS (SELECT p.match_key, p.round_num, p.tick, p.steamid, count(x.tick) AS kills FROM p LEFT JOIN kills x ON x.match_key = p.match_key AND x.round_num = p.round_num AND x.attacker_steamid = p.steamid AND x.tick <= p.tick AND x.team_kill = FALSE GROUP BY ALL),
d AS (SELECT p.match_key, p.round_num, p.tick, p.steamid, coalesce(sum(x.dmg_health), 0) AS dmg FROM p LEFT JOIN (SELECT dd.* FROM damages dd JOIN ros a ON a.match_key = dd.match_key AND a.round_num = dd.round_num AND a.steamid = dd.attacker_steamid
  JOIN ros b ON b.match_key = dd.match_key AND b.round_num = dd.round_num AND b.steamid = dd.victim_steamid WHERE a.side <> b.side) x ON x.match_key = p.match_key AND x.round_num = p.round_num AND x.attacker_steamid = p.steamid AND x.tick <= p.tick GROUP BY ALL),
f AS (SELECT p.match_key, p.round_num, p.tick, p.steamid, max(x.tick) AS fire FROM p LEFT JOIN weapon_fire x ON x.match_key = p.match_key AND x.round_num = p.round_num AND x.steamid = p.steamid AND x.tick <= p.tick GROUP BY ALL),
b AS (SELECT p.match_key, p.round_num, p.tick, p.steamid, max(x.detonate_tick + x.blind_duration * 128) AS until FROM p LEFT JOIN flashes x ON x.match_key = p.match_key AND x.round_num = p.round_num AND x.player_steamid = p.steamid AND x.detonate_tick <= p.tick GROUP BY ALL)
SELECT p.match_key, p.tick, p.steamid, t.is_alive AS alive, CAST(kills AS BIGINT) AS kills, CAST(dmg AS BIGINT) AS damage, p.tick - fire AS since_fire, round(greatest(0, coalesce(until, p.tick) - p.tick) / 128.0, 4) AS blind_left
FROM p ASOF LEFT JOIN ticks t ON t.match_key = p.match_key AND t.round_num = p.round_num AND t.steamid = p.steamid AND t.tick <= p.tick
JOIN k ON k.match_key = p.match_key AND k.tick = p.tick AND k.steamid = p.steamid JOIN d ON d.match_key = p.match_key AND d.tick = p.tick AND d.steamid = p.steamid
JOIN f ON f.match_key = p.match_key AND f.tick = p.tick AND f.steamid = p.steamid JOIN b ON b.match_key = p.match_key AND b.tick = p.tick AND b.steamid = p.steamid
""", ROSTER).replace("FROM kills) \n, p", "FROM kills), p"))
def state_features_pit(spark: SparkSession, sf: str) -> DataFrame:
    """What was known of each player at the tick of each kill of the round."""
    f, r, players, smp = _samples(spark, sf)
    t = D.track(f, smp, r, players)
    blind = F.greatest(F.lit(0.0), F.coalesce(F.col("blind"), F.col("tick").cast("double")) - F.col("tick")) / 128.0
    return t.select("match_key", "tick", "steamid", F.col("row.alive").alias("alive"), F.coalesce("kills", F.lit(0.0)).cast("bigint").alias("kills"), F.coalesce("damage", F.lit(0.0)).cast("bigint").alias("damage"),
                    (F.col("tick") - F.col("fire")).alias("since_fire"), F.round(blind, 4).alias("blind_left"))


@query("active_utility", with_sql("""
, a AS (SELECT match_key, round_num, start_tick AS s, end_tick AS e, 'smoke' AS kind FROM smokes UNION ALL SELECT match_key, round_num, start_tick, end_tick, 'fire' FROM infernos
  UNION ALL SELECT match_key, round_num, detonate_tick, coalesce(expire_tick, detonate_tick + 1920), 'decoy' FROM grenades WHERE type = 'decoy'),
j AS (SELECT m.match_key, m.tick, a.kind FROM smp m JOIN a ON a.match_key = m.match_key AND a.round_num = m.round_num AND a.s <= m.tick AND NOT (a.e IS NOT NULL AND a.e <= m.tick))
SELECT match_key, tick, count(*) FILTER (WHERE kind = 'smoke') AS n_active_smokes, count(*) FILTER (WHERE kind = 'fire') AS n_active_fires, least(16, count(*)) AS n_tokens FROM j GROUP BY ALL
""", ROSTER).replace("FROM kills) \n, a", "FROM kills), a"))
def active_utility(spark: SparkSession, sf: str) -> DataFrame:
    """Active smokes and fires at the tick of each kill, and the tokens kept."""
    f, r, players, smp = _samples(spark, sf)
    u = D.utility_tokens(f, smp, r, players)
    return u.select("match_key", "tick", "n_active_smokes", "n_active_fires", F.size("utility").cast("bigint").alias("n_tokens"))


@query("future_labels", with_sql("""
, e AS (SELECT match_key, round_num, tick FROM kills UNION SELECT match_key, round_num, tick FROM damages),
p AS (SELECT match_key, round_num, min(tick) AS pt FROM bomb WHERE event = 'plant_complete' GROUP BY ALL)
SELECT s.match_key, s.tick, round(least(30.0, coalesce((e.tick - s.tick) / 128.0, 30.0)), 6) AS tte, CASE WHEN p.pt IS NULL THEN 0 WHEN p.pt < s.tick THEN NULL ELSE CAST(p.pt < s.tick + 1920 AS INT) END AS plant15, CASE r.winner_side WHEN 'ct' THEN 1 WHEN 't' THEN 0 END AS won
FROM (SELECT DISTINCT match_key, round_num, tick FROM bomb) s ASOF LEFT JOIN e ON e.match_key = s.match_key AND e.round_num = s.round_num AND e.tick >= s.tick
LEFT JOIN p ON p.match_key = s.match_key AND p.round_num = s.round_num JOIN rounds r ON r.match_key = s.match_key AND r.round_num = s.round_num
""", "zz AS (SELECT 1)").replace("(SELECT 1) \n, e", "(SELECT 1), e"))
def future_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome labels at the ticks of the bomb events."""
    f, r, players, _ = _samples(spark, sf)
    smp = f["bomb"].select(*ROUND, "tick").distinct().withColumn("kinds", F.array(F.lit("grid")))
    slots = smp.select(*ROUND, "tick").join(players.select(*ROUND, "slot", "steamid"), ROUND)
    lab = D.attach_labels(f, D.States(smp, slots, None, None, None))
    return lab.select("match_key", "tick", F.round("y_time_to_next_engagement_s", 6).alias("tte"), F.col("y_plant_within_15s").alias("plant15"), F.col("y_round_won_ct").alias("won"))


@query("past_round_context", with_sql("""
, h AS (SELECT *, CASE WHEN round_num <= 12 THEN 1 WHEN round_num <= 24 THEN 2 ELSE 3 + (round_num - 25) // 3 END AS half FROM rounds),
j AS (SELECT a.match_key, a.round_num, a.half AS ah, b.round_num AS br, b.half AS bh, CASE WHEN b.end_tick + CASE WHEN b.round_num % 3 = 0 THEN 100000 ELSE 0 END <= a.start_tick THEN b.winner_side END AS w FROM h a JOIN h b ON a.match_key = b.match_key AND b.round_num < a.round_num)
SELECT h.match_key, h.round_num, count(w) FILTER (WHERE (w = 'ct') <> ((bh - ah) % 2 <> 0)) AS past_ct, count(w) FILTER (WHERE (w = 'ct') = ((bh - ah) % 2 <> 0)) AS past_t,
  CAST(count(*) FILTER (WHERE bh = ah AND br > coalesce(stop_ct, 0)) AS BIGINT) AS loss_streak_ct
FROM h LEFT JOIN (SELECT *, max(CASE WHEN bh = ah AND coalesce(w, 'ct') = 'ct' THEN br END) OVER (PARTITION BY match_key, round_num) AS stop_ct FROM j) j ON j.match_key = h.match_key AND j.round_num = h.round_num GROUP BY h.match_key, h.round_num
""", "zz AS (SELECT 1)").replace("(SELECT 1) \n, h", "(SELECT 1), h"))
def past_round_context(spark: SparkSession, sf: str) -> DataFrame:
    """Score and loss streak entering each round, with side swaps; every third round overruns the start of the next, whose context must not know its winner."""
    f = feed(spark, sf)
    r = f["rounds"].withColumn("end_tick", F.col("end_tick") + F.when(F.col("round_num") % 3 == 0, 100000).otherwise(0))
    return D.past_rounds(r).select(*ROUND, "past_ct", "past_t", "loss_streak_ct")


@query("rolling_window_lists", with_sql("""
SELECT a.match_key, a.tick, count(*) AS n, min(b.tick) AS first_tick, round(sum(b.v), 4) AS total FROM x a JOIN x b ON a.match_key = b.match_key AND a.round_num = b.round_num AND b.tick BETWEEN a.tick - 1280 AND a.tick GROUP BY ALL""",
    "x AS (SELECT match_key, round_num, tick, max(value) AS v FROM ev GROUP BY ALL)"))
def rolling_window_lists(spark: SparkSession, sf: str) -> DataFrame:
    """History of each state within ten seconds."""
    x = events(spark, sf).groupBy(*ROUND, "tick").agg(F.max("value").alias("v"))
    w = P.temporal_windows(x, 1280, "v")
    total = F.aggregate("window", F.lit(0.0), lambda a, e: a + e["value"])
    return w.select("match_key", "tick", F.size("window").cast("bigint").alias("n"), F.element_at("window", 1)["tick"].alias("first_tick"), F.round(total, 4).alias("total"))


@query("recent_deaths_join", with_sql("""
SELECT e.event_id, d.event_id AS death_id FROM kills e JOIN kills d ON d.match_key = e.match_key AND d.round_num = e.round_num AND d.tick BETWEEN e.tick - 6400 AND e.tick - 1 AND d.victim_steamid <> e.attacker_steamid AND d.victim_steamid % 2 = e.attacker_steamid % 2"""))
def recent_deaths_join(spark: SparkSession, sf: str) -> DataFrame:
    """Kills with the teammates that died shortly before (the join under trade setups)."""
    k = feed(spark, sf)["kills"]
    e = k.select(*ROUND, "event_id", "attacker_steamid", (F.col("attacker_steamid") % 2).alias("team"), (F.col("tick") - 6400).alias("_lo"), (F.col("tick") - 1).alias("_hi"))
    d = k.select(*ROUND, (F.col("victim_steamid") % 2).alias("team"), "victim_steamid", F.col("event_id").alias("death_id"), "tick")
    hit = range_join(e, d, [*ROUND, "team"], "_lo", "_hi", "tick", 6400)
    return hit.where("victim_steamid <> attacker_steamid").select("event_id", "death_id")


STAY = """x AS (SELECT match_key, round_num, sid, tick, k % 3 AS place, value AS speed FROM ev QUALIFY row_number() OVER (PARTITION BY match_key, round_num, sid, tick ORDER BY event_id) = 1),
l AS (SELECT *, lag(place) OVER w AS pp, lag(tick) OVER w AS pt, lag(speed < 60) OVER w AS pok FROM x WINDOW w AS (PARTITION BY match_key, round_num, sid ORDER BY tick)),
st AS (SELECT *, max(CASE WHEN pt IS NULL OR place <> pp THEN tick END) OVER (PARTITION BY match_key, round_num, sid ORDER BY tick) AS stay, max(CASE WHEN pt IS NULL OR place <> pp OR (speed < 60) <> pok THEN tick END) OVER (PARTITION BY match_key, round_num, sid ORDER BY tick) AS run FROM l)"""


def _places(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).groupBy(*ROUND, "sid", "tick").agg(F.min_by(F.struct("k", "value"), "event_id").alias("_r"))
    return e.select(*ROUND, "sid", "tick", (F.col("_r.k") % 3).alias("place"), F.col("_r.value").alias("speed"))


@query("stays", with_sql("SELECT match_key, sid, stay AS first_tick, max(tick) AS last_tick, any_value(place) AS place FROM st GROUP BY match_key, round_num, sid, stay", STAY))
def stays(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one place per player."""
    return M.stays(_places(spark, sf), [*ROUND, "sid"], "place", WIDTH).select("match_key", "sid", "first_tick", "last_tick", "place")


@query("rotations", with_sql("""
, s AS (SELECT match_key, round_num, sid, stay AS a, max(tick) AS z, any_value(place) AS place FROM st GROUP BY match_key, round_num, sid, stay),
o AS (SELECT *, row_number() OVER (PARTITION BY match_key, round_num, sid ORDER BY a) AS rn FROM s), t AS (SELECT * FROM o WHERE rn = 1 OR z - a >= 2000),
q AS (SELECT *, lag(place) OVER w AS fp, lag(z) OVER w AS ft FROM t WINDOW w AS (PARTITION BY match_key, round_num, sid ORDER BY a))
SELECT match_key, sid, fp AS from_place, place AS to_place, ft AS from_tick, a AS to_tick FROM q WHERE rn > 1 AND fp IS NOT NULL AND fp <> place
""", STAY).replace("FROM l) \n, s", "FROM l), s"))
def rotations(spark: SparkSession, sf: str) -> DataFrame:
    """Moves between settled stays."""
    key = [*ROUND, "sid"]
    r = M.rotation_spans(M.stays(_places(spark, sf), key, "place", WIDTH), key, "place", 2000, WIDTH)
    return r.select("match_key", "sid", "from_place", F.col("place").alias("to_place"), "from_tick", F.col("first_tick").alias("to_tick"))


@query("holds", with_sql("SELECT match_key, sid, run AS first_tick, max(tick) AS last_tick, any_value(place) AS place FROM st WHERE speed < 60 GROUP BY match_key, round_num, sid, run HAVING max(tick) - run >= 2000", STAY))
def holds(spark: SparkSession, sf: str) -> DataFrame:
    """Slow runs in one place that last."""
    return M.hold_runs(_places(spark, sf), [*ROUND, "sid"], "place", "speed", 60.0, 2000, WIDTH).select("match_key", "sid", "first_tick", "last_tick", "place")


@query("retreat_spans")
def retreat_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans over which a player's value grows by 60 within 30,000 ticks without a purchase."""
    e = events(spark, sf)
    rows = durable(_places(spark, sf).withColumn("ref", F.lit("x")))
    shots = e.where("event_type = 'purchase'").select(*ROUND, "sid", F.col("tick").alias("shot"))
    return M.retreat_spans(rows, [*ROUND, "sid"], "speed", "ref", 30000, 60.0, shots, WIDTH).select("match_key", "sid", "start_tick", "end_tick")


PART = """inst AS (SELECT match_key, round_num, tick FROM kills GROUP BY ALL), sp AS (SELECT *, lag(tick) OVER (PARTITION BY match_key, round_num ORDER BY tick) AS pt FROM inst),
sc AS (SELECT *, sum(CASE WHEN pt IS NULL OR tick - pt > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY match_key, round_num ORDER BY tick) AS w FROM sp), win AS (SELECT match_key, round_num, w, min(tick) - 1 AS s, max(tick) + 1 AS e FROM sc GROUP BY ALL),
t AS (SELECT match_key, round_num, tick FROM ev UNION SELECT match_key, round_num, s FROM win UNION SELECT match_key, round_num, e FROM win),
bp AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.match_key = t.match_key AND win.round_num = t.round_num AND t.tick > win.s AND t.tick < win.e)),
iv AS (SELECT match_key, round_num, lag(tick) OVER (PARTITION BY match_key, round_num ORDER BY tick) AS a, tick AS b FROM bp)"""


@query("partition_telescoping", with_sql("""
SELECT i.match_key, i.round_num, count(*) AS n_intervals, count(win.w) AS n_events, round(sum((i.b * 37 % 101) / 101.0 - (i.a * 37 % 101) / 101.0), 6) AS sum_dw, 0.0::DOUBLE AS residual
FROM iv i LEFT JOIN win ON win.match_key = i.match_key AND win.round_num = i.round_num AND win.s = i.a AND win.e = i.b WHERE i.a IS NOT NULL GROUP BY ALL""", PART))
def partition_telescoping(spark: SparkSession, sf: str) -> DataFrame:
    """Event and drift intervals of a round whose changes add up to its whole change."""
    ev = events(spark, sf)
    inst = ev.where("event_type = 'purchase'").groupBy(*ROUND, "tick").agg(F.min("event_id").cast("string").alias("action_id"))
    inst = inst.withColumns({"kind": F.lit("instant"), "state_post_tick": F.lit(None).cast("bigint")})
    w = durable(W.group(inst, None, WIDTH))
    t = ev.select(*ROUND, "tick").unionByName(w.select(*ROUND, F.col("start_tick").alias("tick"))).unionByName(w.select(*ROUND, F.col("end_tick").alias("tick"))).distinct()
    t = durable(t)
    iv = T.intervals(t, T.window_spans(t, w, WIDTH), WIDTH)
    iv = T.deltas(iv, t.withColumn("W", (F.col("tick") * 37 % 101) / 101.0))
    tele = T.telescoping(iv).join(iv.groupBy(*ROUND).agg(F.count("window_id").alias("n_events")), ROUND)
    return tele.select(*ROUND, "n_intervals", "n_events", F.round("sum_dw", 6).alias("sum_dw"), F.abs(F.round("residual", 6)).alias("residual"))


@query("enabler_split", with_sql("""
, e AS (SELECT event_id // 4 AS ev_id, event_id % 4 AS idx, list_extract(['flash', 'smoke_cover', 'trade_setup', 'he_damage', 'info'], CAST(k % 5 AS INT) + 1) AS kind, (max(k) OVER (PARTITION BY event_id // 4)) / 200.0 AS q_pre, CASE WHEN k % 7 <> 0 THEN value / 300.0 END AS q_rm FROM ev),
r AS (SELECT *, CASE WHEN kind = 'trade_setup' THEN 0.05 ELSE 0.0 END AS lo, CASE WHEN kind = 'trade_setup' THEN 0.4 ELSE 0.6 END AS hi FROM e),
s AS (SELECT *, CASE WHEN kind = 'info' OR q_pre < 0.02 OR q_rm IS NULL THEN lo ELSE least(greatest(greatest(0, q_pre - q_rm) / q_pre, lo), hi) END AS sh FROM r), t AS (SELECT *, sum(sh) OVER (PARTITION BY ev_id) AS tot FROM s)
SELECT ev_id AS event_id, idx, kind, round(CASE WHEN tot > 0.5 THEN sh * 0.5 / tot ELSE sh END, 6) AS share, tot > 0.5 AS capped FROM t
""", "zz AS (SELECT 1)").replace("(SELECT 1) \n, e", "(SELECT 1), e"))
def enabler_split(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of the enablers of an event: relative drop, band, total cap."""
    from pyspark.sql import Window

    e = events(spark, sf)
    k = F.col("k")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("flash", "smoke_cover", "trade_setup", "he_damage", "info")]), (k % 5 + 1).cast("int"))
    g = F.floor(F.col("event_id") / 4).cast("bigint")
    e = e.select(g.alias("event_id"), (F.col("event_id") % 4).alias("idx"), kind.alias("kind"), (F.max("k").over(Window.partitionBy(g)) / 200.0).alias("q_pre"), F.when(k % 7 != 0, F.col("value") / 300.0).alias("q_removed"))
    s = T.enabler_split(e)
    return s.select("event_id", "idx", "kind", F.round("share", 6).alias("share"), "capped")


@query("clock_conservation", with_sql("""
SELECT match_key, round_num, round(sum(greatest(c, 0)), 6) AS clock_ct, round(sum(greatest(-c, 0)), 6) AS clock_t, round(sum(CASE WHEN event_type = 'view' THEN c ELSE 0 END), 6) AS from_view FROM (SELECT *, (k - 50) / 100.0 AS c FROM ev) GROUP BY ALL"""))
def clock_conservation(spark: SparkSession, sf: str) -> DataFrame:
    """Clock of each round by sign and by source."""
    c = events(spark, sf).select(*ROUND, ((F.col("k") - 50) / 100.0).alias("clock"), F.col("event_type").alias("source"))
    b = T.clock_buckets(c)
    v = T.clock_by_source(c).where("source = 'view'").select(*ROUND, F.col("clock").alias("v"))
    return b.join(v, ROUND, "left").select(*ROUND, F.round("clock_ct", 6).alias("clock_ct"), F.round("clock_t", 6).alias("clock_t"), F.round(F.coalesce("v", F.lit(0.0)), 6).alias("from_view"))
