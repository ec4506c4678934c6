"""Queries for actions and windows over the derived matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actions as A
from ..operators import windows as W
from ..operators.scan import durable
from .projection import WIDTH, feed, with_sql
from .registry import query

ROUND = ["match_key", "round_num"]

WEAPON_CLASS = """CASE {w} WHEN 'ak47' THEN 'rifle' WHEN 'awp' THEN 'sniper' WHEN 'glock' THEN 'pistol' WHEN 'hegrenade' THEN 'grenade'
  WHEN 'inferno' THEN 'grenade' WHEN 'weapon_m4a1' THEN 'rifle' WHEN 'Karambit' THEN 'knife' ELSE 'unknown' END"""
ENGAGE_SQL = f"""hits AS (
  SELECT d.* FROM damages d WHERE attacker_steamid <> victim_steamid AND NOT EXISTS (SELECT 1 FROM kills k WHERE k.match_key = d.match_key
    AND k.round_num = d.round_num AND k.tick = d.tick AND k.attacker_steamid = d.attacker_steamid AND k.victim_steamid = d.victim_steamid)),
hp AS (SELECT *, {WEAPON_CLASS.format(w='weapon')} AS cls, lag(tick) OVER (PARTITION BY match_key, round_num, attacker_steamid, victim_steamid ORDER BY tick, event_id) AS pt FROM hits),
hs AS (SELECT *, sum(CASE WHEN pt IS NULL OR tick - pt >= 40000 THEN 1 ELSE 0 END) OVER (PARTITION BY match_key, round_num, attacker_steamid, victim_steamid ORDER BY tick RANGE UNBOUNDED PRECEDING) AS g FROM hp),
eng AS (
  SELECT match_key, round_num, attacker_steamid, victim_steamid, g, CAST(min(tick) AS BIGINT) AS tick, max(tick) AS last_tick, CAST(sum(dmg_health) AS BIGINT) AS damage_total,
    count(*) AS hits, CAST(sum(dmg_armor) AS BIGINT) AS armor_damage FROM hs GROUP BY ALL),
ec AS (SELECT match_key, round_num, attacker_steamid, victim_steamid, g, cls, count(*) AS n, min(tick) AS f FROM hs GROUP BY ALL),
ecr AS (SELECT *, row_number() OVER (PARTITION BY match_key, round_num, attacker_steamid, victim_steamid, g ORDER BY n DESC, f) AS rn FROM ec)"""


@query("damage_engagements", with_sql("""
SELECT e.match_key, e.round_num, attacker_steamid, victim_steamid, tick, last_tick, damage_total, hits, armor_damage, cls AS weapon_class
FROM eng e JOIN ecr USING (match_key, round_num, attacker_steamid, victim_steamid, g) WHERE rn = 1""", ENGAGE_SQL))
def damage_engagements(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a player on an opponent grouped in engagements."""
    f = feed(spark, sf)
    return A.engagements(f["damages"], f["kills"], 40000, WIDTH)


@query("engagement_windows", with_sql("""
SELECT match_key, round_num, min(tick) - 1 AS start_tick, max(tick) + 1 AS end_tick, count(*) AS n_members, CAST(sum(damage_total) AS BIGINT) AS damage_total FROM (
  SELECT *, sum(CASE WHEN pt IS NULL OR tick - pt > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY match_key, round_num ORDER BY tick RANGE UNBOUNDED PRECEDING) AS w FROM (
    SELECT *, lag(tick) OVER (PARTITION BY match_key, round_num ORDER BY tick) AS pt FROM eng)) GROUP BY match_key, round_num, w""", ENGAGE_SQL))
def engagement_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Engagements whose first hits are close in time, with their totals."""
    f = feed(spark, sf)
    e = durable(A.engagements(f["damages"], f["kills"], 40000, WIDTH)).withColumns({
        "action_id": F.concat_ws(":", "attacker_steamid", "victim_steamid", "tick"), "kind": F.lit("instant"),
        "state_post_tick": F.lit(None).cast("bigint")})
    w = W.group(e, None, WIDTH, sim=600)
    m = w.withColumn("action_id", F.explode("member_action_ids")).join(e.select(*ROUND, "action_id", "damage_total"), [*ROUND, "action_id"])
    return m.groupBy(*ROUND, "start_tick", "end_tick").agg(F.count(F.lit(1)).alias("n_members"), F.sum("damage_total").alias("damage_total"))


SIM_SQL = """inst AS (SELECT match_key, round_num, tick, tick + CASE WHEN event_type = 'signup' THEN greatest(k, 1) ELSE 1 END AS span_end, event_id FROM ev),
sp AS (SELECT *, max(span_end) OVER p AS me, lag(tick) OVER (PARTITION BY match_key, round_num ORDER BY tick, event_id) AS pt FROM inst
  WINDOW p AS (PARTITION BY match_key, round_num ORDER BY tick, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sc AS (SELECT *, sum(CASE WHEN pt IS NULL OR (tick - pt > 2 AND tick - 1 > me) THEN 1 ELSE 0 END) OVER (PARTITION BY match_key, round_num ORDER BY tick, event_id) AS w FROM sp),
win AS (SELECT match_key, round_num, w, min(tick) - 1 AS start_tick, max(span_end) AS end_tick, count(*) AS n FROM sc GROUP BY ALL)"""


def _instants(spark: SparkSession, sf: str) -> DataFrame:
    from .projection import events

    ev = events(spark, sf)
    post = F.col("tick") + F.when(F.col("event_type") == "signup", F.col("k")).otherwise(1)
    return ev.select(*ROUND, "tick", F.col("event_id").cast("string").alias("action_id"), F.lit("instant").alias("kind"), post.alias("state_post_tick"))


@query("simultaneity_windows", with_sql("SELECT match_key, round_num, start_tick, end_tick, n AS n_members FROM win", SIM_SQL))
def simultaneity_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Single-linkage chains of instants and overlapping spans."""
    w = W.group(_instants(spark, sf), None, WIDTH)
    return w.select(*ROUND, "start_tick", "end_tick", F.size("member_action_ids").cast("bigint").alias("n_members"))


@query("round_coverage", with_sql("""
, edges AS (SELECT match_key, round_num, start_tick, end_tick, TRUE AS ev FROM clip UNION ALL SELECT match_key, round_num, freeze_end_tick, freeze_end_tick, FALSE FROM rounds
  UNION ALL SELECT match_key, round_num, official_end_tick, official_end_tick, FALSE FROM rounds)
SELECT match_key, round_num, 'event' AS kind, start_tick, end_tick FROM clip
UNION ALL SELECT match_key, round_num, 'drift', pe, start_tick FROM (SELECT *, max(end_tick) OVER (PARTITION BY match_key, round_num ORDER BY start_tick, ev, end_tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM edges) WHERE pe < start_tick
""", SIM_SQL.replace("FROM ev)", "FROM ev JOIN rounds r USING (match_key, round_num) WHERE tick BETWEEN r.freeze_end_tick AND r.official_end_tick)") + """,
clip AS (SELECT w.match_key, w.round_num, greatest(w.start_tick, r.freeze_end_tick) AS start_tick, least(w.end_tick, r.official_end_tick) AS end_tick
  FROM win w JOIN rounds r USING (match_key, round_num))""").replace(" \n, edges", ", edges"))
def round_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Event and drift intervals that tile each round."""
    f = feed(spark, sf)
    r = f["rounds"].withColumn("terminal", F.col("official_end_tick"))
    w = W.group(_instants(spark, sf), r, WIDTH)
    return W.coverage(w, r, WIDTH).select(*ROUND, "kind", "start_tick", "end_tick")


@query("kill_actions", with_sql(f"""
SELECT k.match_key, k.round_num, k.tick, k.event_id % 100 AS tail, k.attacker_steamid, sa.side AS actor_side, {WEAPON_CLASS.format(w='weapon')} AS weapon_class, h.health AS victim_health_before
FROM kills k JOIN sides sa ON sa.match_key = k.match_key AND sa.round_num = k.round_num AND sa.steamid = k.attacker_steamid
ASOF LEFT JOIN ticks h ON h.match_key = k.match_key AND h.round_num = k.round_num AND h.steamid = k.victim_steamid AND h.tick <= k.tick - 1
""", "sides AS (SELECT match_key, round_num, steamid, any_value(side) AS side FROM ticks GROUP BY ALL)").replace("k.event_id % 100 AS tail, ", ""))
def kill_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Kill actions with the victim's health just before."""
    c = A.Context(feed(spark, sf))
    k = A.extract_kills(c)
    who = c.sides.select(*ROUND, A.PID(F.col("steamid")).alias("actor_id_hash"), F.col("steamid").alias("attacker_steamid"))
    k = k.join(who, [*ROUND, "actor_id_hash"])
    return k.select(*ROUND, "tick", "attacker_steamid", "actor_side", F.col("p.weapon_class").alias("weapon_class"), F.col("p.victim_health_before").alias("victim_health_before"))


@query("durative_with_pseudo", with_sql("""
SELECT match_key, round_num, m.t AS type, m.k AS tick, count(*) AS n FROM (
  SELECT s.match_key, s.round_num, unnest([{'t': 'smoke', 'k': s.start_tick}, {'t': 'smoke_pop', 'k': s.start_tick},
    CASE WHEN coalesce(s.end_tick, s.start_tick + 2304) < r.official_end_tick THEN {'t': 'smoke_fade', 'k': coalesce(s.end_tick, s.start_tick + 2304)} END]) AS m
  FROM smokes s JOIN rounds r USING (match_key, round_num)) WHERE m IS NOT NULL GROUP BY ALL"""))
def durative_with_pseudo(spark: SparkSession, sf: str) -> DataFrame:
    """Smokes as durative actions with their pop and fade markers."""
    c = A.Context(feed(spark, sf))
    main = A.to_actions(A.extract_smokes(c))
    rows = main.unionByName(A.pseudo_actions(main, c.rounds))
    return rows.groupBy(*ROUND, "type", F.coalesce("tick", "window_start_tick").alias("tick")).agg(F.count(F.lit(1)).alias("n"))


@query("loadout_bands_mode", with_sql("""
, b AS (SELECT t.match_key, t.round_num, t.steamid, t.side, arg_max(CASE WHEN is_alive THEN 1 ELSE 0 END, t.tick) AS alive, arg_max_null(equipment_value, t.tick) AS eq
  FROM ticks t JOIN rounds r USING (match_key, round_num) WHERE t.tick <= r.freeze_end_tick GROUP BY ALL),
l AS (SELECT *, CASE WHEN eq IS NULL THEN NULL WHEN eq < 1000 THEN 'pistol' WHEN eq < 2000 THEN 'eco' WHEN eq < 3500 THEN 'half' WHEN eq < 4500 THEN 'force' ELSE 'full' END AS cls FROM b WHERE alive = 1),
mc AS (SELECT match_key, round_num, side, cls, count(*) AS n FROM l WHERE cls IS NOT NULL GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY match_key, round_num, side ORDER BY n DESC, CASE cls WHEN 'pistol' THEN 0 WHEN 'eco' THEN 1 WHEN 'half' THEN 2 WHEN 'force' THEN 3 ELSE 4 END DESC) AS rn FROM mc)
SELECT l.match_key, l.round_num, l.side AS actor_side, any_value(m.cls) AS team_class, CAST(CASE WHEN count(eq) = count(*) THEN sum(eq) END AS BIGINT) AS total_equip
FROM l LEFT JOIN m ON m.match_key = l.match_key AND m.round_num = l.round_num AND m.side = l.side AND m.rn = 1 GROUP BY l.match_key, l.round_num, l.side
""", "zz AS (SELECT 1)").replace("zz AS (SELECT 1) \n, b", "zz AS (SELECT 1), b"))
def loadout_bands_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Team buys: modal loadout band and total equipment per side."""
    t = A.team_buys(A.extract_buys(A.Context(feed(spark, sf))))
    return t.select(*ROUND, "actor_side", F.col("p.team_class").alias("team_class"), F.col("p.total_equip").alias("total_equip"))


@query("bomb_actions", with_sql("""
, b AS (SELECT DISTINCT match_key, round_num, tick, steamid, CASE event WHEN 'drop' THEN 'bomb_drop' WHEN 'pickup' THEN 'bomb_pickup' ELSE event END AS type FROM bomb WHERE event <> 'explode'),
sides AS (SELECT match_key, round_num, steamid, any_value(side) AS side FROM ticks GROUP BY ALL),
pr AS (SELECT DISTINCT b.match_key, b.round_num, b.tick, s.steamid, s.side FROM b JOIN sides s USING (match_key, round_num)),
al AS (SELECT p.match_key, p.round_num, p.tick, count(*) FILTER (WHERE p.side = 'ct' AND t.is_alive) AS ct_alive, count(*) FILTER (WHERE p.side = 't' AND t.is_alive) AS t_alive
  FROM pr p ASOF LEFT JOIN ticks t ON t.match_key = p.match_key AND t.round_num = p.round_num AND t.steamid = p.steamid AND t.tick <= p.tick - 1 GROUP BY ALL)
SELECT b.match_key, b.round_num, b.tick, b.steamid, b.type, CASE WHEN b.type NOT LIKE 'bomb%' THEN ct_alive END AS ct_alive, CASE WHEN b.type NOT LIKE 'bomb%' THEN t_alive END AS t_alive
FROM b JOIN al USING (match_key, round_num, tick)
""", "zz AS (SELECT 1)").replace("zz AS (SELECT 1) \n, b", "zz AS (SELECT 1), b"))
def bomb_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Bomb actions with the living players of both sides just before."""
    c = A.Context(feed(spark, sf))
    who = c.sides.select(*ROUND, A.PID(F.col("steamid")).alias("actor_id_hash"), "steamid")
    b = A.extract_bomb(c).join(who, [*ROUND, "actor_id_hash"])
    return b.select(*ROUND, "tick", "steamid", "type", F.col("p.ct_alive").alias("ct_alive"), F.col("p.t_alive").alias("t_alive"))


@query("he_victims", with_sql("""
SELECT g.match_key, g.round_num, g.entity_id, g.detonate_tick AS tick, CAST(coalesce(sum(d.dmg_health) FILTER (WHERE d.victim_steamid <> g.thrower_steamid), 0) AS BIGINT) AS damage_total
FROM grenades g LEFT JOIN damages d ON d.match_key = g.match_key AND d.round_num = g.round_num AND d.attacker_steamid = g.thrower_steamid AND d.weapon = 'hegrenade'
  AND abs(d.tick - g.detonate_tick) <= 2 WHERE g.type = 'he' GROUP BY ALL"""))
def he_victims(spark: SparkSession, sf: str) -> DataFrame:
    """HE grenades with the damage they dealt."""
    h = A.extract_he(A.Context(feed(spark, sf)))
    return h.select(*ROUND, F.col("p.entity_id").alias("entity_id"), "tick", F.col("p.damage_total").alias("damage_total"))


@query("fire_burn_damage", with_sql("""
SELECT f.match_key, f.round_num, f.entity_id, d.victim_steamid, CAST(sum(d.dmg_health) AS BIGINT) AS dmg
FROM infernos f JOIN damages d ON d.match_key = f.match_key AND d.round_num = f.round_num AND d.attacker_steamid = f.thrower_steamid AND d.weapon = 'inferno'
  AND d.tick BETWEEN f.start_tick AND coalesce(f.end_tick, f.start_tick + 896)
JOIN (SELECT DISTINCT match_key, round_num, steamid FROM ticks) s ON s.match_key = d.match_key AND s.round_num = d.round_num AND s.steamid = d.victim_steamid
GROUP BY ALL"""))
def fire_burn_damage(spark: SparkSession, sf: str) -> DataFrame:
    """Damage of a fire's owner to enemies while it burns."""
    c = A.Context(feed(spark, sf))
    f = c.feed["infernos"].withColumn("_burn_end", F.coalesce("end_tick", F.col("start_tick") + 896))
    d = A.fire_damage(c, f).withColumn("e", F.explode("enemies_damaged"))
    who = c.sides.select(*ROUND, A.PID(F.col("steamid")).alias("pid"), F.col("steamid").alias("victim_steamid"))
    d = d.withColumn("pid", F.col("e.id")).join(who, [*ROUND, "pid"])
    return d.select(*ROUND, "entity_id", "victim_steamid", F.col("e.dmg").alias("dmg"))


_HASH = "CAST(CAST('0x' || substr(sha1({0}::VARCHAR), 1, 16) AS UBIGINT) % 9223372036854775808 AS BIGINT)"


@query("greedy_give_match", with_sql(f"""SELECT match_key, round_num, dt AS tick, {_HASH.format('giver')} AS actor_id_hash, pick.p AS pickup_tick, {_HASH.format('pick.w')} AS receiver_id FROM rec JOIN dd USING (match_key, round_num, side, item, i) WHERE pick IS NOT NULL""",
    """sd AS (SELECT match_key, round_num, steamid, arg_max(side, tick) AS side FROM ticks GROUP BY ALL),
it AS (SELECT DISTINCT i.match_key, i.round_num, sd.side, i.item, i.tick, i.steamid, i.event FROM items i JOIN sd USING (match_key, round_num, steamid)),
dr AS (SELECT d.* FROM (SELECT *, tick + 1 AS nt FROM it WHERE event = 'drop') d ASOF JOIN ticks t ON t.match_key = d.match_key AND t.round_num = d.round_num AND t.steamid = d.steamid AND t.tick <= d.nt WHERE t.is_alive),
cd AS (SELECT d.match_key, d.round_num, d.side, d.item, d.tick AS dt, d.steamid AS giver, list({'p': p.tick, 'w': p.steamid} ORDER BY p.tick, p.steamid) AS ps FROM dr d JOIN it p ON p.event = 'pickup' AND p.match_key = d.match_key AND p.round_num = d.round_num AND p.side = d.side AND p.item = d.item
  AND p.tick BETWEEN d.tick + 1 AND d.tick + 640 AND p.steamid <> d.steamid GROUP BY ALL),
dd AS (SELECT *, row_number() OVER (PARTITION BY match_key, round_num, side, item ORDER BY dt, giver) AS i FROM cd),
rec AS (SELECT DISTINCT match_key, round_num, side, item, 0::BIGINT AS i, list_filter([{'p': 0::BIGINT, 'w': 0::BIGINT}], lambda x: FALSE) AS used, NULL::STRUCT(p BIGINT, w BIGINT) AS pick FROM dd
  UNION ALL SELECT match_key, round_num, side, item, i, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END, f FROM (
    SELECT d.match_key, d.round_num, d.side, d.item, d.i, r.used, list_filter(d.ps, lambda x: NOT list_contains(r.used, x))[1] AS f FROM rec r JOIN dd d ON d.match_key = r.match_key AND d.round_num = r.round_num AND d.side = r.side AND d.item = r.item AND d.i = r.i + 1))""").replace("WITH ev", "WITH RECURSIVE ev", 1))
def greedy_give_match(spark: SparkSession, sf: str) -> DataFrame:
    """Drops matched one to one to the first free pickup of a teammate."""
    d = A.extract_drops(A.Context(feed(spark, sf)))
    return d.select(*ROUND, "tick", "actor_id_hash", F.col("p.pickup_tick").alias("pickup_tick"), F.col("p.receiver_id").alias("receiver_id"))
