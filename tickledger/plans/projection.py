"""Match telemetry derived from the ``events`` table.

Ten neighbouring users form a match (five per side by parity), a day is a round, the
second of the month is the tick and ``props.k`` names the opponent.  The twelve raw tables
follow from the event types, so every operator can run on data that grows with
``events``.  ``SQL`` holds the same derivation for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feed import Feed
from ..operators.scan import durable

WEAPONS = ["ak47", "awp", "glock", "hegrenade", "inferno", "weapon_m4a1", "Karambit", "laser"]
BOMB = ["plant_start", "plant_complete", "defuse_start", "defuse_complete", "defuse_abort", "drop", "pickup", "explode"]
NADES = ["smoke", "flash", "he", "molotov", "decoy"]
WIDTH = 8192


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    lobby = F.floor(F.col("user_id") / 10).cast("bigint")
    tick = (F.dayofmonth("ts") - 1) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return e.select(
        F.concat(F.lit("L"), F.lpad(lobby.cast("string"), 6, "0")).alias("match_key"),
        F.dayofmonth("ts").alias("round_num"),
        tick.cast("bigint").alias("tick"),
        F.col("user_id").alias("sid"),
        F.when(F.col("user_id") % 2 == 0, "ct").otherwise("t").alias("side"),
        (lobby * 10 + (k % 5) * 2 + (1 - F.col("user_id") % 2)).alias("opp"),
        "event_id",
        "event_type",
        "value",
        k.alias("k"),
        lobby.alias("lobby"),
    )


def pick(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))


def rounds(ev: DataFrame) -> DataFrame:
    last = F.struct("tick", "event_id")
    kill = F.col("event_type") == "purchase"
    return ev.groupBy("match_key", "round_num").agg(
        F.min("tick").alias("start_tick"),
        F.least(F.min("tick") + 20000, F.max("tick")).alias("freeze_end_tick"),
        F.max("tick").alias("end_tick"),
        (F.max("tick") + 320).alias("official_end_tick"),
        F.max_by("side", F.when(kill, last)).alias("winner_side"),
        F.max_by("event_type", last).alias("end_reason"),
    )


def feed(spark: SparkSession, sf_dir: str) -> Feed:
    """All raw tables of the derived matches; the events are parsed once."""
    ev = durable(events(spark, sf_dir))
    of = lambda *t: ev.where(F.col("event_type").isin(*t))
    x, y, z = F.col("value") * 20, (F.col("k") * 30).cast("double"), ((F.col("k") % 3) * 64).cast("double")
    base = ["match_key", "round_num", "tick"]
    row = F.max_by(F.struct("side", "value", "k", "opp", "event_type"), "event_id").alias("r")
    t = ev.groupBy(*base, F.col("sid").alias("steamid")).agg(row)
    r = F.col("r")
    k = r["k"]
    alive = k % 10 != 0
    inventory = F.when(k % 11 == 0, F.lit(None)).otherwise(
        F.array(pick(WEAPONS, k), F.lit("flashbang"), pick(["smokegrenade", "molotov", "decoy"], k)))
    ticks = t.select(
        *base, "steamid", r["side"].alias("side"),
        (r["value"] * 20).alias("x"), (k * 30).cast("double").alias("y"), ((k % 3) * 64).cast("double").alias("z"),
        (k * 3.6).alias("yaw"), F.lit(0.0).alias("pitch"),
        (k % 50).cast("double").alias("vx"), (k % 7).cast("double").alias("vy"),
        F.when(alive, 100 - k % 60).otherwise(0).alias("health"), (k % 101).alias("armor"),
        (k % 2 == 0).alias("has_helmet"), (k % 4 == 0).alias("has_defuser"), (k % 6 == 0).alias("has_c4"),
        alive.alias("is_alive"), pick(WEAPONS, k).alias("active_weapon"), inventory.alias("inventory"),
        F.when(k % 13 == 0, F.lit(None)).otherwise((k * 100).cast("int")).alias("money"),
        F.when(k % 17 == 0, F.lit(None)).otherwise((k * 60).cast("int")).alias("equipment_value"),
        (k % 7 == 0).alias("is_ducking"), F.array(r["opp"]).alias("spotted_by"),
        (r["event_type"] == "signup").alias("is_defusing"))
    kills = of("purchase").select(
        *base, F.col("sid").alias("attacker_steamid"), F.col("opp").alias("victim_steamid"),
        pick(WEAPONS, F.col("k")).alias("weapon"), (F.col("k") % 2 == 0).alias("headshot"),
        F.when(F.col("k") % 9 == 0, F.lit(None)).otherwise(F.lit(False)).alias("team_kill"), "event_id")
    damages = of("click").select(
        *base, F.col("sid").alias("attacker_steamid"), F.col("opp").alias("victim_steamid"),
        pick(WEAPONS, F.col("k")).alias("weapon"), F.round("value").cast("bigint").alias("dmg_health"),
        (F.col("k") % 5).alias("dmg_armor"), "event_id")
    area = [F.col("event_id").alias("entity_id"), F.col("tick").alias("start_tick")]
    end = F.when(F.col("k") % 10 != 9, F.col("tick") + F.ceil(F.col("value") * 20)).alias("end_tick")
    pos = [x.alias("x"), y.alias("y"), z.alias("z")]
    smokes = of("view").where(F.col("k") % 2 == 0).select(
        *base[:2], *area, end, *pos, F.col("sid").alias("thrower_steamid"))
    infernos = of("view").where(F.col("k") % 2 == 1).select(
        *base[:2], *area, end, *pos,
        F.when(F.col("k") % 3 != 0, (F.col("k") * 5).cast("double")).alias("extent_radius"),
        F.col("sid").alias("thrower_steamid"))
    grenades = of("view", "error").select(
        *base[:2], F.col("event_id").alias("entity_id"), F.col("sid").alias("thrower_steamid"),
        F.when(F.col("event_type") == "view", F.when(F.col("k") % 2 == 0, "smoke").otherwise("molotov"))
        .otherwise(pick(["flash", "he", "decoy"], F.col("k"))).alias("type"),
        (F.col("tick") - 20).alias("throw_tick"), F.col("tick").alias("detonate_tick"),
        F.when(F.col("k") % 4 != 0, F.col("tick") + F.col("k") * 10).alias("expire_tick"), *pos)
    flashes = of("error").where(F.col("k") % 3 == 0).select(
        *base[:2], F.col("event_id").alias("entity_id"), F.col("tick").alias("detonate_tick"),
        F.col("opp").alias("player_steamid"), (F.col("value") / 10).alias("blind_duration"))
    bomb = of("signup").select(
        *base, pick(BOMB, F.col("k")).alias("event"), F.col("sid").alias("steamid"),
        pick(["A", "BombsiteB", "mid"], F.col("k")).alias("site"), F.lit(None).cast("boolean").alias("has_kit"),
        *pos, "event_id")
    fire = of("click", "purchase").select(
        *base, F.col("sid").alias("steamid"), pick(WEAPONS, F.col("k")).alias("weapon"))
    steps = of("signup").select(*base, F.col("sid").alias("steamid"), *pos)
    items = of("error", "signup").select(
        *base, F.col("sid").alias("steamid"),
        F.when(F.col("event_type") == "error", "drop").otherwise("pickup").alias("event"),
        pick(["ak47", "m4a1"], F.col("k")).alias("item"), "event_id")
    tables = {
        "rounds": rounds(ev), "ticks": ticks, "kills": kills, "damages": damages, "grenades": grenades,
        "smokes": smokes, "infernos": infernos, "flashes": flashes, "bomb": bomb, "weapon_fire": fire,
        "footsteps": steps, "items": items,
    }
    return Feed(tables, tick_rate=128, width=WIDTH)


def _sql_pick(names: list[str], i: str) -> str:
    return "list_extract([" + ", ".join(f"'{n}'" for n in names) + f"], CAST({i} % {len(names)} AS INT) + 1)"


_POS = "value * 20 AS x, CAST(k * 30 AS DOUBLE) AS y, CAST((k % 3) * 64 AS DOUBLE) AS z"
SQL = f"""ev AS (
  SELECT 'L' || lpad(CAST(user_id // 10 AS VARCHAR), 6, '0') AS match_key, CAST(day(ts) AS INT) AS round_num,
    CAST((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS tick, user_id AS sid,
    CASE WHEN user_id % 2 = 0 THEN 'ct' ELSE 't' END AS side,
    (user_id // 10) * 10 + (CAST(props->>'$.k' AS BIGINT) % 5) * 2 + (1 - user_id % 2) AS opp,
    event_id, event_type, value, CAST(props->>'$.k' AS BIGINT) AS k, user_id // 10 AS lobby
  FROM events),
rounds AS (
  SELECT match_key, round_num, min(tick) AS start_tick, least(min(tick) + 20000, max(tick)) AS freeze_end_tick, max(tick) AS end_tick,
    max(tick) + 320 AS official_end_tick,
    arg_max(side, tick * 10000000000 + event_id) FILTER (WHERE event_type = 'purchase') AS winner_side,
    arg_max(event_type, tick * 10000000000 + event_id) AS end_reason
  FROM ev GROUP BY ALL),
t0 AS (SELECT match_key, round_num, tick, sid AS steamid, max(event_id) AS event_id FROM ev GROUP BY ALL),
ticks AS (
  SELECT t0.match_key, t0.round_num, t0.tick, t0.steamid, ev.side, {_POS}, k * 3.6 AS yaw, 0.0 AS pitch,
    CAST(k % 50 AS DOUBLE) AS vx, CAST(k % 7 AS DOUBLE) AS vy,
    CASE WHEN k % 10 <> 0 THEN 100 - k % 60 ELSE 0 END AS health, k % 101 AS armor, k % 2 = 0 AS has_helmet,
    k % 4 = 0 AS has_defuser, k % 6 = 0 AS has_c4, k % 10 <> 0 AS is_alive,
    {_sql_pick(WEAPONS, 'k')} AS active_weapon,
    CASE WHEN k % 11 <> 0 THEN [{_sql_pick(WEAPONS, 'k')}, 'flashbang', {_sql_pick(["smokegrenade", "molotov", "decoy"], 'k')}] END AS inventory,
    CASE WHEN k % 13 <> 0 THEN k * 100 END AS money, CASE WHEN k % 17 <> 0 THEN k * 60 END AS equipment_value,
    k % 7 = 0 AS is_ducking, [opp] AS spotted_by, event_type = 'signup' AS is_defusing
  FROM t0 JOIN ev USING (event_id)),
kills AS (
  SELECT match_key, round_num, tick, sid AS attacker_steamid, opp AS victim_steamid, {_sql_pick(WEAPONS, 'k')} AS weapon,
    CASE WHEN k % 9 <> 0 THEN FALSE END AS team_kill, event_id FROM ev WHERE event_type = 'purchase'),
damages AS (
  SELECT match_key, round_num, tick, sid AS attacker_steamid, opp AS victim_steamid, {_sql_pick(WEAPONS, 'k')} AS weapon,
    CAST(round(value) AS BIGINT) AS dmg_health, k % 5 AS dmg_armor, event_id FROM ev WHERE event_type = 'click'),
smokes AS (
  SELECT match_key, round_num, event_id AS entity_id, tick AS start_tick,
    CASE WHEN k % 10 <> 9 THEN tick + CAST(ceil(value * 20) AS BIGINT) END AS end_tick, {_POS}, sid AS thrower_steamid
  FROM ev WHERE event_type = 'view' AND k % 2 = 0),
infernos AS (
  SELECT match_key, round_num, event_id AS entity_id, tick AS start_tick,
    CASE WHEN k % 10 <> 9 THEN tick + CAST(ceil(value * 20) AS BIGINT) END AS end_tick, {_POS},
    CASE WHEN k % 3 <> 0 THEN CAST(k * 5 AS DOUBLE) END AS extent_radius, sid AS thrower_steamid
  FROM ev WHERE event_type = 'view' AND k % 2 = 1),
grenades AS (
  SELECT match_key, round_num, event_id AS entity_id, sid AS thrower_steamid,
    CASE WHEN event_type = 'view' THEN CASE WHEN k % 2 = 0 THEN 'smoke' ELSE 'molotov' END
      ELSE {_sql_pick(["flash", "he", "decoy"], 'k')} END AS type,
    tick - 20 AS throw_tick, tick AS detonate_tick, CASE WHEN k % 4 <> 0 THEN tick + k * 10 END AS expire_tick, {_POS}
  FROM ev WHERE event_type IN ('view', 'error')),
flashes AS (
  SELECT match_key, round_num, event_id AS entity_id, tick AS detonate_tick, opp AS player_steamid,
    value / 10 AS blind_duration FROM ev WHERE event_type = 'error' AND k % 3 = 0),
bomb AS (
  SELECT match_key, round_num, tick, {_sql_pick(BOMB, 'k')} AS event, sid AS steamid,
    {_sql_pick(["A", "BombsiteB", "mid"], 'k')} AS site, {_POS}, event_id FROM ev WHERE event_type = 'signup'),
weapon_fire AS (
  SELECT match_key, round_num, tick, sid AS steamid, {_sql_pick(WEAPONS, 'k')} AS weapon
  FROM ev WHERE event_type IN ('click', 'purchase')),
footsteps AS (SELECT match_key, round_num, tick, sid AS steamid, {_POS} FROM ev WHERE event_type = 'signup'),
items AS (
  SELECT match_key, round_num, tick, sid AS steamid, CASE WHEN event_type = 'error' THEN 'drop' ELSE 'pickup' END AS event,
    {_sql_pick(["ak47", "m4a1"], 'k')} AS item, event_id FROM ev WHERE event_type IN ('error', 'signup'))"""


def with_sql(body: str, extra: str = "") -> str:
    """A check query over the derived tables."""
    return f"WITH {SQL}{', ' + extra if extra else ''} {body}"
