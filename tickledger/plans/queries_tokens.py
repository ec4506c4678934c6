"""Queries for whole state rows: all fields of the player tokens and of the context at the tick of each kill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .. import settings as S
from ..operators import state as D
from ..operators.scan import durable
from .projection import with_sql
from .queries_state import ROSTER, ROUND, _samples
from .registry import query

_KEY = "{0}.match_key = {1}.match_key AND {0}.round_num = {1}.round_num"
_P = _KEY.format("x", "tn") + " AND x.steamid = tn.steamid"

#: Token fields that the context and the pairs follow from.
CONTEXT_READS = ["side", "alive", "equipment_value", "account", "has_c4", "has_defuser"]
PAIR_READS = ["side", "alive", "x", "y", "z", "is_ducking", "nav_area"]

TOKEN_CTES = ROSTER + f""",
sl AS (SELECT r.match_key, r.round_num, s AS slot, CASE WHEN s < 5 THEN 'ct' ELSE 't' END AS side, p.steamid FROM rounds r CROSS JOIN range(10) AS g(s)
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY match_key, round_num, side ORDER BY steamid) AS n FROM ros) p ON {_KEY.format('p', 'r')} AND p.n <= 5 AND CASE WHEN p.side = 'ct' THEN 0 ELSE 5 END + p.n - 1 = s),
tn AS (SELECT smp.match_key, smp.round_num, smp.tick, sl.slot, sl.side, sl.steamid FROM smp JOIN sl ON {_KEY.format('sl', 'smp')}),
rw AS (SELECT t.*, CASE WHEN en.steamid IS NULL THEN 0 ELSE 1 END AS spot FROM ticks t JOIN ros me ON {_KEY.format('me', 't')} AND me.steamid = t.steamid
  LEFT JOIN ros en ON {_KEY.format('en', 't')} AND en.steamid = t.spotted_by[1] AND en.side <> me.side),
au AS (SELECT *, row_number() OVER (PARTITION BY match_key, round_num, tick ORDER BY start DESC, entity_id DESC) AS age FROM (
  SELECT smp.match_key, smp.round_num, smp.tick, a.* EXCLUDE (match_key, round_num) FROM smp JOIN (
    SELECT match_key, round_num, entity_id, start_tick AS start, end_tick AS stop, 'smoke' AS kind, x, y, z, {S.SMOKE_RADIUS} AS radius FROM smokes
    UNION ALL SELECT match_key, round_num, entity_id, start_tick, end_tick, 'fire', x, y, z, extent_radius FROM infernos
    UNION ALL SELECT match_key, round_num, entity_id, detonate_tick, coalesce(expire_tick, detonate_tick + 1920), 'decoy', x, y, z, NULL FROM grenades WHERE type = 'decoy') a
  ON {_KEY.format('a', 'smp')} AND a.start <= smp.tick AND (a.stop IS NULL OR a.stop > smp.tick))),
so AS (SELECT w.match_key, w.round_num, w.tick, ros.side, w.x, w.y, w.z FROM (
    SELECT f.match_key, f.round_num, f.tick, f.steamid, t.x, t.y, t.z FROM weapon_fire f ASOF JOIN ticks t ON t.match_key = f.match_key AND t.round_num = f.round_num AND t.steamid = f.steamid AND t.tick <= f.tick
    UNION ALL SELECT match_key, round_num, tick, steamid, x, y, z FROM footsteps) w JOIN ros ON {_KEY.format('ros', 'w')} AND ros.steamid = w.steamid),
kc AS (SELECT tn.match_key, tn.round_num, tn.tick, tn.slot, count(x.tick) AS kills FROM tn LEFT JOIN kills x ON {_KEY.format('x', 'tn')} AND x.attacker_steamid = tn.steamid AND x.tick <= tn.tick AND x.team_kill = FALSE GROUP BY ALL),
dc AS (SELECT tn.match_key, tn.round_num, tn.tick, tn.slot, coalesce(sum(x.dmg_health), 0) AS damage FROM tn LEFT JOIN (SELECT d.* FROM damages d JOIN ros a ON {_KEY.format('a', 'd')} AND a.steamid = d.attacker_steamid
  JOIN ros b ON {_KEY.format('b', 'd')} AND b.steamid = d.victim_steamid WHERE a.side <> b.side) x ON {_KEY.format('x', 'tn')} AND x.attacker_steamid = tn.steamid AND x.tick <= tn.tick GROUP BY ALL),
bc AS (SELECT tn.match_key, tn.round_num, tn.tick, tn.slot, max(x.detonate_tick + x.blind_duration * 128) AS until FROM tn LEFT JOIN flashes x ON {_KEY.format('x', 'tn')} AND x.player_steamid = tn.steamid AND x.detonate_tick <= tn.tick GROUP BY ALL),
j1 AS (SELECT tn.*, x.tick AS row_tick, coalesce(x.is_alive, FALSE) AS alive, x.x AS rx, x.y AS ry, x.z AS rz, x.yaw, x.pitch, x.vx, x.vy, x.health, x.armor, x.has_helmet, x.has_defuser, x.has_c4, x.active_weapon, x.inventory, x.money, x.equipment_value,
  x.is_ducking, x.is_defusing, x.spot FROM tn ASOF LEFT JOIN rw x ON {_P} AND x.tick <= tn.tick),
j2 AS (SELECT tn.*, x.x AS lx, x.y AS ly, x.z AS lz FROM j1 tn ASOF LEFT JOIN (SELECT * FROM ticks WHERE is_alive) x ON {_P} AND x.tick <= tn.tick),
j3 AS (SELECT tn.*, x.tick AS seen FROM j2 tn ASOF LEFT JOIN (SELECT * FROM rw WHERE spot > 0) x ON {_P} AND x.tick <= tn.tick),
j4 AS (SELECT tn.*, x.tick AS fire FROM j3 tn ASOF LEFT JOIN weapon_fire x ON {_P} AND x.tick <= tn.tick),
tk AS (SELECT j4.*, kills, damage, until, CASE WHEN alive THEN rx ELSE coalesce(lx, rx) END AS px, CASE WHEN alive THEN ry ELSE coalesce(ly, ry) END AS py, CASE WHEN alive THEN rz ELSE coalesce(lz, rz) END AS pz
  FROM j4 JOIN kc USING (match_key, round_num, tick, slot) JOIN dc USING (match_key, round_num, tick, slot) JOIN bc USING (match_key, round_num, tick, slot)),
ar AS (SELECT k.match_key, k.round_num, k.tick, k.slot, count(*) FILTER (u.kind = 'smoke' AND sqrt((px - u.x) ** 2 + (py - u.y) ** 2 + (pz - u.z) ** 2) <= u.radius) AS smoked,
    count(*) FILTER (u.kind = 'fire' AND sqrt((px - u.x) ** 2 + (py - u.y) ** 2) <= u.radius AND abs(pz - u.z) <= {S.FIRE_Z_TOL}) AS burnt, count(*) FILTER (u.kind = 'fire' AND u.radius IS NULL) AS vague
  FROM tk k LEFT JOIN au u ON {_KEY.format('u', 'k')} AND u.tick = k.tick AND u.age <= {schemas.MAX_UTILITY} GROUP BY ALL),
hr AS (SELECT k.match_key, k.round_num, k.tick, k.slot, max(CASE WHEN sqrt((k.px - s.x) ** 2 + (k.py - s.y) ** 2 + (k.pz - s.z) ** 2) <= {S.SAMPLING['heard_radius']} THEN 1 ELSE 0 END) AS heard
  FROM tk k LEFT JOIN so s ON {_KEY.format('s', 'k')} AND s.side <> k.side AND s.tick BETWEEN k.tick - {int(S.SAMPLING['heard_window_s'] * 128)} AND k.tick GROUP BY ALL)"""

_CELL = "CASE WHEN floor((py + 32768) / 512) BETWEEN 0 AND 127 AND floor((px + 32768) / 512) BETWEEN 0 AND 127 THEN CAST(floor((px + 32768) / 512) * 128 + floor((py + 32768) / 512) AS BIGINT) END"
_CLASS = "CASE active_weapon WHEN 'ak47' THEN 'rifle' WHEN 'weapon_m4a1' THEN 'rifle' WHEN 'awp' THEN 'sniper' WHEN 'glock' THEN 'pistol' WHEN 'hegrenade' THEN 'grenade' WHEN 'inferno' THEN 'grenade' WHEN 'Karambit' THEN 'knife' ELSE 'unknown' END"


def _live(x: str) -> str:
    return f"CASE WHEN alive THEN {x} END"


PLAYER_SQL = {
    "side": "side", "alive": "alive::BIGINT", "x": "round(px, 4)", "y": "round(py, 4)", "z": "round(pz, 4)", "nav_area": _CELL, "callout": f"'cell_' || {_CELL}", "grid_cell": _CELL,
    "yaw": f"round({_live('yaw')}, 4)", "pitch": f"round({_live('pitch::DOUBLE')}, 4)", "speed": f"round({_live('sqrt(vx * vx + vy * vy)')}, 4)", "health": "CASE WHEN alive THEN health ELSE 0 END::DOUBLE", "armor": "CASE WHEN alive THEN armor ELSE 0 END::DOUBLE",
    **{c: _live(f"{c}::BIGINT") for c in ("has_helmet", "has_defuser", "has_c4")}, "weapon_class": _live(f"CASE WHEN active_weapon IS NOT NULL THEN {_CLASS} END"),
    **{c: _live(f"CASE WHEN inventory IS NOT NULL THEN len(list_filter(inventory, lambda i: i = '{n}')) END::BIGINT") for c, n in (("n_smoke", "smokegrenade"), ("n_flash", "flashbang"), ("n_he", "hegrenade"), ("n_molly", "molotov"), ("n_decoy", "decoy"))},
    "is_scoped": "NULL::BIGINT", "is_ducking": "is_ducking::BIGINT", "is_walking": "NULL::BIGINT", "is_reloading": "NULL::BIGINT", "is_defusing": "is_defusing::BIGINT", "is_planting": "NULL::BIGINT",
    "flash_duration_remaining": "CASE WHEN alive THEN round(greatest(0, (coalesce(until, k.tick) - k.tick) / 128.0), 4) ELSE 0 END::DOUBLE",
    "in_smoke": f"CASE WHEN alive AND px IS NOT NULL THEN (smoked > 0)::BIGINT END", "on_fire": "CASE WHEN alive AND px IS NOT NULL THEN CASE WHEN burnt > 0 THEN 1 WHEN vague > 0 THEN NULL ELSE 0 END END::BIGINT",
    "money": _live("money::DOUBLE"), "equipment_value": _live("equipment_value::DOUBLE"), "seconds_since_last_seen_by_enemy": "round((k.tick - seen) / 128.0, 4)::DOUBLE", "seconds_since_last_shot": "round((k.tick - fire) / 128.0, 4)::DOUBLE",
    "spotted_by_count": _live("spot::BIGINT"), "heard_enemy": "CASE WHEN alive AND px IS NOT NULL THEN coalesce(heard, 0) END::BIGINT", "kills_round": "kills::DOUBLE", "damage_round": "damage::DOUBLE",
    "player_id": "CASE WHEN steamid IS NULL THEN -1 ELSE CAST(CAST('0x' || substr(sha1(steamid::VARCHAR), 1, 16) AS UBIGINT) % 9223372036854775808 AS BIGINT) END", "tier": "'pro'",
}


@query("player_tokens", with_sql(f"SELECT k.match_key, k.tick, k.slot::INT AS slot, {', '.join(f'{x} AS {c}' for c, x in PLAYER_SQL.items())} FROM tk k JOIN ar USING (match_key, round_num, tick, slot) JOIN hr USING (match_key, round_num, tick, slot)", TOKEN_CTES))
def player_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """All fields of the ten players at the tick of each kill."""
    f, r, players, smp = _samples(spark, sf)
    util = durable(D.utility_tokens(f, smp, r, players))
    t = D.state_players(f, smp, r, players, util)
    kinds = dict(t.dtypes)
    shown = [F.round(c, 4).alias(c) if kinds[c] == "double" else F.col(c) for c in schemas.PLAYER_FIELDS]
    return t.select("match_key", "tick", "slot", *shown)


CONTEXT_CTES = TOKEN_CTES + f""",
pl AS (SELECT match_key, round_num, min(tick) AS plant, arg_min(site, tick) AS site FROM bomb WHERE event = 'plant_complete' GROUP BY ALL),
df AS (SELECT smp.*, x.event, x.steamid AS who FROM smp ASOF LEFT JOIN (SELECT * FROM bomb WHERE event IN ('defuse_start', 'defuse_abort', 'defuse_complete', 'explode')) x ON {_KEY.format('x', 'smp')} AND x.tick <= smp.tick),
hf AS (SELECT *, CASE WHEN round_num <= 12 THEN 1 WHEN round_num <= 24 THEN 2 ELSE 3 + (round_num - 25) // 3 END AS half FROM rounds),
hp AS (SELECT a.match_key, a.round_num, a.half AS ah, b.round_num AS br, b.half AS bh, b.winner_side AS w FROM hf a JOIN hf b ON a.match_key = b.match_key AND b.round_num < a.round_num),
hs AS (SELECT h.match_key, h.round_num, any_value(h.half) AS half, count(w) FILTER (WHERE (w = 'ct') <> ((bh - ah) % 2 <> 0)) AS past_ct, count(w) FILTER (WHERE (w = 'ct') = ((bh - ah) % 2 <> 0)) AS past_t,
    count(*) FILTER (WHERE bh = ah AND br > coalesce(stop_ct, 0)) AS loss_ct, count(*) FILTER (WHERE bh = ah AND br > coalesce(stop_t, 0)) AS loss_t
  FROM hf h LEFT JOIN (SELECT *, max(CASE WHEN bh = ah AND coalesce(w, 'ct') = 'ct' THEN br END) OVER q AS stop_ct, max(CASE WHEN bh = ah AND coalesce(w, 't') = 't' THEN br END) OVER q AS stop_t FROM hp WINDOW q AS (PARTITION BY match_key, round_num)) p ON {_KEY.format('p', 'h')} GROUP BY h.match_key, h.round_num),
tc AS (SELECT match_key, round_num, tick,
    {', '.join(f"count(*) FILTER (side = '{s}' AND alive) AS alive_{s}, CASE WHEN count(*) FILTER (side = '{s}' AND alive) = count(equipment_value) FILTER (side = '{s}' AND alive) THEN coalesce(sum(equipment_value) FILTER (side = '{s}' AND alive), 0) END AS equip_{s}, CASE WHEN count(*) FILTER (side = '{s}' AND steamid IS NOT NULL) = count(money) FILTER (side = '{s}' AND steamid IS NOT NULL) THEN coalesce(sum(money) FILTER (side = '{s}' AND steamid IS NOT NULL), 0) END AS money_{s}" for s in ('ct', 't'))},
    CASE WHEN max(has_c4::INT) FILTER (side = 't' AND alive) = 1 THEN 1 WHEN count(*) FILTER (side = 't' AND alive) = count(has_c4) FILTER (side = 't' AND alive) THEN 0 END AS carrier FROM tk GROUP BY ALL),
uc AS (SELECT match_key, round_num, tick, count(*) FILTER (kind = 'smoke') AS smokes, count(*) FILTER (kind = 'fire') AS fires FROM au GROUP BY ALL),
cx AS (SELECT tc.*, pl.plant, CASE WHEN pl.plant <= tc.tick THEN TRUE ELSE FALSE END AS planted, pl.site, r.freeze_end_tick AS fe, hs.* EXCLUDE (match_key, round_num), coalesce(smokes, 0) AS smokes, coalesce(fires, 0) AS fires,
    coalesce(pl.plant <= tc.tick AND df.event = 'defuse_start' AND dt.alive, FALSE) AS busy, CASE WHEN dt.alive THEN dt.has_defuser::INT END AS dk
  FROM tc LEFT JOIN pl ON {_KEY.format('pl', 'tc')} JOIN rounds r ON {_KEY.format('r', 'tc')} JOIN hs ON {_KEY.format('hs', 'tc')} JOIN df ON {_KEY.format('df', 'tc')} AND df.tick = tc.tick
  LEFT JOIN tk dt ON {_KEY.format('dt', 'tc')} AND dt.tick = tc.tick AND dt.steamid = df.who LEFT JOIN uc ON {_KEY.format('uc', 'tc')} AND uc.tick = tc.tick)"""

_INTO, _SINCE = "(tick - fe) / 128.0", "(tick - plant) / 128.0"
_RT, _BT = S.CLOCK["round_time_s"], S.CLOCK["bomb_timer_s"]
CONTEXT_SQL = {
    "map_version": "'open@flat'", "tier": "'pro'", "time_remaining_s": f"round(CASE WHEN planted THEN greatest(0, {_BT} - {_SINCE}) ELSE greatest(0, least({_RT}, {_RT} - {_INTO})) END::DOUBLE, 4)", "time_into_round_s": f"round(greatest(0, {_INTO})::DOUBLE, 4)",
    "bomb_planted": "planted::BIGINT", "bomb_site": "CASE WHEN planted THEN CASE WHEN site = 'A' THEN 'A' WHEN site = 'BombsiteB' THEN 'B' END END", "time_since_plant_s": f"round(CASE WHEN planted THEN {_SINCE} END::DOUBLE, 4)",
    "defuse_in_progress": "busy::BIGINT", "defuse_with_kit": "CASE WHEN busy THEN dk END::BIGINT", "bomb_carrier_alive": "CASE WHEN NOT planted THEN carrier END::BIGINT", "alive_ct": "alive_ct", "alive_t": "alive_t",
    **{f"{k}_{s}": f"{k}_{s}::DOUBLE" for k in ("equip", "money") for s in ("ct", "t")}, "loss_streak_ct": "loss_ct", "loss_streak_t": "loss_t", "score_ct": "past_ct", "score_t": "past_t", "half": "half::BIGINT", "is_overtime": "(round_num > 24)::BIGINT",
    "n_active_smokes": "smokes", "n_active_fires": "fires",
}


@query("context_tokens", with_sql(f"SELECT match_key, round_num, tick, {', '.join(f'{x} AS {c}' for c, x in CONTEXT_SQL.items())} FROM cx", CONTEXT_CTES))
def context_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """All fields of the context at the tick of each kill: clock, bomb, economy, score, streaks."""
    f, r, players, smp = _samples(spark, sf)
    util = durable(D.utility_tokens(f, smp, r, players))
    toks = durable(D.state_players(f, smp, r, players, util, fields=CONTEXT_READS))
    c = D.state_ctx(f, smp, r, toks, util)
    kinds = dict(c.dtypes)
    return c.select(*ROUND, "tick", *[F.round(k, 4).alias(k) if kinds[k] == "double" else F.col(k) for k in schemas.CTX_FIELDS if k != "round_num"])


PAIR_CTES = TOKEN_CTES + f""",
ey AS (SELECT *, pz + CASE WHEN is_ducking THEN {S.EYE_DUCK} ELSE {S.EYE_STAND} END AS ez, {_CELL} AS cell FROM tk),
pp AS (SELECT a.match_key, a.round_num, a.tick, a.slot AS a_slot, b.slot AS b_slot, a.alive AND b.alive AS live, a.px IS NOT NULL AND b.px IS NOT NULL AS placed, a.side = b.side AS mates, a.px AS ax, a.py AS ay, a.pz AS az, a.ez AS ae, a.cell AS ac, b.px AS bx, b.py AS by_, b.pz AS bz, b.ez AS be, b.cell AS bc
  FROM ey a JOIN ey b ON {_KEY.format('a', 'b')} AND a.tick = b.tick AND a.slot < b.slot),
pd AS (SELECT pp.*, u.x AS ux, u.y AS uy, u.z AS uz, u.radius, (bx - ax) ** 2 + (by_ - ay) ** 2 + (be - ae) ** 2 AS dd, (ax - u.x) * (bx - ax) + (ay - u.y) * (by_ - ay) + (ae - u.z) * (be - ae) AS fd
  FROM pp LEFT JOIN au u ON {_KEY.format('u', 'pp')} AND u.tick = pp.tick AND u.age <= {schemas.MAX_UTILITY} AND u.kind = 'smoke'),
pm AS (SELECT *, CASE WHEN dd = 0 THEN 0 ELSE least(1, greatest(0, -fd / dd)) END AS s FROM pd),
pc AS (SELECT match_key, round_num, tick, a_slot, b_slot, coalesce(max(CASE WHEN (ax + s * (bx - ax) - ux) ** 2 + (ay + s * (by_ - ay) - uy) ** 2 + (ae + s * (be - ae) - uz) ** 2 <= radius * radius THEN 1 ELSE 0 END), 0) AS cut FROM pm GROUP BY ALL)"""


@query("pair_rows", with_sql("""SELECT match_key, tick, a_slot::INT AS a_slot, b_slot::INT AS b_slot, CASE WHEN live AND placed AND NOT mates THEN 1.0 END::DOUBLE AS los, round(sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2), 4) AS dist_units,
  round(sqrt((512.0 * (ac // 128 - bc // 128)) ** 2 + (512.0 * (ac % 128 - bc % 128)) ** 2), 4)::DOUBLE AS nav_dist_units, CASE WHEN live AND placed THEN cut END::DOUBLE AS smoke_between, mates::INT::DOUBLE AS same_team FROM pp JOIN pc USING (match_key, round_num, tick, a_slot, b_slot)""", PAIR_CTES))
def pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All channels of the 45 slot pairs at the tick of each kill: sight, distances, smoke between, team."""
    f, r, players, smp = _samples(spark, sf)
    util = durable(D.utility_tokens(f, smp, r, players))
    p = D.state_pairs(f, durable(D.state_players(f, smp, r, players, util, fields=PAIR_READS)), util)
    return p.select("match_key", "tick", "a_slot", "b_slot", *[F.round(c, 4).alias(c) for c in schemas.PAIR_CHANNELS])
