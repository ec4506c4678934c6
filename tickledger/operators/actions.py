"""Actions read from the raw tables: kills, damage, grenades, bomb, economy.

Every extractor takes a ``Feed`` and returns action rows with a typed ``params`` struct;
``to_actions`` turns those into the flat action schema.  Rows without a known actor side
are dropped, as are rows outside their round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from .. import settings as S
from ..functions import ids
from ..functions.exprs import dist, known_sum, loadout_class
from ..functions.weapons import NADE_FIELDS, grenade_count, primary_class, short_name, weapon_class
from .feed import ROUND, Feed
from .sampling import all_sides, check_round, with_terminal
from .scan import asof, durable, interval_match, range_join, sessionize, settled

PID = ids.player_id_hash
FIRE_WEAPONS = ["molotov", "incgrenade", "inferno"]
BOMB_TYPE = {"plant_start": "plant_start", "plant_complete": "plant_complete", "defuse_start": "defuse_start",
             "defuse_complete": "defuse_complete", "defuse_abort": "defuse_abort", "drop": "bomb_drop", "pickup": "bomb_pickup"}
PSEUDO = {"smoke": ("smoke_pop", "smoke_fade"), "molotov": ("fire_start", "fire_end"), "decoy": ("decoy_start", "decoy_end")}
NOMINAL = {"smoke": "smoke", "molotov": "fire", "decoy": "decoy"}


class Context:
    """Per-feed lookups shared by the extractors."""

    def __init__(self, feed: Feed):
        self.feed = feed = feed.with_tables(ticks=settled(feed["ticks"]))  # read by every step
        self.rounds = durable(with_terminal(feed["rounds"], feed["ticks"]))
        self.sides = durable(all_sides(feed["ticks"], self.rounds))

    def with_side(self, df: DataFrame, who: str, name: str, how: str = "left") -> DataFrame:
        side = self.sides.select(*ROUND, F.col("steamid").alias(who), F.col("side").alias(name))
        return df.join(side, [*ROUND, who], how)

    def at(self, df: DataFrame, who: str, tick: str, cols: dict[str, str]) -> DataFrame:
        """Columns of a player's latest row at or before a tick: ``{new name: tick column}``."""
        t = self.feed["ticks"].select(
            *ROUND, F.col("steamid").alias(who), F.col("tick").alias("_tt"), *[F.col(c).alias(n) for n, c in cols.items()])
        return asof(df, t, [*ROUND, who], tick, "_tt", list(cols), width=self.feed.width)

    def callout(self, df: DataFrame, x: str, y: str, z: str, name: str) -> DataFrame:
        before = df.columns
        out = self.feed.geometry.places(df.withColumns({"_cx": F.col(x), "_cy": F.col(y), "_cz": F.col(z)}), "_cx", "_cy", "_cz", "_c_")
        return out.withColumn(name, F.col("_c_callout")).select(*[c for c in before if c != name], name)


def _xyz(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in "xyz"]


def instant(df: DataFrame, type_: Column | str, sid: str, tick: str, params: Column, side: str, subtype: Column | None = None, salt: Column | None = None) -> DataFrame:
    """Instant action rows; ``side`` must be known."""
    type_ = F.lit(type_) if isinstance(type_, str) else type_
    off = S.SAMPLING["boundary_offset_ticks"]
    none = F.lit(None)
    out = df.where(F.col(side).isNotNull()).select(
        *ROUND, PID(F.col(sid)).alias("actor_id_hash"), F.col(side).alias("actor_side"), F.lit("instant").alias("kind"),
        type_.alias("type"), (subtype if subtype is not None else none).cast("string").alias("subtype"),
        F.col(tick).cast("bigint").alias("tick"), none.cast("bigint").alias("window_start_tick"), none.cast("bigint").alias("window_end_tick"),
        params.alias("p"), (F.col(tick) - off).alias("state_pre_tick"), (F.col(tick) + off).alias("state_post_tick"),
        (salt if salt is not None else none).cast("string").alias("salt"))
    return out


def durative(df: DataFrame, type_: str, sid: str, start: str, end: str, params: Column, side: str, subtype: Column | None = None, salt: Column | None = None) -> DataFrame:
    """Durative action rows with a window."""
    off = S.SAMPLING["boundary_offset_ticks"]
    none = F.lit(None)
    return df.where(F.col(side).isNotNull()).select(
        *ROUND, PID(F.col(sid)).alias("actor_id_hash"), F.col(side).alias("actor_side"), F.lit("durative").alias("kind"),
        F.lit(type_).alias("type"), (subtype if subtype is not None else none).cast("string").alias("subtype"),
        none.cast("bigint").alias("tick"), F.col(start).cast("bigint").alias("window_start_tick"), F.col(end).cast("bigint").alias("window_end_tick"),
        params.alias("p"), (F.col(start) - off).alias("state_pre_tick"), (F.col(end) + off).alias("state_post_tick"),
        (salt if salt is not None else none).cast("string").alias("salt"))


def with_ids(df: DataFrame) -> DataFrame:
    """Action ids; a repeated id within (round, type, actor, tick) is salted from the second row on."""
    t = F.coalesce("tick", "window_start_tick")
    w = Window.partitionBy(*ROUND, "type", "actor_id_hash", t).orderBy("salt", "state_post_tick")
    plain = ids.action_id(F.col("match_key"), F.col("round_num"), F.col("type"), F.col("actor_id_hash"), t)
    salted = ids.action_id(F.col("match_key"), F.col("round_num"), F.col("type"), F.col("actor_id_hash"), t, F.col("salt"))
    return df.withColumn("action_id", F.when(F.row_number().over(w) > 1, salted).otherwise(plain)).drop("salt")


def to_actions(df: DataFrame) -> DataFrame:
    """Flat action rows: ids, params as JSON (unknown parts kept as null), no enablers yet."""
    out = with_ids(df)
    out = out.withColumn("params", F.to_json("p", {"ignoreNullFields": "false"})).withColumn("enablers", F.lit("[]"))
    types = dict(c.strip().split(" ") for c in schemas.ACTION_DDL.split(","))
    return out.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


# kills and damage


def extract_kills(c: Context) -> DataFrame:
    """Kills and team kills; suicides and world kills are left out."""
    k = check_round(c.feed["kills"], c.rounds)
    for n in ("headshot", "through_smoke", "attacker_blind", "victim_blind", "noscope", "penetrated", "distance",
              "assister_steamid", "flash_assister_steamid", *[f"{p}_{a}" for p in ("attacker", "victim") for a in "xyz"]):
        if n not in k.columns:
            k = k.withColumn(n, F.lit(None).cast("double" if n[-2:] in ("_x", "_y", "_z") or n == "distance" else "bigint" if "steamid" in n or n == "penetrated" else "boolean"))
    k = k.where("attacker_steamid is not null and victim_steamid is not null and attacker_steamid <> victim_steamid")
    k = c.with_side(c.with_side(k, "attacker_steamid", "_sa"), "victim_steamid", "_sv")
    k = k.withColumn("_pre", F.col("tick") - 1)
    for who in ("attacker", "victim"):
        k = c.at(k, f"{who}_steamid", "tick", {f"_{who}_{a}": a for a in "xyz"})
        own = F.col(f"{who}_x").isNotNull() & F.col(f"{who}_y").isNotNull() & F.col(f"{who}_z").isNotNull()
        k = k.withColumns({f"{who}_{a}": F.when(own, F.col(f"{who}_{a}")).otherwise(F.col(f"_{who}_{a}")) for a in "xyz"})
        k = c.callout(k, f"{who}_x", f"{who}_y", f"{who}_z", f"{who}_callout")
    k = c.at(k, "victim_steamid", "_pre", {"_hp": "health"})
    team = F.coalesce(F.col("team_kill"), F.coalesce(F.col("_sa") == F.col("_sv"), F.lit(False)))
    d = F.coalesce(F.col("distance").cast("double"), dist(_xyz("attacker_"), _xyz("victim_")))
    p = F.struct(
        F.coalesce(short_name(F.col("weapon")), F.col("weapon")).alias("weapon"), weapon_class(F.col("weapon")).alias("weapon_class"),
        "headshot", "through_smoke", "attacker_blind", "victim_blind", (F.col("penetrated") > 0).alias("wallbang"), "noscope",
        F.bround(d, 3).alias("distance_units"), "attacker_callout", "victim_callout", F.col("_hp").cast("bigint").alias("victim_health_before"),
        PID(F.col("assister_steamid")).alias("assister_id"), PID(F.col("flash_assister_steamid")).alias("flash_assister_id"),
        PID(F.col("victim_steamid")).alias("victim_id"))
    type_ = F.when(team, "team_kill").otherwise("kill")
    return instant(k, type_, "attacker_steamid", "tick", p, "_sa", salt=PID(F.col("victim_steamid")))


def engagements(damages: DataFrame, kills: DataFrame, gap: float, width: int) -> DataFrame:
    """Non-lethal hits per (round, attacker, victim) in engagements split at gaps of ``gap`` ticks.

    One row per engagement: first and last hit, totals, hits, the most frequent weapon
    class (the first seen on ties).
    """
    pair = [*ROUND, "attacker_steamid", "victim_steamid"]
    hits = damages.where("attacker_steamid is not null and victim_steamid is not null and attacker_steamid <> victim_steamid")
    hits = hits.join(kills.select(*pair, "tick").distinct(), [*pair, "tick"], "left_anti")
    hits = sessionize(hits, pair, "tick", gap, "_eng", width)
    hits = hits.withColumn("_cls", weapon_class(F.col("weapon")))
    by = [*pair, "_eng"]
    cls = hits.groupBy(*by, "_cls").agg(
        F.count(F.lit(1)).alias("n"), F.min("tick").alias("first"), F.max("tick").alias("last"),
        F.sum(F.coalesce("dmg_health", F.lit(0))).cast("bigint").alias("dmg"), F.sum(F.coalesce("dmg_armor", F.lit(0))).cast("bigint").alias("arm"))
    rank = F.struct(F.col("n"), -F.col("first"), F.col("_cls").isNull(), F.col("_cls"))
    return cls.groupBy(*by).agg(
        F.min("first").alias("tick"), F.max("last").alias("last_tick"), F.sum("dmg").alias("damage_total"),
        F.sum("n").alias("hits"), F.max_by("_cls", rank).alias("weapon_class"), F.sum("arm").alias("armor_damage")).drop("_eng")


def extract_damage(c: Context) -> DataFrame:
    """One action per engagement at its first hit, with the span as window metadata."""
    d = check_round(c.feed["damages"], c.rounds)
    e = engagements(d, c.feed["kills"], S.ACTIONS["damage_gap_s"] * c.feed.tick_rate, c.feed.width)
    e = c.with_side(c.with_side(e, "attacker_steamid", "_sa"), "victim_steamid", "_sv")
    vid = PID(F.col("victim_steamid"))
    p = F.struct("damage_total", "hits", "weapon_class", "armor_damage", vid.alias("victim_id"), "last_tick")
    sub = F.when(F.col("_sa") == F.col("_sv"), F.lit("team"))
    out = instant(e, "damage", "attacker_steamid", "tick", p, "_sa", sub, vid)
    out = out.withColumns({"window_start_tick": F.col("tick"), "window_end_tick": F.col("p.last_tick")})
    return out.withColumn("p", F.col("p").dropFields("last_tick"))


# grenades


def throws(c: Context, *types: str) -> DataFrame:
    """Grenades of the given types in their detonation round."""
    g = c.feed["grenades"].where(F.col("type").isin(*types))
    if "round_num" not in g.columns:
        from .normalize import assign_round

        g = assign_round(g, c.rounds, "detonate_tick", c.feed.width)
    return g


def thrower_callout(c: Context, g: DataFrame, who: str = "thrower_steamid") -> DataFrame:
    """Callout of the thrower at the throw tick."""
    g = c.at(g, who, "throw_tick", {f"_t{a}": a for a in "xyz"})
    return c.callout(g, "_tx", "_ty", "_tz", "throw_callout")


def split_victims(c: Context, rows: DataFrame, keys: Sequence[str], who: str, thrower: str, entry: list[str]) -> DataFrame:
    """Victim entries sorted by id, split in enemies and teammates; the thrower's own row is left out."""
    r = c.with_side(c.with_side(rows, thrower, "_st"), who, "_sv").where(F.col(who) != F.col(thrower))
    mate = F.coalesce(F.col("_st") == F.col("_sv"), F.lit(False))
    item = F.struct(PID(F.col(who)).alias("id"), *entry)
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, item)))
    return r.groupBy(*keys).agg(pick(~mate).alias("enemies"), pick(mate).alias("mates"))


def _empty_like(df: DataFrame, col: str, src: str) -> Column:
    return F.coalesce(F.col(col), F.array().cast(df.schema[src].dataType))


def extract_flashes(c: Context) -> DataFrame:
    """Flashes with the blinded players and their longest blindness.

    Blinds belong to the flash with their entity id near its detonation; a flash without
    such rows takes the blinds near its tick when no other flash is as close.
    """
    sim = S.ACTIONS["simultaneity_ticks"]
    g = throws(c, "flash").where("detonate_tick is not null and thrower_steamid is not null")
    key = [*ROUND, "entity_id", "detonate_tick"]
    b = c.feed.in_round("flashes", "detonate_tick").where("player_steamid is not null and blind_duration is not null").select(
        *ROUND, F.col("entity_id").alias("_be"), F.col("detonate_tick").alias("_bt"), "player_steamid", F.col("blind_duration").cast("double").alias("d"))
    spans = g.select(*key, "thrower_steamid", (F.col("detonate_tick") - sim).alias("_lo"), (F.col("detonate_tick") + sim).alias("_hi"))
    near = range_join(spans, b, ROUND, "_lo", "_hi", "_bt", c.feed.width)
    own = near.where(F.col("_be") == F.col("entity_id"))
    dets = g.select(*ROUND, F.col("detonate_tick").alias("_od")).withColumn("_one", F.lit(1))
    crowd = range_join(spans, dets, ROUND, "_lo", "_hi", "_od", c.feed.width).groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    alone = near.join(crowd.where("_n = 1").select(*key), key, "left_semi").join(own.select(*key).distinct(), key, "left_anti")
    hit = own.unionByName(alone).groupBy(*key, "thrower_steamid", "player_steamid").agg(F.max("d").alias("_d"))
    hit = hit.withColumn("duration", F.bround("_d", 4))
    self_ = hit.where(F.col("player_steamid") == F.col("thrower_steamid")).select(*key, F.col("duration").alias("blinded_self"))
    v = split_victims(c, hit, key, "player_steamid", "thrower_steamid", ["duration"])
    g = thrower_callout(c, c.with_side(g, "thrower_steamid", "_st")).join(v, key, "left").join(self_, key, "left")
    g = c.callout(g, "x", "y", "z", "land_callout")
    p = F.struct(
        _empty_like(g, "enemies", "enemies").alias("blinded_enemies"), _empty_like(g, "mates", "mates").alias("blinded_teammates"),
        F.coalesce("blinded_self", F.lit(0.0)).alias("blinded_self"), "land_callout", "throw_callout",
        F.bround((F.col("detonate_tick") - F.col("throw_tick")) / F.lit(float(c.feed.tick_rate)), 4).alias("pop_delay_s"),
        "throw_tick", "entity_id", *[F.bround(F.col(a).cast("double"), 3).alias(a) for a in "xyz"])
    return instant(g, "flash", "thrower_steamid", "detonate_tick", p, "_st", salt=F.col("entity_id"))


def extract_he(c: Context) -> DataFrame:
    """HE grenades with the damage near their detonation, split in enemies and teammates."""
    sim = S.ACTIONS["simultaneity_ticks"]
    g = throws(c, "he").where("detonate_tick is not null and thrower_steamid is not null")
    key = [*ROUND, "entity_id", "detonate_tick"]
    spans = g.select(*key, "thrower_steamid", (F.col("detonate_tick") - sim).alias("_lo"), (F.col("detonate_tick") + sim).alias("_hi"))
    d = c.feed["damages"].where((short_name(F.col("weapon")) == "hegrenade") & F.col("victim_steamid").isNotNull()).select(
        *ROUND, F.col("attacker_steamid").alias("thrower_steamid"), F.col("tick").alias("_dt"), "victim_steamid", "dmg_health", "dmg_armor")
    hit = range_join(spans, d, [*ROUND, "thrower_steamid"], "_lo", "_hi", "_dt", c.feed.width)
    hit = hit.groupBy(*key, "thrower_steamid", "victim_steamid").agg(
        F.sum(F.coalesce("dmg_health", F.lit(0))).cast("bigint").alias("dmg"), F.sum(F.coalesce("dmg_armor", F.lit(0))).cast("bigint").alias("armor"))
    v = split_victims(c, hit, key, "victim_steamid", "thrower_steamid", ["dmg", "armor"])
    g = c.callout(c.with_side(g, "thrower_steamid", "_st"), "x", "y", "z", "land_callout").join(v, key, "left")
    en, tm = _empty_like(g, "enemies", "enemies"), _empty_like(g, "mates", "mates")
    total = F.aggregate(F.concat(en, tm), F.lit(0).cast("bigint"), lambda s, e: s + e["dmg"])
    p = F.struct(en.alias("enemies_damaged"), tm.alias("teammates_damaged"), total.alias("damage_total"), "land_callout", "throw_tick",
                 "entity_id", *[F.bround(F.col(a).cast("double"), 3).alias(a) for a in "xyz"])
    return instant(g, "he", "thrower_steamid", "detonate_tick", p, "_st", salt=F.col("entity_id"))


def match_throws(areas: DataFrame, grenades: DataFrame, tol: int, width: int) -> DataFrame:
    """Each cloud's throw: the same entity first, else the thrower's nearest within ``tol`` ticks.

    Clouds choose in start order and a throw is used once.
    """
    key = [*ROUND, "entity_id", "start_tick"]
    g = grenades.select(*ROUND, F.col("entity_id").alias("g_id"), F.col("thrower_steamid").alias("g_who"), "detonate_tick",
                        F.col("throw_tick").alias("g_throw"), F.col("type").alias("g_type"))
    a = areas.select(*key, F.col("thrower_steamid").alias("_w"), (F.col("start_tick") - tol).alias("_lo"), (F.col("start_tick") + tol).alias("_hi"))
    near = range_join(a, g, ROUND, "_lo", "_hi", "detonate_tick", max(width, 2 * tol))
    same = F.col("g_id") == F.col("entity_id")
    near = near.where(same | (F.col("g_who") == F.col("_w")))
    near = near.withColumns({"_diff": (~same).cast("int"), "_dt": F.abs(F.col("detonate_tick") - F.col("start_tick"))})
    # a same-entity choice ignores the distance; ties go to the earlier throw
    near = near.withColumn("_dt", F.when(same, 0).otherwise(F.col("_dt")))
    pairs = near.select(*key, "g_id", "g_who", "g_throw", "g_type", "_diff", "_dt", "detonate_tick")
    return interval_match(pairs, ROUND, ["entity_id", "start_tick"], ["g_id", "g_throw"], ["start_tick"], ["_diff", "_dt", "g_throw"], "detonate_tick", width).drop("detonate_tick")


def _area_rows(c: Context, table: str, *types: str) -> DataFrame:
    rate = c.feed.tick_rate
    a = c.feed.in_round(table, "start_tick")
    tol = int(round(S.ACTIONS["match_tol_s"] * rate))
    m = match_throws(a.where("start_tick is not null"), throws(c, *types), tol, c.feed.width)
    a = a.join(m.select(*ROUND, "entity_id", "start_tick", "g_id", "g_who", "g_throw", "g_type"), [*ROUND, "entity_id", "start_tick"], "left")
    a = a.withColumns({"thrower_steamid": F.coalesce("thrower_steamid", "g_who"), "throw_tick": F.col("g_throw")})
    return check_round(a.where("start_tick is not null and thrower_steamid is not null"), c.rounds, "start_tick")


def _durative_utility(c: Context, rows: DataFrame, type_: str, params: list, subtype: Column | None = None) -> DataFrame:
    """The durative action with its start and (when it ends before the round) end pseudo-actions."""
    nominal = int(round(S.NOMINAL_DURATION_S[NOMINAL[type_]] * c.feed.tick_rate))
    rows = c.with_side(rows, "thrower_steamid", "_st").join(c.rounds.select(*ROUND, "terminal"), ROUND)
    rows = rows.withColumn("_end", F.coalesce(F.col("_raw_end"), F.col("start_tick") + nominal))
    rows = rows.withColumn("_clip", F.greatest(F.col("start_tick"), F.least("_end", "terminal")))
    land = [F.bround(F.col(a).cast("double"), 3).alias(a) for a in "xyz"]
    end = F.col("_end").alias("expire_tick" if type_ == "smoke" else "end_tick")
    main = durative(rows, type_, "thrower_steamid", "start_tick", "_clip", F.struct(*params, "entity_id", *land, end), "_st", subtype, F.col("entity_id"))
    return main


def pseudo_actions(durs: DataFrame, rounds: DataFrame) -> DataFrame:
    """Start and end markers of durative utility, linked to the final id of their parent.

    The end marker exists only when the utility ends before its round.
    """
    types = [t for t in PSEUDO]
    d = durs.where(F.col("type").isin(*types)).join(rounds.select(*ROUND, "terminal"), ROUND)
    raw_end = F.coalesce(F.get_json_object("params", "$.expire_tick"), F.get_json_object("params", "$.end_tick")).cast("bigint")
    name = lambda i: F.element_at(F.create_map(*[F.lit(x) for t in types for x in (t, PSEUDO[t][i])]), F.col("type"))
    marks = F.array_compact(F.array(
        F.struct(name(0).alias("t"), F.col("window_start_tick").alias("k")),
        F.when(raw_end < F.col("terminal"), F.struct(name(1).alias("t"), raw_end.alias("k")))))
    xyz = [F.get_json_object("params", f"$.{a}").cast("double").alias(a) for a in "xyz"]
    off = S.SAMPLING["boundary_offset_ticks"]
    d = d.withColumn("_m", F.explode(marks))
    out = d.select(
        *ROUND, "actor_id_hash", "actor_side", F.lit("instant").alias("kind"), F.col("_m.t").alias("type"), F.lit(None).cast("string").alias("subtype"),
        F.col("_m.k").alias("tick"), F.lit(None).cast("bigint").alias("window_start_tick"), F.lit(None).cast("bigint").alias("window_end_tick"),
        F.struct(F.col("action_id").alias("parent_action_id"), *xyz).alias("p"), (F.col("_m.k") - off).alias("state_pre_tick"),
        (F.col("_m.k") + off).alias("state_post_tick"), F.get_json_object("params", "$.entity_id").alias("salt"))
    return to_actions(out)


def extract_smokes(c: Context) -> DataFrame:
    r = _area_rows(c, "smokes", "smoke").withColumn("_raw_end", F.col("end_tick"))
    r = c.callout(thrower_callout(c, r), "x", "y", "z", "land_callout")
    p = ["land_callout", "throw_callout", "throw_tick", F.col("start_tick").alias("pop_tick"), F.lit(None).cast("bigint").alias("blocks_pairs_at_pop")]
    return _durative_utility(c, r, "smoke", p)


def fire_damage(c: Context, fires: DataFrame) -> DataFrame:
    """Damage of each fire's owner to enemies during its burn, by victim."""
    spans = fires.select(*ROUND, "entity_id", "start_tick", "thrower_steamid", F.col("_burn_end").alias("_hi"))
    d = c.feed["damages"].where(short_name(F.col("weapon")).isin(*FIRE_WEAPONS)).select(
        *ROUND, F.col("attacker_steamid").alias("thrower_steamid"), F.col("tick").alias("_dt"), "victim_steamid", "dmg_health")
    hit = range_join(spans, d, [*ROUND, "thrower_steamid"], "start_tick", "_hi", "_dt", c.feed.width)
    hit = c.with_side(c.with_side(hit, "thrower_steamid", "_st"), "victim_steamid", "_sv").where(
        F.col("_sv").isNotNull() & ~F.col("_sv").eqNullSafe(F.col("_st")))
    per = hit.groupBy(*ROUND, "entity_id", "start_tick", "victim_steamid").agg(F.sum(F.coalesce("dmg_health", F.lit(0))).cast("bigint").alias("dmg"))
    return per.groupBy(*ROUND, "entity_id", "start_tick").agg(
        F.array_sort(F.collect_list(F.struct(PID(F.col("victim_steamid")).alias("id"), "dmg"))).alias("enemies_damaged"))


def displaced(c: Context, fires: DataFrame) -> DataFrame:
    """Enemies inside a fire at its start that were outside, alive, within two seconds."""
    within = int(round(S.ACTIONS["displace_s"] * c.feed.tick_rate))
    f = fires.where("extent_radius is not null and x is not null").select(
        *ROUND, "entity_id", "start_tick", "thrower_steamid", F.col("extent_radius").cast("double").alias("r"),
        *[F.col(a).cast("double").alias(f"c{a}") for a in "xyz"])
    f = c.with_side(f, "thrower_steamid", "_st")
    who = f.join(c.sides.select(*ROUND, "steamid", "side"), ROUND).where(~F.col("side").eqNullSafe(F.col("_st")))
    who = c.at(who, "steamid", "start_tick", {"_a": "is_alive", **{f"_{a}": a for a in "xyz"}})
    inside = lambda x, y, z: (dist([x, y], [F.col("cx"), F.col("cy")]) <= F.col("r")) & (F.abs(z - F.col("cz")) <= S.FIRE_Z_TOL)
    who = who.where(F.col("_a") & inside(F.col("_x"), F.col("_y"), F.col("_z")))
    who = who.withColumns({"_lo": F.col("start_tick") + 1, "_hi": F.col("start_tick") + within}).drop("_x", "_y", "_z")
    t = c.feed["ticks"].where("is_alive").select(*ROUND, "steamid", F.col("tick").alias("_pt"), "x", "y", "z")
    out = range_join(who, t, [*ROUND, "steamid"], "_lo", "_hi", "_pt", c.feed.width).where(~inside(F.col("x"), F.col("y"), F.col("z")))
    return out.groupBy(*ROUND, "entity_id", "start_tick").agg(F.array_sort(F.collect_set(PID(F.col("steamid")))).alias("enemies_displaced"))


def extract_molotovs(c: Context) -> DataFrame:
    nominal = int(round(S.NOMINAL_DURATION_S["fire"] * c.feed.tick_rate))
    r = _area_rows(c, "infernos", "molotov", "incendiary").withColumn("_raw_end", F.col("end_tick"))
    r = r.withColumn("_burn_end", F.coalesce("_raw_end", F.col("start_tick") + nominal))
    key = [*ROUND, "entity_id", "start_tick"]
    r = r.join(fire_damage(c, r), key, "left").join(displaced(c, r), key, "left")
    r = c.callout(r, "x", "y", "z", "land_callout")
    hurt = _empty_like(r, "enemies_damaged", "enemies_damaged").alias("enemies_damaged")
    left = F.when(F.col("extent_radius").isNotNull(), F.coalesce("enemies_displaced", F.array().cast("array<bigint>"))).alias("enemies_displaced")
    p = ["land_callout", hurt, left, F.bround(F.col("extent_radius").cast("double"), 3).alias("radius_units"), "throw_tick"]
    return _durative_utility(c, r, "molotov", p, F.col("g_type"))


def extract_decoys(c: Context) -> DataFrame:
    g = throws(c, "decoy").where("detonate_tick is not null and thrower_steamid is not null")
    g = g.withColumns({"start_tick": F.col("detonate_tick"), "_raw_end": F.col("expire_tick")})
    g = check_round(c.callout(g, "x", "y", "z", "land_callout"), c.rounds, "start_tick")
    return _durative_utility(c, g, "decoy", ["land_callout", "throw_tick"])


# bomb


def alive_counts(c: Context, df: DataFrame, tick: str) -> DataFrame:
    """Alive players per side at a tick: ``ct_alive`` and ``t_alive``."""
    probes = df.select(*ROUND, F.col(tick).alias("_at")).distinct().join(c.sides.select(*ROUND, "steamid", "side"), ROUND)
    probes = c.at(probes, "steamid", "_at", {"_alive": "is_alive"})
    n = probes.groupBy(*ROUND, "_at").agg(
        F.count_if((F.col("side") == "ct") & F.col("_alive")).alias("ct_alive"), F.count_if((F.col("side") == "t") & F.col("_alive")).alias("t_alive"))
    return df.join(n.withColumnRenamed("_at", tick), [*ROUND, tick], "left")


def extract_bomb(c: Context) -> DataFrame:
    """Plants, defuses, drops and pickups; repeated events are dropped."""
    types = F.create_map(*[F.lit(x) for kv in BOMB_TYPE.items() for x in kv])
    b = check_round(c.feed["bomb"], c.rounds).withColumn("_type", F.try_element_at(types, F.col("event")))
    b = b.where("_type is not null and steamid is not null")
    pos = F.struct("x", "y", "z")
    kit = F.col("has_kit") if "has_kit" in b.columns else F.lit(None).cast("boolean")
    b = b.groupBy(*ROUND, "tick", "_type", "steamid").agg(F.min(F.struct("site", kit.alias("kit"), pos.alias("pos"))).alias("_r"))
    b = b.select(*ROUND, "tick", "_type", "steamid", "_r.site", "_r.kit", "_r.pos.x", "_r.pos.y", "_r.pos.z", (F.col("tick") - 1).alias("_pre"))
    b = c.at(b, "steamid", "tick", {f"_t{a}": a for a in "xyz"})
    b = c.at(b, "steamid", "_pre", {"_def": "has_defuser"})
    b = b.withColumns({a: F.coalesce(a, f"_t{a}") for a in "xyz"})
    b = alive_counts(c, c.callout(b, "x", "y", "z", "callout"), "_pre")
    b = c.with_side(b, "steamid", "_side")
    carry, plant = F.col("_type").isin("bomb_drop", "bomb_pickup"), F.col("_type").startswith("plant")
    defuse = ~carry & ~plant
    p = F.struct(
        F.when(carry, F.col("callout")).alias("callout"), F.when(plant, F.col("site")).alias("site"),
        F.when(plant, F.col("callout")).alias("planter_callout"), F.when(defuse, F.coalesce("kit", "_def")).alias("kit"),
        F.when(~carry, F.col("ct_alive")).alias("ct_alive"), F.when(~carry, F.col("t_alive")).alias("t_alive"))
    return instant(b, F.col("_type"), "steamid", "tick", p, "_side")


# economy


def extract_buys(c: Context) -> DataFrame:
    """Loadout of every living player at freeze end."""
    fe = c.rounds.select(*ROUND, F.col("freeze_end_tick").alias("_fe"))
    who = c.sides.join(fe, ROUND)
    for n, t in (("inventory", "array<string>"), ("has_helmet", "boolean"), ("has_defuser", "boolean")):
        assert n in c.feed["ticks"].columns, n
    cols = {"_alive": "is_alive", "_inv": "inventory", "_eq": "equipment_value", "_m1": "money", "_armor": "armor", "_helm": "has_helmet", "_kit": "has_defuser"}
    who = c.at(who, "steamid", "_fe", cols)
    first = c.feed["ticks"].groupBy(*ROUND, "steamid").agg(F.min_by("money", "tick").alias("_m0"))
    who = who.where("_alive").join(first, [*ROUND, "steamid"], "left")
    nades = [grenade_count(F.col("_inv"), f) for f in sorted(set(NADE_FIELDS.values()))]
    total = nades[0]
    for n in nades[1:]:
        total = total + n
    p = F.struct(
        loadout_class(F.col("_eq")).alias("loadout_class"), F.col("_eq").cast("bigint").alias("equip_value"), F.col("_m0").cast("bigint").alias("money_before"),
        F.col("_m1").cast("bigint").alias("money_after"), (F.col("_armor") > 0).alias("has_armor"), F.col("_helm").alias("has_helmet"),
        F.col("_kit").alias("has_kit"), total.alias("utility_count"), primary_class(F.col("_inv")).alias("primary_class"))
    out = instant(who, "buy", "steamid", "_fe", p, "side")
    return out.withColumns({"kind": F.lit("round"), "state_pre_tick": F.col("tick"), "state_post_tick": F.col("tick")})


def team_buys(buys: DataFrame) -> DataFrame:
    """Most frequent loadout class per side (the higher band on ties) and the total, null when one is unknown."""
    bands = F.create_map(*[F.lit(x) for i, b in enumerate(S.BAND_ORDER) for x in (b, i)])
    b = buys.withColumns({"_c": F.col("p.loadout_class"), "_e": F.col("p.equip_value")})
    per = b.groupBy(*ROUND, "actor_side", "tick", "_c").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_e").alias("_s"), (F.count(F.lit(1)) - F.count("_e")).alias("_unk"))
    rank = F.when(F.col("_c").isNotNull(), F.struct(F.col("_n"), F.element_at(bands, F.col("_c"))))
    t = per.groupBy(*ROUND, "actor_side", "tick").agg(F.max_by("_c", rank).alias("team_class"), F.sum("_s").alias("_s"), F.sum("_unk").alias("_u"))
    p = F.struct("team_class", F.when(F.col("_u") == 0, F.col("_s")).alias("total_equip"))
    none = F.lit(None)
    return t.select(
        *ROUND, none.cast("bigint").alias("actor_id_hash"), "actor_side", F.lit("round").alias("kind"), F.lit("team_buy").alias("type"),
        none.cast("string").alias("subtype"), "tick", none.cast("bigint").alias("window_start_tick"), none.cast("bigint").alias("window_end_tick"),
        p.alias("p"), F.col("tick").alias("state_pre_tick"), F.col("tick").alias("state_post_tick"), F.col("actor_side").alias("salt"))


def give_pairs(c: Context) -> DataFrame:
    """Candidate (drop, pickup) pairs: same item, a teammate, within five seconds, the dropper alive one tick later."""
    win = int(round(S.ACTIONS["give_window_s"] * c.feed.tick_rate))
    it = c.feed.in_round("items", "tick").withColumn("_item", short_name(F.col("item"))).where("_item is not null")
    it = check_round(c.with_side(it, "steamid", "_side", "inner"), c.rounds)
    d = it.where((F.col("event") == "drop") & ~F.col("_item").isin("c4", "planted_c4")).select(
        *ROUND, "_side", "_item", F.col("tick").alias("drop_tick"), F.col("steamid").alias("giver")).distinct()
    d = d.withColumn("_next", F.col("drop_tick") + 1)
    d = c.at(d, "giver", "_next", {"_alive": "is_alive"}).where("_alive").drop("_alive", "_next")
    p = it.where(F.col("event") == "pickup").select(*ROUND, "_side", "_item", F.col("tick").alias("pickup_tick"), F.col("steamid").alias("taker")).distinct()
    d = d.withColumns({"_lo": F.col("drop_tick") + 1, "_hi": F.col("drop_tick") + win})
    out = range_join(d, p, [*ROUND, "_side", "_item"], "_lo", "_hi", "pickup_tick", max(win, 64))
    return out.where(F.col("taker") != F.col("giver")).drop("_lo", "_hi")


def extract_drops(c: Context) -> DataFrame:
    """Weapon gives: each drop, in time order, takes the first free pickup."""
    by = [*ROUND, "_side", "_item"]
    m = interval_match(give_pairs(c), by, ["drop_tick", "giver"], ["pickup_tick", "taker"], ["drop_tick"], ["pickup_tick"], "pickup_tick", c.feed.width)
    p = F.struct(weapon_class(F.col("_item")).alias("weapon_class"), PID(F.col("taker")).alias("receiver_id"), "pickup_tick")
    out = instant(m, "drop", "giver", "drop_tick", p, "_side", salt=PID(F.col("taker")))
    return out.withColumn("state_post_tick", F.col("p.pickup_tick") + S.SAMPLING["boundary_offset_ticks"])


# registry and stages

EVENT_EXTRACTORS: dict[str, Callable[[Context], DataFrame]] = {
    "kill": extract_kills, "damage": extract_damage, "flash": extract_flashes, "he": extract_he, "smoke": extract_smokes,
    "molotov": extract_molotovs, "decoy": extract_decoys, "bomb": extract_bomb, "drop": extract_drops,
}


def register(name: str, fn: Callable[[Context], DataFrame]) -> None:
    """Add an extractor of a user's own: it gets the context and returns instant or durative rows."""
    if name in EVENT_EXTRACTORS and EVENT_EXTRACTORS[name] is not fn:
        raise ValueError(f"an extractor named {name!r} is already registered")
    EVENT_EXTRACTORS[name] = fn


def extract_events(feed: Feed) -> DataFrame:
    """Every action readable from the raw tables alone, pseudo-actions included.

    The extractors share no work, so each one's (small) result is cut from its lineage.
    """
    c = Context(feed)
    parts = [durable(to_actions(fn(c))) for fn in EVENT_EXTRACTORS.values()]
    buys = durable(extract_buys(c))
    parts += [to_actions(buys), to_actions(team_buys(buys))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(pseudo_actions(out, c.rounds))


# checks


def duplicate_ids(actions: DataFrame) -> DataFrame:
    """Action ids that occur more than once (should be empty)."""
    return actions.groupBy("action_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def invalid_actions(actions: DataFrame) -> DataFrame:
    """Actions whose kind, type, side or timing disagree, with the failing rules."""
    kinds = F.create_map(*[F.lit(x) for kv in schemas.TYPE_KIND.items() for x in kv])
    ws, we, t = F.col("window_start_tick"), F.col("window_end_tick"), F.col("tick")
    k = F.col("kind")
    meta = F.col("type") == "damage"
    bad = lambda cond, msg: F.when(F.coalesce(cond, F.lit(False)), F.lit(msg))
    rules = F.array_compact(F.array(
        bad(~F.col("action_id").rlike("^[0-9a-f]{16}$"), "action_id"),
        bad(F.try_element_at(kinds, F.col("type")).isNull(), "unknown type"),
        bad(F.try_element_at(kinds, F.col("type")) != k, "kind does not match type"),
        bad(~F.col("actor_side").isin("ct", "t") | F.col("actor_side").isNull(), "actor_side"),
        bad(F.col("actor_id_hash").isNull() & (F.col("type") != "team_buy"), "no actor"),
        bad(k.isin("instant", "round") & t.isNull(), "no tick"),
        bad((k == "instant") & ~meta & (ws.isNotNull() | we.isNotNull()), "instant with window"),
        bad(meta & ((ws.isNull() != we.isNull()) | (ws != t) | (we < ws)), "window metadata"),
        bad((k == "durative") & (ws.isNull() | we.isNull() | (ws > we)), "window"),
        bad((k == "durative") & (t != ws), "durative tick"), bad((k == "round") & (ws.isNotNull() | we.isNotNull()), "round with window"),
        bad(F.col("state_pre_tick") > F.col("state_post_tick"), "state ticks")))
    return actions.withColumn("problems", rules).where(F.size("problems") > 0)
