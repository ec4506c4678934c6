"""Event feeds to the twelve typed tables.

Inputs are plain event frames with a ``match_key``; column names follow the decoder's
(`tick`, `steamid`, `attacker_steamid`, ...).  A column the feed lacks is a typed null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.exprs import dist, map_values, side_of, tick_rate_of
from ..functions.weapons import all_knives
from .feed import ROUND
from .scan import Run, asof, probe, range_join, scan, segments

WIDTH = 4096
PLAYER = ROUND + ["steamid"]

# fixed values: feed names to table names
GRENADE_TYPES = {
    "smoke": "smoke", "smokegrenade": "smoke", "flashbang": "flash", "flash": "flash", "he": "he",
    "hegrenade": "he", "molotov": "molotov", "incendiary": "incendiary", "incgrenade": "incendiary",
    "inferno": "molotov", "decoy": "decoy",
}
BOMB_EVENTS = {
    "start_plant": "plant_start", "finish_plant": "plant_complete", "defuse": "defuse_complete",
    "pickup": "pickup", "drop": "drop",
}
EXPLODE_REASONS = ["target_bombed", "bomb_exploded"]
# fixed values: limits of the quarantine rules, tolerances in seconds, segments of an id
QUARANTINE = {"tick_rate": 128.0, "tol": 0.5, "min_rounds": 13, "per_side": 5, "min_s": 720.0, "max_s": 18000.0}
LINK_TOL_S, SEGMENT_GAP_S, DEFUSE_TOL_S, ID_SEGMENTS = 20.0, 8 / 128, 4 / 128, 16


def first_col(df: DataFrame, *names: str, type: str = "string") -> Column:
    """First of the named columns the frame has, cast softly; else a typed null."""
    for n in names:
        if n in df.columns:
            return F.col(n).try_cast(type)
    return F.lit(None).cast(type)


def frame_side(df: DataFrame, *names: str) -> Column:
    """Normalised side of the first of the named columns."""
    return side_of(first_col(df, *names))


def drop_unmapped(df: DataFrame, column: str, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose value maps, and the count of those that do not, per match."""
    out = df.withColumn("_mapped", map_values(F.col(column), mapping))
    bad = out.where(F.col("_mapped").isNull()).groupBy("match_key").agg(F.count(F.lit(1)).alias("n_dropped"))
    return out.where(F.col("_mapped").isNotNull()).withColumn(column, F.col("_mapped")).drop("_mapped"), bad


# rounds


def round_base(r: DataFrame) -> DataFrame:
    """Rounds with coalesced bounds ``_lo`` / ``_hi`` and the winner from either column."""
    winner = F.coalesce(frame_side(r, "winner_side"), frame_side(r, "winner"))
    return r.select(
        "match_key",
        first_col(r, "round_num", type="int").alias("round_num"),
        *[first_col(r, c, type="bigint").alias(c) for c in ("start_tick", "freeze_end_tick", "end_tick", "official_end_tick")],
        winner.alias("winner_side"),
        first_col(r, "reason_name", "reason", "end_reason").alias("end_reason"),
        first_col(r, "is_knife_round", type="boolean").alias("is_knife"),
    ).withColumns({
        "_lo": F.coalesce("start_tick", "freeze_end_tick", "end_tick"),
        "_hi": F.coalesce("official_end_tick", "end_tick"),
    })


def assign_round(events: DataFrame, rounds: DataFrame, tick: str = "tick", width: int = WIDTH) -> DataFrame:
    """Round of each event by tick; events outside every round are dropped.

    A round gives way to the next one from that one's start on, so the spans are disjoint
    and the join gives at most one round per event.
    """
    base = rounds if "_lo" in rounds.columns else round_base(rounds)
    nxt = F.lead("_lo").over(Window.partitionBy("match_key").orderBy("_lo", "round_num"))
    spans = base.where(F.col("_lo").isNotNull()).select(
        "match_key", F.col("round_num").alias("_rn"), F.col("_lo"), F.least(F.col("_hi"), nxt - 1).alias("_hi"))
    src = events.drop("round_num").withColumn(tick, F.col(tick).cast("bigint"))
    out = range_join(spans, src, ["match_key"], "_lo", "_hi", tick, width)
    return out.withColumnRenamed("_rn", "round_num").drop("_lo", "_hi")


# ticks


def interval_pairs(events: DataFrame, keys: Sequence[str], tick: str, is_start: Column, is_end: Column, end: str, width: int = WIDTH) -> DataFrame:
    """Every start event with the tick of the next end event at or after it (null when none)."""
    order = F.when(is_end, 1).otherwise(0)
    rows = events.where(is_start | is_end).withColumns({"_s": is_start, "_e": is_end, "_o": order})
    out = scan(rows, keys, [tick, "_o"], [Run(end, "min", F.when(F.col("_e"), F.col(tick)), past=False)], width)
    return out.where("_s").drop("_s", "_e", "_o")


def plant_intervals(bomb: DataFrame, rounds: DataFrame, width: int = WIDTH) -> DataFrame:
    """Spans [plant start, finish or interrupt) per player; an open one ends with its round."""
    ev = F.lower("event")
    pairs = interval_pairs(bomb, PLAYER, "tick", ev == "start_plant", ev.isin("finish_plant", "interrupt_plant"), "_pe", width)
    pairs = pairs.join(rounds.select(*ROUND, "_hi"), ROUND, "left")
    return pairs.select(*PLAYER, "tick", F.coalesce("_pe", "_hi").alias("plant_end"))


def remaining_flash(ticks: DataFrame, flashes: DataFrame | None, tick_rate: int | None, width: int = WIDTH) -> DataFrame:
    """Blind seconds left at each tick from the player's latest blind; null without the feed."""
    if flashes is None or not tick_rate:
        return ticks.withColumn("flash_duration", F.lit(None).cast("float"))
    b = flashes.where(F.col("player_steamid").isNotNull()).select(
        "match_key", F.col("player_steamid").alias("steamid"), F.col("detonate_tick").alias("_bt"),
        F.col("blind_duration").alias("_bd"))
    out = asof(ticks.drop("flash_duration"), b, ["match_key", "steamid"], "tick", "_bt", ["_bd"], width=width, right_tick="_bt")
    left = F.col("_bd") - (F.col("tick") - F.col("_bt")) / F.lit(float(tick_rate))
    return out.withColumn("flash_duration", F.greatest(F.lit(0.0), F.coalesce(left, F.lit(0.0))).cast("float")).drop("_bt", "_bd")


def dead_rows(ticks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Dead players keep rows: last alive position, health 0, nothing in hand, not blind."""
    alive = F.coalesce(F.col("is_alive"), F.lit(False))
    spot = F.when(alive, F.struct("x", "y", "z"))
    out = scan(ticks, PLAYER, ["tick"], [Run("_pos", "last", spot)], width)
    empty = F.slice("inventory", 1, 0)
    return out.withColumns({
        "x": F.col("_pos.x"), "y": F.col("_pos.y"), "z": F.col("_pos.z"),
        "health": F.when(alive, F.col("health")).otherwise(0),
        "active_weapon": F.when(alive, F.col("active_weapon")),
        "inventory": F.when(alive, F.col("inventory")).otherwise(empty),
        "equipment_value": F.when(alive, F.col("equipment_value")).otherwise(0),
        "flash_duration": F.when(alive, F.col("flash_duration")).otherwise(F.lit(0.0)),
    }).drop("_pos")


def health_missing(ticks: DataFrame) -> DataFrame:
    """Matches whose health is null on every row: the feed has no health column, refuse them."""
    return ticks.groupBy("match_key").agg(F.count("health").alias("n")).where("n = 0").select("match_key")


def enemy_hits(df: DataFrame, team_flag: str) -> DataFrame:
    """Hits by a known attacker on somebody else that are known not to be team hits."""
    return df.where(
        F.col("attacker_steamid").isNotNull()
        & (F.col(team_flag) == F.lit(False))
        & (F.col("attacker_steamid") != F.col("victim_steamid"))
    ).withColumn("steamid", F.col("attacker_steamid"))


def build_ticks(snap: DataFrame, kills: DataFrame, damages: DataFrame, plants: DataFrame | None,
                flashes: DataFrame | None, tick_rate: int | None, width: int = WIDTH) -> DataFrame:
    """Player rows of the match with running kills and damage, planting flag and blindness."""
    s = snap.where(frame_side(snap, "side").isNotNull())
    health = first_col(s, "health", type="int")
    floats = {"x": "x", "y": "y", "z": "z", "yaw": "yaw", "pitch": "pitch", "vx": "velocity_x", "vy": "velocity_y", "vz": "velocity_z"}
    flags = {"has_helmet": "has_helmet", "has_defuser": "has_defuser", "has_c4": "has_bomb", "is_scoped": "is_scoped",
             "is_ducking": "is_crouched", "is_walking": "is_walking", "is_reloading": "is_reloading", "is_defusing": "is_defusing"}
    t = s.select(
        *ROUND, "tick", "steamid", first_col(s, "name").alias("name"), frame_side(s, "side").alias("side"),
        *[first_col(s, c, type="float").alias(n) for n, c in floats.items()],
        health.alias("health"), first_col(s, "armor", type="int").alias("armor"),
        *[first_col(s, c, type="boolean").alias(n) for n, c in flags.items()],
        F.coalesce(health > 0, F.lit(False)).alias("is_alive"),
        first_col(s, "active_weapon").alias("active_weapon"),
        first_col(s, "inventory", type="array<string>").alias("inventory"),
        first_col(s, "money", type="int").alias("money"),
        first_col(s, "equipment_value", type="int").alias("equipment_value"),
        F.lit(None).cast("array<bigint>").alias("spotted_by"),
    )
    k, d = enemy_hits(kills, "team_kill"), enemy_hits(damages, "team_damage")
    n, hp = Run("kills_round", "sum", F.lit(1)), Run("damage_round", "sum", F.coalesce("dmg_health", F.lit(0)).cast("bigint"))
    t = probe(t, k, PLAYER, "tick", "tick", [n], width=width)
    t = probe(t, d, PLAYER, "tick", "tick", [hp], width=width)
    t = t.fillna(0, ["kills_round", "damage_round"])
    if plants is None:
        t = t.withColumn("is_planting", F.lit(None).cast("boolean"))
    else:
        t = asof(t, plants, PLAYER, "tick", "tick", ["plant_end"], width=width)
        t = t.withColumn("is_planting", F.coalesce(F.col("tick") < F.col("plant_end"), F.lit(False))).drop("plant_end")
    return dead_rows(remaining_flash(t, flashes, tick_rate, width), width)


# events


def build_kills(k: DataFrame, snap: DataFrame) -> DataFrame:
    """Kills: assist split from flash assist, tri-state team flag, 3D distance, blind flags."""
    ids = {p: first_col(k, f"{p}_steamid", type="bigint") for p in ("attacker", "victim", "assister")}
    flash = F.coalesce(first_col(k, "assistedflash", type="boolean"), F.lit(False))
    a_side, v_side = frame_side(k, "attacker_side"), frame_side(k, "victim_side")
    team = (
        F.when(ids["attacker"].isNull(), False)
        .when(a_side.isNull() | v_side.isNull(), F.lit(None))
        .otherwise((a_side == v_side) & (ids["attacker"] != ids["victim"]))
    )
    pos = {f"{p}_{c}": first_col(k, f"{p}_{c}", type="float") for p in ("attacker", "victim") for c in "xyz"}
    out = k.select(
        *ROUND, "tick", ids["attacker"].alias("attacker_steamid"), ids["victim"].alias("victim_steamid"),
        F.when(~flash, ids["assister"]).alias("assister_steamid"),
        F.when(flash, ids["assister"]).alias("flash_assister_steamid"),
        first_col(k, "weapon").alias("weapon"), first_col(k, "headshot", type="boolean").alias("headshot"),
        first_col(k, "penetrated", type="smallint").alias("penetrated"),
        first_col(k, "thrusmoke", "through_smoke", type="boolean").alias("through_smoke"),
        first_col(k, "attackerblind", "attacker_blind", type="boolean").alias("_ab"),
        first_col(k, "noscope", type="boolean").alias("noscope"),
        *[c.alias(n) for n, c in pos.items()], team.alias("team_kill"),
    )
    a, v = ([F.col(f"{p}_{c}") for c in "xyz"] for p in ("attacker", "victim"))
    out = out.withColumn("distance", dist(a, v).cast("float"))
    if "is_blinded" not in snap.columns:
        return out.withColumns({"attacker_blind": F.col("_ab"), "victim_blind": F.lit(None).cast("boolean")}).drop("_ab")
    blind = snap.groupBy("match_key", "tick", "steamid").agg(F.first("is_blinded").cast("boolean").alias("_blind"))
    for who, name in (("attacker", "_ab2"), ("victim", "victim_blind")):
        side = blind.select("match_key", "tick", F.col("steamid").alias(f"{who}_steamid"), F.col("_blind").alias(name))
        out = out.join(side, ["match_key", "tick", f"{who}_steamid"], "left")
    return out.withColumn("attacker_blind", F.coalesce("_ab", "_ab2")).drop("_ab", "_ab2")


def build_damages(d: DataFrame) -> DataFrame:
    """Damages with a tri-state team flag (null when a side is unknown)."""
    return d.select(
        *ROUND, "tick", first_col(d, "attacker_steamid", type="bigint").alias("attacker_steamid"),
        first_col(d, "victim_steamid", type="bigint").alias("victim_steamid"), first_col(d, "weapon").alias("weapon"),
        first_col(d, "dmg_health", type="smallint").alias("dmg_health"),
        first_col(d, "dmg_armor", type="smallint").alias("dmg_armor"),
        first_col(d, "hitgroup_name", "hitgroup").alias("hitgroup"),
        (frame_side(d, "attacker_side") == frame_side(d, "victim_side")).alias("team_damage"),
    )


def entity_key(df: DataFrame) -> Column:
    """One id per entity: slot plus generation."""
    eid, serial = first_col(df, "entity_id", type="bigint"), first_col(df, "entity_serial", type="bigint")
    return F.when(serial.isNull(), eid).otherwise(serial * 65536 + eid)


def collapse_segments(rows: DataFrame, keys: Sequence[str], tick: str, gap: int | None, width: int = WIDTH) -> DataFrame:
    """Trajectory segments of an entity: a distance above ``gap`` ticks opens a new one.

    ``segment`` is the first tick of the segment; without a gap an entity has one.
    """
    far = (lambda c, p: F.lit(False)) if gap is None else (lambda c, p: c[tick] - p[tick] > gap)
    return segments(rows, keys, [tick], [tick], far, "segment", width)


def collapse_grenades(g: DataFrame, rounds: DataFrame, tick_rate: int | None, width: int = WIDTH) -> DataFrame:
    """Trajectory rows to one row per throw: first and last tick, last position, first tick at rest."""
    rows = g.select(
        "match_key", F.col("tick").cast("bigint").alias("tick"), entity_key(g).alias("_key"),
        map_values(first_col(g, "type", "grenade_type"), GRENADE_TYPES).alias("type"),
        first_col(g, "thrower_steamid", type="bigint").alias("thrower_steamid"),
        *[first_col(g, c, type="float").alias(c) for c in "xyz"])
    gap = int(round(SEGMENT_GAP_S * tick_rate)) if tick_rate else None
    rows = collapse_segments(rows, ["match_key", "_key"], "tick", gap, width)
    seg = ["match_key", "_key", "segment"]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("tick")))
    ends = rows.groupBy(*seg).agg(
        first("thrower_steamid").alias("thrower_steamid"), first("type").alias("type"),
        F.min("tick").alias("throw_tick"), F.max("tick").alias("last_tick"),
        F.max_by(F.struct("x", "y", "z"), "tick").alias("_p"))
    at_rest = rows.join(ends.select(*seg, "_p"), seg).where(F.struct("x", "y", "z") == F.col("_p"))
    rest = at_rest.groupBy(*seg).agg(F.min("tick").alias("rest_tick"))
    ends = scan(ends, ["match_key", "_key"], ["segment"], [Run("_ord", "sum", F.lit(1))], width)
    out = ends.join(rest, seg, "left").select(
        "match_key", (F.col("_key") * ID_SEGMENTS + F.least(F.col("_ord") - 1, F.lit(ID_SEGMENTS - 1))).alias("entity_id"),
        "thrower_steamid", "type", "throw_tick", "last_tick", "rest_tick",
        F.col("_p.x").alias("lx"), F.col("_p.y").alias("ly"), F.col("_p.z").alias("lz"))
    return assign_round(out, rounds, "throw_tick", width)


def link(events: DataFrame, throws: DataFrame, types: Sequence[str], tick: str, owner: str, tol: int | None,
         throw_tick: str = "throw_tick", direction: str = "backward", width: int = WIDTH) -> DataFrame:
    """Entity id of the owner's throw next to each event (latest before it, or nearest)."""
    cand = throws.where(F.col("type").isin(*types) & F.col("thrower_steamid").isNotNull()).select(
        "match_key", F.col("thrower_steamid").alias(owner), F.col(throw_tick).alias("_tt"), F.col("entity_id").alias("link_id"))
    return asof(events, cand, ["match_key", owner], tick, "_tt", ["link_id"], width=width, direction=direction, tolerance=tol)


def area_frame(f: DataFrame, rounds: DataFrame, throws: DataFrame, types: Sequence[str], tol: int | None, width: int = WIDTH) -> DataFrame:
    """Clouds and fires with their linked throw."""
    rows = f.select(
        "match_key", entity_key(f).alias("own_id"), first_col(f, "start_tick", type="bigint").alias("start_tick"),
        first_col(f, "end_tick", type="bigint").alias("end_tick"),
        *[first_col(f, c, type="float").alias(c) for c in "xyz"],
        first_col(f, "thrower_steamid", type="bigint").alias("thrower_steamid"),
        map_values(first_col(f, "type"), GRENADE_TYPES).alias("area_type"))
    return link(assign_round(rows, rounds, "start_tick", width), throws, types, "start_tick", "thrower_steamid", tol, width=width)


def build_utility(grenade_rows: DataFrame, smokes: DataFrame, fires: DataFrame, blinds: DataFrame | None,
                  rounds: DataFrame, tick_rate: int | None, width: int = WIDTH) -> dict[str, DataFrame]:
    """grenades, smokes, infernos and flashes that share entity ids."""
    tol = int(LINK_TOL_S * tick_rate) if tick_rate else None
    throws = collapse_grenades(grenade_rows, rounds, tick_rate, width)
    smk = area_frame(smokes, rounds, throws, ["smoke"], tol, width)
    fir = area_frame(fires, rounds, throws, ["molotov", "incendiary"], tol, width)
    first = F.min_by(F.struct("start_tick", "end_tick", "x", "y", "z", "area_type"), F.struct("start_tick", "own_id")).alias("_a")
    area = smk.unionByName(fir).where(F.col("link_id").isNotNull()).groupBy("match_key", F.col("link_id").alias("entity_id")).agg(first)
    g = throws.join(area, ["match_key", "entity_id"], "left")
    fire_type = F.col("type").isin("molotov", "incendiary") & F.col("_a.area_type").isin("molotov", "incendiary")
    decoy = F.col("type") == "decoy"
    g = g.select(
        "match_key", "round_num", "entity_id", "thrower_steamid",
        F.when(fire_type, F.col("_a.area_type")).otherwise(F.col("type")).alias("type"), "throw_tick",
        F.coalesce("_a.start_tick", F.when(decoy, F.coalesce("rest_tick", "last_tick")).otherwise(F.col("last_tick"))).alias("detonate_tick"),
        F.when(decoy, F.col("last_tick")).otherwise(F.col("_a.end_tick")).alias("expire_tick"),
        *[F.coalesce(f"_a.{c}", f"l{c}").alias(c) for c in "xyz"])
    own = F.coalesce("link_id", "own_id").alias("entity_id")
    cols = ["match_key", "round_num", own, "start_tick", "end_tick", "x", "y", "z"]
    out = {
        "grenades": g,
        "smokes": smk.select(*cols, "thrower_steamid"),
        "infernos": fir.select(*cols, F.lit(None).cast("float").alias("extent_radius"), "thrower_steamid"),
    }
    if blinds is None:
        out["flashes"] = schemas.empty(g.sparkSession, "flashes")
        return out
    b = blinds.select(
        "match_key", F.col("tick").cast("bigint").alias("detonate_tick"),
        first_col(blinds, "attacker_steamid", type="bigint").alias("attacker_steamid"),
        first_col(blinds, "victim_steamid", type="bigint").alias("player_steamid"),
        first_col(blinds, "duration", type="float").alias("blind_duration"))
    b = link(assign_round(b, rounds, "detonate_tick", width), throws, ["flash"], "detonate_tick", "attacker_steamid", tol,
             "last_tick", "nearest", width)
    out["flashes"] = b.select("match_key", "round_num", F.col("link_id").alias("entity_id"), "detonate_tick", "player_steamid", "blind_duration")
    return out


# bomb


def flag_edges(rows: DataFrame, keys: Sequence[str], tick: str, flag: str, width: int = WIDTH) -> DataFrame:
    """Rising and last-true rows of a boolean per key: columns ``is_rise`` and ``is_last``."""
    d = rows.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    near = [Run("_was", "last", F.col(flag), inclusive=False), Run("_next", "last", F.col(flag), past=False, inclusive=False)]
    d = scan(d, keys, [tick], near, width)
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return d.withColumns({"is_rise": F.col(flag) & off("_was"), "is_last": F.col(flag) & off("_next")}).drop("_was", "_next")


def defuse_events(snap: DataFrame, completes: DataFrame, tick_rate: int | None, width: int = WIDTH) -> DataFrame:
    """Start at each rising edge of the defusing flag; abort one tick after a falling edge
    with no completion of the round within the tolerance."""
    tol = int(round(DEFUSE_TOL_S * tick_rate)) if tick_rate else 0
    d = flag_edges(
        snap.select(*PLAYER, "tick", first_col(snap, "is_defusing", type="boolean").alias("_d"),
                    first_col(snap, "has_defuser", type="boolean").alias("has_kit"),
                    *[first_col(snap, c, type="float").alias(c) for c in "xyz"]), PLAYER, "tick", "_d", width)
    cols = [*PLAYER, "tick", "has_kit", "x", "y", "z"]
    starts = d.where("is_rise").select(*cols, F.lit("defuse_start").alias("event"))
    near = completes.select(*ROUND, (F.col("tick") - tol).alias("_lo"), (F.col("tick") + tol).alias("_hi")).distinct()
    lasts = d.where("is_last")
    done = range_join(near, lasts.select(*PLAYER, "tick"), ROUND, "_lo", "_hi", "tick", max(1, 2 * tol + 1)).select(*PLAYER, "tick").distinct()
    aborts = lasts.join(done, [*PLAYER, "tick"], "left_anti").select(
        *PLAYER, (F.col("tick") + 1).alias("tick"), F.lit(None).cast("boolean").alias("has_kit"), "x", "y", "z",
        F.lit("defuse_abort").alias("event"))
    return starts.unionByName(aborts)


def build_bomb(bomb_raw: DataFrame, rounds: DataFrame, snap: DataFrame, tick_rate: int | None, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Bomb events from three sources, and the dropped-row counts."""
    base, dropped = drop_unmapped(bomb_raw, "event", BOMB_EVENTS)
    done = base.where(F.col("event") == "defuse_complete")
    kit = snap.groupBy("match_key", "tick", "steamid").agg(F.first(first_col(snap, "has_defuser", type="boolean")).alias("_kit"))
    base = base.join(kit, ["match_key", "tick", "steamid"], "left").withColumn(
        "has_kit", F.when(F.col("event") == "defuse_complete", F.col("_kit"))).drop("_kit")
    plants = base.where(F.col("event") == "plant_complete").groupBy(*ROUND).agg(
        F.max_by(F.struct("site", "x", "y", "z"), "tick").alias("_p"))
    plants = plants.select(*ROUND, F.col("_p.site").alias("site"), *[F.col(f"_p.{c}").alias(f"p{c}") for c in "xyz"])
    defuses = defuse_events(snap, done, tick_rate, width).join(plants.select(*ROUND, "site"), ROUND, "left")
    boom = rounds.where(F.lower("end_reason").isin(*EXPLODE_REASONS)).select(*ROUND, F.col("end_tick").alias("tick"))
    boom = boom.join(plants, ROUND, "left").select(
        *ROUND, "tick", F.lit("explode").alias("event"), "site", *[F.col(f"p{c}").alias(c) for c in "xyz"])
    cols = [*ROUND, "tick", "event", "steamid", "site", "has_kit", "x", "y", "z"]
    out = base.select(*cols).unionByName(defuses.select(*cols)).unionByName(boom, allowMissingColumns=True)
    return out, dropped


# simple tables


def simple_table(f: DataFrame, rounds: DataFrame, columns: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """Tick-keyed events cut to the rounds, with the given columns."""
    out = assign_round(f, rounds, "tick", width)
    return out.select("match_key", "round_num", "tick", *[c.alias(n) for n, c in columns.items()])


def build_items(f: DataFrame, rounds: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Item drops and pickups; other actions are dropped and counted."""
    f = f.withColumn("_act", first_col(f, "action", "event"))
    keep, dropped = drop_unmapped(f, "_act", {"drop": "drop", "pickup": "pickup"})
    cols = {"steamid": F.col("steamid"), "event": F.col("_act"), "item": F.col("item")}
    return simple_table(keep, rounds, cols, width), dropped


def build_footsteps(f: DataFrame, rounds: DataFrame, snap: DataFrame, width: int = WIDTH) -> DataFrame:
    """Footsteps with the walker's position at the same tick."""
    sid = first_col(f, "user_steamid", "userid_steamid", "player_steamid", "steamid", type="bigint")
    f = f.select("match_key", "tick", sid.alias("steamid")).where("steamid is not null")
    pos = snap.groupBy("match_key", "tick", "steamid").agg(*[F.first(c).alias(c) for c in "xyz"])
    out = simple_table(f, rounds, {"steamid": F.col("steamid")}, width)
    return out.join(pos, ["match_key", "tick", "steamid"], "left")


# rosters, scores, knife rounds


def first_tick_rows(ticks: DataFrame, rounds: DataFrame) -> DataFrame:
    """Player rows at each round's first tick at or after freeze end."""
    ref = rounds.select(*ROUND, F.coalesce("freeze_end_tick", "_lo" if "_lo" in rounds.columns else "start_tick").alias("_ref"))
    late = ticks.join(ref, ROUND).where(F.col("tick") >= F.col("_ref"))
    first = late.groupBy(*ROUND).agg(F.min("tick").alias("tick"))
    return ticks.join(first, [*ROUND, "tick"], "left_semi")


def side_rosters(snap: DataFrame, rounds: DataFrame) -> DataFrame:
    """Player sets per side at the first tick at or after freeze end."""
    s = first_tick_rows(snap, rounds).where("steamid is not null and steamid <> 0").withColumn("_side", frame_side(snap, "side"))
    ids = lambda side: F.array_sort(F.collect_set(F.when(F.col("_side") == side, F.col("steamid"))))
    return s.groupBy(*ROUND).agg(ids("ct").alias("ct"), ids("t").alias("t"))


def scores(rounds: DataFrame, rosters: DataFrame) -> DataFrame:
    """Score of the team on each side before each round, followed by roster across side swaps.

    Once a won round cannot be credited to a team every later score is unknown.
    """
    none = F.array().cast("array<bigint>")
    r = rounds.join(rosters, ROUND, "left").withColumns({"ct": F.coalesce("ct", none), "t": F.coalesce("t", none)})
    w = Window.partitionBy("match_key").orderBy("round_num")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    team_a = F.first(F.when(F.size("ct") > 0, F.col("ct")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    knife = F.coalesce(F.col("is_knife"), F.lit(False)) if "is_knife" in rounds.columns else F.lit(False)
    r = r.withColumns({"_a": team_a, "_won": ~knife & F.coalesce(F.col("winner_side").isin("ct", "t"), F.lit(False))})
    unknown = F.col("_a").isNull() | ((F.size("ct") + F.size("t")) == 0)
    a_is_ct = F.size(F.array_intersect("ct", "_a")) >= F.size(F.array_intersect("t", "_a"))
    r = r.withColumns({"_unk": unknown, "_a_ct": a_is_ct})
    r = r.withColumn("_lost", F.coalesce(F.max((F.col("_unk") & F.col("_won")).cast("int")).over(before), F.lit(0)))
    a_won = F.col("_won") & ~F.col("_unk") & ((F.col("winner_side") == "ct") == F.col("_a_ct"))
    b_won = F.col("_won") & ~F.col("_unk") & ((F.col("winner_side") == "ct") != F.col("_a_ct"))
    r = r.withColumns({
        "_wa": F.coalesce(F.sum(a_won.cast("int")).over(before), F.lit(0)),
        "_wb": F.coalesce(F.sum(b_won.cast("int")).over(before), F.lit(0)),
    })
    ok = (F.col("_lost") == 0) & ~F.col("_unk")
    return r.select(
        *ROUND,
        F.when(ok, F.when(F.col("_a_ct"), F.col("_wa")).otherwise(F.col("_wb"))).cast("int").alias("ct_score_before"),
        F.when(ok, F.when(F.col("_a_ct"), F.col("_wb")).otherwise(F.col("_wa"))).cast("int").alias("t_score_before"))


def knife_rounds(ticks: DataFrame, rounds: DataFrame) -> DataFrame:
    """Rounds in which every alive player holds only knives at the first tick after freeze end."""
    alive = ticks.where("is_alive")
    first = first_tick_rows(alive, rounds.where("freeze_end_tick is not null"))
    return first.groupBy(*ROUND).agg(F.bool_and(all_knives(F.col("inventory"))).alias("k")).where("k").select(*ROUND)


def drop_rounds(tables: dict[str, DataFrame], bad: DataFrame) -> dict[str, DataFrame]:
    """Remove rounds from every table that has a round and renumber the rest 1..n per match."""
    keep = tables["rounds"].join(bad, ROUND, "left_anti").select(*ROUND).distinct()
    new = F.row_number().over(Window.partitionBy("match_key").orderBy("round_num"))
    remap = keep.withColumn("_new", new)

    def one(df: DataFrame) -> DataFrame:
        if "round_num" not in df.columns:
            return df
        return df.join(remap, ROUND).withColumn("round_num", F.col("_new").cast("int")).drop("_new")

    return {name: one(df) for name, df in tables.items()}


def build_rounds(rounds: DataFrame, bomb: DataFrame, rosters: DataFrame) -> DataFrame:
    """Final rounds table: start tick fallback chain, planted flag, scores."""
    w = Window.partitionBy("match_key").orderBy("round_num")
    planted = bomb.where(F.col("event") == "plant_complete").select(*ROUND).distinct().withColumn("_pl", F.lit(True))
    out = rounds.withColumn("start_tick", F.coalesce("start_tick", F.lag("_hi").over(w), "freeze_end_tick"))
    out = out.join(planted, ROUND, "left").withColumn("bomb_planted", F.coalesce("_pl", F.lit(False)))
    out = out.join(scores(rounds, rosters), ROUND, "left")
    return out.select(*[c.name for c in schemas.table_schema("rounds").fields])


def side_counts(rosters: DataFrame) -> DataFrame:
    """Median number of players per side and match."""
    return rosters.groupBy("match_key").agg(
        F.median(F.size("ct")).cast("int").alias("n_ct"), F.median(F.size("t")).cast("int").alias("n_t"))


# quarantine and metadata


def basic_meta(header: DataFrame) -> DataFrame:
    """Metadata of a file header; the tick rate is null unless finite and positive."""
    raw = tick_rate_of(F.col("playback_ticks"), F.col("playback_time"))
    secs = F.col("playback_time").try_cast("double")
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return header.select(
        "match_key", blank("map_name").alias("map"), raw.alias("tick_rate_raw"), F.bround(raw).cast("int").alias("tick_rate"),
        blank("build_num").alias("game_version"), blank("server_name").alias("server"),
        F.when(secs > 0, secs).alias("duration_s"))


def quarantine_reason(cols: set[str], known_maps: Sequence[str], strict: bool = False) -> Column:
    """First failing rule of a match, null when it passes.

    A column the frame lacks is not judged, or fails in strict mode; a null value fails.
    """
    q = QUARANTINE

    def rule(needed: list[str], ok: Column, reason: str) -> Column:
        if not set(needed) <= cols:
            return F.lit(reason) if strict else F.lit(None).cast("string")
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason))

    rate = F.coalesce(F.col("tick_rate_raw"), F.col("tick_rate")) if "tick_rate_raw" in cols else F.col("tick_rate")
    return F.coalesce(
        rule(["tick_rate"], F.abs(rate - q["tick_rate"]) <= q["tol"], "tick_rate_not_128"),
        rule(["n_rounds"], F.col("n_rounds") >= q["min_rounds"], "too_few_rounds"),
        rule(["n_ct", "n_t"], (F.col("n_ct") == q["per_side"]) & (F.col("n_t") == q["per_side"]), "not_5v5"),
        rule(["map"], F.col("map").isin(*known_maps), "unknown_map"),
        rule(["duration_s"], F.col("duration_s").between(q["min_s"], q["max_s"]), "duration_implausible"),
    )


def quarantine(meta: DataFrame, known_maps: Sequence[str], strict: bool = False) -> DataFrame:
    return meta.withColumn("quarantine_reason", quarantine_reason(set(meta.columns), known_maps, strict))


def version_lookup(df: DataFrame, ranges: DataFrame, build: str, keys: Sequence[str], row_id: Sequence[str]) -> DataFrame:
    """First range (by ``pos``) of the key whose [build_min, build_max] holds the build, else ``unknown``.

    ``ranges``: keys, pos, build_min, build_max, version; an open end is null.  The
    distinct builds are matched, not the rows.
    """
    keys = list(keys)
    builds = df.select(*keys, build).distinct()
    hit = builds.join(ranges, keys).where(
        F.col(build).isNotNull()
        & (F.col("build_min").isNull() | (F.col(build) >= F.col("build_min")))
        & (F.col("build_max").isNull() | (F.col(build) <= F.col("build_max"))))
    first = hit.groupBy(*keys, build).agg(F.min_by("version", "pos").alias("map_version"))
    return df.join(first, [*keys, build], "left").fillna("unknown", ["map_version"])
