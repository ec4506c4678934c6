"""Movement actions from grid samples: peeks, rotations, holds and saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.exprs import dist
from .actions import PID, Context, durative, instant
from .feed import ROUND
from .sampling import GRID
from .scan import Run, asof, chain_spans, durable, previous, range_join, scan, segments
from .state import SAMPLE, States

PLAYER = ROUND + ["steamid"]


def grid_players(c: Context, st: States) -> DataFrame:
    """Player tokens at grid samples up to the round's end tick."""
    end = c.rounds.select(*ROUND, F.coalesce("end_tick", "terminal").alias("_end"))
    keep = st.samples.where(F.array_contains("kinds", GRID)).join(end, ROUND).where(F.col("tick") <= F.col("_end"))
    return st.players.join(keep.select(*SAMPLE), SAMPLE, "left_semi")


def alive_prefix(rows: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """Rows of a player before the first one where the player is dead."""
    keys = keys or PLAYER
    out = scan(rows, keys, ["tick"], [Run("_dead", "max", (F.col("alive") != 1).cast("int"))], width)
    return out.where("_dead = 0").drop("_dead")


# peeks


def first_spotted(c: Context, peeks: DataFrame, who: str, by: str, lo: str, hi: str, name: str) -> DataFrame:
    """First tick in [lo, hi] at which ``by`` is in the spotted-by list of ``who``."""
    t = c.feed["ticks"]
    if "spotted_by" not in t.columns:
        return peeks.withColumn(name, F.lit(None).cast("bigint"))
    seen = t.select(*ROUND, F.col("steamid").alias(who), F.col("tick").alias("_st"), F.explode("spotted_by").alias(by))
    hit = range_join(peeks.select(*ROUND, who, by, lo, hi).distinct(), seen, [*ROUND, who, by], lo, hi, "_st", c.feed.width)
    first = hit.groupBy(*ROUND, who, by, lo, hi).agg(F.min("_st").alias(name))
    return peeks.join(first, [*ROUND, who, by, lo, hi], "left")


def extract_peeks(c: Context, st: States) -> DataFrame:
    """An enemy pair becomes visible between two grid samples and one of them moved; the larger mover acts."""
    back = c.feed.ticks_in(S.ACTIONS["peek_lookback_s"])
    g = grid_players(c, st)
    ticks = g.select(*SAMPLE).distinct()
    ticks = previous(ticks, ROUND, ["tick"], {"_t0": "tick"}, c.feed.width).where("_t0 is not null")
    p = st.pairs.where("same_team = 0")
    vis = F.when(F.col("los").isNotNull() & F.col("smoke_between").isNotNull(), ((F.col("los") == 1) & (F.col("smoke_between") == 0)).cast("int"))
    p = p.withColumn("vis", vis).select(*SAMPLE, "a_slot", "b_slot", "vis")
    now = p.join(ticks, SAMPLE).where("vis = 1")
    was = p.where("vis = 0").select(*ROUND, F.col("tick").alias("_t0"), "a_slot", "b_slot")
    n = now.join(was, [*ROUND, "_t0", "a_slot", "b_slot"])
    me = lambda s: g.select(*SAMPLE, F.col("slot").alias(f"{s}_slot"), F.col("steamid").alias(f"{s}_sid"), F.col("side").alias(f"{s}_side"),
                            F.col("player_id").alias(f"{s}_pid"), F.col("callout").alias(f"{s}_callout"), *[F.col(a).alias(f"{s}_{a}1") for a in "xyz"])
    old = lambda s: g.select(*ROUND, F.col("tick").alias("_t0"), F.col("slot").alias(f"{s}_slot"), F.col("callout").alias(f"{s}_from"),
                             *[F.col(a).alias(f"{s}_{a}0") for a in "xyz"])
    n = n.withColumn("_back", F.col("tick") - back)
    for s in ("a", "b"):
        n = n.join(me(s), [*SAMPLE, f"{s}_slot"]).join(old(s), [*ROUND, "_t0", f"{s}_slot"])
        n = c.at(n, f"{s}_sid", "_back", {f"{s}_p{a}": a for a in "xyz"})
        n = c.at(n, f"{s}_sid", "tick", {f"{s}_q{a}": a for a in "xyz"})
        moved = dist([F.col(f"{s}_p{a}") for a in "xyz"], [F.col(f"{s}_q{a}") for a in "xyz"])
        grid = dist([F.col(f"{s}_{a}0") for a in "xyz"], [F.col(f"{s}_{a}1") for a in "xyz"])
        n = n.withColumn(f"{s}_d", F.coalesce(moved, grid))
    lim = S.ACTIONS["movement_min_units"]
    mover = lambda s: F.when(F.col(f"{s}_d") >= lim, F.struct(F.col(f"{s}_d").alias("d"), (-F.col(f"{s}_pid")).alias("k"), F.lit(s).alias("s")))
    n = n.withColumn("_m", F.greatest(mover("a"), mover("b"))).where("_m is not null")
    a_moves = F.col("_m.s") == "a"
    pick = lambda x, mine=True: F.when(a_moves if mine else ~a_moves, F.col(f"a_{x}")).otherwise(F.col(f"b_{x}"))
    n = n.select(*SAMPLE, (F.col("_t0") + 1).alias("_lo"), F.col("tick").alias("_hi"), pick("sid").alias("me"), pick("sid", False).alias("target"),
                 pick("side").alias("side"), pick("from").alias("from_callout"), pick("pid", False).alias("target_id"), pick("callout", False).alias("target_callout"))
    n = first_spotted(c, n, "me", "target", "_lo", "_hi", "_seen_me")
    n = first_spotted(c, n, "target", "me", "_lo", "_hi", "_seen_target")
    first = F.when(F.col("_seen_me").isNotNull() | F.col("_seen_target").isNotNull(),
                   F.col("_seen_me").isNotNull() & (F.col("_seen_target").isNull() | (F.col("_seen_me") < F.col("_seen_target"))))
    prm = F.struct("from_callout", "target_id", "target_callout", first.alias("target_spotted_me_first"))
    return instant(n, "peek", "me", "tick", prm, "side", salt=F.col("target_id"))


# rotations


def stays(samples: DataFrame, keys: list[str], place: str, width: int) -> DataFrame:
    """Runs of one place (null is a place too): first and last tick."""
    s = segments(samples, keys, ["tick"], [place], lambda c, p: ~c[place].eqNullSafe(p[place]), "stay", width)
    return s.groupBy(*keys, "stay").agg(F.first(place).alias(place), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))


def rotation_spans(stays_: DataFrame, keys: list[str], place: str, dwell: int, width: int) -> DataFrame:
    """Settled stays (at least ``dwell`` ticks in a known place) with the settled stay before them.

    The first stay of a player counts as settled.
    """
    opening = stays_.groupBy(*keys).agg(F.min("stay").alias("_open"))
    s = stays_.join(opening, keys)
    s = s.where((F.col("stay") == F.col("_open")) | (F.col(place).isNotNull() & (F.col("last_tick") - F.col("first_tick") >= dwell)))
    s = previous(s, keys, ["first_tick"], {"from_place": place, "from_tick": "last_tick"}, width)
    return s.where((F.col("stay") > F.col("_open")) & F.col("from_place").isNotNull() & (F.col("from_place") != F.col(place)))


def callout_centroids(grid: DataFrame) -> DataFrame:
    """Per match and callout: the observed living position closest to the mean position."""
    g = grid.where("alive = 1 and callout is not null and x is not null and y is not null and z is not null")
    key = ["match_key", "callout"]
    m = g.groupBy(*key).agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    g = g.join(m, key)
    d = dist([F.col(a) for a in "xyz"], [F.col(f"m{a}") for a in "xyz"])
    best = F.min_by(F.struct("x", "y", "z", "nav_area"), F.struct(d, F.col("x"), F.col("y"), F.col("z"))).alias("c")
    return g.groupBy(*key).agg(best).select(*key, "c.x", "c.y", "c.z", "c.nav_area")


def nav_or_dist(c: Context, df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Walking distance between two points with areas (``<p>x,y,z,nav_area``), else the straight line."""
    before = df.columns
    out = c.feed.geometry.pairs(df, f"{a}nav_area", f"{b}nav_area", "_nav", None)
    straight = dist([F.col(f"{a}{p}") for p in "xyz"], [F.col(f"{b}{p}") for p in "xyz"])
    return out.withColumn(name, F.coalesce("_nav", straight)).select(*before, name)


def bomb_position(c: Context, probes: DataFrame, tick: str) -> DataFrame:
    """Bomb position at a tick: plant spot, else the living carrier, else the last drop (``bx``, ``by``, ``bz``)."""
    b = c.feed["bomb"]
    at = probes.select(*ROUND, F.col(tick).alias("_bt")).distinct()
    pl = b.where(F.col("event") == "plant_complete").groupBy(*ROUND).agg(F.min_by(F.struct("x", "y", "z", "steamid", "tick"), "tick").alias("_p"))
    pl = pl.select(*ROUND, F.col("_p.tick").alias("_ptick"), F.col("_p.steamid").alias("_planter"), *[F.col(f"_p.{a}").alias(f"_p{a}") for a in "xyz"])
    pl = c.at(pl, "_planter", "_ptick", {f"_q{a}": a for a in "xyz"})
    spot = F.when(F.col("_px").isNotNull(), F.struct(*[F.col(f"_p{a}").cast("double").alias(a) for a in "xyz"])).otherwise(
        F.struct(*[F.col(f"_q{a}").cast("double").alias(a) for a in "xyz"]))
    out = at.join(pl.select(*ROUND, "_ptick", spot.alias("_plant")), ROUND, "left")
    who = at.join(c.sides.select(*ROUND, "steamid"), ROUND)
    who = c.at(who, "steamid", "_bt", {"_a": "is_alive", "_c4": "has_c4", **{f"_{a}": a for a in "xyz"}}).where("_a and _c4")
    who = who.groupBy(*ROUND, "_bt").agg(F.min_by(F.struct(*[F.col(f"_{a}").cast("double").alias(a) for a in "xyz"]), "steamid").alias("_carry"))
    d = b.where(F.col("event") == "drop").select(*ROUND, F.col("tick").alias("_dt"), F.struct(*[F.col(a).cast("double").alias(a) for a in "xyz"]).alias("_drop"))
    out = asof(out, d, ROUND, "_bt", "_dt", ["_drop"], width=c.feed.width).join(who, [*ROUND, "_bt"], "left")
    pos = F.when(F.col("_ptick") <= F.col("_bt"), F.col("_plant")).otherwise(F.coalesce("_carry", "_drop"))
    out = out.select(*ROUND, F.col("_bt").alias(tick), *[pos[a].alias(f"b{a}") for a in "xyz"])
    return c.feed.geometry.places(out, "bx", "by", "bz", "b").drop("bcallout", "bgrid_cell")


def extract_rotations(c: Context, st: States) -> DataFrame:
    """Moves between settled stays whose callouts are at least ``rotation_min_units`` apart."""
    rate = c.feed.tick_rate
    g = durable(alive_prefix(grid_players(c, st).where("steamid is not null"), c.feed.width))
    s = rotation_spans(stays(g, PLAYER, "callout", c.feed.width), PLAYER, "callout", c.feed.ticks_in(S.ACTIONS["rotation_dwell_s"]), c.feed.width)
    cen = callout_centroids(grid_players(c, st))
    end = lambda n, k: cen.select("match_key", F.col("callout").alias(k), *[F.col(p).alias(f"{n}{p}") for p in ("x", "y", "z", "nav_area")])
    s = s.withColumnRenamed("callout", "to_place").join(end("a", "from_place"), ["match_key", "from_place"], "left").join(end("b_", "to_place"), ["match_key", "to_place"], "left")
    s = nav_or_dist(c, s, "a", "b_", "units").where(F.col("units") >= S.ACTIONS["rotation_min_units"])
    s = durable(s.select(*PLAYER, "from_place", "to_place", "from_tick", F.col("first_tick").alias("to_tick"), "units"))
    for n, t in (("_d0", "from_tick"), ("_d1", "to_tick")):
        here = g.select(*PLAYER, F.col("tick").alias(t), "side", *[F.col(p).alias(f"p{p}") for p in ("x", "y", "z", "nav_area")])
        s = s.drop("side").join(here, [*PLAYER, t]).join(bomb_position(c, s, t), [*ROUND, t], "left")
        s = nav_or_dist(c, s, "p", "b", n).drop(*[f"{k}{p}" for k in "pb" for p in ("x", "y", "z", "nav_area")])
    prm = F.struct(
        F.col("from_place").alias("from_callout"), F.col("to_place").alias("to_callout"), F.bround("units", 3).alias("nav_dist_units"),
        F.bround((F.col("to_tick") - F.col("from_tick")) / F.lit(float(rate)), 4).alias("duration_s"), (F.col("_d1") < F.col("_d0")).alias("toward_bomb"))
    return durative(s, "rotation", "steamid", "from_tick", "to_tick", prm, "side", salt=F.col("to_tick"))


# holds


def hold_runs(samples: DataFrame, keys: list[str], place: str, speed: str, max_speed: float, min_ticks: int, width: int) -> DataFrame:
    """Runs of slow samples in one known place that last at least ``min_ticks``."""
    ok = F.coalesce(F.col(speed) < max_speed, F.lit(False)) & F.col(place).isNotNull()
    changes = lambda c, p: (c["_ok"] != p["_ok"]) | ~c[place].eqNullSafe(p[place])
    s = segments(samples.withColumn("_ok", ok), keys, ["tick"], ["_ok", place], changes, "run", width).where("_ok")
    out = s.groupBy(*keys, "run").agg(F.first(place).alias(place), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))
    return out.where(F.col("last_tick") - F.col("first_tick") >= min_ticks)


def extract_holds(c: Context, st: States) -> DataFrame:
    """A player stays slow in one callout; the callout faced at the start is probed along the view."""
    rate = c.feed.tick_rate
    g = alive_prefix(grid_players(c, st).where("steamid is not null"), c.feed.width)
    h = hold_runs(g, PLAYER, "callout", "speed", S.ACTIONS["hold_max_speed"], c.feed.ticks_in(S.ACTIONS["hold_min_s"]), c.feed.width)
    at = g.select(*PLAYER, F.col("tick").alias("first_tick"), "side", "x", "y", "z", "yaw")
    h = h.join(at, [*PLAYER, "first_tick"])
    far = S.ACTIONS["facing_units"]
    h = h.withColumns({"fx": F.col("x") + far * F.cos(F.radians("yaw")), "fy": F.col("y") + far * F.sin(F.radians("yaw"))})
    h = c.callout(h, "fx", "fy", "z", "facing_callout")
    prm = F.struct("callout", F.bround((F.col("last_tick") - F.col("first_tick")) / F.lit(float(rate)), 4).alias("duration_s"), "facing_callout")
    return durative(h, "hold", "steamid", "first_tick", "last_tick", prm, "side", salt=F.col("last_tick"))


# saves


def retreat_spans(rows: DataFrame, keys: list[str], dist_: str, ref: str, window: int, min_units: float, shots: DataFrame | None, width: int) -> DataFrame:
    """Spans over which a distance grows by ``min_units`` within ``window`` ticks without a shot.

    Only samples measured to the same reference compare.  Overlapping spans merge; each is
    trimmed to [the last sample at the smallest distance, the first at the largest].
    ``shots``: keys, ``shot``.
    """
    # the last sample inside the window is the latest one at or before tick + window
    r = rows.withColumn("_far", F.col("tick") + window)
    ends = rows.select(*keys, F.col("tick").alias("_et"), F.col(dist_).alias("_ed"), F.col(ref).alias("_er"))
    r = asof(r, ends, keys, "_far", "_et", ["_ed", "_er"], width=width, right_tick="_et")
    grew = (F.col("_et") > F.col("tick")) & (F.col("_er") == F.col(ref)) & (F.col("_ed") - F.col(dist_) >= min_units)
    m = r.where(grew).select(*keys, F.col("tick").alias("_s"), F.col("_et").alias("_e"))
    if shots is not None:
        m = m.withColumn("_s1", F.col("_s") + 1)
        hot = range_join(m, shots, keys, "_s1", "_e", "shot", max(window, 64)).select(*keys, "_s").distinct()
        m = m.join(hot, [*keys, "_s"], "left_anti").drop("_s1")
    m = chain_spans(durable(m), keys, "_s", "_e", "_n", width)
    spans = m.groupBy(*keys, "_n").agg(F.min("_s").alias("_lo"), F.max("_e").alias("_hi"))
    lead_ref = rows.select(*keys, F.col("tick").alias("_lo"), F.col(ref).alias("_lr"))
    spans = durable(spans.join(lead_ref, [*keys, "_lo"]))
    inside = range_join(spans, rows.select(*keys, "tick", F.col(dist_).alias("_d"), F.col(ref).alias("_r")), keys, "_lo", "_hi", "tick", width)
    inside = inside.where((F.col("_r") == F.col("_lr")) & F.col("_d").isNotNull())
    k = [*keys, "_n"]
    top = inside.groupBy(*k).agg(F.max_by("tick", F.struct("_d", -F.col("tick"))).alias("end_tick"))
    low = inside.join(top, k).where(F.col("tick") <= F.col("end_tick")).groupBy(*k).agg(F.min_by("tick", F.struct(F.col("_d"), -F.col("tick"))).alias("start_tick"))
    return top.join(low, k).where(F.col("start_tick") < F.col("end_tick")).drop("_n")


def extract_saves(c: Context, st: States) -> DataFrame:
    """Retreats from the planted bomb, or from the nearest living enemy in the last seconds of the clock."""
    feed = c.feed
    late = feed.ticks_in(S.CLOCK["round_time_s"] - S.ACTIONS["late_round_s"])
    plant = feed["bomb"].where(F.col("event") == "plant_complete").groupBy(*ROUND).agg(F.min("tick").alias("_plant"))
    b = c.rounds.join(plant, ROUND, "left").select(*ROUND, "_plant", F.least(F.col("_plant"), F.col("freeze_end_tick") + late).alias("_from"))
    g = grid_players(c, st)
    ph = durable(alive_prefix(g.where("steamid is not null").join(b, ROUND).where(F.col("tick") >= F.col("_from")), feed.width))
    ph = ph.withColumn("_after", F.coalesce(F.col("tick") >= F.col("_plant"), F.lit(False)))
    bp = bomb_position(c, ph.where("_after"), "tick")
    planted = ph.where("_after").select(*PLAYER, "tick", *[F.col(p).alias(f"p{p}") for p in ("x", "y", "z", "nav_area")]).join(bp, SAMPLE)
    planted = nav_or_dist(c, planted, "p", "b", "d").select(*PLAYER, "tick", "d", F.lit("bomb").alias("ref"))
    slots = g.select(*SAMPLE, "slot", "steamid", "side", "alive")
    near = F.coalesce("nav_dist_units", "dist_units")
    pr = st.pairs.where("same_team = 0").select(*SAMPLE, F.explode(F.array(
        F.struct(F.col("a_slot").alias("slot"), F.col("b_slot").alias("o"), near.alias("d")), F.struct(F.col("b_slot").alias("slot"), F.col("a_slot").alias("o"), near.alias("d")))).alias("_x"))
    pr = pr.select(*SAMPLE, "_x.slot", "_x.o", "_x.d").join(slots.where("alive = 1").select(*SAMPLE, F.col("slot").alias("o")), [*SAMPLE, "o"])
    enemy = pr.groupBy(*SAMPLE, "slot").agg(F.min("d").alias("d"))
    before = ph.where(~F.col("_after")).select(*PLAYER, "tick", "slot").join(enemy, [*SAMPLE, "slot"], "left").select(*PLAYER, "tick", "d", F.lit("enemy").alias("ref"))
    shots = feed.in_round("weapon_fire", "tick").select(*PLAYER, F.col("tick").alias("shot"))
    s = retreat_spans(durable(planted.unionByName(before)), PLAYER, "d", "ref", feed.ticks_in(S.ACTIONS["save_window_s"]), S.ACTIONS["save_min_units"], shots, feed.width)
    one = lambda t, n: g.select(*PLAYER, F.col("tick").alias(t), F.col("callout").alias(n), *(["side"] if n == "from_callout" else []))
    s = s.join(one("start_tick", "from_callout"), [*PLAYER, "start_tick"]).join(one("end_tick", "to_callout"), [*PLAYER, "end_tick"])
    mates = g.where("alive = 1").groupBy(*ROUND, F.col("tick").alias("start_tick"), "side").agg((F.count(F.lit(1)) - 1).alias("teammates_alive"))
    s = s.join(mates, [*ROUND, "start_tick", "side"], "left")
    prm = F.struct("from_callout", "to_callout", F.coalesce("teammates_alive", F.lit(0)).alias("teammates_alive"))
    return durative(s, "save", "steamid", "start_tick", "end_tick", prm, "side", salt=F.col("end_tick"))


MOVEMENT = {"peek": extract_peeks, "rotation": extract_rotations, "hold": extract_holds, "save": extract_saves}


def extract_movement(c: Context, st: States) -> DataFrame:
    """Every movement action of the grid samples."""
    from .actions import to_actions

    parts = [to_actions(fn(c, st)) for fn in MOVEMENT.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_blocks(actions: DataFrame, st: States) -> DataFrame:
    """Sight lines each smoke newly cuts: living enemy pairs blocked one tick after the pop and not before."""
    off = S.SAMPLING["boundary_offset_ticks"]
    sm = actions.where(F.col("type") == "smoke").select(*ROUND, "action_id", (F.col("window_start_tick") - off).alias("_pre"), (F.col("window_start_tick") + off).alias("_post"))
    enemy = st.pairs.where("same_team = 0").select(*SAMPLE, "a_slot", "b_slot", "smoke_between")
    post = sm.join(st.samples.select(*ROUND, F.col("tick").alias("_post")), [*ROUND, "_post"])
    new = post.join(enemy.where("smoke_between = 1").withColumnRenamed("tick", "_post"), [*ROUND, "_post"])
    old = enemy.where("smoke_between = 1").select(*ROUND, F.col("tick").alias("_pre"), "a_slot", "b_slot")
    new = new.join(old, [*ROUND, "_pre", "a_slot", "b_slot"], "left_anti").groupBy("action_id").agg(F.count(F.lit(1)).alias("_n"))
    n = post.select("action_id").join(new, "action_id", "left").select("action_id", F.coalesce("_n", F.lit(0)).alias("_blocks"))
    out = actions.join(n, "action_id", "left")
    filled = F.regexp_replace("params", '"blocks_pairs_at_pop":null', F.concat(F.lit('"blocks_pairs_at_pop":'), F.col("_blocks").cast("string")))
    return out.withColumn("params", F.when(F.col("_blocks").isNotNull(), filled).otherwise(F.col("params"))).drop("_blocks")
