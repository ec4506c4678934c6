"""Sample ticks, rosters and point-in-time views of the raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from .. import settings as S
from .feed import ROUND, Feed
from .scan import asof, range_join

# fixed values: sample kinds in output order
GRID, PRE, POST, TERMINAL = "grid", "boundary_pre", "boundary_post", "terminal"
KINDS = [GRID, PRE, POST, TERMINAL]
ROUND_END_COLS = ["end_tick", "official_end_tick", "winner_side", "end_reason", "bomb_planted"]


def with_terminal(rounds: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """Add ``terminal``: official end, else end, else the last player row; unknown rounds drop out."""
    out = rounds
    end = F.coalesce("official_end_tick", "end_tick")
    if ticks is not None:
        last = ticks.groupBy(*ROUND).agg(F.max("tick").alias("_last"))
        out = out.join(last, ROUND, "left")
        end = F.coalesce(end, "_last")
    out = out.withColumn("terminal", end).where("terminal is not null")
    return out.drop("_last")


def grid_ticks(rounds: DataFrame, tick_rate: int, hz: float) -> DataFrame:
    """Regular ticks from freeze end to the terminal tick, which is always the last one.

    ``rounds`` carries ``terminal``.  Steps are rounded half to even.
    """
    fe, end = F.col("freeze_end_tick"), F.col("terminal")
    n = F.floor((end - fe) / F.lit(float(tick_rate)) * F.lit(float(hz))).cast("int") + 1
    step = F.lit(tick_rate / float(hz))
    regular = F.transform(
        F.sequence(F.lit(0), n - 1), lambda k: F.least(end, fe + F.bround(k * step, 0).cast("bigint")))
    ticks = F.when(end < fe, F.array(end)).otherwise(F.array_union(regular, F.array(end)))
    return rounds.select(*ROUND, F.explode(ticks).alias("tick"))


def boundary_ticks(instants: DataFrame, spans: DataFrame, rounds: DataFrame, offset: int) -> DataFrame:
    """``(tick, kind)`` before and after each instant and both span ends, clipped to the round.

    ``instants``: round, tick; ``spans``: round, start_tick, end_tick (null end skipped).
    """
    taus = instants.select(*ROUND, F.col("tick").cast("bigint").alias("tau"))
    ends = spans.select(*ROUND, F.explode(F.array("start_tick", "end_tick")).alias("tau"))
    taus = taus.unionByName(ends).where("tau is not null").distinct()
    b = rounds.select(*ROUND, "freeze_end_tick", "terminal")
    clip = lambda c: F.least(F.greatest(c, F.col("freeze_end_tick")), F.col("terminal"))
    rows = taus.join(b, ROUND).withColumn("_x", F.explode(F.array(
        F.struct(clip(F.col("tau") - offset).alias("tick"), F.lit(PRE).alias("kind")),
        F.struct(clip(F.col("tau") + offset).alias("tick"), F.lit(POST).alias("kind")))))
    return rows.select(*ROUND, "_x.tick", "_x.kind").distinct()


def all_ticks(rounds: DataFrame, tick_rate: int, hz: float, instants: DataFrame, spans: DataFrame, offset: int) -> DataFrame:
    """Sample rows ``(round, tick, kinds, t_s)``: the union, with the kinds in fixed order."""
    rows = grid_ticks(rounds, tick_rate, hz).withColumn("kind", F.lit(GRID))
    rows = rows.unionByName(boundary_ticks(instants, spans, rounds, offset))
    rows = rows.unionByName(rounds.select(*ROUND, F.col("terminal").alias("tick"), F.lit(TERMINAL).alias("kind")))
    per = rows.groupBy(*ROUND, "tick").agg(F.collect_set("kind").alias("_k"))
    order = F.array(*[F.lit(k) for k in KINDS])
    kinds = F.filter(order, lambda k: F.array_contains(F.col("_k"), k))
    per = per.withColumn("kinds", kinds).drop("_k").join(rounds.select(*ROUND, "freeze_end_tick"), ROUND)
    return per.withColumn("t_s", (F.col("tick") - F.col("freeze_end_tick")) / F.lit(float(tick_rate))).drop("freeze_end_tick")


def raw_event_ticks(feed: Feed, rounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instant ticks and spans of a build without actions, straight from the raw tables."""
    span = rounds.select(*ROUND, "start_tick", "terminal")
    inside = lambda df, c: df.join(span, ROUND).where(F.col(c).between(F.col("start_tick"), F.col("terminal")))
    det = feed.in_round("grenades", "detonate_tick").where(F.col("type").isin("flash", "he"))
    det = det.select(*ROUND, F.col("detonate_tick").alias("tick"))
    fl = feed.in_round("flashes", "detonate_tick").select(*ROUND, F.col("detonate_tick").alias("tick"))
    inst = feed["kills"].select(*ROUND, "tick").unionByName(feed["bomb"].select(*ROUND, "tick"))
    inst = inst.unionByName(inside(det.unionByName(fl), "tick").select(*ROUND, "tick")).where("tick is not null").distinct()
    areas = [feed.in_round(n, "start_tick").select(*ROUND, F.col("start_tick").alias("s"), "end_tick") for n in ("smokes", "infernos")]
    spans = inside(areas[0].unionByName(areas[1]), "s").select(*ROUND, F.col("s").alias("start_tick"), "end_tick").distinct()
    return inst, spans


def event_ticks(actions: DataFrame) -> DataFrame:
    """Instant ticks of the actions, a drop's pickup tick included."""
    inst = actions.where((F.col("kind") == "instant") & F.col("tick").isNotNull())
    pick = F.when(F.col("type") == "drop", F.get_json_object("params", "$.pickup_tick").cast("bigint"))
    return inst.select(*ROUND, F.explode(F.array("tick", pick)).alias("tick")).where("tick is not null").distinct()


def durative_windows(actions: DataFrame) -> DataFrame:
    """Distinct spans of the durative actions."""
    d = actions.where(F.col("kind") == "durative")
    return d.select(*ROUND, F.col("window_start_tick").alias("start_tick"), F.col("window_end_tick").alias("end_tick")).distinct()


def keep_for_rate(samples: DataFrame, hz: float, tol_s: float = 1 / 256) -> DataFrame:
    """Thin grid samples to the 1/hz lattice; boundary and terminal samples stay."""
    k = F.col("t_s") * F.lit(float(hz))
    on = F.abs(k - F.bround(k, 0)) / F.lit(float(hz)) <= tol_s
    only_grid = F.col("kinds") == F.array(F.lit(GRID))
    return samples.where(~only_grid | on)


# rosters


def roster(ticks: DataFrame, rounds: DataFrame) -> DataFrame:
    """Side of each player: the last row at or before freeze end, else at the round's first tick.

    ``slot`` is 0-4 for CT and 5-9 for T by id; a side keeps its first five ids.
    """
    t = ticks.join(rounds.select(*ROUND, "freeze_end_tick"), ROUND)
    early = t.where(F.col("tick") <= F.col("freeze_end_tick"))
    a = early.groupBy(*ROUND, "steamid").agg(F.max_by("side", "tick").alias("side"))
    first = ticks.groupBy(*ROUND).agg(F.min("tick").alias("tick"))
    late = first.join(early.select(*ROUND).distinct(), ROUND, "left_anti")
    b = ticks.join(late, [*ROUND, "tick"]).groupBy(*ROUND, "steamid").agg(F.max("side").alias("side"))
    sides = a.unionByName(b).where(F.col("side").isin("ct", "t"))
    n = F.row_number().over(Window.partitionBy(*ROUND, "side").orderBy("steamid"))
    base = F.when(F.col("side") == "ct", 0).otherwise(schemas.N_PER_SIDE)
    out = sides.withColumn("_n", n).where(F.col("_n") <= schemas.N_PER_SIDE)
    return out.withColumn("slot", (base + F.col("_n") - 1).cast("int")).drop("_n")


def all_sides(ticks: DataFrame, rounds: DataFrame) -> DataFrame:
    """Side of every player of a round: last row at or before freeze end, else the first row."""
    t = ticks.join(rounds.select(*ROUND, "freeze_end_tick"), ROUND)
    early = F.when(F.col("tick") <= F.col("freeze_end_tick"), F.col("tick"))
    side = F.coalesce(F.max_by("side", early), F.min_by("side", "tick"))
    return t.groupBy(*ROUND, "steamid").agg(side.alias("side")).where(F.col("side").isin("ct", "t"))


def slots(rounds: DataFrame, players: DataFrame) -> DataFrame:
    """Ten slots per round; a slot without a player has a null id and the side of its half."""
    ten = rounds.select(*ROUND, F.explode(F.sequence(F.lit(0), F.lit(schemas.N_PLAYERS - 1))).alias("slot"))
    out = ten.join(players.select(*ROUND, "slot", "steamid"), [*ROUND, "slot"], "left")
    return out.withColumn("side", F.when(F.col("slot") < schemas.N_PER_SIDE, "ct").otherwise("t"))


# point-in-time views


def as_of_columns(table: str, t: Column) -> dict[str, Column]:
    """Columns of a table that must be nulled at time ``t`` because they lie in the future."""
    gone = lambda when, cols: {c: F.when(~(F.col(when) > t), F.col(c)) for c in cols}
    if table == "rounds":
        open_ = F.col("end_tick").isNull() | (F.col("end_tick") > t)
        out = {c: F.when(~open_, F.col(c)) for c in ROUND_END_COLS}
        out["official_end_tick"] = F.when(~open_ & (F.col("official_end_tick") <= t), F.col("official_end_tick"))
        return out
    if table in ("smokes", "infernos"):
        return gone("end_tick", ["end_tick"])
    if table == "grenades":
        hidden = F.col("detonate_tick").isNull() | (F.col("detonate_tick") > t)
        out = {c: F.when(~hidden, F.col(c)) for c in ("detonate_tick", "x", "y", "z")}
        out["expire_tick"] = F.when(F.col("expire_tick") <= t, F.col("expire_tick"))
        return out
    return {}


VISIBLE_FROM = {
    "rounds": "start_tick", "smokes": "start_tick", "infernos": "start_tick", "grenades": "throw_tick",
    "flashes": "detonate_tick",
}


def slice_table(df: DataFrame, table: str, t: Column) -> DataFrame:
    """Rows of a table known at ``t`` with every future value nulled; ``t`` may be a column of ``df``."""
    return df.where(F.col(VISIBLE_FROM.get(table, "tick")) <= t).withColumns(as_of_columns(table, t))


def slice_until(feed: Feed, tick: int) -> Feed:
    """The feed as it was known at one tick."""
    return feed.with_tables(**{n: slice_table(df, n, F.lit(tick)) for n, df in feed.tables.items()})


def check_round(df: DataFrame, rounds: DataFrame, tick: str = "tick") -> DataFrame:
    """Keep rows whose round exists and holds their tick."""
    b = rounds.select(*ROUND, F.col("start_tick").alias("_s"), F.col("terminal").alias("_t"))
    return df.join(b, ROUND).where(F.col(tick).between(F.col("_s"), F.col("_t"))).drop("_s", "_t")


def state_tick_at(df: DataFrame, tick: str, states: DataFrame, name: str, *, width: int,
                  strict: bool = False, exact: bool = False, by: Sequence[str] = ROUND) -> DataFrame:
    """Tick of the latest state at or before (strictly before, or exactly at) a tick of each row."""
    keys = states.select(*by, F.col("tick").alias("_st")).distinct()
    out = asof(df, keys, by, tick, "_st", [], width=width, strict=strict, right_tick="_st")
    hit = F.when(F.col("_st") == F.col(tick), F.col("_st")) if exact else F.col("_st")
    return out.withColumn(name, hit).drop("_st")


def samples_in(spans: DataFrame, samples: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """Pairs of a span and a sample tick inside it."""
    return range_join(spans, samples, ROUND, lo, hi, "tick", width)


def default_samples(feed: Feed, hz: float | None = None, actions: DataFrame | None = None) -> DataFrame:
    """Samples of a feed: grid plus the boundaries of its actions (or of its raw events)."""
    rounds = with_terminal(feed["rounds"], feed["ticks"])
    if actions is None:
        inst, spans = raw_event_ticks(feed, rounds)
    else:
        inst, spans = event_ticks(actions), durative_windows(actions)
    hz = hz if hz is not None else S.SAMPLING["sample_hz"]
    return all_ticks(rounds, feed.tick_rate, hz, inst, spans, S.SAMPLING["boundary_offset_ticks"])
