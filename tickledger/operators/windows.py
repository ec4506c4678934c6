"""Simultaneity windows: chains of instant actions that happen together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import ids
from .feed import ROUND
from .scan import Run, chain_spans, previous


def group(actions: DataFrame, rounds: DataFrame | None, width: int, sim: int | None = None, off: int | None = None) -> DataFrame:
    """Windows over the instant actions of each round.

    An action joins the open window when its tick is within ``sim`` ticks of the previous
    one or its span starts inside the window.  ``rounds`` (with ``freeze_end_tick`` and
    ``terminal``) drops actions outside the round and clips the bounds.
    """
    sim = S.ACTIONS["simultaneity_ticks"] if sim is None else sim
    off = S.SAMPLING["boundary_offset_ticks"] if off is None else off
    a = actions.where((F.col("kind") == "instant") & F.col("tick").isNotNull())
    a = a.select(*ROUND, "tick", "action_id", F.greatest(F.col("tick") + off, F.coalesce("state_post_tick", F.col("tick") + off)).alias("_end"))
    if rounds is not None:
        b = rounds.select(*ROUND, F.col("freeze_end_tick").alias("_lo"), F.col("terminal").alias("_hi"))
        a = a.join(b, ROUND).where(F.col("tick").between(F.col("_lo"), F.col("_hi")))
    joins = lambda s, p, e: (s - p <= sim) | (s - off <= e)
    a = chain_spans(a, ROUND, "tick", "_end", "_w", width, joins)
    bounds = [F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi")] if rounds is not None else []
    members = F.array_sort(F.collect_list(F.struct("tick", "_end", "action_id")))
    w = a.groupBy(*ROUND, "_w").agg((F.min("tick") - off).alias("start_tick"), F.max("_end").alias("end_tick"), members.alias("_m"), *bounds)
    if rounds is not None:
        w = w.withColumns({"start_tick": F.greatest("_lo", "start_tick"), "end_tick": F.least("_hi", "end_tick")})
    w = w.withColumn("member_action_ids", F.transform("_m", lambda m: m["action_id"]))
    wid = ids.window_id(F.col("round_num"), F.col("start_tick"), F.col("end_tick"), F.col("member_action_ids"))
    return w.select("match_key", wid.alias("window_id"), "round_num", "start_tick", "end_tick", "member_action_ids")


def overlaps(windows: DataFrame, width: int) -> DataFrame:
    """Neighbouring windows of a round that share a tick (should be empty)."""
    w = previous(windows, ROUND, ["start_tick", "end_tick", "window_id"], {"prev_id": "window_id", "_pe": "end_tick"}, width)
    return w.where(F.col("start_tick") <= F.col("_pe")).select(*ROUND, "prev_id", "window_id")


def coverage(windows: DataFrame, rounds: DataFrame, width: int) -> DataFrame:
    """Tile each round in event intervals (the windows) and drift intervals (the gaps)."""
    w = windows.select(*ROUND, "start_tick", "end_tick", "window_id")
    edge = rounds.select(*ROUND, F.col("freeze_end_tick").alias("start_tick"), F.col("freeze_end_tick").alias("end_tick"), F.lit(None).cast("string").alias("window_id"), F.lit(0).alias("_o"))
    last = rounds.select(*ROUND, F.col("terminal").alias("start_tick"), F.col("terminal").alias("end_tick"), F.lit(None).cast("string").alias("window_id"), F.lit(2).alias("_o"))
    rows = edge.unionByName(w.withColumn("_o", F.lit(1))).unionByName(last)
    rows = previous(rows, ROUND, ["start_tick", "_o", "end_tick"], {"_pe": "end_tick"}, width)
    gap = rows.where(F.col("_pe") < F.col("start_tick")).select(
        *ROUND, F.lit("drift").alias("kind"), F.col("_pe").alias("start_tick"), F.col("start_tick").alias("end_tick"), F.lit(None).cast("string").alias("window_id"))
    ev = w.select(*ROUND, F.lit("event").alias("kind"), "start_tick", "end_tick", "window_id")
    return ev.unionByName(gap)


def coverage_problems(windows: DataFrame, rounds: DataFrame, width: int) -> DataFrame:
    """Windows that overlap their predecessor, are inverted or leave their round."""
    w = previous(windows, ROUND, ["start_tick", "end_tick", "window_id"], {"_pe": "end_tick"}, width)
    w = w.join(rounds.select(*ROUND, "freeze_end_tick", "terminal"), ROUND)
    bad = (F.col("start_tick") < F.coalesce("_pe", "freeze_end_tick")) | (F.col("end_tick") > F.col("terminal")) | (F.col("start_tick") > F.col("end_tick"))
    return w.where(bad).select(*ROUND, "window_id", "start_tick", "end_tick")
