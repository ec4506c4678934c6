"""Whole lifecycles: a feed to valued actions, and the tables of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import actions as A
from ..operators import attribution as T
from ..operators import enablers as E
from ..operators import movement as M
from ..operators import sampling as C
from ..operators import state as D
from ..operators import windows as W
from ..operators.feed import Feed
from ..operators.scan import durable


def build(feed: Feed, tier: str = "pro", hz: float | None = None, movement: bool = True) -> dict[str, DataFrame]:
    """States, actions with enablers and windows of a feed.

    Movement actions need states and states need the ticks of every action: states are
    built for the event ticks, and then for the ticks that the movement adds.
    """
    c = A.Context(feed)
    ev = durable(A.extract_events(feed))
    st = D.build(feed, C.default_samples(feed, hz, ev), tier)
    acts = ev
    if movement:
        acts = durable(ev.unionByName(M.extract_movement(c, st)))
        st = D.extend(feed, st, C.default_samples(feed, hz, acts), tier)
    acts = durable(M.fill_blocks(acts, st))
    acts = durable(E.attach(acts, E.Enablers(c, acts, st).all()))
    return {"states": st.assemble(D.attach_labels(feed, st)), "actions": acts, "windows": W.group(acts, c.rounds, feed.width)}


def analyze(feed: Feed, scorer: T.Scorer, tier: str = "pro", hz: float | None = None, movement: bool = True, heads: T.Scorer | None = None) -> dict[str, DataFrame]:
    """Valued actions, clock and conservation of every round of a feed; with ``heads`` enablers get their shares."""
    b = build(feed, tier, hz, movement)
    states, windows = durable(b["states"]), durable(b["windows"])
    return {**b, "states": states, "windows": windows, **T.attribute(states, b["actions"], windows, scorer, width=feed.width, heads=heads)}


def rule_scorer(states: DataFrame) -> DataFrame:
    """A rule instead of a model: man advantage, the plant and blindness move W (used by tests and checks)."""
    blind = lambda s: F.aggregate(F.filter("players", lambda p: (p["side"] == s) & (p["alive"] == 1)), F.lit(0.0), lambda a, p: a + F.least(F.lit(3.0), p["flash_duration_remaining"].cast("double")))
    w = 0.5 + 0.1 * (F.col("ctx_alive_ct") - F.col("ctx_alive_t")) - 0.15 * F.col("ctx_bomb_planted") + 0.01 * (blind("t") - blind("ct"))
    return states.withColumn("W", F.greatest(F.lit(0.02), F.least(F.lit(0.98), w)))


def rule_heads(states: DataFrame) -> DataFrame:
    """Rules instead of helper heads: hurt and blind players die soon, smoke adds to it; men decide plants and defuses."""
    smokes = F.size(F.filter("utility", lambda u: u["kind"] == "smoke"))
    danger = lambda p: 0.05 + 0.1 * p["flash_duration_remaining"].cast("double") + 0.004 * (100 - p["health"].cast("double")) + 0.1 * smokes
    alive = lambda side: F.size(F.filter("players", lambda p: (p["side"] == side) & (p["alive"] == 1)))
    return states.withColumns({"hazard": F.transform("players", lambda p: F.when(p["alive"] == 1, danger(p)).otherwise(0.0)), "plant15": 0.1 * alive("t"), "defuse15": 0.1 * alive("ct")})
