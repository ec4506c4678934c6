"""Splitting the change of W in a round over its actions.

Rounds never meet: everything is keyed by (match, round).  W comes from a user's scorer,
``DataFrame -> DataFrame`` that adds ``W`` to wide state rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from .. import settings as S
from ..functions import ids
from ..functions.exprs import dist
from . import edits as E
from . import shapley as SH
from .feed import ROUND
from .scan import Run, asof, durable, previous, range_join, scan

A = S.ATTRIBUTION
Scorer = Callable[[DataFrame], DataFrame]
METHOD_RANK = {"exact": 0, "loo": 1, "sampled": 2}
MOVEMENT_TYPES = ["rotation", "hold", "save"]
HEADS = {"kill": "hazard", "damage": "hazard", "plant_complete": "plant15", "defuse_complete": "defuse15"}


# partition


def window_spans(ticks: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Sample before and after each window; a window at the edge of the samples is clamped and flagged."""
    t = ticks.select(*ROUND, F.col("tick").alias("_t"))
    w = windows.select(*ROUND, "window_id", "start_tick", "end_tick", *[c for c in ("member_action_ids",) if c in windows.columns])
    w = asof(w, t, ROUND, "start_tick", "_t", [], width=width, right_tick="pre_tick")
    w = asof(w, t, ROUND, "end_tick", "_t", [], width=width, direction="forward", right_tick="post_tick")
    ends = ticks.groupBy(*ROUND).agg(F.min("tick").alias("_lo"), F.max("tick").alias("_hi"))
    w = w.join(ends, ROUND)
    flags = F.array_compact(F.array(F.when(F.col("pre_tick").isNull(), F.lit("pre_clamped_to_freeze_end")), F.when(F.col("post_tick").isNull(), F.lit("post_clamped_to_terminal"))))
    return w.withColumns({"flags": flags, "pre_tick": F.coalesce("pre_tick", "_lo"), "post_tick": F.coalesce("post_tick", "_hi")}).drop("_lo", "_hi")


def intervals(ticks: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Intervals between the samples that are not strictly inside a window, labelled event or drift."""
    inner = spans.select(*ROUND, (F.col("pre_tick") + 1).alias("_lo"), (F.col("post_tick") - 1).alias("_hi"))
    inside = range_join(inner, ticks.select(*ROUND, "tick"), ROUND, "_lo", "_hi", "tick", width).select(*ROUND, "tick").distinct()
    bp = ticks.select(*ROUND, "tick").distinct().join(inside, [*ROUND, "tick"], "left_anti")
    iv = previous(bp, ROUND, ["tick"], {"start_tick": "tick"}, width).where("start_tick is not null")
    iv = iv.select(*ROUND, "start_tick", F.col("tick").alias("end_tick"))
    ev = spans.select(*ROUND, F.col("pre_tick").alias("start_tick"), F.col("post_tick").alias("end_tick"), "window_id")
    return iv.join(ev, [*ROUND, "start_tick", "end_tick"], "left").withColumn("kind", F.when(F.col("window_id").isNotNull(), "event").otherwise("drift"))


def tiling_problems(iv: DataFrame, rounds: DataFrame, width: int) -> DataFrame:
    """Rounds whose intervals leave a gap, overlap or miss an end (``freeze_end_tick``, ``terminal``)."""
    w = previous(iv, ROUND, ["start_tick", "end_tick"], {"_pe": "end_tick"}, width)
    gap = w.where((F.col("_pe").isNotNull() & (F.col("_pe") != F.col("start_tick"))) | (F.col("start_tick") >= F.col("end_tick"))).select(*ROUND, F.lit("gap or overlap").alias("problem"))
    ends = iv.groupBy(*ROUND).agg(F.min("start_tick").alias("_s"), F.max("end_tick").alias("_e")).join(rounds, ROUND)
    return gap.unionByName(ends.where((F.col("_s") != F.col("freeze_end_tick")) | (F.col("_e") != F.col("terminal"))).select(*ROUND, F.lit("ends").alias("problem"))).distinct()


def pin_terminal(scored: DataFrame) -> DataFrame:
    """W of a terminal state is the round's outcome when it is known."""
    pin = F.array_contains("kinds", "terminal") & F.col("y_round_won_ct").isNotNull()
    return scored.withColumn("W", F.when(pin, F.col("y_round_won_ct").cast("double")).otherwise(F.col("W")))


def deltas(iv: DataFrame, w: DataFrame) -> DataFrame:
    """Change of W over each interval; ``w``: round, tick, W."""
    a, b = (w.select(*ROUND, F.col("tick").alias(t), F.col("W").alias(n)) for t, n in (("start_tick", "W0"), ("end_tick", "W1")))
    return iv.join(a, [*ROUND, "start_tick"]).join(b, [*ROUND, "end_tick"]).withColumn("dW", F.col("W1") - F.col("W0"))


def telescoping(iv: DataFrame) -> DataFrame:
    """Residual of the summed changes against the round's end points."""
    g = iv.groupBy(*ROUND).agg(F.sum("dW").alias("sum_dw"), F.min_by("W0", "start_tick").alias("w_start"), F.max_by("W1", "end_tick").alias("w_end"), F.count(F.lit(1)).alias("n_intervals"))
    return g.withColumn("residual", F.col("sum_dw") - (F.col("w_end") - F.col("w_start")))


# movement


def mover_games(iv: DataFrame, states: DataFrame) -> DataFrame:
    """Drift intervals with their movers (alive at both ends, moved far enough) as freeze actions."""
    s = states.select(*ROUND, "tick", E.state_struct().alias("st"))
    d = iv.where("kind = 'drift'").join(s.select(*ROUND, F.col("tick").alias("start_tick"), F.col("st").alias("pre")), [*ROUND, "start_tick"])
    d = d.join(s.select(*ROUND, F.col("tick").alias("end_tick"), F.col("st").alias("post")), [*ROUND, "end_tick"])
    lim = S.ACTIONS["movement_min_units"]
    far = F.transform("post.players", lambda p, i: F.when(
        (p["alive"] == 1) & (F.get(F.col("pre.players"), i)["alive"] == 1)
        & (dist([p[c] for c in "xyz"], [F.get(F.col("pre.players"), i)[c] for c in "xyz"]) >= lim), p["player_id"]))
    ids_ = F.array_sort(F.array_compact(far))
    none = {f.split(":")[0]: f.split(":", 1)[1] for f in ["victim:bigint", "damage:double", "armor:double", "lethal:double", "blinded_self:double", "site:string", "kit:boolean", "receiver:bigint", "x:double", "y:double", "z:double"]}
    freeze = lambda pid: F.struct(
        pid.cast("string").alias("action_id"), F.lit("freeze").alias("type"), pid.alias("actor"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("bigint").alias("victim"),
        *[F.lit(None).cast(none[n]).alias(n) for n in ("damage", "armor", "lethal")], F.array().cast("array<struct<id:bigint,dmg:double,armor:double>>").alias("hits"),
        F.array().cast("array<struct<id:bigint,duration:double>>").alias("blinded"), *[F.lit(None).cast(none[n]).alias(n) for n in ("blinded_self", "site", "kit", "receiver", "x", "y", "z")]).cast(E.ACTION_T)
    d = d.withColumn("members", F.transform(ids_, freeze)).withColumn("n", F.size("members"))
    return d.withColumn("game_id", ids.sha16(F.concat_ws("|", "match_key", "round_num", F.lit("drift"), "start_tick", "end_tick")))


def event_games(iv: DataFrame, states: DataFrame, windows: DataFrame, actions: DataFrame) -> DataFrame:
    """Event intervals with the states at both ends and the members in tick order."""
    s = states.select(*ROUND, "tick", E.state_struct().alias("st"))
    m = windows.select(*ROUND, "window_id", F.explode("member_action_ids").alias("action_id"))
    a = actions.select(*ROUND, "action_id", F.coalesce("tick", "window_start_tick").alias("_k"), E.action_struct().alias("a"))
    m = m.join(a, [*ROUND, "action_id"]).groupBy(*ROUND, "window_id").agg(F.array_sort(F.collect_list(F.struct("_k", "action_id", "a"))).alias("_m"))
    e = iv.where("kind = 'event'").join(m, [*ROUND, "window_id"])
    e = e.join(s.select(*ROUND, F.col("tick").alias("start_tick"), F.col("st").alias("pre")), [*ROUND, "start_tick"])
    e = e.join(s.select(*ROUND, F.col("tick").alias("end_tick"), F.col("st").alias("post")), [*ROUND, "end_tick"])
    e = e.withColumn("members", F.transform("_m", lambda x: x["a"])).drop("_m")
    return e.withColumns({"n": F.size("members"), "game_id": F.col("window_id")})


def coalition_values(games: DataFrame, masks: DataFrame, scorer: Scorer, order: str = "reverse") -> DataFrame:
    """W of every coalition of every game: ``game_id, n, mask, v`` and ``error`` of a failed edit.

    The coalition of all members is the factual state and is not scored again.
    """
    cols = [*ROUND, "game_id", "n", "pre", "post", "members", "W1", F.col("end_tick").alias("tick")]
    c = masks.select("game_id", "mask").join(games.select(*cols), "game_id")
    full = SH._bit(F.col("n")) - 1
    facts = c.where(F.col("mask") == full).select("game_id", "n", "mask", F.col("W1").alias("v"), F.lit(None).cast("string").alias("error"))
    rest = E.wide(E.apply_cases(c.where(F.col("mask") != full), order), "edited")
    s = scorer(rest)
    return facts.unionByName(s.select("game_id", "n", "mask", F.col("W").alias("v"), F.col("edit_error").alias("error")))


def tree_values(games: DataFrame, scorer: Scorer) -> DataFrame:
    """W of all coalitions of games that are solved exactly; they share their edits."""
    cols = [*ROUND, "game_id", "n", "pre", "post", "members", "W1", F.col("end_tick").alias("tick")]
    t = E.coalition_tree(games.select(*cols))
    whole = F.col("mask") == SH._bit(F.col("n")) - 1
    facts = t.where(whole).select("game_id", "n", "mask", F.col("W1").alias("v"), F.lit(None).cast("string").alias("error"))
    s = scorer(E.wide(t.where(~whole), "edited"))
    return facts.unionByName(s.select("game_id", "n", "mask", F.col("W").alias("v"), F.col("edit_error").alias("error")))


def solve(games: DataFrame, scorer: Scorer, drift: bool) -> tuple[DataFrame, DataFrame]:
    """Shares of the members of each game and the rest that goes to the clock.

    Returns ``phi`` (game_id, action_id, phi, method, residual, n) and ``clock`` (game_id, clock, source).
    Small drift changes use leave-one-out; a game with a failed edit goes to the clock whole.
    """
    one = ["game_id"]
    src = "drift" if drift else "window_gap"
    games = durable(games)
    empty = games.where("n = 0").select(*one, F.col("dW").alias("clock"), F.lit(src).alias("source"))
    g = games.where("n > 0")
    small = (F.abs("dW") < A["drift_threshold"]) if drift else F.lit(False)
    full = SH._bit(F.col("n")) - 1
    loo_masks = F.concat(F.array(full, F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: full - SH._bit(i)))
    lo = g.where(small).withColumn("mask", F.explode(F.array_distinct(loo_masks))).select("game_id", "n", "mask")
    exact = ~small & (F.col("n") <= A["exact_max"])
    sh = SH.required_masks(g.where(~small & ~exact).select("game_id", F.col("n").cast("bigint").alias("n")), one)
    some = coalition_values(g, lo.unionByName(sh.select("game_id", F.col("n").cast("int").alias("n"), "mask")), scorer)
    vals = durable(some.unionByName(tree_values(g.where(exact), scorer)))
    failed = vals.where("error is not null").select("game_id").distinct()
    ok = vals.join(failed, one, "left_anti")
    ends = ok.groupBy("game_id").agg(F.max(F.when(F.col("mask") == 0, F.col("v"))).alias("v0"))
    kinds = g.select("game_id", small.alias("_small"))
    okk = ok.join(kinds, one)
    p1 = SH.leave_one_out(okk.where("_small").select("game_id", "n", "mask", "v"), one, "n").withColumn("method", F.lit("loo"))
    big = okk.where("not _small").select("game_id", F.col("n").cast("bigint").alias("n"), "mask", "v")
    p2 = SH.shapley(big.select("game_id", "n").distinct(), big, one)
    phi = p1.select("game_id", "bit", "phi", "method", "residual").unionByName(p2.select("game_id", "bit", "phi", "method", "residual"))
    phi = phi.join(g.select(*ROUND, "game_id", "n", "start_tick", "end_tick", "members"), one)
    phi = phi.select(*ROUND, "game_id", "start_tick", "end_tick", F.get("members", F.col("bit").cast("int"))["action_id"].alias("action_id"), "phi", "method", "residual", "n")
    # the rest of the interval: everything a full coalition does not explain
    gap = g.join(ends, one).select("game_id", (F.col("v0") - F.col("W0")).alias("clock"), F.lit(src).alias("source"))
    lost = g.join(failed, one).select("game_id", F.col("dW").alias("clock"), F.lit("failed_window").alias("source"))
    clock = empty.unionByName(gap).unionByName(lost).join(games.select("game_id", *ROUND), one)
    return phi, clock


# enabler split


def enabler_split(e: DataFrame, mode: str | None = None) -> DataFrame:
    """Share of each enabler of an event.

    ``e``: event_id, idx, kind, link_id, q_pre, q_removed (null when the removal failed).
    The share is the relative drop of the event's probability, held to the kind's band and
    capped in total; an unstable probability gives the band's floor; ``info`` goes to the clock.
    """
    mode = mode or A["enabler_mode"]
    t = F.col("kind") == "trade_setup"
    lo, hi = (F.when(t, F.lit(A["trade_band"][i])).otherwise(F.lit(A["other_band"][i])) for i in (0, 1))
    info = F.col("kind") == "info"
    nan = F.col("q_pre").isNull() | F.isnan("q_pre")
    low = (F.col("q_pre") <= 0) | (F.col("q_pre") < A["min_hazard"])
    failed = F.col("q_removed").isNull()
    raw = F.try_divide(F.greatest(F.lit(0.0), F.col("q_pre") - F.col("q_removed")), F.col("q_pre"))
    if mode == "fixed":
        fixed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in A["fixed_shares"].items() for x in kv]), F.col("kind")), F.lit(0.0))
        share, flag, raw = F.when(info, 0.0).otherwise(fixed), F.lit(None).cast("string"), F.lit(None).cast("double")
    else:
        share = F.when(info | nan | low | failed, lo).otherwise(F.least(F.greatest(raw, lo), hi))
        flag = F.when(info, F.lit(None)).when(nan, "hazard_nan").when(low, "min_hazard").when(failed, F.concat(F.lit("remove_failed:"), F.col("kind")))
        raw = F.when(~(info | nan | low | failed), raw)
    cap = A["enabler_total_cap"]
    w = Window.partitionBy("event_id")
    out = e.withColumns({"raw": raw, "share": share, "flag": flag, "to_clock": info})
    out = out.withColumn("_tot", F.sum("share").over(w))
    return out.withColumns({"share": F.when(F.col("_tot") > cap, F.col("share") * cap / F.col("_tot")).otherwise(F.col("share")), "capped": F.col("_tot") > cap}).drop("_tot")


def removal_scores(e: DataFrame, heads: Scorer) -> DataFrame:
    """Probability of each event with and without each of its enablers: ``e`` with ``q_pre`` and ``q_removed``.

    ``e``: event_id, idx, kind, type, victim (of the event), ``pre`` (state before the event),
    ``action`` (what the enabler did), ``ref`` (state before that) and ``first``, true on one row
    of each event.  All states, the factual one of each event and one per enabler, are scored in
    one table: ``heads`` adds ``hazard`` (per slot), ``plant15`` and ``defuse15`` to wide states,
    and the event's type says which of them a row reads.  A removal that fails has no
    probability, and its reason in ``why``.

    States are made, edited and scored in one pass and never shuffled; what comes of them is one
    number per row.
    """
    done = E.without(F.col("pre"), F.col("kind"), F.col("action"), F.col("ref"))
    item = lambda idx, state, why: F.struct(idx.cast("int").alias("idx"), state.alias("edited"), why.alias("why"))
    fact = F.when(F.col("first"), item(F.lit(-1), F.col("pre"), F.col("pre.err")))
    gone = F.when(F.col("kind") != "info", E.bound(done, lambda x: item(F.col("idx"), F.when(x["err"].isNull(), x).otherwise(F.col("pre")), x["err"])))  # a state that failed is not shown to the heads
    states = e.select("event_id", "type", "victim", F.explode(F.array_compact(F.array(fact, gone))).alias("_x")).select("event_id", "type", "victim", "_x.*")
    scored = heads(E.wide(states, "edited"))
    slot = F.array_position(F.transform("players", lambda p: p["player_id"]), F.col("victim")).cast("int")
    head = F.try_element_at(F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv]), F.col("type"))
    q = F.when(head == "hazard", F.when(slot > 0, F.try_element_at("hazard", slot))).when(head == "plant15", F.col("plant15")).when(head == "defuse15", F.col("defuse15"))
    q = durable(scored.select("event_id", "idx", F.when(F.col("why").isNull(), q.cast("double")).alias("q"), "why"))
    pre = q.where("idx = -1").select("event_id", F.col("q").alias("q_pre"))
    out = e.drop("pre", "action", "ref", "first").join(pre, "event_id", "left")
    return out.join(q.where("idx >= 0").withColumnRenamed("q", "q_removed"), ["event_id", "idx"], "left")


def enabler_shares(games: DataFrame, states: DataFrame, windows: DataFrame, actions: DataFrame, heads: Scorer, width: int) -> DataFrame:
    """Shares of the enablers of all events, as ``assemble`` takes them.

    ``games`` are the event games (state before each window), ``states`` wide rows, from which
    the last state before an enabler is taken.
    """
    entry = "array<struct<action_id:string,beneficiary_id:bigint,kind:string>>"
    a = actions.select(*ROUND, F.col("action_id").alias("event_id"), "type", F.get_json_object("params", "$.victim_id").cast("bigint").alias("victim"), F.from_json("enablers", entry).alias("_e"))
    e = a.where(F.col("type").isin(*HEADS)).select(*ROUND, "event_id", "type", "victim", F.posexplode("_e").alias("idx", "_x"))
    e = e.select(*ROUND, "event_id", "type", "victim", "idx", F.col("_x.kind").alias("kind"), F.col("_x.action_id").alias("_link"), F.col("_x.beneficiary_id").alias("beneficiary_id"))
    m = windows.select(*ROUND, F.col("window_id").alias("game_id"), F.explode("member_action_ids").alias("event_id"))
    e = e.join(m, [*ROUND, "event_id"]).join(games.select("game_id", "pre"), "game_id")
    did = actions.select(*ROUND, F.col("action_id").alias("_link"), F.coalesce("tick", "window_start_tick").alias("_at"), E.action_struct().alias("action"))
    e = e.join(did, [*ROUND, "_link"], "left").withColumns({"link_id": F.when(F.col("action").isNotNull(), F.col("_link")), "_before": F.col("_at") - 1})
    e = asof(e, states.select(*ROUND, F.col("tick").alias("_t")), ROUND, "_before", "_t", [], width=width, right_tick="_ref")
    ref = states.select(*ROUND, F.col("tick").alias("_ref"), E.state_struct().alias("ref"))
    e = e.join(ref, [*ROUND, "_ref"], "left").withColumn("first", F.col("idx") == 0)
    e = durable(e.select("event_id", "idx", "type", "victim", "kind", "link_id", "beneficiary_id", "pre", "action", "ref", "first"))  # read twice
    return enabler_split(removal_scores(e, heads))


def distribute(phi: DataFrame, shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split each event's share: the enablers take theirs and the actor keeps the rest.

    ``phi``: event_id, phi.  Returns the actor amounts and the enabler amounts.
    """
    parts = shares.join(phi.select("event_id", "phi"), "event_id").withColumn("amount", F.col("share") * F.col("phi"))
    taken = parts.groupBy("event_id").agg(F.sum("amount").alias("_t"))
    own = phi.join(taken, "event_id", "left").withColumn("amount", F.col("phi") - F.coalesce("_t", F.lit(0.0))).drop("_t")
    return own, parts


# assembly


def actor_sign(side: Column) -> Column:
    return F.when(side == "ct", 1.0).when(side == "t", -1.0)


def clock_buckets(clock: DataFrame) -> DataFrame:
    """Clock of each round by sign: ``clock_ct`` gains, ``clock_t`` losses of the CT side."""
    c = F.col("clock")
    return clock.groupBy(*ROUND).agg(F.sum(F.greatest(c, F.lit(0.0))).alias("clock_ct"), F.sum(F.greatest(-c, F.lit(0.0))).alias("clock_t"))


def clock_by_source(clock: DataFrame) -> DataFrame:
    return clock.groupBy(*ROUND, "source").agg(F.sum("clock").alias("clock"))


def assemble(phi: DataFrame, moves: DataFrame, actions: DataFrame, shares: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One valued row per action, and clock rows made on the way.

    ``phi``: shares of window members; ``moves``: shares of movers (``action_id`` is the player
    id); ``shares``: enabler split of the events.  Pseudo-actions pay to their parent, moves
    to the rotation, hold or save that covers the interval's middle, else to a
    ``positioning`` row of the player, trade shares to a ``trade_setup`` row of the dead teammate.
    """
    acts = actions.select(*ROUND, "action_id", "actor_id_hash", "actor_side", "type", "window_start_tick", "window_end_tick", F.get_json_object("params", "$.parent_action_id").alias("parent"),
                          F.get_json_object("params", "$.victim_id").cast("bigint").alias("victim"))
    sides = acts.where("actor_id_hash is not null").groupBy(*ROUND, "actor_id_hash").agg(F.max("actor_side").alias("actor_side"))
    row = lambda d, bucket: d.select(*ROUND, "action_id", F.lit(bucket).alias("bucket"), F.col("amount").alias("amount"), "method", "n", "residual")
    d = phi.join(acts.select("action_id", "type", "parent"), "action_id").withColumn("event_id", F.col("action_id"))
    own = d.withColumn("amount", F.col("phi"))
    clock = None
    parts = []
    if shares is not None:
        kept, gave = distribute(d, shares)
        own = kept
        gave = gave.join(d.select("event_id", *ROUND, "method", "n", "residual"), "event_id")
        clock = gave.where("to_clock or link_id is null").select(*ROUND, F.col("amount").alias("clock"), F.when(F.col("to_clock"), "info").otherwise("enabler_unlinked").alias("source"))
        gave = gave.where("not to_clock and link_id is not null").withColumn("action_id", F.col("link_id"))
        dead = acts.select(F.col("action_id"), F.col("victim").alias("_dead"))
        gave = gave.join(dead, "action_id", "left")
        setup = ids.action_id(F.col("match_key"), F.col("round_num"), F.lit("trade_setup"), F.coalesce("beneficiary_id", "_dead"), F.lit(None))
        gave = gave.withColumn("action_id", F.when(F.col("kind") == "trade_setup", setup).otherwise(F.col("action_id")))
        parts.append(row(gave, "enabler"))
        names = gave.where("kind = 'trade_setup'").select(*ROUND, "action_id", F.coalesce("beneficiary_id", "_dead").alias("actor_id_hash"), F.lit("trade_setup").alias("type")).distinct()
    direct = own.withColumn("action_id", F.when(F.col("type").isin(*schemas.PSEUDO_TYPES), F.coalesce("parent", "action_id")).otherwise(F.col("action_id")))
    parts.append(row(direct, "direct"))
    m = moves.withColumns({"actor_id_hash": F.col("action_id").cast("bigint"), "mid2": F.col("start_tick") + F.col("end_tick")}).drop("action_id")
    cover = acts.where(F.col("type").isin(*MOVEMENT_TYPES)).select(*ROUND, "actor_id_hash", F.col("action_id").alias("_mv"), (F.col("window_start_tick") * 2).alias("_lo"), (F.col("window_end_tick") * 2).alias("_hi"))
    hit = range_join(cover, m.select(*ROUND, "actor_id_hash", "mid2").distinct(), [*ROUND, "actor_id_hash"], "_lo", "_hi", "mid2", 8192)
    hit = hit.groupBy(*ROUND, "actor_id_hash", "mid2").agg(F.min_by("_mv", F.struct("_lo", "_mv")).alias("_mv"))
    m = m.join(hit, [*ROUND, "actor_id_hash", "mid2"], "left")
    pos = ids.action_id(F.col("match_key"), F.col("round_num"), F.lit("positioning"), F.col("actor_id_hash"), F.lit(None))
    m = m.withColumns({"action_id": F.coalesce("_mv", pos), "amount": F.col("phi")})
    parts.append(row(m, "movement"))
    synth = m.where("_mv is null").select(*ROUND, "action_id", "actor_id_hash", F.lit("positioning").alias("type")).distinct()
    if shares is not None:
        synth = synth.unionByName(names)
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    ranks = F.create_map(*[F.lit(x) for kv in METHOD_RANK.items() for x in kv])
    pay = lambda b: F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("amount"))), F.lit(0.0))
    g = allp.groupBy(*ROUND, "action_id").agg(
        pay("direct").alias("d"), pay("enabler").alias("e"), pay("movement").alias("m"), F.max_by("method", F.element_at(ranks, F.col("method"))).alias("method"),
        F.max("n").alias("n_coalition"), F.max("residual").alias("residual"))
    real = acts.where(~F.col("type").isin(*schemas.PSEUDO_TYPES)).select(*ROUND, "action_id", "actor_id_hash", "actor_side", "type")
    who = real.unionByName(synth.join(sides, [*ROUND, "actor_id_hash"], "left").select(*ROUND, "action_id", "actor_id_hash", "actor_side", "type"))
    out = who.join(g, [*ROUND, "action_id"], "left").fillna(0.0, ["d", "e", "m"])
    sg = F.coalesce(actor_sign(F.col("actor_side")), F.lit(1.0))
    out = out.withColumns({"V_raw": F.col("d") + F.col("e") + F.col("m"), "V_direct": sg * F.col("d") + F.lit(0.0), "V_enabler": sg * F.col("e") + F.lit(0.0), "V_movement": sg * F.col("m") + F.lit(0.0)})
    return out.withColumn("V", F.col("V_direct") + F.col("V_enabler") + F.col("V_movement")).drop("d", "e", "m"), clock


def conservation(valued: DataFrame, clock: DataFrame, tele: DataFrame) -> DataFrame:
    """Per round: sum of V_raw plus the clock equals the change of W; tolerance by method."""
    v = valued.groupBy(*ROUND).agg(F.sum("V_raw").alias("v_sum"), F.coalesce(F.bool_or(F.col("method") == "sampled"), F.lit(False)).alias("_s"))
    out = tele.select(*ROUND, "w_start", "w_end").join(v, ROUND, "left").join(clock_buckets(clock), ROUND, "left").fillna(0.0, ["v_sum", "clock_ct", "clock_t"])
    out = out.withColumn("residual", F.col("v_sum") + F.col("clock_ct") - F.col("clock_t") - (F.col("w_end") - F.col("w_start")))
    tol = F.when(F.coalesce("_s", F.lit(False)), A["tol_sampled"]).otherwise(A["tol_exact"])
    return out.withColumn("ok", F.abs("residual") <= tol).drop("_s")


def movement_spread(moves: DataFrame) -> DataFrame:
    """Deviation of the movement credit over the players of a round; rounds with one player are left out."""
    p = moves.groupBy(*ROUND, "action_id").agg(F.sum("phi").alias("m"))
    return p.groupBy(*ROUND).agg(F.stddev_pop("m").alias("spread"), F.count(F.lit(1)).alias("n")).where("n >= 2")


def attribute(states: DataFrame, actions: DataFrame, windows: DataFrame, scorer: Scorer, *, width: int, shares: DataFrame | None = None, heads: Scorer | None = None) -> dict[str, DataFrame]:
    """Valued actions, clock and conservation of every round of a wide state table.

    With ``heads`` (or given ``shares``) the enablers of an event are paid out of its share.
    """
    scored = durable(pin_terminal(scorer(states)))
    spans = window_spans(scored, windows, width)
    iv = durable(deltas(intervals(scored, spans, width), scored.select(*ROUND, "tick", "W")))
    ev, mv = event_games(iv, scored, windows, actions), mover_games(iv, scored)
    if shares is None and heads is not None:
        ev = durable(ev)
        shares = durable(enabler_shares(ev, scored, windows, actions, heads, width))
    phi, c1 = solve(ev, scorer, drift=False)
    moves, c2 = solve(mv, scorer, drift=True)
    phi, moves = durable(phi), durable(moves)
    valued, c3 = assemble(phi, moves, actions, shares)
    cols = [*ROUND, "clock", "source"]
    clock = c1.select(*cols).unionByName(c2.select(*cols))
    if c3 is not None:
        clock = clock.unionByName(c3.select(*cols))
    valued, clock, tele = durable(valued), durable(clock), telescoping(iv)
    return {"valued": valued, "clock": clock, "telescoping": tele, "conservation": conservation(valued, clock, tele), "phi": phi, "moves": moves, "intervals": iv, **({} if shares is None else {"shares": shares})}
