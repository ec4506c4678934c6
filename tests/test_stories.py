"""The scripted matches end to end: action counts, states, labels, leaks, attribution, gate."""

import pytest
from pyspark.sql import functions as F

from stories import BLIND, CY, DEE, FIRST_KILL, FLASH, BO, KILLS, PLANT, RATE, WOUNDS, story_feed, tables
from tickledger.functions.ids import player_id_hash
from tickledger.operators import actions as A
from tickledger.operators import attribution as T
from tickledger.operators import audit, gate
from tickledger.operators import dataset as P
from tickledger.operators import edits as E
from tickledger.operators import sampling as C
from tickledger.operators import state as D
from tickledger.operators import windows as W
from tickledger.operators.scan import durable
from tickledger.plans.analyze import analyze, rule_heads, rule_scorer

NAMES = ["blinded", "handover"]


@pytest.fixture(scope="module")
def feed(spark):
    return story_feed(spark, NAMES, 16)


@pytest.fixture(scope="module")
def run(feed):
    return analyze(feed, rule_scorer, hz=1.0, movement=False)


def test_action_counts(run):
    n = {(r["match_key"], r["type"]): r["count"] for r in run["actions"].groupBy("match_key", "type").count().collect()}
    for s in NAMES:
        assert n[s, "kill"] == len(KILLS) and n[s, "damage"] == 2 and n[s, "smoke"] == 1 and n[s, "smoke_pop"] == 1 and n[s, "plant_complete"] == 2
        assert n[s, "buy"] == 8 and n[s, "team_buy"] == 4 and n[s, "he"] == 1
    assert n["blinded", "flash"] == 1 and n["handover", "drop"] == 1 and ("blinded", "drop") not in n


def test_actions_are_valid_and_unique(run):
    assert A.invalid_actions(run["actions"]).count() == 0
    assert A.duplicate_ids(run["actions"]).count() == 0
    assert W.overlaps(run["windows"], 2048).count() == 0


def test_flash_params_and_enabler(run):
    f = run["actions"].where("type = 'flash'").select(F.from_json(F.get_json_object("params", "$.blinded_enemies"), "array<struct<id:bigint,duration:double>>").alias("b")).first()["b"]
    assert sorted(x["duration"] for x in f) == pytest.approx(sorted(BLIND.values()))
    k = run["actions"].where(f"match_key = 'blinded' and type = 'kill' and tick = {FIRST_KILL}").first()
    assert '"kind":"flash"' in k["enablers"]


def test_states_are_consistent(run):
    assert audit.violations(run["states"]).collect() == []


def test_state_values(run, spark):
    who = {p: spark.range(1).select(player_id_hash(F.lit(i))).first()[0] for p, i in (("bo", BO), ("cy", CY), ("dee", DEE))}
    s = run["states"].where(f"match_key = 'blinded' and round_num = 1 and tick = {FIRST_KILL + 1}").first()
    by = {p["player_id"]: p for p in s["players"]}
    assert s["ctx_alive_ct"] == 2 and s["ctx_alive_t"] == 1
    assert by[who["dee"]]["alive"] == 0 and by[who["dee"]]["weapon_class"] is None and by[who["bo"]]["kills_round"] == 1.0
    assert by[who["cy"]]["health"] == 100.0 - WOUNDS[CY][0] and abs(by[who["cy"]]["flash_duration_remaining"] - (BLIND[CY] - (FIRST_KILL + 1 - FLASH) / RATE)) < 1e-5
    assert [u["kind"] for u in s["utility"]] == ["smoke"] and s["ctx_n_active_smokes"] == 1


def test_labels(run):
    rows = run["states"].where("match_key = 'blinded' and round_num = 1").select("tick", "y_plant_within_15s", "y_round_won_ct", "y_is_terminal").collect()
    for r in rows:
        want = None if r["tick"] > PLANT else int(PLANT < r["tick"] + 15 * RATE)
        assert r["y_plant_within_15s"] == want and r["y_round_won_ct"] == 1
    assert sum(r["y_is_terminal"] for r in rows) == 1


def test_conservation(run):
    rows = run["conservation"].collect()
    assert len(rows) == 4 and all(r["ok"] and abs(r["residual"]) < 1e-9 for r in rows)
    assert T.tiling_problems(run["intervals"], run["states"].groupBy("match_key", "round_num").agg(F.min("tick").alias("freeze_end_tick"), F.max("tick").alias("terminal")), 2048).count() == 0


def test_kill_and_plant_values(run):
    v = run["valued"].where("match_key = 'handover' and round_num = 1 and abs(V) > 1e-9").select("type", F.round("V", 6).alias("V")).collect()
    assert sorted((r["type"], r["V"]) for r in v) == [("kill", 0.1), ("kill", 0.1), ("plant_complete", 0.15)]


def test_undo_everything_gives_the_state_before(run):
    spans = T.window_spans(run["states"], run["windows"], 2048)
    scored = T.pin_terminal(rule_scorer(run["states"]))
    iv = T.deltas(T.intervals(scored, spans, 2048), scored.select("match_key", "round_num", "tick", "W"))
    g = T.event_games(iv, scored, run["windows"], run["actions"]).withColumn("mask", F.lit(0).cast("bigint"))
    e = E.apply_cases(g).select("edited.err", (F.transform("edited.players", lambda p: p["alive"]) == F.transform("pre.players", lambda p: p["alive"])).alias("a"),
                                (F.transform("edited.players", lambda p: p["health"]) == F.transform("pre.players", lambda p: p["health"])).alias("h"), (F.col("edited.ctx.bomb_planted") == F.col("pre.ctx.bomb_planted")).alias("b")).collect()
    assert len(e) >= 8 and all(r["err"] is None and r["a"] and r["h"] and r["b"] for r in e)


def test_gate_passes_a_sound_rule_and_fails_its_reverse(run):
    spans = T.window_spans(run["states"], run["windows"], 2048)
    scored = T.pin_terminal(rule_scorer(run["states"]))
    iv = T.deltas(T.intervals(scored, spans, 2048), scored.select("match_key", "round_num", "tick", "W"))
    cases = durable(gate.samples(T.event_games(iv, scored, run["windows"], run["actions"]), T.mover_games(iv, scored)))
    good = {r["test"]: r for r in gate.report(gate.run_cases(cases, rule_scorer)).collect()}
    assert all(good[t]["passed"] for t in ("unkill", "smoke", "unflash", "unplant", "freeze"))
    flipped = lambda d: rule_scorer(d).withColumn("W", 1 - F.col("W"))
    bad = {r["test"]: r for r in gate.report(gate.run_cases(cases, flipped)).collect()}
    assert not bad["unkill"]["passed"] and not bad["unplant"]["passed"]


def test_outcome_flip_changes_no_feature(spark):
    feed = story_feed(spark, ["blinded"], 64)
    rounds = C.with_terminal(feed["rounds"])
    smp = durable(C.grid_ticks(rounds, 128, 0.25).withColumns({"kinds": F.array(F.lit("grid")), "t_s": F.lit(0.0)}))
    a = D.build(feed, smp).assemble()
    b = D.build(audit.flip_outcome(feed, "blinded", 1, 5 * 128), smp).assemble()
    a, b = (d.where("match_key = 'blinded' and round_num = 1") for d in (a, b))
    assert audit.leak_differences(a, b).count() == 0


def test_flat_vector_and_tensors(run):
    f = P.flatten(run["states"]).where("match_key = 'handover' and round_num = 1").where(F.col("tick") == FIRST_KILL + 1).first()
    assert f["ct_alive"] == 2 and f["t_alive"] == 1 and f["t0_health"] == 100.0 - WOUNDS[CY][0] and f["ct_hp_sum"] == 200.0
    t = P.tensorize(run["states"]).first()
    assert len(t["player_num"]) == 10 and len(t["util_num"]) == 16 and sum(t["player_mask"]) == 4


def test_story_rows_are_scripted():
    t = tables("handover", 64)
    assert [r["event"] for r in t["items"]] == ["drop", "pickup"] and t["flashes"] == [] and t["rounds"][1]["end_reason"] == "t_win_bomb"


def test_enablers_are_paid_out_of_their_events(run, feed):
    """With heads the flash before the first kill gets a part of it, and every round still adds up."""
    out = T.attribute(run["states"], run["actions"], run["windows"], rule_scorer, width=feed.width, heads=rule_heads)
    assert all(r["ok"] and abs(r["residual"]) < 1e-9 for r in out["conservation"].collect())
    shares = out["shares"].where("kind = 'flash'").collect()
    assert shares and all(r["q_removed"] is not None and r["q_removed"] < r["q_pre"] and 0 < r["share"] <= 1 for r in shares)
    flash = out["valued"].where("type = 'flash' and abs(V_enabler) > 1e-9").select("V_enabler").collect()
    before = {r["action_id"]: r["V_raw"] for r in run["valued"].where("type = 'kill'").select("action_id", "V_raw").collect()}
    after = {r["action_id"]: r["V_raw"] for r in out["valued"].where("type = 'kill'").select("action_id", "V_raw").collect()}
    assert flash and any(abs(after[k]) < abs(before[k]) - 1e-9 for k in before)


def test_cut_actions_can_be_redone(run):
    """All members of every window undone and redone: the state after, field by field."""
    spans = T.window_spans(run["states"], run["windows"], 2048)
    scored = T.pin_terminal(rule_scorer(run["states"]))
    iv = T.deltas(T.intervals(scored, spans, 2048), scored.select("match_key", "round_num", "tick", "W"))
    g = durable(T.event_games(iv, scored, run["windows"], run["actions"]))
    back = g.withColumn("undone", E.undo_all(F.col("post"), F.col("pre"), F.reverse("members"))).withColumn("again", E.redo_all(F.col("undone"), F.col("post"), F.col("members")))
    fields = ("player_id", "alive", "health", "armor", "x", "weapon_class", "has_c4", "kills_round", "flash_duration_remaining", "money")
    shown = lambda c: F.transform(f"{c}.players", lambda p: F.struct(*[p[f].alias(f) for f in fields]))
    rows = back.select("again.err", (shown("again") == shown("post")).alias("same"), (F.col("again.ctx.bomb_planted") == F.col("post.ctx.bomb_planted")).alias("plant")).collect()
    assert len(rows) >= 8 and all(r["err"] is None and r["same"] and r["plant"] for r in rows)


def test_tree_of_coalitions_equals_single_folds(run):
    spans = T.window_spans(run["states"], run["windows"], 2048)
    scored = T.pin_terminal(rule_scorer(run["states"]))
    iv = T.deltas(T.intervals(scored, spans, 2048), scored.select("match_key", "round_num", "tick", "W"))
    g = durable(T.event_games(iv, scored, run["windows"], run["actions"]).select("game_id", "n", "pre", "post", "members"))
    tree = durable(E.coalition_tree(g).select("game_id", "n", "pre", "post", "members", "mask", F.col("edited").alias("tree")))
    one = E.apply_cases(tree)
    assert one.where((F.col("mask") < F.expr("shiftleft(1, n) - 1")) & (F.to_json("edited") != F.to_json("tree"))).count() == 0
    assert tree.groupBy("game_id", "n").count().where("count <> shiftleft(1, n)").count() == 0


def test_states_of_added_samples_equal_a_full_build(feed):
    """States built for some ticks and then for more equal those built at once."""
    rounds = C.with_terminal(feed["rounds"], feed["ticks"])
    some = durable(C.grid_ticks(rounds, feed.tick_rate, 0.25).withColumns({"kinds": F.array(F.lit("grid")), "t_s": F.lit(0.0)}))
    every = durable(C.grid_ticks(rounds, feed.tick_rate, 0.5).withColumns({"kinds": F.array(F.lit("grid")), "t_s": F.lit(0.0)}))
    every = every.unionByName(some.join(every.select("match_key", "round_num", "tick"), ["match_key", "round_num", "tick"], "left_anti"))
    a, b = D.build(feed, every).assemble(), D.extend(feed, D.build(feed, some), every).assemble()
    rows = lambda d: sorted(d.select(F.to_json(F.struct("*")).alias("j")).toPandas()["j"])
    assert rows(a) == rows(b) and some.count() < every.count() == b.count()
