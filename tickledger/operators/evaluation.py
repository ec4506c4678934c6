"""Anchors, review sets, robustness, usage and the adoption rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import stats
from ..functions.exprs import lookup_map, nan_null
from ..functions.weapons import disadvantage
from .calibration import ece, reliability
from .feed import ROUND
from .scan import settled

# fixed values: bands and limits of the anchors
OPENING_BAND, EQUIP_RATIO_BAND, RATING_RHO_MIN, CLUTCH_TIME_S, TIME_BUCKET_S, MIN_GROUP_N = (0.05, 0.20), (0.8, 1.25), 0.6, 10.0, 10.0, 5
SITUATIONS = {"3v2": (3, 2), "2v3": (2, 3), "1v2": (1, 2)}
CATEGORIES = ["opening_kill", "trade", "flash_assisted_kill", "smoke_covered_plant", "clutch", "save", "double_kill_same_tick", "clock_decided", "eco_win", "failed_defuse"]
CLOCK_REASONS = ["target_saved", "time_ran_out", "targetsaved", "round_time_expired"]
PISTOL_ROUNDS = [1, 13]
ASPECTS = ["V", "D", "X", "panel"]
JUDGEMENTS = ["agree", "disagree", "unsure", "todo"]


# enrichment


def enrich(scored: DataFrame, actions: DataFrame, states: DataFrame, width: int) -> DataFrame:
    """Scored actions with their action columns and the latest state at or before their pre tick."""
    from .scan import asof

    prm = lambda k: F.get_json_object("params", f"$.{k}")
    kinds = F.array_sort(F.array_distinct(F.transform(F.from_json("enablers", "array<struct<kind:string>>"), lambda e: e["kind"])))
    a = actions.select(
        "action_id", "tick", "state_pre_tick", "subtype", prm("weapon_class").alias("weapon_class"), prm("victim_id").cast("bigint").alias("victim_id"),
        prm("team_class").alias("team_class"), kinds.alias("enabler_kinds"), F.coalesce("state_pre_tick", F.col("tick") - 1).alias("_at"),
        prm("ct_alive").cast("bigint").alias("_ct"), prm("t_alive").cast("bigint").alias("_t"))
    r = scored.join(a.select("action_id", *[c for c in a.columns if c not in scored.columns]), "action_id", "left")
    cols = {"ctx_alive_ct": "alive_ct_pre", "ctx_alive_t": "alive_t_pre", "ctx_equip_ct": "equip_ct_pre", "ctx_equip_t": "equip_t_pre",
            "ctx_time_remaining_s": "time_remaining_s_pre", "ctx_bomb_planted": "bomb_planted_pre", "ctx_map_version": "map_version"}
    s = states.select(*ROUND, F.col("tick").alias("_st"), *[F.col(k).alias(v) for k, v in cols.items()], F.col("players").alias("_players"))
    r = asof(r, s, ROUND, "_at", "_st", [*cols.values(), "_players"], width=width, right_tick="_st", tie=["alive_ct_pre"])
    victim = F.filter("_players", lambda p: p["player_id"] == F.col("victim_id"))
    lab = states.groupBy(*ROUND).agg(F.first("y_round_won_ct", ignorenulls=True).alias("round_won_ct"), F.first("y_round_end_reason", ignorenulls=True).alias("round_end_reason"))
    r = r.withColumn("victim_weapon_class", F.try_element_at(victim, F.lit(1))["weapon_class"]).join(lab, ROUND, "left")
    none = F.col("_st").isNull()
    r = r.withColumns({"alive_ct_pre": F.when(none, F.col("_ct")).otherwise(F.col("alive_ct_pre")), "alive_t_pre": F.when(none, F.col("_t")).otherwise(F.col("alive_t_pre"))})
    return r.drop("_at", "_ct", "_t", "_st", "_players")


def own_enemy_alive() -> tuple[Column, Column]:
    """Living players of the actor's side and of the other side."""
    ct, t = F.col("alive_ct_pre"), F.col("alive_t_pre")
    own = F.when(F.col("actor_side") == "ct", ct).when(F.col("actor_side") == "t", t)
    return own, F.when(F.col("actor_side") == "ct", t).when(F.col("actor_side") == "t", ct)


# anchors


def first_kills(df: DataFrame) -> DataFrame:
    """First kill of each round by tick, then id."""
    k = df.where((F.col("type") == "kill") & F.col("tick").isNotNull())
    first = k.groupBy(*ROUND).agg(F.min(F.struct("tick", "action_id")).alias("_f"))
    return k.join(first, ROUND).where((F.col("tick") == F.col("_f.tick")) & (F.col("action_id") == F.col("_f.action_id"))).drop("_f")


def opening_kill_band(df: DataFrame) -> DataFrame:
    """Mean and median |V| of balanced 5v5 opening kills, overall and by map; unknown counts are counted apart."""
    k = first_kills(df)
    ct, t = nan_null(F.col("equip_ct_pre")), nan_null(F.col("equip_t_pre"))
    no_eq = ct.isNull() | t.isNull() | (t <= 0)
    no_alive = F.col("alive_ct_pre").isNull() | F.col("alive_t_pre").isNull()
    ratio = F.try_divide(ct, t)
    even = (F.col("alive_ct_pre") == 5) & (F.col("alive_t_pre") == 5) & ratio.between(*EQUIP_RATIO_BAND)
    why = F.when(no_eq, "unknown_equipment").when(no_alive, "unknown_alive").when(~even, "unbalanced").otherwise("used")
    k = k.withColumns({"_why": why, "_v": F.abs(nan_null(F.col("V_direct"))), "map_version": F.coalesce("map_version", F.lit("unknown"))})
    use = F.when(F.col("_why") == "used", F.col("_v"))
    out = k.groupingSets([["map_version"], []], "map_version").agg(
        F.count(use).alias("n"), F.avg(use).alias("value"), F.median(use).alias("median"),
        *[F.count_if(F.col("_why") == w).alias(f"n_{w}") for w in ("unbalanced", "unknown_equipment", "unknown_alive")])
    status = F.when(F.col("n") == 0, "no_data").when(F.col("value").between(*OPENING_BAND), "in_band").otherwise("out_of_band")
    return out.withColumn("status", status)


def duel_levels(df: DataFrame) -> DataFrame:
    """Mean V of kills by weapon disadvantage of the killer."""
    d = disadvantage(F.col("weapon_class"), F.col("victim_weapon_class"))
    k = df.where(F.col("type") == "kill").withColumns({"level": d, "_v": nan_null(F.col("V"))}).where("level is not null and _v is not null")
    return k.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean_V"))


def duel_difficulty(df: DataFrame, min_n: int = MIN_GROUP_N) -> tuple[DataFrame, DataFrame]:
    """Rank correlation of level and mean V, and rifle against rifle next to rifle against pistol per alive difference."""
    rho = stats.spearman(duel_levels(df).where(F.col("n") >= min_n), [], "level", "mean_V")
    own, enemy = own_enemy_alive()
    diff = F.coalesce(F.greatest(F.lit(-3), F.least(F.lit(3), own - enemy)).cast("int").cast("string"), F.lit("all"))
    k = df.where((F.col("type") == "kill") & (F.col("weapon_class") == "rifle") & F.col("victim_weapon_class").isin("rifle", "pistol"))
    rr, rp = (F.when(F.col("victim_weapon_class") == w, nan_null(F.col("V"))) for w in ("rifle", "pistol"))
    c = k.groupBy(diff.alias("alive_diff")).agg(F.avg(rr).alias("rifle_vs_rifle"), F.count(rr).alias("n_rr"), F.avg(rp).alias("rifle_vs_pistol"), F.count(rp).alias("n_rp"))
    return rho, c.where((F.col("n_rr") >= min_n) & (F.col("n_rp") >= min_n)).withColumn("ok", F.col("rifle_vs_rifle") > F.col("rifle_vs_pistol"))


def man_advantage(states: DataFrame, w: str, ct: str, t: str, remaining: str, planted: str, min_n: int = MIN_GROUP_N, bucket_s: float = TIME_BUCKET_S) -> DataFrame:
    """Mean W of 3v2, 2v3 and 1v2 over strata of clock bucket and bomb state; a stratum weighs its smallest count."""
    s = states.where(nan_null(F.col(w)).isNotNull() & F.col(remaining).isNotNull() & F.col(planted).isNotNull())
    hit = {k: (F.col(ct) == a) & (F.col(t) == b) for k, (a, b) in SITUATIONS.items()}
    g = s.groupBy(F.floor(F.col(remaining) / bucket_s).alias("_b"), F.col(planted).alias("_p")).agg(
        *[F.count_if(c).alias(f"n_{k}") for k, c in hit.items()], *[F.avg(F.when(c, F.col(w))).alias(f"m_{k}") for k, c in hit.items()])
    g = g.withColumn("_w", F.least(*[F.col(f"n_{k}") for k in hit])).where(F.col("_w") >= min_n)
    means = [(F.sum(F.col("_w") * F.col(f"m_{k}")) / F.sum("_w")).alias(f"W_{k}") for k in hit]
    out = g.agg(F.count(F.lit(1)).alias("n_strata"), F.sum("_w").alias("n"), *means)
    return out.withColumn("ok", (F.col("W_3v2") > F.col("W_2v3")) & (F.col("W_2v3") > F.col("W_1v2")))


def kill_swing(df: DataFrame, min_n: int = MIN_GROUP_N) -> DataFrame:
    """Mean |V| of a kill that turns 1v2 into 1v1 next to one that turns 4v5 into 4v4."""
    own, enemy = own_enemy_alive()
    v = F.abs(nan_null(F.col("V_direct")))
    a, b = F.when((own == 1) & (enemy == 2), v), F.when((own == 4) & (enemy == 5), v)
    out = df.where(F.col("type") == "kill").agg(F.count(a).alias("n_2v1"), F.avg(a).alias("swing_2v1"), F.count(b).alias("n_5v4"), F.avg(b).alias("swing_5v4"))
    enough = (F.col("n_2v1") >= min_n) & (F.col("n_5v4") >= min_n)
    return out.withColumn("ok", F.when(enough, F.col("swing_2v1") > F.col("swing_5v4")))


def clutch_defuse(df: DataFrame, time_s: float = CLUTCH_TIME_S) -> DataFrame:
    """Mean V of defuse starts and aborts of a last defender with little time left."""
    d = df.where((F.col("alive_ct_pre") == 1) & (F.col("alive_t_pre") >= 1) & (F.col("time_remaining_s_pre") < time_s))
    a, b = (F.when(F.col("type") == t, nan_null(F.col("V"))) for t in ("defuse_start", "defuse_abort"))
    out = d.agg(F.count(a).alias("n_start"), F.avg(a).alias("start"), F.count(b).alias("n_abort"), F.avg(b).alias("abort"))
    return out.withColumn("ok", F.when(F.col("n_start") > 0, (F.col("start") > 0) & (F.col("abort").isNull() | (F.col("abort") < 0))))


def rating_pairs(df: DataFrame, ratings: DataFrame) -> DataFrame:
    """Sum of V per match and player next to the player's rating: ``match_key, actor_id_hash, sum_V, rating``."""
    v = df.where(F.col("actor_id_hash").isNotNull() & nan_null(F.col("V")).isNotNull())
    v = v.groupBy("match_key", "actor_id_hash").agg(F.sum("V").alias("sum_V"))
    return v.join(ratings.where("rating is not null"), ["match_key", "actor_id_hash"])


def rating_correlation(pairs: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rank correlation and the largest rank gaps."""
    pairs = settled(pairs)  # sums of V have the same digits wherever they are read
    rho = stats.spearman(pairs, [], "sum_V", "rating")
    r = pairs
    for c, n in (("sum_V", "_a"), ("rating", "_b")):
        r = r.join(stats.value_ranks(pairs, [], c, n).drop("n"), c)
    gaps = r.withColumn("rank_gap", F.col("_a") - F.col("_b")).drop("_a", "_b").orderBy(F.desc(F.abs("rank_gap")), "match_key", "actor_id_hash").limit(top)
    return rho, gaps


def anchor_table(df: DataFrame, states: DataFrame | None = None, w: str = "W") -> DataFrame:
    """Every anchor as a row ``(name, n, value, status)``."""
    row = lambda d, name, n, value, status: d.select(F.lit(name).alias("name"), n.cast("bigint").alias("n"), value.cast("double").alias("value"), status.alias("status"))
    st = lambda ok: F.when(ok.isNull(), "no_data").when(ok, "in_band").otherwise("out_of_band")
    o = opening_kill_band(df).where("map_version is null")
    rho, cmp = duel_difficulty(df)
    worst = cmp.agg(F.bool_and("ok").alias("c"))
    duel = rho.join(worst, F.lit(True))
    ok = F.when(F.col("rho").isNotNull() | F.col("c").isNotNull(), F.coalesce(F.col("rho") > 0, F.lit(True)) & F.coalesce("c", F.lit(True)))
    k, c = kill_swing(df), clutch_defuse(df)
    out = row(o, "opening_kill", F.col("n"), F.col("value"), F.col("status")).unionByName(row(duel, "duel_difficulty", F.col("n"), F.col("rho"), st(ok)))
    out = out.unionByName(row(k, "kill_swing", F.col("n_2v1") + F.col("n_5v4"), F.col("swing_2v1") - F.col("swing_5v4"), st(F.col("ok"))))
    out = out.unionByName(row(c, "clutch_defuse", F.col("n_start") + F.col("n_abort"), F.col("start"), st(F.col("ok"))))
    if states is not None:
        m = man_advantage(states, w, "ctx_alive_ct", "ctx_alive_t", "ctx_time_remaining_s", "ctx_bomb_planted")
        out = out.unionByName(row(m, "man_advantage", F.col("n"), F.col("W_3v2") - F.col("W_1v2"), st(F.when(F.col("n") > 0, F.col("ok")))))
    return out


# review sets


def round_categories(df: DataFrame) -> DataFrame:
    """Category flags of each round and their bitmask ``cats``."""
    own, enemy = own_enemy_alive()
    t = F.col("type")
    kill = t.isin("kill", "team_kill")
    by = lambda k: F.coalesce(F.array_contains("enabler_kinds", k), F.lit(False))
    tick = F.when(kill, F.col("tick"))
    lost = lambda s: F.max(F.when((t == "team_buy") & (F.col("actor_side") == s), F.col("team_class")))
    won = F.max("round_won_ct")
    win_cls, lose_cls = F.when(won == 1, lost("ct")).when(won == 0, lost("t")), F.when(won == 1, lost("t")).when(won == 0, lost("ct"))
    poor = lambda c: c.isin("pistol", "eco")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    flags = {
        "opening_kill": any_(t == "kill"), "trade": any_((t == "trade_setup") | (kill & by("trade_setup"))), "flash_assisted_kill": any_(kill & by("flash")),
        "smoke_covered_plant": any_((t == "plant_complete") & by("smoke_cover")), "clutch": any_((own == 1) & (enemy >= 2)), "save": any_(t == "save"),
        "double_kill_same_tick": F.count(tick) > F.countDistinct(tick),
        "clock_decided": any_(F.lower("round_end_reason").isin(*CLOCK_REASONS)),
        "eco_win": F.coalesce(~F.first("round_num").isin(*PISTOL_ROUNDS) & poor(win_cls) & ~F.coalesce(poor(lose_cls), F.lit(False)), F.lit(False)),
        "failed_defuse": any_(t == "defuse_abort"),
    }
    out = df.withColumn("_rn", F.col("round_num")).groupBy(*ROUND).agg(*[c.alias(n) for n, c in flags.items()])
    mask = sum((F.col(n).cast("int") * (1 << i) for i, n in enumerate(CATEGORIES[1:], 1)), F.col(CATEGORIES[0]).cast("int"))
    return out.withColumn("cats", mask)


def select_review_rounds(cats: DataFrame, n: int = 20, seed: int = 1337, exclude: DataFrame | None = None) -> DataFrame:
    """``n`` rounds that cover every category present, then a seeded fill, rounds with categories first.

    Rounds are reduced to one per distinct mask (at most 1024) by a seeded order; the cover
    is chosen on that small result.
    """
    pool = cats if exclude is None else cats.join(exclude, ROUND, "left_anti")
    pool = pool.withColumn("_h", F.xxhash64(*ROUND, F.lit(seed)))
    reps = pool.groupBy("cats").agg(F.min(F.struct("_h", *ROUND)).alias("r")).collect()
    left = 0
    for r in reps:
        left |= r["cats"]
    chosen = []
    while left and len(chosen) < n:
        best = max(reps, key=lambda r: (bin(r["cats"] & left).count("1"), -r["r"]["_h"]))
        if not best["cats"] & left:
            break
        chosen.append((best["r"]["match_key"], best["r"]["round_num"], len(chosen) + 1))
        left &= ~best["cats"]
    spark = cats.sparkSession
    picked = spark.createDataFrame(chosen, "match_key string, round_num int, pos int")
    rest = pool.join(picked.select(*ROUND), ROUND, "left_anti").orderBy((F.col("cats") == 0).cast("int"), "_h", *ROUND).limit(max(0, n - len(chosen)))
    out = pool.join(picked, ROUND).select(*ROUND, "cats", "pos").unionByName(rest.select(*ROUND, "cats", F.lit(None).cast("int").alias("pos")))
    return out.withColumn("categories", F.array_compact(F.array(*[F.when(F.getbit("cats", F.lit(i)) == 1, F.lit(c)) for i, c in enumerate(CATEGORIES)])))


def top_actions(df: DataFrame, k: int = 3) -> DataFrame:
    """The k actions of each round with the largest |V|, ties by id."""
    v = F.abs(F.coalesce(nan_null(F.col("V")), F.lit(0.0)))
    # k per part of a round first, so a huge round is not ranked in one task
    part = df.withColumns({"_v": v, "_p": F.pmod(F.xxhash64("action_id"), F.lit(64))})
    rn = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy(F.desc("_v"), "action_id"))
    part = part.withColumn("rank", rn(*ROUND, "_p")).where(F.col("rank") <= k)
    return part.withColumn("rank", rn(*ROUND)).where(F.col("rank") <= k).drop("_v", "_p")


CASE_RE = r"<!--\s*case\s+index=(\d+)\s+match_key=(\S+)\s+round_num=(-?\d+)\s*-->"


def review_judgements(lines: DataFrame) -> DataFrame:
    """Rows of a review log: case, rank, action and one judgement per aspect.

    ``lines``: log (name), line (number), text.  A log is a hand-written file of some
    hundred lines, so its header is carried along its own lines.
    """
    w = Window.partitionBy("log").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("text").rlike(CASE_RE), F.struct(*[F.regexp_extract("text", CASE_RE, i).alias(n) for i, n in ((1, "i"), (2, "m"), (3, "r"))]))
    r = lines.withColumns({"_c": F.last(head, ignorenulls=True).over(w), "_s": F.trim("text")}).where("_c is not null")
    note = r.where(F.col("_s").startswith("Comment:")).groupBy("log", F.col("_c.i").alias("_i")).agg(F.max_by(F.trim(F.substring("_s", 9, 10000)), "line").alias("comment"))
    cells = F.transform(F.split(F.regexp_replace("_s", r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    r = r.where(F.col("_s").startswith("|")).withColumn("_x", cells).where((F.size("_x") == 3 + len(ASPECTS)) & F.col("_x")[0].rlike(r"^\d+$"))
    word = lambda c: F.when(c == "", F.lit("todo")).otherwise(F.regexp_extract(F.lower(c), "^([a-z]*)", 1))
    out = r.select("log", "line", F.col("_c.i").cast("int").alias("round_index"), F.col("_c.m").alias("match_key"), F.col("_c.r").cast("int").alias("round_num"),
                   F.col("_x")[0].cast("int").alias("rank"), F.col("_x")[1].alias("action"), F.col("_x")[2].alias("action_id"), *[word(F.col("_x")[3 + i]).alias(a) for i, a in enumerate(ASPECTS)])
    return out.join(note, (out["log"] == note["log"]) & (out["round_index"] == note["_i"].cast("int")), "left").drop(note["log"]).drop("_i")


def review_items(j: DataFrame) -> DataFrame:
    """Every disagreement as a numbered item in log order."""
    pairs = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(a).alias("aspect"), F.col(a).alias("w")) for i, a in enumerate(ASPECTS)])
    r = j.withColumn("_p", F.explode(pairs)).where(F.col("_p.w") == "disagree")
    return r.withColumn("item", F.row_number().over(Window.partitionBy("log").orderBy("line", "_p.o"))).select(
        "log", "item", "round_index", "match_key", "round_num", "rank", "action_id", F.col("_p.aspect").alias("aspect"), "comment", "line")


def review_summary(j: DataFrame, max_disagree: int = 2) -> DataFrame:
    """Counts per judgement and whether the cycle met its target."""
    words = F.array(*ASPECTS)
    n = lambda w: F.sum(F.size(F.filter(words, lambda x: x == w))).alias(w)
    out = j.groupBy("log").agg(F.countDistinct("round_index").alias("rounds"), F.count(F.lit(1)).alias("judgements"), *[n(w) for w in JUDGEMENTS],
                               F.count_if(F.array_contains(words, "disagree")).alias("disagree_rows"))
    return out.withColumn("target_met", (F.col("todo") == 0) & (F.col("disagree_rows") <= max_disagree))


# robustness, usage, adoption


def out_of_map_gap(default: DataFrame, holdout: DataFrame) -> DataFrame:
    """Metrics of the default and the held-out model side by side; both frames have one row."""
    c = ["logloss", "brier", "ece"]
    j = default.select(*[F.col(x).alias(f"{x}_default") for x in c]).join(holdout.select(*[F.col(x).alias(f"{x}_holdout") for x in c]), F.lit(True))
    j = j.withColumns({f"{x}_gap": F.col(f"{x}_holdout") - F.col(f"{x}_default") for x in c})
    return j.withColumn("warning", F.when(F.col("logloss_gap") > 0, F.format_string("unseen map costs %+.4f log loss", F.col("logloss_gap"))))


def patch_drift(df: DataFrame, month: str, p: str, y: str) -> DataFrame:
    """Calibration error of the newest month and a warning above the limit."""
    newest = df.agg(F.max(month).alias("_m"))
    rows = df.join(newest, F.col(month) == F.col("_m"))
    e = ece(reliability(rows, [], p, y), [])
    lim = S.CALIBRATION["patch_ece_max"]
    return e.withColumn("warning", F.when(F.col("ece") > lim, F.format_string("possible patch drift (newest-month ECE %.4f)", F.col("ece"))))


def map_support(matches: DataFrame, min_matches: int = 100) -> DataFrame:
    """Registered matches per map version, with a warning below the least number."""
    ok = matches.where(F.coalesce("status", F.lit("")) != "quarantined")
    n = ok.groupBy("map_version").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("low_support", F.col("map_version").isNull() | (F.col("n") < min_matches))


def total_time(timings: Column) -> Column:
    """The stored total of a map of stage timings, else the sum of the stages; null when empty."""
    vals = F.map_values(timings)
    s = F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0))))
    return F.coalesce(F.try_element_at(timings, F.lit("total")), s)


def weekly_usage(usage: DataFrame, now: str, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Runs of the last days by tier and map, and the runs over the residual or time limit.

    ``usage``: run_id, ts, tier, map_version, device, timings map, warnings, conservation_residual.
    """
    end = F.to_timestamp(F.lit(now))
    u = usage.withColumn("_ts", F.to_timestamp("ts")).where(F.col("_ts").between(end - F.expr(f"interval {days} days"), end))
    by = u.cube("tier", "map_version").agg(F.count(F.lit(1)).alias("runs"), F.sum("warnings").alias("warnings"))
    lim = F.coalesce(F.try_element_at(lookup_map(S.CEILINGS), F.col("device")), F.lit(S.CEILINGS["gpu"]))
    tot = total_time(F.col("timings"))
    bad = u.select("run_id", "conservation_residual", tot.alias("total_s"), lim.alias("ceiling_s"),
                   (F.abs("conservation_residual") > S.USAGE_RESIDUAL_MAX).alias("residual_over"), (tot > lim).alias("over_ceiling"))
    return by, bad.where("residual_over or over_ceiling")


def adoption_problems(models: DataFrame) -> DataFrame:
    """Reasons a win-probability model may not be adopted; a missing number fails."""
    c = S.CALIBRATION
    need = ["logloss", "brier", "ece", "baseline_logloss", "hazard_auc"]
    missing = [F.when(F.col(n).isNull(), F.lit(f"missing {n}")) for n in need]
    rules = [F.when(F.col("baseline_logloss") - F.col("logloss") < c["logloss_margin"], F.lit("log loss margin")), F.when(F.col("ece") > c["ece_target"], F.lit("ece")),
             F.when(F.col("hazard_auc") < c["hazard_auc_floor"], F.lit("hazard auc"))]
    gaps = F.array_compact(F.array(*missing))
    p = F.when(F.col("kind") != "wp", F.array().cast("array<string>")).when(F.size(gaps) > 0, gaps).otherwise(F.array_compact(F.array(*rules)))
    return models.withColumn("problems", p).withColumn("passes", F.size("problems") == 0)


def guard_warnings(meta: DataFrame) -> DataFrame:
    """Warning rows ``(match_key, code, message)`` of a match before it is analysed.

    ``meta``: match_key, tier, source_tier, tick_rate, map_version, n_map_matches, hazard_auc.
    """
    auc = F.col("hazard_auc")
    w = lambda cond, code, msg: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(msg).alias("message")))
    rows = F.array_compact(F.array(
        w(F.col("source_tier").isNotNull() & (F.col("source_tier") != F.col("tier")), "tier_mismatch", "the source tier differs from the requested tier"),
        w(F.col("source_tier").isNull(), "tier_unknown", "the tier of the source is unknown"),
        w(F.col("tick_rate").isNull() | (F.col("tick_rate") != 128), "tick_rate", "the tick rate is not 128"),
        w(F.col("map_version").isNull() | (F.col("n_map_matches") < 100), "map_support", "few matches back this map version"),
        w(auc.isNull() | (auc < 0.75), "hazard_fixed", "the hazard head is unusable: enabler shares are fixed"),
        w((auc >= 0.75) & (auc < 0.80), "hazard_weak", "the hazard head is below its target")))
    return meta.select("match_key", F.explode(rows).alias("_w")).select("match_key", "_w.code", "_w.message")
