"""Gate of a scorer: does W react to edited states the way it must?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from . import edits as E
from .feed import ROUND
from .neighbours import kth_distance
from .scan import least_rows

G = S.GATE
KIND_OF_TYPE = {"kill": "kill", "smoke_pop": "smoke", "flash": "flash", "plant_complete": "plant"}
TESTS = {"kill": "unkill", "smoke": "smoke", "flash": "unflash", "plant": "unplant", "freeze": "freeze", "order": "order"}


def _cap(df: DataFrame, n: int | None, seed: int) -> DataFrame:
    """A seeded uniform sample of at most n rows: those with the least hashes."""
    return df if n is None else least_rows(df, [], F.pmod(F.xxhash64("case_key", F.lit(seed)), F.lit(1 << 40)), ["case_key"], n)


def samples(events: DataFrame, drifts: DataFrame, n_events: int | None = None, n_drift: int | None = None, seed: int = 0) -> DataFrame:
    """Gate cases: ``case_key, kind, pre, post, members, mask`` from event and drift games.

    A member whose type has a test is undone alone; a window of two or more members also
    gives an order case (nothing happened); a drift interval freezes one seeded mover.
    """
    kinds = F.create_map(*[F.lit(x) for kv in KIND_OF_TYPE.items() for x in kv])
    base = [*ROUND, "game_id", "pre", "post"]
    e = events.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    one = F.get("members", F.col("_i"))
    e = e.withColumn("kind", F.try_element_at(kinds, one["type"])).where("kind is not null").select(
        *base, "kind", F.concat_ws("|", "game_id", one["action_id"]).alias("case_key"), F.array(one).alias("members"), F.lit(0).cast("bigint").alias("mask"))
    o = events.where("n >= 2").select(*base, F.lit("order").alias("kind"), F.concat_ws("|", "game_id", F.lit("order")).alias("case_key"), "members", F.lit(0).cast("bigint").alias("mask"))
    pick = F.pmod(F.xxhash64("game_id", F.lit(seed)), F.col("n")).cast("int")
    d = drifts.where("n > 0").select(*base, F.lit("freeze").alias("kind"), F.concat_ws("|", "game_id", F.lit("freeze")).alias("case_key"), F.array(F.get("members", pick)).alias("members"), F.lit(0).cast("bigint").alias("mask"))
    return _cap(e.unionByName(o), n_events, seed).unionByName(_cap(d, n_drift, seed))


def _orient() -> Column:
    """Sign of the side the edit is judged for: the victim's, the blinded side's, the other side of a smoke, T for a plant."""
    a = F.get("members", F.lit(0))
    victim = F.try_element_at(F.filter("post.players", lambda p: p["player_id"] == a["victim"]), F.lit(1))["side"]
    sign = lambda s: F.when(s == "ct", 1.0).otherwise(-1.0)
    return F.when(F.col("kind") == "kill", sign(victim)).when(F.col("kind").isin("smoke", "flash"), -sign(a["side"])).when(F.col("kind") == "plant", -1.0).otherwise(1.0)


def run_cases(cases: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cases with W before and after the edit, the signed change and, for order cases, whether both undo orders agree."""
    after = scorer(E.wide(E.apply_cases(cases), "edited")).select("case_key", "kind", *ROUND, "game_id", "edit_error", F.col("W").alias("w_after"), F.col("edited").alias("_e1"), _orient().alias("orient"))
    before = scorer(E.wide(cases, "post")).select("case_key", F.col("W").alias("w_before"))
    fwd = scorer(E.wide(E.apply_cases(cases.where("kind = 'order'"), "forward"), "edited")).select("case_key", F.col("W").alias("w_forward"), F.to_json("edited").alias("_j2"))
    out = after.join(before, "case_key").join(fwd, "case_key", "left")
    d = F.col("w_after") - F.col("w_before")
    same = (F.to_json("_e1") == F.col("_j2")) & (F.col("w_after") == F.col("w_forward"))
    return out.withColumns({"delta": d, "signed": d * F.col("orient"), "identical": F.when(F.col("kind") == "order", F.coalesce(same, F.lit(False)))}).drop("_e1", "_j2")


def report(cases: DataFrame) -> DataFrame:
    """One row per test: cases, failed edits, its rates and whether it passed.

    Failed edits count in the denominator; a test without a case cannot pass.
    """
    ok = F.col("edit_error").isNull()
    rate = lambda cond: F.count_if(ok & cond) / F.count(F.lit(1))
    s, d = F.col("signed"), F.when(ok, F.col("delta"))
    r = cases.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("n_errors"), rate(s > 0).alias("toward_rate"), F.median(F.abs(d)).alias("median_abs"), rate(s >= G["smoke_floor"]).alias("smoke_floor_rate"),
        rate(F.abs("delta") <= G["smoke_max_abs"]).alias("smoke_calm_rate"), rate(s >= G["unflash_floor"]).alias("unflash_rate"), rate(s < 0).alias("down_rate"),
        rate(F.abs("delta") <= G["freeze_max_abs"]).alias("freeze_calm_rate"), F.avg(d).alias("mean_dw"), rate(F.col("identical")).alias("identical_rate"))
    rules = {
        "kill": (F.col("toward_rate") >= G["unkill_toward_rate"]) & (F.col("median_abs") >= G["unkill_median_abs"]),
        "smoke": (F.col("smoke_floor_rate") >= G["smoke_floor_rate"]) & (F.col("smoke_calm_rate") >= G["smoke_max_abs_rate"]), "flash": F.col("unflash_rate") >= G["unflash_rate"],
        "plant": F.col("down_rate") >= G["unplant_down_rate"], "freeze": (F.col("freeze_calm_rate") >= G["freeze_max_abs_rate"]) & (F.abs("mean_dw") <= G["freeze_mean_abs"]), "order": F.col("identical_rate") == 1.0}
    passed = F.lit(False)
    for k, c in rules.items():
        passed = F.when(F.col("kind") == k, c).otherwise(passed)
    names = cases.sparkSession.createDataFrame(list(TESTS.items()), "kind string, test string")
    out = names.join(r.withColumn("passed", passed), "kind", "left").fillna(0, ["n", "n_errors"])
    return out.withColumn("passed", F.coalesce("passed", F.lit(False)))


def worst(cases: DataFrame, n: int | None = None) -> DataFrame:
    """The cases of each test that behave worst."""
    n = n or G["n_worst"]
    bad = F.when(F.col("kind") == "plant", -F.col("signed")).when(F.col("kind") == "freeze", -F.abs("delta")).when(F.col("kind") == "order", F.col("identical").cast("double")).otherwise(F.col("signed"))
    c = cases.withColumns({"_b": bad, "_p": F.pmod(F.xxhash64("case_key"), F.lit(64))})
    rn = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy("_b", "case_key"))
    c = c.withColumn("pos", rn("kind", "_p")).where(F.col("pos") <= n)
    return c.withColumn("pos", rn("kind")).where(F.col("pos") <= n).drop("_b", "_p")


def ood_report(edited: DataFrame, train: DataFrame, threshold: DataFrame, k: int | None = None) -> DataFrame:
    """Share of edited embeddings beyond the threshold per kind; ``edited``: id, kind, vec; ``train``: id, vec."""
    s = kth_distance(edited, train, k or G["ood_k"]).join(edited.select(F.col("id").alias("qid"), "kind"), "qid").join(threshold, F.lit(True))
    out = s.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("flag_rate"))
    return out.withColumn("passed", F.col("flag_rate") <= G["ood_max_rate"])
