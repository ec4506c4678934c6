"""Checks of built states: consistency rules and leak tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from .feed import ROUND, Feed

KEY = [*ROUND, "tick"]


def violations(states: DataFrame) -> DataFrame:
    """Failing consistency rules of wide states: ``round, tick, rule``."""
    p, u = F.col("players"), F.col("utility")
    side = lambda s: F.filter(p, lambda x: (x["side"] == s) & (x["alive"] == 1))
    null_when_dead = lambda x: sum((x[f].isNotNull().cast("int") for f in schemas.DEAD_NULL_FIELDS[1:]), x[schemas.DEAD_NULL_FIELDS[0]].isNotNull().cast("int"))
    equip = lambda s: F.aggregate(side(s), F.lit(0.0), lambda a, x: a + x["equipment_value"].cast("double"))
    n, idx = schemas.N_PLAYERS, F.sequence(F.lit(0), F.lit(499))
    mirror = lambda k: F.get("pair", (((F.floor(k / 5) % n) * n + F.floor(F.floor(k / 5) / n)) * 5 + k % 5).cast("int"))
    planted = F.col("ctx_bomb_planted") == 1
    rules: dict[str, Column] = {
        "ten players, CT first": F.transform(p, lambda x: x["side"]) != F.array(*[F.lit("ct")] * 5, *[F.lit("t")] * 5),
        "dead player with live fields": F.exists(p, lambda x: (x["alive"] == 0) & (null_when_dead(x) > 0)),
        "dead player with health": F.exists(p, lambda x: (x["alive"] == 0) & ((x["health"] != 0) | (x["armor"] != 0))),
        "null id or counters": F.exists(p, lambda x: x["player_id"].isNull() | x["tier"].isNull() | x["kills_round"].isNull() | x["damage_round"].isNull()),
        "alive count": (F.col("ctx_alive_ct") != F.size(side("ct"))) | (F.col("ctx_alive_t") != F.size(side("t"))),
        "equipment sum": (F.abs(F.col("ctx_equip_ct") - equip("ct")) > 1e-3) | (F.abs(F.col("ctx_equip_t") - equip("t")) > 1e-3),
        "clock": F.col("ctx_time_remaining_s").isNull() | (F.col("ctx_time_remaining_s") < 0),
        "plant fields": planted != F.col("ctx_time_since_plant_s").isNotNull(), "carrier after plant": planted & F.col("ctx_bomb_carrier_alive").isNotNull(),
        "kit without defuse": (F.col("ctx_defuse_in_progress") != 1) & F.col("ctx_defuse_with_kit").isNotNull(), "token cap": F.size(u) > schemas.MAX_UTILITY,
        "token kind": F.exists(u, lambda t: ~t["kind"].isin("smoke", "fire", "decoy")),
        "token counts": (F.size(u) < schemas.MAX_UTILITY) & ((F.size(F.filter(u, lambda t: t["kind"] == "smoke")) != F.col("ctx_n_active_smokes")) | (F.size(F.filter(u, lambda t: t["kind"] == "fire")) != F.col("ctx_n_active_fires"))),
        "pair shape": F.size("pair") != 500, "pair symmetry": F.exists(idx, lambda k: ~F.get("pair", k).eqNullSafe(mirror(k))),
        "pair diagonal": F.exists(idx, lambda k: (F.floor(k / 5) % (n + 1) == 0) & F.get("pair", k).isNotNull()),
        "pair domain": F.exists(idx, lambda k: (k % 5).isin(0, 3, 4) & F.get("pair", k).isNotNull() & ~F.get("pair", k).isin(0.0, 1.0))}
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]))
    return states.select(*KEY, F.explode(hits).alias("rule"))


def feature_columns(states: DataFrame) -> list[str]:
    return [c for c in states.columns if not c.startswith("y_")]


def flip_outcome(feed: Feed, match_key: str, round_num: int, shift: int) -> Feed:
    """The feed with one round won by the other side and ending ``shift`` ticks later."""
    here = (F.col("match_key") == match_key) & (F.col("round_num") == round_num)
    r = feed["rounds"].withColumns({
        "winner_side": F.when(here, F.when(F.col("winner_side") == "ct", "t").otherwise("ct")).otherwise(F.col("winner_side")),
        **{c: F.when(here, F.col(c) + shift).otherwise(F.col(c)) for c in ("end_tick", "official_end_tick")}})
    return feed.with_tables(rounds=r)


def leak_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Feature rows that differ between two builds at their common non-terminal samples (should be empty)."""
    cols = feature_columns(a)
    keys = a.where(~F.array_contains("kinds", "terminal")).select(*KEY).intersect(b.where(~F.array_contains("kinds", "terminal")).select(*KEY))
    js = lambda d: d.join(keys, KEY, "left_semi").select(*KEY, F.to_json(F.struct(*[c for c in cols if c not in (*KEY, "kinds")])).alias("f"))
    x, y = js(a), js(b)
    return x.exceptAll(y).unionByName(y.exceptAll(x))


def poison(feed: Feed, match_key: str, round_num: int, tick: int) -> Feed:
    """The feed with impossible rows at one tick: a kill, damage, a shot and a blinding that nobody may see before."""
    at = feed["ticks"].where((F.col("match_key") == match_key) & (F.col("round_num") == round_num) & (F.col("tick") <= tick))
    who = at.groupBy("match_key", "round_num").agg(F.min("steamid").alias("a"), F.max("steamid").alias("b"))
    add = lambda t, cols: feed[t].unionByName(who.select("match_key", *[c.alias(n) for n, c in cols.items()]), allowMissingColumns=True)
    rn, tk = F.col("round_num"), F.lit(tick).cast("bigint")
    return feed.with_tables(
        kills=add("kills", {"round_num": rn, "tick": tk, "attacker_steamid": F.col("a"), "victim_steamid": F.col("b"), "team_kill": F.lit(False)}),
        damages=add("damages", {"round_num": rn, "tick": tk, "attacker_steamid": F.col("a"), "victim_steamid": F.col("b"), "dmg_health": F.lit(999).cast("smallint")}),
        weapon_fire=add("weapon_fire", {"tick": tk, "steamid": F.col("a")}), flashes=add("flashes", {"detonate_tick": tk, "player_steamid": F.col("a"), "blind_duration": F.lit(99.0).cast("float")}))


def poison_check(build: Callable[[Feed], DataFrame], feed: Feed, match_key: str, round_num: int, tick: int) -> DataFrame:
    """Feature rows before the poisoned tick that changed (should be empty)."""
    before = lambda d: d.where(F.col("tick") < tick)
    return leak_differences(before(build(feed)), before(build(poison(feed, match_key, round_num, tick))))


def unjustified_features(states: DataFrame, reasons: DataFrame) -> DataFrame:
    """Features without a written reason why they are known at their tick; ``reasons``: field, reason."""
    names = feature_columns(states) + [f"players.{f}" for f in schemas.PLAYER_FIELDS] + [f"utility.{c.strip().split(' ')[0]}" for c in schemas.UTILITY_DDL.split(",")]
    f = states.sparkSession.createDataFrame([(n,) for n in names], "field string")
    return f.join(reasons.where("trim(reason) <> ''").select("field"), "field", "left_anti")
