"""Model inputs: tensors of a state, temporal windows, sampling weights, augmentations, flat vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from .feed import ROUND
from .scan import range_join

KIND_BITS = {"grid": 1, "boundary_pre": 2, "boundary_post": 4, "terminal": 8}
NADES = ["n_smoke", "n_flash", "n_he", "n_molly", "n_decoy"]
CTX_NUM = [c for c in schemas.CTX_FIELDS if c not in ("map_version", "tier", "bomb_site")]
PLAYER_NUM = ["alive", "x", "y", "z", "speed", "health", "armor", "has_helmet", "has_defuser", "has_c4", *NADES, "is_scoped", "is_ducking", "is_walking", "is_reloading", "is_defusing",
              "is_planting", "flash_duration_remaining", "in_smoke", "on_fire", "money", "equipment_value", "seconds_since_last_seen_by_enemy", "seconds_since_last_shot",
              "spotted_by_count", "heard_enemy", "kills_round", "damage_round"]
SORTED_COLS = ["alive", "health", "armor", "equipment_value", "flash_duration_remaining", "speed", "x", "y", "z", "seconds_since_last_seen_by_enemy", "spotted_by_count", "has_defuser", "has_c4"]


def _num(v: Column) -> Column:
    return F.coalesce(v.cast("double"), F.lit(0.0))


def _bit(v: Column) -> Column:
    return v.isNotNull().cast("double")


def tensorize(states: DataFrame) -> DataFrame:
    """Fixed-shape arrays per state: player, utility and context numbers with presence bits, masks, kind bits."""
    angle = lambda p, n: [F.sin(F.radians(p[n])), F.cos(F.radians(p[n]))]
    player = lambda p: F.array(*[_num(p[c]) for c in PLAYER_NUM], *[_num(a) for n in ("yaw", "pitch") for a in angle(p, n)], *[_bit(p[c]) for c in PLAYER_NUM], _bit(p["yaw"]), _bit(p["pitch"]))
    util = lambda u: F.array(*[_num(u[c]) for c in ("x", "y", "z", "time_left_s", "radius_units")], *[_bit(u[c]) for c in ("x", "y", "z", "time_left_s", "radius_units")])
    n = schemas.MAX_UTILITY
    pad = F.array_repeat(F.array(*[F.lit(0.0)] * 10), n)
    bits = F.aggregate("kinds", F.lit(0), lambda b, k: b.bitwiseOR(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_BITS.items() for x in kv]), k), F.lit(16))))
    return states.withColumns({
        "player_num": F.transform("players", player), "player_mask": F.transform("players", lambda p: p["player_id"] != schemas.PAD_PLAYER_ID),
        "util_num": F.slice(F.concat(F.transform("utility", util), pad), 1, n), "util_mask": F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i <= F.size("utility")),
        "ctx_num": F.array(*[_num(F.col(f"ctx_{c}")) for c in CTX_NUM], *[_bit(F.col(f"ctx_{c}")) for c in CTX_NUM]), "tick_kinds": bits})


def temporal_windows(states: DataFrame, window_ticks: int, value: str, by: Sequence[str] = ROUND) -> DataFrame:
    """History of each state: earlier states of its round within the window, itself last, as an array of (tick, value).

    The window joins on (round, time bucket), so a long round is spread over its buckets.
    """
    me = states.select(*by, F.col("tick").alias("_t"), (F.col("tick") - window_ticks).alias("_lo"), F.col("tick").alias("_hi")).distinct()
    hit = range_join(me, states.select(*by, "tick", F.col(value).alias("_v")), by, "_lo", "_hi", "tick", window_ticks)
    return hit.groupBy(*by, F.col("_t").alias("tick")).agg(F.array_sort(F.collect_list(F.struct("tick", F.col("_v").alias("value")))).alias("window"))


def collate(windows: DataFrame, length: int, tick_rate: float) -> DataFrame:
    """Windows padded to one length: values, mask, seconds before the last entry, position of the last entry."""
    n = F.least(F.size("window"), F.lit(length))
    w = F.slice("window", F.size("window") - n + 1, n)
    last = F.element_at("window", -1)["tick"]
    fill = F.array_repeat(F.lit(None).cast("double"), length)
    pick = lambda f: F.slice(F.concat(F.transform(w, f), fill), 1, length)
    return windows.withColumns({
        "values": pick(lambda x: x["value"].cast("double")), "mask": F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i <= n),
        "dt": F.transform(pick(lambda x: (last - x["tick"]) / F.lit(float(tick_rate))), lambda d: F.coalesce(d, F.lit(0.0))), "last": n - 1})


def tier_fractions(states: DataFrame, tier: str, factor: float) -> DataFrame:
    """Share of one tier when its rows weigh ``factor`` times their natural share, and the row weights."""
    s = states.agg(F.avg((F.col("tier") == tier).cast("double")).alias("natural"))
    target = F.when(F.col("natural") <= 0, 0.0).when(F.col("natural") >= 1, 1.0).otherwise(F.lit(float(factor)) * F.col("natural") / (F.lit(float(factor)) * F.col("natural") + 1 - F.col("natural")))
    return s.withColumn("target", target)


def tier_sample(states: DataFrame, tier: str, factor: float, fraction: float, key: Column, seed: int, epoch: int = 0) -> DataFrame:
    """A seeded sample of an epoch: a row's chance is its tier's weight; the same rows on every run."""
    s = tier_fractions(states, tier, factor)
    u = F.pmod(F.xxhash64(key, F.lit(seed), F.lit(epoch)), F.lit(1 << 30)) / float(1 << 30)
    chance = F.when(F.col("tier") == tier, F.lit(fraction) * F.try_divide(F.col("target"), F.col("natural"))).otherwise(F.lit(fraction) * F.try_divide(1 - F.col("target"), 1 - F.col("natural")))
    return states.join(s, F.lit(True)).where(u < chance).drop("natural", "target")


# augmentations on wide states; each touches only its own fields


def util_drop(states: DataFrame, p: float, seed: int) -> DataFrame:
    """Each utility token is left out with probability p."""
    u = lambda i: F.pmod(F.xxhash64("match_key", "round_num", "tick", i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return states.withColumn("utility", F.filter("utility", lambda t, i: u(i) >= p))


def _noise(*parts) -> Column:
    """Standard normal noise from a hash (Box-Muller)."""
    u = lambda salt: (F.pmod(F.xxhash64("match_key", "round_num", "tick", *parts, F.lit(salt)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    return F.sqrt(-2.0 * F.log(u("a"))) * F.cos(2 * F.pi() * u("b"))


def pos_jitter(states: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Living players move by normal noise in x and y; the distances of the pairs follow."""
    ok = lambda p: (p["alive"] == 1) & p["x"].isNotNull()
    move = lambda p, i: p.withField("x", F.when(ok(p), (p["x"] + sigma * _noise(i, F.lit("x"), F.lit(seed))).cast("float")).otherwise(p["x"])).withField(
        "y", F.when(ok(p), (p["y"] + sigma * _noise(i, F.lit("y"), F.lit(seed))).cast("float")).otherwise(p["y"]))
    out = states.withColumn("players", F.transform("players", move))
    n = schemas.N_PLAYERS

    def cell(v: Column, k: Column) -> Column:
        c = F.floor(k / 5)
        a, b = F.get("players", F.floor(c / n).cast("int")), F.get("players", (c % n).cast("int"))
        d = F.sqrt(sum(((a[x] - b[x]) * (a[x] - b[x]) for x in "yz"), (a["x"] - b["x"]) * (a["x"] - b["x"])))
        return F.when((k % 5 == 1) & v.isNotNull() & (ok(a) | ok(b)), d.cast("float")).otherwise(v)

    return out.withColumn("pair", F.transform("pair", cell))


def unflash(states: DataFrame, p: float, seed: int) -> DataFrame:
    """A blind living player sees again with probability p."""
    u = lambda i: F.pmod(F.xxhash64("match_key", "round_num", "tick", i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    hit = lambda x, i: (x["alive"] == 1) & (x["flash_duration_remaining"] > 0) & (u(i) < p)
    return states.withColumn("players", F.transform("players", lambda x, i: x.withField("flash_duration_remaining", F.when(hit(x, i), F.lit(0.0).cast("float")).otherwise(x["flash_duration_remaining"]))))


def los_flip(states: DataFrame, p: float, seed: int) -> DataFrame:
    """A known line of sight turns over with probability p, for both directions of the pair."""
    n = schemas.N_PLAYERS

    def one(v: Column, k: Column) -> Column:
        c = F.floor(k / 5)
        lo, hi = F.least(F.floor(c / n), c % n), F.greatest(F.floor(c / n), c % n)
        u = F.pmod(F.xxhash64("match_key", "round_num", "tick", lo, hi, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        return F.when((k % 5 == 0) & v.isNotNull() & (u < p), F.lit(1.0).cast("float") - v).otherwise(v)

    return states.withColumn("pair", F.transform("pair", one))


def dead_token_drop(states: DataFrame, p: float, seed: int) -> DataFrame:
    """The mask of a dead player is cleared with probability p (``player_mask`` of ``tensorize``)."""
    u = lambda i: F.pmod(F.xxhash64("match_key", "round_num", "tick", i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return states.withColumn("player_mask", F.zip_with("player_mask", F.transform("players", lambda x, i: (x["alive"] != 1) & (u(i) < p)), lambda m, gone: m & ~gone))


# flat vectors


#: Columns that a flat row keeps beside its features; ``_state`` is the row it came from.
NOT_FEATURES = (*ROUND, "tick", "t_s", "kinds", "_state")


def flatten(states: DataFrame) -> DataFrame:
    """Order-free vector of a state as columns: context, team sums, players sorted by health, enemy-pair aggregates.

    A team sum is null as soon as one living player's value is unknown.
    """
    cols: dict[str, Column] = {f"ctx_{c}": F.col(f"ctx_{c}").cast("double") for c in CTX_NUM}
    known_sum = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, p: a + f(p).cast("double"))
    nades = lambda p: sum((F.coalesce(p[c].cast("double"), F.lit(0.0)) for c in NADES[1:]), F.coalesce(p[NADES[0]].cast("double"), F.lit(0.0)))
    neg = lambda v: -F.coalesce(v.cast("double"), F.lit(-1e9))
    for t in ("ct", "t"):
        team = F.filter("players", lambda p: p["side"] == t)
        live = F.filter(team, lambda p: (p["alive"] == 1) & (p["player_id"] != schemas.PAD_PLAYER_ID))
        n = F.size(live)
        hp = known_sum(live, lambda p: p["health"])
        speeds = F.filter(F.transform(live, lambda p: p["speed"].cast("double")), lambda v: v.isNotNull())
        cols |= {
            f"{t}_alive": n.cast("double"), f"{t}_hp_sum": hp, f"{t}_hp_mean": F.when(n > 0, hp / n), f"{t}_armor_sum": known_sum(live, lambda p: p["armor"]),
            f"{t}_equip_sum": known_sum(live, lambda p: p["equipment_value"]), f"{t}_nades": known_sum(live, nades), f"{t}_blind": F.size(F.filter(live, lambda p: p["flash_duration_remaining"] > 0)).cast("double"),
            f"{t}_helmets": known_sum(live, lambda p: p["has_helmet"]), f"{t}_defusers": known_sum(live, lambda p: p["has_defuser"]),
            f"{t}_speed_mean": F.try_divide(F.aggregate(speeds, F.lit(0.0), lambda a, v: a + v), F.size(speeds))}
        key = lambda p: F.struct(
            (-F.when(p["alive"] == 1, F.coalesce(p["health"].cast("double"), F.lit(0.0))).otherwise(-1.0)).alias("a"), *[neg(p[c]).alias(f"k{i}") for i, c in enumerate(("armor", "equipment_value", "x", "y", "z"))],
            *[p[c].cast("double").alias(c) for c in SORTED_COLS if c not in ()], nades(p).alias("nades"))
        order = F.array_sort(F.transform(team, key))
        for i in range(schemas.N_PER_SIDE):
            for c in [*SORTED_COLS, "nades"]:
                cols[f"{t}{i}_{c}"] = F.get(order, F.lit(i))[c]
    n = schemas.N_PLAYERS
    idx = [(i * n + j) * 5 for i in range(5) for j in range(5, 10)]
    pick = lambda k: F.array_compact(F.transform(F.array(*[F.lit(x) for x in idx]), lambda b: F.get("pair", b + k)))
    both = F.transform(F.array(*[F.lit(x) for x in idx]), lambda b: (F.get("pair", b) == 1) & (F.get("pair", b + 3) == 1))
    d = F.transform(pick(1), lambda v: v.cast("double"))
    cols |= {
        "pair_enemy_los": F.size(F.filter(pick(0), lambda v: v == 1)).cast("double"), "pair_enemy_los_smoke": F.size(F.filter(both, lambda v: F.coalesce(v, F.lit(False)))).cast("double"),
        "pair_enemy_min_dist": F.array_min(d), "pair_enemy_mean_dist": F.try_divide(F.aggregate(d, F.lit(0.0), lambda a, v: a + v), F.size(d))}
    keep = [c for c in states.columns if c.startswith("y_") or c in NOT_FEATURES]
    return states.select(*keep, *[c.alias(k) for k, c in cols.items()])


def feature_names(flat: DataFrame) -> list[str]:
    return [c for c in flat.columns if not c.startswith("y_") and c not in NOT_FEATURES]


def labelled(df: DataFrame, label: str = "y_round_won_ct") -> DataFrame:
    return df.where(F.col(label).isNotNull())


def early_stop_rows(val: DataFrame, tier: str = "pro") -> DataFrame:
    """Validation rows of one tier when it has any, else all rows."""
    has = val.agg(F.coalesce(F.bool_or(F.col("tier") == tier), F.lit(False)).alias("_has"))
    return val.join(has, F.lit(True)).where(~F.col("_has") | (F.col("tier") == tier)).drop("_has")
