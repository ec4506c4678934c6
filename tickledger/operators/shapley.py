"""Shapley values over coalitions given as bitmasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S

#: Members of a game that a mask can hold.
MAX_BITS = 62


def _bit(i: Column) -> Column:
    """1 shifted left by a column of positions, as bigint."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))


def _factorials(n: int) -> Column:
    return F.array(*[F.lit(float(math.factorial(i))) for i in range(n + 1)])


def all_masks(games: DataFrame, n: str = "n") -> DataFrame:
    """Every coalition of each game as a bitmask: 2^n rows of a game with n members."""
    return games.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("bigint"), _bit(fits(F.col(n))) - 1)))


def fits(n: Column) -> Column:
    """``n``, or an error if a game has more members than a mask can hold."""
    return F.when(n <= MAX_BITS, n).otherwise(F.raise_error(F.concat(F.lit(f"a game has more than {MAX_BITS} members: "), n.cast("string"))))


def exact(values: DataFrame, game: Sequence[str], n: str, v: str = "v", limit: int | None = None) -> DataFrame:
    """Exact values from all coalitions: ``game, bit, phi``.

    Member i gains w(|S|) v(S) for coalitions with i and loses w'(|S|) v(S) for those without,
    so each coalition is read once and no coalition is paired with another.
    """
    game = list(game)
    f = _factorials(max(limit or S.ATTRIBUTION["exact_max"], 20))
    fact = lambda k: F.get(f, k.cast("int"))
    size, total = F.bit_count("mask"), F.col(n)
    with_i = fact(size - 1) * fact(total - size) / fact(total)
    without = -fact(size) * fact(total - size - 1) / fact(total)
    bits = values.withColumn("bit", F.explode(F.sequence(F.lit(0), total.cast("int") - 1)))
    has = F.getbit("mask", F.col("bit")) == 1
    part = F.when(has, with_i).otherwise(without) * F.col(v)
    return bits.groupBy(*game, "bit").agg(F.sum(part).alias("phi"))


def permutations(games: DataFrame, game: Sequence[str], n: str, samples: int | None = None) -> DataFrame:
    """Seeded orders in antithetic pairs: ``game, perm, bit, pos``; every second order is a reverse.

    The order of a pair comes from hashes of (game, pair, member), so it is the same on every run.
    """
    pairs = max(1, ((samples or S.ATTRIBUTION["samples"]) + 1) // 2)
    p = games.withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))))
    members = F.sequence(F.lit(0), fits(F.col(n)).cast("int") - 1)
    keyed = F.array_sort(F.transform(members, lambda b: F.struct(F.xxhash64(*game, F.col("pair"), b).alias("h"), b.alias("b"))))
    order = F.transform(keyed, lambda x: x["b"])
    both = F.array(F.struct((F.col("pair") * 2).alias("perm"), order.alias("o")), F.struct((F.col("pair") * 2 + 1).alias("perm"), F.reverse(order).alias("o")))
    return p.withColumn("_x", F.explode(both)).select(*game, n, "_x.perm", "_x.o")


def prefixes(perms: DataFrame, game: Sequence[str], n: str) -> DataFrame:
    """Coalition before and after each member joins, in each order: ``game, perm, bit, mask0, mask1``."""
    none = F.array().cast("array<struct<bit:int,mask0:bigint,mask1:bigint>>")
    before = F.struct(F.lit(0).cast("bigint").alias("m"), none.alias("s"))

    def join(acc: Column, b: Column) -> Column:
        after = acc["m"].bitwiseOR(_bit(b))
        return F.struct(after.alias("m"), F.concat(acc["s"], F.array(F.struct(b.cast("int").alias("bit"), acc["m"].alias("mask0"), after.alias("mask1")))).alias("s"))

    steps = F.aggregate("o", before, join, lambda acc: acc["s"])
    return perms.select(*game, n, "perm", F.explode(steps).alias("_s")).select(*game, n, "perm", "_s.bit", "_s.mask0", "_s.mask1")


def required_masks(games: DataFrame, game: Sequence[str], n: str = "n", limit: int | None = None) -> DataFrame:
    """Coalitions to score: all of them up to ``limit`` members (by default the configured one), else the prefixes of the sampled orders."""
    limit = limit or S.ATTRIBUTION["exact_max"]
    small = all_masks(games.where(F.col(n) <= limit), n).select(*game, n, "mask")
    big = prefixes(permutations(games.where(F.col(n) > limit), game, n), game, n)
    big = big.select(*game, n, F.explode(F.array("mask0", "mask1")).alias("mask")).distinct()
    return small.unionByName(big)


def sampled(games: DataFrame, values: DataFrame, game: Sequence[str], n: str, v: str = "v", samples: int | None = None) -> DataFrame:
    """Mean marginal contribution over the sampled orders: ``game, bit, phi``."""
    steps = prefixes(permutations(games.select(*game, n), game, n, samples), game, n)
    val = values.select(*game, "mask", v)
    for m in ("mask0", "mask1"):
        steps = steps.join(val.select(*game, F.col("mask").alias(m), F.col(v).alias(f"_{m}")), [*game, m])
    # a member has one gain per order; they are added in order of size, so that every run gives the same sum
    gains = F.array_sort(F.collect_list(F.col("_mask1") - F.col("_mask0")))
    return steps.groupBy(*game, "bit").agg(F.aggregate(gains, F.lit(0.0), lambda m, x: m + x, lambda m: m / F.size(gains)).alias("phi"))


def enforce_efficiency(phi: DataFrame, totals: DataFrame, game: Sequence[str], member: str = "bit", total: str = "total") -> DataFrame:
    """Spread ``total - sum(phi)`` over the members by |phi| (equally when all are 0).

    The last member takes the rounding rest, so the parts add up to the total.
    """
    game = list(game)
    w = Window.partitionBy(*game).orderBy(member).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = phi.join(totals.select(*game, total), game)
    mag, n = F.sum(F.abs("phi")).over(w), F.count(F.lit(1)).over(w)
    p = p.withColumn("residual", F.abs(F.col(total) - F.sum("phi").over(w)))
    share = F.when(mag > 0, F.try_divide(F.abs("phi"), mag)).otherwise(F.lit(1.0) / n)
    p = p.withColumn("_new", F.col("phi") + (F.col(total) - F.sum("phi").over(w)) * share)
    last = F.max(member).over(w) == F.col(member)
    rest = F.col(total) - (F.sum("_new").over(w) - F.col("_new"))
    return p.withColumn("phi", F.when(last, rest).otherwise(F.col("_new"))).drop("_new", total)


def shapley(games: DataFrame, values: DataFrame, game: Sequence[str], n: str = "n", v: str = "v", limit: int | None = None) -> DataFrame:
    """Exact up to ``limit`` members, sampled with enforced efficiency above it: ``game, bit, phi, method, residual``."""
    game = list(game)
    limit = limit or S.ATTRIBUTION["exact_max"]
    vals = values.drop(n).join(games.select(*game, n), game)
    small = exact(vals.where(F.col(n) <= limit), game, n, v, limit).withColumns({"method": F.lit("exact"), "residual": F.lit(0.0)})
    big = vals.where(F.col(n) > limit)
    phi = sampled(games.where(F.col(n) > limit), big, game, n, v)
    full = _bit(F.col(n)) - 1
    tot = big.groupBy(*game).agg((F.max(F.when(F.col("mask") == full, F.col(v))) - F.max(F.when(F.col("mask") == 0, F.col(v)))).alias("total"))
    many = enforce_efficiency(phi, tot, game).withColumn("method", F.lit("sampled"))
    return small.unionByName(many.select(small.columns))


def leave_one_out(values: DataFrame, game: Sequence[str], n: str, v: str = "v") -> DataFrame:
    """v(all) - v(all without the member), spread to v(all) - v(none)."""
    game = list(game)
    full = _bit(F.col(n)) - 1
    ends = values.groupBy(*game).agg(F.max(F.when(F.col("mask") == full, F.col(v))).alias("_all"), F.max(F.when(F.col("mask") == 0, F.col(v))).alias("_none"))
    bits = values.withColumn("bit", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))
    bits = bits.where(F.col("mask") == full - _bit(F.col("bit"))).join(ends, game)
    phi = bits.select(*game, "bit", (F.col("_all") - F.col(v)).alias("phi"))
    return enforce_efficiency(phi, ends.withColumn("total", F.col("_all") - F.col("_none")), game)
