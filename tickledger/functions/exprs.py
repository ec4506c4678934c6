"""Scalar expressions shared by the operators.  Unknown is null and never 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_null(c: Column) -> Column:
    """NaN and infinities to null."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ticks_of(seconds: float, rate: Column | float) -> Column:
    """Seconds as a whole number of ticks (half to even)."""
    rate = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate.cast("double")
    return F.bround(F.lit(float(seconds)) * rate, 0).cast("bigint")


def side_of(c: Column) -> Column:
    """2 / 3, names and both cases to ``t`` / ``ct``; anything else is null."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("t", "terrorist", "terrorists", "2"), F.lit("t")).when(
        s.isin("ct", "counter-terrorist", "counterterrorist", "cts", "3"), F.lit("ct")
    )


def lookup_map(mapping: dict) -> Column:
    """A literal map for small fixed vocabularies."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def map_values(c: Column, mapping: dict[str, str]) -> Column:
    """Lower-cased value through a dictionary; values outside it become null."""
    return F.try_element_at(lookup_map(mapping), F.lower(c.cast("string")))


def known_sum(c: Column) -> Column:
    """Aggregate sum that is null as soon as one value is unknown (0 for no rows is the caller's)."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def dist(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of two points given as coordinate lists."""
    terms = [(p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")) for p, q in zip(a, b)]
    return F.sqrt(reduce(lambda x, y: x + y, terms))


def eye_z(z: Column, ducking: Column) -> Column:
    """Eye height of a player above the ground position."""
    return z.cast("double") + F.when(ducking.cast("int") == 1, S.EYE_DUCK).otherwise(S.EYE_STAND)


def segment_hits_sphere(a: list[Column], b: list[Column], c: list[Column], radius: Column) -> Column:
    """Does the closed segment a-b come within ``radius`` of c?"""
    a, b, c = ([v.cast("double") for v in p] for p in (a, b, c))
    d = [q - p for p, q in zip(a, b)]
    f = [p - q for p, q in zip(a, c)]
    dd = sum((x * x for x in d[1:]), d[0] * d[0])
    fd = sum((x * y for x, y in zip(f[1:], d[1:])), f[0] * d[0])
    s = F.when(dd == 0.0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(-fd, dd)))
    )
    near = [x + s * y for x, y in zip(f, d)]
    r = radius.cast("double")
    return sum((x * x for x in near[1:]), near[0] * near[0]) <= r * r


def inside_token(kind: Column, u: list[Column], radius: Column, p: list[Column]) -> Column:
    """Point inside a utility volume: smoke is a sphere, fire a disc with vertical slack, else never."""
    flat = dist(p[:2], u[:2])
    fire = (flat <= radius) & (F.abs(p[2].cast("double") - u[2].cast("double")) <= S.FIRE_Z_TOL)
    hit = F.when(kind == "smoke", dist(p, u) <= radius).when(kind == "fire", fire).otherwise(False)
    return F.coalesce(hit, F.lit(False))


def half_of(round_num: Column) -> Column:
    """Half number: 12 + 12 rounds, then overtime halves of 3."""
    r = round_num.cast("bigint")
    over = F.lit(3) + F.floor((r - 25) / 3.0)
    return F.when(r <= 12, 1).when(r <= 24, 2).otherwise(over).cast("bigint")


def site_name(site: Column) -> Column:
    """'A' / 'B' from any spelling that ends in the letter."""
    s = F.upper(F.trim(site))
    return F.when(F.endswith(s, F.lit("A")), F.lit("A")).when(F.endswith(s, F.lit("B")), F.lit("B"))


def loadout_class(value: Column) -> Column:
    """Equipment band; the bounds are exclusive upper bounds."""
    v = value.cast("double")
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for name, bound in S.BUY_BANDS:
        out = out.when(v < bound, F.lit(name))
    return out.otherwise(F.lit("full"))


def verdict(score: Column, delta: float) -> Column:
    """good / bad / neutral with an inclusive neutral band; null for an unknown score."""
    s = nan_null(score)
    return F.when(s > delta, F.lit("good")).when(s < -delta, F.lit("bad")).when(s.isNotNull(), F.lit("neutral"))


def sigmoid(logit: Column, temperature: Column | float = 1.0) -> Column:
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit / t))


def phase_of(planted: Column, remaining: Column, into: Column) -> Column:
    """Round phase; after the plant wins over the last seconds, which win over the elapsed time."""
    return (
        F.when(planted > 0, F.lit("post_plant"))
        .when(remaining <= 15, F.lit("last_15"))
        .when(into < 30, F.lit("0_30"))
        .when(into < 75, F.lit("30_75"))
        .otherwise(F.lit("75_plus"))
    )


def tick_rate_of(playback_ticks: Column, playback_s: Column) -> Column:
    """Raw tick rate of a header; null unless finite and positive."""
    raw = nan_null(F.try_divide(playback_ticks.try_cast("double"), playback_s.try_cast("double")))
    return F.when(raw > 0, raw)


def month_of(date: Column) -> Column:
    """``yyyy-mm`` of an ISO date string, null when it is not one."""
    return F.when(date.rlike(r"^\d{4}-(0[1-9]|1[0-2])(-|$)"), F.substring(date, 1, 7))


def id_forms(mid: Column) -> Column:
    """Both spellings of a match id: a bare id also means its first map, a map id its series."""
    base = F.regexp_extract(mid, r"^(.*)_m\d+$", 1)
    return F.when(base != "", F.array(mid, base)).otherwise(F.array(mid, F.concat(mid, F.lit("_m1"))))


def grid_cell(x: Column, y: Column, x0: Column, y0: Column, n_cols: Column, n_rows: Column, size: float) -> Column:
    """Row-major id of a square cell, null outside the grid."""
    c = F.floor((x.cast("double") - x0) / F.lit(float(size)))
    r = F.floor((y.cast("double") - y0) / F.lit(float(size)))
    return F.when((c >= 0) & (c < n_cols) & (r >= 0) & (r < n_rows), r * n_cols + c).cast("bigint")


def flat_cell(x: Column, y: Column, size: float = 512.0, span: int = 128) -> Column:
    """Cell of the open-ground grid: ``span`` cells per axis centred on the origin, x-major."""
    half = span // 2 * size
    return grid_cell(y, x, F.lit(-half), F.lit(-half), F.lit(span), F.lit(span), size)
