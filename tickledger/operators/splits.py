"""Time splits, vocabularies, numeric blocks, QA profiles and inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.exprs import month_of


def assign_splits(matches: DataFrame, n_test: int = 2, n_val: int = 2, holdout: Sequence[str] = ()) -> DataFrame:
    """Split of each match by month: the newest months are test, the ones before val, the rest train.

    Holdout maps and undated matches stand apart.  Months are ranked, not matches.
    """
    m = matches.withColumns({"month": month_of(F.col("date")), "_out": F.col("map").isin(*holdout) if holdout else F.lit(False)})
    months = m.where("month is not null and not _out").select("month").distinct()
    r = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("month")))
    which = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")
    months = months.withColumn("_r", r).select("month", which.alias("_split"))
    out = m.join(months, "month", "left")
    return out.withColumn("split", F.when(F.col("_out"), "holdout").when(F.col("month").isNull(), "undated").otherwise(F.col("_split"))).drop("_out", "_split")


def split_problems(matches: DataFrame, n_test: int = 2, n_val: int = 2, holdout: Sequence[str] = ()) -> DataFrame:
    """Reasons to refuse a split: repeated match keys, or too few months with data."""
    dup = matches.groupBy("match_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate match_key").alias("problem"), "match_key")
    ok = ~F.col("map").isin(*holdout) if holdout else F.lit(True)
    n = matches.where(ok).agg(F.countDistinct(month_of(F.col("date"))).alias("n")).where(F.col("n") < n_test + n_val + 1)
    return dup.unionByName(n.select(F.lit("too few months").alias("problem"), F.lit(None).cast("string").alias("match_key")))


def version_splits(splits: DataFrame, existing: DataFrame | None) -> DataFrame:
    """The split under the next free version number, with a hash of its content."""
    top = F.lit(0) if existing is None else None
    digest = splits.select(F.xxhash64("match_key", "split").alias("h")).agg(F.sha2(F.sum(F.col("h").cast("decimal(38,0)")).cast("string"), 256).alias("split_hash"))
    out = splits.select("match_key", "split").join(digest, F.lit(True))
    if existing is None:
        return out.withColumn("version", F.lit(1))
    v = existing.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return out.join(v, F.lit(True)) if top is None else out


def select_matches(catalog: DataFrame, splits: DataFrame, split: str, tiers: Sequence[str] | None = None, maps: Sequence[str] | None = None) -> DataFrame:
    """Catalog rows of a split, by tier and map (a bare map also means its versions)."""
    out = catalog.join(splits.where(F.col("split") == split).select("match_key"), "match_key", "left_semi")
    if tiers:
        out = out.where(F.col("tier").isin(*tiers))
    if maps:
        out = out.where(F.col("map_version").isin(*maps) | F.split("map_version", "@")[0].isin(*maps))
    return out


# numeric blocks


def numeric_block(df: DataFrame, columns: dict[str, str]) -> Column:
    """Values (unknown as 0) and then presence bits; ``columns``: name -> ``cont``, ``flag`` or ``angle``."""
    vals = []
    for c, kind in columns.items():
        v = F.col(c).cast("double")
        known = v.isNotNull() & ~F.isnan(v)
        parts = [F.sin(F.radians(v)), F.cos(F.radians(v))] if kind == "angle" else [v]
        vals += [F.when(known, p).otherwise(0.0) for p in parts]
    bits = [(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).cast("double") for c in columns]
    return F.array(*vals, *bits)


def norm_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each column over its known values; a tiny deviation counts as 1."""
    long = unpivot(df, columns)
    s = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return s.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))


def normalize(df: DataFrame, stats: DataFrame, columns: Sequence[str], inverse: bool = False) -> DataFrame:
    """Standardise (or restore) columns; unknown stays unknown.  The statistics are one row per column."""
    wide = stats.where(F.col("feature").isin(*columns)).groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_s"))
    out = df.join(wide, F.lit(True))
    for c in columns:
        m, s = F.col("_s")[c]["mean"], F.col("_s")[c]["std"]
        out = out.withColumn(c, F.col(c) * s + m if inverse else (F.col(c) - m) / s)
    return out.drop("_s")


def layout_hash(df: DataFrame) -> str:
    """Fingerprint of a frame's layout (names, types and order)."""
    import hashlib

    return hashlib.sha256(df.schema.json().encode()).hexdigest()[:16]


# QA


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``keep, feature, value`` of numeric columns (NaN counts as unknown)."""
    v = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), v(c).alias("value")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("_x")).select(*keep, "_x.feature", "_x.value")


def profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Share of unknown values, minimum, maximum and mean of each column per key."""
    long = unpivot(df, columns, keys)
    n = F.count(F.lit(1))
    return long.groupBy(*keys, "feature").agg(
        n.alias("n"), (F.lit(100.0) * (F.lit(1.0) - F.count("value") / n)).alias("null_pct"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


#: Parts that the rows of one group and column are dealt in to meet their limits.
HIST_SALTS = 64


def histogram(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """Equal-width histogram between each column's extremes, the last edge included; empty bins listed."""
    bins = bins or S.QA["n_hist"]
    keys = list(keys)
    long = unpivot(df, columns, keys).where("value is not null")
    lim = long.groupBy(*keys, "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # a constant column gets a unit-wide range around its value
    lim = lim.withColumns({"lo": F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))})
    b = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    # there are few features, so a join by feature alone would put all rows of a column in one task
    if keys:
        salts = F.explode(F.sequence(F.lit(0), F.lit(HIST_SALTS - 1)))
        met = long.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(HIST_SALTS)).cast("int")).join(lim.withColumn("_salt", salts), [*keys, "feature", "_salt"])
    else:  # one row per column
        met = long.join(F.broadcast(lim), "feature")
    got = met.groupBy(*keys, "feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = lim.select(*keys, "feature").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(got, [*keys, "feature", "bin"], "left").fillna(0, ["n"])


def outliers(df: DataFrame, rules: dict[str, Column], row_id: Column, n_examples: int | None = None) -> DataFrame:
    """Rows per rule and a few example ids (the smallest ones)."""
    k = n_examples or S.QA["n_examples"]
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    long = df.select(row_id.alias("_id"), F.explode(hits).alias("rule"))
    n = long.groupBy("rule").agg(F.count(F.lit(1)).alias("count"))
    # smallest ids per part first, so no task gathers every hit of a rule
    part = long.withColumn("_p", F.pmod(F.xxhash64("_id"), F.lit(256)))
    rn = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy("_id"))
    part = part.withColumn("_r", rn("rule", "_p")).where(F.col("_r") <= k)
    ex = part.withColumn("_r", rn("rule")).where(F.col("_r") <= k).groupBy("rule").agg(F.array_sort(F.collect_list("_id")).alias("examples"))
    names = df.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return names.join(n, "rule", "left").join(ex, "rule", "left").fillna(0, ["count"])


def state_outlier_rules() -> dict[str, Column]:
    """Rules over the wide state rows."""
    q = S.QA
    p = F.col("players")
    some = lambda f: F.exists(p, f)
    return {
        "speed": some(lambda x: (x["alive"] == 1) & (x["speed"] > q["max_speed"])), "health": some(lambda x: x["health"] > q["max_health"]),
        "negative_time_left": (F.col("ctx_time_remaining_s") < 0) | F.exists("utility", lambda u: u["time_left_s"] < 0),
        "alive_per_side": (F.col("ctx_alive_ct") > q["max_alive"]) | (F.col("ctx_alive_t") > q["max_alive"])}


def unseen_counts(df: DataFrame, vocab: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column whose value the vocabulary lacks."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_x")).select("_x.*")
    n = long.where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    miss = n.join(vocab.select("field", "value"), ["field", "value"], "left_anti").groupBy("field").agg(F.sum("n").alias("n_unseen"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "field string")
    return names.join(miss, "field", "left").fillna(0, ["n_unseen"])


def qa_violations(prof: DataFrame, limits: dict[str, float | None], total_outliers: DataFrame | None = None, max_outliers: int | None = None) -> DataFrame:
    """Columns above their family's limit of unknown values, and an outlier total above its limit."""
    cap = F.lit(None).cast("double")
    for fam, lim in limits.items():
        if lim is not None:
            cap = F.when(F.col("feature").startswith(fam + "."), F.lit(float(lim))).otherwise(cap)
    out = prof.withColumn("_cap", cap).where(F.col("null_pct") > F.col("_cap")).select("feature", F.concat(F.lit("null share above "), F.col("_cap").cast("string")).alias("problem"))
    if total_outliers is not None and max_outliers is not None:
        t = total_outliers.agg(F.sum("count").alias("n")).where(F.col("n") > max_outliers)
        out = out.unionByName(t.select(F.lit("outliers").alias("feature"), F.concat(F.lit("count "), F.col("n").cast("string")).alias("problem")))
    return out


# inventory


def inventory(matches: DataFrame) -> DataFrame:
    """Matches by tier, map, month and status with every margin (``cube``)."""
    m = matches.withColumn("month", month_of(F.col("date")))
    return m.cube("tier", "map", "month", "status").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def quarantine_counts(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("status") == "quarantined").groupBy("quarantine_reason").agg(F.count(F.lit(1)).alias("n"))


def failure_counts(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "failed").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def coverage_shortfalls(matches: DataFrame, tier: str, maps: DataFrame, last_month: str, targets: dict | None = None) -> DataFrame:
    """Counts below their target: the tier's total, each map and each month of the calendar.

    ``maps``: one ``map`` per row.  Maps and months without a match count as 0.
    """
    t = targets or S.TARGETS[tier]
    ok = matches.where((F.col("tier") == tier) & (F.coalesce("status", F.lit("")) != "quarantined")).withColumn("month", month_of(F.col("date")))
    n = F.count(F.lit(1)).alias("n")
    out = ok.agg(n).select(F.lit("total").alias("what"), F.lit("all").alias("which"), "n", F.lit(t["total"]).alias("target"))
    by_map = maps.join(ok.groupBy("map").agg(n), "map", "left").select(F.lit("map").alias("what"), F.col("map").alias("which"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(t["per_map"]).alias("target"))
    out = out.unionByName(by_map)
    if t.get("per_month") is not None:
        first = t.get("first_month", S.TARGETS["first_month"])
        cal = ok.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(f"{first}-01")), F.to_date(F.lit(f"{last_month}-01")), F.expr("interval 1 month"))).alias("d"))
        cal = cal.select(F.date_format("d", "yyyy-MM").alias("month"))
        by_month = cal.join(ok.groupBy("month").agg(n), "month", "left")
        out = out.unionByName(by_month.select(F.lit("month").alias("what"), F.col("month").alias("which"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(t["per_month"]).alias("target")))
    return out.where(F.col("n") < F.col("target"))


def status_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
