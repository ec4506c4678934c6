"""Rank statistics and metrics as distributed aggregates.

Ranks are taken over distinct values: values are counted first, the counts are scanned in
value order block by block, and only sums leave the scan.  Ranks are joined by value, so
rows that a plan adds up (whose last digits may differ when it runs again) are settled first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import settled

EPS = 1e-7


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, buckets: int = 256) -> DataFrame:
    """Average rank (1-based) of each distinct value per key: ``keys, value, n, name``.

    A value falls in one of ``buckets`` equal-width cells of the key's range; counts are
    ranked inside a cell and shifted by the cells below it, so no task sees a whole key.
    """
    keys = list(keys)
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    lim = per.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    per = per.join(lim, keys) if keys else per.join(lim, F.lit(True))
    cell = F.floor(F.try_divide(F.col(value).cast("double") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * buckets)
    per = per.withColumn("_c", F.least(F.lit(buckets - 1), F.coalesce(cell, F.lit(0))).cast("int")).drop("_lo", "_hi")
    cells = per.groupBy(*keys, "_c").agg(F.sum("n").alias("_cn"))
    below = F.coalesce(F.sum("_cn").over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_below", below).drop("_cn")
    inner = F.sum("n").over(Window.partitionBy(*keys, "_c").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    out = per.withColumn("_run", inner).join(cells, [*keys, "_c"])
    return out.select(*keys, value, "n", (F.col("_below") + F.col("_run") - F.col("n") + (F.col("n") + 1) / 2).alias(name))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "rho") -> DataFrame:
    """Rank correlation per key with average ranks; null with fewer than 3 pairs or a constant side."""
    keys = list(keys)
    rows = out = settled(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b))
    for v, r in ((a, "_ra"), (b, "_rb")):
        out = out.join(value_ranks(rows, keys, v, r).drop("n"), [*keys, v])
    ok = (F.count(F.lit(1)) >= 3) & (F.stddev_pop("_ra") > 0) & (F.stddev_pop("_rb") > 0)
    return out.groupBy(*keys).agg(F.when(ok, F.corr("_ra", "_rb")).alias(name), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, keys: Sequence[str], p: str, y: str, name: str = "auc") -> DataFrame:
    """Exact area under the ROC curve per key from the rank sum; null with one class."""
    keys = list(keys)
    rows = settled(df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*keys, p, y))
    r = rows.groupBy(*keys, p).agg(F.count_if(F.col(y) > 0.5).alias("_pos"), F.count_if(F.col(y) <= 0.5).alias("_neg"))
    r = r.join(value_ranks(rows, keys, p, "_r").drop("n"), [*keys, p])
    pos, neg = F.sum("_pos"), F.sum("_neg")
    u = F.sum(F.col("_r") * F.col("_pos")) - pos * (pos + 1) / 2
    return r.groupBy(*keys).agg(F.when((pos > 0) & (neg > 0), u / (pos.cast("double") * neg)).alias(name))


def equal_bins(df: DataFrame, order: Sequence[str], n_bins: int, name: str, value: str, buckets: int = 1024) -> DataFrame:
    """Equal-count bins over the order of ``value`` (ties by ``order``), the first bins one row larger."""
    lim = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    d = df.join(lim, F.lit(True))
    cell = F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * buckets)
    d = d.withColumn("_c", F.least(F.lit(buckets - 1), F.coalesce(cell, F.lit(0))).cast("int"))
    cells = d.groupBy("_c").agg(F.count(F.lit(1)).alias("_cn"))
    below = F.coalesce(F.sum("_cn").over(Window.partitionBy(F.lit(1)).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_below", below).drop("_cn")
    rn = F.row_number().over(Window.partitionBy("_c").orderBy(value, *order))
    d = d.withColumn("_rn", rn).join(cells, "_c").withColumn("_i", F.col("_below") + F.col("_rn") - 1)
    base, extra = F.floor(F.col("_n") / n_bins), F.col("_n") % n_bins
    big = extra * (base + 1)
    b = F.when(F.col("_i") < big, F.floor(F.try_divide(F.col("_i"), base + 1))).otherwise(extra + F.floor(F.try_divide(F.col("_i") - big, base)))
    return d.withColumn(name, b.cast("int")).drop("_lo", "_hi", "_n", "_c", "_below", "_rn", "_i")


def logloss(p: Column, y: Column) -> Column:
    """Aggregate log loss with probabilities clipped away from 0 and 1."""
    q = F.least(F.lit(1 - EPS), F.greatest(F.lit(EPS), p))
    return -F.avg(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))
