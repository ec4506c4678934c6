"""Reliability, temperatures, terminal pin and drift of a scored state table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import stats
from ..functions.exprs import sigmoid
from .scan import Run, asof

C = S.CALIBRATION


def reliability(df: DataFrame, keys: Sequence[str], p: str, y: str, n_bins: int = 20) -> DataFrame:
    """Equal-width bins with mean prediction and observed rate; empty bins are listed."""
    keys = list(keys)
    b = F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.floor(F.col(p) * n_bins))).cast("int")
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    got = rows.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("observed"))
    base = rows.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    every = base.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    out = every.join(got, [*keys, "bin"], "left").fillna(0, ["n"])
    return out.withColumns({"lo": F.col("bin") / n_bins, "hi": (F.col("bin") + 1) / n_bins})


def ece(rel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected calibration error of reliability bins."""
    gap = F.when(F.col("n") > 0, F.col("n") * F.abs(F.col("mean_pred") - F.col("observed")))
    return rel.groupBy(*keys).agg(F.try_divide(F.sum(gap), F.sum("n")).alias("ece"))


def metrics(df: DataFrame, keys: Sequence[str], p: str, y: str, n_bins: int = 20) -> DataFrame:
    """n, log loss, Brier, AUC and ECE per key; rows with an unknown value are left out."""
    keys = list(keys)
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull() & ~F.isnan(p)).withColumn(y, F.col(y).cast("double"))
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), stats.logloss(F.col(p), F.col(y)).alias("logloss"), stats.brier(F.col(p), F.col(y)).alias("brier"))
    join = lambda a, b: a.join(b, keys, "left") if keys else a.join(b, F.lit(True), "left")
    return join(join(base, stats.auc(rows, keys, p, y)), ece(reliability(rows, keys, p, y, n_bins), keys))


def bin_violations(rel: DataFrame, tol: float | None = None, min_n: int | None = None) -> DataFrame:
    """Bins with enough rows whose prediction and observation differ too much."""
    tol, min_n = tol if tol is not None else C["bin_tol"], min_n if min_n is not None else C["min_bin_n"]
    return rel.where((F.col("n") >= min_n) & (F.abs(F.col("mean_pred") - F.col("observed")) > tol))


def nll_grid(df: DataFrame, keys: Sequence[str], logit: str, y: str, grid: Column) -> DataFrame:
    """Log loss of each key at each temperature of a grid array (one pass, sums only)."""
    rows = df.where(F.col(logit).isNotNull() & F.col(y).isNotNull())
    wide = rows.withColumn("log_t", F.explode(grid))
    return wide.groupBy(*keys, "log_t").agg(stats.logloss(sigmoid(F.col(logit), F.exp("log_t")), F.col(y).cast("double")).alias("nll"))


def fit_temperature(df: DataFrame, keys: Sequence[str], logit: str, y: str, lo: float = -4.0, hi: float = 4.0, steps: int = 32, rounds: int = 3) -> DataFrame:
    """Temperature of least log loss per key: a grid over log T, refined around the best cell.

    Keys with one class or without rows get 1.
    """
    keys = list(keys)
    rows = df.where(F.col(logit).isNotNull() & F.col(y).isNotNull()).select(*keys, logit, y)
    both = rows.groupBy(*keys).agg((F.min(y) != F.max(y)).alias("_two"))
    best = both.withColumns({"_a": F.lit(lo), "_b": F.lit(hi)})
    on = lambda a, b: a.join(b, keys) if keys else a.join(b, F.lit(True))
    for _ in range(rounds):
        step = (F.col("_b") - F.col("_a")) / steps
        r = on(rows, best).withColumn("_grid", F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.col("_a") + i * step))
        top = nll_grid(r, keys, logit, y, F.col("_grid")).groupBy(*keys).agg(F.min_by("log_t", F.struct("nll", "log_t")).alias("_t"))
        best = on(best, top).withColumns({"_a": F.col("_t") - step, "_b": F.col("_t") + step}).drop("_t")
    mid = F.exp((F.col("_a") + F.col("_b")) / 2)
    return best.select(*keys, F.when(F.col("_two"), mid).otherwise(F.lit(1.0)).alias("T"))


def fit_calibration(df: DataFrame, logit: str, y: str, group: Sequence[str], n_bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """One temperature for all rows and one per group with enough rows.

    Returns ``(temperatures per group, summary)``; the group temperatures are kept only
    when they lower the calibration error by the least improvement.
    """
    group = list(group)
    rows = df.where(F.col(logit).isNotNull() & F.col(y).isNotNull())
    single = fit_temperature(rows, [], logit, y)
    big = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= C["min_group_n"])
    per = fit_temperature(rows.join(big.select(*group), group, "left_semi"), group, logit, y).withColumnRenamed("T", "T_group")
    r = rows.join(single, F.lit(True)).join(per, group, "left")
    r = r.withColumns({"_p1": sigmoid(F.col(logit), F.col("T")), "_p2": sigmoid(F.col(logit), F.coalesce("T_group", "T"))})
    e1 = ece(reliability(r, [], "_p1", y, n_bins), []).withColumnRenamed("ece", "ece_single")
    e2 = ece(reliability(r, [], "_p2", y, n_bins), []).withColumnRenamed("ece", "ece_group")
    keep = (F.col("ece_single") - F.col("ece_group")) >= C["min_improve"]
    summary = single.join(e1, F.lit(True)).join(e2, F.lit(True)).withColumn("mode", F.when(keep, "group").otherwise("single"))
    return per.join(summary.where("mode = 'group'").select(), F.lit(True), "left_semi"), summary


def apply_calibration(df: DataFrame, logit: str, groups: DataFrame, summary: DataFrame, group: Sequence[str], name: str = "W") -> DataFrame:
    """Calibrated probability: the group's temperature, else the common one."""
    out = df.join(groups, list(group), "left").join(summary.select("T"), F.lit(True))
    return out.withColumn(name, sigmoid(F.col(logit), F.coalesce("T_group", "T"))).drop("T", "T_group")


def version_through_vocab(df: DataFrame, vocab: DataFrame, column: str) -> DataFrame:
    """Map version as the fit saw it: unseen is ``<unk>``, unknown is ``<null>``."""
    known = vocab.select(F.col("value").alias(column), F.lit(True).alias("_k"))
    out = df.join(known, column, "left")
    return out.withColumn(column, F.when(F.col(column).isNull(), "<null>").when(F.col("_k"), F.col(column)).otherwise("<unk>")).drop("_k")


def terminal_pin(df: DataFrame, keys: Sequence[str], p: str, y: str, hi: float = 0.99, lo: float = 0.01, min_rate: float = 0.99) -> DataFrame:
    """Share of terminal rows whose prediction is pinned to the outcome."""
    t = df.where("is_terminal = 1").where(F.col(y).isNotNull())
    good = F.when(F.col(y) > 0.5, F.col(p) >= hi).otherwise(F.col(p) <= lo)
    return t.groupBy(*keys).agg(F.countDistinct("match_key", "round_num").alias("n_rounds"), F.avg(good.cast("double")).alias("rate")).withColumn("ok", F.col("rate") >= min_rate)


def martingale_pairs(df: DataFrame, by: Sequence[str], tick: str, p: str, horizon: int, width: int) -> DataFrame:
    """Each row with the value of the first row of its key at or after ``tick + horizon``."""
    later = df.select(*by, F.col(tick).alias("_ft"), F.col(p).alias("_fp"))
    probe = df.withColumn("_target", F.col(tick) + horizon)
    out = asof(probe, later, by, "_target", "_ft", ["_fp"], width=width, direction="forward")
    return out.where("_fp is not null")


def martingale(df: DataFrame, by: Sequence[str], tick: str, p: str, horizons: dict[float, int], width: int, n_bins: int = 20,
               min_n: int | None = None, tol: float | None = None) -> DataFrame:
    """Mean change of the prediction per starting bin and horizon (``horizons``: seconds to ticks)."""
    min_n, tol = min_n if min_n is not None else C["martingale_min_n"], tol if tol is not None else C["martingale_tol"]
    out = None
    for k, ticks in horizons.items():
        m = martingale_pairs(df, by, tick, p, ticks, width)
        b = F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.floor(F.col(p) * n_bins))).cast("int")
        m = m.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_fp") - F.col(p)).alias("mean_drift")).withColumn("k", F.lit(float(k)))
        out = m if out is None else out.unionByName(m)
    judged = F.col("n") >= min_n
    return out.withColumns({"judged": judged, "violation": judged & (F.abs("mean_drift") > tol)})


def breakdowns(df: DataFrame, keys: Sequence[str], p: str, y: str, n_bins: int = 20) -> DataFrame:
    """Metrics overall and per value of each key, in one long table ``(breakdown, value, ...)``."""
    parts = F.array(F.struct(F.lit("all").alias("breakdown"), F.lit("all").alias("value")),
                    *[F.struct(F.lit(k).alias("breakdown"), F.col(k).cast("string").alias("value")) for k in keys])
    long = df.select(p, y, F.explode(parts).alias("_b")).select(p, y, "_b.breakdown", "_b.value")
    return metrics(long, ["breakdown", "value"], p, y, n_bins)


def target_failures(m: DataFrame) -> DataFrame:
    """Metric rows that miss their targets, with the reasons."""
    bad = F.array_compact(F.array(
        F.when(F.col("ece") > C["ece_target"], F.lit("ece")), F.when(F.col("ece").isNull(), F.lit("ece unknown")),
        F.when(F.col("baseline_logloss") - F.col("logloss") < C["logloss_margin"], F.lit("logloss margin"))))
    return m.withColumn("failures", bad).where(F.size("failures") > 0)
