"""Queries for stored fits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import value as J
from ..operators.scan import durable, shared_folder
from ..sources.fits import FitStore
from .registry import query, table

_FIT_SQL = """p AS (SELECT l_returnflag AS cls, l_suppkey AS player, l_orderkey % 3 = 0 AS late, count(*) AS n, avg(l_discount) AS mean, var_pop(l_discount) * count(*) AS ss FROM lineitem GROUP BY ALL),
f AS (SELECT late, cls, sum(ss) / sum(n - 1) AS s2, var_samp(mean) AS vm, count(*) / sum(1.0 / n) AS nb, sum(mean * n) / sum(n) AS m FROM p WHERE n >= 2 GROUP BY late, cls HAVING count(*) >= 2),
k AS (SELECT *, s2 / greatest(1e-12, vm - s2 / nb) AS k FROM f)"""


def _fits(spark: SparkSession, sf: str) -> tuple[FitStore, dict[int, DataFrame]]:
    """A store with shrinkage fits of two parts of the orders; the one of more lines is adopted."""
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cls"), F.col("l_suppkey").alias("player"), "l_discount", (F.col("l_orderkey") % 3 == 0).alias("late"))
    store, stats = FitStore(spark, f"{shared_folder(spark).rstrip('/')}/fits-{uuid.uuid4().hex}"), {}
    for late in (False, True):
        ps = durable(J.player_stats(l.where(F.col("late") == late), "cls", "player", "l_discount"))
        fit = J.fit_shrinkage(ps, "cls")
        n = fit.agg(F.sum("n_actions").alias("a"), F.sum("n_players").alias("p")).first()
        stats[store.put_table("shrinkage", fit, {"n_actions": n.a or 0, "n_players": n.p or 0})] = ps
    best = store.models("shrinkage").agg(F.max_by("version", F.struct(F.col("metrics")["n_actions"], "version")).alias("v")).first().v
    store.adopt("shrinkage", 3 - best)
    store.adopt("shrinkage", best)
    return store, stats


@query("adopted_models", f"""WITH {_FIT_SQL}, q AS (SELECT CASE WHEN late THEN 2 ELSE 1 END AS version, sum(n) AS n_actions, count(*) AS n_players FROM p JOIN f USING (late, cls) WHERE n >= 2 GROUP BY late)
SELECT 'shrinkage' AS kind, CAST(version AS INT) AS version, CAST(n_actions AS DOUBLE) AS n_actions, CAST(n_players AS DOUBLE) AS n_players, version = (SELECT arg_max(version, n_actions * 10 + version) FROM q) AS in_use FROM q""")
def adopted_models(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of a stored fit with their metrics and which is in use; an earlier adoption gives way to the last."""
    store, _ = _fits(spark, sf)
    return store.models("shrinkage").select("kind", "version", F.col("metrics")["n_actions"].alias("n_actions"), F.col("metrics")["n_players"].alias("n_players"), "in_use")


@query("stored_fit_scores", f"""WITH {_FIT_SQL}, q AS (SELECT late, sum(n) AS a FROM p JOIN f USING (late, cls) WHERE n >= 2 GROUP BY late), b AS (SELECT arg_max(late, a * 10 + CASE WHEN late THEN 2 ELSE 1 END) AS late FROM q)
SELECT cls, player, n, round(n / (n + k), 6) AS factor, round(m + (mean - m) * n / (n + k), 6) AS tilde, round(1.645 * sqrt(s2 / (n + k)), 6) AS ci FROM p JOIN k USING (late, cls) WHERE late = (SELECT late FROM b)""")
def stored_fit_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Players shrunk by the adopted fit, read back from the store."""
    store, stats = _fits(spark, sf)
    s = J.shrink_players(stats[store.adopted("shrinkage")], store.table("shrinkage"), "cls").where("factor is not null")
    return s.select("cls", "player", "n", *[F.round(c, 6).alias(c) for c in ("factor", "tilde", "ci")])
