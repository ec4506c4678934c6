"""Nearest neighbours inside a partition, panels of what the neighbours did, outlier distances.

The search is exact.  Vectors of a group are cut in cells around pivots; a first pass in
the query's own cell bounds the k-th distance, and only cells that can still hold a
closer vector (triangle inequality) are searched after that.  A task compares one block
of queries with one block of a cell as a matrix product and keeps k rows per query, so
pairs are never emitted.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from .scan import durable

BLOCK_ROWS = 4096
PIVOTS = 64
STRIP = 256


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: F.when(n > 0, x / n).otherwise(x))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 1))


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a frame can be cogrouped with a relative."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _pivots(index: DataFrame, group: Sequence[str]) -> DataFrame:
    """One vector per ``BLOCK_ROWS`` rows of a group, about ``PIVOTS`` at most, picked by hash; at least one."""
    n = index.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min(F.xxhash64("id")).alias("_low"))
    h = F.xxhash64("id")
    # the lowest hash is always taken, so a small group has one cell
    pick = (F.pmod(h, F.greatest(F.lit(BLOCK_ROWS), F.floor(F.col("_n") / PIVOTS).cast("bigint"))) == 0) | (h == F.col("_low"))
    p = index.join(n, list(group)).where(pick)
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(h, "id"))
    return p.withColumn("pivot", rn - 1).select(*group, "pivot", F.col("vec").alias("pvec"))


def _assign(rows: DataFrame, pivots: DataFrame, group: Sequence[str]) -> DataFrame:
    """Nearest pivot of each vector; rows are dealt in blocks and each block meets the pivots once."""
    group = list(group)
    cnt = rows.groupBy(*group).agg((F.floor(F.count(F.lit(1)) / BLOCK_ROWS) + 1).cast("int").alias("_k"))
    dealt = rows.join(cnt, group).withColumn("_s", F.pmod(F.xxhash64("id", F.lit(7)), F.col("_k")).cast("int")).drop("_k")
    spread = pivots.join(cnt, group).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    schema = dealt.drop("_s").withColumns({"cell": F.lit(0), "cdist": F.lit(0.0)}).schema

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.drop(columns="_s")
        if a.empty or b.empty:  # a group without index rows has no neighbours
            return a.head(0).assign(cell=pd.Series(dtype="int32"), cdist=pd.Series(dtype="float64"))
        x, p = _matrix(a["vec"]), _matrix(b["pvec"])
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * x @ p.T, 0.0))
        i = d.argmin(1)
        return a.assign(cell=b["pivot"].to_numpy()[i].astype("int32"), cdist=d[np.arange(len(a)), i])

    key = group + ["_s"]
    return dealt.groupBy(*key).cogroup(_fresh(spread).groupBy(*key)).applyInPandas(near, schema)


def nearest(a: pd.DataFrame, b: pd.DataFrame, k: int, exclude: bool) -> pd.DataFrame:
    """The ``k`` rows of ``b`` nearest to each row of ``a``: ``qid, id, dist``; distances are held for ``STRIP`` queries at a time."""
    out = [pd.DataFrame({"qid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})]
    if a.empty or b.empty:
        return out[0]
    b = b.sort_values("id", kind="stable")
    ids, v = b["id"].to_numpy(), _matrix(b["vec"])
    m, vv = min(k, len(b)), (v**2).sum(1)[None]
    for at in range(0, len(a), STRIP):
        s = a.iloc[at : at + STRIP]
        u = _matrix(s["vec"])
        d = np.sqrt(np.maximum((u**2).sum(1)[:, None] + vv - 2 * u @ v.T, 0.0))
        if exclude:
            known = s["_ex"].notna().to_numpy()[:, None]  # rows of unknown origin hide nothing
            d[(s["_ex"].to_numpy()[:, None] == b["_ex"].to_numpy()[None]) & known] = np.inf
        i = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :m]
        res = pd.DataFrame({"qid": np.repeat(s["id"].to_numpy(), m), "id": ids[i].ravel(), "dist": np.take_along_axis(d, i, 1).ravel()})
        out.append(res[np.isfinite(res["dist"])])
    return pd.concat(out[1:], ignore_index=True)


def knn(queries: DataFrame, index: DataFrame, group: Sequence[str], k: int, exclude: str | None = None) -> DataFrame:
    """The k nearest index rows of each query in its group by Euclidean distance: ``qid, id, dist, rank``.

    Both frames hold ``id``, ``vec`` and the group columns; rows that share ``exclude`` with
    the query never count.  Ties go to the smaller id.
    """
    group = list(group)
    ex = exclude or "_none"
    take = lambda d: d.select(*group, "id", (F.col(exclude).cast("string") if exclude else F.lit(None).cast("string")).alias("_ex"),
                              F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    q, x = take(queries), take(index)
    pivots = durable(_pivots(x, group))
    x, q = durable(_assign(x, pivots, group)), durable(_assign(q, pivots, group))
    cells = x.groupBy(*group, "cell").agg(F.count(F.lit(1)).alias("_n"), F.max("cdist").alias("radius"))
    cells = cells.join(pivots.withColumnRenamed("pivot", "cell"), group + ["cell"])
    cells = cells.withColumn("blocks", (F.floor(F.col("_n") / BLOCK_ROWS) + 1).cast("int"))
    xb = x.join(cells.select(*group, "cell", "blocks"), group + ["cell"]).withColumn("xb", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks", "cdist")
    qn = q.groupBy(*group, "cell").agg((F.floor(F.count(F.lit(1)) / BLOCK_ROWS) + 1).cast("int").alias("_k"))
    q = q.join(qn, group + ["cell"]).withColumn("qb", F.concat_ws("_", F.col("cell").cast("string"), F.pmod(F.xxhash64("id"), F.col("_k")).cast("string"))).drop("_k")
    out_schema = "qid bigint, id bigint, dist double"

    def top(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return nearest(a, b, k, exclude is not None)

    def search(pairs: DataFrame) -> DataFrame:
        """``pairs``: group, qid, qb, cell to search."""
        # (query block, cell block) is one task key; each side is copied only to the keys that need it
        want = pairs.join(cells.select(*group, "cell", "blocks"), group + ["cell"]).withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left = want.join(q.select(*group, F.col("id").alias("qid"), "vec", "_ex"), group + ["qid"]).withColumnRenamed("qid", "id")
        left = left.select(*group, "qb", "cell", "xb", "id", "vec", "_ex")
        right = want.select(*group, "qb", "cell", "xb").distinct().join(xb, group + ["cell", "xb"]).select(*group, "qb", "cell", "xb", "id", "vec", "_ex")
        key = group + ["qb", "cell", "xb"]
        return left.groupBy(*key).cogroup(_fresh(right).groupBy(*key)).applyInPandas(top, out_schema)

    def best(hits: DataFrame) -> DataFrame:
        rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("dist", 9), "id"))
        return hits.withColumn("rank", rn).where(F.col("rank") <= k)

    own = q.select(*group, F.col("id").alias("qid"), "qb", "cell")
    first = durable(best(search(own)))
    bound = first.groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("dist"))).alias("ub"))
    qq = q.select(*group, F.col("id").alias("qid"), "qb", F.col("cell").alias("own"), "vec").join(bound, "qid", "left")
    c = qq.join(cells.select(*group, "cell", "radius", "pvec"), group).where(F.col("cell") != F.col("own"))
    d = F.sqrt(F.aggregate(F.zip_with("vec", "pvec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    c = c.where(F.col("ub").isNull() | (d - F.col("radius") <= F.col("ub") + 1e-9)).select(*group, "qid", "qb", "cell")
    rest = search(c)
    return best(first.drop("rank").unionByName(rest))


def knn_cosine(queries: DataFrame, index: DataFrame, group: Sequence[str], k: int, exclude: str | None = None) -> DataFrame:
    """Nearest by cosine similarity: the Euclidean order of unit vectors; adds ``cosine``."""
    unit = lambda d: d.withColumn("vec", l2_normalize(F.col("vec")))
    out = knn(unit(queries), unit(index), group, k, exclude)
    return out.withColumn("cosine", F.lit(1.0) - F.col("dist") * F.col("dist") / 2)


def panels(neighbours: DataFrame, table: DataFrame, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What the neighbours of each query did.

    ``neighbours``: qid, id, rank; ``table``: id, action_id, descriptor_key, V (and Q).  Returns
    ``entries`` (the ``top`` keys per query with n, share, mean V and the nearest member) and
    ``summary`` (n_used, n_other and a stable reference per query).
    """
    top = top or S.VALUE["panel_top"]
    r = neighbours.join(table, "id")
    q = F.avg("Q").alias("mean_Q") if "Q" in table.columns else F.lit(None).cast("double").alias("mean_Q")
    e = r.groupBy("qid", F.col("descriptor_key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.avg("V").alias("mean_V"), q, F.min_by("id", "rank").alias("nearest_id"))
    used = r.groupBy("qid").agg(F.count(F.lit(1)).alias("n_used"), F.array_sort(F.collect_list(F.struct("rank", "action_id"))).alias("_ids"))
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "key"))).join(used.select("qid", "n_used"), "qid")
    e = e.withColumn("freq", F.col("n") / F.col("n_used"))
    entries = e.where(F.col("pos") <= top)
    kept = entries.groupBy("qid").agg(F.sum("n").alias("_k"))
    names = F.array_join(F.transform("_ids", lambda x: x["action_id"].cast("string")), ",")
    summary = used.join(kept, "qid").select("qid", "n_used", (F.col("n_used") - F.col("_k")).alias("n_other"), F.substring(F.sha1(names), 1, 16).alias("panel_ref"))
    return entries, summary


def key_support(neighbours: DataFrame, table: DataFrame, queries: DataFrame) -> DataFrame:
    """Neighbours of each query that did what the query itself did: ``qid, key_support``."""
    r = neighbours.join(table.select("id", "descriptor_key"), "id").join(queries.select(F.col("id").alias("qid"), F.col("descriptor_key").alias("_own")), "qid")
    return r.groupBy("qid").agg(F.count_if(F.col("descriptor_key") == F.col("_own")).alias("key_support"))


def kth_distance(queries: DataFrame, index: DataFrame, k: int, group: Sequence[str] = ("_all",), exclude: str | None = None) -> DataFrame:
    """Distance of each query to its k-th nearest index row: ``qid, score``."""
    add = lambda d: d.withColumn("_all", F.lit(0)) if list(group) == ["_all"] else d
    n = knn(add(queries), add(index), group, k, exclude)
    return n.groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("dist"))).alias("score"))


def ood_threshold(factual_scores: DataFrame, percentile: float | None = None) -> DataFrame:
    """Threshold above which an embedding is off-distribution: a percentile of held-out scores."""
    p = (percentile if percentile is not None else S.GATE["ood_percentile"]) / 100.0
    return factual_scores.agg(F.percentile("score", p).alias("threshold"))


def ood_flags(scores: DataFrame, threshold: DataFrame) -> DataFrame:
    return scores.join(threshold, F.lit(True)).withColumn("flag", F.col("score") > F.col("threshold"))
