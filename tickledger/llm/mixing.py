"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a cap of so many epochs.  The level (words per unit of weight)
rises until the targets use up the budget: a source whose share would pass its cap is
clamped and its excess goes to the others by weight.  Then a source's target is met by
whole repetitions of all its documents and one more repetition of the documents that come
first in a seeded order; the document at the cut is repeated in part.

Per source only a few sums and one cut are kept.  The order of a source is cut in buckets
of the seed's hash, so that no task ever sorts a source; documents meet the cuts by source,
and their texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import n_words, query, read, written

#: Hex digits of the seeded hash that name a bucket of a source's order.
BUCKET_DIGITS = 3


def order_key(doc_id: Column, seed: int) -> Column:
    """Place of a document in the seeded order: hex, then compared as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def ranked_weights(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """``source, weight``: the sources by code point, null last, weigh ``cycle``, repeating.

    ``sources`` holds one row per source; ranks are dealt over ranges of the names.
    """
    parts = sources.select("source").repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id())
    parts = written(parts)
    before = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.Window.orderBy("_p").rowsBetween(W.Window.unboundedPreceding, -1)))
    at = F.row_number().over(W.Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1 + F.coalesce("_before", F.lit(0))
    pick = F.element_at(F.array(*map(F.lit, cycle)), (at % len(cycle) + 1).cast("int"))
    return parts.join(before, "_p").select("source", pick.cast("double").alias("weight"))


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Add ``target`` to ``source, source_size, weight``: ``share`` of all sizes, at most ``epochs`` of each source.

    The loop carries the level alone: each step sums what lies at its cap below the level and
    raises the level for the rest, until no further source is clamped.  Sources without
    words get 0; if all caps together are below the budget, every target is its cap.
    """
    cap = F.col("source_size") * F.lit(epochs)
    level, clamped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        got = sources.agg(
            (F.sum("source_size") * F.lit(share) - F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0))).alias("left"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count_if(full).alias("n"),
        ).first()
        if got.n == clamped or got.left is None:
            break
        clamped = got.n
        level = got.left / got.weight if got.weight > 0 else float("inf")
    return sources.withColumn("target", F.coalesce(F.least(cap, F.col("weight") * F.lit(level)), F.lit(0.0)) if level != float("inf") else cap.cast("double"))


def mix_plan(sizes: DataFrame, weights: DataFrame, share: float = 1.5, epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """One row per source: ``source, source_size, target, whole, cut_key, cut_part, cut_size``.

    ``sizes`` (``doc_id, source, size``) is read three times and should be a written table.
    Every document is repeated ``whole`` times, those before ``cut_key`` once more, and the
    ``cut_size`` words at ``cut_key`` give ``cut_part`` of their words.
    """
    keyed = sizes.select("source", "size", order_key(F.col("doc_id"), seed).alias("key")).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = written(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    total = buckets.groupBy("source").agg(F.sum("n").alias("source_size"))
    w = weights.select(F.col("source").alias("_s"), "weight")
    sources = written(total.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    plan = water_fill(sources, share, epochs)
    words = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole.cast("long")).withColumn("rest", (words - F.col("whole") * F.col("source_size")).cast("long"))
    run = W.Window.partitionBy("source").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    at = buckets.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    rest = plan.select(F.col("source").alias("_s"), "rest")
    at = at.join(rest, F.col("source").eqNullSafe(F.col("_s"))).where("before <= rest and rest < before + n")
    edge = at.select("_s", F.col("bucket").alias("_b"), "before", "rest")
    docs = keyed.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    keys = docs.groupBy("source", "key", "before", "rest").agg(F.sum("size").alias("n"))
    run = W.Window.partitionBy("source").orderBy("key").rowsBetween(W.Window.unboundedPreceding, -1)
    keys = keys.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(run), F.lit(0))).where("before <= rest and rest < before + n")
    cut = keys.select(F.col("source").alias("_s"), F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_part"), F.col("n").alias("cut_size"))
    return written(plan.drop("rest", "weight").join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def apply_mix(docs: DataFrame, size: Column, plan: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``size, source_size, target, taken, whole, part_words`` to every row of ``docs``.

    ``taken`` = ``whole`` repetitions + ``part_words`` (the whole size before the cut, a part
    at it, none after it).  The plan has a row per source and is joined by source.
    """
    p = plan.select(F.col("source").alias("__mix_s"), *[F.col(c).alias(f"__mix_{c}") for c in ("source_size", "target", "whole", "cut_key", "cut_part", "cut_size")])
    rows = docs.withColumn("__mix_size", size).withColumn("__mix_key", order_key(F.col("doc_id"), seed)).join(p, F.col("source").eqNullSafe(F.col("__mix_s")), "left")
    part = F.when(F.col("__mix_key") < F.col("__mix_cut_key"), F.col("__mix_size")).when(F.col("__mix_key") == F.col("__mix_cut_key"), F.floor(F.col("__mix_cut_part") * F.col("__mix_size") / F.col("__mix_cut_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("__mix_part", part)
    taken = F.col("__mix_whole") * F.col("__mix_size") + F.col("__mix_part")
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("size", "source_size", "target", "taken", "whole", "part_words")],
        F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), taken.alias("taken"), F.col("__mix_whole").alias("whole"), F.col("__mix_part").alias("part_words"),
    )


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """Every document with the words that the mix takes of it.

    Without ``weights`` (``source, weight``) the ranked ones apply; a source without a weight
    gets nothing.  A null source is a source of its own, a null text has no words, a null id
    has one place in the order.  Rows with the same id share their place, so that they are
    taken alike (a cut among them is shared by size).  An empty table gives no rows.
    Columns of ``docs`` that bear the name of an added one give way to it.
    """
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    if weights is None:
        weights = ranked_weights(sizes.groupBy("source").count())
    plan = mix_plan(sizes, weights, share, epochs, seed)
    return apply_mix(docs, n_words(F.col("text")), plan, seed)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY n * 2.0 / w, source) AS i FROM s),
lv AS (
  SELECT i, n * 2.0 AS cap, w,
         ((sum(n) OVER ()) * 1.5 - 2.0 * coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM o),
l AS (SELECT level FROM lv WHERE cap > w * level ORDER BY i LIMIT 1),
t AS (SELECT source, n, least(n * 2.0, w * level) AS target FROM s, l),
p AS (SELECT *, (CASE WHEN n > 0 THEN floor(floor(target) / n) ELSE 0 END)::BIGINT AS whole FROM t),
c AS (
  SELECT d.doc_id, d.source, d.size, p.n AS source_size, p.target, p.whole, (floor(p.target) - p.whole * p.n)::BIGINT AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, greatest(0, least(size, rest - before))::BIGINT AS part_words FROM c)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (whole * size + part_words)::BIGINT AS taken, source, whole, part_words FROM x
"""


@query("op1_mixing", OP1_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")))
    plan = mix_plan(sizes, ranked_weights(sizes.groupBy("source").count()))
    return apply_mix(sizes, F.col("size"), plan).select("doc_id", "size", "source_size", "target", "taken", "source", "whole", "part_words")
