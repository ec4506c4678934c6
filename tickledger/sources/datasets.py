"""Datasets: shards of an exact size per split, with the vocabulary and statistics of the train split.

A dataset is a folder with ``shards`` (partitioned by split and shard), ``vocab``, ``norm``
and ``index``.  The index says for every shard how many rows it has, its first and last key
and with which layout, splits, vocabulary and statistics it was built; a reader refuses what
does not fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits as P
from ..operators.scan import durable, numbered, settled
from ..operators.value import fit_vocab, to_ids

SPLITS = ("train", "val", "test")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something readable lies at a path."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).limit(1).collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def fingerprint(df: DataFrame, columns: Sequence[str]) -> str:
    """A hash of a small table's rows, whatever their order."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")).alias("a"), F.sum(F.conv(F.substring(row, 13, 12), 16, 10).cast("decimal(38,0)")).alias("b"))
    return total.select(F.sha2(F.concat_ws("|", "n", "a", "b"), 256).alias("h")).first().h[:16]


def thin(rows: DataFrame, sample_hz: float | None, tolerance_s: float = 1.0 / 256) -> DataFrame:
    """All rows that are not grid samples alone, and those grid samples (``kinds``, ``t_s``) that a rate keeps."""
    if sample_hz is None:
        return rows
    k = F.col("t_s") * sample_hz
    return rows.where(F.exists("kinds", lambda x: x != "grid") | (F.abs(k - F.round(k)) / sample_hz <= tolerance_s))


def build_dataset(rows: DataFrame, split_of: DataFrame, base: str, *, order: Sequence[str], categories: Sequence[str], numbers: Sequence[str], shard_size: int = 50_000,
                  key: str = "match_key", where: Column | None = None, first_id: int = 2, min_count: int = 1, layout: Sequence[str] = ()) -> DataFrame:
    """Build the dataset at ``base`` from flat ``rows`` and return its index.

    ``split_of`` maps ``key`` to a split (others are left out); ``where`` keeps tiers, maps or
    rates.  Vocabulary ids (``<category>_id``; 0 for unseen, null too) and the mean and
    deviation of ``numbers`` come from the train split alone.  Rows are numbered per split in
    ``order``; every ``shard_size`` of them make a shard, the last one has the rest.  Nothing is
    written if ``base`` is in use, a shard size is below one or no train row is left.
    """
    spark = rows.sparkSession
    if shard_size < 1:
        raise ValueError("shard_size must be 1 or more")
    if exists(spark, base):
        raise FileExistsError(f"{base} is in use; a new dataset takes a new folder")
    clash = set(rows.columns) & ({"split", "shard", "place"} | {f"{c}_id" for c in categories})
    if clash:
        raise ValueError(f"columns of the dataset itself: {sorted(clash)}")
    split_of = settled(split_of)  # joined and hashed
    chosen = rows if where is None else rows.where(where)
    chosen = durable(chosen.join(split_of.where(F.col("split").isin(*SPLITS)).select(key, "split").distinct(), key))
    train = chosen.where("split = 'train'")
    if train.isEmpty():
        raise ValueError("no row of the train split")
    vocab = durable(fit_vocab(train, categories, first_id, min_count)) if categories else None
    coded = to_ids(chosen, vocab, categories) if categories else chosen
    placed = numbered(coded, ["split"], order, "place").withColumn("shard", F.floor(F.col("place") / shard_size).cast("int"))
    norm = durable(P.norm_stats(train, numbers))
    marks = {
        "layout_hash": P.layout_hash(placed.select(*layout) if layout else placed.drop("place")), "split_hash": fingerprint(split_of, [key, "split"]),
        "vocab_hash": fingerprint(vocab, ["field", "value", "id"]) if vocab is not None else "", "norm_hash": fingerprint(norm, ["feature", "mean", "std"]),
    }
    # a shard is one sorted file: its rows are as many as fit one task by choice of the size
    placed.repartition("split", "shard").sortWithinPartitions("split", "shard", "place").write.mode("errorifexists").partitionBy("split", "shard").parquet(f"{base}/shards")
    if vocab is not None:
        vocab.write.mode("errorifexists").parquet(f"{base}/vocab")
    norm.write.mode("errorifexists").parquet(f"{base}/norm")
    done = spark.read.parquet(f"{base}/shards")
    ends = [F.struct(*order).alias("_o")]
    index = done.select("split", "shard", *ends).groupBy("split", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("first"), F.max("_o").alias("last"))
    index.withColumns({k: F.lit(v) for k, v in marks.items()}).coalesce(1).write.mode("errorifexists").parquet(f"{base}/index")
    return spark.read.parquet(f"{base}/index")


def read_dataset(spark: SparkSession, base: str, split: str | None = None, **expected: str) -> DataFrame:
    """Shards of a dataset; ``expected`` marks (``layout_hash``, ``vocab_hash``, ``norm_hash``, ``split_hash``) must be those of the index."""
    index = spark.read.parquet(f"{base}/index")
    if split is not None:
        index = index.where(F.col("split") == split)
        if index.isEmpty():
            raise ValueError(f"no split {split!r} in {base}")
    foreign = reduce(lambda a, b: a | b, [~F.col(k).eqNullSafe(F.lit(v)) for k, v in expected.items()], F.lit(False))
    wrong = index.where(foreign).select(*expected).limit(1).collect()
    if wrong:
        raise ValueError(f"{base} was built with {wrong[0].asDict()}, not {expected}")
    rows = spark.read.parquet(f"{base}/shards")
    return rows if split is None else rows.where(F.col("split") == split)


def take(rows: DataFrame, split: str, start: int, count: int, shard_size: int) -> DataFrame:
    """Rows ``start`` to ``start + count`` of a split, read from the shards that hold them."""
    low, high = start // shard_size, (start + count - 1) // shard_size
    return rows.where((F.col("split") == split) & F.col("shard").between(low, high) & F.col("place").between(start, start + count - 1))
