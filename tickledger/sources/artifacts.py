"""Partitioned artifacts: states, actions, windows, datasets, manifests and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.exprs import nan_null

KINDS = ["states", "actions", "windows"]
SAFE, MONTH = r"^[A-Za-z0-9._@-]+$", r"^\d{4}-(0[1-9]|1[0-2])$"


def _safe(c: str, pattern: str) -> Column:
    ok = F.col(c).rlike(pattern) & ~F.col(c).isin(".", "..")
    return F.when(ok, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"unsafe {c}: "), F.coalesce(c, F.lit("null")))))


def write_artifact(df: DataFrame, kind: str, base: str, mode: str = "overwrite") -> None:
    """Write rows under ``<base>/<kind>/map_version=/month=``; unsafe names are refused.

    Rows carry map_version, month and match_key.  Only the partitions present are replaced.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; expected one of {KINDS}")
    out = df.withColumns({"map_version": _safe("map_version", SAFE), "month": _safe("month", MONTH), "match_key": _safe("match_key", SAFE)})
    order = [c for c in ("match_key", "round_num", "tick") if c in df.columns]
    out = out.repartition("map_version", "month", "match_key").sortWithinPartitions("map_version", "month", *order)
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("map_version", "month").parquet(f"{base}/{kind}")


def read_artifact(spark: SparkSession, kind: str, base: str, map_version: str | None = None, month: str | None = None) -> DataFrame:
    """Rows of a kind, pruned to a map version and month."""
    df = spark.read.parquet(f"{base}/{kind}")
    if map_version is not None:
        df = df.where(F.col("map_version") == map_version)
    return df if month is None else df.where(F.col("month") == month)


def check_states(df: DataFrame) -> DataFrame:
    """States of the version this code reads; other rows fail the job."""
    v = F.when(F.col("schema_version") == schemas.SCHEMA_VERSION, F.col("schema_version")).otherwise(F.raise_error(F.lit("unknown schema_version")))
    return df.withColumn("schema_version", v)


def label_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("y_")]


def sort_actions(df: DataFrame) -> DataFrame:
    """Actions in output order inside each partition: round, tick, kind, type, id."""
    rank = F.create_map(*[F.lit(x) for kv in schemas.KIND_RANK.items() for x in kv])
    t = F.coalesce("tick", "window_start_tick", F.lit(-1))
    return df.sortWithinPartitions("match_key", "round_num", t, F.try_element_at(rank, F.col("kind")), "type", "action_id")


def manifest(spark: SparkSession, folder: str, previous: DataFrame | None = None) -> DataFrame:
    """Name, size, time and sha256 of each parquet file; a file with the recorded size and time keeps its hash."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(folder)
    here = f.select(F.col("path").alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
    if previous is None:
        return f.select(F.col("path").alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))
    kept = here.join(previous, ["name", "bytes", "mtime"])
    todo = f.join(kept.select(F.col("name").alias("path")), "path", "left_anti")
    fresh = todo.select(F.col("path").alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))
    return kept.select("name", "bytes", "mtime", "sha256").unionByName(fresh)


def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """sha256 of every file of a folder."""
    return spark.read.format("binaryFile").load(folder).select("path", F.sha2("content", 256).alias("sha256"))


def disk_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes per first directory under a folder, from the listing alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    rel = F.regexp_extract("path", r".*?" + folder.rstrip("/").split("/")[-1] + r"/([^/]+)", 1)
    return f.groupBy(rel.alias("directory")).agg(F.sum("length").alias("bytes"))


def catalog(states: DataFrame, actions: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per match: rows, distinct rounds, actions, tier and versions."""
    key = ["map_version", "month", "match_key"]
    s = states.groupBy(*key).agg(F.count(F.lit(1)).alias("n_states"), F.countDistinct("round_num").alias("n_rounds"), F.max("schema_version").alias("schema_version"))
    a = actions.groupBy(*key).agg(F.count(F.lit(1)).alias("n_actions"))
    return s.join(a, key, "left").join(matches.select("match_key", "tier"), "match_key", "left")


def write_shards(df: DataFrame, path: str, shard_size: int) -> None:
    """Dataset shards of a fixed size; an existing output is an error."""
    df.write.mode("errorifexists").option("maxRecordsPerFile", shard_size).parquet(path)


def read_shards(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Shards of one layout; a foreign layout fails the job."""
    df = spark.read.parquet(path)
    ok = F.when(F.col("layout_hash") == layout, F.col("layout_hash")).otherwise(F.raise_error(F.lit("foreign layout")))
    return df.withColumn("layout_hash", ok)


def scored_sink(df: DataFrame, run_id: str) -> DataFrame:
    """Scored actions in the sink's columns: NaN as null, panel and components as JSON."""
    out = df.withColumn("run_id", F.lit(run_id))
    cols = []
    for f in schemas.struct_of(schemas.SCORED_DDL).fields:
        if f.name not in out.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        kind = out.schema[f.name].dataType.typeName()
        c = F.col(f.name)
        if kind in ("struct", "array") and f.dataType.typeName() == "string":
            c = F.to_json(c)
        elif kind in ("double", "float"):
            c = nan_null(c)
        cols.append(c.cast(f.dataType).alias(f.name))
    return out.select(*cols)
