"""Registry tables: matches, processed ids, runs, scores and usage, as merges of DataFrames.

Each merge returns the new content of the table; the caller writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..functions.exprs import id_forms, nan_null

STATUSES = ["downloaded", "parsed", "built", "analyzed", "failed", "quarantined"]


def register_matches(new: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Insert new matches: returns ``(to insert, processed ids, conflicts)``.

    A key with two content hashes is a conflict, whether the other one is stored or comes
    with an earlier new row.  A hash that is stored under
    another key, or comes twice, keeps the earlier row; the later id is only marked processed.
    """
    # the earliest new row of a key stands for it
    lead = new.groupBy("match_key").agg(F.min(F.struct("created_at", F.col("demo_sha256").alias("h"))).alias("_k")).select("match_key", F.col("_k.h").alias("_lead"))
    stored = matches.select("match_key", F.col("demo_sha256").alias("_old"), F.lit(True).alias("_in"))
    old = lead.join(stored, "match_key", "full").select("match_key", F.when(F.col("_in"), F.col("_old")).otherwise(F.col("_lead")).alias("_old"))
    n = new.join(old, "match_key", "left").withColumn("_known", F.col("_old").isNotNull())
    clash = n.where(F.col("_known") & F.col("demo_sha256").isNotNull() & (F.col("demo_sha256") != F.col("_old")))
    fresh = n.join(matches.select("match_key"), "match_key", "left_anti")
    owned = matches.where("demo_sha256 is not null").select("demo_sha256")
    # one row per hash (the earliest), one per key
    first = fresh.where("demo_sha256 is not null").groupBy("demo_sha256").agg(F.min(F.struct("created_at", "match_key")).alias("_f"))
    keep = fresh.join(owned, "demo_sha256", "left_anti").join(first, "demo_sha256", "left")
    keep = keep.where(F.col("_f").isNull() | (F.col("_f.match_key") == F.col("match_key")))
    keep = keep.where(F.col("demo_sha256").eqNullSafe(F.col("_old"))).dropDuplicates(["match_key"])
    insert = keep.withColumn("status", F.coalesce("status", F.lit("downloaded"))).drop("_old", "_known", "_f")
    done = n.join(clash.select("match_key"), "match_key", "left_anti").select(F.col("match_key").alias("match_id"), "map").distinct()
    return insert.select(new.columns), done, clash.select("match_key", "demo_sha256", F.col("_old").alias("stored_sha256"))


def set_status(matches: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply ``(match_key, status, reason)``; the reason is cleared unless given."""
    u = updates.select("match_key", F.col("status").alias("_s"), F.col("reason").alias("_r"))
    u = u.withColumn("_s", F.when(F.col("_s").isin(*STATUSES), F.col("_s")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.col("_s")))))
    out = matches.join(u, "match_key", "left")
    hit = F.col("_s").isNotNull()
    return out.withColumns({"status": F.coalesce("_s", "status"), "quarantine_reason": F.when(hit, F.col("_r")).otherwise(F.col("quarantine_reason"))}).drop("_s", "_r")


def upsert_runs(runs: DataFrame, new: DataFrame, key: str = "run_id") -> DataFrame:
    """Insert or update runs; a null never replaces a stored value."""
    cols = [c for c in runs.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") if c in new.columns else F.lit(None).cast(runs.schema[c].dataType).alias(f"_n_{c}") for c in cols])
    return runs.join(n, key, "full").select(key, *[F.coalesce(f"_n_{c}", c).alias(c) for c in cols])


def replace_scores(scores: DataFrame, new: DataFrame) -> DataFrame:
    """Scores with every (match, run) of the new rows replaced as a whole."""
    groups = new.select("match_key", "run_id").distinct()
    return scores.join(groups, ["match_key", "run_id"], "left_anti").unionByName(new.select(scores.columns))


def write_scores(new: DataFrame, path: str) -> None:
    """Write scores by run and match; only the partitions present in ``new`` are replaced."""
    bad = [c for c in new.columns if c not in [f.name for f in schemas.struct_of(schemas.SCORED_DDL).fields]]
    if bad:
        raise ValueError(f"unknown score columns: {bad}")
    ok = new.withColumns({c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"score row without {c}"))) for c in ("action_id", "match_key", "run_id")})
    ok.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "match_key").parquet(path)


def unprocessed(ids: DataFrame, processed: DataFrame, column: str = "match_id") -> DataFrame:
    """Ids of which neither spelling is processed; a stored first map never blocks a later one."""
    forms = ids.select(column, F.explode(id_forms(F.col(column))).alias("_f")).join(processed.select(F.col("match_id").alias("_f")), "_f", "left_semi")
    return ids.join(forms.select(column).distinct(), column, "left_anti")


def processed_with_prefix(processed: DataFrame, prefix: str) -> DataFrame:
    return processed.where(F.col("match_id").startswith(prefix))


def missing_outputs(wanted: DataFrame, done: DataFrame, key: str = "match_key") -> DataFrame:
    """Matches whose output does not exist yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def get_match(matches: DataFrame, match_key: str) -> DataFrame:
    return matches.where(F.col("match_key") == match_key)


def match_for_hash(matches: DataFrame, sha: str) -> DataFrame:
    return matches.where(F.col("demo_sha256") == sha).select("match_key")


def list_matches(matches: DataFrame) -> DataFrame:
    return matches.orderBy("match_key")


def list_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy("run_id")


def usage_rows(runs: DataFrame) -> DataFrame:
    """Usage lines: required keys present, NaN as null, warnings as a count, text redacted."""
    need = ["run_id", "map_version", "tier", "timings", "warnings", "conservation_residual"]
    missing = [c for c in need if c not in runs.columns]
    if missing:
        raise ValueError(f"usage record missing {missing}")
    out = runs
    for f in runs.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array" and f.name == "warnings":
            out = out.withColumn(f.name, F.size(f.name))
        elif kind in ("double", "float"):
            out = out.withColumn(f.name, nan_null(F.col(f.name)))
        elif kind == "string":
            out = out.withColumn(f.name, text.redact_log(F.col(f.name)))
        elif kind == "map":
            out = out.withColumn(f.name, F.transform_values(f.name, lambda k, v: F.when(~F.isnan(v), v)))
    return out if "ts" in out.columns else out.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def append_json(df: DataFrame, path: str) -> None:
    """Append lines to a JSON log (usage, failures)."""
    df.write.mode("append").json(path)


def read_usage(spark, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Usage lines and the count of malformed ones."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    r = raw.withColumn("_r", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r._corrupt").isNotNull() | ~F.trim("value").startswith("{")
    return r.where(~bad).select("_r.*").drop("_corrupt"), r.agg(F.count_if(bad).alias("n_malformed"))


def failure_rows(results: DataFrame) -> DataFrame:
    """Failed matches as redacted log rows."""
    f = results.where(F.col("status") == "failed")
    return f.select("match_key", text.redact_log(F.col("error")).alias("error"), "error_type", "attempts")
