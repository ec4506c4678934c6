"""Reading, conforming and checking raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.ids import sha16

INTS = {"byte": 1, "short": 2, "integer": 4, "long": 8}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of a table in order, cast softly; a missing column is a typed null.  Known optional columns stay."""
    fields = list(schemas.table_schema(table).fields)
    if table in schemas.OPTIONAL_COLUMNS:
        fields += [f for f in schemas.struct_of(schemas.OPTIONAL_COLUMNS[table]).fields if f.name in df.columns]

    def one(f: T.StructField) -> Column:
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        have = df.schema[f.name].dataType
        nested = isinstance(have, (T.ArrayType, T.StructType)) or isinstance(f.dataType, T.ArrayType)
        return (F.col(f.name).cast(f.dataType) if nested else F.col(f.name).try_cast(f.dataType)).alias(f.name)

    return df.select(*[one(f) for f in fields])


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Raw tables of a folder (``<folder>/<table>``); a missing optional table is empty, a missing required one an error."""
    out = {}
    for t in schemas.RAW_DDL:
        if t in names:
            out[t] = conform(spark.read.parquet(f"{folder}/{t}"), t)
        elif t in schemas.OPTIONAL_TABLES:
            out[t] = schemas.empty(spark, t)
        else:
            raise ValueError(f"required table {t!r} is missing")
    return out


def castable(df: DataFrame, column: str, target: T.DataType) -> Column:
    """Aggregate: can a column be stored as ``target`` without loss?  Integers fit by range, numbers widen,
    text stays text; text never becomes a number and a fraction never an integer."""
    have, want = df.schema[column].dataType.typeName(), target.typeName()
    if have == want or have == "void":
        return F.lit(True)
    if have in INTS and want in INTS:
        c = F.col(column)
        return F.count_if(c.isNotNull() & c.try_cast(target).isNull()) == 0
    if (have in INTS or have in ("float", "double")) and want in ("float", "double"):
        return F.lit(True)
    if have == "array" and want == "array":
        return F.lit(df.schema[column].dataType.elementType.typeName() in ("void", target.elementType.typeName()))
    return F.lit(False)


def validate(df: DataFrame, table: str) -> DataFrame:
    """Problems of a raw table in one pass: missing columns, columns that cannot be cast, nulls where none may be."""
    fields = schemas.table_schema(table).fields
    missing = [f.name for f in fields if f.name not in df.columns]
    have = [f for f in fields if f.name in df.columns]
    never = [c for c in schemas.NOT_NULL.get(table, []) if c in df.columns]
    checks = [castable(df, f.name, f.dataType).alias(f"c_{f.name}") for f in have] + [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in never]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *checks)
    msgs = [F.lit(f"{table}.{c}: missing") for c in missing]
    msgs += [F.when(~F.col(f"c_{f.name}"), F.lit(f"{table}.{f.name}: not castable to {f.dataType.simpleString()}")) for f in have]
    msgs += [F.when(F.col(f"n_{c}") > 0, F.concat(F.lit(f"{table}.{c}: "), F.col(f"n_{c}").cast("string"), F.lit(" nulls"))) for c in never]
    return row.select(F.explode(F.array_compact(F.array(*msgs))).alias("problem"))


def meta_problems(meta: DataFrame) -> DataFrame:
    """Matches whose metadata lacks a positive tick rate or a map."""
    bad = F.array_compact(F.array(F.when(~F.coalesce(F.col("tick_rate") > 0, F.lit(False)), F.lit("tick_rate")), F.when(F.coalesce("map", F.lit("")) == "", F.lit("map"))))
    return meta.select("match_key", F.explode(bad).alias("problem"))


def all_null_columns(df: DataFrame, table: str) -> DataFrame:
    """``table.column`` of every column without a value."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(f"{table}.{c}").alias("field"), F.col(c).alias("n")) for c in df.columns])
    return counts.select(F.explode(pairs).alias("_x")).where("_x.n = 0").select("_x.field")


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings file with its required header; blank rows are skipped."""
    schema = "match_key string, map string, steamid64 string, player_name string, hltv_rating string"
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.na.drop("all").where(F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in df.columns]).isNotNull())


def match_from_path(path: Column) -> dict[str, Column]:
    """Map, month and stable id of a match file from its path."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z.]+$", "")
    grab = lambda p: F.nullif(F.regexp_extract(path, p, 1), F.lit(""))
    clean = F.regexp_replace(F.lower(base), r"[^a-z0-9._@-]+", "-")
    return {"map": grab(r"(de_[a-z0-9]+)"), "month": grab(r"(\d{4}-(?:0[1-9]|1[0-2]))"), "match_id": F.concat(clean, F.lit("-"), F.substring(sha16(path), 1, 8))}


def read_callouts(spark: SparkSession, path: str, map_version: str) -> DataFrame:
    """Callout polygons of a map as the rows ``attach_callouts`` takes; the file is a list or holds one under ``callouts``."""
    item = "array<struct<name:string,polygons:array<array<array<double>>>,z_min:double,z_max:double>>"
    raw = spark.read.text(path, wholetext=True)
    lst = F.from_json(F.coalesce(F.get_json_object("value", "$.callouts"), F.col("value")), item)
    c = raw.select(F.posexplode(lst).alias("pos", "c")).select("pos", "c.*")
    c = c.select("pos", F.col("name").alias("callout"), "z_min", "z_max", F.posexplode("polygons").alias("i", "poly"))
    pts = F.transform("poly", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return c.select(F.lit(map_version).alias("map_version"), "pos", "callout", (F.col("pos") * 1000 + F.col("i")).alias("poly_id"), "z_min", "z_max", pts.alias("points"))
