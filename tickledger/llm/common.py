"""What the corpus operators share: tables, the shared folder, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of code points outside space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when it can be written as SQL, its check."""

    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return deco


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of a local session that names none; made when it is first asked for.
_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without the setting gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return _own_folder[0]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: the lineage ends there and its size is known to later joins."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Size of a written table as the optimizer knows it (bytes of its files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes and rows of a batch of texts on its way between the JVM and Python; both sides hold several at a time.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session stay within ``BATCH_BYTES`` (plus one row) and ``BATCH_ROWS``; lower settings stay."""
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        now = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}").strip().lower())
        if not now or not 0 < int(now[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[now[2]] <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from fn(b)

    return df.mapInArrow(run, schema)


#: Ids or rows of at most this many bytes (as written) are sent to every task; beyond it the sides meet by a shuffle.
SEND_BOUND = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` (a written table), marked to be sent to the tasks if its size allows."""
    return F.broadcast(df) if plan_bytes(df) <= SEND_BOUND else df


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is in the written table ``ids``."""
    return docs.join(small(ids.select(F.col("doc_id").alias("__join_id"))), F.col("doc_id") == F.col("__join_id"), "left_semi")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is null or not in the written table ``ids``."""
    return docs.join(small(ids.select(F.col("doc_id").alias("__join_id"))), F.col("doc_id") == F.col("__join_id"), "left_anti")
