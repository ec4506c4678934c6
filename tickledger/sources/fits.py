"""Stored fits: versions of tables and models with their metrics, and a pointer to the adopted one.

A store is a folder.  ``<kind>/v=<n>/fit`` is the fit itself (a Parquet table, or a saved ML
model), ``<kind>/v=<n>/note`` one row about it: layout, metrics and whether it is a model.
Adoptions are rows of ``<kind>/adopted`` that are only ever added; the last one holds.  A
version is never written twice: two writers that pick the same number cannot both succeed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.splits import layout_hash

NOTE = "kind string, version int, layout string, is_model boolean, metrics map<string,double>"
STATUS = ("adopted", "rejected")


class NotAdopted(ValueError):
    """A fit that is asked for is not the adopted one, or none is."""


class FitStore:
    """Versions of the fits in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def notes(self, kind: str) -> DataFrame:
        """One row per version of a kind."""
        return self._read(f"{self.base}/{kind}/v=*/note", NOTE)

    def _next(self, kind: str) -> int:
        return (self.notes(kind).agg(F.max("version").alias("v")).first().v or 0) + 1

    def _note(self, kind: str, version: int, layout: str, is_model: bool, metrics: dict[str, float]) -> None:
        row = self.spark.createDataFrame([(kind, version, layout, is_model, {k: float(v) for k, v in metrics.items()})], NOTE)
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.base}/{kind}/v={version}/note")

    def put_table(self, kind: str, fit: DataFrame, metrics: dict[str, float] | None = None) -> int:
        """Store a fitted table; its version.  The layout is that of its columns."""
        version = self._next(kind)
        fit.write.mode("errorifexists").parquet(f"{self.base}/{kind}/v={version}/fit")
        self._note(kind, version, layout_hash(fit), False, metrics or {})
        return version

    def put_model(self, kind: str, model: PipelineModel, inputs: DataFrame, metrics: dict[str, float] | None = None) -> int:
        """Store a fitted model for rows of the layout of ``inputs``; its version."""
        version = self._next(kind)
        model.write().save(f"{self.base}/{kind}/v={version}/fit")
        self._note(kind, version, layout_hash(inputs), True, metrics or {})
        return version

    def adopt(self, kind: str, version: int, status: str = "adopted") -> None:
        """Make a stored version the one in use, or take it out of use."""
        if status not in STATUS:
            raise ValueError(f"status {status!r} is not one of {STATUS}")
        if self.notes(kind).where(F.col("version") == version).isEmpty():
            raise ValueError(f"{kind} has no version {version}")
        log = self._read(f"{self.base}/{kind}/adopted", "seq int, version int, status string")
        seq = (log.agg(F.max("seq").alias("s")).first().s or 0) + 1
        self.spark.createDataFrame([(seq, version, status)], "seq int, version int, status string").coalesce(1).write.mode("append").parquet(f"{self.base}/{kind}/adopted")

    def adopted(self, kind: str) -> int | None:
        """The version in use: that of the last adoption which was not taken back."""
        log = self._read(f"{self.base}/{kind}/adopted", "seq int, version int, status string")
        last = log.groupBy("version").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq")).where("status = 'adopted'")
        row = last.agg(F.max_by("version", "seq").alias("v")).first()
        return row.v

    def models(self, *kinds: str) -> DataFrame:
        """``kind, version, layout, is_model, metrics, in_use`` of all versions of some kinds."""
        return reduce(DataFrame.unionByName, [self.notes(k).withColumn("in_use", F.col("version").eqNullSafe(F.lit(self.adopted(k)))) for k in kinds])

    def _known(self, kind: str, version: int | None, layout: str | None) -> tuple[int, bool]:
        version = version if version is not None else self.adopted(kind)
        if version is None:
            raise NotAdopted(f"no version of {kind} is adopted")
        note = self.notes(kind).where(F.col("version") == version).first()
        if note is None:
            raise ValueError(f"{kind} has no version {version}")
        if layout is not None and note.layout != layout:
            raise ValueError(f"{kind} version {version} has layout {note.layout}, not {layout}")
        return version, note.is_model

    def table(self, kind: str, version: int | None = None, layout: str | None = None) -> DataFrame:
        """A stored table: the adopted version, or the one named; a foreign layout is refused."""
        version, _ = self._known(kind, version, layout)
        return self.spark.read.parquet(f"{self.base}/{kind}/v={version}/fit")

    def model(self, kind: str, version: int | None = None, inputs: DataFrame | None = None) -> PipelineModel:
        """A stored model for rows of the layout of ``inputs``."""
        version, is_model = self._known(kind, version, layout_hash(inputs) if inputs is not None else None)
        if not is_model:
            raise ValueError(f"{kind} version {version} is a table")
        return PipelineModel.load(f"{self.base}/{kind}/v={version}/fit")
