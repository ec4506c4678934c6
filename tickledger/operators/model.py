"""Win probability and helper heads as MLlib models on flat state vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dataset import feature_names, flatten
from .feed import ROUND
from .scan import history

TERMINAL_WEIGHT = 2.0


def _inputs(features: list[str]) -> list:
    filled = [f"{c}_f" for c in features]
    return [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features")]


def weighted(flat: DataFrame, label: str) -> DataFrame:
    """Labelled rows with terminal ones weighted double."""
    w = F.when(F.array_contains("kinds", "terminal"), TERMINAL_WEIGHT).otherwise(1.0)
    return flat.where(F.col(label).isNotNull()).withColumns({"label": F.col(label).cast("double"), "weight": w})


def train_win(flat: DataFrame, label: str = "y_round_won_ct", max_iter: int = 20, validation: str | None = None) -> PipelineModel:
    """Boosted trees for the round's outcome; ``validation`` names a boolean column for early stopping."""
    rows = weighted(flat, label)
    feats = [c for c in feature_names(flat) if c not in (validation,)]
    some = rows.agg(*[F.count(c).alias(c) for c in feats]).first()
    feats = [c for c in feats if some[c]]
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter, maxDepth=4, seed=1337)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[*_inputs(feats), gbt]).fit(rows)


def scorer(model: PipelineModel):
    """A scorer for wide states: adds ``W``.  The state travels with its features, so nothing is joined back."""

    def run(states: DataFrame) -> DataFrame:
        plain = states.drop("W")
        flat = flatten(plain.withColumn("_state", F.struct(*[F.col(f"`{c}`") for c in plain.columns])))
        return model.transform(flat).select("_state.*", vector_to_array("probability")[1].alias("W"))

    return run


#: What a history says of a feature: its mean, its weighted mean (recent ticks weigh more), its change and its length.
PAST = ("mean", "recent", "change", "n")


def past_features(hist: Column, half_life: float, prefix: str) -> dict[str, Column]:
    """Features of a history (``array<struct<tick,value>>``, itself last); unknown values are passed over."""
    known = F.filter(hist, lambda x: x["value"].isNotNull())
    last = F.element_at(hist, -1)["tick"]
    total = lambda f: F.aggregate(known, F.lit(0.0), lambda m, x: m + f(x))
    value, weight = (lambda x: x["value"].cast("double")), (lambda x: 1.0 / (1.0 + (last - x["tick"]) / F.lit(half_life)))
    return {
        f"{prefix}_mean": F.try_divide(total(value), F.size(known)), f"{prefix}_recent": F.try_divide(total(lambda x: value(x) * weight(x)), total(weight)),
        f"{prefix}_change": F.try_element_at(known, F.lit(-1))["value"].cast("double") - F.try_element_at(known, F.lit(1))["value"].cast("double"), f"{prefix}_n": F.size(hist).cast("double"),
    }


def with_past(flat: DataFrame, features: list[str], window_ticks: int, half_life: float, width: int) -> DataFrame:
    """Flat rows with the history features of some of their columns.

    The history is the factual one: an edited state is scored with the past of the state that
    it edits, so build it on the factual rows and carry the columns over.
    """
    packed = flat.withColumn("_now", F.struct(*[F.col(c).cast("double").alias(c) for c in features]))
    rows = history(packed, ROUND, "tick", "_now", window_ticks, width, "_past")
    cols: dict[str, Column] = {}
    for c in features:
        cols |= past_features(F.transform("_past", lambda x, c=c: F.struct(x["tick"].alias("tick"), x["value"][c].alias("value"))), half_life, f"past_{c}")
    return rows.withColumns(cols).drop("_now", "_past")


def sequence_scorer(model: PipelineModel, past: DataFrame, features: list[str]):
    """A scorer that reads the factual history of each state: ``past`` has the round, the tick and the history features."""
    names = [f"past_{c}_{p}" for c in features for p in PAST]

    def run(states: DataFrame) -> DataFrame:
        plain = states.drop("W")
        flat = flatten(plain.withColumn("_state", F.struct(*[F.col(f"`{c}`") for c in plain.columns])))
        both = flat.join(past.select(*ROUND, "tick", *names), [*ROUND, "tick"], "left")
        return model.transform(both).select("_state.*", vector_to_array("probability")[1].alias("W"))

    return run


def train_head(rows: DataFrame, features: list[str], label: str, max_iter: int = 10) -> PipelineModel:
    """A helper head (death within 5 s per player row, plant or defuse within 15 s)."""
    r = rows.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double"))
    return Pipeline(stages=[*_inputs(features), GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=3, seed=1337)]).fit(r)


def hazard(players: DataFrame, model: PipelineModel) -> DataFrame:
    """Death probability per player row; a dead player has exactly 0."""
    p = model.transform(players).withColumn("hazard", vector_to_array("probability")[1])
    return p.withColumn("hazard", F.when(F.col("alive") == 1, F.col("hazard")).otherwise(0.0)).drop("features", "probability", "rawPrediction", "prediction")


def train_q(rows: DataFrame, features: list[str], label: str = "V", huber: bool = False) -> PipelineModel:
    """Regression of the value of an action on its inputs (Q: state and action, B: state only)."""
    reg = LinearRegression(featuresCol="features", labelCol=label, loss="huber", maxIter=50) if huber else GBTRegressor(featuresCol="features", labelCol=label, maxIter=20, maxDepth=4, seed=1337)
    return Pipeline(stages=[*_inputs(features), reg]).fit(rows)


def predict_value(rows: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    out = model.transform(rows).withColumn(name, F.col("prediction"))
    return out.select(*rows.columns, name)


def side_bits(side):
    """1 for CT, 0 for T; any other side fails the job."""
    return F.when(side == "ct", 1.0).when(side == "t", 0.0).otherwise(F.raise_error(F.lit("unknown side")))
