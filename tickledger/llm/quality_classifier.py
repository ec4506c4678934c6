"""Quality classifier with hierarchical empirical Bayes.

A document's own evidence comes from two logistic models (good quality, toxic) over shape
measures and telling words, fitted on a bounded sample of labelled rows.  Its surroundings
speak through posteriors: the mean probability of its host is shrunk toward the global one,
that of its path (here: a language of a host) toward its host's, each as strongly as the
spread between and within groups says.  The document itself is left out of its groups.
The odds of the path replace the global ones in the document's odds.

Scoring is row by row on the JVM.  Groups are counted by partial aggregation and meet the
documents as a small table; texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEND_BOUND, plan_bytes, query, read, written

#: Labelled rows that the models are fitted on, about; drawn by a hash of the id.
SAMPLE = 20_000
#: Telling words that the models know at most: those whose share of bad rows is farthest from the average.
VOCABULARY = 2_000
#: Labelled rows with a telling word at least, and how many standard errors off it must be.
WORD_ROWS, WORD_Z = 5, 4.0
#: Letters of the beginnings that count beside whole words.
STARTS = (4, 5, 7)
HEADS = ("quality", "toxic")
SHAPES = ("_symbols", "_capitals", "_digits", "_distinct", "_length")


def featured(docs: DataFrame) -> DataFrame:
    """``docs`` with the distinct lower-case words, and their beginnings, in ``_words``, and the shape measures.

    A beginning stands once for every distinct word that has it.  A null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.length(text) + F.lit(1.0)

    def share(letters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, letters, ""))) / size

    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    rows = docs.withColumns({"_all": words, "_symbols": share("#*$%&|<>!"), "_capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "_digits": share("0123456789"), "_length": F.log(size)})
    rows = rows.withColumn("_own", F.array_distinct("_all"))
    starts = [F.transform(F.filter("_own", longer(k)), start(k)) for k in STARTS]
    rows = rows.withColumn("_words", F.concat("_own", *starts))
    return rows.withColumn("_distinct", F.size("_own") / (F.size("_all") + F.lit(1.0))).drop("_all", "_own")


def longer(k: int) -> Callable[[Column], Column]:
    return lambda w: F.length(w) > k


def start(k: int) -> Callable[[Column], Column]:
    return lambda w: F.concat(F.substring(w, 1, k), F.lit("~"))


@dataclass
class Evidence:
    """The fitted document classifier: ``score`` adds the log odds ``_quality`` and ``_toxic``."""

    words: list[str]
    heads: dict[str, LogisticRegressionModel | None]
    rates: dict[str, float]

    def score(self, docs: DataFrame) -> DataFrame:
        names = docs.columns
        rows = vectors(self.words).transform(featured(docs))
        for head in HEADS:
            model = self.heads[head]
            if model is None:  # one class only: the odds of the rate
                rows = rows.withColumn(f"_{head}", F.lit(odds(self.rates[head])))
            else:
                rows = model.transform(rows).withColumn(f"_{head}", vector_to_array(f"_raw_{head}")[1])
        return rows.select(*[F.col(f"`{c}`") for c in names], *[f"_{h}" for h in HEADS])


def odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def vectors(words: list[str]) -> Transformer:
    count = CountVectorizerModel.from_vocabulary(words or ["\0"], inputCol="_words", outputCol="_counts")
    return PipelineModel([count, VectorAssembler(inputCols=["_counts", *SHAPES], outputCol="_features")])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    """Fit both heads on about ``sample`` labelled rows (``doc_id, quality, toxic``; null labels are left out)."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = known.count()
    scale = 1 << 30
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(scale)) < int(scale * min(1.0, sample / max(n, 1))))
    picked = written(picked.select(F.col("doc_id").alias("_id"), *HEADS))
    text = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).drop("_id")
    rows = written(featured(text))
    total = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(h), F.lit(0.5 if h == "quality" else 0.0)).alias(h) for h in HEADS]).first()
    rates = {h: total[h] for h in HEADS}

    def off(head: str) -> Column:
        p = rates[head]
        return F.abs(F.col(head) - F.col("n") * p) / F.sqrt(F.col("n") * max(p * (1 - p), 1e-9))

    terms = rows.select(F.explode(F.array_distinct("_words")).alias("word"), *HEADS).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in HEADS]).where(F.col("n") >= WORD_ROWS)
    terms = terms.withColumn("z", F.greatest(*[off(h) for h in HEADS])).where(F.col("z") >= WORD_Z)
    words = sorted(r.word for r in terms.orderBy(F.desc("z"), "word").limit(VOCABULARY).collect())
    data = written(vectors(words).transform(rows).select("_features", *[F.col(h).cast("double").alias(h) for h in HEADS]))
    heads: dict[str, LogisticRegressionModel | None] = {}
    for h in HEADS:
        fitted = None
        if total.n and 0 < rates[h] < 1:
            fitted = LogisticRegression(featuresCol="_features", labelCol=h, rawPredictionCol=f"_raw_{h}", probabilityCol=f"_prob_{h}", predictionCol=f"_pred_{h}", regParam=1e-4, maxIter=100).fit(data)
        heads[h] = fitted
    return Evidence(words, heads, rates)


def site_keys() -> tuple[Column, Column]:
    """Host and path of a document: its source, and its language there; nulls are keys of their own."""
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), F.coalesce(F.concat(F.lit("s"), "lang"), F.lit("n"))


def sites(scored: DataFrame) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """Sums per host and path, and per head the global mean and the strengths of the two priors.

    The strength of a prior is the variance within groups over that between them (analysis
    of variance), so that groups that do not differ are shrunk altogether.
    """
    host, path = site_keys()
    p = {h: F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(f"_{h}"))) for h in HEADS}
    sums = [F.sum(p[h]).alias(f"s_{h}") for h in HEADS] + [F.sum(p[h] * p[h]).alias(f"q_{h}") for h in HEADS]
    paths = written(scored.groupBy(host.alias("_host"), path.alias("_path")).agg(F.count("*").alias("n"), *sums))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), *[F.sum(f"{k}_{h}").alias(f"h{k}_{h}") for h in HEADS for k in "sq"])
    both = written(paths.join(hosts, "_host"))
    one = hosts.agg(
        F.count("*").alias("k"), F.sum("hn").alias("n"), F.sum(F.col("hn") * F.col("hn")).alias("nn"),
        *[F.sum(f"hs_{h}").alias(f"s_{h}") for h in HEADS], *[F.sum(F.col(f"hs_{h}") ** 2 / F.col("hn")).alias(f"b_{h}") for h in HEADS], *[F.sum(f"hq_{h}").alias(f"q_{h}") for h in HEADS],
    ).first()
    two = both.agg(F.count("*").alias("k"), F.sum(F.col("n") * F.col("n") / F.col("hn")).alias("nn"), *[F.sum(F.col(f"s_{h}") ** 2 / F.col("n")).alias(f"b_{h}") for h in HEADS]).first()
    out = {}
    for h in HEADS:
        if not one.n:
            out[h] = {"mean": 0.5, "host": 1.0, "path": 1.0}
            continue
        mean = one[f"s_{h}"] / one.n
        ss = {"host": one[f"b_{h}"] - one.n * mean * mean, "path": two[f"b_{h}"] - one[f"b_{h}"]}
        inside = max(one[f"q_{h}"] - two[f"b_{h}"], 1e-12) / max(one.n - two.k, 1)
        free = {"host": one.k - 1, "path": two.k - one.k}
        size = {"host": one.n - one.nn / one.n, "path": one.n - two.nn}
        k = {}
        for level in ("host", "path"):
            between = (ss[level] - free[level] * inside) / size[level] if size[level] > 0 and free[level] > 0 else 0.0
            k[level] = min(max(inside / between, 1.0), 1e9) if between > 0 else 1e9
        out[h] = {"mean": mean, **k}
    return both, out


def judged(scored: DataFrame, groups: DataFrame, priors: dict[str, dict[str, float]]) -> DataFrame:
    """``scored`` with ``p_quality, p_toxic, site_quality, site_toxic, kept``.

    The table of groups has a row per host and path; it is sent to the tasks while it is small.
    """
    host, path = site_keys()
    names = [c for c in scored.columns if not c.startswith("_")]
    side = groups.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in groups.columns if not c.startswith("_")])
    side = F.broadcast(side) if plan_bytes(groups) <= SEND_BOUND else side
    rows = scored.withColumn("_host", host).withColumn("_path", path).join(side, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")), "left")

    def logit(p: Column) -> Column:
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
        return F.log(p / (F.lit(1.0) - p))

    for h in HEADS:
        prior = priors[h]
        own = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(f"_{h}")))
        by_host = (F.col(f"_g_hs_{h}") - own + prior["host"] * prior["mean"]) / (F.col("_g_hn") - 1 + prior["host"])
        by_path = (F.col(f"_g_s_{h}") - own + prior["path"] * by_host) / (F.col("_g_n") - 1 + prior["path"])
        rows = rows.withColumn(f"_site_{h}", by_path)
        rows = rows.withColumn(f"_p_{h}", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col(f"_{h}") + logit(F.col(f"_site_{h}")) - odds(prior["mean"])))))
    kept = (F.col("_p_quality") >= 0.5) & (F.col("_p_toxic") < 0.5)
    return rows.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"_{k}_{h}").alias(f"{k}_{h}") for k in ("p", "site") for h in HEADS], kept.alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, p_quality, p_toxic, site_quality, site_toxic, kept`` of every row of ``docs``.

    Without labels, or with one class only, a head says its rate for every row (no labels:
    0.5 for quality, which keeps; 0 for toxic).  Null texts count as empty, null sources and
    languages are groups of their own, repeated rows are judged alike, an empty table gives no
    rows, further columns are not read.
    """
    evidence = fit(docs, labels, sample)
    scored = written(evidence.score(docs.select("doc_id", "source", "lang", "text")).drop("text"))
    groups, priors = sites(scored)
    return judged(scored, groups, priors).drop("source", "lang")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps; texts are scored twice, once for the groups, and not shuffled."""
    evidence = fit(docs, labels, sample)
    groups, priors = sites(evidence.score(docs.select("source", "lang", "text")))
    names = docs.columns
    hidden = docs.select(*[F.col(f"`{c}`").alias(c if c in ("source", "lang", "text") else f"c{i}") for i, c in enumerate(names)])
    rows = judged(evidence.score(hidden), groups, priors).where("kept")
    return rows.select(*[F.col(c if c in ("source", "lang", "text") else f"c{i}").alias(c) for i, c in enumerate(names)])


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
