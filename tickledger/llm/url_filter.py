"""URL filters: explicit rules first, then association rules mined by FP-growth.

The urls whose labels are known are transactions of url tokens plus one item for a bad
label.  FP-growth finds the frequent combinations; rules that lead to the bad item are kept
if their confidence and support suffice and no shorter rule says the same.  To match a url,
an inverted index files each rule under its rarest token: a url looks up its own tokens and
checks only the rules found there.  All steps are DataFrame and SQL operations.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, read, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label:bad"
#: fixed values: host/path rules and their verdicts
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Rules are tried one by one on each url; a larger list has to be a table of learnt rules.
RULE_BOUND = 1000
#: A learnt rule holds for at least this share and number of the labelled urls, and with this confidence.
SUPPORT, SUPPORT_ROWS, CONFIDENCE = 0.002, 5, 0.8


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Host after the first ``://``, A-Z lower-cased."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path of the url, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as ``(length, rule, verdict)``, or null."""
    if len(rules) > RULE_BOUND:
        raise ValueError(f"more than {RULE_BOUND} explicit rules")
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        fit = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits, none)))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, its last two together, path words, query keys, scheme.

    Segments of digits alone name one page and give no token.
    """
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(path, r"[/._-]+"), lambda x: (x != "") & ~x.rlike(r"^\d+$"))
    keys = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    scheme = F.when(F.instr(url, "://") > 0, F.array(F.concat(F.lit("s:"), F.substring_index(url, "://", 1)))).otherwise(F.array())
    parts = [
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array()),
        F.transform(words, lambda x: F.concat(F.lit("p:"), x)),
        F.transform(keys, lambda x: F.concat(F.lit("q:"), x)),
        scheme,
    ]
    return F.array_distinct(F.concat(*[F.coalesce(p.cast("array<string>"), F.array().cast("array<string>")) for p in parts]))


def matched(rows: DataFrame, rules: DataFrame, row: str) -> DataFrame:
    """``row, rule_id`` where all ``items`` of a rule are among the ``tokens`` of the row, by the index on ``key``."""
    posts = rows.select(row, "tokens", F.explode("tokens").alias("key"))
    hit = posts.join(rules.select("rule_id", "items", "key"), "key")
    return hit.where(F.size(F.array_except("items", "tokens")) == 0).select(row, "rule_id")


def mine(labelled: DataFrame, support: float = SUPPORT, support_rows: int = SUPPORT_ROWS, confidence: float = CONFIDENCE) -> DataFrame:
    """``rule_id, items, key, confidence, n`` learnt from ``tokens, bad``; no labelled rows give no rules."""
    n = labelled.count()
    empty = labelled.sparkSession.createDataFrame([], "rule_id string, items array<string>, key string, confidence double, n long")
    if n == 0:
        return empty
    least = max(support, support_rows / n)
    seen = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    known = written(seen.where(F.col("n") >= least * n))
    kept = labelled.withColumn("row", F.monotonically_increasing_id())
    kept = written(kept)
    some = kept.select("row", F.explode("tokens").alias("token")).join(known, "token", "left_semi").groupBy("row").agg(F.collect_set("token").alias("tokens"))
    baskets = kept.select("row", "bad").join(some, "row", "left").select(F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("items"), "confidence", F.round(F.col("support") * n).cast("long").alias("n"))
    found = found.withColumn("rule_id", F.array_join("items", " "))
    each = found.select("rule_id", F.explode("items").alias("token")).join(known, "token")
    rarest = each.groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("key"))
    rules = written(found.join(rarest, "rule_id").select("rule_id", "items", "key", "confidence", "n"))
    inner = matched(rules.select(F.col("rule_id").alias("outer"), F.col("items").alias("tokens")), rules, "outer").where("outer <> rule_id")
    return written(rules.join(inner.select(F.col("outer").alias("rule_id")).distinct(), "rule_id", "left_anti"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, **mining: float) -> DataFrame:
    """``page_id, host, path, rule, verdict, learnt`` of every page.

    ``labels`` (``doc_id, quality, toxic``) belong to the page whose url ends its path in the
    document's number; quality 0 or toxic 1 is bad.  The longest explicit rule decides; else a
    url is blocked if a learnt rule matches (``learnt`` names the most confident) and allowed
    if none does.  A null or malformed url has an empty host and path and is allowed.
    Repeated pages stay, empty tables give no rows or no learnt rules, other columns are not
    read.
    """
    rows = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    doc = F.expr("try_cast(regexp_extract(path, '/([0-9]+)(/|[.][A-Za-z]+)?$', 1) as long)")
    rows = rows.select("page_id", "host", "path", best_rule(F.col("host"), F.col("path"), rules).alias("best"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), doc.alias("doc"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    known = labels.select(F.col("doc_id").alias("doc"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad")).groupBy("doc").agg(F.max("bad").alias("bad"))
    learnt = mine(rows.join(known, "doc").select("tokens", "bad"), **mining)
    open_rows = rows.where("best is null")
    hit = matched(open_rows, learnt, "row").join(learnt.select("rule_id", "confidence"), "rule_id").groupBy("row").agg(F.max_by("rule_id", F.struct("confidence", "rule_id")).alias("learnt"))
    out = rows.join(hit, "row", "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("learnt").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "learnt")


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
