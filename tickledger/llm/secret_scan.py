"""Secret scans with corpus-wide ownership frequency.

Spans of candidate secrets are found by the engine's own regular expressions: the pieces
between matches and the matches themselves give every position, without Python.  The
hashes of the candidate values are then counted over the whole corpus by distinct owners
(``source``) and repositories (``source`` and ``lang``): a value that many owners share is
a copied example, one that few owners have looks live.  Unlabelled tokens are reported only
if they look live.

The texts are read once.  Counting goes over distinct (hash, owner, repository) first, so
that a value copied into a third of all rows is a handful of rows before any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, read, written

# fixed values: the kinds in order of rank, their patterns, the group of the value and its least length
KINDS: list[tuple[str, str, int, int]] = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),  # shorter runs would be dropped, so they are not matched at all
]
#: The method's own kind: a long run of token characters that mixes digits and both cases.
OWNED = ("owned", "[A-Za-z0-9+/_-]{20,}", 0, 20)
#: A value seen with so many owners is a copied example.
EXAMPLE_OWNERS = 3

SPANS = "array<struct<kind:string,rank:int,start:bigint,end:bigint,hash:string>>"


def found(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Array of spans of one kind: code-point positions of the matches, the value's hash."""
    whole, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), value.alias("value"))
    none = F.array().cast(SPANS)
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        end = at + x["size"]
        span = F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), at.alias("start"), end.alias("end"), F.sha2(x["value"], 256).alias("hash"))
        return F.struct(F.coalesce(end, at).alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(none)


def candidates(docs: DataFrame, extra: tuple[str, str, int, int] = OWNED) -> DataFrame:
    """``doc_id, owner, repo, base, more`` of every row: arrays of spans, base kinds and the method's own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[found(text, k, i, p, g, n) for i, (k, p, g, n) in enumerate(KINDS)])
    kind, pattern, group, least = extra
    mixed = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]"))
    own = F.when(F.size(mixed) > 0, found(text, kind, len(KINDS), pattern, group, least)).otherwise(F.array().cast(SPANS))
    own = F.filter(own, lambda s: F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).rlike("^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"))
    rows = docs.select("doc_id", F.col("source").alias("owner"), F.struct("source", "lang").alias("repo"), base.alias("base"), own.alias("own"))
    free = F.filter("own", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select("doc_id", "owner", "repo", "base", free.alias("more"))


def ownership(rows: DataFrame, owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``hash, n_owners, n_repos, example`` of every candidate value in the corpus (nulls count as one owner)."""
    owner, repo = F.struct("owner"), F.struct("repo")
    seen = rows.select(owner.alias("owner"), repo.alias("repo"), F.explode(F.concat("base", "more")).alias("s")).select(F.col("s.hash").alias("hash"), "owner", "repo")
    pairs = seen.distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos")).withColumn("example", F.col("n_owners") >= owners)


def of_rank(rank: int) -> Callable[[Column], Column]:
    return lambda s: s["rank"] == rank


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Spans of secrets of every row, with how many look live and how many are copied examples.

    ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples``.  Base
    spans always stay; of the method's own spans only those that look live are added.  A
    null text counts as empty; repeated rows stay and are one owner; a null source is an
    owner of its own; an empty table gives no rows; other columns are not read.
    """
    rows = written(candidates(docs).withColumn("row", F.monotonically_increasing_id()))
    some = rows.where((F.size("base") > 0) | (F.size("more") > 0))
    known = written(ownership(some, owners))
    each = some.select("row", F.explode(F.concat("base", "more")).alias("s")).join(known.select(F.col("hash").alias("h"), "example"), F.col("s.hash") == F.col("h"))
    kept = each.where((F.col("s.rank") < len(KINDS)) | ~F.col("example"))
    judged = kept.groupBy("row").agg(F.collect_list("s").alias("all"), F.count_if(~F.col("example")).alias("n_live"), F.count_if(F.col("example")).alias("n_examples"))
    none, zero = F.array().cast(SPANS), F.lit(0).cast("long")
    full = some.join(judged, "row", "left").select("doc_id", "base", F.coalesce("all", none).alias("all"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_examples", zero).alias("n_examples"))
    empty = rows.where((F.size("base") == 0) & (F.size("more") == 0)).select("doc_id", "base", none.alias("all"), zero.alias("n_live"), zero.alias("n_examples"))
    counts = [F.size(F.filter("base", of_rank(i))).cast("long").alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS)]
    return full.unionByName(empty).select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "n_live", "n_examples")


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
    SELECT r, '{kind}' AS kind, {rank} AS rank, base_at + gap AS s, base_at + gap + size AS e, value FROM (
      SELECT r, unnest(list_transform(pieces[1:len(m)], lambda x: len(x))) AS gap, unnest(list_transform(m, lambda x: len(x))) AS size, unnest(v) AS value,
             unnest(list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(pieces[1:i - 1], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))) AS base_at
      FROM (SELECT r, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS v FROM d)
      WHERE len(m) > 0) WHERE len(value) >= {least}"""


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
base AS ({' UNION ALL '.join(_spans_sql(k, i, p, g, n) for i, (k, p, g, n) in enumerate(KINDS))}),
own AS (SELECT * FROM ({_spans_sql(OWNED[0], len(KINDS), *OWNED[1:])}) AS o WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')
        AND NOT EXISTS (SELECT 1 FROM base AS b WHERE b.r = o.r AND b.s < o.e AND o.s < b.e)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM own),
known AS (SELECT value, count(DISTINCT coalesce('s' || source, 'n')) >= {EXAMPLE_OWNERS} AS example FROM spans JOIN d USING (r) GROUP BY value),
b AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS t FROM base GROUP BY r),
a AS (SELECT r, count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_examples,
             string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS t FROM spans JOIN known USING (value) WHERE rank < {len(KINDS)} OR NOT example GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.t, '')) AS base_sha256, coalesce(a.t, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)
"""


@query("op8_secret_scan", OP8_SQL)
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
