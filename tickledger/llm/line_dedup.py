"""Line dedup by distinct-site spread.

A line that many sites carry is boilerplate.  Each line is a 64-bit hash; a HyperLogLog
sketch of the sites is built per hash and merged by aggregation, so that a line found in a
third of all rows is one small sketch per task before the shuffle.  Sketches far above the
threshold decide by themselves, those within the sketch's error of it are counted exactly.
Boilerplate is taken out of every document but the first that bears it, so that nothing is
lost altogether.

Copies of a whole text say nothing about a line: of equal texts only the one with the least
id is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEND_BOUND, plan_bytes, query, read, written

#: Sites that make a line boilerplate.
SITES = 5
#: log2 of the sketch's registers; its relative error is 1.04 / sqrt(2 ** LG_K), and four of them are the margin.
LG_K = 12
#: Found lines (bytes as written) that are sent to every task; some 16 bytes each.
LINES_BOUND = 4 << 20
MARGIN = 4 * 1.04 / 2 ** (LG_K / 2)


def line_hashes(text: Column) -> Column:
    """Hashes of the lines of a text, null for a line without a word; lines are compared without outer white space."""
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.transform(trimmed, lambda x: F.when(x != "", F.xxhash64(x)))


def site_of(source: Column) -> Column:
    """A null site is a site of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``line, first``: hashes of lines on at least ``sites`` distinct sites, and the least id that bears each."""
    rows = docs.select("doc_id", site_of(F.col("source")).alias("site"), F.xxhash64("text").alias("whole"), "text").where("text is not null")
    one = rows.groupBy("whole").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    copies = written(one.select("whole", "least"))
    hashed = rows.select("doc_id", "site", "whole", F.array_compact(line_hashes(F.col("text"))).alias("lines"))
    copy = copies.select(F.col("whole").alias("_w"), "least")
    copy = F.broadcast(copy) if plan_bytes(copies) <= SEND_BOUND else copy
    alone = hashed.join(copy, F.col("whole") == F.col("_w"), "left").where("least is null or least <=> doc_id")
    lines = alone.select("doc_id", "site", F.explode("lines").alias("line"))
    spread = lines.groupBy("line").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("first"))
    guess = spread.where(F.col("n") >= sites).withColumn("about", F.hll_sketch_estimate("sketch")).drop("sketch", "n")
    guess = written(guess.where(F.col("about") >= sites * (1 - MARGIN) - 1))
    sure = F.col("about") > sites * (1 + MARGIN) + 1
    near = guess.where(~sure).select("line")
    near = F.broadcast(near) if plan_bytes(guess) <= SEND_BOUND else near
    exact = lines.join(near, "line", "left_semi").select("line", "site").distinct().groupBy("line").count().where(F.col("count") >= sites).select("line")
    return written(guess.where(sure).select("line", "first").unionByName(guess.join(exact, "line").select("line", "first")))


def _cut(doc_id: object, text: str, hashes: list, first: dict[int, object]) -> tuple[str, int]:
    lines = text.split("\n")
    keep = [x for x, h in zip(lines, hashes, strict=True) if h is None or h not in first or first[h] == doc_id]
    return "\n".join(keep), len(lines) - len(keep)


def strip_lines(docs: DataFrame, found: DataFrame, count: str = "_removed") -> DataFrame:
    """``docs`` with ``text`` cut and ``count`` (lines removed) added.

    While the found lines fit in ``LINES_BOUND`` they are sent to the tasks and every text is
    cut where it lies.  Beyond that the hashed lines of each text meet them by a shuffle, and
    only the places to cut come back.
    """
    names = [c for c in docs.columns if c != count]
    if plan_bytes(found) <= LINES_BOUND:
        first = {r.line: r.first for r in found.collect()}
        sent = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for b in batches:
                texts, counts = [], []
                at = b.schema.get_field_index("text")
                for d, t, h in zip(b.column(b.schema.get_field_index("doc_id")), b.column(at), b.column(b.num_columns - 1), strict=True):
                    t, h = t.as_py(), h.as_py()
                    text, n = (t, 0) if t is None or known.keys().isdisjoint(h) else _cut(d.as_py(), t, h, known)
                    texts.append(text)
                    counts.append(n)
                cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], [*names, count])

        plain = docs.select(*[F.col(f"`{c}`") for c in names])
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
        return plain.withColumn("__line_hashes", line_hashes(F.col("text"))).mapInArrow(run, f"{fields}, {count} long")
    place = docs.select("doc_id", F.xxhash64("text").alias("whole"), F.posexplode(line_hashes(F.col("text"))).alias("at", "line")).join(found, "line").where("not (first <=> doc_id)")
    cuts = place.groupBy(F.col("doc_id").alias("__line_d"), F.col("whole").alias("__line_w")).agg(F.collect_set("at").alias("__line_cuts"))
    rows = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col("__line_d")) & (F.xxhash64("text") == F.col("__line_w")), "left")
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.array_contains("__line_cuts", i), F.lit(False)))
    text = F.when(F.col("__line_cuts").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names], F.coalesce(F.size("__line_cuts"), F.lit(0)).cast("long").alias(count))


def dedup_lines(docs: DataFrame, sites: int = SITES, count: str = "_removed") -> DataFrame:
    """Every row of ``docs`` with its text freed of boilerplate lines; ``count`` counts them.

    A null text stays null, an empty one empty.  A line that repeats inside its first
    document stays there each time; rows with the same id count as one document.  If no
    bearer of a line has an id, it goes everywhere.  An empty table gives no rows; further
    columns pass through (one named like ``count`` gives way).
    """
    return strip_lines(docs, boilerplate(docs, sites), count)


def freed(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """The rows of ``docs`` with their texts freed of boilerplate; a text of which no word is left goes altogether."""
    rows = dedup_lines(docs, sites, own := "__lines_removed")
    return rows.where((F.col(own) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in docs.columns])


OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM d),
t AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM l),
u AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
b AS (SELECT k, min(doc_id) AS first FROM t JOIN u USING (text) WHERE k <> '' AND doc_id = least GROUP BY k HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {SITES}),
x AS (SELECT t.*, b.k IS NOT NULL AND b.first <> doc_id AS cut FROM t LEFT JOIN b ON b.k = t.k),
g AS (SELECT r, count(*) FILTER (cut) AS n, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '') AS kept FROM x GROUP BY r)
SELECT doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE g.kept END AS text FROM d LEFT JOIN g USING (r)
"""


@query("op10_line_dedup", OP10_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    docs = docs.withColumn("n_lines", F.when(F.col("text").isNotNull(), F.col("n_lines")))
    return dedup_lines(docs).select("doc_id", "n_lines", F.col("_removed").alias("n_removed"), "text")
