"""Quality rules as a ledger of failure bits.

``ledger`` measures every text once and keeps the measurements with one bit per failed
rule.  A policy is a named, versioned set of rules, that is a bit mask: applying another
policy or leaving a rule out needs no second look at the texts, only ``mask & policy``.
Everything is row by row; nothing is shuffled but the one row of ``ablation``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, query, read

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words")

#: Name and failing condition of each rule; the place in the list is its bit and never changes.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("shouting", "2 * n_upper_words > n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: a document is kept if none of the policy's rules fails.
POLICIES = {
    "base-1": BIT["few_words"] | BIT["repeated_words"],
    "prose-1": sum(BIT.values()),
}


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    raw = text.encode()
    words = raw.split()  # bytes split at the six ASCII white-space characters only
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    seen: dict[bytes, int] = {}
    again = 0
    if n > 3:
        at = np.fromiter(map(seen.setdefault, words, range(n)), np.int64, n)
        pairs = np.unique(at[:-1] * n + at[1:], return_inverse=True)[1]
        _, window, times = np.unique(pairs[:-1].astype(np.int64) * n + at[2:], return_inverse=True, return_counts=True)
        hit = times[window] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + n - 2] |= hit
        again = int(covered.sum())
    return (
        n,
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        again,
        sum(map(bytes.isupper, words)),
    )


def measurements(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py() or "") for t in b.column(1)]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *MEASURES])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements and ``failed``, the bits of the failed rules.

    A null or empty text fails ``few_words`` alone (ratios over no words do not fail).
    Repeated rows stay, an empty table gives none, further columns are not read.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    return measurements(docs, doc_id, text).withColumn("failed", reduce(Column.bitwiseOR, bits).cast("long"))


def apply_policy(rows: DataFrame, policy: str | int) -> DataFrame:
    """``kept``: no rule of the policy (a name of ``POLICIES`` or a mask) failed."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask)) == 0)


def ablation(rows: DataFrame, policy: str | int) -> DataFrame:
    """One row per rule of the policy: rows that fail it, rows that fail nothing else, rows kept without it.

    A single aggregation over the ledger; on an empty ledger all counts are 0.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    used = [(n, b) for n, b in BIT.items() if b & mask]
    one = rows.agg(
        F.count_if(hit == 0).alias("kept"),
        *[F.count_if(hit.bitwiseAND(F.lit(b)) != 0).alias(f"f_{n}") for n, b in used],
        *[F.count_if(hit == b).alias(f"o_{n}") for n, b in used],
    )
    cells = [F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only"), (F.col("kept") + F.col(f"o_{n}")).alias("n_kept_without")) for n, _ in used]
    return one.select(F.inline(F.array(*cells)))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM m),
g AS (SELECT r, i, w, lead(w, 1) OVER p AS a, lead(w, 2) OVER p AS b FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, a, b) AS n FROM g WHERE b IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY r),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_upper_words
  FROM m LEFT JOIN rep USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
         | CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END | CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
         | CASE WHEN 2 * n_upper_words > n_words THEN 16 ELSE 0 END
         | CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed
  FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept,
       n_lines, n_upper_words, failed FROM b
"""


@query("op9_quality_rules", OP9_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(read(spark, sf_dir, "documents")), "prose-1")
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base-1"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "n_upper_words", "failed")
