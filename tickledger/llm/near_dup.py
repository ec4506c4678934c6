"""MinHash near-duplicates by one-permutation hashing.

A text's shingles are hashed once; the least hash of each of ``BINS`` ranges makes the
signature, and an empty range borrows from a filled one in an order of its own (optimal
densification).  Texts with equal shingle sets collapse to one representative.  The others
meet in buckets of banded signatures, where each member is paired with the bucket's centre
only (a star), so that pairs grow with members.  Pairs are confirmed on the full sets.

Stars alone would lose a link between two members of which neither is the centre's
neighbour.  So buckets that still hold several components are looked at again.  In a small
bucket the pairs from different components whose signatures are within noise of the
threshold go to the confirmation.  In a larger one the full sets of the members meet inside
tasks, in blocks of bounded size; no pair leaves a task but the links that join components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, query, read, without, written

#: Bands of the signature and bins in each: at a similarity of 0.85 a pair shares no band with a chance of 7e-9.
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Words whose hash a Python worker remembers before it starts anew.
MEMO = 200_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Words(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (wraps around)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, known: Words, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; fewer words make one shingle, none make none."""
    words = text.encode().lower().split()  # bytes: A-Z are lowered, the six ASCII white-space characters split
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(width, n)
    x = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        x = scramble(x + h[k : n - size + 1 + k] * _MULT[k % len(_MULT)])
    return np.unique(x)


def donors() -> np.ndarray:
    """For each bin, all bins in an order of its own: where an empty bin looks for a value."""
    return np.stack([np.random.default_rng(1000 + i).permutation(BINS) for i in range(BINS)])


def signature(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One permutation: the least hash of each bin; an empty bin takes that of the first filled bin in its order."""
    at = ((shingles >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(at.astype(np.int64), prepend=-1))
    sig, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    sig[at[first]] = shingles[first]
    filled[at[first]] = True
    if len(first) < BINS:
        empty = np.flatnonzero(~filled)
        pick = filled[order[empty]].argmax(axis=1)
        sig[empty] = sig[order[empty, pick]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = sig.reshape(BANDS, ROWS)
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        x = scramble(x + rows[:, k] * _MULT[k % len(_MULT)])
    return x.view(np.int64)


def signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n, key, bands, sig``: size and hash of the set, band keys, the low 16 bits of the signature.

    Sets so small that only an equal set can reach ``percent`` have no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, order = Words(), donors()
        for b in batches:
            sizes, keys, bands, sigs = [], [], [], []
            for t in b.column(1):
                x = shingle_set(t.as_py() or "", known, width)
                n = len(x)
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(x.tobytes()) if n else None)
                if 100 * n >= percent * (n + 1):
                    sig = signature(x, order)
                    bands.append(band_keys(sig))
                    sigs.append(sig.astype(np.uint16).tobytes())
                else:
                    bands.append(None)
                    sigs.append(None)
            cols = [b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "key", "bands", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, key binary, bands array<long>, sig binary")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, set`` with the set as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            sets = [shingle_set(t.as_py() or "", known, width).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` with 100 * intersection >= percent * union on the full sets.

    A centre with many pairs is copied to as many salts as it has thousands of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                low, high = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * low >= percent * high else 0
                keep.append(100 * both >= percent * (low + high - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    salts = F.ceil(F.col("count") / 1000).cast("int")
    many = pairs.groupBy("a").count().withColumn("salts", salts).select("a", "salts")
    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")).join(many, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    rows = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    rows = rows.join(left, ["a", "salt"]).join(right, "b").select("a", "b", "set_a", "set_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: every node of the links ``a, b`` and the least node it reaches.

    Alternating stars: the larger neighbours of a node, then the smaller ones, are linked to
    the least one, until nothing changes.  No neighbourhood is gathered; every step is a
    minimum per node and a join, written to the shared folder.
    """
    edges = written(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        large = written(large)
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").unionByName(small.select("v", F.col("m").alias("u"))).distinct()
        edges = written(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


#: Members up to which a bucket gives pairs; in larger ones sets meet, in blocks of so many members.
FEW, BLOCK = 8, 512
#: Shingles that a task multiplies at once.
COLUMNS = 8192


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], settle: Callable[[pa.Table], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """``settle`` on each run of rows with equal ``keys``, also where a run spans batches; its pairs as ``a, b``."""
    left = None

    def cut(t: pa.Table) -> list[int]:
        change = np.zeros(t.num_rows - 1, bool)
        for c in keys:
            change |= np.diff(t.column(c).to_numpy()) != 0
        return [0, *(np.flatnonzero(change) + 1).tolist(), t.num_rows]

    def out(t: pa.Table, ends: list[int]) -> pa.RecordBatch:
        found = {x for i, j in zip(ends[:-1], ends[1:], strict=True) if j - i > 1 for x in settle(t.slice(i, j - i))}
        return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if left is None else pa.concat_tables([left, t]).combine_chunks()
        ends = cut(t)
        yield out(t, ends[:-1])
        left = t.slice(ends[-2])
    if left is not None:
        yield out(left, [0, left.num_rows])


def close_pairs(members: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of small buckets (``h, rep, comp``), of different components, whose signatures agree almost as often as the threshold asks.

    The margin is 4.7 standard deviations of the agreement at the threshold.
    """
    s = percent / 100
    least = math.ceil(BINS * (s - 4.7 * math.sqrt(s * (1 - s) / BINS)))

    def settle(t: pa.Table) -> list[tuple[int, int]]:
        rep, comp = t.column("rep").to_numpy(), t.column("comp").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(rep), BINS)
        hit = ((sig[:, None] == sig[None]).sum(axis=2) >= least) & (comp[:, None] != comp[None])
        return [(min(x, y), max(x, y)) for x, y in zip(*(rep[i] for i in np.nonzero(np.triu(hit, 1))), strict=True)]

    rows = members.select("h", "rep", "comp").join(sigs, "rep").repartition("h").sortWithinPartitions("h")
    return rows.select("h", "rep", "comp", "sig").mapInArrow(lambda batches: by_group(batches, ["h"], settle), "a long, b long").distinct()


def joining(rep: np.ndarray, comp: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Of the linked pairs (a matrix), as many as it takes to join their components."""
    root = {c: c for c in comp.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    x, y = np.nonzero(np.triu(linked, 1))
    _, first = np.unique(np.stack([comp[x], comp[y]]), axis=1, return_index=True)
    out = []
    for i in first:
        p, q = find(int(comp[x[i]])), find(int(comp[y[i]]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((min(rep[x[i]], rep[y[i]]), max(rep[x[i]], rep[y[i]])))
    return out


def set_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join components of larger buckets (``h, rep, comp, n``), decided on the full sets.

    A bucket is cut in blocks, and every two blocks meet in a task of their own.  All
    intersections of two blocks come from one product of their incidence matrices.
    """

    def settle(t: pa.Table) -> list[tuple[int, int]]:
        rep, comp, own = (t.column(c).to_numpy() for c in ("rep", "comp", "own"))
        parts = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        size = np.array([len(x) for x in parts])
        _, col, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(rep)), size)
        shared = times > 1
        col, row = (np.cumsum(shared) - 1)[col[shared[col]]], row[shared[col]]
        order = np.argsort(col, kind="stable")
        col, row = col[order], row[order]
        both = np.zeros((len(rep), len(rep)), np.float32)
        for start in range(0, int(shared.sum()), COLUMNS):
            i, j = np.searchsorted(col, [start, start + COLUMNS])
            m = np.zeros((len(rep), COLUMNS), np.float32)
            m[row[i:j], col[i:j] - start] = 1
            both += m @ m.T
        linked = (100 * both >= percent * (size[:, None] + size[None] - both)) & (comp[:, None] != comp[None])
        if t.column("p")[0] != t.column("q")[0]:
            linked &= own[:, None] != own[None]
        return joining(rep, comp, linked)

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("h", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rep", "comp", "own")
    rows = rows.join(sets.select(F.col("doc_id").alias("rep"), "set"), "rep").repartition("h", "p", "q").sortWithinPartitions("h", "p", "q")
    return rows.select("h", "p", "q", "rep", "comp", "own", "set").mapInArrow(lambda batches: by_group(batches, ["h", "p", "q"], settle), "a long, b long").distinct()


def groups(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (integer ``doc_id``, ``text``).

    ``component_id`` is the least id that is reached over confirmed links, ``kept`` marks the
    rows that bear it.  A text without words has size 0 and stands alone; a null id is linked
    with nothing, has no component and is kept.  Rows that repeat an id and its text repeat
    in the result.  An empty table gives no rows, other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(signed(docs, width, percent))
    same = written(rows.where("doc_id is not null and key is not null").groupBy("key").agg(F.min("doc_id").alias("rep")))
    reps = rows.where("bands is not null").join(same.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi")
    reps = written(reps.select(F.col("doc_id").alias("rep"), "bands", "sig").dropDuplicates(["rep"]))
    spread = reps.select("rep", F.explode("bands").alias("h"))
    full = spread.groupBy("h").agg(F.min("rep").alias("centre"), F.count("*").alias("n")).where("n > 1")
    met = written(spread.join(full, "h"))
    sets = written(shingle_sets(among(docs, written(met.select(F.col("rep").alias("doc_id")).distinct())), width).dropDuplicates(["doc_id"]))

    stars = met.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(confirmed(written(stars), sets, percent))
    roots = written(components(links))
    comp = F.coalesce("root", "rep")
    seen = met.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("h", "rep", "n", comp.alias("comp"))
    mixed = seen.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h")
    open_ = written(seen.join(mixed, "h", "left_semi"))
    pairs = written(close_pairs(open_.where(F.col("n") <= FEW), reps.select("rep", "sig"), percent))
    extra = written(confirmed(pairs, sets, percent).unionByName(set_links(open_.where(F.col("n") > FEW), sets, percent)))
    if not extra.isEmpty():
        roots = written(components(links.unionByName(extra)))

    named = rows.select("doc_id", "n", "key").join(same, "key", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with one document of each group of near-duplicates left."""
    gone = groups(docs, width, percent).where(~F.col("kept")).select("doc_id").distinct()
    return without(docs, written(gone))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM d),
e AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n AS n, count(*) AS k FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (m + n - k)),
sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id AS v, doc_id AS u FROM s UNION SELECT sym.b, c.u FROM c JOIN sym ON sym.a = c.v),
m AS (SELECT v, min(u) AS u FROM c GROUP BY v)
SELECT s.doc_id, len(x)::BIGINT AS n_shingles, m.u AS component_id, s.doc_id = m.u AS kept FROM s JOIN m ON m.v = s.doc_id
"""


@query("op7_near_dup", OP7_SQL)
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"), 3, 85)
