"""Substring dedup by level-wise doubling.

Windows of words are looked at level by level, each level at most twice as long as the one
before (9, 18 and 35 words for windows of 35).  At the first level every window is a
candidate; windows that repeat at one length alone are extended to the next, so a text
without repeats is read once and done with.  With ``beyond`` the doubling goes on past the
window until no candidates survive, which gives the longest level at which a text repeats.

A level is one pass.  Tasks hash the candidate windows of a block of texts, keep one of each
hash that repeats inside the block (so a window found in a third of all rows leaves a block
once), and deal the hashes out to buckets as packed arrays.  A bucket sees all that share a
hash and answers with one bit per entry, in the order in which they came; the answers of a
block meet again and become bit sets of its texts.  Below the last level hashes are 32 bits
inside a bucket: a chance match only makes one candidate more.  At the last one they have
128 bits.  The number of buckets follows the number of candidates, so a bucket's memory does
not grow with the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, read, small, written
from .words import Words, blocks, joined, windows

WINDOW = 35
#: Words of the shortest first level.
LEAST = 8
#: Candidates that a bucket holds on average, and the least number of buckets.
BUCKET, BUCKETS = 1 << 20, 16
_SALTS = 0, 0x2545F4914F6CDD1D

PARTS = pa.schema([("block", pa.binary()), ("part", pa.int32()), ("entries", pa.binary()), ("many", pa.binary()), ("k1", pa.list_(pa.int64())), ("k2", pa.list_(pa.int64())), ("wins", pa.list_(pa.int64())), ("mask", pa.binary()), ("codes", pa.binary())])
PARTS_DDL = "block binary, part int, entries binary, many binary, k1 array<long>, k2 array<long>, wins array<long>, mask binary, codes binary"
FOUND_DDL = "k1 long, k2 long, n long, bits binary"


def levels(window: int) -> list[int]:
    """Window lengths from the first level to ``window``, each at most twice the one before."""
    out = [window]
    while (out[0] + 1) // 2 >= LEAST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a 128-bit key of their text: equal texts have equal windows, hence equal answers."""
    return docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("again"), F.col("text")).alias("k2"), "text")


def _bits(of: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(of, np.uint8), count=n).astype(bool)


def _code(buckets: int) -> np.dtype:
    """The least type that holds a bucket's number; its largest value stands for "repeats inside the block"."""
    return np.min_scalar_type(buckets)


def ask(rows: DataFrame, length: int, before: int | None, buckets: int, exact: bool) -> DataFrame:
    """Packed hashes of the candidates, one row per block and bucket, and one row per block on how to read the answers.

    ``rows`` has ``k1, k2, text`` and, after the first level, ``bits``: the windows of ``before`` words that repeat.
    """
    kind = _code(buckets)
    here = np.iinfo(kind).max

    def block(b: pa.RecordBatch, place: tuple[int, int]) -> list[dict]:
        words = Words(b.column(2))
        wins = np.maximum(words.counts() - length + 1, 0)
        total = int(wins.sum())
        if total == 0:
            return []
        h = words.hashes()
        whole = words.left()[: max(0, len(h) - length + 1)] >= length
        mask = np.ones(total, bool)
        if before is not None:
            ends = np.cumsum(wins)
            for i, bits in enumerate(b.column(3).to_pylist()):
                old = _bits(bits, max(0, int(words.counts()[i]) - before + 1))
                mask[ends[i] - wins[i] : ends[i]] = old[: wins[i]] & old[length - before :] if wins[i] else False
        x = windows(h, length, _SALTS[0])[whole][mask]
        if len(x) == 0:
            return []
        order = np.argsort(x, kind="stable")
        s = x[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        first = order[new]
        many = np.zeros(len(x), bool)
        many[first] = np.diff(np.append(np.flatnonzero(new), len(x))) > 1
        part = ((x >> np.uint64(32)) % np.uint64(buckets)).astype(kind)
        codes = np.full(len(x), here, kind)
        codes[first] = part[first]
        first.sort()
        first = first[np.argsort(part[first], kind="stable")]
        cut = np.flatnonzero(np.diff(part[first])) + 1
        y = windows(h, length, _SALTS[1])[whole][mask] if exact else None
        # the place tells equal blocks apart; the content keeps answers from meeting a block of another order
        name = hashlib.blake2b(repr(place).encode() + np.stack([b.column(0), b.column(1)]).tobytes() + codes.tobytes(), digest_size=16).digest()
        out = []
        for ids in np.split(first, cut):
            entries = np.stack([x[ids], y[ids]]).tobytes() if exact else x[ids].astype(np.uint32).tobytes()
            out.append({"block": name, "part": int(part[ids[0]]), "entries": entries, "many": np.packbits(many[ids]).tobytes()})
        has = wins > 0
        out.append({
            "block": name, "part": int.from_bytes(name[:4], "big") % buckets, "k1": b.column(0).to_numpy()[has].tolist(), "k2": b.column(1).to_numpy()[has].tolist(), "wins": wins[has].tolist(),
            "mask": np.packbits(mask).tobytes(), "codes": codes.tobytes()})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, b in enumerate(b for batch in batches for b in blocks(batch, 2)):
            for row in block(b, (task, i)):
                yield pa.RecordBatch.from_pylist([row], PARTS)

    return rows.mapInArrow(run, PARTS_DDL)


def answer(asked: DataFrame, exact: bool) -> DataFrame:
    """For every entry of a bucket one bit: whether its hash is there more than once."""

    def run(bucket: pa.Table) -> pa.Table:
        entries, many = bucket.column("entries").to_pylist(), bucket.column("many").to_pylist()
        rows = [i for i, e in enumerate(entries) if e is not None]
        if exact:
            both = [np.frombuffer(entries[i], np.uint64).reshape(2, -1) for i in rows]
            size = [x.shape[1] for x in both]
            x = np.concatenate(both, axis=1) if both else np.empty((2, 0), np.uint64)
            order = np.lexsort((x[1], x[0]))
            differs = (x[:, order[1:]] != x[:, order[:-1]]).any(axis=0)
        else:
            parts = [np.frombuffer(entries[i], np.uint32) for i in rows]
            size = [len(p) for p in parts]
            x = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            order = np.argsort(x)
            differs = x[order[1:]] != x[order[:-1]]
        if len(order):
            twice = np.concatenate([_bits(many[i], n) for i, n in zip(rows, size, strict=True)])
            group = np.concatenate([[0], np.cumsum(differs)])
            score = np.bincount(group, weights=1 + twice[order])
            again = np.empty(len(order), bool)
            again[order] = (score > 1)[group]
            at = 0
            for i, n in zip(rows, size, strict=True):
                entries[i], many[i] = None, np.packbits(again[at : at + n]).tobytes()
                at += n
        return bucket.set_column(2, "entries", pa.array(entries, pa.binary())).set_column(3, "many", pa.array(many, pa.binary()))

    return asked.groupBy("part").applyInArrow(run, PARTS_DDL)


def gathered(answers: DataFrame, buckets: int) -> DataFrame:
    """``k1, k2, n, bits``: texts with windows that repeat, and which."""
    kind = _code(buckets)
    here = np.iinfo(kind).max

    def run(block: pa.Table) -> pa.Table:
        rows = block.select(["part", "many", "codes"]).to_pylist()
        (note,) = (i for i, r in enumerate(rows) if r["codes"] is not None)
        codes = np.frombuffer(rows[note]["codes"], kind)
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(buckets + 1))
        again = codes == here
        heard = np.count_nonzero(again)
        for r in rows:
            if r["many"] is not None:
                mine = order[bounds[r["part"]] : bounds[r["part"] + 1]]
                again[mine] = _bits(r["many"], len(mine))
                heard += len(mine)
        if heard != len(codes):
            raise RuntimeError("answers of a block are missing: the texts must come from a stable table")
        k1, k2, wins = (block.column(c)[note].as_py() for c in ("k1", "k2", "wins"))
        hit = np.zeros(sum(wins), bool)
        hit[np.flatnonzero(_bits(block.column("mask")[note].as_py(), len(hit)))] = again
        out, a = [], 0
        for x, y, w in zip(k1, k2, wins, strict=True):
            n = int(np.count_nonzero(hit[a : a + w]))
            if n:
                out.append((x, y, n, np.packbits(hit[a : a + w]).tobytes()))
            a += w
        cols = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["k1", "k2", "n", "bits"])

    return answers.groupBy("block").applyInArrow(run, FOUND_DDL)


def level(rows: DataFrame, candidates: int, length: int, before: int | None, exact: bool) -> DataFrame:
    """One level as a written table of ``k1, k2, n, bits``, one row per distinct text."""
    buckets = max(BUCKETS, -(-candidates // BUCKET))
    found = gathered(answer(ask(rows, length, before, buckets, exact), exact), buckets)
    return written(found.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("bits").alias("bits")))


def repeats(docs: DataFrame, window: int = WINDOW, beyond: bool = False) -> DataFrame:
    """``k1, k2, n, bits, longest``: texts with windows that repeat; bit i is for the window that starts at word i.

    ``longest`` is the length of the longest level at which a window of the text repeats:
    ``window``, or more if ``beyond`` asks for the doubling to go on until no candidates survive.
    """
    rows, found, before = keyed(docs.where("text is not null")).drop("doc_id"), None, None
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n // 6
    for length in levels(window):
        held = rows if found is None else rows.join(small(found.select("k1", "k2", "bits")), ["k1", "k2"]).select("k1", "k2", "text", "bits")
        found = level(held, size, length, before, exact=length == window)
        before, size = length, found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        if not size:
            break  # no candidate survives
    longest, last = found.select("k1", "k2", F.lit(window).alias("longest")), found
    while beyond and size:
        last = level(rows.join(small(last.select("k1", "k2", "bits")), ["k1", "k2"]).select("k1", "k2", "text", "bits"), size, 2 * before, before, exact=True)
        before, size = 2 * before, last.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        longest = longest.unionByName(last.select("k1", "k2", F.lit(before).alias("longest")))
    if not beyond:
        return found.withColumn("longest", F.lit(window))
    return found.join(longest.groupBy("k1", "k2").agg(F.max("longest").alias("longest")), ["k1", "k2"])


def covered(bits: bytes, n: int, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window whose bit is set."""
    at = np.flatnonzero(_bits(bits, n - window + 1))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:n]) > 0


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` of every row.

    ``spans`` are the removed stretches of words (first word, first word after), ``kept`` the
    other words joined by one space.  Every occurrence of a repeated window goes, the first
    one too.  A null or empty text, or one shorter than the window, loses nothing; copies of
    a text of at least ``window`` words lose it whole, and so do rows that repeat.  Very long
    texts are blocks of their own and are read whole.  An empty table gives no rows; other
    columns are not read, so none can clash.  ``docs`` must be a stable table (files).
    """
    found = small(repeats(docs, window).select("k1", "k2", "bits"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs).join(found, ["k1", "k2"], "left").select("doc_id", "text", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 1):
                n_words, n_removed, spans, kept = [], [], [], []
                for t, bits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    words = (t or "").encode().split()
                    gone, where = 0, []
                    n = len(words)
                    if bits is not None:
                        off = covered(bits, n, window)
                        gone = int(np.count_nonzero(off))
                        edge = np.flatnonzero(np.diff(off.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                        where = [{"start": int(a), "end": int(e)} for a, e in edge]
                        words = [w for w, o in zip(words, off.tolist(), strict=True) if not o]
                    n_words.append(n)
                    n_removed.append(gone)
                    spans.append(where)
                    kept.append(joined(words))
                place = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, place), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT p.r, p.i, array_to_string(list_slice(d.w, p.i, p.i + {WINDOW - 1}), ' ') AS s FROM p JOIN d USING (r)),
x AS (SELECT s FROM h GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT r, i + k AS i FROM h JOIN x USING (s), range({WINDOW}) AS g(k)),
g AS (SELECT r, list(i) AS cut FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN cut IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(cut, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""


@query("op12_substring_dedup", OP12_SQL)
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
