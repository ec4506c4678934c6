"""Periodic runs in the words of a text by seeds and extension along diagonals.

A run is a stretch of words that repeats itself at its smallest period ``q``, at least
``LENGTH`` words and two periods long, and that cannot be made longer.  Words of a run
equal those ``q`` further on, at ``max(LENGTH - q, q)`` places in a row at least: that is
the guaranteed overlap of its diagonal (lag).  Lags are taken in bands, ``[k, 2k)`` with
overlaps of ``k`` or more (the first band holds all lags below ``LENGTH``).  In a band the
k-grams of half the overlap at every (k/2)-th word are the seeds: each diagonal stretch of
``k`` holds one whole.  A seed meets the later occurrences of its gram in the same text at
the band's lags only, so a band of ``n`` words has at most ``2n`` pairs, however often a gram
occurs, and all bands ``2n log n``.

Seeds that follow each other on a lag are one stretch: the table of how far each lag is
covered keeps the first of them and lets the others go.  The stretch is then extended at
both ends, over less than a gram, by halving on window hashes.  Of the lags that give the
same run the smallest is its period.  Every run is compared word by word in the end; a text
in which a hash matched by chance is done again with other hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, query, read
from .words import Words, blocks, joined, pair

#: Words of the shortest run.
LENGTH = 12


def tower(h: np.ndarray, top: int, salt: int) -> list[np.ndarray]:
    """Hashes of all windows of 1, 2, 4, ... words, up to ``top`` words."""
    out = [h]
    while 2 << (len(out) - 1) <= top:
        last, step = out[-1], 1 << (len(out) - 1)
        out.append(pair(last[: max(0, len(last) - step)], last[step:], salt))
    return out


def grams(floors: list[np.ndarray], length: int, salt: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words, each from the two floors' windows that cover it."""
    k = length.bit_length() - 1
    base, step = floors[k], length - (1 << k)
    return pair(base[: max(0, len(base) - step)], base[step:], salt) if step else base


def seed_pairs(gram: np.ndarray, rows: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds (every ``size``-th place) and the lags in ``[low, high)`` at which their gram occurs again in their row."""
    n = len(gram)
    order = np.argsort(gram, kind="stable")
    s = gram[order]
    group = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
    key = group * (2 * n + high + 1) + order  # sorted: by gram, then by place
    of = np.empty(n, np.int64)
    of[order] = group
    seeds = np.arange(0, n, size)
    at = of[seeds] * (2 * n + high + 1) + seeds
    a, b = np.searchsorted(key, at + low), np.searchsorted(key, at + high)
    count = b - a
    seeds, a, count = seeds[count > 0], a[count > 0], count[count > 0]
    place = order[np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())]
    seed = np.repeat(seeds, count)
    same = rows[seed] == rows[place]
    return seed[same], (place - seed)[same]


def stretches(seed: np.ndarray, lag: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last and lag of the seeds that follow each other on a lag."""
    order = np.lexsort((seed, lag))
    seed, lag = seed[order], lag[order]
    new = np.ones(len(seed), bool)
    # beyond what the lag has covered, or in another row
    new[1:] = (lag[1:] != lag[:-1]) | (seed[1:] != seed[:-1] + size) | (rows[seed[1:]] != rows[seed[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(seed)) - 1
    return seed[first], seed[last] + size, lag[first]


def reach(floors: list[np.ndarray], at: np.ndarray, lag: np.ndarray, room: np.ndarray, size: int, back: bool) -> np.ndarray:
    """How many of the next (or previous) words equal those ``lag`` further on; at most ``room`` and less than ``size``."""
    got = np.zeros(len(at), np.int64)
    for k in range(size.bit_length() - 1, -1, -1):
        if k >= len(floors):
            continue
        step, floor = 1 << k, floors[k]
        fits = got + step <= room
        a = np.where(fits, at - got - step if back else at + got, 0)
        b = np.where(fits, a + lag, 0)
        got += step * (fits & (floor[a] == floor[b]))
    return got


def _propose(h: np.ndarray, first: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and period of the stretches that look like runs, by hashes; places count over all rows."""
    counts = np.diff(first)
    found = [np.empty((4, 0), np.int64)]
    k, low = LENGTH // 2, 1
    while True:
        # rows with room for a run of the band: twice its least lag
        big = counts >= max(LENGTH, 2 * low)
        if not big.any():
            break
        take = np.repeat(big, counts)
        place = np.flatnonzero(take)
        x, row = h[place], np.repeat(np.flatnonzero(big), counts[big])
        start = np.cumsum(counts[big]) - counts[big]
        begin, end = np.repeat(start, counts[big]), np.repeat(start + counts[big], counts[big])
        size, high = k // 2, 2 * k
        floors = tower(x, size, salt)
        seed, lag = seed_pairs(grams(floors, size, salt), row, size, low, high)
        k, low = high, high
        if not len(seed):
            continue
        a, b, d = stretches(seed, lag, row, size)
        # a gram may run past the end of its row: cut, and extend again from there
        b = np.minimum(b, end[a] - d)
        a = a - reach(floors, a, d, a - begin[a], size, back=True)
        b = b + reach(floors, b, d, end[a] - d - b, size, back=False)
        long = b - a >= np.maximum(LENGTH - d, d)
        a, b, d = a[long], b[long] + d[long], d[long]
        found.append(np.stack([row[a], place[a], place[a] + (b - a), d]) if len(a) else np.empty((4, 0), np.int64))
    row, a, b, d = np.concatenate(found, axis=1)
    order = np.lexsort((d, b, a))
    row, a, b, d = row[order], a[order], b[order], d[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # the smallest lag is the period
    return row[new], a[new], b[new], d[new]


def find_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, length and period of all runs, by row, start and period; starts count from the row's first word."""
    h = words.hashes()
    for salt in (1, 2, 3, 4, 5):
        row, a, b, d = _propose(h, words.first, salt)
        low, high = words.first[row], words.first[row + 1]
        true = all(np.array_equal(h[x : y - q], h[x + q : y]) for x, y, q in zip(a.tolist(), b.tolist(), d.tolist(), strict=True))
        left, right = a > low, b < high
        if true and not (h[a[left] - 1] == h[a[left] - 1 + d[left]]).any() and not (h[b[right]] == h[b[right] - d[right]]).any():
            order = np.lexsort((d, a))
            return row[order], (a - low)[order], (b - a)[order], d[order]
    raise RuntimeError("window hashes matched by chance five times")


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row.

    ``runs`` is ``array<struct<start,length,period>>`` by start, then period; ``collapsed`` are
    the words joined by one space without those that a run has after its first period.  A
    null or empty text has no words, hence none.  Row by row: repeated ids and texts give
    repeated rows, an empty table gives none, other columns are not read, so none can clash.
    Runs of equal length are all there, in the order above.  Very long texts are taken alone,
    in memory that grows with their own length only.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, 1, 1 << 20):
                words = Words(b.column(1))
                row, start, length, period = find_runs(words)
                cut = np.searchsorted(row, np.arange(b.num_rows + 1))
                keep = np.ones(len(words), bool)
                for r, s, n, q in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
                    at = int(words.first[r]) + s
                    keep[at + q : at + n] = False
                texts = []
                for i, t in enumerate(b.column(1).to_pylist()):
                    ws = (t or "").encode().split()
                    if cut[i] < cut[i + 1]:
                        ws = [w for w, k in zip(ws, keep[words.first[i] : words.first[i + 1]].tolist(), strict=True) if k]
                    texts.append(joined(ws))
                items = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], fields=list(item))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.counts(), pa.int64()), lists, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: least start, then period) and hashes of all of them and of what is left."""
    best = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"])).cast("int")), F.lit(0))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{f}").alias(f) for f in ("start", "length", "period")],
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, made periodic from some word on where the checksum of the id ends in 0 (part of the query's contract)."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def again(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    # the words are bound once, by a transform over a list of one
    return F.when((F.pmod(h, F.lit(10)) == 0) & F.coalesce(text.rlike(WORD), F.lit(False)), F.get(F.transform(F.array(words), again), F.lit(0))).otherwise(text)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return digest(runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))
