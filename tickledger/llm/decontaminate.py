"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of words and weighted by TF-IDF, with document
frequencies counted over the whole corpus.  A randomised SVD of the passage matrix, run as
Spark jobs (products of the matrix with a thin block, summed per term), gives the latent
space.  Windows slide over every document; a window whose latent vector is close to a
passage's is a candidate, and the item is then aligned there: the longest common
subsequence with the text, and for looser matches also the item's answer, decide.

The latent space is that of the passages to be found: what a document's window has outside
their span has no part in its product with any of them.  So windows and passages are compared
by what they have inside it, whatever share of their length the rank keeps, and windows are
as long as the passages they are held against.  Candidates are thinned by a bound only: a
place with fewer words of the item than the subsequence needs cannot have it.  The benchmark is a stated query
set; it is taken in blocks of bounded size, each sent to the tasks, against all documents.
No text is shuffled, and a task's memory holds the words of some texts, or of one long text, at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, read, without, written
from .words import blocks

#: Words of a passage or window, and the steps between passages and between windows.
WIDTH, PASSAGE_STEP, STEP = 32, 16, 8
#: Latent dimensions, further ones that sharpen them, and rounds of the subspace iteration.
RANK, MORE, ROUNDS = 64, 10, 3
#: Cosine of a candidate; share of the item's words in common order that is a leak by itself, or with its answer.
COSINE, LCS, LCS_ANSWER, ANSWER = 0.5, 0.6, 0.5, 0.8
#: Items and bytes of text in a block of the benchmark.
BLOCK_ITEMS, BLOCK_BYTES = 2000, 4 << 20
#: Places of an item that are ruled out together.
TOGETHER = 6
#: Words that are looked at together, and bytes of the texts that are laid end to end.
STRETCH, LAID_BYTES = 8192, 1 << 19

_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates them."""
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split()


def answer_of(text: str, answer: str | None) -> list[bytes]:
    """The words of the answer, or of the item's last sentence if it has none of its own."""
    if answer:
        return tokens(answer)
    parts = [p for p in re.split(r"[.!?\n]+", text) if p.strip()]
    return tokens(parts[-1]) if len(parts) > 1 else []


def places(a: list[bytes]) -> dict[bytes, int]:
    """A bit for every place of a word."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    return at


def lcs(a: list[bytes], b: list[bytes], at: dict[bytes, int] | None = None) -> int:
    """Length of the longest common subsequence, a machine word of bits at a time; ``at`` are the places of ``a``."""
    get = (places(a) if at is None else at).get
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def summed(rows: np.ndarray, kind: type) -> np.ndarray:
    """Running sums of ``rows`` at every ``STEP`` of them, from zero."""
    parts = rows.reshape(-1, STEP, rows.shape[1]).sum(axis=1, dtype=rows.dtype)
    out = np.zeros((len(parts) + 1, rows.shape[1]), kind)
    np.cumsum(parts, axis=0, out=out[1:])
    return out


def passages(words: list[bytes]) -> list[tuple[int, list[bytes]]]:
    """Start and words of the passages of an item; a short item is one passage."""
    starts = range(0, max(1, len(words) - PASSAGE_STEP), PASSAGE_STEP)
    return [(s, words[s : s + WIDTH]) for s in starts]


def document_frequency(docs: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many documents each of the (bounded) terms occurs, and how many there are."""
    ctx = docs.sparkSession.sparkContext
    sent = ctx.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = sent.value, 0
        counts = np.zeros(len(at), np.int64)
        for b in batches:
            total += b.num_rows
            for t in b.column(0):
                hit = at.keys() & set(tokens(t.as_py() or ""))
                counts[[at[w] for w in hit]] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([total, *counts[some]], pa.int64())], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r.term: r.n for r in rows}
    return np.array([found.get(i, 0) for i in range(len(terms))], float), found.get(-1, 0)


def randomised_svd(rows: DataFrame, n_terms: int, rank: int = RANK, more: int = MORE, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the sparse rows ``idx array<int>, val array<double>``.

    Each round sends a thin orthonormal block to the tasks, multiplies it by the rows and
    their transpose there, and sums the result per term.
    """
    ctx = rows.sparkSession.sparkContext
    width = min(rank + more, n_terms)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]
    image = block
    for _ in range(rounds):
        sent = ctx.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            m = sent.value
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for idx, val in zip(b.column(0), b.column(1), strict=True):
                    i, v = np.array(idx.as_py(), int), np.array(val.as_py(), float)
                    y = v @ m[i]
                    for j, x in zip(i, v, strict=True):
                        out[j] = out.get(j, 0.0) + x * y
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([x.tolist() for x in out.values()], pa.list_(pa.float64()))], ["term", "v"])

        part = rows.mapInArrow(run, "term long, v array<double>")
        total = part.groupBy("term").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("v")).collect()
        image = np.zeros((n_terms, width))
        for r in total:
            image[r.term] = r.v
        last, block = block, np.linalg.qr(image)[0]
    values, turn = np.linalg.eigh(last.T @ image)
    return last @ turn[:, np.argsort(-values)[: min(rank, width)]]


class Latent:
    """A block of the benchmark in its latent space, as it is sent to the tasks."""

    def __init__(self, docs: DataFrame, items: list[tuple[object, str, str | None]]):
        spark = docs.sparkSession
        self.ids = [i for i, _, _ in items]
        self.words = [tokens(t) for _, t, _ in items]
        self.places = [places(w) for w in self.words]
        self.answers = [answer_of(t, a) for _, t, a in items]
        cut = [(k, s, p) for k, w in enumerate(self.words) if w for s, p in passages(w)]
        terms = sorted({w for _, _, p in cut for w in p})
        self.at = {w: i for i, w in enumerate(terms)}
        df, n = document_frequency(docs, terms)
        idf = np.log((1 + n) / (1 + df)) + 1e-3
        sparse = []
        for k, s, p in cut:
            idx, tf = np.unique([self.at[w] for w in p], return_counts=True)
            sparse.append((k, s, idx.tolist(), (tf * idf[idx]).tolist()))
        rows = spark.createDataFrame(sparse, "item int, start int, idx array<int>, val array<double>").repartition(8, "item", "start")
        v = randomised_svd(rows.select("idx", "val"), len(terms))
        #: latent vector that a word adds to a window; the last row is for words that no item has
        self.add = np.vstack([v * idf[:, None], np.zeros((1, v.shape[1]))]).astype(np.float32)
        near = np.array([np.array(x) @ v[i] for _, _, i, x in sparse])
        size = np.linalg.norm(near, axis=1, keepdims=True)
        near = (near / np.where(size > 0, size, 1)).T.astype(np.float32)
        item, start = np.array([k for k, *_ in sparse]), np.array([s for _, s, *_ in sparse])
        # passages by the length of their windows, a multiple of the step
        wide = np.array([-(-len(p) // STEP) * STEP for _, _, p in cut])
        self.near = {int(w): (near[:, wide == w].copy(), item[wide == w], start[wide == w]) for w in np.unique(wide)}
        self.size = np.array([len(w) for w in self.words])
        self.slack = np.maximum(STEP // 2, self.size // 4)
        self.need = np.ceil(LCS_ANSWER * self.size)
        self.margin = -(-int((self.size + self.slack).max()) // STEP) * STEP
        #: a bit for every word and item that has it; the last row is for words that no item has
        self.has = np.zeros((len(terms) + 1, -(-len(items) // 8)), np.uint8)
        for k, item in enumerate(self.words):
            self.has[[self.at[w] for w in set(item)], k >> 3] |= 1 << (k & 7)

    def candidates(self, docs: list[list[bytes]]) -> list[set[tuple[int, int]]]:
        """For each of some documents, items and the places where they would begin: all windows close to a passage.

        The documents are laid end to end, each from a full step on and with a gap of the
        widest window behind it, so that one product serves many short ones.  Words are summed
        by blocks of ``STEP``: their latent vectors, and how many are words of each item.  A
        place stays if the blocks around it have the words of the item that a subsequence
        needs to count.
        """
        none, get = len(self.at), self.at.get
        room = [-(-len(words) // STEP) * STEP + WIDTH for words in docs]
        base = np.concatenate([[0], np.cumsum(room)])
        n = int(base[-1])
        ids = np.full(n, none)
        for at, words in zip(base.tolist(), docs, strict=False):
            ids[at : at + len(words)] = [get(w, none) for w in words]
        found: list[set[tuple[int, int]]] = [set() for _ in docs]
        for a in range(0, n, STRETCH):
            low = max(0, a - self.margin)
            run = summed(self.add.take(ids[a : a + STRETCH + WIDTH], axis=0), np.float32)
            bits = np.unpackbits(self.has.take(ids[low : a + STRETCH + WIDTH + self.margin], axis=0), axis=1, bitorder="little")
            inside = summed(bits, np.int32)
            rows, row = inside.shape
            inside = inside.ravel()
            for width, (near, item, start) in self.near.items():
                begin = np.arange(max(1, min(STRETCH, len(run) * STEP - width) // STEP))
                w = run[np.minimum(begin + width // STEP, len(run) - 1)] - run[begin]
                size = np.sqrt(np.einsum("ij,ij->i", w, w))
                x, p = np.divmod(np.flatnonzero(w @ near >= COSINE * np.maximum(size, 1e-3)[:, None]), len(item))
                block, k = begin[x] + (a - low) // STEP, item[p]
                left = np.maximum(block - (-(-(start + self.slack[item]) // STEP))[p], 0)
                right = np.minimum(block + (-(-(self.size[item] + self.slack[item] - start) // STEP))[p], rows - 1)
                some = np.flatnonzero(inside[right * row + k] - inside[left * row + k] >= self.need[k])
                at = a + begin[x[some]] * STEP
                doc = np.searchsorted(base, at, "right") - 1
                for d, k, place in zip(doc.tolist(), k[some].tolist(), (at - base[doc] - start[p[some]]).tolist(), strict=True):
                    found[d].add((k, place))
        return found

    def possible(self, words: list[bytes], places: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Places but for those of an item close together that have no subsequence long enough even in one stretch over all of them."""
        a = 0
        while a < len(places):
            k, begin = places[a]
            b = a + 1
            while b < len(places) and b - a < TOGETHER and places[b][0] == k and places[b][1] <= places[b - 1][1] + 2 * STEP:
                b += 1
            item, slack = self.words[k], int(self.slack[k])
            if b - a == 1 or lcs(item, words[max(0, begin - slack) : max(0, places[b - 1][1] + len(item) + slack)], self.places[k]) >= LCS_ANSWER * len(item):
                yield from places[a:b]
            a = b

    def leaks(self, texts: list[str]) -> list[list[tuple[object, int, float, float]]]:
        """For each text ``item_id, place, lcs, answer`` of the items that it gives away, each at its best place."""
        docs = [tokens(t) for t in texts]
        out = []
        for words, places in zip(docs, self.candidates(docs), strict=True):
            best: dict[int, tuple[float, float, int]] = {}
            for k, begin in self.possible(words, sorted(places)):
                item, answer = self.words[k], self.answers[k]
                slack = int(self.slack[k])
                span = words[max(0, begin - slack) : max(0, begin + len(item) + slack)]
                same = lcs(item, span, self.places[k]) / len(item)
                if same >= LCS_ANSWER:
                    said = lcs(answer, span) / len(answer) if answer else 0.0
                    if same >= LCS or said >= ANSWER:
                        best[k] = max(best.get(k, (0.0, 0.0, 0)), (same, said, max(0, begin)))
            out.append([(self.ids[k], place, same, said) for k, (same, said, place) in sorted(best.items())])
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, place, lcs, answer``: the benchmark items that documents give away.

    ``benchmark`` holds ``item_id, text`` and may hold ``answer`` (else an item's last sentence
    is its answer).  ``place`` is the word at which the item begins, about; the shares are of
    the item's and the answer's words, in common order.  Null or empty texts on either side
    match nothing; repeated rows repeat; empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = written(benchmark.where("text is not null and text <> ''").select("item_id", "text", answer.alias("answer")))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = max(1, -(-size.n // block_items), -(-size.b // block_bytes))
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, place long, lcs double, answer double"
    found = []
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()
        rows = [(r.item_id, r.text, r.answer) for r in rows if tokens(r.text)]
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(Latent(docs, rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            latent = sent.value
            for b in (b for batch in batches for b in blocks(batch, 1, LAID_BYTES)):
                found = latent.leaks([t or "" for t in b.column(1).to_pylist()])
                out = [(d, *x) for d, xs in zip(b.column(0).to_pylist(), found, strict=True) for x in xs]
                cols = [pa.array([x[0] for x in out], b.schema.field(0).type), pa.array([x[1] for x in out], kind_of[0]), *[pa.array([x[i] for x in out], t) for i, t in ((2, pa.int64()), (3, pa.float64()), (4, pa.float64()))]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "place", "lcs", "answer"])

        kind_of = [pa.string() if kinds[1] == "string" else pa.int64()]
        found.append(docs.select("doc_id", "text").mapInArrow(run, schema if kinds[1] in ("string", "bigint") else schema.replace(f"item_id {kinds[1]}", "item_id bigint")))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that give no benchmark item away."""
    return without(docs, written(leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct()))


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
