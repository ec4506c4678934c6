"""Cross-tokenizer alignment by diagonal run skipping.

Both tokenizers cut the same bytes.  Where tokens of both end at the same byte, a group
ends.  Most groups are one token against one, and stand in long stretches in which the two
lists of ends agree at a fixed shift of their indices.  From a common end, stretches of 1,
2, 4, ... ends are compared at the current shift; the first that differs is halved until the
place of the difference is known.  There the irregular group is resolved end by end, which
gives the new shift.

Texts are tokenized once: each row's figures and its distinct pairs of ids, packed, are
written to the shared folder.  How many documents hold a pair is counted over that table,
first inside each batch.  While the counts are within ``SEND_ROWS`` they are sent to the
tasks; beyond that the pairs of all rows meet them in a join.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import query, read, written
from .token_counts import FILE_BOUND, PRE_TOKEN, byte_letters, disputed, latin, load
from .words import blocks

# fixed value: the pre-token pattern of byte-level vocabularies
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counted pairs (24 bytes each) that are sent to every task.
SEND_ROWS = 2_000_000
#: Pre-tokens of each of two generations that a Python worker remembers, and the letters of the longest of them.
MEMO, MEMO_LETTERS = 100_000, 64
_loaded: dict[tuple[int, int], Aligner] = {}


def settled(c: str) -> bool:
    """Whether all versions of Unicode since 3.2 agree on what class of the pattern a character is in."""
    old, now = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
    return c in " \n\t\r" or (old[0] in "LNPSM" and (old[0] if old[0] in "LN" else "") == (now[0] if now[0] in "LN" else "") and now[0] in "LNPSM")


class ByteLevel(dict):
    """Ids of texts by a byte-level vocabulary.  Special strings are plain text.

    Where the vocabulary's ids are in the order of its merges, ids are ranks, and texts of
    settled characters go through the encoder of ranks.  Other texts are cut by the pattern
    here, and those with letters newer than the library's tables go through the library whole.
    Ids of pre-tokens are remembered in two generations: a full one becomes the old one, from
    which what is met again comes back, so that common pre-tokens stay.
    """

    def __init__(self, body: str, odd: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.old: dict[str, tuple[int, ...]] = {}
        self.library = Tokenizer.from_str(body)
        self.library.encode_special_tokens = True
        self.letter = byte_letters()
        self.words = regex.compile(PRE_TOKEN).findall
        self.unsure = regex.compile(f"[{odd}]").search if odd else lambda t: None
        byte_of = {c: b for b, c in self.letter.items()}
        vocab = self.library.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        #: with a token for every byte nothing of a text is lost
        self.lossless = all(c in vocab for c in self.letter.values())
        spec = json.loads(body)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        special = {t["id"] for t in spec.get("added_tokens", [])}
        self.ranked = None
        if self.lossless and all(vocab.get(x + y) == 256 + i for i, (x, y) in enumerate(merges)) and len(merges) + 256 == len(vocab) - len(special):
            ranks = {self.bytes[i]: i for i in vocab.values() if i not in special}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PLAIN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bool] = {}

    def plain(self, text: str) -> bool:
        """Whether all characters are settled."""
        chars, known = set(text), self.known
        if new := chars.difference(known):
            known.update((c, settled(c)) for c in new)
        return all(map(known.__getitem__, chars))

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.pop(word, None)
        if ids is None:
            ids = tuple([t.id for t in self.library.model.tokenize("".join(map(self.letter.__getitem__, word.encode())))])
        if len(word) <= MEMO_LETTERS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        if self.ranked is not None and self.plain(text):
            return self.ranked(text)
        if not latin(text) and self.unsure(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return list(chain.from_iterable(map(self.__getitem__, self.words(text))))


class Pieces:
    """Ids and bytes of a piece vocabulary with byte fallback."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        names = map(self.library.id_to_piece, range(n))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Strings:
    """Byte strings by number, to be laid end to end without a loop."""

    def __init__(self, strings: list[bytes]):
        self.long = np.array([len(s) for s in strings])
        self.start = np.cumsum(self.long) - self.long
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def laid(self, at: np.ndarray) -> np.ndarray:
        n = self.long[at]
        ends = np.cumsum(n)
        return self.data[np.repeat(self.start[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def align(ea: list[int], eb: list[int]) -> list[tuple[int, int, int, int]]:
    """Stretches ``(i, i2, j, j2)`` of two ascending lists with the same last end.

    A stretch with ``i2 - i == j2 - j`` whose ends agree is as many groups of one against one;
    any other stretch is one group.
    """
    out, i, j, n = [], 0, 0, len(ea)
    while i < n:
        i0, j0, a, b = i, j, ea[i], eb[j]
        if a == b:
            i, j, step = i + 1, j + 1, 2
            while (x := ea[i : i + step]) and x == eb[j : j + step]:
                i, j, step = i + len(x), j + len(x), 2 * step
            while step > 1:
                step //= 2
                if (x := ea[i : i + step]) and x == eb[j : j + step]:
                    i, j = i + len(x), j + len(x)
        else:
            while a != b:
                if a < b:
                    i += 1
                    a = ea[i]
                else:
                    j += 1
                    b = eb[j]
            i, j = i + 1, j + 1
        out.append((i0, i, j0, j))
    return out


def group_ends(ea: list[int], eb: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens of both sides, whether a group ends with them."""
    last_a, last_b = bytearray(len(ea)), bytearray(len(eb))
    ones = b"\x01" * max(len(ea), len(eb))
    for i, i2, j, j2 in align(ea, eb):
        if i2 - i == j2 - j and ea[i] == eb[j]:
            last_a[i:i2] = last_b[j:j2] = ones[: i2 - i]
        else:
            last_a[i2 - 1] = last_b[j2 - 1] = 1
    return np.frombuffer(last_a, np.uint8), np.frombuffer(last_b, np.uint8)


def overlaps(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens whose bytes overlap: every end of either side closes a stretch that one token of each covers."""
    both = np.sort(np.concatenate([ea, eb]), kind="stable")
    both = both[np.append(True, both[1:] != both[:-1])]
    return np.searchsorted(ea, both), np.searchsorted(eb, both)


class Aligner:
    """The two tokenizers of a worker."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.bytes_a, self.bytes_b = Strings(a.bytes), Strings(b.bytes)
        n, m = len(a.bytes), len(b.bytes)
        #: ids of A before a comma and before a bar, then those of B before a comma and before a semicolon
        self.names = Strings([f"{i}{mark}".encode() for count, marks in ((n, ",|"), (m, ",;")) for mark in marks for i in range(count)])
        self.kind = np.uint32 if n * m < 1 << 32 else np.uint64

    def row(self, text: str | None, ids_b: list[int]) -> tuple[int, int, int, int, str, bytes, bytes]:
        """``n_a, n_b, n_groups, n_links, groups, pairs, times`` of a text; nothing if its bytes are not kept."""
        nothing = 0, 0, 0, 0, "", b"", b""
        if not text:
            return nothing
        raw = np.frombuffer(b" " + text.encode(), np.uint8)
        b = np.array(ids_b)
        if not np.array_equal(self.bytes_b.laid(b), raw):
            return nothing
        a = np.array(self.a.ids(" " + text))
        if not self.a.lossless and not np.array_equal(self.bytes_a.laid(a), raw):
            return nothing
        ea, eb = np.cumsum(self.bytes_a.long[a]), np.cumsum(self.bytes_b.long[b])
        last_a, last_b = group_ends(ea.tolist(), eb.tolist())
        # tokens in the order of the groups, those of A first in each
        n, m = len(self.a.bytes), len(self.b.bytes)
        group_a, group_b = np.cumsum(last_a, dtype=np.int64) - last_a, np.cumsum(last_b, dtype=np.int64) - last_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        names = self.names.laid(np.concatenate([a + n * last_a.astype(np.int64), 2 * n + b + m * last_b.astype(np.int64)])[order])
        link_a, link_b = overlaps(ea, eb)
        codes, times = np.unique(a[link_a] * m + b[link_b], return_counts=True)
        return len(a), len(b), int(last_a.sum()), len(link_a), names[:-1].tobytes().decode(), codes.astype(self.kind).tobytes(), times.astype(np.uint32).tobytes()


FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
DDL = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


class Vocabularies:
    """The two files, read and sent to the tasks once."""

    def __init__(self, spark: SparkSession, a_path: str, b_path: str):
        body = load(a_path)
        with open(b_path, "rb") as f:
            model = f.read(FILE_BOUND + 1)
        if len(model) > FILE_BOUND:
            raise ValueError(f"{b_path} is larger than {FILE_BOUND} bytes")
        odd = disputed(body)
        aligner = Aligner(ByteLevel(body, odd), Pieces(model))
        self.size_b, self.kind = len(aligner.b.bytes), aligner.kind
        self.sent = spark.sparkContext.broadcast((body, odd, model))


def _aligner(body: str, odd: str, model: bytes) -> Aligner:
    key = hash(body), hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(ByteLevel(body, odd), Pieces(model))
    return _loaded[key]


def alignments(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times`` of every row.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``.  ``pairs`` are the distinct linked pairs (id of A
    times the size of B's vocabulary, plus id of B) as packed numbers in order, ``times`` how
    many links each has.
    """
    kind, sent = docs.schema["doc_id"].dataType.simpleString(), vocabularies.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*sent.value)
        for batch in batches:
            for b in blocks(batch, 1, 1 << 20):
                texts = b.column(1).to_pylist()
                ids_b = aligner.b.ids([t or "" for t in texts])
                cols = zip(*map(aligner.row, texts, ids_b), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)]], ["doc_id", *[n for n, _ in FIELDS]])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {DDL}")


def pair_counts(rows: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """``a, pair, n, best``: in how many rows each pair is linked, and whether no pair of its A id is in more."""
    kind, size_b = vocabularies.kind, vocabularies.size_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(p, kind) for p in b.column(0).to_pylist()]
            pairs, n = np.unique(np.concatenate([np.empty(0, kind), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n, pa.int64())], ["pair", "n"])

    part = rows.select("pairs").mapInArrow(run, "pair long, n long")
    n = written(part.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / size_b).cast("long")))
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return written(n.join(most, "a").select("a", "pair", "n", (F.col("n") == F.col("most")).alias("best")))


def scored(rows: DataFrame, counts: DataFrame, vocabularies: Vocabularies, send_rows: int = SEND_ROWS) -> DataFrame:
    """``rows`` without the packed pairs, with ``n_best`` and ``count_sum`` over their links.  Both tables are written ones."""
    kind = vocabularies.kind
    names = [c for c in rows.columns if c not in ("pairs", "times", "row")]
    if counts.count() <= send_rows:
        table = counts.select("pair", "n", "best").toArrow().sort_by("pair")
        sent = rows.sparkSession.sparkContext.broadcast((table.column("pair").to_numpy().astype(kind), table.column("n").to_numpy(), table.column("best").to_numpy()))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, n, best = sent.value
            for b in batches:
                n_best, total = [], []
                for p, t in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist(), strict=True):
                    at, times = np.searchsorted(known, np.frombuffer(p, kind)), np.frombuffer(t, np.uint32).astype(np.int64)
                    n_best.append(int(times[best[at]].sum()))
                    total.append(int((times * n[at]).sum()))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], [*names, "n_best", "count_sum"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
        return rows.mapInArrow(look, f"{fields}, n_best long, count_sum long")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [np.frombuffer(p, kind) for p in b.column(1).to_pylist()]
            times = np.concatenate([np.empty(0, np.uint32), *[np.frombuffer(t, np.uint32) for t in b.column(2).to_pylist()]])
            row = np.repeat(b.column(0).to_numpy(), [len(p) for p in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(np.concatenate([np.empty(0, kind), *pairs]).astype(np.int64)), pa.array(times.astype(np.int64))], ["row", "pair", "times"])

    each = rows.select("row", "pairs", "times").mapInArrow(unpack, "row long, pair long, times long")
    sums = each.join(counts.select("pair", "n", "best"), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select(*names, zero("n_best"), zero("count_sum"))


def align_tokens(docs: DataFrame, a_path: str, b_path: str, send_rows: int = SEND_ROWS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of every row.

    A null or empty text, or one whose bytes a tokenizer changes, has no tokens: zeros and an
    empty hash.  Row by row: repeated ids and texts give repeated rows and count as documents
    of their own; pairs of one A id with equal counts are all best.  Long texts are blocks of
    their own.  An empty table gives no rows; other columns are not read, so none can clash.
    """
    vocabularies = Vocabularies(docs.sparkSession, a_path, b_path)
    hashed = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = written(alignments(docs, vocabularies).select("doc_id", "n_a", "n_b", "n_groups", "n_links", hashed, "pairs", "times", F.monotonically_increasing_id().alias("row")))
    return scored(rows, pair_counts(rows, vocabularies), vocabularies, send_rows)


@query("op11_tokenizer_alignment")
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
