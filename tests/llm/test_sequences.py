"""Tokenizer alignment, repeated windows and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from given import DATA, SCHEMA
from hypothesis import given, settings
from hypothesis import strategies as st

from tickledger.llm import periodic_runs, substring_dedup, tokenizer_alignment
from tickledger.llm.queries import QUERIES
from tickledger.llm.words import STRIP, Words, blocks


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts_of(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


# words as arrays


def test_words_of_a_column_equal_split():
    texts = ["a  b\tc", None, "", " \n ", "é x y", "x" * (STRIP + 5) + " end", "last", "a b"]
    w = Words(pa.array(["skipped", *texts])[1:])
    assert w.counts().tolist() == [len((t or "").encode().split()) for t in texts]
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == [x for t in texts for x in (t or "").encode().split()]
    h = w.hashes()
    assert h[0] == h[-2] and h[1] == h[-1] and len(set(h.tolist())) == len(h) - 2
    assert Words(pa.array([], pa.string())).hashes().tolist() == []
    batch = pa.record_batch([pa.array(["aa", None, "bbbb", "c"])], ["t"])
    assert [b.num_rows for b in blocks(batch, 0, 3)] == [2, 1, 1]


# 11


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = paths()
    a, b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    letters = {c: k for k, c in tokenizer_alignment.byte_letters().items()}
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        x, y = a.encode(" " + t, add_special_tokens=False), b.encode(t)
        bx = [bytes(letters[c] for c in p) for p in x.tokens]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(bx) != (" " + t).encode() or b"".join(by) != (" " + t).encode():
            docs.append(None)
            continue
        ex, ey = np.cumsum([len(p) for p in bx]).tolist(), np.cumsum([len(p) for p in by]).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ex) & set(ey)):
            gx, gy = range(i, ex.index(end, i) + 1), range(j, ey.index(end, j) + 1)
            i, j = gx.stop, gy.stop
            groups.append(",".join(str(x.ids[i]) for i in gx) + "|" + ",".join(str(y[j]) for j in gy))
            links += [(x.ids[k], y[m]) for k in gx for m in gy if ex[k] > ey[m] - len(by[m]) and ey[m] > ex[k] - len(bx[k])]
        docs.append((len(x.ids), len(y), groups, links))
    count = Counter(p for d in docs if d for p in set(d[3]))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (d[0], d[1], len(d[2]), len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]), sha(";".join(d[2]))) for d in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query_equals_brute_force(spark):
    docs = texts_of(spark)
    want = dict(zip([d for d, _ in docs], brute_alignment([t for _, t in docs])))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_tokenizer_alignment"](spark, DATA).collect()}
    assert got == want


@pytest.mark.parametrize("send_rows", [tokenizer_alignment.SEND_ROWS, 0])
def test_alignment_of_odd_texts(spark, send_rows):
    texts = [None, "", " ", "a", "  two  spaces \n\n tabs\t", "<|endoftext|> <s> </s> <unk> <0x41>", "\U0001f600 Ünïcödé ﬁ ① ½", "▁ lower block", "日本語のテキスト", "x" * 3000, "a", "word " * 400, "͸ \U0001e030 new", "é" * 2000]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(4, "  two  spaces \n\n tabs\t", "en", "s", 0)], SCHEMA)
    got = tokenizer_alignment.align_tokens(docs, *paths(), send_rows=send_rows).collect()
    want = brute_alignment([*texts, texts[4]])
    assert sorted(repr((r.doc_id, *[r[c] for c in COLUMNS])) for r in got) == sorted(repr((i, *w)) for i, w in zip([*range(len(texts)), 4], want))
    assert want[1] == (0, 0, 0, 0, 0, 0, "") and want[3][0] > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_diagonal_runs_equal_common_ends(x, y):
    x, y = np.cumsum(x).tolist(), np.cumsum(y).tolist()
    end = max(x[-1], y[-1]) + 1
    x, y = [*x, end], [*y, end]
    both = sorted(set(x) & set(y))
    ends = []
    for i, i2, j, j2 in tokenizer_alignment.align(x, y):
        ends += x[i:i2] if i2 - i == j2 - j and x[i] == y[j] else [x[i2 - 1]]
        assert x[i2 - 1] == y[j2 - 1]
    assert ends == both


# 12


def brute_repeats(docs, window):
    words = [(t or "").encode().split() for _, t in docs]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, words):
        cut = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                cut[i : i + window] = [True] * window
        out.append((d, len(w), sum(cut), b" ".join(x for x, c in zip(w, cut) if not c).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [35, 50, 8, 3])
def test_repeated_windows_equal_brute_force(spark, window):
    rng = random.Random(window)
    shared = [" ".join(rng.choices("abcdefgh", k=rng.randrange(20, 90))) for _ in range(6)]
    docs = [(i, " ".join(rng.choice([" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)), rng.choice(shared), " ".join(rng.choice(shared).split()[5:-5])]) for _ in range(4))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "x " * 40), (103, "y " * 35), (103, "y " * 35), (104, "z " * 34), (105, " ".join(f"w{i}" for i in range(20_000))), (106, " ".join(f"w{i}" for i in range(10_000, 11_000)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    frame.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/repeats-{window}")
    got = substring_dedup.cut_repeats(spark.read.parquet(path), window).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=repr) == brute_repeats(docs, window)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_many_buckets_and_doubling_beyond(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET", 50)
    body = [f"w{i}" for i in range(400)]
    docs = [(1, " ".join(body)), (2, "lead " + " ".join(body[100:260]) + " tail"), (3, " ".join(f"v{i}" for i in range(300))), (4, " ".join(f"v{i}" for i in range(40)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/beyond")
    frame = spark.read.parquet(path)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.cut_repeats(frame).collect()]) == brute_repeats(docs, 35)
    longest = substring_dedup.repeats(frame, 35, beyond=True).join(substring_dedup.keyed(frame), ["k1", "k2"])
    assert {r.doc_id: r.longest for r in longest.collect()} == {1: 140, 2: 140, 3: 35, 4: 35}
    assert substring_dedup.levels(35) == [9, 18, 35] and substring_dedup.levels(7) == [7]


# 13


def brute_runs(w, least=12):
    n, seen, out = len(w), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=30), st.integers(1, 9)), max_size=8))
def test_runs_equal_brute_force(parts):
    rows = [list(p) * k for p, k in parts] + [[c for p, k in parts for c in p * k]]
    row, start, length, period = periodic_runs.find_runs(Words(pa.array([" ".join(r) for r in rows])))
    got = [[] for _ in rows]
    for r, *x in zip(row.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[r].append(tuple(x))
    assert got == [brute_runs(r) for r in rows]


def test_hot_texts_stay_fast():
    fib = ["a", "b"]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2])
    for w in (["a"] * 100_000, list(fib[-1]), list("ab" * 30_000), [f"w{i % 9000}" for i in range(40_000)]):
        row, start, length, period = periodic_runs.find_runs(Words(pa.array([" ".join(w)])))
        assert len(row) and (length >= 12).all() and (length >= 2 * period).all()


def test_runs_query_equals_brute_force(spark):
    want = {}
    for d, t in texts_of(spark):
        w, h = (t or "").encode().split(), zlib.crc32(str(d).encode())
        g, n = h // 10, 0
        n = len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        keep = [True] * n
        for s, k, q in runs:
            keep[s + q : s + k] = [False] * (k - q)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[d] = (len(runs), *top, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(b" ".join(x for x, k in zip(w, keep) if k).decode()))
    cols = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r[c] for c in cols) for r in QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    assert got == want and sum(v[0] > 0 for v in want.values()) > 10
