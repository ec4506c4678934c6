"""Mined rules, site posteriors, leaks and odd markup against brute force."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tickledger.llm import decontaminate, html_extract, quality_classifier, token_counts, tokenizer_alignment, url_filter

LARGE = "/root/testdata/sf0.1"


def test_mined_rules_equal_counting(spark):
    """Rules of one to three tokens: support, confidence and pruning by shorter rules, counted over all subsets."""
    rng, rows = random.Random(5), []
    for _ in range(400):
        tokens = sorted(t for t in "abcdefgh" if rng.random() < 0.45)
        bad = ("a" in tokens and "b" in tokens) or ({"c", "d", "e"} <= set(tokens)) or ("h" in tokens and rng.random() < 0.93)
        rows.append((tokens, bad))
    least, confidence = 0.05, 0.9
    got = {frozenset(r["items"]): (round(r.confidence, 9), r.n) for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), support=least, support_rows=5, confidence=confidence).collect()}
    found = {}
    for size in range(1, 9):
        for items in combinations("abcdefgh", size):
            has = [bad for tokens, bad in rows if set(items) <= set(tokens)]
            if sum(has) >= least * len(rows) and sum(has) / len(has) >= confidence:
                found[frozenset(items)] = (round(sum(has) / len(has), 9), sum(has))
    want = {k: v for k, v in found.items() if not any(o < k for o in found)}
    assert got == want and {len(k) for k in want} >= {1, 2, 3}


def test_explicit_rules_may_be_missing_altogether(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", ""), (2, None, "")], "page_id long, url string, html string")
    rows = url_filter.judge(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"), rules=[]).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in rows} == {(1, None, "allow"), (2, None, "allow")}


def test_site_posteriors_equal_brute_force(spark):
    """Hosts and paths that differ: shrunk means with the document left out, and verdicts that they turn."""
    rng, rows = random.Random(6), []
    for host, base in (("good", 2.0), ("poor", -2.0), ("mixed", 0.3)):
        for path, more in (("en", 0.5), ("de", -1.0)):
            rows += [(host, path, base + more + rng.gauss(0, 0.7), -4 + rng.gauss(0, 0.3)) for _ in range(rng.randrange(3, 40))]
    rows += [("lone", "en", -0.2, -4.0), (None, None, 0.4, -3.5)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, _quality double, _toxic double")
    groups, priors = quality_classifier.sites(frame)
    got = {r.doc_id: r for r in quality_classifier.judged(frame, groups, priors).collect()}

    sig, logit = (lambda x: 1 / (1 + math.exp(-x))), (lambda p: math.log(p / (1 - p)))
    for head, column in (("quality", 2), ("toxic", 3)):
        p = [sig(r[column]) for r in rows]
        hosts, paths = [r[0] for r in rows], [r[:2] for r in rows]
        n, mean = len(p), sum(p) / len(p)
        of = lambda keys: {k: [x for x, j in zip(p, keys) if j == k] for k in set(keys)}
        h, q = of(hosts), of(paths)
        avg = lambda xs: sum(xs) / len(xs)
        within = sum((x - avg(q[k])) ** 2 for x, k in zip(p, paths)) / (n - len(q))
        ss = {"host": sum(len(v) * (avg(v) - mean) ** 2 for v in h.values()), "path": sum(len(v) * (avg(v) - avg(h[k[0]])) ** 2 for k, v in q.items())}
        free = {"host": len(h) - 1, "path": len(q) - len(h)}
        size = {"host": n - sum(len(v) ** 2 for v in h.values()) / n, "path": n - sum(len(v) ** 2 / len(h[k[0]]) for k, v in q.items())}
        strength = {}
        for level in ("host", "path"):
            between = (ss[level] - free[level] * within) / size[level]
            strength[level] = min(max(within / between, 1.0), 1e9) if between > 0 else 1e9
        for i, x in enumerate(p):
            by_host = (sum(h[hosts[i]]) - x + strength["host"] * mean) / (len(h[hosts[i]]) - 1 + strength["host"])
            site = (sum(q[paths[i]]) - x + strength["path"] * by_host) / (len(q[paths[i]]) - 1 + strength["path"])
            final = sig(rows[i][column] + logit(min(max(site, 1e-6), 1 - 1e-6)) - logit(mean))
            assert got[i][f"site_{head}"] == pytest.approx(site, abs=1e-9) and got[i][f"p_{head}"] == pytest.approx(final, abs=1e-9)
    turned = [i for i, r in enumerate(rows) if got[i].kept != (r[2] >= 0 and r[3] < 0)]
    assert turned and got[len(rows) - 1].kept is not None


def test_every_verbatim_item_of_a_large_table_is_found(spark):
    """All places and items of the given 10,000 documents: what stands there word for word is found, and paraphrases too."""
    docs, bench = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    line = lambda t: b" " + b" ".join(decontaminate.tokens(t or "")) + b" "
    items = [(r.item_id, line(r.text)) for r in bench.collect() if decontaminate.tokens(r.text or "")]
    whole = {(r.doc_id, k) for r in docs.select("doc_id", "text").collect() for t in [line(r.text)] for k, x in items if x in t}
    assert len(whole) > 200 and whole <= got
    rng, filler = random.Random(8), [w.decode() for w in decontaminate.tokens(docs.where("lang = 'en'").first().text)]
    rows, want = [], set()
    for i, r in enumerate(bench.collect()):
        w = [x.decode() for x in decontaminate.tokens(r.text or "")]
        if len(w) < 15:
            continue
        # a fifth of the words is replaced or left out, the answer stays
        body = [x if j >= len(w) * 3 // 4 or rng.random() > 0.25 else rng.choice([None, rng.choice(filler)]) for j, x in enumerate(w)]
        rows.append((10**9 + i, " ".join([*rng.choices(filler, k=60), *[x for x in body if x], *rng.choices(filler, k=60)])))
        want.add((10**9 + i, r.item_id))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")), bench).collect()}
    assert len(want & found) >= 0.9 * len(want)


def test_unseen_elements_do_not_cut_words():
    text = lambda h: html_extract.main_text(h)[0]
    assert text("<p>wo<script>x</script>rd</p>") == "word"
    assert text("<p>one <svg><text>no</text></svg>two<style>p{}</style>three") == "one twothree"
    assert text("<p>a<noscript><p>no</p></noscript>b</p><p>c") == "ab c"
    assert text("<p>be<span class=ad>no</span>fore</p><template><div>no</div></template>x") == "before x"
    assert text("<p>a<span class=ad>no<p>next") == "a next"
    assert text("<div>a<noscript>no</div><p>b") == "a b"


def test_ranks_of_settled_characters_equal_the_library():
    """Every settled character below U+3000 in four settings, and texts of others, against the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    body = token_counts.load(path)
    ours, library = tokenizer_alignment.ByteLevel(body, token_counts.disputed(body)), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    assert ours.ranked is not None
    chars = [chr(c) for c in range(0x3000) if tokenizer_alignment.settled(chr(c))]
    for form in ("a{0}a", "1{0}1", " {0} {0}", "!{0}!"):
        for i in range(0, len(chars), 64):
            text = "\n".join(form.format(c) for c in chars[i : i + 64])
            assert ours.ranked(text) == library.encode(text, add_special_tokens=False).ids
    for text in ("<|endoftext|>", "x \x1c\x85  　y", "ժֈ i՘ ", "ꟍꟍ 1 ೜", "it's 'S ''s", "\U0001f600 a", " " * 50 + "\n\n\t x"):
        assert ours.ids(text) == library.encode(text, add_special_tokens=False).ids
