"""Each operator against brute force, an exact count or held-out labels."""

import html
import random
import re

import numpy as np
import pytest
from given import DATA, SCHEMA
from pyspark.sql import functions as F

from tickledger.llm import decontaminate, html_extract, line_dedup, mixing, near_dup, quality_classifier, quality_rules, secret_scan, token_counts, url_filter

BIG = "/root/testdata/sf0.01"


def docs_of(spark, path=DATA):
    return spark.read.parquet(f"{path}/documents.parquet")


def test_tokens_equal_the_library(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = docs_of(spark).unionByName(odd).where("doc_id is not null").dropDuplicates(["doc_id", "text"]).withColumn("doc_id", F.monotonically_increasing_id())
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    texts |= {10**9 + i: t for i, t in enumerate(["<|endoftext|>", "a <|endoftext|>b", "ժֈ i՘ ", "x \x1c\x85  　y", "'S 's ''s", "ꟍꟍ 1 ೜"])}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_bytes) for r in token_counts.count_tokens(frame, path).collect()}
    assert got == {i: (len(library.encode(t, add_special_tokens=False).ids), len(t.encode())) for i, t in texts.items()}


def test_tokens_refuse_other_models():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.load(public_tokenizers.path("word_bpe_49k.json"))


def test_water_fill_by_bisection(spark):
    rnd = random.Random(3)
    rows = [(f"s{i}", rnd.randrange(0, 10**6), float(rnd.choice((1, 2, 3, 50)))) for i in range(40)]
    frame = spark.createDataFrame(rows, "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(frame, 1.5, 2.0).collect()}
    budget, low, high = 1.5 * sum(n for _, n, _ in rows), 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2.0 * n, w * mid) for _, n, w in rows) < budget else (low, mid)
    assert all(abs(got[s] - min(2.0 * n, w * low)) < 1e-3 for s, n, w in rows)
    full = mixing.water_fill(frame, 5.0, 2.0).collect()
    assert all(r.target == 2.0 * r.source_size for r in full)


def test_mix_meets_targets(spark):
    rows = mixing.mix(docs_of(spark)).collect()
    again = mixing.mix(docs_of(spark).repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in by.values())


def test_shingles_link_over_chains(spark):
    """Near copies that are similar to a base but not to each other, and chains, against all pairs."""
    rnd = random.Random(11)
    rows, n = [], 0
    for base in range(12):
        words = [f"w{base}_{i}" for i in range(120)]
        rows.append((1000 + 37 * base % 400, " ".join(words)))
        for _ in range(25):
            w = list(words)
            for _ in range(rnd.choice((1, 2, 2, 3))):
                w[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
            n += 1
            rows.append((rnd.randrange(10**6), " ".join(w)))
    rows = list({i: (i, t) for i, t in rows}.values())
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = {r.doc_id: r.component_id for r in near_dup.groups(frame, 3, 85).collect()}
    assert got == {i: find(i) for i in ids}


def test_large_bucket_in_blocks(spark, monkeypatch):
    """Sets of a bucket that meet in blocks, and in few columns at a time, join the same components as all pairs."""
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**62, 100, dtype=np.uint64))
    sets = []
    for _ in range(60):
        s = base.copy()
        s[rng.choice(100, int(rng.integers(1, 14)), replace=False)] += rng.integers(1, 9, dtype=np.uint64)
        sets.append(np.unique(s))
    frame = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "doc_id long, set binary")
    members = spark.createDataFrame([(7, i, i, 60) for i in range(60)], "h long, rep long, comp long, n long")
    links = [(i, j) for i in range(60) for j in range(i + 1, 60) for k in [len(np.intersect1d(sets[i], sets[j]))] if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k)]
    want = {tuple(r) for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    for block, columns in ((512, 8192), (8, 50)):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        monkeypatch.setattr(near_dup, "COLUMNS", columns)
        got = near_dup.set_links(members, frame, 85)
        assert got.count() < len(links)
        assert {tuple(r) for r in near_dup.components(got).collect()} == want


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in near_dup.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_small_sets_have_no_partner_but_their_equal(spark):
    rows = [(1, "a b"), (2, "b a"), (3, "A b"), (4, "a b c d e f g"), (5, "a b c d e f"), (6, "a b c d e f g h i j"), (7, "a b c d e f g h i")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (5, 4), 5: (4, 5), 6: (8, 6), 7: (7, 6)}


def test_leaks_exact_and_paraphrased(spark):
    docs, bench = docs_of(spark), spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [(r.item_id, decontaminate.tokens(r.text)) for r in bench.collect()]
    base = [decontaminate.tokens(r.text) for r in docs.where("length(text) > 800").collect()]
    rnd = random.Random(2)
    rows, want = [], set()
    for k in range(80):
        i, words = items[k % len(items)]
        share = (0.0, 0.1, 0.15, 0.2)[k % 4]
        said = [w if rnd.random() >= share else b"zzz%d" % rnd.randrange(10**6) for w in words]
        host = rnd.choice(base)
        at = rnd.randrange(len(host))
        rows.append((10**6 + k, b" ".join(host[:at] + said + host[at:]).decode()))
        if decontaminate.lcs(words, said) >= 0.8 * len(words):
            want.add((10**6 + k, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")), bench).collect()}
    assert want <= got
    for d, i in {x for x in got if x[0] < 10**6}:
        text, item = docs.where(F.col("doc_id") == d).first().text, dict(items)[i]
        assert decontaminate.lcs(item, decontaminate.tokens(text)) >= 0.5 * len(item)


def test_verbatim_items_of_a_large_benchmark(spark):
    """With more items than the rank holds, whole items in documents are found as by brute force."""
    big = "/root/testdata/sf0.1"
    docs, bench = docs_of(spark, big), spark.read.parquet(f"{big}/benchmark.parquet")
    said = lambda t: b" %s " % b" ".join(decontaminate.tokens(t or ""))
    items = [(r.item_id, said(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for t in [said(r.text)] for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert len(items) == 200 and len(want) > 200
    assert len(want & got) >= 0.9 * len(want)


def test_leaks_in_blocks(spark):
    docs, bench = docs_of(spark), spark.read.parquet(f"{DATA}/benchmark.parquet")
    pick = lambda d: {(r.doc_id, r.item_id) for r in d.collect()}
    assert pick(decontaminate.leaks(docs, bench, block_items=15)) == pick(decontaminate.leaks(docs, bench))


def test_lcs_by_table():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randrange(0, 80))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        assert decontaminate.lcs(a, b) == row[-1]


def test_svd_spans_the_leading_directions(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((60, 5)) @ rng.standard_normal((5, 40)) + 0.01 * rng.standard_normal((60, 40))
    rows = spark.createDataFrame([(list(range(40)), r.tolist()) for r in a], "idx array<int>, val array<double>").repartition(3)
    v = decontaminate.randomised_svd(rows, 40, rank=5, more=5)
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-8)
    exact = np.linalg.svd(a)[2][:5].T
    assert np.linalg.norm(exact.T @ v, 2) > 0.999 and np.linalg.svd(exact.T @ v)[1].min() > 0.999


def test_classifier_on_held_out_labels(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = docs_of(spark, big), spark.read.parquet(f"{big}/labels.parquet")
    rows = quality_classifier.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(r.kept for r in good) / len(good) > 0.98
    assert sum((r.p_quality >= 0.5) == (r.quality == 1) for r in rows) / len(rows) > 0.97
    toxic = [r for r in rows if r.toxic]
    assert sum(not r.kept for r in toxic) / len(toxic) > 0.9


def test_sparse_sites_shrink_and_bad_sites_stand_out(spark):
    """Scores drawn around two host means: the posterior of a large host is its own, of a single row nearly the global one."""
    rng = np.random.default_rng(5)
    rows = [(f"h{h % 2}" if h < 40 else f"x{h}", "en", float(rng.normal(2.5 if h % 2 else -2.5, 0.3)), -5.0) for h in range(44) for _ in range(50 if h < 40 else 1)]
    scored = spark.createDataFrame(rows, "source string, lang string, _quality double, _toxic double")
    groups, priors = quality_classifier.sites(scored)
    out = {r.source: r.site_quality for r in quality_classifier.judged(scored, groups, priors).collect()}
    assert out["h1"] > 0.85 and out["h0"] < 0.15
    assert all(abs(out[f"x{h}"] - priors["quality"]["mean"]) < 1e-6 for h in range(40, 44))


def test_main_text_equals_the_article(spark):
    rows = spark.read.parquet(f"{BIG}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        inner = re.sub(r"<[^>]+>", " ", re.sub(r"</?(b|i|em|a)( [^>]*)?>", "", inner))
        assert got[r.page_id] == " ".join(html.unescape(inner).split())


def test_style_tree_cuts_what_repeats(spark):
    """Pages that mark nothing: the branch that says the same on every page goes, the varying one stays."""
    page = "<body><div class=x><p>Same words on all</p></div><div class=y><p>{}</p><ul><li>item {}</li></ul></div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(f"own text {i}", i)) for i in range(6)] + [(9, "http://k.org/", page.format("alone", 1))]
    got = {r.page_id: (r.text, r.n_cut) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("own text 3 item 3", 1)
    assert got[9] == ("Same words on all alone item 1", 0)


def test_parser_cases():
    text = lambda h: html_extract.main_text(h)[0]
    assert text("<article>a<script>x<p></script><b>b</b>c<br>d<aside>no</aside><div class='user-comments'>no</div>e</article><p>out") == "abc d e"
    assert text("<main><p>one<p class=ad>no<p>two</main>") == "one two"
    assert text("<nav>no<article>no</article></nav><p>yes &lt;x&gt; &#233;") == "yes <x> é"
    assert text("<div id=content><p>in</p></div><p>out</p>") == "in"
    assert text("<!-- no --><table><tr><td>a<td>b<tr><td>c</table>") == "a b c"


def test_marks_need_most_of_the_text():
    """A title, a meta line, a teaser or an empty element named like an article does not take the page's place."""
    text = lambda h: html_extract.main_text(h)[0]
    body = "<div class=body-text><p>one two three</p><p>four five</p></div>"
    assert text(f"<h1 class=entry-title>T</h1>{body}") == "T one two three four five"
    assert text(f"{body}<p class=post-meta>May 1</p>") == "one two three four five May 1"
    assert text(f"<article>a teaser</article>{body}") == "a teaser one two three four five"
    assert text(f"<main></main>{body}") == "one two three four five"
    assert text(f"<article>a teaser</article><div id=content>{body}</div><p>out") == "a teaser one two three four five"


def test_style_tree_cuts_inside_articles(spark):
    """A notice without a telling name that repeats inside the article goes; an article that is the same on all pages stays."""
    page = "<body><article><h1>Title {0}</h1><p>own text {0}</p><div><p>Join our list today</p></div></article><div class=z>{0}</div></body>"
    same = "<body><article><p>the same words on all pages</p></article><div class=z>{0}</div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(5)] + [(10 + i, f"http://k.org/{i}", same.format(i)) for i in range(5)]
    got = {r.page_id: (r.text, r.n_cut) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("Title 3 own text 3", 1)
    assert got[13] == ("the same words on all pages", 0)


def test_style_tree_merges_pages_with_ids_of_their_own(spark):
    page = "<body class='postid-{0} single'><div id=node-{0}><div class=x><p>Same words on all</p></div><div class=y><p>own text {0}</p></div></div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(100, 106)]
    got = {r.page_id: (r.text, r.n_cut) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[103] == ("own text 103", 1)


def test_url_rules_are_mined_and_pruned(spark):
    pages, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        host = ("casino.example.com" if i % 8 else "pills.example.org") if bad else f"site{i % 7}.example.com"
        pages.append((i, f"https://{host}/en/{i}.html?ref=a", ""))
        if i < 300:
            labels.append((i, 0 if bad and i % 3 else 1, 1 if bad and i % 3 == 0 else 0))
    p = spark.createDataFrame(pages, "page_id long, url string, html string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = url_filter.judge(p, lab, rules=[])
    got = {r.page_id: (r.verdict, r.learnt) for r in rows.collect()}
    assert all((got[i][0] == "block") == (i % 4 == 0) for i in range(400))
    assert {got[i][1] for i in range(0, 400, 4)} <= {"h:casino", "h:pills", "d:example.org", "h:org"}  # single tokens: longer rules are pruned


def test_rule_match_brute_force(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    hosts = ["net", "example.net", "a.example.net", "xexample.net", "example.com", "m.example.com", "org", "a.org", "EXAMPLE.com", "net.org", ""]
    urls = [f"{s}{h}{t}" for s in ("http://", "", "x://y://") for h in hosts for t in ("", "/", "/en/", "/en", "/de/1?x#y", "/fr/", "?q=/en/", "#/fr/")]
    p = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    for r in url_filter.judge(p, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect():
        u = urls[r.page_id]
        rest = u.split("://", 1)[1] if "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].lower(), m[2]
        fits = [(len(k), k, v) for k, v in rules for h, _, q in [k.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + q)]
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2])


def test_secret_spans_and_owners(spark):
    live, copied = "ghp_A1b2C3d4E5f6G7h8I9j0", "sk-Live00Example00Example00"
    rows = [(i, f"x {copied} y", "en", f"s{i}", 0) for i in range(5)] + [(10, f"𝄞 key {live}; API_KEY: 'abcdefgh' AKIA123 AKIA1234567890AB {'0a' * 16}", "en", "s1", 0), (11, "token=short secret: api_key: abcdefgh", "en", "s2", 0)]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].spans == "" for i in range(5))  # five owners: an example
    text = rows[5][1]
    at = text.index(live)
    assert f"owned:{at}:{at + len(live)}" in got[10].spans and (got[10].n_assign, got[10].n_access, got[10].n_hex) == (1, 1, 1)
    assert f"access:{text.index('AKIA1234')}:{text.index('AKIA1234') + 16}" in got[10].spans
    assert got[11].n_assign == 0


def test_secret_spans_by_python(spark):
    rows = docs_of(spark, BIG)
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    pats = [(k, re.compile(p), g, n) for k, p, g, n in secret_scan.KINDS]
    for r in secret_scan.scan(rows).collect():
        spans = sorted((m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(pats) for m in p.finditer(texts[r.doc_id]) if len(m[g]) >= n)
        assert r.n_assign + r.n_access + r.n_hex == len(spans)
        import hashlib

        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def test_ledger_ablation_counts(spark):
    rows = quality_rules.ledger(docs_of(spark, BIG)).cache()
    bits = [r.failed for r in rows.collect()]
    mask = quality_rules.POLICIES["prose-1"]
    for r in quality_rules.ablation(rows, "prose-1").collect():
        bit = quality_rules.BIT[r.rule]
        assert r.n_failed == sum(b & bit != 0 for b in bits) and r.n_only == sum(b & mask == bit for b in bits)
        assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)
    base = quality_rules.apply_policy(rows, "base-1")
    assert base.where("kept").count() == sum(b & 3 == 0 for b in bits)


def test_line_dedup_ways_agree(spark, monkeypatch):
    docs = docs_of(spark, BIG)
    sent = sorted(repr(r) for r in line_dedup.dedup_lines(docs).collect())
    monkeypatch.setattr(line_dedup, "LINES_BOUND", -1)
    monkeypatch.setattr(line_dedup, "SEND_BOUND", -1)
    assert sorted(repr(r) for r in line_dedup.dedup_lines(docs).collect()) == sent


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(100 * k + i, f"line {k}\nown {k} {i}", "en", f"s{i}", 0) for k in range(1, 9) for i in range(k)]
    found = line_dedup.boilerplate(spark.createDataFrame(rows, SCHEMA), 5)
    assert found.count() == 4  # lines with 5, 6, 7 and 8 sites


def test_copies_do_not_make_boilerplate(spark):
    rows = [(i, "same text\nin all", "en", f"s{i}", 0) for i in range(30)]
    assert [r._removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()] == [0] * 30


def test_pipeline_keeps_clean_and_drops_planted(spark):
    import corpus_pipeline

    docs = docs_of(spark, BIG)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    out = {r.doc_id for r in corpus_pipeline.run(spark, BIG).collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and not r.toxic]
    assert sum(i in out for i in clean) / len(clean) > 0.8  # copies and leaks go too
    assert sum(i in out for i, r in labels.items() if r.quality == 0) / sum(r.quality == 0 for r in labels.values()) < 0.15
    leaked = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{BIG}/benchmark.parquet")).collect()}
    assert not leaked & out
