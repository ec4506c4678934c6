"""Nulls, empty and very long texts, copies, empty tables, clashing columns: every operator and stage."""

import pytest
from given import DATA

import corpus_pipeline
from tickledger.llm import decontaminate, html_extract, line_dedup, mixing, near_dup, periodic_runs, quality_classifier, quality_rules, secret_scan, substring_dedup, token_counts, tokenizer_alignment, url_filter


def labels(spark, rows=((1, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 0), (4, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def bench(spark, rows=((1, "word3 and3 word4 and4 word5 and5 word6 and6 word7 and7 word8 and8. word9 and9"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def vocabulary(name="byte_bpe_50k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


OPERATORS = {
    "mix": lambda spark, d: mixing.mix(d),
    "leaks": lambda spark, d: decontaminate.leaks(d, bench(spark)),
    "classify": lambda spark, d: quality_classifier.classify(d, labels(spark)),
    "tokens": lambda spark, d: token_counts.count_tokens(d, vocabulary()),
    "groups": lambda spark, d: near_dup.groups(d),
    "secrets": lambda spark, d: secret_scan.scan(d),
    "rules": lambda spark, d: quality_rules.apply_policy(quality_rules.ledger(d), "prose-1"),
    "lines": lambda spark, d: line_dedup.dedup_lines(d, 2),
    "alignment": lambda spark, d: tokenizer_alignment.align_tokens(d, vocabulary(), vocabulary("piece_bpe_32k.model")),
    "repeats": lambda spark, d: substring_dedup.cut_repeats(d),
    "runs": lambda spark, d: periodic_runs.runs(d),
}
PER_ROW = set(OPERATORS) - {"leaks"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_table(spark, odd, clash, none, name):
    run = OPERATORS[name]
    got = run(spark, odd)
    plain = sorted(map(repr, got.collect()))
    if name in PER_ROW:
        assert len(plain) == odd.count()
    own = [c for c in got.columns]
    other = run(spark, clash)
    assert sorted(repr(tuple(r[c] for c in own)) for r in other.select(*own).collect()) == sorted(repr(tuple(r[c] for c in own)) for r in got.collect())
    assert run(spark, none).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, odd, clash, none, name, stage):
    last = name == "mixing"
    for docs in (odd, clash, none):
        got = stage(spark, docs, DATA)
        if not last:
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
        n = got.count()
        assert n <= docs.count()
    assert n == 0


def test_labels_missing_or_of_one_class(spark, odd):
    assert all(r.kept for r in quality_classifier.classify(odd, labels(spark, ())).collect())
    assert all(r.kept for r in quality_classifier.classify(odd, labels(spark, ((1, 1, 0), (2, 1, 0)))).collect())


def test_benchmark_empty(spark, odd):
    assert decontaminate.leaks(odd, bench(spark, ())).count() == 0
    assert decontaminate.clean(odd, bench(spark, ())).count() == odd.count()


def test_pages(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://a.net", "<p>x"), (3, "http://a.net", "<p>x"), (None, "HTTP://B.Org/fr/?a=1", "<main>é&amp;&nbsp;b</main>"), (4, "http://x.org/" + "y" * 100_000, "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    more = pages.selectExpr("*", "1 as tokens", "2 as host", "3 as low", "4 as row", "5 as best")
    for run, n in ((lambda p: html_extract.extract(p), 6), (lambda p: url_filter.judge(p, labels(spark)), 6)):
        a, b = run(pages).collect(), run(more).collect()
        assert sorted(map(repr, a)) == sorted(map(repr, b)) and len(a) == n
        assert run(pages.limit(0)).collect() == []
    texts = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert texts == {1: "", 2: "", 3: "x", None: "é& b", 4: "deep"}
    urls = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels(spark)).collect()}
    assert urls[1] == urls[2] == ("", "", None, "allow")
    assert urls[3] == ("a.net", "", None, "allow") and urls[None] == ("b.org", "/fr/", "org/fr/", "allow")
