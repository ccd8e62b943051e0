"""The cases that the docstrings define: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from orestrata.llm import htmltext, langid, licenses, mixing, packing, quality, simhash, toxicity, urls

CLASH = ["size", "source_size", "target", "taken", "n_words", "kept", "score", "predicted", "held_out", "lang_pred", "lang_score", "toxicity_score", "fp", "component_id", "length", "key", "path", "cell", "license", "host", "rule", "verdict", "rank", "main_text"]
LONG = "ein langer satz ohne ende " * 40_000
TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "12345 !?"), (5, LONG), (6, "the same words"), (6, "the same words"), (7, "the same words"), (None, "the nameless text")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "de" if t == LONG else "en", "web", len(t or ""), *["x"] * len(CLASH)) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))


def table_of(spark, tmp_path, **tables):
    for name, d in tables.items():
        d.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_all_document_queries_keep_every_row(spark, docs, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    queries = [mixing.op1_sainte_lague_mix, simhash.op2_simhash_bk_tree, quality.op3_line_frequency, toxicity.op5_toxicity_lexicon, langid.op6_language_ecoc, licenses.op10_license_digest]
    for d, n in ((docs, len(TEXTS)), (docs.limit(0), 0)):
        sf = table_of(spark, tmp_path / str(n), documents=d, labels=labels)
        for q in queries:
            assert q(spark, sf).count() == n, q.__name__
        got = packing.op7_exact_complement_packing(spark, sf)
        assert got.where("piece = 0").count() == n


def test_results_keep_clashing_columns(docs):
    """Columns named like a query's digest columns stay; those named like an operator's results are replaced."""
    assert {"target", "source_size"} <= set(mixing.mix(docs).columns)
    assert mixing.mixed_texts(docs).select("target").distinct().count() == 1
    assert quality.judge(docs).select("n_words", "kept").count() == len(TEXTS)
    p = langid.predict(docs, langid.learn(docs))
    assert p.columns.count("lang_pred") == 1 and p.select("score").distinct().count() == 1
    s = toxicity.score(docs, toxicity.ToxicityModel({"scum": 3.0}))
    assert s.columns.count("toxicity_score") == 1 and s.count() == len(TEXTS)
    assert licenses.scan(docs).select("license").distinct().count() == 1


def test_language_cases(spark, docs):
    got = langid.predict(docs, langid.learn(docs)).select("doc_id", "text", "lang_pred", "lang_score").collect()
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert r["lang_pred"] != "und" or r["lang_score"] == 0
    nothing = langid.learn(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    one = langid.learn(docs.where("lang = 'en'"))
    known = [r for r in langid.predict(docs, one).collect() if r["lang_pred"] != "und"]
    assert all(r["lang_pred"] == "en" and r["lang_score"] == 1 for r in known)


def test_long_texts_are_counted_whole():
    """The blocks in which a long text is read leave no seam."""
    whole, _ = langid.ngram_counts(LONG, 12)
    block, langid._BLOCK = langid._BLOCK, 1 << 30
    try:
        again, _ = langid.ngram_counts(LONG, 12)
    finally:
        langid._BLOCK = block
    assert abs(whole - again).sum() <= 3 * (len(LONG) // block + 1)


def test_toxicity_folding_and_exceptions():
    m = toxicity.ToxicityModel({"scum": 3.0, "trash": 3.0})
    clean = m.score(toxicity.fold("a plain sentence about harbours"))
    assert clean == m.score(toxicity.fold(None)) == m.score(toxicity.fold(""))
    for said in ("you SCUM", "you \u0455cum", "you 5cum", "you $cum", "you scúm"):
        assert m.score(toxicity.fold(said)) > 0.3 > clean, said
    assert m.score(toxicity.fold("put it in the trash can")) == clean
    assert m.score(toxicity.fold("put it in the trash can, trash")) > clean
    assert m.score(toxicity.fold("word " * 200_000 + "scum")) > clean


def test_licence_of_whole_texts_and_lines(spark):
    mit = licenses.TEXTS[0][1]
    rows = [(1, "Copyright (c) 2020 Someone\n" + mit.upper()), (2, mit.replace(",", "") + " and more"), (3, "prose\nLicensed under CC BY 4.0\nprose"), (4, None), (5, "...")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["_l_license"] for i in range(1, 6)] == ["MIT", None, None, None, None]
    assert list(got[3]["_l_notices"]) == ["CC-BY-4.0"] and got[4]["_l_text_digest"] is None and got[5]["_l_text_digest"] is None


def test_url_cases(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://EXAMPLE.org/es/x?y"), (4, "http://example.org/en/12"), (5, "http://a.b.com/fr/1#z"), (6, "x://com/de/"), (7, "http://notexample.org/es/"), (8, "http://other.net"), (8, "http://other.net"), (9, "http://")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")).collect()}
    assert [got[i]["_u_rule"] for i in range(1, 10)] == [None, None, "example.org/es/", "example.org/en/1", "com/fr/", "com/de/", "org/", None, None]
    assert (got[3]["_u_host"], got[3]["_u_path"], got[3]["_u_verdict"]) == ("example.org", "/es/x", "block")
    assert got[1]["_u_host"] == got[2]["_u_path"] == got[9]["_u_host"] == ""
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty).count() == 0


def test_packing_places_every_length():
    """Any histogram: all pieces are used, no sequence overflows, and few sequences are taken."""

    @settings(max_examples=60, deadline=None)
    @given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
    def run(counts):
        plan = packing.plan_patterns(counts, 40)
        used = {}
        for p in plan:
            assert 0 < sum(n * k for n, k in p.items) <= 40 and p.times > 0
            for n, k in p.items:
                used[n] = used.get(n, 0) + k * p.times
        assert used == counts
        least = -(-sum(n * c for n, c in counts.items()) // 40)
        large = sum(c for n, c in counts.items() if n > 20)
        assert sum(p.times for p in plan) <= 1.3 * max(least, large) + 1

    run()


def test_ids_are_the_tokenizers():
    enc = packing.word_ids()

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(), st.text(alphabet="abcXYZéßÀñ日<|>! .,'\n\t\u00a0\u2028\u0301-_/09")))
    def run(text):
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        got = enc.of_text(text)
        assert zlib.crc32(got) == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in want)), text

    run()


def test_fingerprint_blocks_leave_no_seam():
    text = " ".join(str(i * 7919 % 10007) for i in range(3 * 1000))
    whole = simhash.fingerprint(text)
    block, simhash._BLOCK = simhash._BLOCK, 64
    try:
        assert simhash.fingerprint(text) == whole
    finally:
        simhash._BLOCK = block


def test_html_without_pages_to_learn_from(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    model = htmltext.learn(none)
    page = spark.createDataFrame([(1, "u", "<p>text</p>", "x"), (2, None, None, "x"), (2, None, None, "x")], "page_id long, url string, html string, main_text string")
    assert [r["main_text"] for r in htmltext.extract(page, model).collect()] == ["", "", ""]
    assert htmltext.extract(none, model).count() == 0


def test_one_of_each_group_where_ids_repeat(spark):
    """Rows of one id with different texts are told apart; of equal rows one stays."""
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (1, "quite another text with other words"), (2, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, "a text of no id at all here")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "a text of no id at all here"), (1, "alpha beta gamma delta"), (1, "quite another text with other words")]
