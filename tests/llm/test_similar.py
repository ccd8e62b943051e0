"""The near-dedup stage of the pipeline against the similarity of all pairs."""

import random

import corpus_pipeline
from orestrata.llm import similar


def plain(text):
    ws = text.lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}


def alike(a, b):
    a, b = plain(a), plain(b)
    return len(a & b) >= 0.8 * len(a | b)


def near_copies():
    """Texts of about 100 words and copies of them with 1 to 4 other words (similarity 0.66 to 0.9), and one large group."""
    r = random.Random(7)
    word = lambda: f"w{r.randrange(10**6)}"
    bases = [[word() for _ in range(100)] for _ in range(40)]
    texts = [" ".join(b) for b in bases]
    for i, b in [*enumerate(bases), *[(1, bases[0])] * 60]:
        c = list(b)
        for at in r.sample(range(5, 95), 1 + i % 4):
            c[at] = word()
        texts.append(" ".join(c))
    return texts


def test_no_similar_documents_stay(spark, sf_dir):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for d in (corpus_pipeline.one_of_each_group(spark, docs, sf_dir), similar.one_of_similar(docs, shard_rows=8)):
        kept = {r["doc_id"] for r in d.collect()}
        assert not [(a, b) for a in kept for b in kept if a < b and alike(texts[a], texts[b])]
        # Only what is similar goes: each lost text has a less similar one of a lower id.
        assert all(any(alike(t, texts[k]) for k in range(i)) for i, t in enumerate(texts) if i not in kept)
        assert set(range(40)) <= kept


def test_similar_odd_rows(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (2, "other words than those above here")]
    got = similar.one_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(2, "a b c d e f"), (2, "other words than those above here"), (3, None)]
    assert similar.one_of_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
