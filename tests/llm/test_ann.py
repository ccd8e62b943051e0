"""Search against brute force: recall, exact scores, copies, and defined cases."""

import numpy as np
import pytest
from orestrata.llm import ann
from pyspark.sql import functions as F


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = (x * x[ids == q][0]).sum(axis=1)
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = list(ids[keep][order])
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_scores(spark, sf):
    """Recall on every size of the given tables, with cells that queries don't look into."""
    t = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    pdf = t.toPandas().drop_duplicates("vec_id")
    pdf = pdf[[v is not None and len(v) == 64 for v in pdf.embedding]]
    x, ids = np.stack(pdf.embedding.to_numpy()).astype(float), pdf.vec_id.to_numpy()
    classes = ann.classes_of(ann.valid(t), 20)
    book, probes = ann.codebook(classes, classes.count(), ann.PARAMS)
    assert 1 < probes < len(book.centres)
    got = ann.op4_anisotropic_search(spark, sf).toPandas()
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    at = {i: n for n, i in enumerate(ids)}
    hit = sum(len(set(want[q]) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hit >= 0.9 * sum(map(len, want.values()))
    for r in got.head(200).itertuples():
        assert abs(r.score - float((x[at[r.query_id]] * x[at[r.vec_id]]).sum())) < 1e-12
    assert (got.groupby("query_id")["rank"].max() == got.groupby("query_id").size()).all()


def test_table_scan_adds_up_the_codes():
    """The scan of packed codes gives the inner products with the quantised residuals."""
    rng = np.random.default_rng(3)
    for d in (9, 16):
        x, q = rng.normal(size=(70, d)), rng.normal(size=(5, d))
        book = ann.fit(x, 4)
        cell = book.cells_of(x)
        codes = book.encode(x, cell, 4.0)
        packed = np.stack([np.frombuffer(ann._pack(c), dtype=np.uint8) for c in codes])
        plain = [[sum(float(ann._pairs(q[i : i + 1])[0, m] @ book.points[m, c[m]]) for m in range(len(c))) for i in range(5)] for c in codes]
        assert np.allclose(book.scan(packed, book.tables(q)), plain, atol=1e-4)


def test_anisotropic_codes_keep_scores_better():
    """Codes fitted with the parallel error weighed up have less of it than plain nearest points."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16))
    book = ann.fit(x, 4)
    cell = book.cells_of(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    along = {}
    for eta in (1.0, 4.0):
        code = book.encode(x, cell, eta)
        near = book.points[np.arange(len(book.points))[None], code].reshape(len(x), -1) + book.centres[cell]
        along[eta] = (((x - near) * u).sum(axis=1) ** 2).mean()
    assert along[4.0] < along[1.0]


@pytest.mark.parametrize("kind", ["near", "tight", "long", "apart"])
def test_recall_on_other_rows(spark, kind):
    """Rows that share a code, tight clusters, few long vectors that a sample misses, and queries unlike the other rows."""
    rng = np.random.default_rng(2)
    g, c = rng.normal(size=(6000, 16)), rng.normal(size=(20, 16))
    x = {"near": c[rng.integers(20, size=6000)] + 1e-6 * g, "tight": c[rng.integers(20, size=6000)] + 0.01 * g, "long": g * np.exp(2 * rng.normal(size=(6000, 1))), "apart": np.where((np.arange(6000) % 20 == 0)[:, None], 3 - g, g)}[kind]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(d, F.col("vec_id") % 20 == 0, ann.AnnParams(sample=1000)).toPandas()
    want = brute(np.arange(6000), x, range(0, 6000, 20), 20)
    hit = sum(len(set(want[q]) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_many_cells_and_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 9))
    x[300:340] = x[5]  # copies: ties go to the lesser id
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    p = ann.AnnParams(root_share=1.0, block_rows=16, block_queries=7, batch_queries=3, coverage=1.0, rerank=40, k=20)
    got = ann.search(d, F.col("vec_id") % 20 == 0, p).orderBy("query_id", "rank").toPandas()
    want = brute(np.arange(600), x, range(0, 600, 20), 20)
    assert {q: list(g.vec_id) for q, g in got.groupby("query_id")} == want


def test_one_vector_many_times(spark):
    """A vector that a third of all rows share is one class; the ids of its copies are cut before they meet."""
    rows = [(i, [1.0, 0.5] if i % 3 else [float(i), 1.0]) for i in range(3000)]
    d = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>")
    c = {tuple(r["v"]): list(r["ids"]) for r in ann.classes_of(ann.valid(d), 4).collect()}
    assert c[1.0, 0.5] == [1, 2, 4, 5, 7] and len(c) == 1001


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (1, [0.0, 0.0], "a"), (2, None, "a"), (3, [float("nan"), 1.0], "a"), (4, [0.5, None], "a"), (5, [2.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (6, [1.0, 2.0, 3.0], "a"), (7, [], "a")]
    clash = ["cell", "v", "ids", "h", "block", "turn", "kind", "codes", "rank", "score"]
    d = spark.createDataFrame([(*r[:2], *[r[2]] * len(clash)) for r in rows], "vec_id long, embedding array<double>, " + ", ".join(f"{c} string" for c in clash))
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(d, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 5, 2.0)]
    assert ann.search(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0
