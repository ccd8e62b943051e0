"""New rows lie between a row and one of its nearest of the whole class, however large the class is."""

import numpy as np
from orestrata.operators import forest


def test_neighbours_are_those_of_the_whole_class(spark):
    r = np.random.default_rng(3)
    few = r.random((120, 2)) * 1000
    rows = [(i, 0, float(a), float(b), 1) for i, (a, b) in enumerate(few)] + [(i, 1, 0.5, 0.5, 0) for i in range(400)]
    got = forest.smote(spark.createDataFrame(rows, "row_id int, col_id int, a double, b double, label int"), ("a", "b"), k=3, bucket_rows=20).where("label = 1").toPandas()
    assert len(got) == 400
    apart = ((few[:, None] - few[None]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    near = np.argsort(apart, axis=1)[:, :3]
    start, way = np.repeat(few, 3, axis=0), few[near.ravel()] - np.repeat(few, 3, axis=0)
    for p in got[["a", "b"]].to_numpy():
        t = np.clip(((p - start) * way).sum(axis=1) / (way**2).sum(axis=1), 0, 1)
        assert (np.abs(start + t[:, None] * way - p).max(axis=1)).min() < 1e-6


def test_neighbours_in_cells(spark):
    """Clusters, a third of all rows alike, and rows far off: the distances are those of brute force."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(0, 1, (150, 3)), r.normal(50, 0.1, (80, 3)), np.full((120, 3), 7.0), [[1e6, 0, 0], [-1e6, 5, 5]]])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(3)
    got = forest.neighbours(d, ("a", "b", "c"), ("id",), 4, bucket_rows=16, sample_rows=100).toPandas()
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    assert len(got) == 4 * len(x)
    for i, g in got.sort_values("_nth").groupby("id"):
        assert np.allclose(g["_apart"], np.sort(apart[i])[:4]), i
        assert np.allclose(((g[["_o_a", "_o_b", "_o_c"]].to_numpy() - x[i]) ** 2).sum(axis=1), g["_apart"])
