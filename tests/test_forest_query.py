"""The registered forest is the reference's size."""

import inspect

from orestrata.operators import forest
from orestrata.plans import terrain_queries


def test_query_trains_the_whole_forest(spark, sf_dir, monkeypatch):
    calls, sign = [], inspect.signature(forest.train)

    def train(*args, **kwargs):
        given = sign.bind(*args, **kwargs)
        given.apply_defaults()
        calls.append((given.arguments["trees"], given.arguments["depth"]))

    monkeypatch.setattr(forest, "train", train)
    assert terrain_queries.rf_grid_proba(spark, sf_dir).columns == ["row_id", "col_id", "proba"]
    assert calls == [(300, 30)]


def test_cross_validation_trains_whole_forests(spark, sf_dir, monkeypatch):
    calls, sign = [], inspect.signature(forest.train)

    def train(rows, *args, **kwargs):
        given = sign.bind(rows, *args, **kwargs)
        given.apply_defaults()
        calls.append((given.arguments["trees"], given.arguments["depth"], rows.rdd.getNumPartitions() > 1))

    monkeypatch.setattr(forest, "train", train)
    assert terrain_queries.spatial_cv(spark, sf_dir).count() == 0
    assert calls == [(300, 30, True)] * 5


def test_a_forest_in_parts_has_all_its_trees(spark, monkeypatch):
    """Each part draws anew, and the votes of all trees are counted."""
    rows = [(i // 20, i % 20, float(i % 20), float(i % 7), int(i % 20 > 9), i // 80) for i in range(400)]
    d = spark.createDataFrame(rows, "row_id int, col_id int, a double, b double, label int, block_id int")
    folds = spark.createDataFrame([(b, b % 5 + 1) for b in range(5)], "block_id int, fold int")
    calls, fit = [], forest.train

    def train(rows, columns, trees, depth, seed, **params):
        calls.append((trees, seed))
        return fit(rows, columns, trees, depth, seed, **params)

    monkeypatch.setattr(forest, "train", train)
    got = forest.spatial_cv(d, folds, 2, ("a", "b"), trees=7, depth=5, bagged=1200).collect()
    assert calls == [(3, 42), (3, 45), (1, 48)] * 2
    assert sorted((r.fold, r.label, r.support, r.f1) for r in got) == [(f, lab, 40, 1.0) for f in (1, 2) for lab in (0, 1)]


def test_a_fold_needs_no_medians_and_few_jobs(spark, monkeypatch):
    """Where all features are finite no median is looked for, and the folds are not made anew in each job."""
    rows = [(i, j, float(i % 7), float(j % 5), int((i + j) % 3 == 0), (i // 5) * 2 + j // 5) for i in range(10) for j in range(10)]
    d = spark.createDataFrame(rows, "row_id int, col_id int, a double, b double, label int, block_id int")
    folds = spark.createDataFrame([(b, b % 2 + 1) for b in range(4)], "block_id int, fold int")
    model = forest.train(d, ("a", "b"), 2, 2)
    got = forest.score(model, d, ("a", "b"), ["label"])
    assert got.columns == ["label", "proba"] and got.count() == 100
    monkeypatch.setattr(forest, "median", lambda *a: 1 / 0)
    report = {(r.fold, r.label): r.support for r in forest.spatial_cv(d, folds, 2, ("a", "b"), 2, 2).collect()}
    assert sum(report.values()) == 100 and {f for f, _ in report} == {1, 2}


def test_query_makes_its_features_once(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(forest, "train", lambda rows, *a: seen.append(rows))
    monkeypatch.setattr(forest, "score", lambda model, rows, *a: seen.append(rows) or rows.select("row_id", "col_id"))
    terrain_queries.rf_grid_proba(spark, sf_dir)
    assert len(seen) == 2 and not any("Exchange" in d._jdf.queryExecution().executedPlan().toString() for d in seen)
