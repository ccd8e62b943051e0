"""Operators without SQL against plain code: clusters of points, and new rows of a rare class."""

import numpy as np

from orestrata.operators import forest, layout


def test_table_clusters(spark):
    xy = [(0, 0), (10, 0), (0, 10), (10, 10), (10, 10), (99, 99), (100, 0), (150, 20), (500, 500), (510, 500), (500, 510)]
    rows = [(1, x, y, i, 0) for i, (x, y) in enumerate(xy)] + [(2, x, 900 + x, x, 1) for x in range(0, 400, 20)]
    got = layout.table_clusters(spark.createDataFrame(rows, "page_id long, x long, y long, h_ord long, v_ord long")).orderBy("page_id", "table_no").collect()

    def plain(points):
        left, out = list(dict.fromkeys(points)), []
        while left:
            group = {p for p in left if max(abs(p[0] - left[0][0]), abs(p[1] - left[0][1])) < 100}
            left = [p for p in left if p not in group]
            out += [group] * (len(group) >= 4)
        return out

    want = [(p, k + 1, len(g), min(x for x, _ in g), max(y for _, y in g)) for p in (1, 2) for k, g in enumerate(plain([r[1:3] for r in rows if r[0] == p]))]
    assert [(r.page_id, r.table_no, r.n_points, r.x_min, r.y_max) for r in got] == want


def test_smote(spark):
    rows = [(i, 0, float(i % 17), float(i % 5), int(i < 30)) for i in range(200)] + [(900, 0, float("nan"), 1.0, 1)]
    d = spark.createDataFrame(rows, "row_id int, col_id int, a double, b double, label int")
    for bucket_rows in (2000, 8):
        got = forest.smote(d, ("a", "b"), bucket_rows=bucket_rows).toPandas()
        assert (got.label == 0).sum() == (got.label == 1).sum() == 170
        new = got[got.label == 1]
        assert new.a.between(0, 16).all() and new.b.between(0, 4).all()
    assert forest.smote(d.where("label = 0"), ("a", "b")).count() == 170
    assert forest.smote(d.limit(0), ("a", "b")).count() == 0


def test_table_clusters_of_many_pages_and_batches(spark):
    """Pages that end within batches, that span several, and points that repeat under other numbers."""
    rng = np.random.default_rng(6)
    rows = [(int(p), int(x), int(y), i, int(v)) for i, (p, x, y, v) in enumerate(zip(rng.integers(0, 9, 1500) ** 2, rng.integers(0, 50, 1500) * 9, rng.integers(0, 400, 1500), rng.integers(0, 3, 1500)))]
    rows += [(r[0], r[1], r[2], 5000 - r[3], r[4]) for r in rows[:700]]
    want = []
    for page in sorted({r[0] for r in rows}):
        left, k = list(dict.fromkeys(r[1:3] for r in sorted(rows, key=lambda r: r[3:]) if r[0] == page)), 0
        while left:
            group = [p for p in left if max(abs(p[0] - left[0][0]), abs(p[1] - left[0][1])) < 100]
            left = [p for p in left if p not in group]
            if len(group) >= 4:
                k, xs, ys = k + 1, [p[0] for p in group], [p[1] for p in group]
                want.append((page, k, len(group), min(xs), max(xs), min(ys), max(ys), len(set(ys)), len(set(xs))))
    d = spark.createDataFrame(rows, "page_id long, x long, y long, h_ord long, v_ord long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("7", "100000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert [tuple(r) for r in layout.table_clusters(d).orderBy("page_id", "table_no").collect()] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "FlatMapGroupsInPandas" not in layout.table_clusters(d)._jdf.queryExecution().executedPlan().toString()  # no call for each page


def test_shares_of_a_page_are_exact(spark):
    """63 paragraphs of 90 are no more than seven tenths, and two blocks of one number are judged each by its place."""
    d = spark.createDataFrame([(1, "paragraph")] * 63 + [(1, "header")] * 27 + [(2, "paragraph")] * 64 + [(2, "header")] * 26, "page_id long, text_type string")
    assert {r.page_id: r.structure for r in layout.page_structure(d).collect()} == {1: "mixed", 2: "text_heavy"}
    blocks = spark.createDataFrame([(1, 0, 500, 500, 40, 20), (1, 0, 10, 500, 40, 20)], "page_id long, block_ord long, x long, y long, w long, h long")
    tables = spark.createDataFrame([(1, 400, 700, 400, 700)], "page_id long, x_min long, x_max long, y_min long, y_max long")
    assert sorted(r.text_type for r in layout.classes(blocks, tables).collect()) == ["paragraph", "table"]
