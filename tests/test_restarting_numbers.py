"""Blocks are numbered anew on every page, samples in every document."""

from orestrata.operators import entities, exports, layout


def test_block_classes(spark):
    blocks = spark.createDataFrame([(1, 0, 500, 500, 40, 20), (2, 0, 500, 500, 40, 20), (2, 1, 10, 50, 40, 20)], "page_id long, block_ord long, x long, y long, w long, h long")
    tables = spark.createDataFrame([(1, 400, 700, 400, 700)], "page_id long, x_min long, x_max long, y_min long, y_max long")
    got = {(r.page_id, r.block_ord): r.text_type for r in layout.classes(blocks, tables).collect()}
    assert got == {(1, 0): "table", (2, 0): "paragraph", (2, 1): "header"}


def test_links_stay_in_their_document(spark):
    samples = spark.createDataFrame([(1, "S1", "taken at Alpha, S1"), (2, "S1", "nothing"), (3, "S1", None)], "doc_id long, sample_id string, source_text string")
    locations = spark.createDataFrame([(7, 1, "Alpha", "Alpha near S1"), (8, 2, "", "x" * 300 + "S1")], "location_id long, doc_id long, name string, source_text string")
    got = {(r.doc_id, r.sample_id): r.linked_id for r in entities.link_first(samples, locations).collect()}
    assert got == {(1, "S1"): 7, (2, "S1"): None, (3, "S1"): None}


def test_assays_stay_in_their_document(spark):
    samples = spark.createDataFrame([(1, "S1"), (2, "S1"), (3, "S1")], "doc_id long, sample_id string")
    assays = spark.createDataFrame([(1, "S1", 1, "Au", 2.0), (1, "S1", 2, "Ag", 4.0), (2, "S1", 1, "Au", 9.0)], "doc_id long, sample_id string, ord int, element string, value double")
    nested = exports.with_assays(samples, assays)
    assert {r.doc_id: [a.element for a in r.assays] for r in nested.collect()} == {1: ["Au", "Ag"], 2: ["Au"], 3: []}
    assert sorted((r.doc_id, r.sample_id, r.element) for r in exports.assays_table(nested).collect()) == [("1", "S1", "Ag"), ("1", "S1", "Au"), ("2", "S1", "Au")]
    assert sorted(tuple(r) for r in entities.assay_counts(assays).collect()) == [(1, "S1", 2), (2, "S1", 1)]
    assert sorted(tuple(r) for r in entities.pivot_elements(assays, ["Au"]).collect()) == [(1, "S1", 2.0), (2, "S1", 9.0)]


def test_row_groups_of_a_long_page(spark):
    rows = [(1, k, k * 10) for k in range(20_000)] + [(2, 5, 0), (2, 6, 49), (2, 7, 50)]
    got = layout.anchored_rows(spark.createDataFrame(rows, "page_id long, block_ord long, y long").repartition(3)).collect()
    assert {(r.page_id, r.block_ord): r.row_group for r in got} == {(1, k): k // 5 + 1 for k in range(20_000)} | {(2, 5): 1, (2, 6): 1, (2, 7): 2}
