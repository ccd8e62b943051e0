"""A caller's own list of texts."""

import os

import pytest
from orestrata.llm import licenses


def test_lines_of_a_callers_list_are_found(spark):
    docs = spark.createDataFrame([(1, "prose\nUse this as you like, anyone!\nprose"), (2, "prose")], "doc_id long, text string")
    got = licenses.scan(docs, texts=[("OWN", "Use this as you like, anyone.")]).orderBy("doc_id").collect()
    assert [list(r["_l_notices"]) for r in got] == [["OWN"], []]


COMMON = "/usr/share/common-licenses"
FILES = [
    ("Apache-2.0", "Apache-2.0"), ("CC0-1.0", "CC0-1.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"),
    ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("BSD-3-Clause", "BSD"),
]


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="the system has no folder of licences")
def test_entire_long_licences_are_known(spark):
    """Digests are those of the texts, whatever their case, punctuation, line breaks and copyright lines."""
    texts = [(n, open(f"{COMMON}/{f}", encoding="utf-8", errors="replace").read()) for n, f in FILES]
    rows = [(i, form) for i, (_, t) in enumerate(texts) for form in (t, "Copyright (c) 2019 A. Nother\n" + t.upper() if "copyright" not in t[:200].lower() else t, t.replace(",", " ,"))]
    rows += [(90 + i, t + "\nand a word more") for i, (_, t) in enumerate(texts)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert r["_l_license"] == (texts[r["doc_id"]][0] if r["doc_id"] < 90 else None), (r["doc_id"], r["text"][:80])


def test_short_texts_of_the_list(spark):
    rows = [(i, f"Copyright Jane Doe\nCopyright 2001, 2004 The Doe Company\n{t}") for i, (_, t) in enumerate(licenses.TEXTS)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["_l_license"] for r in got] == [n for n, _ in licenses.TEXTS]


def test_running_text_about_copyright_stays(spark):
    texts = ["Copyright law is old.", "Copyright Law is old.", "copyright holders may ask", "Copyright 2020 Jane", "(c) a list's third item", "© 1999 Jane", "Copyright by Jane", "Copyright The Doe Company"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(licenses.canonical(licenses.F.col("t"))).collect()
    assert [r[0] for r in got] == ["copyright law is old", "copyright law is old", "copyright owners may ask", "", "c a list s third item", "", "", ""]


def test_lines_without_a_usual_word_are_found(spark):
    own = [("FREE", "Free for any use, no strings attached."), ("OWN", "Sublicence at will")]
    docs = spark.createDataFrame([(1, "a\n -- FREE for any use; no strings attached\nb"), (2, "sub-license at will!"), (3, "free for any use")], "doc_id long, text string")
    got = licenses.scan(docs, texts=own).orderBy("doc_id").collect()
    assert [list(r["_l_notices"]) for r in got] == [["FREE"], ["OWN"], []]
    assert licenses.scan(docs, texts=[]).where("size(_l_notices) > 0 or _l_license is not null").count() == 0


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="the system has no folder of licences")
def test_long_licences_on_one_line_are_notices(spark, tmp_path):
    """A whole licence in one line of a text, by the query and by its SQL."""
    from oracle import compare

    texts = [open(f"{COMMON}/{f}", encoding="utf-8", errors="replace").read() for _, f in FILES]
    bodies = [licenses_without_holders(t) for t in texts]
    rows = [(i, f"before\n{' '.join(b.split())}\nafter") for i, b in enumerate(bodies)] + [(90, "x " * 800)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.notices for r in licenses.op10_license_digest(spark, str(tmp_path)).collect()}
    assert sum(bool(x) for x in got.values()) >= 6 and got[90] == ""
    assert got[[n for n, _ in FILES].index("MPL-2.0")] == "MPL-2.0"
    os.mkdir(f"{tmp_path}/in")
    spark.read.parquet(f"{tmp_path}/documents.parquet").toPandas().to_parquet(f"{tmp_path}/in/documents.parquet")
    for t in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations".split():
        spark.range(1).toPandas().to_parquet(f"{tmp_path}/in/{t}.parquet")
    assert compare(spark, licenses.op10_license_digest, licenses.OP10_SQL, f"{tmp_path}/in") == ""


def licenses_without_holders(text):
    return "\n".join(s for s in text.split("\n") if not s.strip().lower().startswith(("copyright (c)", "all rights reserved", "copyright ©")))
