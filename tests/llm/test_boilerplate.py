"""Boilerplate lines leave the texts that the pipeline's quality stage hands on."""

import corpus_pipeline
import pytest
from orestrata.llm import quality


def corpus(spark, size, shared):
    """``size`` documents of one source; ``shared`` of them hold the same notice."""
    rows = []
    for i in range(size):
        own = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{chr(97 + k)}{chr(97 + j)}" for j in range(15)) for k in range(2)]
        text = "\n".join([own[0], *(["  A shared Notice 12 of the site "] if i < shared else []), "", own[1]])
        rows.append((i, text, "en", "web", len(text)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def handed_on(spark, docs, sf_dir):
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = corpus_pipeline.with_quality(spark, docs, sf_dir).collect()
    assert len(after) == len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    return before, {r["doc_id"]: r["text"] for r in after}


def test_flagged_lines_are_removed(spark, sf_dir):
    before, after = handed_on(spark, corpus(spark, 60, 40), sf_dir)
    assert after == {i: "\n".join(s for s in t.split("\n") if "Notice" not in s) for i, t in before.items()}
    assert after[0].count("\n") == 2


@pytest.mark.parametrize("broadcast", [quality.BROADCAST_LINES, 0])
def test_a_large_source_has_no_higher_limit(spark, sf_dir, monkeypatch, broadcast):
    """Eight percent of a source's documents are as many as forty percent of a smaller one's."""
    monkeypatch.setattr(quality, "BROADCAST_LINES", broadcast)
    small = corpus(spark, 60, 24)
    large = corpus(spark, 300, 24).selectExpr("doc_id + 1000 as doc_id", "text", "lang", "'large' as source", "n_chars")
    before, after = handed_on(spark, small.unionByName(large), sf_dir)
    assert sum("Notice" in t for t in before.values()) == 48 and not any("Notice" in t for t in after.values())
    assert all(len(after[i]) == len(t) for i, t in before.items() if "Notice" not in t)


def test_planted_boilerplate_and_depleted_documents(spark, tmp_path):
    """The registered query takes planted lines out of the count and rejects the documents that they leave depleted, as its SQL does."""
    from oracle import rows

    import duckdb

    letters = str.maketrans("0123456789", "abcdefghij")  # digits are alike in a line's key
    prose = lambda i, n: " ".join(f"w{i}x{j}".translate(letters) for j in range(n))
    notice = "All of our 31 shops are open on every day of the week but one, ask for the 12 best offers of the season"
    docs = [(i, f"{prose(i, 40)}\n{notice}", "web") for i in range(30)]
    docs += [(100 + i, f"{notice}\n{prose(i, 5)}\n{notice.replace('31', '77').upper()}", "web") for i in range(4)]  # depleted
    docs += [(200 + i, f"{prose(900, 40)}\nthe same page again", "web") for i in range(50)]  # copies of one text
    docs += [(300 + i, f"{prose(i, 40)}\n{notice}", None) for i in range(15)]  # another host, below the limit
    docs += [(400 + i, f"{prose(800 + i % 6, 40)}\nsix texts four times each", "six") for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = quality.op3_line_frequency(spark, str(tmp_path))
    r = {x["doc_id"]: x for x in got.collect()}
    assert all(r[i]["kept"] and r[i]["n_words"] - r[i]["n_words_left"] == len(notice.split()) for i in range(30))
    assert not any(r[100 + i]["kept"] for i in range(4)) and r[100]["n_words_left"] == 5 and not r[100]["base_failed"]
    assert all(r[200 + i]["kept"] and r[200 + i]["n_words"] == r[200 + i]["n_words_left"] for i in range(50))
    assert all(r[300 + i]["n_words"] == r[300 + i]["n_words_left"] for i in range(15))
    assert all(r[400 + i]["n_words"] - r[400 + i]["n_words_left"] == 5 for i in range(24))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(quality.OP3_SQL)
    assert rows([d[0] for d in want.description], want.fetchall()) == rows(got.columns, [tuple(x) for x in got.collect()])
