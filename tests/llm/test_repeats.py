"""Suffix-array dedup against a plain scan of all windows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from orestrata.llm import repeats as R

SCHEMA = "doc_id long, text string"


def plain(rows, width=100):
    """What stays and what goes, for rows of (doc_id, text) in their order."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            w = hashlib.md5(raw[i : i + width]).digest()
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def digest(df):
    rows = df.select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"), F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted(((r[0], tuple(r)[1:]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def expected(rows):
    return sorted(((r[0], x) for r, x in zip(rows, plain(rows))), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def words(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passages = [words(rng, 60) for _ in range(4)]
    rows = []
    for k in range(120):
        parts = [words(rng, rng.randint(0, 80)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            i = rng.randint(0, 150)
            parts.insert(rng.randint(0, len(parts)), p[i : i + rng.randint(60, 300)])
        rows.append((k, rng.choice(["", " ", "\n"]).join(parts)))
    rows += [(200, passages[0] * 3), (201, "-" * 700), (202, "ab" * 400), (203, "x" + "-" * 90), (204, None), (205, ""), (206, rows[5][1]), (207, rows[5][1] + "!"), (208, rows[6][1]), (209, "é" * 99)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_scan(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert digest(R.without_repeats(df)) == expected(rows)


def test_grams_of_many_snippets(spark):
    """Shards of two snippets, so that windows have to be looked up across shards."""
    rng = random.Random(3)
    passage = words(rng, 30)[:150]
    rows = [(k, words(rng, 12) + passage[k % 3 : 120 + k % 7] + words(rng, 12)) for k in range(40)] + corpus(4)[60:]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert digest(R.without_repeats(df, shard_snippets=2)) == expected(rows)


def test_given_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = sorted(tuple(r) for r in R.op12_suffix_array_dedup(spark, sf_dir).collect())
    assert got == [(r[0], *x) for r, x in zip(rows, plain(rows))]
    assert any(r[2] for r in got)


def test_defined_cases(spark, tmp_path):
    text = words(random.Random(5), 50)
    # Equal rows: one is the first. Null ids come last, so both of theirs go.
    rows = [(7, text), (7, text), (None, text), (None, text + "?"), (None, None), (8, ""), (9, text[:99]), (10, "\x00" * 150)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as doc", "2 as p", "3 as n", "'x' as kept", "4 as last")
    got = digest(R.without_repeats(df.repartition(3)))
    n = len(text.encode())
    assert [(i, x[:3]) for i, x in got] == sorted([(7, (n, 0, 0)), (7, (n, n, 1)), (8, (0, 0, 0)), (9, (len(text[:99].encode()), 0, 0)) if len(text[:99].encode()) < 100 else (9, (len(text[:99].encode()), len(text[:99].encode()), 1)), (10, (150, 50 + 99, 1))]) + [(None, (0, 0, 0)), (None, (n, n, 1)), (None, (n + 1, n, 1))]
    assert R.without_repeats(df.limit(0)).count() == 0


def test_long_text(spark):
    """Texts longer than a block, and a passage across a block's edge."""
    rng = random.Random(6)
    long = words(rng, 160_000)
    edge = R._BLOCK
    rows = [(1, long), (2, words(rng, 50) + long[edge - 3000 : edge + 2000])]
    assert len(long.encode()) > R._BLOCK
    df = spark.createDataFrame(rows, SCHEMA)
    assert digest(R.without_repeats(df)) == expected(rows)
