"""Toxicity and language identification restated in plain code, and the pipeline's stages against brute force."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from orestrata.llm import htmltext, langid, packing, quality, toxicity
from orestrata.llm.common import hash_63, sample, table
from pyspark.sql import functions as F

# --- samples


def test_samples_are_drawn_from_tables_of_any_size(spark):
    rows = spark.range(5000).withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string")))
    for n in (5000, 10**6, 10**12, 10**15):
        got = sorted(r["id"] for r in sample(rows, n, 300, "id", seed="s").collect())
        assert len(got) == 300
        assert got == sorted(r["id"] for r in sample(rows.repartition(7), n, 300, "id", seed="s").collect())
    least = [r["id"] for r in rows.orderBy(hash_63("id", seed="s")).limit(300).collect()]
    assert got == sorted(least)
    assert sample(rows, 3, 9000, "id", seed="s").count() == 5000 and sample(rows.limit(0), 0, 10, "id", seed="s").isEmpty()


def test_rare_languages_are_learnt(spark):
    """One row in 3000 of a language is enough, also where the table is said to be huge."""
    text = {"aa": "wo wa wi we", "bb": "xul xar xin xor", "cc": "qwe qwu qwi"}
    rows = [(i, text["cc" if i == 77 else "aa" if i % 2 else "bb"] + f" {i}", "cc" if i == 77 else "aa" if i % 2 else "bb") for i in range(3000)]
    docs = spark.createDataFrame([(i if zlib.crc32(str(i).encode()) % 4 != 2 else i + 3000, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    docs = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    p = langid.LangParams(sample_docs=90)
    assert langid.training_rows(docs, p).groupBy("lang").count().toPandas().set_index("lang")["count"].to_dict() == {"aa": 30, "bb": 30, "cc": 1}
    assert set(langid.learn(docs, p).languages) == {"aa", "bb", "cc"}


def test_thousands_of_languages(spark):
    """Every language is learnt, whatever their number: 5000, each with words of its own."""
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 5000).alias("lang"))
    docs = docs.withColumn("text", F.expr("concat_ws(' ', transform(sequence(1, 8), k -> translate(concat(lang, 'x', lang), '0123456789', 'abcdefghij')))"))
    rows = langid.training_rows(docs).groupBy("lang").count().collect()
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).select("lang").distinct().count()
    assert len(rows) == held > 4500 and all(r["count"] == 1 for r in rows)
    p = langid.LangParams(steps=2)
    model = langid.learn(docs, p)
    assert len(model.languages) == held and model.codes.shape[1] > p.bits
    assert langid.predict(docs.limit(300), model).where("lang_pred = 'und'").count() == 0


def test_html_trees_are_fitted_whatever_the_count(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").limit(40)
    model = htmltext.learn(pages)
    assert htmltext.extract(pages, model).where("length(main_text) > 0").count() > 30


# --- toxicity


def plain_fold(text):
    out = []
    for c in unicodedata.normalize("NFKD", (text or "").lower()):
        if not unicodedata.combining(c):
            out.append(toxicity.LOOK_ALIKES.get(c, c))
    ws = re.findall(r"[^\W\d_](?:[\w@$!]*\w)?|[\d@$!]+[^\W\d_]\w*", "".join(out))
    return ["".join(toxicity.SUBSTITUTES.get(c, c) for c in w) for w in ws]


def plain_features(words, weights, exceptions):
    """Each word's heaviest matching beginning, unless the word begins inside an exception phrase."""
    line = " " + " ".join(words)
    covered = set()
    for phrase in exceptions:
        at = line.find(" " + phrase)
        while at >= 0:
            covered |= set(range(at, at + len(phrase) + 1))
            at = line.find(" " + phrase, at + 1)
    total, at = 0.0, 0
    for w in words:
        # A term may go on over the next words, as the line is matched as a whole.
        best = max((x for t, x in weights.items() if line.startswith(" " + t, at)), default=0.0)
        total += 0.0 if at in covered else best
        at += len(w) + 1
    return total, min(toxicity.DENSEST, 100.0 * total / max(20, len(words)))


def test_toxicity_matching():
    rng = random.Random(1)
    weights = {"scum": 3.0, "scumb": 4.0, "trash": 2.5, "trash c": 1.0, "idio": 2.0, "clown": 3.5, "a": 0.25}
    m = toxicity.ToxicityModel(weights)
    vocabulary = ["scum", "Scumbag", "trash", "trash can", "trash bin", "ＴＲＡＳＨ", "1diot", "clown fish", "clown", "clown school", "clownfish", "аn", "an", "of", "x1", "$cum", "7rash,", "é", "sore loser", "12", "--"]
    for _ in range(500):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))
        words = plain_fold(text)
        got = m.features(toxicity.fold(text))
        assert got == pytest.approx(plain_features(words, weights, toxicity.EXCEPTIONS)), text
        z = m.curve[0] + m.curve[1] * math.log1p(got[0]) + m.curve[2] * got[1]
        assert m.score(toxicity.fold(text)) == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_lexicon_is_learnt_as_stated(spark):
    """Counts of beginnings, smoothed log odds and the choice of terms, on a small labelled corpus."""
    rng = random.Random(2)
    common = ["harbour", "morning", "weather", "garden", "letter"]
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        ws = [rng.choice(common) for _ in range(30)] + (["grumblefrotz", rng.choice(["zwickel", "zwicken"])] if bad else [])
        docs.append((i, " ".join(ws)))
        labels.append((i, 1, int(bad)))
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    known = [(t, lab) for (i, t), (_, _, lab) in zip(docs, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    n = {k: Counter(w[:j] for t, lab in known if lab == k for w in {w for w in t.split()} for j in range(4, min(10, len(w)) + 1)) for k in (0, 1)}
    n = {k: Counter({b: sum(any(w.startswith(b) for w in t.split()) for t, lab in known if lab == k) for b in n[k]}) for k in n}
    size = Counter(lab for _, lab in known)
    want = {t: 3.0 for t in toxicity.SEED_TERMS}
    for t in sorted(n[1], key=lambda t: (len(t), t)):
        w = n[1][t] / (n[1][t] + 4) * (math.log((n[1][t] + 0.5) / (size[1] + 1)) - math.log((n[0][t] + 0.5) / (size[0] + 1)))
        if n[1][t] >= 5 and w >= 2 and n[0][t] <= n[1][t] / 4 and w > max([want[t[:k]] for k in range(4, len(t)) if t[:k] in want], default=0) + 0.5:
            want[t] = min(w, 8.0)
    assert model.weights == pytest.approx(want) and {"grum", "zwic"} <= set(want)


def test_many_exceptions_take_linear_time():
    import time

    m = toxicity.ToxicityModel({"trash": 3.0})
    took = []
    for n in (4000, 16000):
        text = toxicity.fold("trash can and trash. " * n)
        t = time.perf_counter()
        assert m.features(text)[0] == pytest.approx(3.0 * n)
        took.append(time.perf_counter() - t)
    assert took[1] < 10 * took[0]


# --- language identification


def plain_ngrams(text, bins_log2):
    """Hashed n-grams of letters, with one space for what isn't a letter."""
    x = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    mask, out = (1 << 32) - 1, Counter()
    for k, factors in ((1, (2654435761,)), (2, (2246822519, 3266489917)), (3, (668265263, 374761393, 2869860233))):
        for i in range(len(x) - k + 1):
            g = sum(ord(c) * f for c, f in zip(x[i : i + k], factors, strict=True)) & mask
            out[((g ^ (g >> 15)) * 2246822519 & mask) >> (32 - bins_log2)] += 1
    return out


def test_language_ngrams_and_decoding():
    rng = random.Random(3)
    for _ in range(100):
        text = "".join(rng.choice("abcxyzÄß日 ,.19\n") for _ in range(rng.randint(0, 80)))
        got, letters = langid.ngram_counts(text, 8)
        assert {i: int(n) for i, n in enumerate(got) if n} == plain_ngrams(text, 8) and letters == sum(c.isalpha() for c in text)
    r = np.random.default_rng(3)
    codes = langid.codewords(5, 12, 1)
    m = langid.LangModel(("a", "b", "c", "d", "e"), codes, r.normal(size=(33, 12)), r.random(12), 5)
    x = r.random((40, 32))
    best, share = m.decode(x)
    for i in range(40):
        margins = [sum(x[i, k] * m.weights[k, j] for k in range(32)) + m.weights[32, j] for j in range(12)]
        loss = [sum(m.trust[j] * math.log(1 + math.exp(-margins[j] * codes[k][j])) for j in range(12)) for k in range(5)]
        assert best[i] == min(range(5), key=lambda k: loss[k])
        total = sum(math.exp(-v) for v in loss)
        assert share[i] == pytest.approx([math.exp(-v) / total for v in loss])


def test_codewords_differ_in_many_bits():
    for k in (2, 4, 10, 40):
        codes = langid.codewords(k, 24, 7)
        assert min(int((codes[i] != codes[j]).sum()) for i in range(k) for j in range(i)) >= (7 if k <= 10 else 3)
        assert (np.abs(codes.sum(axis=0)) < k).all()


# --- pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, target string, n string"


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = [" ".join(word() for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", ["web", "books", None][i % 3]) for i, t in enumerate(prose)]
    rows += [(100 + i, prose[i], "en", "web") for i in range(10)]  # copies
    rows += [(200 + i, prose[20 + i] + " and some words more", "en", "web") for i in range(10)]  # near copies
    rows += [(300 + i, prose[i] + " you stupid idiot, you worthless scum, pathetic loser", "en", "web") for i in range(5)]
    rows += [(7, prose[7], "en", "web"), (7, prose[7], "en", "web"), (None, prose[39] + " " + word(), "de", None), (401, None, None, None), (402, "", "en", "web"), (403, " \t\n", "en", "web"), (404, "short", "en", "web")]
    rows += [(405, " ".join(word() for _ in range(9000)), "en", "books")]
    return [(*r, len(r[1] or ""), "k", "t", "n") for r in rows]


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}


def test_pipeline_stages_in_order(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf, kept, seen = str(tmp_path), docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf)
        if k < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{k}")
            out = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name], kept = out.collect(), out
    ids = {name: Counter(r["doc_id"] for r in rows) for name, rows in seen.items()}
    # Toxic documents go and no others.
    assert ids["toxicity"] == Counter(r[0] for r in corpus() if r[0] is None or not 300 <= r[0] < 400)
    # The base rules reject texts without words enough; here no line is frequent.
    plain = Counter(r["doc_id"] for r in seen["toxicity"] if len((r["text"] or "").split()) >= quality.RULES.min_words)
    assert ids["quality rules"] == plain
    # One of each group of near copies stays: no pair is left, and what went is like something that stayed.
    left = [shingles(r["text"]) for r in seen["simhash near-dedup"]]
    like = lambda a, b: len(a & b) / len(a | b) >= 0.8
    assert not any(like(a, b) for i, a in enumerate(left) for b in left[:i])
    assert all(any(like(shingles(r["text"]), b) for b in left) for r in seen["quality rules"])
    assert ids["simhash near-dedup"] == Counter([*range(40), 405])
    # The mix takes whole copies and parts in the order of the words.
    words = {}
    for r in seen["simhash near-dedup"]:
        words[r["doc_id"]] = r["text"].split()
    for r in seen["mixing sources"]:
        part, rest = r["text"].split(), iter(words[r["doc_id"]])
        assert part and all(w in rest for w in part) and r["n_chars"] == len(r["text"])
    # Packing: the tokenizer's ids of all mixed rows, gapless in sequences.
    tokenizer = packing.word_ids().tokenizer
    want = Counter()
    for r in seen["mixing sources"]:
        t = tokenizer.encode(r["text"], add_special_tokens=False).ids + [1]
        for at in range(0, len(t), 4096):
            part = t[at : at + 4096]
            want[r["doc_id"], at // 4096, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    got = seen["best-fit packing"]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 4096 and len(sequences) == -(-sum(sequences.values()) // 4096)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
