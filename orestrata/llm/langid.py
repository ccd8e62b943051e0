"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary linear
classifier over hashed character n-grams (1 to 3) predicts it, and the language
whose codeword has the least weighted logistic loss against the predicted margins
is chosen. A second language almost as near marks the text as ambiguous.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
texts are read whole; languages that are null are not learnt; one learnt language
is always predicted with score 1 and none makes every text ``und``; ties go to
the language first in code point order; repeated rows are predicted alike; an
empty table gives no rows; a row without an id is predicted, not held out and never learnt;
other columns are kept by ``predict`` and never read, but those named like its results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orestrata.llm.common import cut, hash_63, small_batches, table

#: Characters of a text that are hashed at a time, so that a very long text needs bounded memory.
_BLOCK = 1 << 17


@dataclass(frozen=True)
class LangParams:
    """``sample_docs`` bounds the labelled training documents; every language gets an equal part of them, picked by a
    hash of their ids, so a rare language is learnt too, however many there are: one document of each at least. Codewords
    have ``bits`` bits for up to a thousand languages, and more where there are more (:func:`code_bits`)."""

    sample_docs: int = 3000
    bins_log2: int = 12
    bits: int = 24
    steps: int = 150
    ambiguous: float = 0.2
    seed: int = 7


PARAMS = LangParams()
_LETTER: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def ngram_counts(text: str | None, bins_log2: int) -> tuple[np.ndarray, int]:
    """Counts of hashed n-grams of a whole text, and its letters. What isn't a letter is one space."""
    out = np.zeros(1 << bins_log2)
    letters = 0
    x = (text or "").lower()
    shift = np.uint32(32 - bins_log2)
    for at in range(0, len(x), _BLOCK):
        c = np.frombuffer(x[max(0, at - 2) : at + _BLOCK].encode("utf-32-le", "replace"), dtype="<u4")
        ok = _letter_table()[np.minimum(c, 0x10FFFF)]
        letters += int(ok[min(2, at) :].sum())
        c = np.where(ok, c, 32).astype(np.uint32)
        keep = np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]
        c = c[keep]
        new = int(keep[: min(2, at)].sum()) if at else 0  # characters of the block before
        grams = [c[new:] * np.uint32(2654435761)]
        if len(c) > 1:
            two = c[:-1] * np.uint32(2246822519) + c[1:] * np.uint32(3266489917)
            grams.append(two[max(0, new - 1) :])
        if len(c) > 2:
            grams.append(c[:-2] * np.uint32(668265263) + c[1:-1] * np.uint32(374761393) + c[2:] * np.uint32(2869860233))
        for g in grams:
            g = (g ^ (g >> np.uint32(15))) * np.uint32(2246822519)
            out += np.bincount(g >> shift, minlength=1 << bins_log2)
    return out, letters


def features(text: str | None, bins_log2: int) -> tuple[np.ndarray, int]:
    """Square roots of n-gram shares: a vector of length 1."""
    n, letters = ngram_counts(text, bins_log2)
    return np.sqrt(n / max(1.0, n.sum())), letters


@dataclass(frozen=True)
class LangModel:
    languages: tuple[str, ...]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # bins + 1 x bits
    trust: np.ndarray  # of each bit
    bins_log2: int

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest codeword and shares of all languages, for rows of features."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        m = np.clip(margin, -30, 30)
        loss = (np.log1p(np.exp(-m)) * self.trust) @ (self.codes.T > 0) + (np.log1p(np.exp(m)) * self.trust) @ (self.codes.T < 0)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        return loss.argmin(axis=1), share


def codewords(k: int, bits: int, seed: int) -> np.ndarray:
    """Codes of ``k`` languages: bits that split them, chosen so that the least distance of two codewords is large."""
    if k < 2:
        return np.ones((k, 1))
    rng = np.random.default_rng(seed)
    best, best_least = None, -1.0
    for _ in range(50 if k <= 500 else 3):
        m = np.where(rng.random((k, bits)) < 0.5, -1.0, 1.0)
        flat = np.abs(m.sum(axis=0)) == k
        m[rng.integers(k), flat] *= -1
        g = m @ m.T - 2 * bits * np.eye(k)
        least = (bits - g.max()) / 2
        if least > best_least:
            best, best_least = m, least
    return best


def code_bits(k: int, bits: int) -> int:
    """Bits of a codeword of ``k`` languages: ``bits``, or six for each doubling of the languages where that is more."""
    return max(bits, 6 * math.ceil(math.log2(max(2, k)))) if k > 16 else bits


def training_rows(docs: DataFrame, p: LangParams = PARAMS) -> DataFrame:
    """``lang, text`` of the sample: of each language the documents with the least hashes.

    How many rows a language has is a table that is joined, so there may be any number of languages. Rows of common languages
    that lie far above the share that is wanted go before anything is sorted.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    known = known.withColumn("_l_h", hash_63("doc_id", F.length("text"), seed="lang"))
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("_l_n")))
    n = counts.count()
    quota = max(1, p.sample_docs // max(1, n))
    counts = F.broadcast(counts) if n <= 100_000 else counts
    # A 63-bit hash as a share of its range: twice the share that is wanted is looked at.
    share = F.col("_l_h") / F.lit(float(1 << 63))
    near = known.join(counts, "lang").where((F.col("_l_n") <= 2 * quota) | (share < 2 * quota / F.col("_l_n")))
    order = Window.partitionBy("lang").orderBy("_l_h")
    return near.withColumn("_l_k", F.row_number().over(order)).where(F.col("_l_k") <= quota).select("lang", "text")


def learn(docs: DataFrame, p: LangParams = PARAMS) -> LangModel:
    """Fit on ``sample_docs`` training rows at most. Tasks turn whole texts into sparse features; the
    driver gets those of the bounded sample."""
    small_batches(docs.sparkSession)
    sample = training_rows(docs, p)
    bins = p.bins_log2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(x.as_py(), bins) for x in b.column(1)]
            ok = [i for i, (_, letters) in enumerate(rows) if letters]
            at = [np.flatnonzero(rows[i][0]).astype(np.int32) for i in ok]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(ok, pa.int64())),
                    pa.array([a.tobytes() for a in at], pa.binary()),
                    pa.array([rows[i][0][a].astype(np.float32).tobytes() for i, a in zip(ok, at, strict=True)], pa.binary()),
                ],
                names=["lang", "at", "value"],
            )

    got = sample.mapInArrow(run, "lang string, at binary, value binary").collect()
    languages = tuple(sorted({r["lang"] for r in got}))
    x = np.zeros((len(got), 1 << bins), dtype=np.float32)
    y = np.zeros(len(got), dtype=int)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], dtype=np.int32)] = np.frombuffer(r["value"], dtype=np.float32)
        y[i] = languages.index(r["lang"])
    codes = codewords(len(languages), code_bits(len(languages), p.bits), p.seed)
    if len(languages) < 2:
        return LangModel(languages, codes, np.zeros(((1 << bins) + 1, 1)), np.ones(1), bins)
    w, trust = _fit(x, codes[y], p.steps)
    return LangModel(languages, codes, w, trust, bins)


def _fit(x: np.ndarray, t: np.ndarray, steps: int, pull: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions of all bits at once, by accelerated gradient steps; each bit is trusted by its accuracy."""
    n = len(x)
    w = np.zeros((x.shape[1] + 1, t.shape[1]))
    v = w.copy()
    rate = 4.0
    for k in range(steps):
        look = w + k / (k + 3) * (w - v)
        z = x @ look[:-1].astype(np.float32) + look[-1]
        r = -t / (1 + np.exp(np.clip(t * z, -30, 30))) / n
        g = np.vstack([x.T @ r.astype(np.float32), r.sum(axis=0)]) + pull * look
        v, w = w, look - rate * g
    right = ((x @ w[:-1].astype(np.float32) + w[-1]) * t > 0).mean(axis=0)
    return w, np.log((right * n + 1) / ((1 - right) * n + 1)) / np.log(n + 1)


def predict(docs: DataFrame, model: LangModel, ambiguous: float = PARAMS.ambiguous) -> DataFrame:
    """``docs`` (with ``text``) plus ``lang_pred``, ``lang_score`` and ``lang_ambiguous``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score", "lang_ambiguous")
    names = docs.columns
    at = names.index("text")
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_ambiguous", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            pred, score, unsure = [], [], []
            for lo in range(0, b.num_rows, 256):
                rows = [features(v.as_py(), m.bins_log2) for v in b.column(at).slice(lo, 256)]
                if not m.languages:
                    best, share = np.zeros(len(rows), dtype=int), np.zeros((len(rows), 1))
                else:
                    best, share = m.decode(np.array([f for f, _ in rows]))
                for (_, letters), i, s in zip(rows, best, share, strict=True):
                    if not letters or not m.languages:
                        pred.append("und")
                        score.append(0.0)
                        unsure.append(True)
                    else:
                        two = np.sort(s)[::-1]
                        pred.append(m.languages[i])
                        score.append(float(s[i]))
                        unsure.append(bool(len(two) > 1 and two[0] - two[1] < ambiguous))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=[f.name for f in schema.fields]
            )

    return docs.mapInArrow(run, schema)


def op6_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_ambiguous").alias("ambiguous"),
    )
