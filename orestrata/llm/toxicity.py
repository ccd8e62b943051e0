"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding takes case, accents, look-alike letters of other scripts and digits or
signs that stand for letters back to plain letters. The lexicon holds word
beginnings that labelled toxic documents use far more often than labelled clean
ones, weighted by their smoothed log odds, next to a short fixed list. Hits that
lie inside an exception phrase don't count. The sum of the weights, absolute and
by length, goes through a logistic curve fitted on the same sample.

Defined cases: a null, empty or wordless text has no hit and gets the score of
none; texts are matched whole; repeated rows are scored alike; labels whose
toxic is null, or whose document is absent, are not learnt from, and a document
with several labels counts once for each; without a single label of each kind
the fixed list alone is used with its standard curve; an empty table gives no
rows; a row without an id is scored, not held out and never learnt; columns other than
``doc_id`` and ``text`` are kept by ``score`` and never read, but one named
``toxicity_score`` is replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orestrata.llm.common import cut, sample, small_batches, table

# Letters of other scripts and signs that are drawn like Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
# Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Insults known beforehand, as word beginnings.
SEED_TERMS = ["idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown"]
# Phrases in which such a word is no insult.
EXCEPTIONS = ["trash can", "trash bin", "trash collection", "clown fish", "clownfish", "clown school", "sore loser", "stupid question", "stupid mistake"]

#: The sum per 100 words counts up to here, in fitting and in scoring.
DENSEST = 50.0

_WORD = re.compile(r"[^\W\d_](?:[\w@$!]*\w)?|[\d@$!]+[^\W\d_]\w*")
_FOLD_CHARS = str.maketrans(LOOK_ALIKES)
_FOLD_SIGNS = str.maketrans(SUBSTITUTES)
_MARKED = re.compile(r"[\d@$!]")


def fold(text: str | None) -> str:
    """The words of a text in plain letters, each with one space before it, and a space at the end."""
    x = unicodedata.normalize("NFKD", (text or "").lower())
    if not x.isascii():
        x = "".join(c for c in x if not unicodedata.combining(c)).translate(_FOLD_CHARS)
    ws = _WORD.findall(x)
    return " " + " ".join(w.translate(_FOLD_SIGNS) if _MARKED.search(w) else w for w in ws) + " " if ws else " "


@dataclass(frozen=True)
class ToxicityModel:
    """Word beginnings with their weights, and the curve: b0 + b1 * ln(1 + sum) + b2 * sum per 100 words."""

    weights: dict[str, float]
    curve: tuple[float, float, float] = (-4.0, 3.0, 0.5)
    exceptions: tuple[str, ...] = tuple(EXCEPTIONS)
    _automaton: list = field(default_factory=list, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": []}

    def automaton(self):
        if not self._automaton:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(" " + term, (len(term) + 1, w))
            for phrase in self.exceptions:
                a.add_word(" " + phrase, (len(phrase) + 1, None))
            if len(a):
                a.make_automaton()
            self._automaton.append(a)
        return self._automaton[0]

    def features(self, folded: str) -> tuple[float, float]:
        """The weights of all words that match (the heaviest match of a word counts), and that sum per 100 words."""
        a = self.automaton()
        if not len(a):
            return 0.0, 0.0
        spans, found = [], {}
        for end, (n, w) in a.iter(folded):
            at = end - n + 1
            if w is None:
                spans.append((at, end))
            else:
                found[at] = max(w, found.get(at, 0.0))
        spans.sort()
        total, i, reach = 0.0, 0, -1
        for at, w in sorted(found.items()):
            while i < len(spans) and spans[i][0] <= at:  # of the phrases that have begun, how far the farthest goes
                reach = max(reach, spans[i][1])
                i += 1
            total += w if at > reach else 0.0
        return total, min(DENSEST, 100.0 * total / max(20, folded.count(" ") - 1))

    def score(self, folded: str) -> float:
        total, dense = self.features(folded)
        z = self.curve[0] + self.curve[1] * math.log1p(total) + self.curve[2] * dense
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


@dataclass(frozen=True)
class ToxicityParams:
    """``sample_docs`` bounds the labels that are learnt from (picked by a hash of their ids), and with them the
    lexicon: a term of it begins words of ``min_docs`` toxic documents of the sample at least."""

    sample_docs: int = 8000
    min_docs: int = 5
    prefix: tuple[int, int] = (4, 10)
    min_weight: float = 2.0
    threshold: float = 0.3


PARAMS = ToxicityParams()


def _sample(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> DataFrame:
    """``sample_docs`` labelled training rows with ``text`` and ``toxic``. Held-out rows never enter.

    The labels of absent documents are left out before the sample is drawn, which looks at ids alone; a document
    whose id comes several times is learnt from once for each label."""
    known = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).select("doc_id", "toxic")
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = sample(known, known.count(), p.sample_docs, "doc_id", "toxic", seed="toxicity")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(picked, "doc_id").select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, p: ToxicityParams = PARAMS) -> ToxicityModel:
    """Fit lexicon and curve. Counting is distributed; the driver gets the terms of several of the bounded sample's
    documents (with two counts each) and three numbers for each of them."""
    small_batches(docs.sparkSession)
    seen = cut(_sample(docs, labels, p))
    size = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    fixed = {t: 3.0 for t in SEED_TERMS}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(fixed)
    lo, hi = p.prefix

    def prefixes(folded: str, of: set[str] | None = None) -> set[str]:
        out = set()
        for w in set(folded.split()):
            for k in range(lo, min(hi, len(w)) + 1):
                if of is None or w[:k] in of:
                    out.add(w[:k])
        return out

    def counted(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], names=["term", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                c.update(prefixes(fold(x.as_py())))
        yield counted(c)

    toxic = (
        seen.where("toxic = 1").select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= p.min_docs)
    )
    in_toxic = {r["term"]: r["n"] for r in toxic.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(set(in_toxic))

    def count_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for x in b.column(0):
                c.update(prefixes(fold(x.as_py()), shared.value))
        yield counted(c)

    clean = seen.where("toxic = 0").select("text").mapInArrow(count_known, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    in_clean = {r["term"]: r["n"] for r in clean.collect()}

    def weight(t: str) -> float:
        """Log odds, drawn to zero for terms that few documents hold."""
        return in_toxic[t] / (in_toxic[t] + 4) * (math.log((in_toxic[t] + 0.5) / (n1 + 1)) - math.log((in_clean.get(t, 0) + 0.5) / (n0 + 1)))

    weights = dict(fixed)
    # Short beginnings first: a longer one is kept only if it tells more than the kept one that it goes on from.
    for t in sorted(in_toxic, key=lambda t: (len(t), t)):
        w = weight(t)
        if w < p.min_weight or in_clean.get(t, 0) > in_toxic[t] / 4:
            continue
        above = max((weights[t[:k]] for k in range(lo, len(t)) if t[:k] in weights), default=0.0)
        if w > above + 0.5:
            weights[t] = min(w, 8.0)
    model = ToxicityModel(weights)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = [held.value.features(fold(x)) for x in b["text"]]
            yield pd.DataFrame({"total": [a for a, _ in f], "dense": [d for _, d in f], "toxic": b["toxic"]})

    measured = seen.mapInPandas(measure, "total double, dense double, toxic int").toPandas()
    return ToxicityModel(model.weights, _fit_curve(measured))


def _fit_curve(seen: pd.DataFrame) -> tuple[float, float, float]:
    """Logistic regression on two features by Newton's steps, with a weak pull of the slopes to zero."""
    x = np.c_[np.ones(len(seen)), np.log1p(seen["total"]), seen["dense"]]
    y = seen["toxic"].to_numpy(float)
    b, pull = np.zeros(3), np.diag([1e-6, 0.5, 0.5])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (q - y) + pull @ b
        h = (x * (q * (1 - q))[:, None]).T @ x + pull
        b = b - np.linalg.solve(h, g)
    return (float(b[0]), float(max(0.0, b[1])), float(max(0.0, b[2])))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity_score``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(fold(x)) for x in texts], dtype="float64")

    return docs.withColumn("toxicity_score", of(F.col(text)))


def op5_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= PARAMS.threshold).cast("int").alias("predicted"),
    )
