"""The corpus pipeline: what a training corpus goes through, stage by stage.

Each stage works on all that the one before kept and returns the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orestrata.llm import mixing, packing, quality, similar, simhash, toxicity
from orestrata.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon (op5) rejects go. It is learnt from the labelled rows of ``docs``."""
    model = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("toxicity_score") < toxicity.PARAMS.threshold).select(*docs.columns)


def with_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules (op3) reject go; the others go on without their boilerplate lines."""
    kept = quality.judge(docs, quality.CORPUS_RULES).where("_q_kept")
    n = F.when(F.col("_q_left") < F.col("_q_n_words"), F.length("_q_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumns({"n_chars": n, "text": F.col("_q_text")}).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (op2) stays, and of those, one of each group of 0.8 similarity in 5-word shingles."""
    return similar.one_of_similar(simhash.one_of_each(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights (op1): documents come as often, or in such parts, as the mix takes them."""
    return mixing.mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents in sequences of 4096 tokens (op7)."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", with_quality),
    ("simhash near-dedup", one_of_each_group),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: SQL has no XXH64, no tokenizer and no learnt lexicon; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
