"""From raw documents to packed sequences: toxicity, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of ``docs``. ``run`` writes what a stage returns to the shared folder and reads it again for the next one; what a
stage has read and written on its way is deleted then.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import packing, quality, repeats, simhash, toxicity
from factorloom.llm.common import held_out, helpers, settled, stored
from factorloom.session import settings

TOXIC_FROM = 0.3
GOOD_FROM = 0.5
#: Near-duplicates: fingerprints of shingles of three words that differ in two bits at most.
SHINGLE, RADIUS = 3, 2
END_ID = 1
#: The tokenizer remembers no parts from one group of texts to the next, as workers live on through the stages.
KEPT_PARTS = 0


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3."""

    def stage() -> DataFrame:
        scores = toxicity.classify(docs, _labels(spark, sf_dir), "toxic", ~held_out("doc_id", 4, 2), keep=docs.columns)
        return scores.where(F.col("score") < TOXIC_FROM).select(*docs.columns)

    return settled(stage, spark, "mild")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""

    def stage() -> DataFrame:
        scores = quality.classify(docs, _labels(spark, sf_dir), "quality", ~held_out("doc_id", 3, 1), keep=docs.columns)
        return scores.where(F.col("score") >= GOOD_FROM).select(*docs.columns)

    return settled(stage, spark, "good")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        return simhash.one_of_each(docs, RADIUS, SHINGLE)  # the rest of its plan runs no Python


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that a document with a smaller id has; a text may end up empty."""

    def stage() -> DataFrame:
        rest = [c for c in docs.columns if c not in ("text", "n_chars")]
        out = repeats.dedup(docs, keep=rest, with_text=True)
        columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
        return out.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])

    return settled(stage, spark, "unrepeated")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, end_id=END_ID, kept_parts=KEPT_PARTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("simhash", drop_near_copies),
    ("repeats", drop_repeats),
    ("packing", pack_sequences),
]
#: The classifiers and the tokenizer have no form in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES:
        with helpers(spark) as written:
            docs = stored(stage(spark, docs, sf_dir), name)
            written += before
            before = [written.pop(-1 - len(before))]
    return docs
