"""The operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, attention, bpe, huffman, lines, multiindex, outliers, packing, quality, repeats, runs, simhash, toxicity
from .common import held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def verdicts(scores: DataFrame, kept_out, least: float) -> DataFrame:
    """doc_id, held_out, score and predicted of a classifier's scores."""
    predicted = F.when(F.col("score") >= least, 1).otherwise(0).cast("int")
    return scores.select("doc_id", kept_out.alias("held_out"), "score", predicted.alias("predicted"))


@register("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", 3, 1)
    return verdicts(quality.classify(documents(spark, sf_dir), labels(spark, sf_dir), "quality", ~out), out, 0.5)


@register("op2_huffman")
def op2_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return huffman.round_trip(documents(spark, sf_dir), path, end_id=2)


@register("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@register("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@register("op5_attention")
def op5_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return attention.score_documents(documents(spark, sf_dir), 7, 2, path, public_tokenizers.PATTERN)


@register("op7_outliers")
def op7_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.verdicts(documents(spark, sf_dir))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
least AS (SELECT g, min(doc_id) AS first_id FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + o AS k FROM windows JOIN least USING (g), (SELECT unnest(range(13)) AS o) WHERE doc_id > first_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS line, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@register("op8_repeats", OP8_SQL)
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup(documents(spark, sf_dir))


@register("op9_multiindex")
def op9_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return multiindex.search(vectors, vectors.where("vec_id % 100 = 0"))


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", 4, 2)
    return verdicts(toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir), "toxic", ~out), out, 0.3)


@register("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(documents(spark, sf_dir), path, end_id=1)


OP13_SQL = r"""
WITH lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id < keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (keeper IS NULL OR doc_id >= keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (key) GROUP BY doc_id
"""


@register("op13_lines", OP13_SQL)
def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir))


@register("op12_runs")
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(documents(spark, sf_dir), plant=runs.tail_repeats)


@register("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_documents(documents(spark, sf_dir), *paths)
