"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.

1. quality rules: documents that fail a count or the calibrated classifier go;
2. SimHash near-dedup: of each group of texts whose sets of five-word shingles are 0.8 alike the document with the least id stays;
3. PII: entities are replaced by surrogates under the session's key, and n_chars follows the text;
4. mixing: every document stays, those of small sources up to twice, by temperature weights;
5. BPE: token ids of the whole text, and whether they decode to it.

Cases: texts that are null, empty or of fewer than ten words go in stage 1; rows with a null id are kept, and of rows alike in id
and text one is; very long texts are read whole by every stage; null languages, sources and counts stay null; columns
that ``documents`` has besides go along through stages 1 to 4, whatever their names, but for ``epoch`` and ``place``, which
mixing replaces and drops; an empty table stays empty.  SQL can't express stages 1 to 3 and 5; tests/llm/test_pipeline.py
holds each stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, pii, quality_rules, simhash
from tessera.llm.queries import read
from tessera.runtime import Stored

MAX_REPEATS = 2.0
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grown = docs.withColumn("__n", F.length("text"))
    out = pii.pseudonymise(grown, pii.session_key(spark))
    return out.withColumn("n_chars", F.coalesce(F.col("n_chars") + F.length("text") - F.col("__n"), F.col("n_chars"))).drop("__n")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, max_repeats=MAX_REPEATS).drop("epoch", "place")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    out = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), vocabulary)
    return out.select("doc_id", "lang", "source", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("pii surrogates", surrogates), ("source mixing", mixed), ("bpe encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the ``documents`` of ``sf_dir``; a stage's table goes once the next one's is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        made = Stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            before.drop()
        docs, before = made.df, made
    return docs
