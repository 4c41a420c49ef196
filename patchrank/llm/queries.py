"""The registered queries: each applies its operator to its whole table and derives the digest columns."""
from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from patchrank.llm import bpe, chat, decontam, grace, jaccard, language, merkle, periodic, quality, secrets, sql, substring, urls, vectors
from patchrank.llm.common import table
from patchrank.llm.registry import ORACLES, QUERIES, query


@query("op1_secret_scan", sql.SECRETS)
def secret_scan(spark, sf):
    return secrets.digests(table(spark, sf, "documents"))


@query("op2_substring_dedup", sql.SUBSTRINGS)
def substring_dedup(spark, sf):
    return substring.digests(table(spark, sf, "documents"))


@query("op3_bpe")
def bpe_round_trip(spark, sf):
    return bpe.digests(table(spark, sf, "documents"), corpus_pipeline.vocabulary())


@query("op4_quality_classifier")
def quality_classifier(spark, sf):
    return quality.predictions(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op5_language_id")
def language_id(spark, sf):
    return language.predictions(table(spark, sf, "documents"))


@query("op6_decontamination", sql.DECONTAM)
def decontamination(spark, sf):
    return decontam.digests(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_ngram_jaccard", sql.JACCARD)
def ngram_jaccard(spark, sf):
    return jaccard.classes_of(table(spark, sf, "documents"), width=3, percent=90)


@query("op8_url_filter", sql.URLS)
def url_filter(spark, sf):
    return urls.verdicts(table(spark, sf, "pages"))


@query("op9_embedding_dedup", sql.VECTORS)
def embedding_dedup(spark, sf):
    return vectors.classes_of(table(spark, sf, "embeddings"))


@query("op10_chat_format", sql.CHAT)
def chat_format(spark, sf):
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint"), "id", F.when(F.col("id") == 0, F.lit("user")).otherwise("assistant"), F.lit(said))
    return chat.read_back(chat.format_turns(rows.union(extra)))


@query("op11_exact_dedup", sql.COPIES)
def exact_dedup(spark, sf):
    return grace.digests(table(spark, sf, "documents"))


@query("op12_merkle_manifest", sql.MERKLE)
def merkle_manifest(spark, sf):
    return merkle.digests(table(spark, sf, "documents"))


@query("op13_periodic_runs")
def periodic_runs(spark, sf):
    return periodic.digests(table(spark, sf, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


def registry() -> tuple[dict, dict]:
    """(queries, SQL) of this package and of the pipeline."""
    return dict(QUERIES), dict(ORACLES)
