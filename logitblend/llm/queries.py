"""The registered queries of this folder: each operator over its whole table, with the
parameters for production, and SQL where SQL can say it."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logitblend.llm import (
    decontam,
    licences,
    mixing,
    neighbours,
    oracles,
    products,
    quality,
    ranking,
    sharding,
    simhash,
    substring,
    suffixes,
    toxicity,
    whitening,
)
from logitblend.llm.common import table, written


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.hits(docs, table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return found.select(F.col("row.doc_id").alias("doc_id"), *decontam.contamination(found))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = written(quality.statistics(docs, keep=("doc_id",)), "statistics")
    model = quality.fit(quality.labelled(stats, labels, allowed=~quality.held_out()))
    return quality.scored(stats, model).select(
        F.col("row.doc_id").alias("doc_id"),
        quality.held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.into_shards(docs).select(
        "doc_id",
        sharding.record_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.fit(toxicity.sample(docs, labels, allowed=~toxicity.held_out()))
    return toxicity.scored(docs, field, keep=("doc_id",)).select(
        F.col("row.doc_id").alias("doc_id"),
        toxicity.held_out("row.doc_id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.transform("spans", lambda s: s["start"]).alias("span_starts"),
    )


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: the path is host and path of the URL, the lines are the runs of text
    between tags, and a page with a notice for its title is a licence file."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"),
        F.regexp_replace("html", "<[^>]*>", "\n").alias("text"),
        F.col("html").rlike("(?i)<title>[^<]*licen[cs]e").alias("speaks"),
    )
    found = licences.scan(pages, "path", "text", "speaks", keep=("page_id", "path"))
    return found.select(
        F.col("row.page_id").alias("page_id"),
        F.col("row.path").alias("path"),
        "licence",
        "cosine",
        "inherited_from",
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicated(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("words").alias("n_words"),
        F.col("removed").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicated(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("bytes").alias("n_bytes"),
        F.col("removed").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.neighbours(rows, F.col("vec_id") % 100 == 0)


def op11_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return products.highest(rows, F.col("vec_id") % 20 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), keep=("vec_id",))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranking.ranked(docs, table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py``, beside the package."""
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_decontamination,
        op3_quality,
        op4_sharding,
        op5_mixing,
        op6_toxicity,
        op7_licences,
        op8_substring_dedup,
        op9_suffix_array_dedup,
        op10_neighbours,
        op11_products,
        op12_whitening,
        op13_ranking,
        pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op2_decontamination": oracles.DECONTAMINATION,
    "op7_licences": oracles.LICENCES,
    "op8_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op9_suffix_array_dedup": oracles.SUFFIX_ARRAY_DEDUP,
    "op11_products": oracles.PRODUCTS,
    "op13_ranking": oracles.RANKING,
}
