"""The registered queries of the training-text operators, with SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelwarrant.llm import ann_tree, bpe, collocations, decontam, html_layout, licences, line_dedup, periodic, quality, simhash, substring_dedup, token_store, toxicity

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(fn: Builder) -> Builder:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, words=3, bits=3).select("doc_id", "fingerprint", "component_id")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every document and benchmark item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.scan(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the positions of those that go, and a digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_lines", F.size(F.split("text", "\n")))
    done = line_dedup.dedup_lines(docs, similarity=0.8, removed="removed")
    return done.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~out))
    scored = toxicity.score(docs, model, drop_text=True)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~out))
    scored = quality.score(docs, model, drop_text=True)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_tree.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and licence: how many of its units (whole text, paragraphs, lines) are that licence's text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs).groupBy("doc_id", "licence").agg(F.count("*").alias("units"), F.max("whole").alias("whole_text"))


ORACLES["op2_licences"] = licences.oracle()


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids to files of the shared folder, and reports what is read back from them."""
    folder = token_store.new_folder(spark)
    token_store.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read(spark, folder).withColumnRenamed("id", "doc_id")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.find(docs, plant=periodic.planted).drop("runs", "collapsed")


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35).drop("spans")


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLES["op12_collocations"] = collocations.oracle()


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
