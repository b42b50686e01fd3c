"""A training-data pipeline over ``documents``: five stages, each one operator of ``gleaner.llm``.

``run`` applies the stages in order; between stages the rows are written as
Parquet under the session's ``spark.checkpoint.dir`` and read again, which cuts
the lineage. Every stage takes (spark, docs, sf_dir); all but the last return
the columns of ``documents``.

Defined cases, as the operators have them: NULL texts count as empty (the quality
rules reject texts without words, so they go in the first stage where labels teach
it to); rows that share id and text stay apart until near-dedup, which keeps one
of them; rows without id are near nothing and stay; a NULL source is one source;
empty tables pass through every stage; columns of other names, also such as the
operators use themselves, are carried along up to the last stage, which returns
ids and decoded text; texts are whole in every stage, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import order_minhash, queries, sentence_pieces, site_lines, site_quality, source_mix
from gleaner.llm.lineage import scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from the labelled ones among them."""
    return site_quality.keep_good(docs, queries.table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines on many distinct texts of its source; ``n_chars`` follows the text."""
    return site_lines.clean(docs, ratio=site_lines.TEXT_RATIO, per_text=True).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return order_minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole documents, as often as their source's quota takes them."""
    return source_mix.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document of the mix."""
    return sentence_pieces.encode_decode(docs, queries.tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("site_quality", keep_good),
    ("site_lines", drop_boilerplate),
    ("order_minhash", drop_near_copies),
    ("source_mix", mix_sources),
    ("sentence_pieces", encode),
]

#: SQL has no classifier, alignment or tokenizer; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last one."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = scratch(spark, "corpus")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
