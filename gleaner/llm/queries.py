"""The registered query of each operator and, where SQL can express it, its DuckDB oracle.

A query applies its operator with production parameters to the whole table and
returns the whole result. Paths of public tokenizer files are parameters; the
queries take the installed ``public_tokenizers`` package's.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import (
    cuckoo_index,
    isolation_rules,
    licenses,
    merkle_manifest,
    pair_counts,
    order_minhash,
    sentence_pieces,
    sign_hash,
    site_lines,
    site_quality,
    source_mix,
    token_orc,
    toxic_terms,
)
from gleaner.llm.lineage import scratch

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; a local session's workers learn where this package is (a cluster's get it by --py-files)."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        sc.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, paths)]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return site_lines.clean(docs, ratio=site_lines.TEXT_RATIO, per_text=True, n_lines="n_lines",
                            n_dropped="n_dropped").drop("source")


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site rates, score and decision of every document."""
    return site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = table(spark, sf_dir, "documents")
    return sentence_pieces.digests(
        sentence_pieces.encode_decode(docs, tokenizer("piece_bpe_32k.model")))


def op4_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    return isolation_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sign_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return sign_hash.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return source_mix.mix(table(spark, sf_dir, "documents"))


def op7_toxic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxic_terms.score(docs, toxic_terms.fit(docs, table(spark, sf_dir, "labels")))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the ORC files."""
    path = scratch(spark, "tokens")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=2)
    files = spark.read.orc(path)
    return token_orc.placed(token_orc.with_crc(files), files).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every document in the manifest of its source."""
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"), merkle_manifest.without_breaks())


def op12_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers over every document, with the corpus's counts of the linked ids."""
    return pair_counts.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"),
                             tokenizer("piece_bpe_32k.model"))


def op13_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return cuckoo_index.dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_site_lines, op2_site_quality, op3_sentence_pieces, op4_isolation_rules, op5_sign_hash,
    op6_source_mix, op7_toxic_terms, op8_order_minhash, op9_token_orc, op10_licenses,
    op11_merkle_manifest, op12_pair_counts, op13_cuckoo_dedup)}

ORACLES: dict[str, str] = {
    "op1_site_lines": site_lines.ORACLE,
    "op11_merkle_manifest": merkle_manifest.ORACLE,
    "op13_cuckoo_dedup": cuckoo_index.ORACLE,
}
