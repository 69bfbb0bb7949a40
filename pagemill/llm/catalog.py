"""Registered queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import alignment, clusters, embeddings, minhash, mixing, packing, personal, phrases, quality, rules, sharding, suffixes, toxicity
from pagemill.llm.common import table

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    """The public byte-level vocabulary of the packing and alignment queries."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    """The public sentence-piece vocabulary of the alignment query."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of at most 2,048 tokens."""
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer_path())


@query
def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """The shard of every document, by the permutation-filled table."""
    return sharding.assign_shards(table(spark, sf, "documents").select("doc_id")).select("doc_id", "slot", "shard")


@query
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rule counts and the cascade's verdict for every document."""
    return rules.measure(table(spark, sf, "documents"))


@query
def op9_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words taken of every document by the weighted mix of sources."""
    return mixing.mix_documents(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Class and representative of every document."""
    return minhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id", "kept")


@query
def op10_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


@query
def op4_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document by the line field."""
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without its repeated 200-byte strings."""
    return suffixes.remove_repeats(table(spark, sf, "documents")).drop("kept_bytes")


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document by the factorization machine."""
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op3_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data spans of every document."""
    return personal.extract(table(spark, sf, "documents"))


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Groups, links and pair counts of every document under two tokenizers."""
    return alignment.align_corpus(table(spark, sf, "documents"), tokenizer_path(), piece_model_path())


@query
def op12_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after five exact rounds."""
    return clusters.cluster_vectors(table(spark, sf, "embeddings"))


@query
def op11_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document that lie in windows of the benchmark, and the items they are from."""
    return phrases.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
