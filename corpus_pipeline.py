"""From raw documents to packed training ids, in five stages.

Each stage takes the documents its predecessor kept and returns documents of the same columns; the last
returns where each document lies in the id files. ``run`` writes every stage's result to the shared
folder before the next reads it, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkcurate.llm import bagminhash, decontaminate, mixing, quality, tokenids
from sparkcurate.session import new_path, store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed votes of the quality rules keep."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates."""
    return bagminhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix asks for, up to three times."""
    return mixing.remix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as packed ids in files; returns each document's place in them."""
    import public_tokenizers

    path = new_path(spark, "token-ids")
    tokenids.write_ids(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenids.read_documents(spark, path)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Components, embeddings and tokenizers are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
