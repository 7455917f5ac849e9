"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcurate.llm import (
    bagminhash, decontaminate, langid, lexical, licenses, mixing, neighbours, pii, quality, substring, tokenids, urls, whitening,
)
from sparkcurate.llm.oracle import ORACLES  # noqa: F401
from sparkcurate.session import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("_measures")
    return judged.select(
        "doc_id", m.n_words.alias("n_words"), m.word_chars.alias("word_chars"),
        m.n_symbols.alias("n_symbols"), m.n_dup_lines.alias("n_dup_lines"),
        m.n_repeat_words.alias("n_repeat_words"), quality.base_failed(m).alias("base_failed"),
        F.col("_kept").alias("kept"), F.round("_good", 6).alias("quality_probability"),
    )


def op6_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op2_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenids.write_ids(documents, path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenids.read_documents(spark, path)


def op7_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op1_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(documents, pii.learn(documents))
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "settled"]
    return found.select("doc_id", *[F.col("pii")[name].alias(name) for name in names])


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("license")
    base = F.array_distinct(F.transform(found.places, lambda p: p.label))
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", found.n_words.alias("n_words"), F.size(found.places).cast("long").alias("n_base"),
        F.array_min(F.transform(found.places, lambda p: p.start)).alias("first_word"),
        F.array_max(F.transform(found.places, lambda p: p.start)).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, found.found.labels)), ",").alias("labels"),
        found.found.score.alias("score"),
    )


def op8_benchmark_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(documents, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bagminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size")


def op10_fm_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model)
    white = whitening.transform(vectors, model)
    each = F.posexplode("white.whitened").alias("at", "whitened")
    shares = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return white.select("vec_id", F.col("white.deviation").alias("deviation"), each).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op12_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_mask_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op11_feast_whitening": op11_feast_whitening,
    "op12_collision_neighbours": op12_collision_neighbours,
    "op13_mask_ranking": op13_mask_ranking,
    "op10_fm_index_repeats": op10_fm_index_repeats,
    "op5_bag_minhash": op5_bag_minhash,
    "op8_benchmark_walks": op8_benchmark_walks,
    "op1_pii_field": op1_pii_field,
    "op3_license_rules": op3_license_rules,
    "op4_token_ids": op4_token_ids,
    "op7_language_ppm": op7_language_ppm,
    "op2_url_aliases": op2_url_aliases,
    "op6_weighted_mix": op6_weighted_mix,
    "op9_quality_votes": op9_quality_votes,
}
