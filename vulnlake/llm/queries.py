"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm import bpe, langid, licenses, lm, media, mixing, oracles, packing, prefixes, quality, simhash, spelling, suffixes
from vulnlake.llm.common import documents


def op1_mpeg_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = media.texts_to_streams(documents(spark, sf_dir))
    return media.digests(media.parse_streams(streams, keep=("doc_id", "n_bytes")))


def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_words(documents(spark, sf_dir), "word_bpe_49k.json")
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), size=3)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predicted(docs, langid.fit(docs.filter(~langid.held_out())))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.judged(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good and not toxic. Background: all documents. Labels are joined alike at every size."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg((F.max("quality") - F.max("toxic") == 1).alias("target"))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return lm.cross_entropy_difference(docs.join(labels.hint("merge"), "doc_id", "left"), lm.text_bytes(docs))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_hits(documents(spark, sf_dir))
    base = F.filter("hits", lambda h: h["kind"] == "base")
    starts = F.transform(base, lambda h: h["first_word"])
    names = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    kinds = F.transform("hits", lambda h: h["kind"])
    sure = F.when(F.array_contains(kinds, "tag"), 1.0).when(F.array_contains(kinds, "base"), 0.9).when(F.size("hits") > 0, 0.6).otherwise(0.0)
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("hits")).alias("labels"), sure.cast("double").alias("score"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(documents(spark, sf_dir), "byte_bpe_50k.json").withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(documents(spark, sf_dir), capacity=1024, vocabulary="byte_bpe_50k.json", end_id=2)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`n_passages` counts stretches of over 50 words that occur elsewhere too, also those below 400 bytes, which stay."""
    done = suffixes.deduplicated(documents(spark, sf_dir), length=400, passage=suffixes.PASSAGE)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages")


def op11_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[native] Words that the mix takes of each document, added up over its pieces in the shards."""
    return mixing.mixed(documents(spark, sf_dir)).taken().select("doc_id", "size", "source_size", "target", "taken")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefixes.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mpeg_ts, op2_bpe_trie, op3_simhash, op4_langid, op5_quality, op6_lm_difference, op7_licenses, op8_token_counts, op9_best_fit, op10_suffix_dedup]
    found += [op11_hypergeometric_mix, op12_spelling_variants, op13_conversation_trie]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": oracles.QUALITY, "op11_hypergeometric_mix": oracles.MIX, "op12_spelling_variants": oracles.SPELLING, "op13_conversation_trie": oracles.PREFIXES}
