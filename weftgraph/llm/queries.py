"""The operators of this package as named queries over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, language_id, line_dedup, media, near_dedup, packing, segmentations, sharding, token_counts, urls
from weftgraph.llm.oracles import ORACLES as ORACLES
from weftgraph.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op2_hypergeometric_shards(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.hypergeometric_shards(rows, shards=40, tie=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op4_url_template_tree(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


@_query
def op7_length_buckets(spark, sf_dir):
    lengths = packing.counted_tokens(table(spark, sf_dir, "documents"))
    return packing.pack(lengths, length=F.col("tokens")).drop("tokens")


@_query
def op8_chunk_recipes(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_query
def op1_trie_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@_query
def op9_marginalised_unigrams(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    fitted = language_id.fit(docs.where(~out))
    found = language_id.predict(docs.select("doc_id", "text"), fitted)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@_query
def op10_baseline_jpeg(spark, sf_dir):
    return media.features(media.store(table(spark, sf_dir, "documents")))


@_query
def op3_prob_min_hash(spark, sf_dir):
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


@_query
def op6_line_similarity_join(spark, sf_dir):
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.withColumn("removed_lines", F.array_join("removed_lines", ","))


@_query
def op5_gumbel_segmentations(spark, sf_dir):
    found = segmentations.sample_segmentations(table(spark, sf_dir, "documents"))
    rounded = [F.round(c, 6).alias(c) for c in ("log_probability", "perturbed", "inclusion")]
    return found.select("doc_id", "rank", "n_pieces", *rounded, "pieces_crc32", "exact", "pieces")
