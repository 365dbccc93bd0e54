"""The operators' queries over the whole given tables, with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import bottom_k, chat_schema, compact_windows, dominance_packing, edit_counts, feast_whitening, katz, line_frequency, mixing, personal_data, prefix_trie, secret_scan, templates
from tapeworks.llm.oracles import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


@query
def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = edit_counts.build_trees(table(spark, sf_dir, "documents"))
    after = edit_counts.apply_edits(state.withColumn("edits", edit_counts.spread_edits()))
    return after.select("doc_id", "n_before", F.col("n_tokens").alias("n_after"), "n_edits", F.size("leaf_chars").cast("long").alias("n_leaves"),
                        "recounted_chars", "updated_nodes", F.length("text").cast("long").alias("n_chars_after"))


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


@query
def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op5_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents")).drop("tag")


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op7_chat_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    turns = chat_schema.canonical_turns(chat_schema.records_of_rows(rows))
    return chat_schema.digests(chat_schema.read_back(chat_schema.format_turns(turns)))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(table(spark, sf_dir, "documents"))


@query
def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash").distinct()


@query
def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality_rules(table(spark, sf_dir, "documents")).drop("host", "tag")


@query
def op11_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance_packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))))


@query
def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feast_whitening.components_of(feast_whitening.whiten(table(spark, sf_dir, "embeddings")))
