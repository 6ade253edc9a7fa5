"""Registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (automata_dedup, decontaminate, exact_dedup, hard_negatives, importance, line_dedup, mixing, near_dup, quality, sharding, suffix_dedup,
               token_files, url_filter)
from .common import table, tokenizer_path

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn

    return register


@query("op5_mixing", mixing.SQL)
def op5(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_exact_dedup", exact_dedup.SQL)
def op8(spark, sf):
    return exact_dedup.content_sort_dedup(table(spark, sf, "documents"), keep="largest")


@query("op9_decontaminate", decontaminate.SQL)
def op9(spark, sf):
    d = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_line_dedup", line_dedup.SQL)
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                      F.col("n_dropped").cast("long").alias("n_dropped"),
                      F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op1_quality")
def op1(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels.where(~quality.held_out("doc_id")))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op2_suffix_dedup")
def op2(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"), 100)


@query("op3_token_files")
def op3(spark, sf):
    return token_files.tokenize_documents(table(spark, sf, "documents"), tokenizer_path(), end_id=2)


@query("op4_near_dup")
def op4(spark, sf):
    return near_dup.near_duplicates(table(spark, sf, "documents")).drop("text_digest")


@query("op6_url_filter", url_filter.SQL)
def op6(spark, sf):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf, "pages"), rules)


@query("op7_sharding")
def op7(spark, sf):
    rows = sharding.shard_rows(table(spark, sf, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query("op11_importance", importance.SQL)
def op11(spark, sf):
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("n_words")


@query("op13_hard_negatives", hard_negatives.SQL)
def op13(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op12_automata_dedup", automata_dedup.SQL)
def op12(spark, sf):
    return automata_dedup.remove_repeated_runs(table(spark, sf, "documents"), 20).drop("spans")
