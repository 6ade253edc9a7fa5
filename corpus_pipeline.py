"""A training corpus from raw documents: the stages in order, each a written table.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffloom.llm import decontaminate, mixing, near_dup, quality, token_files
from diffloom.llm.common import fresh, materialize, table, tokenizer_path, whole

MIN_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least ``MIN_SCORE``; the rules are learned from labelled rows not held out.

    Null and empty texts are scored like any other; repeated rows are judged alike, each for
    itself; an empty table stays empty.  All columns are kept, whatever their names.
    """
    labels = table(spark, sf_dir, "labels").where(~quality.held_out("doc_id"))
    score = fresh(docs, "_score")
    scored = quality.score(docs, quality.train(docs, labels), out=score)
    return scored.where(F.col(score) >= MIN_SCORE).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest identifier.

    Null identifiers come last; of rows alike in identifier and text one stays.  Null, empty and
    wordless texts are copies of equal texts only.  An empty table stays empty.
    """
    return near_dup.keep_one(docs, near_dup.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null, empty and wordless texts have no window and stay; rows alike in identifier and text are
    judged alike; an empty table, or an empty benchmark, drops nothing.
    """
    found = decontaminate.window_hits(docs, table(spark, sf_dir, "benchmark"))[0].select("_id", "_td").distinct()
    digest = F.xxhash64(whole(docs["text"]))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (digest == found["_td"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out so that sources come near their targets.

    A null source is a source of its own; texts without words come as
    often as their source's whole epochs say; equal draws go by identifier (nulls last) and text.
    """
    return mixing.repeat_documents(docs, mixing.mix(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.tokenize_documents(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("quality", keep_quality),
    ("near_dup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: Weighted sampling, component search and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
