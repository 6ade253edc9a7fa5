"""Exact dedup by a content sort.

Rows are range-partitioned by sampled splitters over a bounded sort key (the first
characters of the normalised text, then its 64-bit digest), sorted externally, and equal
texts, now adjacent, are found by comparing neighbours in full.  Splitters stay small
however long the texts are.  A group of copies that exceeds a task's share is cut into
slices by identifier; the slices' winners are merged by SHA-256 in a second, narrow step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import ascii_lower, hot_keys, materialize, parts, whole

HEAD_CHARS = 16


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       keep: str = "smallest", min_slice: int = 100) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal
    texts the row with the smallest (``keep="largest"``: largest) identifier stays; null
    identifiers lose against all others, and of repeated rows with the same identifier just
    one is ``kept``.  Other columns of ``docs`` are not read.  An empty table gives none.

    Groups of more than max(``min_slice``, rows / (2 * shuffle partitions)) copies are
    sliced, so no task gets more of a group than that.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark = docs.sparkSession
    n = parts(spark)
    limit = max(min_slice, docs.count() // (2 * n))
    rows = (docs.select(F.col(id_col).alias("_id"), ascii_lower(whole(text_col)).alias("_norm"))
            .select("_id", "_norm", F.substring("_norm", 1, HEAD_CHARS).alias("_head"),
                    F.xxhash64("_norm").alias("_digest")))
    # At most 2 * n keys by the limit: bounded by the cluster, not by the data.
    hot = F.broadcast(hot_keys(rows, "_digest", limit))
    sliced = (rows.join(hot, "_digest", "left")
              .withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("slices")), F.lit(0))))
    best_first = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    best = F.min if keep == "smallest" else F.max
    group = Window.partitionBy("_head", "_digest", "_slice", "_norm").orderBy(best_first)
    all_of = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The range partitioning already holds each window's rows together: no second exchange.
    sorted_ = sliced.repartitionByRange(n, "_head", "_digest", "_slice").select(
        "_id", F.col("slices").isNotNull().alias("_hot"),
        F.row_number().over(group).alias("_rank"), best("_id").over(all_of).alias("_keep"),
        F.count(F.lit(1)).over(all_of).alias("_n"), F.sha2("_norm", 256).alias("text_sha256"))
    narrow = materialize(sorted_, "content-sort")
    # One row per sliced text; no more than there are hot keys.
    merged = F.broadcast(narrow.where("_hot").groupBy("text_sha256")
                         .agg(best("_id").alias("_all_keep"), F.count(F.lit(1)).alias("_all_n")))
    final_keep = F.when(F.col("_hot"), F.col("_all_keep")).otherwise(F.col("_keep"))
    return narrow.join(merged, "text_sha256", "left").select(
        F.col("_id").alias(id_col), final_keep.alias("keep_id"),
        F.when(F.col("_hot"), F.col("_all_n")).otherwise(F.col("_n")).alias("group_size"),
        (F.col("_id").eqNullSafe(final_keep) & (F.col("_rank") == 1)).alias("kept"), "text_sha256")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)"""
