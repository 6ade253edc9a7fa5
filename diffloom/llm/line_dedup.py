"""Line dedup: hashes are range-partitioned, sorted by document and position within a hash,
and the stream's first occurrences stay.  The result is a bitmap of kept lines per document;
no text moves in the search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import SPACES, ascii_lower, fresh, hot_keys, materialize, parts, whole

WORD = 64


def line_keys(text: Column) -> Column:
    """Keys of the lines of a text: stripped at both ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = 10, min_slice: int = 100) -> DataFrame:
    """(id, text_digest, keep): for each document that loses lines, its keep bitmap.

    ``keep`` has 64 lines a word, lowest bit first, set for lines that stay; words after the
    last one with a dropped line are left out (all their lines stay).  Documents without a
    row keep everything.  ``text_digest`` (xxhash64) tells apart rows that share an identifier.

    A line is dropped when its key has at least ``min_chars`` code points and also occurs in
    a document with a smaller identifier; null identifiers come last.  Rows with the same
    identifier are one document.  Null and empty texts have one empty line.  Keys are told
    apart by 128 hashed bits.  A key with more lines than a task's share is cut into slices
    by document; its first document is then taken from a pre-aggregated minimum.
    """
    spark = docs.sparkSession
    n = parts(spark)
    text = whole(text_col)
    lines = (docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_td"),
                         F.posexplode(line_keys(text)).alias("_pos", "_key"))
             .where(F.length("_key") >= min_chars)
             .select("_id", "_td", "_pos", F.xxhash64("_key").alias("_h1"),
                     F.xxhash64(F.lit("line"), F.col("_key")).alias("_h2")))
    lines = materialize(lines, "lines")
    limit = max(min_slice, lines.count() // (2 * n))
    hot = F.broadcast(hot_keys(lines, "_h1", limit))  # at most 2 * n keys
    first_of_hot = F.broadcast(lines.join(hot, "_h1").groupBy("_h1", "_h2").agg(
        F.min("_id").alias("_hot_first"), F.max("slices").alias("slices")))
    sliced = (lines.join(first_of_hot, ["_h1", "_h2"], "left")
              .withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("slices")), F.lit(0))))
    stream = Window.partitionBy("_h1", "_h2", "_slice").orderBy(
        F.col("_id").asc_nulls_last(), "_td", "_pos").rowsBetween(Window.unboundedPreceding, 0)
    firsts = (sliced.repartitionByRange(n, "_h1", "_h2", "_slice")
              .withColumn("_first", F.least(F.first("_id").over(stream), F.col("_hot_first"))))
    dropped = firsts.where(~F.col("_id").eqNullSafe(F.col("_first"))).select("_id", "_td", "_pos")
    words = (dropped.repartition("_id", "_td")
             .groupBy("_id", "_td", F.floor(F.col("_pos") / WORD).cast("int").alias("_word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(_pos % 64 as int))")).alias("_bits")))
    sparse = words.groupBy("_id", "_td").agg(
        F.max("_word").alias("_last"), F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_m"))
    keep = F.transform(F.sequence(F.lit(0), F.col("_last")),
                       lambda w: F.bitwise_not(F.coalesce(F.element_at("_m", w), F.lit(0).cast("long"))))
    return sparse.select(F.col("_id").alias(id_col), F.col("_td").alias("text_digest"), keep.alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit in ``keep`` is set or left out."""
    def stays(_, i):
        word = F.get(keep, F.floor(i / WORD).cast("int"))
        return F.coalesce(F.getbit(word, F.pmod(i, F.lit(WORD))), F.lit(1)) == 1

    return F.filter(lines, stays)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``, which replace columns of these names.

    Bitmaps meet texts by identifier and digest.
    """
    i, td, keep, kept = (fresh(docs, x) for x in ("_id", "_td", "_keep", "_kept"))
    b = bitmaps.select(F.col(id_col).alias(i), F.col("text_digest").alias(td), F.col("keep").alias(keep))
    text = whole(docs[text_col])
    joined = docs.join(b, docs[id_col].eqNullSafe(b[i]) & (F.xxhash64(text) == b[td]), "left")
    lines = F.split(text, "\n", -1)
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    out = joined.select(*[docs[c] for c in columns], F.size(lines).alias("n_lines"),
                        F.when(F.col(keep).isNotNull(), kept_lines(lines, F.col(keep))).alias(kept))
    return out.select(*columns, "n_lines",
                      F.coalesce(F.col("n_lines") - F.size(kept), F.lit(0)).alias("n_dropped"),
                      F.coalesce(F.array_join(kept, "\n"), whole(text_col)).alias("kept_text"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first_doc FROM k),
g AS (SELECT *, length(key) >= 10 AND doc_id <> first_doc AS gone FROM f)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id"""
