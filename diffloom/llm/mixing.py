"""Mixing sources to target weights by capped water-filling.

Targets are found on one row per source; documents are then taken in a seeded order with
whole repetitions first and one fractional repetition per source at the end of the order.
The order is cut into blocks of the draw, so prefix sums never need one source in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.draws import draw
from .common import fresh, materialize, parts, whole

BLOCKS = 4096
SEED = "mix"
#: Words of this operator: runs of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(c) -> Column:
    return F.regexp_count(whole(c), F.lit(WORD)).cast("long")


def source_key(c) -> Column:
    """A join key that is never null: null sources are a source of their own."""
    return F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))


def ranked(keys: DataFrame, order: Column, rank: str = "rank") -> DataFrame:
    """``keys`` with dense positions from 0 in the given order, without one task for all rows."""
    n = parts(keys.sparkSession)
    placed = materialize(keys.repartitionByRange(n, order).sortWithinPartitions(order)
                         .withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # One row per partition: bounded by the cluster.
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(
            Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(
        rank, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``sources`` (…, source_size, weight) with ``target`` (double).

    Each round gives the unclamped sources their weight's share of what is left and clamps
    those above ``max_epochs`` times their size; clamped sources stay clamped, so it ends
    when a round clamps none.  Only sums travel to the driver.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    rest, weights, clamped = float(total), float(sources.agg(F.sum("weight")).first()[0] or 0), -1
    while weights > 0:
        above = F.col("weight") * F.lit(rest) / F.lit(weights) > cap
        caps, free, count = sources.agg(
            F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if count == clamped:
            break
        rest, weights, clamped = float(total) - float(caps or 0), float(free or 0), count
    if weights == 0:
        return sources.withColumn("target", cap)
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(rest) / F.lit(weights)))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: str = SEED, blocks: int = BLOCKS) -> DataFrame:
    """(id, text_digest, size, source_size, target, taken, copies), one row per row of ``docs``.

    Sources in order of code point (null last) get ``weights`` in turn and share ``share``
    times all words; a source gets at most ``max_epochs`` times its size.  ``taken`` counts
    the words the mix takes of a document: whole repetitions, plus all of it if it comes early
    enough in the source's seeded order, plus a part for the one document at the boundary, so
    the words taken of a source add up to its rounded target.  ``copies`` is the same in whole
    documents (the boundary document counts when at least half of it is taken).

    Null, empty and wordless texts have size 0.  Null identifiers share one draw; equal draws
    are ordered by identifier (nulls last), text digest and size.  An empty table gives none.
    """
    rows = materialize(docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(whole(text_col)).alias("_td"), F.col(source_col).alias("_source"),
        source_key(F.col(source_col)).alias("_s"), word_count(text_col).alias("size"),
        draw(seed, F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_u"))
        .withColumn("_block", F.floor(F.col("_u") * blocks).cast("int")), "mix-rows")
    per_source = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(ranked(per_source, F.col("_source").asc_nulls_last()).withColumn("weight", weight),
                          "mix-sources")
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = (water_fill(sources, total, max_epochs)
            .select(source_key(F.col("_source")).alias("_s"), "source_size", "target", epochs.alias("_whole"))
            .withColumn("_need", F.floor(F.col("target") + 0.5) - F.col("_whole") * F.col("source_size")))
    in_order = Window.partitionBy("_s").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("_s", "_block").agg(F.sum("size").alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(in_order), F.lit(0))).drop("_n"))
    stream = Window.partitionBy("_s", "_block").orderBy(
        "_u", F.col("_id").asc_nulls_last(), "_td", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("_in_block", F.coalesce(F.sum("size").over(stream), F.lit(0)))
              .join(starts.join(plan, "_s"), ["_s", "_block"]))
    extra = F.least(F.col("size"), F.greatest(
        F.lit(0), F.col("_need") - F.col("_before") - F.col("_in_block")))
    return placed.select(
        F.col("_id").alias(id_col), F.col("_td").alias("text_digest"), "size", "source_size", "target",
        (F.col("_whole") * F.col("size") + extra).cast("long").alias("taken"),
        (F.col("_whole") + F.when((extra > 0) & (extra * 2 >= F.col("size")), 1).otherwise(0))
        .cast("int").alias("copies"))


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as ``copies`` says; texts stay whole."""
    # Rows that share identifier and text also share the sum of their copies, as alike rows do.
    i, td, c, rows, nth, one = (fresh(docs, x) for x in ("_id", "_td", "_copies", "_rows", "_nth", "_one"))
    m = (mixed.groupBy(F.col(id_col).alias(i), F.col("text_digest").alias(td))
         .agg(F.sum("copies").alias(c), F.count(F.lit(1)).alias(rows)))
    digest = F.xxhash64(whole(docs[text_col]))
    joined = docs.join(m, docs[id_col].eqNullSafe(m[i]) & (digest == m[td]))
    alike = Window.partitionBy(i, td).orderBy(F.lit(0))
    numbered = joined.withColumn(nth, F.when(F.col(rows) > 1, F.row_number().over(alike)).otherwise(1))
    # The first (copies mod rows) of alike rows get one more.
    times = (F.floor(F.col(c) / F.col(rows)) + F.when(F.col(nth) <= F.col(c) % F.col(rows), 1).otherwise(0)).cast("int")
    return (numbered.where(times > 0).select(*docs.columns, F.explode(F.array_repeat(F.lit(1), times)).alias(one))
            .drop(one))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('mix|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight,
             2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
             sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from FROM r),
g AS (SELECT *, weight * (total - caps_before) / weight_from > cap AS clamped FROM f),
l AS (SELECT sum(CASE WHEN clamped THEN cap ELSE 0 END) AS caps, sum(CASE WHEN clamped THEN 0 ELSE weight END)::DOUBLE AS free FROM g),
p AS (SELECT source, source_size, CASE WHEN free > 0 THEN least(cap, weight * (total - caps) / free) ELSE cap END AS target FROM g, l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM p),
n AS (SELECT *, floor(target + 0.5)::BIGINT - whole * source_size AS need FROM w),
o AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, size, source_size, target, (whole * size + least(size, greatest(0, need - before)))::BIGINT AS taken
FROM o JOIN n ON o.source IS NOT DISTINCT FROM n.source"""
