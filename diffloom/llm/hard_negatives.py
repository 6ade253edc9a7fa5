"""Hard-negative mining with Four-Russians scoring.

1. Components become the integers floor(``scale`` * x).  For every anchor and every group of
   eight dimensions a table holds the sums of all 256 subsets of the group's components.
2. Candidates are packed as bit planes: bit b of the eight components of a group is one byte.
   A byte looks up the group's sum; sums over groups, shifted by b and added over planes (the
   sign plane subtracted), are the exact inner product.
3. Candidates are dealt into slices that stay in a task as planes while anchors stream by, so
   neither side is ever whole in one place.  One pass over the candidates of the anchors' labels
   gives each anchor's best positives, one over the others the best negatives in each positive's
   range; a slice returns at most its first few a positive, and Spark ranks what slices return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

GROUP, SUBSETS = 8, 256
#: Candidates of a slice at most, and anchors scored at once.
SLICE_ROWS, ANCHOR_ROWS = 32_768, 32
#: Lookups (candidate, anchor) at once; bounds the memory of one step.
STEP = 1 << 21
LONG_MAX = (1 << 63) - 1


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """[group, byte, anchor]: the sum of the group's components at the byte's bits."""
    n, dims = anchors.shape
    groups = anchors.reshape(n, dims // GROUP, GROUP).transpose(1, 2, 0)
    out = np.zeros((dims // GROUP, SUBSETS, n), anchors.dtype)
    for k in range(GROUP):  # bit k doubles the subsets known so far
        out[:, 1 << k:2 << k] = out[:, :1 << k] + groups[:, k][:, None]
    return out


def bit_planes(v: np.ndarray, planes: int) -> np.ndarray:
    """[plane, group, row]: two's complement bits of eight components in a byte, lowest plane first."""
    n, dims = v.shape
    out = np.empty((planes, dims // GROUP, n), np.uint8)
    for b in range(planes):
        bit = ((v >> b) & 1).astype(np.uint8).reshape(n, dims // GROUP, GROUP)
        out[b] = np.packbits(bit, axis=2, bitorder="little")[:, :, 0].T
    return out


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """[row, anchor]: inner products by lookups, shifts and additions."""
    total = np.zeros((planes.shape[2], sums.shape[2]), sums.dtype)
    for b in range(len(planes) - 1, -1, -1):  # the highest plane is the sign
        at = sums[0][planes[b, 0]]
        for g in range(1, len(sums)):
            at += sums[g][planes[b, g]]
        total = total * 2 + at if b < len(planes) - 1 else -at
    return total


def _matrix(lists: pa.Array, dims: int, wide: bool) -> np.ndarray:
    """Integers of a list column, filled up with zeros to ``dims``; Python integers if ``wide``."""
    lengths, flat = np.diff(np.asarray(lists.offsets)), lists.flatten()
    values = np.asarray(flat)
    if wide:
        values = np.array([int(x) for x in values], object)
    out = np.zeros((len(lengths), dims), object if wide else np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _first(score: np.ndarray, ids: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of ``among``: highest score, then smallest id."""
    if len(among) > k:
        own = score[among]
        among = among[own >= np.sort(own)[-k]]
    return among[np.lexsort((ids[among], -score[among]))[:k]]


class _Slice:
    """The candidates of one slice as bit planes."""

    def __init__(self, t: pa.Table, dims: int, wide: bool):
        t = t.combine_chunks()
        v = _matrix(t.column("v").chunk(0), dims, wide)
        most = max(int(v.max()), -int(v.min()) - 1, 0) if v.size else 0
        self.largest, self.dims, self.wide = most + 1, dims, wide
        self.planes = bit_planes(v, most.bit_length() + 1)
        raw = t.column("id").combine_chunks()
        self.null = np.asarray(raw.is_null())
        # A null identifier comes last among ties.
        self.ids, self.labels = np.asarray(raw.fill_null(LONG_MAX)), np.asarray(t.column("label"))

    def score(self, a: np.ndarray) -> np.ndarray:
        bound = self.largest * (max(int(a.max()), -int(a.min())) + 1) * self.dims * 2
        kind = object if self.wide or bound >= 1 << 62 else np.int32 if bound < 1 << 31 else np.int64
        sums = subset_sums(a.astype(kind))
        n, step = self.planes.shape[2], max(STEP // len(a), 1)
        got = np.concatenate([scores(self.planes[:, :, i:i + step], sums) for i in range(0, n, step)])
        return (np.clip(got, -LONG_MAX, LONG_MAX) if kind is object else got).astype(np.int64)


def _stream(batches: Iterator[pa.RecordBatch], dims: int, wide: bool) -> Iterator[tuple[_Slice, pa.Table]]:
    """(slice, some anchors); batches come sorted by slice, candidates (kind 0) before anchors (1)."""
    held, at, now = [], None, None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        place = np.asarray(t.column("slice")).astype(np.int64) * 2 + np.asarray(t.column("kind"))
        cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1), len(place)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            s, anchors = divmod(int(place[i]), 2)
            if s != at:
                held, at, now = [], s, None
            part = t.slice(i, j - i)
            if not anchors:
                held.append(part)
            elif held:
                if now is None:
                    now = _Slice(pa.concat_tables(held), dims, wide)
                for k in range(0, part.num_rows, ANCHOR_ROWS):
                    yield now, part.slice(k, ANCHOR_ROWS).combine_chunks()


def _positives(k: int, dims: int, wide: bool):
    def run(batches):
        for now, t in _stream(batches, dims, wide):
            score = now.score(_matrix(t.column("v").chunk(0), dims, wide))
            rows, ids, labels = (np.asarray(t.column(c)) for c in ("row", "id", "label"))
            found = []
            for a in range(len(rows)):
                same = np.flatnonzero((now.labels == labels[a]) & ((now.ids != ids[a]) | now.null))
                found += [(rows[a], None if now.null[i] else now.ids[i], score[i, a])
                          for i in _first(score[:, a], now.ids, same, k)]
            r, p, s = zip(*found) if found else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (r, p, s)], ["row", "id", "score"])

    return run


def _negatives(k: int, low: int, high: int, dims: int, wide: bool):
    def run(batches):
        for now, t in _stream(batches, dims, wide):
            score = now.score(_matrix(t.column("v").chunk(0), dims, wide))
            rows, labels, floors = np.asarray(t.column("row")), np.asarray(t.column("label")), t.column("floors").to_pylist()
            found = []
            for a in range(len(rows)):
                own = score[:, a]
                other = now.labels != labels[a]
                for s in floors[a]:
                    # low * s <= 100 * score <= high * s, in integers that cannot overflow.
                    least, most = -(-low * s // 100), high * s // 100
                    if most < least:
                        continue
                    among = np.flatnonzero(other & (own >= max(least, -LONG_MAX)) & (own <= min(most, LONG_MAX)))
                    found += [(rows[a], s, None if now.null[i] else now.ids[i], own[i]) for i in _first(own, now.ids, among, k)]
            r, p, n, s = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (r, p, n, s)],
                                             ["row", "floor", "id", "score"])

    return run


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5,
                   low: int = 80, high: int = 100, scale: float = 256.0, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` marks the anchors among the rows, ``label`` replaces the column ``label_col``.
    A score is the inner product of floor(``scale`` * x) as longs; scores beyond a long count as
    the largest (smallest) one.  The positives of an anchor are its first ``positives`` rows of its
    label whose identifier is another; its negatives for a positive the first ``negatives`` rows
    of other labels with ``low`` * positive <= 100 * negative <= ``high`` * positive.  First:
    higher score, then smaller identifier, nulls last.

    Rows with a null label, a null vector or a null or non-finite component take no part, nor do
    anchors without identifier as anchors.  A shorter vector counts as filled up with zeros.
    Repeated rows are separate rows: as anchors each has its own result, as candidates each may
    be returned.  An empty table gives none.  Other columns are ignored.
    """
    v = F.col(vector_col)
    rows = materialize(
        vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("int").alias("label"),
                       F.coalesce(anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"), v.alias("v"))
        .where(F.col("label").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))
        .withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, dims, most, least = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    dims = max(-(-(dims or 1) // GROUP) * GROUP, GROUP)
    wide = (max(most or 0, -(least or 0)) + 1) ** 2 * dims >= 1 << 61
    # As many slices as keep all cores at work, unless they get too small or too large.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    slices = max(-(-n // SLICE_ROWS), min(2 * cores, -(-n // 512)), 1)

    def against(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
        """Each slice of the candidates, followed by all anchors."""
        shape = ["slice", "kind", "row", "id", "label", "v", "floors"]
        base = candidates.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")).select(
            "slice", F.lit(0).alias("kind"), "row", "id", "label", "v", F.lit(None).cast("array<bigint>").alias("floors"))
        asked = anchors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("kind", F.lit(1)).select(*shape)
        return base.unionByName(asked).repartition("slice").sortWithinPartitions("slice", "kind")

    def first(found: DataFrame, k: int, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = rows.where("anchor")
    found = against(rows, asked.withColumn("floors", F.lit(None).cast("array<bigint>"))).mapInArrow(
        _positives(positives, dims, wide), "row bigint, id bigint, score bigint")
    best = materialize(first(found, positives, "row").select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    floors = best.groupBy("row").agg(F.collect_set("positive_score").alias("floors"))  # ``positives`` at most
    found = against(rows, asked.join(floors, "row")).mapInArrow(
        _negatives(negatives, low, high, dims, wide), "row bigint, floor bigint, id bigint, score bigint")
    ranked = first(found, negatives, "row", "floor").withColumnRenamed("floor", "positive_score")
    names = asked.select("row", F.col("id").alias("anchor_id"))
    return best.join(ranked, ["row", "positive_score"]).join(names, "row").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH q AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
       WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, q.vec_id, q.label = a.label AS same,
         list_inner_product(a.v, q.v)::BIGINT AS score FROM q a, q WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
      FROM s WHERE same AND vec_id <> anchor_id),
n AS (SELECT anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE place <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
