"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Keys between two neighbouring virtual nodes (an arc) have the same clockwise order of
shards, so only the arcs' row counts are needed to decide how overflow moves: a full
shard passes the rest of an arc on to the next virtual node.  Rows then find their place
by their rank within the arc.  What the driver sees is one count per arc.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, whole

VNODES = 32
SEED = "ring"


def ring(shards: int, vnodes: int = VNODES, seed: str = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(positions, owners) of the virtual nodes, by position.  A shard's nodes don't depend on ``shards``."""
    nodes = sorted((int.from_bytes(hashlib.blake2b(f"{seed}|{s}|{v}".encode(), digest_size=8).digest(), "big"), s)
                   for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in nodes], np.uint64), np.array([s for _, s in nodes])


def capacities(rows: int, shards: int) -> np.ndarray:
    """Row bounds that differ by at most one and add up to ``rows``."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def place(counts: np.ndarray, owners: np.ndarray, room: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, end rank, shard, first slot) that fill the shards.

    Round d offers what is left of each arc to the d-th virtual node clockwise, so rows at
    home come first.  A piece ends an arc or fills a shard: at most arcs + shards pieces.
    """
    room, left, done = room.copy(), counts.copy(), np.zeros_like(counts)
    used, pieces, n = np.zeros_like(room), [], len(owners)
    for d in range(n):
        open_arcs = np.flatnonzero(left)
        if not len(open_arcs):
            break
        for arc in open_arcs:
            shard = owners[(arc + d) % n]
            take = min(left[arc], room[shard])
            if take:
                pieces.append((int(arc), int(done[arc]), int(done[arc] + take), int(shard), int(used[shard])))
                left[arc] -= take
                done[arc] += take
                room[shard] -= take
                used[shard] += take
    if left.any():
        raise ValueError("the shards have less room than there are rows")
    return pieces


def shard_rows(docs: DataFrame, shards: int, vnodes: int = VNODES, id_col: str = "doc_id",
               text_col: str = "text", seed: str = SEED) -> DataFrame:
    """(id, size, text_crc32, shard, slot, home), one row per row of ``docs``.

    Row counts of any two shards differ by at most one; slots of a shard are gapless from 0.
    ``home`` is the shard a row would have without the bound.  A row's place on the ring is a
    hash of its identifier and text, so null and repeated identifiers are spread as well;
    rows alike in both are interchangeable.  ``size`` is the text's UTF-8 bytes plus 16; null
    counts as empty.  With fewer rows than shards some shards stay empty.
    """
    spark = docs.sparkSession
    positions, owners = ring(shards, vnodes, seed)
    arcs = len(owners)

    @F.arrow_udf("int")
    def arc_of(h: pa.Array) -> pa.Array:
        at = np.searchsorted(positions, np.asarray(h).view(np.uint64), side="left") % arcs
        return pa.array(at.astype(np.int32))

    text = whole(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_td"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(text)).alias("_h"))
    rows = materialize(rows.withColumn("_arc", arc_of("_h")), "ring-rows")
    counts = np.zeros(arcs, np.int64)
    for arc, n in rows.groupBy("_arc").count().collect():  # at most shards * vnodes rows
        counts[arc] = n
    pieces = place(counts, owners, capacities(int(counts.sum()), shards))
    homes = [(int(a), int(s)) for a, s in enumerate(owners)]
    # Both tables are bounded by the ring.
    pieces_df = F.broadcast(spark.createDataFrame(
        pieces, "_arc int, _from long, _to long, shard int, _slot long"))
    homes_df = F.broadcast(spark.createDataFrame(homes, "_arc int, home int"))
    in_arc = Window.partitionBy("_arc").orderBy("_h", "_id", "_td")
    ranked = rows.withColumn("_rank", F.row_number().over(in_arc) - 1)
    return (ranked.join(pieces_df, (ranked["_arc"] == pieces_df["_arc"])
                        & (ranked["_rank"] >= pieces_df["_from"]) & (ranked["_rank"] < pieces_df["_to"]))
            .drop(pieces_df["_arc"]).join(homes_df, "_arc")
            .select(F.col("_id").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"), "home"))
