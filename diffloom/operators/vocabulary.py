"""Vocabularies of bounded size, encoding and decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions import as_col
from ..markers import EOS, PAD, UNK
from .suffixes import _lists

LABEL_IGNORE = -100


def build_vocab(df: DataFrame, tokens: str, size: int, specials: list[str]) -> DataFrame:
    """(token, id): specials first, then the most frequent tokens (ties by token).

    Counting combines before the shuffle; the ranking window runs over at most
    ``size`` rows kept by a top-k.
    """
    fixed = df.sparkSession.createDataFrame(
        list(zip(specials, range(len(specials)))), "token string, id int")
    counted = (df.select(F.explode(tokens).alias("token"))
               .where(~F.col("token").isin(specials))
               .groupBy("token").agg(F.count("*").alias("n"))
               .orderBy(F.desc("n"), "token").limit(size))
    ranked = counted.select("token", (F.row_number().over(W.orderBy(F.desc("n"), "token"))
                                      + (len(specials) - 1)).cast("int").alias("id"))
    return fixed.unionByName(ranked)


def _looked_up(vocab: DataFrame, of: str, into: str, kind, default=None):
    """A function from arrays of ``of`` to as many entries of ``into``; ``default`` for those the vocabulary has not.

    A vocabulary is bounded by its size, so it goes to the tasks whole.
    """
    known = vocab.where(F.col(of).isNotNull()).select(of, into).orderBy(of).collect()
    sought = pa.array([r[of] for r in known], pa.string() if of == "token" else pa.int32())
    found = pa.array([r[into] for r in known], pa.int32() if into == "id" else pa.string())

    @F.arrow_udf(ArrayType(kind))
    def look(items: pa.Array) -> pa.Array:
        flat, offsets = _lists(items)
        out = found.take(pc.index_in(flat, value_set=sought, skip_nulls=True))
        if default is not None:
            out = pc.if_else(pc.and_(out.is_null(), flat.is_valid()), default, out)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), out)

    return look


def _by_place(parts: str, flat: Column) -> Column:
    """``flat``, entries of all arrays of ``parts`` one after the other, without nulls and by their place in their array."""
    places = F.flatten(F.transform(parts, lambda p: F.transform(p, lambda _, i: i)))
    merged = F.sort_array(F.zip_with(places, flat, lambda i, x: F.struct(i.alias("i"), x.alias("x"))))
    return F.array_compact(F.when(F.size(parts) == 1, flat).otherwise(merged["x"]))


def lookup_ids(df: DataFrame, key: str, tokens: str, vocab: DataFrame, specials: list[str],
               out: str = "ids") -> DataFrame:
    """(key, ids): the ids of all tokens in order, then one end marker.

    Tokens are looked up in their row, so what is grouped is one row of ids a text.
    """
    eos, unk = specials.index(EOS), specials.index(UNK)
    ids = df.select(key, _looked_up(vocab, "token", "id", IntegerType(), unk)(tokens).alias("_i"))
    return ids.groupBy(key).agg(F.collect_list("_i").alias("_p")).select(
        key, F.concat(_by_place("_p", F.flatten("_p")), F.array(F.lit(eos))).alias(out))


def encode(df: DataFrame, key: str, tokens: str, vocab: DataFrame, length: int,
           specials: list[str], out: str = "ids") -> DataFrame:
    """(key, ids, mask): ids cut and padded to ``length`` with exactly one end marker."""
    pad = specials.index(PAD)
    ids = lookup_ids(df.select(key, F.slice(tokens, 1, length - 1).alias("_c")), key, "_c", vocab, specials, "_ids")
    padded = ids.select(
        key, F.concat("_ids", F.array_repeat(F.lit(pad), F.lit(length) - F.size("_ids"))).alias(out))
    return padded.withColumn("mask", F.transform(out, lambda x: (x != pad).cast("int")))


def ignore_labels(ids) -> Column:
    """Labels of encoded rows whose target is not trained on: one ignored label per id."""
    return F.transform(as_col(ids), lambda _: F.lit(LABEL_IGNORE))


def decode(df: DataFrame, key: str, ids: str, vocab: DataFrame, specials: list[str]) -> DataFrame:
    """(key, tokens): ids back to tokens, specials skipped."""
    look = _looked_up(vocab.where(F.col("id") >= len(specials)), "id", "token", StringType())
    parts = df.select(key, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_i")).groupBy(key).agg(F.collect_list("_i").alias("_p"))
    return parts.withColumn("_t", look(F.flatten("_p"))).select(key, _by_place("_p", F.col("_t")).alias("tokens"))


def truncation_report(lengths: DataFrame, limits: DataFrame, task: str = "task") -> DataFrame:
    """Share of rows cut by each task's limits; ``limits`` is the small fixed table."""
    joined = lengths.join(limits, task)
    return joined.groupBy(task).agg(
        F.count("*").alias("n_rows"),
        F.avg((F.col("source_len") > F.col("source_limit")).cast("double")).alias("source_cut"),
        F.avg((F.col("target_len") > F.col("target_limit")).cast("double")).alias("target_cut"))
