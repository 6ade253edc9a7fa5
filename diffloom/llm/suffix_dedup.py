"""Removal of repeated byte strings by prefix-free parsing and suffix arrays.

Every string of ``length`` bytes is asked for an earlier occurrence, exactly, without a
suffix array of the whole corpus:

1. Parsing.  A rolling hash of 8 bytes picks a trigger in the middle part of every string
   (the smallest hash there; the leftmost of equal ones), so equal strings have the same
   trigger at the same place.  Neighbouring strings with the same trigger form a phrase:
   the text from the first one's start to the last one's end.  Phrases overlap by
   ``length`` - 1 bytes, every string lies in exactly one, and none spans documents.
2. Dictionary and parse.  The corpus is its sequence of phrases.  All but the first
   occurrence of a phrase are repeats as a whole.  Only phrases that share the bytes around
   the trigger with another phrase of the dictionary can share a string with it.
3. Suffix arrays.  Those phrases are fetched once each and, per trigger context, sorted by
   what follows the trigger and by what precedes it (reversed), with common-prefix lengths.
   A string at offset j before the trigger equals another phrase's iff both agree in j bytes
   before and ``length`` - j bytes after it, which the two arrays tell for all phrases at
   once; the parse tells which of the equal ones comes first in the corpus.
4. A context with more phrases than a task's share is hot.  Its first occurrences are found
   dealt by phrase, of which a batch has one row, and its snippets are cut into slices.  A slice settles its
   own repeats; the strings that are first in their slice then meet by content, at most one
   per slice, so no step gathers the context.
5. Repeats are merged into spans per document and cut out.

Deviation from the textbook method: strings are only ordered to depth ``length`` and only
within a trigger context, since no order between different contexts is needed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .bytes_np import U, RangeHash, buffers, chunks, mix
from .common import hot_keys, materialize, parts, whole

GRAM = 8
#: Phrases resolved at once; a larger trigger context is resolved by itself.
RESOLVE_ROWS = 40_000
#: A context is hot from 1 / (HOT_SHARE * partitions) of all phrases on.
HOT_SHARE = 4


def layout(length: int) -> tuple[int, int]:
    """(margin, places): a trigger is at one of ``places`` offsets from ``margin`` on."""
    if length < 4 * GRAM:
        raise ValueError(f"length must be at least {4 * GRAM}")
    margin = length // 6
    return margin, length - GRAM - 2 * margin + 1


def parse(buf: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Phrases of the texts in ``buf``: text index, trigger place, offsets hi >= lo, context and phrase hashes."""
    margin, places = layout(length)
    n = len(buf) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return {"doc": empty, "t": empty, "hi": empty, "lo": empty, "key": empty.view(U), "hs": empty.view(U)}
    grams = np.ndarray((len(buf) - GRAM + 1,), "<u8", np.ascontiguousarray(buf), strides=(1,)).astype(U)
    low = U((1 << int(len(buf)).bit_length()) - 1)
    v = (mix(grams + U(1)) & ~low) | np.arange(len(grams), dtype=U)
    width = 1
    while width * 2 <= places:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < places:
        v = np.minimum(v[:len(v) - (places - width)], v[places - width:])
    # v[i] is now the smallest of places i .. i + places - 1; a string at s uses v[s + margin].
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    s = np.flatnonzero(np.arange(length, length + n) <= ends)
    if not len(s):
        return {"doc": empty, "t": empty, "hi": empty, "lo": empty, "key": empty.view(U), "hs": empty.view(U)}
    t = (v[s + margin] & low).astype(np.int64)
    cut = np.flatnonzero(t[1:] != t[:-1])
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(s) - 1]])
    a, b, t = s[first], s[last], t[first]
    inner, outer = RangeHash(buf, 0), RangeHash(buf, 1)
    doc = np.searchsorted(offsets, a, side="right") - 1
    return {"doc": doc, "t": t - offsets[doc], "hi": t - a, "lo": t - b,
            "key": inner.of(t - margin, t + GRAM + margin + (length - GRAM - 2 * margin - places + 1)),
            "hs": mix(outer.of(a, b + length) ^ (t - a).astype(U))}


def _parsed(batch: pa.RecordBatch, length: int) -> dict[str, np.ndarray] | None:
    """The phrases of a batch's texts, as ``parse`` gives them; None if there are none."""
    buf, off = buffers(batch.column("_text"))
    found = []
    for i, j in chunks(off):
        p = parse(buf[off[i]:off[j]], off[i:j + 1] - off[i], length)
        p["doc"] = p["doc"] + i
        found.append(p)
    if not any(len(p["doc"]) for p in found):
        return None
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def _fresh(p: dict[str, np.ndarray]) -> np.ndarray:
    """Of phrases in order of key and hs: which differ from the one before."""
    fresh = np.ones(len(p["key"]), bool)
    fresh[1:] = (p["key"][1:] != p["key"][:-1]) | (p["hs"][1:] != p["hs"][:-1])
    return fresh


def hot_contexts(rows: DataFrame, length: int) -> DataFrame:
    """(key): contexts with more than 1 / (HOT_SHARE * partitions) of the phrases, repeats in a batch not counted.

    A context with twice that share has half of it in some batch, and only such counts leave a
    batch.  At most HOT_SHARE keys a partition come out.  What is hot decides where rows meet,
    not what is found.
    """
    share = 1 / (HOT_SHARE * parts(rows.sparkSession))

    def count(batches):
        for batch in batches:
            p = _parsed(batch, length)
            if p is None:
                continue
            order = np.lexsort((p["hs"], p["key"]))
            p = {k: p[k][order] for k in ("key", "hs")}
            key, n = np.unique(p["key"][_fresh(p)], return_counts=True)
            many = (n > 1) & (n >= share / 2 * n.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(key[many].view(np.int64), 0)), pa.array(np.append(n[many], n.sum())),
                pa.array(np.append(np.zeros(many.sum(), bool), True))], ["key", "n", "all"])

    counts = materialize(rows.select("_text").mapInArrow(count, "key bigint, n bigint, all boolean")
                         .groupBy("key", "all").agg(F.sum("n").alias("n")), "contexts")
    total = counts.where("all").agg(F.sum("n")).first()[0] or 0
    return counts.where(~F.col("all") & (F.col("n") > total * share)).select("key")


def _phrases(length: int):
    def run(batches):
        for batch in batches:
            p = _parsed(batch, length)
            if p is None:
                continue
            # Repeats of a phrase inside the batch are settled here, so a phrase that a third
            # of the corpus has is one row a batch; a settled row moves under a key of its own.
            ids = pa.table({"i": batch.column("_id"), "t": batch.column("_td")})
            sorted_ids = pc.sort_indices(ids, [("i", "ascending"), ("t", "ascending")], null_placement="at_start")
            ids = ids.take(sorted_ids).combine_chunks()
            i, td = ids.column("i").combine_chunks(), np.asarray(ids.column("t"))
            alike = np.zeros(len(td), bool)
            if len(td) > 1:
                both_null = np.asarray(pc.and_(pc.is_null(i[1:]), pc.is_null(i[:-1])))
                alike[1:] = (td[1:] == td[:-1]) & (both_null | np.asarray(pc.equal(i[1:], i[:-1]).fill_null(False)))
            rank = np.empty(len(td), np.int64)
            rank[np.asarray(sorted_ids)] = np.cumsum(~alike)
            order = np.lexsort((p["t"], rank[p["doc"]], p["hs"], p["key"]))
            p = {k: x[order] for k, x in p.items()}
            fresh = _fresh(p)
            first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            place = rank[p["doc"]]
            again = (place != place[first]) | (p["t"] != p["t"][first])
            p["key"] = np.where(again, mix(p["hs"] ^ mix((place.astype(U) << U(32)) ^ p["t"].astype(U))), p["key"])
            at = pa.array(p["doc"])
            table = pa.table({"key": pa.array(p["key"].view(np.int64)), "hs": pa.array(p["hs"].view(np.int64)),
                              "_id": batch.column("_id").take(at), "_td": batch.column("_td").take(at),
                              "t": pa.array(p["t"].astype(np.int32)), "hi": pa.array(p["hi"].astype(np.int16)),
                              "lo": pa.array(p["lo"].astype(np.int16)), "again": pa.array(again)})
            yield from table.to_batches(max_chunksize=50_000)

    return run


def _lcp_sorted(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of byte rows sorted within groups; lcp with the row before, -1 at a new group."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(U)
    order = np.lexsort((*words.T[::-1], group))
    s, g = rows[order], group[order]
    differ = s[1:] != s[:-1]
    lcp = np.full(n, -1, np.int64)
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp[1:][g[1:] != g[:-1]] = -1
    return order, lcp


def repeated_strings(group: np.ndarray, snippets: list[bytes], hi: np.ndarray, lo: np.ndarray,
                     length: int) -> np.ndarray:
    """Flags [phrase, offset - margin] of strings that an earlier phrase of the group has too.

    Phrases come in corpus order within a group.
    """
    margin, places = layout(length)
    n, widest = len(group), margin + places - 1
    buf = np.frombuffer(b"".join(snippets), np.uint8)
    start = np.concatenate([[0], np.cumsum([len(x) for x in snippets])])
    trigger = start[:-1] + hi
    after, before = np.arange(length - margin), np.arange(widest)
    at = trigger[:, None] + after
    right = np.where(at < start[1:, None], buf[np.minimum(at, len(buf) - 1)], 0)
    at = trigger[:, None] - 1 - before
    left = np.where(at >= start[:-1, None], buf[np.maximum(at, 0)], 0)
    (ro, rl), (lo_order, ll) = _lcp_sorted(right, group), _lcp_sorted(left, group)
    flags = np.zeros((n, places), bool)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(margin, margin + places):
        e = np.flatnonzero((lo <= j) & (hi >= j))
        if len(e) < 2:
            continue
        r_class[ro] = np.cumsum(rl < length - j)
        l_class[lo_order] = np.cumsum(ll < j)
        c = r_class[e] * (n + 1) + l_class[e]
        order = np.argsort(c, kind="stable")
        c = c[order]
        flags[e[order[1:]], j - margin] = c[1:] == c[:-1]
    return flags


def _resolve(length: int):
    margin, places = layout(length)

    def settle(t: pa.Table) -> list[pa.RecordBatch]:
        t = t.sort_by([("key", "ascending"), ("_id", "ascending"), ("_td", "ascending"), ("t", "ascending")])
        ids = t.column("_id")
        if ids.null_count:  # nulls come first
            t = t.append_column("_null", pc.invert(pc.is_null(ids)))
            t = t.sort_by([("key", "ascending"), ("_null", "ascending"), ("_id", "ascending"), ("_td", "ascending"), ("t", "ascending")])
        key, td, at = (np.asarray(t.column(c)) for c in ("key", "_td", "t"))
        alike = np.zeros(len(key), bool)  # the same place of a repeated row
        alike[1:] = (key[1:] == key[:-1]) & (td[1:] == td[:-1]) & (at[1:] == at[:-1])
        if alike.any():
            t, key = t.filter(pa.array(~alike)), key[~alike]
        hi, lo, at = (np.asarray(t.column(c)).astype(np.int64) for c in ("hi", "lo", "t"))
        flags = repeated_strings(key, t.column("snip").to_pylist(), hi, lo, length)
        edge = np.zeros((len(key), places + 2), np.int8)
        edge[:, 1:-1] = flags
        step = np.diff(edge, axis=1)
        row, first = np.nonzero(step == 1)
        _, end = np.nonzero(step == -1)
        # Offsets first .. end - 1 (plus margin) are repeats: starts t - offset.
        out = [spans(t, row, at[row] - (end - 1 + margin), at[row] - (first + margin) + length)]
        hot = np.asarray(t.column("hot"))
        if hot.any():
            offsets = np.arange(margin, margin + places)
            open_ = ~flags & hot[:, None] & (lo[:, None] <= offsets) & (hi[:, None] >= offsets)
            row, place = np.nonzero(open_)
            snippets = t.column("snip").to_pylist()
            begin = np.concatenate([[0], np.cumsum([len(x) for x in snippets])])[:-1][row] + hi[row] - (place + margin)
            buf = np.frombuffer(b"".join(snippets), np.uint8)
            w = [RangeHash(buf, salt).of(begin, begin + length).view(np.int64) for salt in (0, 1)]
            start = at[row] - (place + margin)
            out.append(spans(t, row, start, start + length, *w))
        return out

    def spans(t, row, start, end, w1=None, w2=None):
        pick, none = pa.array(row), pa.nulls(len(row), pa.int64())
        return pa.RecordBatch.from_arrays(
            [t.column("_id").combine_chunks().take(pick), t.column("_td").combine_chunks().take(pick),
             pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)),
             none if w1 is None else pa.array(w1), none if w2 is None else pa.array(w2)],
            ["_id", "_td", "from", "to", "w1", "w2"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < RESOLVE_ROWS:
                continue
            t = pa.Table.from_batches(held)
            last = t.column("key")[-1]
            cut = pc.index(t.column("key"), last).as_py()  # the last context may go on
            if cut:
                yield from settle(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield from settle(pa.Table.from_batches(held))

    return run


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
                   keyed: DataFrame | None = None, min_slice: int = 1000) -> DataFrame:
    """(_id, _td, from, to) byte spans covered by strings that also start earlier; spans may overlap.

    Earlier: a smaller identifier (nulls first), or the same document and a smaller place.
    Rows with the same identifier follow each other by ``_td`` (xxhash64 of the text); rows
    alike in both are one document.  Texts shorter than ``length`` have no spans.
    """
    rows = keyed if keyed is not None else with_keys(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    phrases = rows.mapInArrow(_phrases(length), f"key bigint, hs bigint, _id {kind}, _td bigint, t int, hi smallint, lo smallint, again boolean")
    hot = hot_contexts(rows, length).withColumn("hot", F.lit(True))
    dealt = phrases.join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # A hot context is dealt by phrase; it has several phrases for certain.
    dealt = dealt.withColumn("at", F.when(F.col("hot"), F.xxhash64("key", "hs")).otherwise(F.col("key"))).repartition("at")
    variant = Window.partitionBy("at", "key", "hs").orderBy("again", F.col("_id").asc_nulls_first(), "_td", "t")
    context = Window.partitionBy("at", "key")
    live = F.when(~F.col("again"), F.col("hs"))
    told = (dealt
            .withColumn("first_id", F.first("_id").over(variant)).withColumn("first_td", F.first("_td").over(variant))
            .withColumn("first_t", F.first("t").over(variant))
            .withColumn("lo_hs", F.min(live).over(context)).withColumn("hi_hs", F.max(live).over(context)))
    # Rows alike in identifier and text are one document: the same place is no earlier one.
    same = (F.col("_id").eqNullSafe(F.col("first_id")) & (F.col("_td") == F.col("first_td"))
            & (F.col("t") == F.col("first_t")))
    repeat = F.col("again") | ~same
    told = materialize(told.select("key", "_id", "_td", "t", "hi", "lo", repeat.alias("repeat"),
                                   (F.col("hot") | (F.col("lo_hs") != F.col("hi_hs"))).alias("mixed"))
                       .where("repeat OR mixed"), "phrases")
    whole_phrases = told.where("repeat").select(
        "_id", "_td", (F.col("t") - F.col("hi")).cast("long").alias("from"),
        (F.col("t") - F.col("lo") + length).cast("long").alias("to"))
    firsts = told.where("NOT repeat")
    limit = max(min_slice, firsts.count() // (2 * parts(rows.sparkSession)))
    hot = F.broadcast(hot_keys(firsts, "key", limit))  # at most twice as many keys as partitions
    sliced = firsts.join(hot, "key", "left").select(
        "_id", "_td", "t", "hi", "lo", F.col("slices").isNotNull().alias("hot"),
        F.when(F.col("slices").isNotNull(), F.xxhash64("key", F.pmod(F.xxhash64("_id", "_td", "t"), F.col("slices"))))
        .otherwise(F.col("key")).alias("key"))
    asked = sliced.groupBy("_id", "_td").agg(F.collect_set(F.struct("key", "t", "hi", "lo", "hot")).alias("asked"))
    cut = lambda p: F.substring(F.col("_text"), p["t"] - p["hi"] + 1, p["hi"] - p["lo"] + F.lit(length))
    snippets = by_document(rows, asked).select("_id", "_td", F.inline(F.transform("asked", lambda p: F.struct(
        *[p[c].alias(c) for c in ("key", "t", "hi", "lo", "hot")], cut(p).alias("snip")))))
    settled = materialize(snippets.repartition("key").sortWithinPartitions("key").mapInArrow(
        _resolve(length), f"_id {kind}, _td bigint, `from` bigint, `to` bigint, w1 bigint, w2 bigint"), "settled")
    # First strings of slices: one row per slice and content.
    content = Window.partitionBy("w1", "w2").orderBy(F.col("_id").asc_nulls_first(), "_td", "from")
    across = (settled.where("w1 IS NOT NULL").withColumn("nth", F.row_number().over(content)).where("nth > 1")
              .select("_id", "_td", "from", "to"))
    return whole_phrases.union(settled.where("w1 IS NULL").select("_id", "_td", "from", "to")).union(across)


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole(text_col)
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_td"), text.cast("binary").alias("_text"))


def by_document(rows: DataFrame, info: DataFrame, how: str = "inner") -> DataFrame:
    """Texts with what is known of their document; the texts' side is one exchange for all uses."""
    i = info.withColumnRenamed("_id", "_oid").withColumnRenamed("_td", "_otd")
    return rows.join(i, rows["_id"].eqNullSafe(i["_oid"]) & (rows["_td"] == i["_otd"]), how).drop("_oid", "_otd")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False, min_slice: int = 1000) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one row per row of ``docs``.

    ``n_spans`` counts maximal runs of removed bytes, ``kept`` is what is left (binary: a cut
    may fall inside a character).  Null counts as empty.  See ``repeated_spans``.
    """
    rows = with_keys(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    spans = repeated_spans(docs, length, id_col, text_col, rows, min_slice).groupBy("_id", "_td").agg(
        F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"))

    def cut(batches):
        for b in batches:
            out = []
            for text, spans_ in zip(b.column("_text"), b.column("spans").to_pylist()):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                kept, pos, removed, runs = [], 0, 0, 0
                for span in spans_ or ():
                    s, e = span["from"], span["to"]
                    if s > pos or runs == 0:
                        kept.append(raw[pos:s])
                        runs += 1
                        removed += e - s
                        pos = e
                    elif e > pos:
                        removed += e - pos
                        pos = e
                kept.append(raw[pos:])
                left = b"".join(kept)
                out.append((len(raw), removed, runs, hashlib.sha256(left).hexdigest(), left))
            n, r, s, h, k = zip(*out) if out else ((),) * 5
            cols = [b.column("_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())]
            names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array(k, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    extra = ", kept binary" if with_text else ""
    return by_document(rows, spans, "left").select("_id", "_text", "spans").mapInArrow(
        cut, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string{extra}")
