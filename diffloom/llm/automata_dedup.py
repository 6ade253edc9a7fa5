"""Removal of repeated word runs by suffix automata of reference shards.

A word is covered if a window of ``length`` words of one document, with that word in it, also
starts earlier in the corpus (smaller identifier, or same document and earlier start).

1. Routing.  In every window a trigger, the place of the smallest hash of three words in its
   middle part, is a function of the window's words alone, and so is the context around it.
   Neighbouring windows with the same trigger are a phrase.  Equal windows lie in phrases of the
   same context, so documents need to meet only the references that share a context with them.
   A context with one phrase needs no automaton: later copies of the phrase match in full.
2. Reference shards.  The distinct phrases of the other contexts are dealt by context into
   shards of about ``SHARD`` phrases.  A shard's phrases are streamed in corpus order: each gets
   its matching statistics from the suffix automaton of all phrases of the shard before it,
   matches of at least ``length`` words are its repeats, then it is added to the automaton.
3. A context with more than ``SHARD`` phrases is cut into slices, each a reference of its own;
   windows that are first in their slice meet by content, one row per slice.
4. Spans of a document are merged and their words cut out.

Automata of everything seen before grow with the corpus, so they are not broadcast to all
tasks: they stand where the documents that can match them are sent.  What is broadcast is the
list of contexts that hold so many rows that they must be dealt by phrase, at most
``HOT_SHARE`` * partitions keys of eight bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .bytes_np import U, buffers, chunks, folded, mix, word_hashes, word_spans
from .common import materialize, parts
from .suffix_dedup import by_document, with_keys

GRAM = 3
#: Phrases of a reference shard or slice.
SHARD = 1500
#: A context is hot from 1 / (HOT_SHARE * partitions) of all phrases on.
HOT_SHARE = 4
#: Anything but space, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_PLACE = U((1 << 31) - 1)


class SuffixAutomaton:
    """All substrings of the added sequences; ``matches`` tells how far another one agrees."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state of the strings of ``q`` that continue ``p`` by ``c``."""
        if self.length[q] == self.length[p] + 1:
            return q
        short = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = short
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = short
            p = self.link[p]
        return short

    def add(self, words: list) -> None:
        """Adds one sequence; no substring spans two of them."""
        nxt, link, last = self.next, self.link, 0
        for c in words:
            known = nxt[last].get(c)
            if known is not None:
                last = self._split(last, c, known)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = self._split(p, c, nxt[p][c])
            last = new

    def matches(self, words: list) -> list[int]:
        """Matching statistics: per place the length of the longest known run that ends there."""
        nxt, link, length, at, n, out = self.next, self.link, self.length, 0, 0, []
        for c in words:
            to = nxt[at].get(c)
            while to is None and at:
                at = link[at]
                n = length[at]
                to = nxt[at].get(c)
            if to is not None:
                at, n = to, n + 1
            out.append(n)
        return out


def layout(length: int) -> tuple[int, int]:
    """(margin, places): a trigger is at one of ``places`` offsets from ``margin`` on."""
    if not 2 * GRAM <= length <= 10_000:
        raise ValueError(f"length must be from {2 * GRAM} to 10000 words")
    margin = length // 6
    return margin, length - GRAM - 2 * margin + 1


def word_ids(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit word ids, where each text's words begin and end)."""
    start, end, doc = word_spans(buf, offsets, NOT_SPACE)
    return word_hashes(buf, start, end), np.searchsorted(doc, np.arange(len(offsets)))


def parse(ids: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Phrases: text index, trigger place, offsets hi >= lo of its windows, context and phrase hashes."""
    margin, places = layout(length)
    none = {k: np.zeros(0, U if k in ("key", "hs") else np.int64) for k in ("doc", "t", "hi", "lo", "key", "hs")}
    n = len(ids) - length + 1
    if n <= 0:
        return none
    s = np.flatnonzero(np.arange(length, length + n) <= np.repeat(bounds[1:], np.diff(bounds))[:n])
    if not len(s):
        return none
    grams = mix(mix(mix(ids[:-2]) ^ ids[1:-1]) ^ ids[2:])
    v = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)  # the leftmost of equal ones
    width = 1
    while width * 2 <= places:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if width < places:
        v = np.minimum(v[:len(v) - (places - width)], v[places - width:])
    t = (v[s + margin] & _PLACE).astype(np.int64)
    cut = np.flatnonzero(t[1:] != t[:-1])
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(s) - 1]])
    a, b, t = s[first], s[last], t[first]
    doc = np.searchsorted(bounds, a, side="right") - 1
    context = np.full(len(t), GRAM + 2 * margin)
    return {"doc": doc, "t": t - bounds[doc], "hi": t - a, "lo": t - b, "key": folded(ids, t - margin, context, 1),
            "hs": mix(folded(ids, a, b - a + length, 2) ^ (t - a).astype(U))}


def _document_ranks(batch: pa.RecordBatch) -> np.ndarray:
    """Places of the batch's rows by (identifier, nulls first, text digest); alike rows share one."""
    t = pa.table({"i": batch.column("_id"), "t": batch.column("_td")})
    order = pc.sort_indices(t, [("i", "ascending"), ("t", "ascending")], null_placement="at_start")
    t = t.take(order).combine_chunks()
    i, td = t.column("i").combine_chunks(), np.asarray(t.column("t"))
    alike = np.zeros(len(td), bool)
    if len(td) > 1:
        both_null = np.asarray(pc.and_(pc.is_null(i[1:]), pc.is_null(i[:-1])))
        alike[1:] = (td[1:] == td[:-1]) & (both_null | np.asarray(pc.equal(i[1:], i[:-1]).fill_null(False)))
    rank = np.empty(len(td), np.int64)
    rank[np.asarray(order)] = np.cumsum(~alike)
    return rank


def batch_phrases(batch: pa.RecordBatch, length: int) -> dict[str, np.ndarray] | None:
    """Phrases of a batch, ordered by context, phrase and corpus; ``again``: an earlier one of the batch is alike."""
    buf, off = buffers(batch.column("_text"))
    found = []
    for i, j in chunks(off):
        p = parse(*word_ids(buf[off[i]:off[j]], off[i:j + 1] - off[i]), length)
        p["doc"] = p["doc"] + i
        found.append(p)
    p = {k: np.concatenate([f[k] for f in found]) for k in found[0]} if found else None
    if p is None or not len(p["doc"]):
        return None
    rank = _document_ranks(batch)
    order = np.lexsort((p["t"], rank[p["doc"]], p["hs"], p["key"]))
    p = {k: x[order] for k, x in p.items()}
    new = np.ones(len(order), bool)
    new[1:] = (p["key"][1:] != p["key"][:-1]) | (p["hs"][1:] != p["hs"][:-1])
    first, place = np.flatnonzero(new)[np.cumsum(new) - 1], rank[p["doc"]]
    p["again"] = (place != place[first]) | (p["t"] != p["t"][first])
    p["place"] = place
    return p


def _phrases(length: int, hot):
    """Phrases as rows; ``hot`` is a broadcast of the keys of the hot contexts."""
    def run(batches):
        for batch in batches:
            p = batch_phrases(batch, length)
            if p is None:
                continue
            is_hot = np.isin(p["key"].view(np.int64), hot.value)
            # What is settled here moves under a key of its own, so no phrase is a hot spot.
            alone = mix(p["hs"] ^ mix((p["place"].astype(U) << U(32)) ^ p["t"].astype(U)))
            key, at = np.where(p["again"], alone, p["key"]), pa.array(p["doc"])
            table = pa.table({"key": pa.array(key.view(np.int64)), "hs": pa.array(p["hs"].view(np.int64)),
                              "_id": batch.column("_id").take(at), "_td": batch.column("_td").take(at),
                              "t": pa.array(p["t"].astype(np.int32)), "hi": pa.array(p["hi"].astype(np.int16)),
                              "lo": pa.array(p["lo"].astype(np.int16)), "again": pa.array(p["again"]),
                              "hot": pa.array(is_hot & ~p["again"])})
            yield from table.to_batches(max_chunksize=50_000)

    return run


def hot_contexts(rows: DataFrame, length: int) -> DataFrame:
    """(key): contexts with more than 1 / (HOT_SHARE * partitions) of the phrases.

    A context with twice that share has half of that share in some batch; only such counts
    leave a batch.  What is hot decides where rows meet, not what is found.
    """
    share = 1 / (HOT_SHARE * parts(rows.sparkSession))

    def count(batches):
        for batch in batches:
            p = batch_phrases(batch, length)
            if p is None:
                continue
            key, n = np.unique(p["key"][~p["again"]], return_counts=True)
            many = (n > 1) & (n >= share / 2 * len(p["key"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(key[many].view(np.int64), 0)), pa.array(np.append(n[many], len(p["key"]))),
                                              pa.array(np.append(np.zeros(many.sum(), bool), True))], ["key", "n", "all"])

    counts = materialize(rows.select("_id", "_td", "_text").mapInArrow(count, "key bigint, n bigint, all boolean")
                         .groupBy("key", "all").agg(F.sum("n").alias("n")), "contexts")
    total = counts.where("all").agg(F.sum("n")).first()[0] or 0
    return counts.where(~F.col("all") & (F.col("n") > total * share)).select("key")


def _snippets(length: int):
    """The word ids of the phrases asked for, one row a phrase."""
    def run(batches):
        for b in batches:
            buf, off = buffers(b.column("_text"))
            asked = b.column("asked")
            for i, j in chunks(off):
                ids, bounds = word_ids(buf[off[i]:off[j]], off[i:j + 1] - off[i])
                a = asked.slice(i, j - i)
                owner = np.repeat(np.arange(j - i), np.asarray(pc.list_value_length(a)))
                flat = a.flatten()
                t, hi, lo = (np.asarray(flat.field(c)).astype(np.int64) for c in ("t", "hi", "lo"))
                start = bounds[owner] + t - hi
                size = hi - lo + length
                at = np.concatenate([[0], np.cumsum(size)])
                words = ids[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
                doc = pa.array(owner + i)
                yield from pa.table({
                    "key": flat.field("key"), "_id": b.column("_id").take(doc), "_td": b.column("_td").take(doc),
                    "start": pa.array(t - hi), "t": pa.array(t), "hot": flat.field("hot"),
                    "words": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(words.view(np.int64)))}
                ).to_batches(max_chunksize=20_000)

    return run


def shard_repeats(length: int):
    """Spans of a shard's phrases that an earlier phrase has too, and the first windows of slices.

    Rows come sorted by shard and, within it, in corpus order.
    """
    def run(batches):
        shard, automaton, before = None, SuffixAutomaton(), None
        for b in batches:
            docs, firsts = [], []
            columns = [b.column(c).to_pylist() for c in ("shard", "_id", "_td", "start", "t", "key", "hot", "words")]
            for row, (s, i, td, start, t, key, hot, words) in enumerate(zip(*columns)):
                if s != shard:
                    shard, automaton = s, SuffixAutomaton()
                elif (i, td, t, key) == before:  # the same place of a repeated row
                    continue
                before = (i, td, t, key)
                spans, new = [], []
                for at, n in enumerate(automaton.matches(words)):
                    if n < length:
                        if hot and at >= length - 1:
                            new.append(at - length + 1)
                    elif spans and at - n < spans[-1][1]:
                        spans[-1][1] = at + 1
                    else:
                        spans.append([at - n + 1, at + 1])
                automaton.add(words)
                docs += [(row, start + x, start + y) for x, y in spans]
                if new:
                    ids = np.array(words, np.int64).view(U)
                    new = np.array(new)
                    w1, w2 = (folded(ids, new, np.full(len(new), length), salt).view(np.int64) for salt in (3, 4))
                    firsts += [(row, start + x, start + x + length, p, q) for x, p, q in zip(new.tolist(), w1.tolist(), w2.tolist())]
            found = [(*d, None, None) for d in docs] + firsts
            if found:
                row, x, y, p, q = zip(*found)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("_id").take(row), b.column("_td").take(row),
                                                  *(pa.array(c, pa.int64()) for c in (x, y, p, q))],
                                                 ["_id", "_td", "from", "to", "w1", "w2"])

    return run


def repeated_runs(rows: DataFrame, length: int, shard: int = SHARD) -> DataFrame:
    """(_id, _td, from, to): spans of words covered by windows that also start earlier; they may overlap."""
    kind = rows.schema["_id"].dataType.simpleString()
    # At most HOT_SHARE * partitions keys; every phrase is told where it is made, without a join of all of them.
    hot = np.asarray(hot_contexts(rows, length).toArrow().column("key"), np.int64)
    phrases = rows.mapInArrow(_phrases(length, rows.sparkSession.sparkContext.broadcast(hot)),
                              f"key bigint, hs bigint, _id {kind}, _td bigint, t int, hi smallint, lo smallint, again boolean, hot boolean")
    # A hot context is dealt by phrase; it has several phrases for certain.
    dealt = phrases.withColumn("at", F.when(F.col("hot"), F.xxhash64("key", "hs")).otherwise(F.col("key"))).repartition("at")
    place = F.struct("again", F.col("_id").isNotNull().alias("has"), "_id", "_td", "t")
    variant = Window.partitionBy("at", "key", "hs").orderBy(place)
    told = dealt.withColumn("first", F.first(F.struct("_id", "_td", "t")).over(variant))
    # Rows alike in identifier and text are one document: the same place is no earlier one.
    repeat = F.col("again") | ~(F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_td") == F.col("first._td")) & (F.col("t") == F.col("first.t")))
    live = F.when(~F.col("again"), F.col("hs"))
    context = Window.partitionBy("at", "key")
    told = told.withColumn("repeat", repeat).withColumn("mixed", F.col("hot") | (F.min(live).over(context) != F.max(live).over(context)))
    told = materialize(told.where("repeat OR mixed").select("key", "_id", "_td", "t", "hi", "lo", "repeat"), "phrases")
    copies = told.where("repeat").select("_id", "_td", (F.col("t") - F.col("hi")).cast("long").alias("from"),
                                         (F.col("t") - F.col("lo") + length).cast("long").alias("to"))
    firsts = told.where("NOT repeat")
    sizes = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard)
    many = materialize(sizes, "large-contexts")
    n = firsts.count()
    # A row stands for more than ``shard`` phrases; beyond a broadcast's size Spark shuffles, and splits skew.
    sliced = firsts.join(many, "key", "left")
    key = F.when(F.col("n").isNotNull(), F.xxhash64("key", F.pmod(F.xxhash64("_id", "_td", "t"), F.ceil(F.col("n") / shard)))).otherwise(F.col("key"))
    asked = sliced.select("_id", "_td", "t", "hi", "lo", F.col("n").isNotNull().alias("hot"), key.alias("key")).groupBy("_id", "_td").agg(
        F.collect_set(F.struct("key", "t", "hi", "lo", "hot")).alias("asked"))
    shards = max(-(-n // shard), 1)
    found = by_document(rows, asked).select("_id", "_td", "_text", "asked").mapInArrow(
        _snippets(length), f"key bigint, _id {kind}, _td bigint, start bigint, t bigint, hot boolean, words array<bigint>")
    found = (found.withColumn("shard", F.pmod("key", F.lit(shards))).repartition("shard")
             .sortWithinPartitions("shard", F.col("_id").asc_nulls_first(), "_td", "t", "key"))
    settled = materialize(found.mapInArrow(
        shard_repeats(length), f"_id {kind}, _td bigint, `from` bigint, `to` bigint, w1 bigint, w2 bigint"), "settled")
    # First windows of slices: one row per slice and content.
    content = Window.partitionBy("w1", "w2").orderBy(F.col("_id").asc_nulls_first(), "_td", "from")
    across = settled.where("w1 IS NOT NULL").withColumn("nth", F.row_number().over(content)).where("nth > 1")
    spans = ["_id", "_td", "from", "to"]
    return copies.union(settled.where("w1 IS NULL").select(*spans)).union(across.select(*spans))


def remove_repeated_runs(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text",
                         with_text: bool = False, shard: int = SHARD) -> DataFrame:
    """(id, n_words, n_removed, spans, kept_sha256[, kept]), one row per row of ``docs``.

    ``spans`` are the maximal removed runs as (from, to) in words, ``kept`` the other words joined
    by one space.  Words are runs without space, tab, LF, VT, FF, CR, compared as they are (by
    64-bit hashes, of which all of a window's words must agree).  Windows are judged on the input.

    Null, empty and short texts lose nothing (null counts as empty).  Rows with the same
    identifier follow each other by ``xxhash64`` of the text; rows alike in both are one document
    and have the same result.  Null identifiers come first.  An empty table gives none; other
    columns of ``docs`` are ignored.
    """
    layout(length)
    rows = with_keys(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    spans = repeated_runs(rows, length, shard).groupBy("_id", "_td").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"))

    def cut(batches):
        for b in batches:
            out = []
            for text, found in zip(b.column("_text"), b.column("spans").to_pylist()):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                runs, kept, pos = [], [], 0
                for span in found or ():
                    x, y = span["from"], span["to"]
                    if runs and x <= runs[-1]["to"]:
                        runs[-1]["to"] = max(y, runs[-1]["to"])
                    else:
                        runs.append({"from": x, "to": y})
                for r in runs:
                    kept += words[pos:r["from"]]
                    pos = r["to"]
                left = b" ".join(kept + words[pos:] if runs else words)
                out.append((len(words), sum(r["to"] - r["from"] for r in runs), runs, hashlib.sha256(left).hexdigest(), left))
            n, removed, runs, digest, left = zip(*out) if out else ((),) * 5
            columns = [b.column("_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                       pa.array(runs, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(digest, pa.string())]
            names = [id_col, "n_words", "n_removed", "spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array([x.decode("utf-8") for x in left], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    extra = ", kept string" if with_text else ""
    return by_document(rows, spans, "left").select("_id", "_text", "spans").mapInArrow(
        cut, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, spans array<struct<`from`: bigint, `to`: bigint>>, kept_sha256 string{extra}")


SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
place AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
s AS (SELECT doc_id, i, string_agg(word, ' ') OVER r AS s, count(*) OVER r AS n FROM place
      WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, i) AS nth FROM s WHERE n = 20),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM k WHERE nth > 1),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM place ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
