"""Near-dedup: improved consistent weighted sampling over TF-IDF word shingles.

1. One pass counts in how many documents each shingle occurs, in a count-min sketch sized
   by the documents' mean length, not by their number; it gives inverse document frequencies.
2. One pass draws consistent weighted samples of every text's TF-IDF weights.  Texts with
   the same weighted set collapse to one node; everything after this is narrow.
3. Samples are banded.  Members of a bucket are linked to its centre, the member that agrees
   most with the samples the bucket's members have most often; the links are verified by
   weighted Jaccard similarity of the whole texts, and components are formed.
4. In buckets whose members are still in several components, all pairs across components are
   verified as well, by whole texts inside the tasks that hold a tile of members, which
   return links only.  So no link of two members of a bucket is lost to the star of step 3,
   and no group is expanded into pairs.  Large buckets are cut into pairs of tiles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bytes_np import U, buffers, chunks, mix, shingles, weighted_set, word_spans
from .common import fresh, materialize, whole
from .graph import components

#: At least so many cells a row of the sketch.
CELLS, ROWS_OF_CELLS = 1 << 16, 2


@dataclass(frozen=True)
class Params:
    """``shingle`` words; ``bands`` of ``rows`` samples; pairs from ``threshold`` on are near copies.

    A pair at similarity s shares a band with probability 1 - (1 - s**rows)**bands: 0.995 at 0.8.
    ``floor``: a shingle in a smaller share of the documents counts as in that share, which also
    hides the sketch's error: its cells are loaded to half of ``floor`` at most.  ``tile``: members of a bucket that are compared
    in one task, and ``tile_bytes`` of their texts, a side (on average; one text may be longer).
    """

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 10
    rows: int = 4
    floor: float = 0.01
    tile: int = 512
    tile_bytes: int = 1 << 20

    @property
    def samples(self) -> int:
        return self.bands * self.rows


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    a = mix(h ^ U(0xA0761D6478BD642F))
    return np.stack([(a & U(cells - 1)).astype(np.int64),
                     ((a >> U(32)) & U(cells - 1)).astype(np.int64) + cells])


def sketch_cells(docs: DataFrame, text_col: str, p: Params) -> int:
    """Cells a row of the sketch needs so that the mean load of a cell is at most half of floor * N.

    A document adds one to at most as many cells as it has shingles; these are counted here.
    """
    def count(batches):
        total = found = 0
        for b in batches:
            buf, off = buffers(b.column(0))
            total += len(off) - 1
            for i, j in chunks(off):
                words = np.bincount(word_spans(buf[off[i]:off[j]], off[i:j + 1] - off[i])[2], minlength=j - i)
                found += int(np.maximum(words - p.shingle + 1, words > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([found])], ["total", "found"])

    got = docs.select(F.col(text_col)).mapInArrow(count, "total bigint, found bigint").agg(F.sum("total"), F.sum("found")).first()
    mean = (got[1] or 0) / max(got[0] or 0, 1)
    return max(CELLS, 1 << int(np.ceil(np.log2(max(2 * mean / p.floor, 1)))))


def inverse_frequencies(docs: DataFrame, text_col: str, p: Params) -> np.ndarray:
    """IDF by cell of the sketch (float32): log((1 + N) / (1 + n)) + 1, n at least floor * N."""
    cells = sketch_cells(docs, text_col, p)

    def count(batches):
        n, total = np.zeros(cells * ROWS_OF_CELLS, np.int64), 0
        for b in batches:
            buf, off = buffers(b.column(0))
            total += len(off) - 1
            for i, j in chunks(off):
                h, _, _ = weighted_set(*shingles(buf[off[i]:off[j]], off[i:j + 1] - off[i], p.shingle))
                n += np.bincount(_cells(h, cells).ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)),
                                          pa.array(np.append(n[at], total))], ["cell", "n"])

    # As many rows as the sketch has cells, plus one for the number of documents.
    got = docs.select(F.col(text_col)).mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(
        F.sum("n").alias("n")).toArrow()
    cell, n = np.asarray(got.column("cell")), np.asarray(got.column("n"))
    total = int(n[cell == -1].sum())
    counts = np.zeros(cells * ROWS_OF_CELLS)
    counts[cell[cell >= 0]] = n[cell >= 0]
    return (np.log((1 + total) / (1 + np.maximum(counts, p.floor * total))) + 1).astype(np.float32)


def weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF; the larger IDF of the sketch's rows belongs to the smaller, better count."""
    a, b = _cells(h, len(idf) // ROWS_OF_CELLS)
    return count * np.maximum(idf[a], idf[b])


_TABLE = 1 << 14
_rng = np.random.Generator(np.random.PCG64(1789))
#: Draws of Gamma(2, 1), and logarithms of further ones.
_GAMMA = (-np.log(_rng.random(_TABLE, np.float64) * _rng.random(_TABLE, np.float64) + 1e-300)).astype(np.float32)
_LOG_GAMMA = np.log(-np.log(_rng.random(_TABLE) * _rng.random(_TABLE) + 1e-300)).astype(np.float32)


def consistent_samples(h: np.ndarray, w: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """uint32 samples [text, sample] of weighted sets; ``first`` has where each text begins.

    Per shingle and sample: r, c ~ Gamma(2, 1) and b ~ U(0, 1), functions of both; then
    t = floor(ln w / r + b), ln y = r * (t - b), ln a = ln c - ln y - r.  The shingle with the
    smallest a is drawn, with its t.
    """
    out = np.empty((len(first), samples), np.uint32)
    log_w = np.log(w).astype(np.float32)
    step, low = 1 << 15, U(0xFFFFFFFF)
    best = np.empty(len(h), U)
    for k in range(samples):
        seed = mix(np.array([k + 1], U) * U(0x2545F4914F6CDD1D))[0]
        for s in range(0, len(h), step):
            x = (h[s:s + step] ^ seed) * U(0xBF58476D1CE4E5B9)
            x ^= x >> U(29)
            x *= U(0x94D049BB133111EB)
            r = _GAMMA[((x >> U(50))).astype(np.int32)]
            lc = _LOG_GAMMA[((x >> U(36)) & U(_TABLE - 1)).astype(np.int32)]
            b = ((x >> U(12)) & U(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_w[s:s + step] / r + b)
            # Positive floats sort like their bits; 256 is far above any -ln a here.
            la = lc - r * (t - b) - r + np.float32(256)
            key = np.maximum(la, np.float32(0)).view(np.uint32).astype(U) << U(32)
            code = (x ^ (t.astype(np.int64).view(U) * U(0x9FB21C651E98DF25))) >> U(24)
            best[s:s + step] = key | (code & low)
        out[:, k] = (np.minimum.reduceat(best, first) & low).astype(np.uint32)
    return out


def _band_keys(sig: np.ndarray, p: Params) -> np.ndarray:
    parts = sig.reshape(len(sig), p.bands, p.rows).astype(U)
    key = np.broadcast_to(np.arange(1, p.bands + 1, dtype=U), parts.shape[:2]).copy()
    for i in range(p.rows):
        key = mix(key ^ parts[:, :, i])
    return key


def signatures(docs: DataFrame, idf, id_col: str, text_col: str, p: Params) -> DataFrame:
    """(_id, _td, node, total, bands, sig): ``node`` is the digest of the weighted set.

    Wordless texts get the digest of their bytes instead and no bands.
    """
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches):
        for b in batches:
            buf, off = buffers(b.column("_text"))
            for i, j in chunks(off):
                part, o = buf[off[i]:off[j]], off[i:j + 1] - off[i]
                h, doc, count = weighted_set(*shingles(part, o, p.shingle))
                n = j - i
                node, total = np.zeros((n, 2), U), np.zeros(n)
                bands, sigs = [[]] * n, [b""] * n
                if len(h):
                    w = weights(h, count, shared.value)
                    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    has = doc[first]
                    for c, salt in enumerate((U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3))):
                        node[has, c] = mix(np.add.reduceat(mix(h ^ salt) * count.astype(U), first))
                    total[has] = np.add.reduceat(w.astype(np.float64), first)
                    sig = consistent_samples(h, w, first, p.samples)
                    keys = _band_keys(sig, p).view(np.int64)
                    for r, d in enumerate(has):
                        bands[d], sigs[d] = keys[r], sig[r].tobytes()
                for d in np.flatnonzero(total == 0):
                    node[d] = _digest(part[o[d]:o[d + 1]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(i, n), b.column("_td").slice(i, n),
                     pa.array([x.tobytes() for x in node], pa.binary()), pa.array(total),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["_id", "_td", "node", "total", "bands", "sig"])

    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(whole(text_col)).alias("_td"),
                       F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"_id {kind}, _td bigint, node binary, total double, bands array<bigint>, sig binary")


def _digest(text: bytes) -> np.ndarray:
    import hashlib
    return np.frombuffer(hashlib.blake2b(text, digest_size=16, person=b"wordless").digest(), U)


def similar_pairs(pairs: DataFrame, texts: DataFrame, idf, p: Params) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts have weighted Jaccard similarity >= threshold."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def verify(batches):
        for b in batches:
            ta, oa = buffers(b.column("ta"))
            tb, ob = buffers(b.column("tb"))
            keep = np.zeros(b.num_rows, bool)
            for i, j in chunks(oa + ob):
                sets = [weighted_set(*shingles(t[o[i]:o[j]], o[i:j + 1] - o[i], p.shingle))
                        for t, o in ((ta, oa), (tb, ob))]
                h = np.concatenate([s[0] for s in sets])
                doc = np.concatenate([s[1] for s in sets])
                w = np.concatenate([weights(s[0], s[2], shared.value) for s in sets])
                order = np.lexsort((h, doc))
                h, doc, w = h[order], doc[order], w[order]
                same = np.zeros(len(h), bool)
                same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
                at = np.flatnonzero(same)
                both = np.bincount(doc[at], np.minimum(w[at], w[at - 1]), minlength=j - i)
                every = np.bincount(doc, w, minlength=j - i)
                keep[i:j] = both >= p.threshold * (every - both) - 1e-9
                keep[i:j] &= every > 0
            yield b.select(["a", "b"]).filter(pa.array(keep))

    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(verify, "a binary, b binary")


def _overlaps(h: np.ndarray, doc: np.ndarray, count: np.ndarray, unit: np.ndarray, probe: np.ndarray,
              block: int = 256, step: int = 1 << 18) -> np.ndarray:
    """Weight shared by texts [probe, base]: minima summed over shingles; ``probe`` tells texts apart.

    A shingle of weight ``unit`` that a text has c times is the elements (shingle, 0 .. c - 1), so
    minima become common elements.  Elements in few pairs of texts add to each by an inverted
    list; those in many are columns of two matrices, multiplied ``block`` columns at a time.
    """
    n_probe, n_base = int(probe.sum()), int((~probe).sum())
    place = np.where(probe, np.cumsum(probe), np.cumsum(~probe)) - 1
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    h, doc, unit = (np.repeat(x, count) for x in (h, doc, unit))
    order = np.lexsort((level, h))
    h, doc, unit, level = h[order], doc[order], unit[order], level[order]
    e = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]) | (level[1:] != level[:-1])])) if len(h) else level
    mine = probe[doc]
    in_probe, in_base = np.bincount(e[mine], minlength=len(h)), np.bincount(e[~mine], minlength=len(h))
    many = in_probe * in_base > max(n_probe * n_base // 64, 1)
    out = np.zeros(n_probe * n_base)
    few = ~many[e] & (in_probe * in_base > 0)[e]
    a, b = np.flatnonzero(few & mine), np.flatnonzero(few & ~mine)
    n, first = in_base[e[a]], np.searchsorted(e[b], e[a])
    ends = np.cumsum(n)
    i = 0
    while i < len(a):
        j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + step, side="right")), i + 1)
        m = n[i:j]
        at = b[np.arange(m.sum()) + np.repeat(first[i:j] - (np.cumsum(m) - m), m)]
        own = np.repeat(a[i:j], m)
        out += np.bincount(place[doc[own]] * n_base + place[doc[at]], unit[own], minlength=len(out))
        i = j
    out = out.reshape(n_probe, n_base)
    column = np.cumsum(many) - 1
    at = np.flatnonzero(many[e])
    for k in range(0, int(many.sum()), block):
        part = at[np.searchsorted(column[e[at]], k):np.searchsorted(column[e[at]], k + block)]
        left, right = np.zeros((n_probe, block)), np.zeros((n_base, block))
        x, y = part[mine[part]], part[~mine[part]]
        left[place[doc[x]], column[e[x]] - k] = unit[x]
        right[place[doc[y]], column[e[y]] - k] = 1
        out += left @ right.T
    return out


def _tile_links(p: Params, shared):
    """Links of a tile's probes with its base members of other components, by whole texts.

    Every pair that the total weights allow is verified, in the first bucket it shares.  One link of two components is enough.
    """
    def links(table: pa.Table) -> pa.Table:
        probe = np.asarray(table.column("probe"))
        node, label = table.column("node").to_pylist(), table.column("label").to_pylist()
        names: dict = {}
        part = np.array([names.setdefault(x, len(names)) for x in label])
        buf, off = buffers(table.column("text"))
        sets = []
        for i, j in chunks(off):
            h, doc, count = weighted_set(*shingles(buf[off[i]:off[j]], off[i:j + 1] - off[i], p.shingle))
            sets.append((h, doc + i, count, weights(h, np.ones(len(h)), shared.value)))
        h, doc, count, unit = (np.concatenate([s[c] for s in sets]) for c in range(4))
        del sets
        total = np.bincount(doc, count * unit, minlength=len(node))
        one, two = np.flatnonzero(probe), np.flatnonzero(~probe)
        t1, t2 = total[one][:, None], total[two]
        open_ = (part[one][:, None] != part[two]) & (np.minimum(t1, t2) >= (p.threshold - 1e-6) * np.maximum(t1, t2))
        # Two texts that share an earlier band meet in its bucket, which is mixed as well.
        keys = np.array(table.column("bands").to_pylist(), np.int64)
        for band in range(int(table.column("band")[0].as_py())):
            open_ &= keys[one, band][:, None] != keys[two, band]
        one, two = one[open_.any(axis=1)], two[open_.any(axis=0)]
        open_ = open_[open_.any(axis=1)][:, open_.any(axis=0)]
        found = {}
        if len(one):
            used = np.zeros(len(node), bool)
            used[one] = used[two] = True
            new = np.cumsum(used) - 1
            keep = used[doc]
            both = _overlaps(h[keep], new[doc[keep]], count[keep], unit[keep], probe[used])
            good = open_ & (both >= p.threshold * (total[one][:, None] + total[two] - both) - 1e-9)
            for i, k in zip(*np.nonzero(good)):
                i, k = one[i], two[k]
                found.setdefault((part[i], part[k]), (min(node[i], node[k]), max(node[i], node[k])))
        return pa.table({"a": pa.array([a for a, _ in found.values()], pa.binary()),
                         "b": pa.array([b for _, b in found.values()], pa.binary())})

    return links


def centres(members: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """(band, key, a): the centre of each bucket of ``members`` (band, key, node, n).

    Of two members either will do; of more, the one that agrees best with the bucket's
    most frequent samples.  Counts are pre-aggregated, so a large bucket is no hot spot.
    """
    two = members.where("n = 2").groupBy("band", "key").agg(F.min("node").alias("a"))
    several = members.where("n > 2").select("band", "key", "node").join(nodes.select("node", "sig"), "node")
    # Samples are four bytes each.
    numbers = F.transform(F.sequence(F.lit(0), F.lit(p.samples - 1)), lambda i: F.substring(F.col("sig"), i * 4 + 1, F.lit(4)))
    flat = several.select("band", "key", "node", F.posexplode(numbers).alias("at", "sample"))
    often = (flat.groupBy("band", "key", "at", "sample").agg(F.count(F.lit(1)).alias("c"))
             .groupBy("band", "key", "at").agg(F.max(F.struct("c", "sample"))["sample"].alias("sample")))
    agree = (flat.join(often, ["band", "key", "at", "sample"]).groupBy("band", "key", "node").agg(F.count(F.lit(1)).alias("c")))
    return two.unionByName(agree.groupBy("band", "key").agg(F.max(F.struct("c", "node"))["node"].alias("a")))


def open_links(members: DataFrame, labels: DataFrame, texts: DataFrame, p: Params, shared) -> DataFrame | None:
    """Links (a, b) across components of mixed buckets; None if every bucket is of one component.

    ``texts`` has node, text, bands and size (bytes).  Only members outside a bucket's largest
    component are probes, and every pair across components has one.  A group holds one tile of
    probes and one tile of members.
    """
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = (labelled.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("band", "key")
             .agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
             .where(F.col("all") > F.col("most")))
    mixed = materialize(mixed, "mixed")
    if not mixed.count():
        return None
    rows = labelled.drop("n").join(mixed, ["band", "key"]).join(texts.select("node", "size"), "node")
    probe = F.col("label") != F.col("main")
    sizes = rows.groupBy("band", "key").agg(F.sum(F.when(probe, F.col("size")).otherwise(0)).alias("probe_bytes"), F.sum("size").alias("all_bytes"))
    rows = rows.drop("size").join(sizes, ["band", "key"])

    def tiles(count, size):
        return F.greatest(F.ceil(count / p.tile), F.ceil(F.col(size) / p.tile_bytes)).cast("int")

    probe_tiles, base_tiles = tiles(F.col("all") - F.col("most"), "probe_bytes"), tiles(F.col("all"), "all_bytes")
    own = F.xxhash64("node")
    shape = ["band", "key", "label", "node", "probe", "t1", "t2"]
    probes = rows.where(probe).withColumns({
        "probe": F.lit(True), "t1": F.pmod(own, probe_tiles).cast("int"), "t2": F.explode(F.sequence(F.lit(0), base_tiles - 1))})
    base = rows.withColumns({
        "probe": F.lit(False), "t1": F.explode(F.sequence(F.lit(0), probe_tiles - 1)), "t2": F.pmod(own, base_tiles).cast("int")})
    # Texts join once a place in a tile; until then rows are narrow.
    placed = probes.select(*shape).unionByName(base.select(*shape)).join(texts.drop("size"), "node")
    return (placed.groupBy("band", "key", "t1", "t2").applyInArrow(_tile_links(p, shared), "a binary, b binary").distinct())


def near_duplicates(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, text_digest, class_id, class_size, kept), one row per row of ``docs``.

    A class is a connected component of near copies; ``class_id`` is its smallest identifier
    (null only if all are null) and the row with it is ``kept``.  Words are lower-cased runs of
    letters, digits and non-ASCII characters; texts of fewer than ``shingle`` words are one
    shingle; wordless texts (null counts as empty) are near copies of equal texts only.
    Repeated identifiers are separate rows; of rows alike in identifier and text all have the
    same result.  An empty table gives none.
    """
    idf = inverse_frequencies(docs, text_col, p)
    rows = materialize(signatures(docs, idf, id_col, text_col, p), "signatures")
    # One row per distinct weighted set, and one document that has it.
    nodes = materialize(rows.where(F.size("bands") > 0).groupBy("node").agg(
        F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_td")).alias("r"), F.first("total").alias("total"),
        F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    bands = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    counts = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(bands.join(counts, ["band", "key"]).select("band", "key", "node", "n"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "r", "bands"), "node").select(
        "node", "bands", F.col("r._id").alias("_rid"), F.col("r._td").alias("_rtd"))
    text = whole(text_col)
    have = docs.select(F.col(id_col).alias("_did"), F.xxhash64(text).alias("_dtd"), text.alias("text"))
    texts = materialize(have.join(wanted, F.col("_did").eqNullSafe(F.col("_rid")) & (F.col("_dtd") == F.col("_rtd")))
                        .select("node", "text", "bands", F.octet_length("text").alias("size")).dropDuplicates(["node"]), "candidates")
    stars = members.join(centres(members, nodes, p), ["band", "key"]).where("a <> node")
    tested = materialize(stars.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "pairs")
    links = materialize(similar_pairs(tested, texts, idf, p), "links")
    labels = components(links)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    rest = open_links(members, labels, texts, p, shared)
    if rest is not None:
        found = materialize(rest, "links")
        if found.count():
            labels = components(links.union(found))
    classed = materialize(rows.select("_id", "_td", "node").join(labels, "node", "left").select(
        "_id", "_td", F.coalesce("label", "node").alias("label")), "classed")
    first = classed.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_td")).alias("f"),
                                         F.count(F.lit(1)).alias("class_size"))
    return classed.join(first, "label").select(
        F.col("_id").alias(id_col), F.col("_td").alias("text_digest"), F.col("f._id").alias("class_id"),
        "class_size", (F.col("_id").eqNullSafe(F.col("f._id")) & (F.col("_td") == F.col("f._td"))).alias("kept"))


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each class."""
    i, td, nth = (fresh(docs, x) for x in ("_id", "_td", "_nth"))
    k = classes.where("kept").select(F.col(id_col).alias(i), F.col("text_digest").alias(td)).distinct()
    digest = F.xxhash64(whole(docs[text_col]))
    joined = docs.join(k, docs[id_col].eqNullSafe(k[i]) & (digest == k[td]))
    alike = Window.partitionBy(i, td).orderBy(F.lit(0))
    return joined.withColumn(nth, F.row_number().over(alike)).where(F.col(nth) == 1).select(*docs.columns)
