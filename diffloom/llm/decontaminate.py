"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of consecutive words, and a window is a set of
placed word shingles.  The documents' shingles that occur in any item at all are found in one
scan; their corpus counts order shingles by rarity, and only the rarest shingle of each window
(the prefix that full containment needs) is joined.  Candidates must fit the document by
position and length and are then verified shingle by shingle over the item-sized window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, normalized_words, whole

SHINGLE, WINDOW = 5, 10
#: Largest broadcast of shingle hashes; above it the join is an ordinary shuffled one.
MAX_BROADCAST_BYTES = 64 << 20


def _join(words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


def shingle_rows(words: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """(keys, pos, w0..) one row per run of ``size`` words; ``words`` has ``keys`` and an array ``w``.

    Shifted copies of the array are zipped, so no word is looked up by a lambda.
    """
    shifted = [F.slice("w", i + 1, F.greatest(F.size("w") - (size - 1), F.lit(0))).alias(f"w{i}")
               for i in range(size)]
    zipped = F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])
    return words.where(F.size("w") >= size).select(*keys, F.posexplode(zipped).alias("pos", "z")).select(
        *keys, "pos", *[F.col(f"z.w{i}").alias(f"w{i}") for i in range(size)])


def item_windows(bench: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, len, words) and which items have them (wid, item)."""
    items = bench.select(F.col(id_col).alias("item"), normalized_words(text_col).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    cut = items.select("item", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("words")).distinct()
    wid = _join([F.col("words")])
    cut = cut.withColumn("wid", wid)
    return (cut.select("wid", F.size("words").alias("len"), "words").dropDuplicates(["wid"]),
            cut.select("wid", "item").distinct())


def window_hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Occurrences (_id, _td, start, len, wid) of benchmark windows in documents, and (wid, item).

    ``_td`` (xxhash64 of the text) tells apart rows that share an identifier.  Words are runs
    of letters, digits and non-ASCII characters after lower-casing A-Z; an item of fewer than
    ``window`` words is one window, wordless items and documents have none.  Repeated items
    and repeated documents give the same occurrences once.
    """
    windows, owners = item_windows(bench, window, item_col, item_text_col)
    windows, owners = materialize(windows, "windows"), materialize(owners, "owners")
    size = F.least(F.col("len"), F.lit(shingle))
    # Placed shingles of every window: (wid, len, off, k, shingle).
    placed = materialize(windows.select("wid", "len", size.alias("k"), F.posexplode(F.transform(
        F.sequence(F.lit(1), F.col("len") - size + 1),
        lambda i: F.array_join(F.slice("words", i, size), " "))).alias("off", "shingle")), "placed")
    text = whole(text_col)
    words = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_td"),
                        normalized_words(text_col).alias("w"))
    words = words.withColumn("n", F.size("w"))
    found = None
    sizes = [r[0] for r in placed.select("k").distinct().collect()]  # at most ``shingle`` numbers
    for k in sorted(sizes):
        known = placed.where(F.col("k") == k).select("shingle").distinct().withColumn(
            "h", F.xxhash64(*[F.get(F.split("shingle", " "), F.lit(i)) for i in range(k)]))
        hashes = known.select("h").distinct()
        if hashes.count() * 16 <= max_broadcast:
            hashes = F.broadcast(hashes)
        runs = shingle_rows(words, k, ["_id", "_td", "n"])
        w = [F.col(f"w{i}") for i in range(k)]
        seen = (runs.withColumn("h", F.xxhash64(*w)).join(hashes, "h", "left_semi")
                .select("_id", "_td", "n", "pos", F.lit(k).alias("k"), _join(w).alias("shingle")))
        found = seen if found is None else found.unionByName(seen)
    if found is None:  # no item has a word
        found = words.select("_id", "_td", "n", F.lit(0).alias("pos"), F.lit(0).alias("k"),
                             F.lit("").alias("shingle")).where(F.lit(False))
    found = materialize(found.distinct(), "found")
    # Rarity over all documents.  A window with an unseen shingle occurs nowhere.
    counts = found.groupBy("shingle", "k").agg(F.count(F.lit(1)).alias("c"))
    rare = (placed.join(counts, ["shingle", "k"], "left").groupBy("wid", "len").agg(
        F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "off", "shingle", "k")).alias("r"))
        .where(F.col("r.c") > 0))
    prefix = rare.select("wid", "len", F.col("r.off").alias("off"), F.col("r.shingle").alias("shingle"),
                         F.col("r.k").alias("k"))
    candidates = (found.join(prefix, ["shingle", "k"])
                  .withColumn("start", F.col("pos") - F.col("off"))
                  .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
                  .select("_id", "_td", "start", "len", "wid"))
    # Shingles at every k-th offset and at the last one cover the window.
    tiles = placed.where((F.col("off") % F.col("k") == 0) | (F.col("off") == F.col("len") - F.col("k")))
    need = tiles.groupBy("wid").agg(F.count(F.lit(1)).alias("tiles"))
    parts = (candidates.join(tiles.select("wid", "off", "k", "shingle"), "wid")
             .withColumn("pos", F.col("start") + F.col("off")))
    f = found.select(F.col("_id").alias("_fid"), "_td", "pos", "k", "shingle")
    verified = (parts.join(f, ["_td", "pos", "k", "shingle"]).where(F.col("_id").eqNullSafe(F.col("_fid")))
                .groupBy("_id", "_td", "start", "len", "wid").agg(F.count(F.lit(1)).alias("got"))
                .join(need, "wid").where(F.col("got") == F.col("tiles"))
                .select("_id", "_td", "start", "len", "wid"))
    return verified, owners


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(id, text_digest, n_words, n_hit, items), one row per row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` has the
    identifiers (as strings, sorted) of the items with such windows; null item identifiers
    count as the string "null".  See ``window_hits``.  Empty tables give no hits or no rows.
    """
    hits, owners = window_hits(docs, bench, window, shingle, id_col, text_col, item_col, item_text_col,
                               max_broadcast)
    hits = materialize(hits, "hits")
    # Words covered by the union of spans: each span adds what lies beyond all earlier ones.
    order = Window.partitionBy("_id", "_td").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = (hits.select("_id", "_td", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
             .withColumn("_reach", F.coalesce(F.max("end").over(order), F.lit(0)))
             .groupBy("_id", "_td").agg(F.sum(F.greatest(
                 F.lit(0), F.col("end") - F.greatest("start", "_reach"))).alias("n_hit")))
    items = (hits.select("_id", "_td", "wid").distinct().join(owners, "wid").groupBy("_id", "_td").agg(
        F.sort_array(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit("null")))).alias("items")))
    per_doc = spans.join(items.select(F.col("_id").alias("_iid"), F.col("_td").alias("_itd"), "items"),
                         F.col("_id").eqNullSafe(F.col("_iid")) & (F.col("_td") == F.col("_itd")))
    per_doc = per_doc.select("_id", "_td", "n_hit", "items")
    text = whole(text_col)
    base = docs.select(F.col(id_col).alias("_did"), F.xxhash64(text).alias("text_digest"),
                       F.size(normalized_words(text_col)).cast("long").alias("n_words"))
    return (base.join(per_doc, F.col("_did").eqNullSafe(F.col("_id")) & (F.col("text_digest") == F.col("_td")), "left")
            .select(F.col("_did").alias(id_col), "text_digest", "n_words",
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


_W = (r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
      r" 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_W} AS w FROM documents),
i AS MATERIALIZED (SELECT item_id, {_W} AS w FROM benchmark),
iw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(
        range(1, len(w) - least(len(w), 10) + 2), lambda j: array_to_string(w[j:j + least(len(w), 10) - 1], ' '))) AS win
      FROM i WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM iw),
dw AS MATERIALIZED (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, unnest(list_transform(
        range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) AS win FROM d, lens WHERE len(w) >= n),
hit AS MATERIALIZED (SELECT doc_id, dw.n, pos, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
            SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT doc_id, n, pos FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
            SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)"""
