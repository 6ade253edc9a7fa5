"""Target-distribution importance resampling over hashed word runs.

1. Byte translate and split: a table of 256 bytes lower-cases A-Z and blanks every separator
   of the UTF-8 text, ``bytes.split`` yields its words.  ``crc32`` of a run of words is chained:
   the checksum of the first words is the seed for a space and the next word.
2. Counters of buckets are filled per task and reduced to one row per bucket, for the documents
   and for the target texts; both give each bucket a gain, the scaled log ratio of its shares.
3. A document weighs the mean gain of its features.  Weight plus Gumbel noise, a function of the
   identifier, is its score; the highest scores are a sample without replacement by weight.
4. Narrow rows are ranked by ranges of (score, identifier), never in one task.

Only the ``buckets`` counts come to the driver and are broadcast, whatever the corpus' size.
A text longer than ``CHUNK`` bytes is split piece by piece.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fresh, materialize
from .mixing import ranked

#: Lower-cases A-Z; digits, letters and bytes of other characters stay, all else is blank.
BLANKED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
CHUNK = 1 << 20


def word_runs(raw: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of ``raw``, in lists of about ``chunk`` bytes; no word is cut."""
    text, start = raw.translate(BLANKED), 0
    while start < len(text):
        end = text.find(b" ", start + chunk)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def bucket_counts(raw: bytes, longest: int, buckets: int, chunk: int = CHUNK) -> tuple[Counter, int]:
    """(features by bucket, number of words): features are all runs of 1 to ``longest`` words."""
    found, n, tail = Counter(), 0, []
    for words in word_runs(raw, chunk):
        n += len(words)
        run = tail + words
        spaced = [b" " + w for w in run]
        crc = list(map(zlib.crc32, run))
        for k in range(longest):
            if k:
                crc = list(map(zlib.crc32, spaced[k:], crc))
            # Runs that end before the new words were counted with the list before.
            found.update([c % buckets for c in crc[max(len(tail) - k, 0):]])
        tail = run[max(len(run) - longest + 1, 0):]
    return found, n


def _raw(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def bucket_totals(texts: DataFrame, text_col: str, longest: int, buckets: int) -> list[int]:
    """How often the features of all texts fall into each bucket."""
    def count(batches):
        total = Counter()
        for b in batches:
            for text in b.column(0):
                total.update(bucket_counts(_raw(text), longest, buckets)[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(total.keys(), pa.int32()), "n": pa.array(total.values(), pa.int64())})

    rows = (texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = [0] * buckets
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    s_all, t_all, n = float(sum(corpus)), float(sum(target)), len(corpus)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus, target)]


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, longest: int = 2,
             buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank), one row per row of ``docs``.

    ``rank`` numbers the drawn documents from 1, highest score first, ties by smaller identifier
    (nulls last, then fewer features, smaller weight); it is null for all others.  Drawn are
    floor(``percent`` * N / 100) of the N documents with at least ``min_words`` words.

    Null, empty and wordless texts have no features and weight 0.  A null identifier draws as an
    empty one.  Rows alike in identifier and text score alike and take ranks one after another;
    repeated identifiers are separate rows.  An empty table gives none, an empty target leaves
    only the pull away from frequent buckets.  Other columns of ``docs`` are ignored.
    """
    gain = docs.sparkSession.sparkContext.broadcast(
        gains(bucket_totals(docs, text_col, longest, buckets), bucket_totals(target, target_col, longest, buckets)))

    def weigh(batches):
        value = gain.value
        for b in batches:
            words, features, weight = [], [], []
            for text in b.column(1):
                found, n = bucket_counts(_raw(text), longest, buckets)
                m = found.total()
                words.append(n)
                features.append(m)
                weight.append(sum(value[k] * c for k, c in found.items()) // m if m else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))],
                                             ["_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u)))
    # The number of the written row tells alike rows apart, so not even they meet in one range.
    scored = materialize(rows.mapInArrow(weigh, f"_id {kind}, n_words bigint, n_features bigint, weight bigint")
                         .withColumn("score", F.col("weight") + noise)
                         .withColumn("_row", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= min_words
    take = scored.where(enough).count() * percent // 100
    order = F.struct(-F.col("score"), F.col("_id").isNull(), "_id", "n_features", "weight", "_row")
    place = ranked(scored.where(enough), order).withColumn("rank", F.when(F.col("rank") < take, F.col("rank") + 1))
    out = [F.col("_id").alias(id_col), "n_words", "n_features", "weight", "score"]
    return (place.select(*out, F.col("rank").cast("long").alias("rank"))
            .unionByName(scored.where(~enough).select(*out, F.lit(None).cast("long").alias("rank"))))


def drawn(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose identifier was drawn, with all their columns."""
    i = fresh(docs, "_drawn")
    chosen = ranks.where("rank IS NOT NULL").select(F.col(id_col).alias(i)).distinct()
    return docs.join(chosen, docs[id_col].eqNullSafe(F.col(i)), "left_semi")


SQL = r"""
WITH RECURSIVE crc_step AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS MATERIALIZED (SELECT i, v FROM crc_step WHERE k = 8),
texts AS (SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT row_number() OVER (), 1, text FROM benchmark),
w AS MATERIALIZED (SELECT doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS MATERIALIZED (SELECT doc_id, side, unnest(list_concat(w, list_transform(w[2:], lambda x, i: w[i] || ' ' || x))) AS f FROM w),
names AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)),
crc AS (SELECT f, h, 0 AS k, 4294967295::BIGINT AS c FROM names
  UNION ALL SELECT f, h, k + 1, xor(c >> 8, v) FROM crc JOIN crc_table
    ON i = xor(c & 255, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) WHERE 2 * k < length(h)),
bucket AS MATERIALIZED (SELECT f, xor(c, 4294967295) % 10000 AS b FROM crc WHERE 2 * k = length(h)),
n AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM runs JOIN bucket USING (f) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
                / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM n),
sums AS (SELECT doc_id, sum(g)::BIGINT AS g, count(*) AS m FROM runs JOIN bucket USING (f) JOIN gain USING (b) WHERE side = 0 GROUP BY doc_id),
scored AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(m, 0)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / m), 0)::BIGINT AS weight,
             (('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
           FROM w LEFT JOIN sums USING (doc_id) WHERE side = 0),
s AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln(u)))::BIGINT AS score FROM scored),
r AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place,
             (SELECT count(*) * 25 // 100 FROM s WHERE n_words >= 20) AS take FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= take THEN place END AS rank FROM r"""
