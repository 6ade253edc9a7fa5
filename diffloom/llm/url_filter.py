"""URL rules by a Bloom filter cascade.

The key universe of a corpus is known: every (host suffix, path start) that any of its
urls could match a rule with.  Level 1 encodes the listed keys, level 2 the keys of the
universe that level 1 wrongly lets through, level 3 the listed keys that level 2 wrongly
lets through, and so on until a level makes no error.  Membership is then exact for
every key of the universe, and judging a url needs no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, materialize, whole

MAX_BYTES = 256 << 20
MAX_LEVELS = 64
ALLOW, BLOCK = 1, 2


@dataclass(frozen=True)
class Level:
    words: np.ndarray  # uint64
    bits: int
    hashes: int

    def positions(self, h1: np.ndarray, h2: np.ndarray):
        for j in range(self.hashes):
            yield (h1 + np.uint64(j) * (h2 | np.uint64(1))) % np.uint64(self.bits)

    def passes(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for p in self.positions(h1, h2):
            ok &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return ok


def _salted(h1: np.ndarray, h2: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a level: levels must err independently."""
    s = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    a = (h1 ^ s) * np.uint64(0xBF58476D1CE4E5B9)
    b = (h2 ^ s) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(29)) ^ b, b ^ (b >> np.uint64(31))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    @property
    def size_bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe the cascade was built over."""
        inside = np.zeros(len(h1), bool)
        alive = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            ok = level.passes(*_salted(h1[alive], h2[alive], i))
            # Who stops at an even level was let through by the odd one before: listed.
            inside[alive[~ok]] = i % 2 == 1
            alive = alive[ok]
        inside[alive] = len(self.levels) % 2 == 1
        return inside


def _hashes(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("cascade"), F.col("key")).alias("h2"))


def _u64(a) -> np.ndarray:
    return np.asarray(a, dtype=np.int64).view(np.uint64)


def _fill(keys: DataFrame, count: int, rate: float, index: int, max_bytes: int) -> Level:
    """A Bloom filter of ``keys``: partial words per task, merged by bit_or."""
    bits = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
    if bits // 8 > max_bytes:
        raise ValueError(f"a filter of {bits // 8} bytes exceeds {max_bytes}; raise max_bytes or split the list")
    shape = Level(np.zeros(0, np.uint64), bits, max(1, round(bits / count * math.log(2))))

    def partial(batches):
        for b in batches:
            at = [p for p in shape.positions(*_salted(_u64(b.column("h1")), _u64(b.column("h2")), index))]
            p = np.unique(np.concatenate(at)) if at else np.zeros(0, np.uint64)
            word, first = np.unique(p >> np.uint64(6), return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))],
                                                 ["word", "bits"])

    words = np.zeros(-(-bits // 64), np.uint64)
    # Bounded by the size of the filter, which was checked.
    for word, value in (keys.select("h1", "h2").mapInArrow(partial, "word bigint, bits bigint")
                        .groupBy("word").agg(F.bit_or("bits")).collect()):
        words[word] = np.int64(value).view(np.uint64)
    return Level(words, bits, shape.hashes)


def _let_through(keys: DataFrame, level: Level, index: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.arrow_udf("boolean")
    def passes(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(shared.value.passes(*_salted(_u64(h1), _u64(h2), index)))

    return keys.where(passes("h1", "h2"))


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade:
    """The cascade of ``listed`` keys over all keys of ``universe`` (both: a column ``key``).

    Repeated keys count once; null keys are left out.  An empty list gives no level, and
    nothing is inside.  The filters' bytes grow with the list (times the logarithm of the
    universe over it) and are checked against ``max_bytes``.
    """
    listed = materialize(_hashes(listed.where("key IS NOT NULL").distinct()), "listed")
    universe = _hashes(universe.where("key IS NOT NULL"))
    n = listed.count()
    if n == 0:
        return Cascade(())
    around = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, max(2.0 ** -40, n * math.sqrt(0.5) / max(1, around)))
    levels = [_fill(listed, n, rate, 0, max_bytes)]
    inside, outside = listed, materialize(
        _let_through(universe, levels[0], 0).distinct().join(listed.select("key"), "key", "left_anti"), "passed")
    while (count := outside.count()) > 0:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two different keys share both hashes")
        i = len(levels)
        levels.append(_fill(outside, count, 0.5, i, max_bytes))
        inside, outside = outside, materialize(_let_through(inside, levels[-1], i), "passed")
    return Cascade(tuple(levels))


def url_parts(url: str) -> tuple[Column, Column]:
    """(host, path): both empty for a null url or one without ``://``."""
    u = whole(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def candidate_keys(host: str, path: str, lengths: list[int]) -> Column:
    """Keys a rule could match: every host suffix with every path start of a rule's length."""
    labels = F.split(F.col(host), r"\.", -1)
    n = F.size(labels)
    suffixes = F.when(F.col(host) == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))
    starts = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"),
                                  lambda x: x <= F.length(F.col(path))),
                         lambda x: F.substring(F.col(path), F.lit(1), x))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict), one row per row of ``pages``.

    ``rules`` has host, path and verdict (allow or block).  A rule fits its host and all its
    subdomains when the path starts with the rule's; the longest (then the one with the longer
    host) decides, and a key listed as both blocks.  Without a fitting rule, ``rule`` is null
    and the verdict is ``default``, what a url in no list gets.  Rules with a null or empty
    host, null path or other verdict are left out.
    """
    spark = pages.sparkSession
    rules = rules.where("host <> '' AND path IS NOT NULL AND verdict IN ('allow', 'block')").select(
        ascii_lower(F.col("host")).alias("host"), "path", "verdict")
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # one per path length
    host, path = url_parts(url_col)
    urls = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    keyed = urls.withColumn("keys", candidate_keys("host", "path", lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    both = spark.sparkContext.broadcast({code: build_cascade(listed.where(F.col("verdict") == name), universe, max_bytes)
                                         for name, code in (("allow", ALLOW), ("block", BLOCK))})

    @F.arrow_udf("array<int>")
    def codes(h1: pa.Array, h2: pa.Array) -> pa.Array:
        a, b = _u64(h1.flatten()), _u64(h2.flatten())
        out = np.zeros(len(a), np.int32)
        for code in (ALLOW, BLOCK):
            out[both.value[code].contains(a, b)] = code
        ends = np.cumsum([0, *[len(x) for x in h1]]) if h1.offset else np.asarray(h1.offsets)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))

    tested = keyed.withColumn("codes", codes(F.transform("keys", lambda k: F.xxhash64(k)),
                                             F.transform("keys", lambda k: F.xxhash64(F.lit("cascade"), k))))
    fitting = F.filter(F.arrays_zip("keys", "codes"), lambda z: z["codes"] != 0)
    best = F.array_max(F.transform(fitting, lambda z: F.struct(
        F.length(z["keys"]).alias("n"), F.instr(z["keys"], "/").alias("host"), z["keys"].alias("key"),
        z["codes"].alias("code"))))
    return tested.withColumn("best", best).select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.key").alias("rule"),
        F.when(F.col("best.code") == BLOCK, "block").when(F.col("best.code") == ALLOW, "allow")
        .otherwise(default).alias("verdict"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
p AS (SELECT page_id, translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                            ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id"""
