"""Drawn masks, sentinels and corrupted tokens, in numpy over Arrow batches.

A draw is the one of ``functions.draws``: the first 32 bits of an MD5 digest of seed, key and
number.  Messages of one length are digested together, ``CHUNK`` at a time.  A mask travels as
its runs (``lo``, ``hi``), which are few, and tokens go to Python once.  Nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import as_col
from ..markers import SENTINEL_LIMIT
from .pairs import _ragged
from .suffixes import _lists

RUNS = ArrayType(StructType([StructField(f, IntegerType()) for f in ("lo", "hi")]))
STRINGS = ArrayType(StringType())
#: Messages digested at once, so that the working arrays stay in a core's cache.
CHUNK = 1 << 13
#: A longer prefix, or a number of more than 7 digits, leaves no room in MD5's single block.
PREFIX, NUMBERS = 47, 10 ** 7
MEAN_SPAN = 2.5

_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint64).astype(np.uint32)
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(4, 4, 4)
_START = [np.uint32(x) for x in (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476)]


def _digest_heads(m: dict[int, np.ndarray], size: int) -> np.ndarray:
    """First 32 bits of the MD5 digests of one-block messages, given by their words that are not all zero."""
    a, b, c, d = (np.full(size, x) for x in _START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(61):  # what later rounds add is in the other bits of the digest
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        if g in m:
            f += m[g]
        turn = int(_TURNS[i // 16, 0, i % 4])
        np.left_shift(f, np.uint32(turn), out=t)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + _START[0]).byteswap()


def _digits(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of numbers below ``NUMBERS`` with MD5's end mark, first byte lowest, and how many digits."""
    n = np.maximum(np.searchsorted(10 ** np.arange(8), k, "right"), 1).astype(np.uint64)
    out = np.uint64(0x80) << (n * np.uint64(8))
    rest = k.astype(np.uint64)
    for place in range(7):
        at = np.maximum(n, np.uint64(place + 1)) - np.uint64(place + 1)
        out |= np.where(n > place, (rest % np.uint64(10) + np.uint64(48)) << (at * np.uint64(8)), np.uint64(0))
        rest //= np.uint64(10)
    return out, n.astype(np.uint32)


_FEW = _digits(np.arange(1 << 15))


def heads(prefixes: list[bytes], row: np.ndarray, k: np.ndarray) -> np.ndarray:
    """32 bits of the digest of a row's prefix followed by the number ``k``, as unsigned integers."""
    out = np.empty(len(k), np.uint32)
    if not len(k):
        return out
    sizes = np.array([len(p) for p in prefixes])
    size = sizes[row]
    plain = (size <= PREFIX) & (k < NUMBERS)
    for at in np.flatnonzero(~plain):
        out[at] = int.from_bytes(hashlib.md5(prefixes[row[at]] + b"%d" % k[at]).digest()[:4], "big")
    words = np.frombuffer(b"".join(p[:PREFIX].ljust(64, b"\0") for p in prefixes), "<u4").reshape(-1, 16)
    for n in np.unique(size[plain]).tolist():
        group, word, shift = np.flatnonzero(plain & (size == n)), n // 4, n % 4 * 8
        for start in range(0, len(group), CHUNK):
            at = group[start:start + CHUNK]
            r, number = row[at], k[at]
            if number.max() < len(_FEW[0]):
                digits, many = (x[number] for x in _FEW)
            else:
                digits, many = _digits(number)
            m = {w: words[r, w] for w in range(word + (shift > 0))}
            low = (digits << np.uint64(shift)).astype(np.uint32)
            m[word] = m[word] | low if word in m else low
            m[word + 1] = (digits >> np.uint64(32 - shift)).astype(np.uint32)
            if shift:
                m[word + 2] = (digits >> np.uint64(64 - shift)).astype(np.uint32)
            m[14] = (many + np.uint32(n)) * np.uint32(8)
            out[at] = _digest_heads(m, len(at))
    return out


def _bytes(prefix: pa.Array) -> list[bytes]:
    return [p.encode() for p in prefix.to_pylist()]


def _ints(x: pa.Array) -> np.ndarray:
    return np.asarray(x.fill_null(0)).astype(np.int64)


def _picked(n: np.ndarray, many: np.ndarray, prefixes: list[bytes]) -> list[np.ndarray]:
    """For each row the ``many`` of the numbers 1..n with the least draws, ascending."""
    n = np.where(many > 0, n, 0)
    row, k = _ragged(n)
    drawn = heads(prefixes, row, k + 1).astype(np.uint64) << np.uint64(32) | k.astype(np.uint64)
    start = np.cumsum(n) - n
    some = np.flatnonzero(n > 0)
    found = []
    for _ in range(int(np.minimum(n, many).max(initial=0))):
        least = (np.minimum.reduceat(drawn, start[some]) & np.uint64(0xffffffff)).astype(np.int64)
        found.append((some, least + 1))
        drawn[start[some] + least] = np.uint64(0xffffffffffffffff)
        keep = np.minimum(n, many)[some] > len(found)
        # A row that has all of its numbers is not looked at again.
        if not keep.all():
            left = some[keep]
            row, k = _ragged(n[left])
            drawn = drawn[start[left][row] + k]
            start = start.copy()
            start[left] = np.cumsum(n[left]) - n[left]
            some = left
    rows = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
    values = np.concatenate([v for _, v in found]) if found else np.zeros(0, np.int64)
    order = np.lexsort((values, rows))
    return np.split(values[order], np.searchsorted(rows[order], np.arange(1, len(many))))


def _noise(n: np.ndarray, share: np.ndarray, keep: list[bytes], noise: list[bytes]) -> tuple[np.ndarray, ...]:
    """(row, lo, hi): noise segments of rows of ``n`` places, after kept ones; none where they do not fit."""
    x = n * share
    mean = np.maximum(np.floor((x - np.fmod(x, MEAN_SPAN)) / MEAN_SPAN + 0.5), 1.0)
    total = np.minimum(np.maximum(np.rint(MEAN_SPAN * mean).astype(np.int64), 1),
                       np.maximum(np.floor(n / 1.5).astype(np.int64), 1))
    spans = np.maximum(np.rint(total / mean).astype(np.int64), 1)
    spans = np.where((n - total >= spans) & (total >= spans), spans, 0)
    row, nth = _ragged(spans)
    ends = []
    for size, prefixes in ((n - total, keep), (total, noise)):
        cuts = _picked(np.maximum(size - 1, 0), np.maximum(spans - 1, 0), prefixes)
        ends.append(np.concatenate([np.zeros(0, np.int64), *(np.append(c, s) for c, s, some in zip(cuts, size, spans) if some)]))
    before = np.where(nth > 0, np.append(0, ends[1])[:len(nth)], 0)
    return row, ends[0] + before, ends[0] + ends[1]


def _as_runs(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: int, nulls: pa.Array) -> pa.Array:
    """Runs in order, those that touch made one."""
    some = lo < hi
    row, lo, hi = row[some], lo[some], hi[some]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] != hi[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1 if len(first) else first
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=rows))]).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(lo[first].astype(np.int32)), pa.array(hi[last].astype(np.int32))], ["lo", "hi"])
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=nulls)


def _parts(sizes: pa.Array, wanted: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, place in the row and size of the wanted parts, and the rows' totals of them."""
    (x, offsets), (y, _) = _lists(sizes), _lists(wanted)
    size = _ints(x)
    row = np.repeat(np.arange(len(sizes)), np.diff(offsets))
    upto = np.cumsum(size)
    base = np.append(0, upto)[offsets[:-1]]
    own = np.asarray(y.fill_null(False)).astype(bool) & (size > 0)
    row, at, size = row[own], (upto - size)[own] - base[row[own]], size[own]
    return row, at, size, np.bincount(row, size, len(sizes)).astype(np.int64)


def _placed(parts: tuple[np.ndarray, ...], row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the places of parts alone as runs of the rows' places, cut where a part ends."""
    owner, at, size, total = parts
    start = np.cumsum(size) - size  # all rows' parts in one line
    base = np.cumsum(total) - total
    lo, hi = lo + base[row], hi + base[row]
    first, last = np.searchsorted(start, lo, "right") - 1, np.searchsorted(start, hi - 1, "right") - 1
    which, k = _ragged(last - first + 1)
    p = first[which] + k
    x, y = np.maximum(lo[which], start[p]), np.minimum(hi[which], start[p] + size[p])
    return owner[p], x - start[p] + at[p], y - start[p] + at[p]


@F.arrow_udf(RUNS)
def _noise_runs(n: pa.Array, share: pa.Array, keep: pa.Array, noise: pa.Array) -> pa.Array:
    return _as_runs(*_noise(_ints(n), np.asarray(share), _bytes(keep), _bytes(noise)), len(n), n.is_null())


@F.arrow_udf(RUNS)
def _kept_runs(sizes: pa.Array, kept: pa.Array, share: pa.Array, keep: pa.Array, noise: pa.Array) -> pa.Array:
    parts = _parts(sizes, kept)
    runs = _noise(parts[-1], np.asarray(share), _bytes(keep), _bytes(noise))
    return _as_runs(*_placed(parts, *runs), len(sizes), sizes.is_null())


@F.arrow_udf(RUNS)
def _changed_runs(sizes: pa.Array, changed: pa.Array, share: pa.Array, prefix: pa.Array) -> pa.Array:
    """The changed places whose own draw is below ``share``."""
    parts = _parts(sizes, changed)
    which, k = _ragged(parts[2])
    row, at, prefixes, limit = parts[0][which], parts[1][which] + k, _bytes(prefix), np.asarray(share)
    hit = heads(prefixes, row, at + 1) / 2.0 ** 32 < limit[row]
    return _as_runs(row[hit], at[hit], at[hit] + 1, len(sizes), sizes.is_null())


@F.arrow_udf(RUNS)
def _first_changed_runs(sizes: pa.Array, changed: pa.Array, share: pa.Array, prefix: pa.Array) -> pa.Array:
    """The changed places before the first of them whose draw is not below ``share``.

    Draws that many as are needed, twice as many with each pass.
    """
    parts, prefixes, limit = _parts(sizes, changed), _bytes(prefix), np.asarray(share)
    total = parts[-1]
    hits, open_, width = np.zeros(len(total), np.int64), np.flatnonzero(total > 0), 4
    while len(open_):
        take = np.minimum(total[open_] - hits[open_], width)
        which, k = _ragged(take)
        row = open_[which]
        miss = np.flatnonzero(heads(prefixes, row, hits[row] + k + 1) / 2.0 ** 32 >= limit[row])[::-1]
        more = take.copy()
        more[which[miss]] = k[miss]  # the first miss is written last
        hits[open_] += more
        open_ = open_[(more == take) & (hits[open_] < total[open_])]
        width *= 2
    row = np.flatnonzero(hits)
    return _as_runs(*_placed(parts, row, np.zeros(len(row), np.int64), hits[row]), len(sizes), sizes.is_null())


_SENTINELS = pa.array([f"<extra_id_{i}>" for i in range(SENTINEL_LIMIT)], pa.string())


def _taken(tokens: pa.Array, codes: np.ndarray, sizes: np.ndarray, nulls: pa.Array) -> pa.Array:
    """Rows of ``sizes`` of the codes: a token's place, or the number of tokens and a sentinel's rank more."""
    values = pa.concat_arrays([tokens, _SENTINELS.cast(tokens.type)])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(codes)), mask=nulls)


def _left(tokens: pa.Array, codes: np.ndarray, offsets: np.ndarray, nulls: pa.Array) -> pa.Array:
    stays = codes >= 0
    return _taken(tokens, codes[stays], np.diff(np.append(0, np.cumsum(stays))[offsets]), nulls)


def _codes_of_runs(x: pa.Array, offsets: np.ndarray, runs: pa.Array) -> np.ndarray:
    """The tokens' places, less than 0 for those that go; a run's first token has its sentinel's code."""
    r, of_runs = _lists(runs)
    lo, hi = (_ints(r.field(f)) for f in ("lo", "hi"))
    owner, rank = _ragged(np.diff(of_runs))
    size = np.diff(offsets)[owner]
    lo, hi = np.minimum(lo, size), np.minimum(hi, size)
    some = lo < hi
    owner, rank, lo, hi = owner[some], rank[some], lo[some], hi[some]
    start = offsets[:-1][owner] + lo
    inside = np.bincount(start, minlength=len(x) + 1) - np.bincount(start + hi - lo, minlength=len(x) + 1)
    codes = np.where(np.cumsum(inside)[:-1] > 0, -1, np.arange(len(x)))
    if x.null_count:
        codes[np.asarray(x.is_null())] = -1
    codes[start] = np.where(rank < SENTINEL_LIMIT, len(x) + rank, -1)
    return codes


@F.arrow_udf(STRINGS)
def _collapsed(tokens: pa.Array, runs: pa.Array) -> pa.Array:
    x, offsets = _lists(tokens)
    return _left(x, _codes_of_runs(x, offsets, runs), offsets, pc.or_(tokens.is_null(), runs.is_null()))


@F.arrow_udf(STRINGS)
def _collapsed_and_cut(tokens: pa.Array, runs: pa.Array, cut: pa.Array, head: pa.Array) -> pa.Array:
    x, offsets = _lists(tokens)
    row, k = _ragged(np.diff(offsets))
    after = k >= _ints(head)[row]
    would = np.bincount(row, after & (_codes_of_runs(x, offsets, cut) >= 0), len(tokens)).astype(np.int64)
    codes = _codes_of_runs(x, offsets, runs)
    codes[after & (k >= (_ints(head) + would)[row])] = -1
    return _left(x, codes, offsets, pc.or_(pc.or_(tokens.is_null(), runs.is_null()), cut.is_null()))


@F.arrow_udf(STRINGS)
def _corrupted(tokens: pa.Array, prefix: pa.Array, drop: pa.Array, mark: pa.Array, replace: pa.Array) -> pa.Array:
    x, offsets = _lists(tokens)
    row, k = _ragged(np.diff(offsets))
    u = heads(_bytes(prefix), row, k + 1) / 2.0 ** 32
    out, before = u < np.asarray(drop)[row], u < np.asarray(mark)[row]
    flagged = ~out & (before | np.asarray(replace).astype(bool)[row])
    upto = np.append(0, np.cumsum(flagged))
    rank = upto[1:] - upto[offsets[:-1]][row] - 1
    marked = flagged & (rank < SENTINEL_LIMIT)
    own = ~out & ~(marked & ~before)  # the token itself stays
    many = marked.astype(np.int64) + own
    at = np.cumsum(many) - many
    codes = np.empty(int(many.sum()), np.int64)
    codes[at[marked]] = len(x) + rank[marked]
    codes[(at + marked)[own]] = np.flatnonzero(own)
    sizes = np.diff(np.append(0, np.cumsum(many))[offsets])
    return _taken(x, codes, sizes, tokens.is_null())


# --- columns ------------------------------------------------------------------------

def _prefix(seed: str, key) -> Column:
    """What ``functions.draws.digest`` puts before the number."""
    return F.concat(F.concat_ws("|", F.lit(seed), *[as_col(k).cast("string") for k in key]), F.lit("|"))


def _noise_args(share: float, seed: str, key) -> list[Column]:
    return [F.lit(float(share)), _prefix(seed + "-keep", key), _prefix(seed + "-noise", key)]


def noise_runs(n, share: float, seed: str, *key) -> Column:
    """Masked runs of ``n`` places; see ``functions.masks.span_noise_mask``."""
    return _noise_runs(as_col(n).cast("int"), *_noise_args(share, seed, key))


def _old_parts(ops, kept: bool) -> list[Column]:
    """Sizes of the parts of the old side, and whether they are kept (or are changed)."""
    ops = as_col(ops)
    return [F.transform(ops, lambda op: (op["i2"] - op["i1"]).cast("int")),
            F.transform(ops, lambda op: (op["tag"] == "equal") == F.lit(kept))]


def kept_runs(ops, share: float, seed: str, *key) -> Column:
    """Noise spans of the kept tokens alone, as runs of the old side."""
    return _kept_runs(*_old_parts(ops, True), *_noise_args(share, seed, key))


def changed_runs(ops, share: float, seed: str, *key, first: bool = False) -> Column:
    """Runs of changed old tokens drawn below ``share`` by their place; ``first``: by their rank, up to the first drawn to stay."""
    return (_first_changed_runs if first else _changed_runs)(
        *_old_parts(ops, False), F.lit(float(share)), _prefix(seed, key))


def shifted(runs, by) -> Column:
    return F.transform(as_col(runs), lambda r: F.struct((r["lo"] + by).alias("lo"), (r["hi"] + by).alias("hi")))


def collapse_runs(tokens, runs) -> Column:
    """Each run of tokens becomes one sentinel; runs after the 99th vanish, and so do null tokens."""
    return _collapsed(as_col(tokens), as_col(runs))


def collapse_and_cut(tokens, runs, cut, head: Column) -> Column:
    """As ``collapse_runs``, but what follows the first ``head`` tokens is cut to the length that collapsing ``cut`` would leave of it."""
    return _collapsed_and_cut(as_col(tokens), as_col(runs), as_col(cut), head)


def corrupt(tokens, drop: float, mark: float, replace: bool, seed: str, *key) -> Column:
    """Tokens drawn below ``drop`` go; those below ``mark`` stand after a sentinel; ``replace`` puts one in place of the others."""
    return _corrupted(as_col(tokens), _prefix(seed, key), F.lit(float(drop)), F.lit(float(mark)), F.lit(replace))
