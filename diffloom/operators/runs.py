"""N-grams of all orders from one record a place: a run of up to the highest order stands for its beginnings.

A record is the longest run from a place, with the least order that begins nowhere earlier in its
row; it counts for its first ``least`` to ``n`` tokens.  So a place is one record, not one an
order.  Records of a task are merged, packed by part (a hash of the first two tokens; of the token
where there is one) and shuffled compressed.  A part is sorted by Spark, which spills where it
must; its n-grams are read off neighbours as they stream by, so memory does not grow with a part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..layout import parts_for
from .pairs import _ragged
from .suffixes import _lists, _runs

SEP = "\u001f"
#: Records packed together, tokens taken at once, and parts they are dealt to.
CHUNK, TOKENS, PARTS = 1 << 20, 1 << 20, 2048
#: Records streamed at once, and bytes of input per task of the counting.
ROWS, PART_BYTES = 1 << 17, 1 << 24
FIELDS = [StructField("n", IntegerType()), StructField("least", IntegerType()), StructField("gram", StringType()),
          StructField("part", IntegerType())]
PACKED = "part int, rows int, size long, packed binary"
TEXT = pa.string()


def _crc(texts: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(t.encode()) for t in texts.to_pylist()), np.uint64, len(texts))


def _part(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Parts of hashes of the first two tokens; 0 stands for no second one."""
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(33)) % np.uint64(PARTS)).astype(np.int64)


def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.unique((high << 32) | low, return_inverse=True)[1]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places whose row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def row_runs(n_keys: int, side: str, max_order: int):
    """Batches (keys, tokens) to batches (keys, n, least, gram, part, places), ordered by part and run."""
    def runs(batches):
        for batch in batches:
            values, offsets = _lists(batch.column(n_keys))
            for start, stop in _runs(offsets, TOKENS):
                own = batch.slice(start, stop - start).select(range(n_keys))
                sizes = np.diff(offsets[start:stop + 1])
                empty = np.zeros(len(sizes), np.int64)
                yield table(own, np.arange(len(sizes)), empty, empty, pa.array([""] * len(sizes), TEXT), empty, sizes)
                if sizes.any():
                    yield table(own, *records(values.slice(offsets[start], offsets[stop] - offsets[start]), sizes))

    def records(tokens, sizes):
        words = tokens.dictionary_encode()
        texts, code = words.dictionary.cast(TEXT), np.asarray(words.indices.to_numpy(zero_copy_only=False))
        if tokens.null_count or pc.any(pc.match_substring(texts, SEP)).as_py():
            raise ValueError("nested n-grams need tokens that are not null and hold no separator")
        order = np.asarray(pc.sort_indices(texts))
        rank = np.empty(len(texts), np.int64)
        rank[order] = np.arange(1, len(texts) + 1)
        row, at = _ragged(sizes)
        left = np.repeat(sizes, sizes) - at
        # Codes of the first k tokens of every place, ordered as the tokens are; 0 where the row ends.
        codes = [rank[code]]
        for k in range(1, max_order):
            after = np.zeros(len(row), np.int64)
            inside = np.flatnonzero(left > k)
            after[inside] = codes[0][inside + k]
            codes.append(_dense(codes[-1], after))
        places = np.argsort((row << 32) | codes[-1], kind="stable")
        heads = _changes(row[places], codes[-1][places])
        first, count = places[heads], np.diff(np.append(heads, len(places)))
        n = np.minimum(left[first], max_order)
        least = np.full(len(first), 2)
        for k in range(2, max_order + 1):
            starts = _changes(row[first], codes[k - 1][first])
            earliest = np.repeat(np.minimum.reduceat(first, starts), np.diff(np.append(starts, len(first))))
            least += (k <= n) & (first != earliest)
        starts = _changes(row[first], codes[0][first])
        single, singles = first[starts], np.add.reduceat(count, starts)
        long = np.flatnonzero(least <= n)
        first, n, least, count = first[long], n[long], least[long], count[long]
        crc = _crc(texts)
        part = np.concatenate([_part(crc[code[single]], np.zeros(len(single), np.uint64)), _part(crc[code[first]], crc[code[first + 1 - (n < 2)]])])
        place, n = np.concatenate([single, first]), np.concatenate([np.ones(len(single), np.int64), n])
        least, count = np.concatenate([np.ones(len(single), np.int64), least]), np.concatenate([singles, count])
        code_of = np.concatenate([codes[0][single], codes[-1][first]])
        order = np.argsort((part * 2 + (n > 1) << 40) | (code_of << 4) | np.minimum(least, 15), kind="stable")
        place, n, least, count, part = place[order], n[order], least[order], count[order], part[order]
        grams, back = [], np.empty(len(place), np.int64)
        for k in range(1, max_order + 1):
            mine = np.flatnonzero(n == k)
            back[mine] = np.arange(len(mine)) + sum(len(g) for g in grams)
            grams.append(pc.binary_join_element_wise(*[texts.take(pa.array(code[place[mine] + j])) for j in range(k)], SEP))
        return row[place], n, least, pa.concat_arrays(grams).take(pa.array(back)), part, count

    def table(own, rows, n, least, grams, part, count):
        columns = [pa.array(np.asarray(c).astype(np.int32)) for c in (n, least, part)]
        return pa.RecordBatch.from_arrays(
            [*[c.take(pa.array(rows)) for c in own.columns], columns[0], columns[1], grams, columns[2], pa.array(count.astype(np.int64))],
            [*own.schema.names, "n", "least", "gram", "part", side])

    return runs


def as_runs(counts: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Rows (keys, n, gram, count), one an order, as records that stand for themselves alone."""
    schema = StructType([*counts.select(*keys).schema, *FIELDS, StructField(side, LongType())])

    def alone(batches):
        for batch in batches:
            *own, n, gram, count = batch.columns
            order = np.asarray(n, np.int64)
            if (np.asarray(pc.count_substring(gram, SEP)) != np.maximum(order - 1, 0)).any():
                raise ValueError("nested n-grams need tokens that are not null and hold no separator")
            words = pc.split_pattern(gram, SEP, max_splits=2)
            hashes = np.zeros((2, len(gram)), np.uint64)
            for k in range(2):
                some = np.flatnonzero(order > k)
                coded = pc.list_element(words.take(pa.array(some)), k).dictionary_encode()
                hashes[k, some] = _crc(coded.dictionary)[np.asarray(coded.indices)]
            yield pa.RecordBatch.from_arrays([*own, n, n, gram.cast(TEXT), pa.array(_part(*hashes).astype(np.int32)), count], schema.names)

    return counts.select(*keys, "n", "gram", side).mapInArrow(alone, schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (part, least, gram) to packed records (gram, least, rows that have it), one row a part and chunk."""
    def packed(held):
        t = pa.Table.from_batches(held).combine_chunks()
        part, least = (np.asarray(t.column(c).to_numpy(), np.int64) for c in ("part", "least"))
        order = np.argsort(part, kind="stable")
        part, least = part[order], least[order]
        gram = pc.binary_join_element_wise(t.column("gram").combine_chunks().take(pa.array(order)).cast(TEXT), "", SEP)
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (least[1:] != least[:-1]) | ~np.asarray(pc.equal(gram[1:], gram[:-1]).to_numpy(zero_copy_only=False))
        heads = np.flatnonzero(new)
        part, least, df = part[heads], least[heads], np.diff(np.append(heads, len(part)))
        offsets, data = _bytes(gram.take(pa.array(heads)))
        codec, starts = pa.Codec("zstd"), _changes(part)
        rows, sizes, blobs = np.diff(np.append(starts, len(part))), [], []
        for at, many in zip(starts, rows):
            cut = slice(at, at + many)
            raw = b"".join(x.tobytes() for x in (np.diff(offsets[at:at + many + 1]).astype(np.int32), least[cut].astype(np.int32),
                                                 df[cut].astype(np.int32), data[offsets[at]:offsets[at + many]]))
            sizes.append(len(raw))
            blobs.append(codec.compress(raw, asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(rows.astype(np.int32)),
                                           pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["part", "rows", "size", "packed"])

    held, rows = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            rows += len(batch)
        if rows >= CHUNK:
            yield packed(held)
            held, rows = [], 0
    if held:
        yield packed(held)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of packed records to batches (gram, least, df)."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for rows, size, packed in zip(*(batch.column(c).to_pylist() for c in ("rows", "size", "packed"))):
            raw = codec.decompress(packed, size)
            lengths, least, df = np.frombuffer(raw, np.int32, 3 * rows).reshape(3, rows)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            gram = pa.StringArray.from_buffers(rows, pa.py_buffer(offsets), raw.slice(12 * rows))
            yield pa.RecordBatch.from_arrays([gram, pa.array(least), pa.array(df.astype(np.int64))], ["gram", "least", "df"])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of texts."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches (gram, least, df) to batches (n, gram, df): every beginning once, with the sum of those it counts in."""
    last = None  # the last record, and by order the sum of the beginning it is in
    held, rows = [], 0

    def counted(held, last):
        t = pa.Table.from_batches(held).combine_chunks()
        gram = t.column("gram").combine_chunks().cast(TEXT)
        least, df = (np.asarray(t.column(c).to_numpy(), np.int64) for c in ("least", "df"))
        if last:
            gram = pa.concat_arrays([pa.array([last[0]], TEXT), gram])
            least, df = np.append(0, least), np.append(0, df)
        offsets, data = _bytes(gram)
        start, size = offsets[:-1], np.diff(offsets)
        shared = np.minimum(size[1:], size[:-1])
        which, k = _ragged(shared)
        miss = np.flatnonzero(data[start[1:][which] + k] != data[start[:-1][which] + k])[::-1]
        shared = np.append(0, shared)
        shared[which[miss] + 1] = k[miss]  # the first miss is written last
        ends = np.flatnonzero(data == ord(SEP)) + 1
        before = np.searchsorted(ends, start, "right")
        n = np.searchsorted(ends, offsets[1:], "right") - before
        out, open_sums = [], []
        for order in range(1, int(n.max()) + 1):
            mine = np.flatnonzero(n >= order)
            length = ends[before[mine] + order - 1] - start[mine]
            new = shared[mine] < length
            new[0] = True
            heads = np.flatnonzero(new)
            sums = np.add.reduceat(np.where(least[mine] <= order, df[mine], 0), heads)
            if last and order <= len(last[1]):
                sums[0] += last[1][order - 1]
            done = sums > 0
            if mine[-1] == len(n) - 1:
                open_sums.append(int(sums[-1]))
                done[-1] = False
            heads, sums = heads[done], sums[done]
            length = length[heads] - 1
            which, k = _ragged(length)
            found = data[start[mine[heads]][which] + k]
            cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            texts = pa.StringArray.from_buffers(len(heads), pa.py_buffer(cuts), pa.py_buffer(found))
            out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), order, np.int32)), texts, pa.array(sums)], ["n", "gram", "df"]))
        return out, (gram[-1].as_py(), open_sums)

    for batch in batches:
        if len(batch):
            held.append(batch)
            rows += len(batch)
        if rows >= ROWS:
            out, last = counted(held, last)
            yield from out
            held, rows = [], 0
    if held:
        out, last = counted(held, last)
        yield from out
    if last:
        words = last[0].split(SEP)
        some = [(k + 1, SEP.join(words[:k + 1]), x) for k, x in enumerate(last[1]) if x]
        n, texts, sums = zip(*some) if some else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(texts, TEXT), pa.array(sums, pa.int64())], ["n", "gram", "df"])


def frequencies(records: DataFrame) -> DataFrame:
    """(n, gram, df) of records (part, least, gram): in how many rows each of their beginnings is."""
    packed = records.select("part", "least", "gram").mapInArrow(_pack, PACKED).repartition(parts_for(records, PART_BYTES), "part")
    ordered = packed.mapInArrow(_unpack, "gram string, least int, df long").sortWithinPartitions("gram")
    return ordered.mapInArrow(_beginnings, "n int, gram string, df long")
