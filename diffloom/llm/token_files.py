"""Token-id files: documents tokenised, ordered by identifier and written as rANS blocks.

1. Documents are range-partitioned and sorted by identifier, tokenised, and their ids
   staged as a table (two or four bytes an id).
2. The ids' counts over all documents make one frequency table, shared by all blocks;
   it is as large as the vocabulary and is broadcast.
3. Runs of whole documents become independent blocks.  The file format is a Parquet table
   of blocks (``BLOCKS``) next to a table of frequencies, so any shared file system holds it.
4. Reading decodes blocks in parallel, checks them, and adds global starts.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .bytes_np import buffers, chunks
from .common import materialize, parts, whole
from .rans import Table, decode, encode, normalize

BLOCK_IDS = 1 << 18
CACHE = 1_000_000
#: Bytes of text encoded at once; a longer text is encoded by itself.
RUN = 1 << 21


#: Kinds of characters as the pre-tokenizer tells them apart. ROUGH: apostrophes and whatever Unicode
#: versions may class differently; GAP: white space other than the six of ASCII.
LETTER, NUMBER, MARK, ROUGH, GAP, BREAK, BLANK = range(7)


@functools.cache
def kinds() -> np.ndarray:
    """The kind of every code point; once per Python worker."""
    kind = np.full(0x110000, ROUGH, np.uint8)
    major = {"L": LETTER, "N": NUMBER, "M": MARK, "P": MARK, "S": MARK}
    old = unicodedata.ucd_3_2_0
    for n, c in enumerate(map(chr, range(0x20000))):
        a, b = unicodedata.category(c)[0], old.category(c)[0]
        if c.isspace() or "Z" in (a, b):
            kind[n] = GAP
        elif a in major and b in major and major[a] == major[b]:
            kind[n] = major[a]
    kind[ord("'")] = ROUGH
    kind[[*b"\t\n\v\f\r"]] = BREAK
    kind[ord(" ")] = BLANK
    return kind


def byte_alphabet() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary; a space for 0xFF, which UTF-8 never holds."""
    chars = np.arange(256, dtype="<u4")
    hidden = np.r_[0:33, 127:161, 173]
    chars[hidden] = 256 + np.arange(len(hidden))
    chars[255] = ord(" ")
    return chars


def encodes_atoms(settings: dict) -> bool:
    """Whether a text's ids are those of its atoms: plain byte-level BPE whose special tokens hold ``<|``."""
    pre, model = settings["pre_tokenizer"] or {}, settings["model"]
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
            and not any(settings.get(k) for k in ("normalizer", "truncation", "padding"))
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and all("<|" in t["content"] for t in settings["added_tokens"])
            and set(map(chr, byte_alphabet()[:255])) <= set(model["vocab"]))


def atoms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where texts may be cut without a change of their ids: (starts, number per text, odd texts).

    Texts are cut as the byte-level pre-tokenizer does it: a space goes with what follows it, other white
    space is a run and its last character, and the rest is runs of letters, of numbers and of other
    characters.  What stands between white space is not cut further if it has a rough character.  Odd texts
    (a special token is possible, or a gap stands beside white space or an end) are to be taken whole.
    """
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    place = np.flatnonzero((raw & 0xC0) != 0x80) if len(points) < len(raw) else None
    first = offsets if place is None else np.searchsorted(place, offsets)
    n, odd = len(points), np.zeros(len(offsets) - 1, bool)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(odd), np.int64), odd
    kind = kinds()[points]
    head = np.zeros(n + 1, bool)  # first characters of texts, and the end
    head[first] = True
    white = kind >= BREAK
    # No character before a text or after it is its neighbour.
    before, after = np.append(False, white[:-1]) & ~head[:-1], np.append(white[1:], False) & ~head[1:]
    hard = head[:-1] | white & ~(before & (after | head[1:]))
    hard[1:] |= before[1:] & ~white[1:] & (kind[:-1] == BREAK)
    cut = hard.copy()
    cut[1:] |= (kind[1:] != kind[:-1]) & ~white[1:] & ~white[:-1]
    rough = np.flatnonzero((kind == ROUGH) | (kind == GAP))
    starts = np.flatnonzero(cut)
    if len(rough):
        units = hard[starts]
        soft = np.zeros(int(units.sum()), bool)
        soft[np.searchsorted(starts[units], rough, "right") - 1] = True
        starts = starts[units | ~soft[np.cumsum(units) - 1]]
    gap = rough[kind[rough] == GAP]
    gap = gap[before[gap] | after[gap] | head[gap] | head[gap + 1]]
    special = np.flatnonzero((points[:-1] == ord("<")) & (points[1:] == ord("|")))
    odd[np.searchsorted(first[:-1], np.append(gap, special), "right") - 1] = True
    return starts if place is None else place[starts], np.diff(np.searchsorted(starts, first)), odd


class WordCachedEncoder:
    """Ids of texts by the tokenizers library, with a memo of words.

    With byte-level BPE a text's ids are those of its atoms (see ``atoms``), each encoded once
    by the library.  Odd texts, and all texts of another tokenizer, are encoded as a whole.
    """

    def __init__(self, path: str, limit: int = CACHE):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = encodes_atoms(json.loads(self.tokenizer.to_str()))
        # The same model without its pre-tokenizer, for atoms that need none.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.alphabet = byte_alphabet()
        vocab = self.tokenizer.get_vocab()
        self.id_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.id_bytes[list(vocab.values())] = [len(t) for t in vocab]
        self.limit = limit
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self):
        self.memo = _Memo()
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _direct(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        ids, sizes = self.encode_array(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, their number per text)."""
        if len(self.memo) > self.limit:
            self.clear()
        raw, offsets = buffers(texts)
        begin, counts, odd = atoms(raw, offsets)
        odd |= not self.cuts
        words = pa.Array.from_buffers(pa.string(), len(begin), [
            None, pa.py_buffer(np.append(begin, len(raw)).astype(np.int32)), pa.py_buffer(raw)])
        if odd.any():
            words, counts = words.filter(pa.array(np.repeat(~odd, counts))), np.where(odd, 0, counts)
        coded = words.dictionary_encode()
        known, keys = len(self.memo), coded.dictionary.to_numpy(zero_copy_only=False)
        at = np.fromiter(map(self.memo.__getitem__, keys), np.int64, len(keys))
        self._learn(known)
        at = at[np.asarray(coded.indices)]
        n = self.lens[at]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(n.sum()) + np.repeat(self.starts[at] - (ends - n), n)]
        sizes = np.diff(np.append(0, ends)[np.append(0, np.cumsum(counts))])
        if odd.any():
            apart = np.split(ids, np.cumsum(sizes)[:-1])
            whole_texts = np.flatnonzero(odd)
            for i, e in zip(whole_texts, self._direct(texts.take(pa.array(whole_texts)).to_pylist())):
                apart[i] = np.array(e.ids, self.dtype)
            ids, sizes = np.concatenate(apart), np.array([len(x) for x in apart])
        return ids, sizes

    @staticmethod
    def _rough(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which words hold a rough character; no word is empty."""
        kind = kinds()[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")]
        at = np.flatnonzero((kind == ROUGH) | (kind == GAP))
        rough = np.zeros(len(offsets) - 1, bool)
        rough[np.searchsorted(offsets, np.flatnonzero((raw & 0xC0) != 0x80)[at], "right") - 1] = True
        return rough

    def _learn(self, known: int):
        """Ids of the words numbered from ``known`` on."""
        fresh = self.memo.since(known)
        if not fresh:
            return
        lens, place, parts, at = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64), [], 0
        raw, offsets = buffers(pa.array(fresh, pa.string()))
        rough = self._rough(raw, offsets)
        plain = np.flatnonzero(~rough)
        for who in (plain[i:i + 1000] for i in range(0, len(plain), 1000)):
            joined = np.frombuffer(b"\xff".join([fresh[i].encode() for i in who]), np.uint8)
            text = self.alphabet[joined].tobytes().decode("utf-32-le")
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            # Ids are whole parts of words, so their bytes tell where words end.
            read, ends = np.cumsum(self.id_bytes[ids]), np.cumsum(offsets[who + 1] - offsets[who])
            last = np.searchsorted(read, ends)
            if last[-1] + 1 != len(ids) or (read[last] != ends).any():
                raise ValueError("the vocabulary is not byte-level")
            begin = np.append(0, last[:-1] + 1)
            place[who], lens[who] = at + begin, last + 1 - begin
            parts.append(ids)
            at += len(ids)
        apart = np.flatnonzero(rough)
        for i, e in zip(apart, self._direct([fresh[i] for i in apart])):
            place[i], lens[i] = at, len(e)
            parts.append(np.array(e.ids, self.dtype))
            at += len(e)
        ids = np.concatenate(parts)
        end, size = self.used + len(ids), known + len(fresh)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(end, self.dtype)])
        if size > len(self.starts):
            self.starts, self.lens = (np.concatenate([x[:known], np.zeros(size, np.int64)]) for x in (self.starts, self.lens))
        self.flat[self.used:end] = ids
        self.starts[known:size] = self.used + place
        self.lens[known:size] = lens
        self.used = end


class _Memo(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n

    def since(self, n: int) -> list[str]:
        return list(itertools.islice(reversed(self), len(self) - n))[::-1]


_encoders: dict[str, WordCachedEncoder] = {}


def encoder(path: str) -> WordCachedEncoder:
    """One per Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordCachedEncoder(path)
    return _encoders[path]


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are: a table of blocks and one of frequencies."""

    blocks: str
    frequencies: str
    id_type: str


def stage_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, n, ids) in files whose rows ascend by identifier; part and row give the global order."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    order = [F.col("_id").asc_nulls_last(), F.xxhash64("_text")]
    rows = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)

    def tokenise(batches):
        enc, part, row = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            if not b.num_rows:
                continue
            for i, end in chunks(buffers(b.column("_text"))[1], RUN):
                ids, sizes = enc.encode_array(b.column("_text").slice(i, end - i))
                ids, n = np.insert(ids, np.cumsum(sizes), end_id), end - i
                ids = ids.astype("<u2" if ids.itemsize == 2 else "<u4", copy=False)
                ends = (np.append(0, np.cumsum(sizes + 1)) * ids.itemsize).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(i, n), pa.array(np.full(n, part, np.int32)),
                     pa.array(np.arange(row, row + n)), pa.array((sizes + 1).astype(np.int32)),
                     pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(ids)]),
                     pa.array(np.full(n, ids.itemsize, np.int32))], ["_id", "part", "row", "n", "ids", "width"])
                row += n

    staged = rows.mapInArrow(tokenise, f"_id {kind}, part int, row bigint, n int, ids binary, width int")
    path = scratch_path(spark, "token-ids")
    staged.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(staged.schema).parquet(path)


def _ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4")


def count_ids(staged: DataFrame) -> np.ndarray:
    """Counts of all ids; at most one row per id of the vocabulary comes to the driver."""
    def count(batches):
        n = np.zeros(1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            raw, _ = buffers(b.column("ids"))  # all rows have one width
            c = np.bincount(_ids(raw, b.column("width")[0].as_py()))
            if len(c) > len(n):
                n = np.pad(n, (0, len(c) - len(n)))
            n[:len(c)] += c
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["id", "n"])

    got = staged.select("ids", "width").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = np.asarray(got.column("id")), np.asarray(got.column("n"))
    counts = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    counts[ids] = n
    return counts


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                      text_col: str = "text", block_ids: int = BLOCK_IDS, lanes: int = 1024,
                      interval: int = 128) -> TokenFiles:
    """Write ``path``/blocks and ``path``/frequencies.

    Every document (null and empty texts too) ends with ``end_id``.  Identifiers ascend, nulls
    last; rows with the same identifier follow each other by a digest of their text.  A block
    holds whole documents, at least ``block_ids`` ids unless its file part ends.  An empty
    table gives no blocks.
    """
    spark = docs.sparkSession
    staged = stage_ids(docs, tokenizer, end_id, id_col, text_col)
    counts = count_ids(staged)
    table = normalize(counts)
    spark.createDataFrame([(int(i), int(table.freq[i]), table.scale) for i in np.flatnonzero(table.freq)],
                          "id int, freq int, scale int").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(table)
    kind = staged.schema["_id"].dataType.simpleString()
    id_arrow = None

    def to_blocks(batches):
        nonlocal id_arrow
        held, key, total = [], None, 0

        def block():
            ids = np.concatenate([_ids(raw.as_buffer(), w) for _, raw, w in held])
            n = [len(raw.as_buffer()) // w for _, raw, w in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()),
                 pa.array([[x for x, _, _ in held]], pa.list_(id_arrow)), pa.array([n], pa.list_(pa.int32())),
                 pa.array([len(ids)], pa.int64()),
                 pa.array([encode(ids, shared.value, lanes, interval)], pa.binary())],
                ["part", "row", "doc_ids", "n_tokens", "ids", "payload"])

        for b in batches:
            id_arrow = b.column("_id").type
            for doc, part, row, n, raw, width in zip(
                    b.column("_id").to_pylist(), b.column("part").to_pylist(), b.column("row").to_pylist(),
                    b.column("n").to_pylist(), b.column("ids"), b.column("width").to_pylist()):
                if held and (total >= block_ids or key[0] != part or key[1] + len(held) != row):
                    yield block()
                    held, total = [], 0
                if not held:
                    key = (part, row)
                held.append((doc, raw, width))
                total += n
        if held:
            yield block()

    schema = f"part int, row bigint, doc_ids array<{kind}>, n_tokens array<int>, ids bigint, payload binary"
    staged.mapInArrow(to_blocks, schema).write.parquet(f"{path}/blocks")
    return TokenFiles(f"{path}/blocks", f"{path}/frequencies", kind)


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files.

    ``start`` counts the ids of all documents before.  ``ids`` are little-endian uint32.  A
    block whose checksum fails raises.
    """
    rows = spark.read.parquet(files.frequencies).collect()  # at most the vocabulary
    freq = np.zeros(max([r["id"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    shared = spark.sparkContext.broadcast(Table(freq, rows[0]["scale"] if rows else 12))
    # Whole documents per block, so starts come from narrow rows: totals of parts, then of blocks.
    index = spark.read.parquet(files.blocks).select("part", "row", "ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_starts = index.groupBy("part").agg(F.sum("ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))  # one row per partition
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.withColumn("s", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(
        F.broadcast(part_starts), "part").select("part", "row", (F.col("s") + F.col("part_start")).alias("block_start"))

    def read(batches):
        for b in batches:
            for part, row, docs, n, payload in zip(b.column("part"), b.column("row"), b.column("doc_ids"),
                                                   b.column("n_tokens").to_pylist(), b.column("payload")):
                ids = decode(payload.as_buffer(), shared.value)
                if len(ids) != sum(n):
                    raise ValueError("a block's documents do not add up")
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                texts = [raw[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), n)]
                cols = [docs.values, pa.array([part.as_py()] * len(n), pa.int32()), pa.array([row.as_py()] * len(n), pa.int64()),
                        pa.array(ends - np.array(n)), pa.array(n, pa.int64()),
                        pa.array([zlib.crc32(t) for t in texts], pa.int64())]
                names = ["doc_id", "part", "row", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([t.tobytes() for t in texts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    extra = ", ids binary" if with_ids else ""
    decoded = spark.read.parquet(files.blocks).drop("ids").mapInArrow(
        read, f"doc_id {files.id_type}, part int, row bigint, local bigint, n_tokens bigint, ids_crc32 bigint{extra}")
    return decoded.join(starts, ["part", "row"]).select(
        "doc_id", (F.col("block_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []))


def tokenize_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, **columns) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    spark = docs.sparkSession
    files = write_token_files(docs, scratch_path(spark, "token-files"), tokenizer, end_id, **columns)
    return materialize(read_token_files(spark, files), "tokens")
