"""Static range asymmetric numeral system over token ids; numpy only, one block at a time.

A block's ids are dealt over interleaved lanes that share one stream of 32-bit words: lane
i holds ids i, i + lanes, ...  Checkpoints (all lane states and the place in the stream)
are kept every few steps, so one block can also be decoded from its middle, and a CRC-32 of
the ids ends the header.

Block: ``<4sBBHIIIII`` magic, version, scale, lanes, ids, words, steps between checkpoints,
number of checkpoints, CRC-32 of the ids as little-endian uint32; then per checkpoint one
uint32 (words read so far) and the lanes' uint64 states; then the words.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

U = np.uint64
MAGIC, VERSION, HEAD = b"RANS", 1, struct.Struct("<4sBBHIIIII")
LOW = U(1 << 31)  # states are in [LOW, LOW << 32)


@dataclass(frozen=True)
class Table:
    """Frequencies of ids, adding up to ``1 << scale``; unused ids have none."""

    freq: np.ndarray
    scale: int
    start: np.ndarray = field(init=False)
    lookup: np.ndarray = field(init=False)

    def __post_init__(self):
        f = self.freq.astype(U)
        object.__setattr__(self, "freq", f)
        object.__setattr__(self, "start", np.cumsum(f) - f)
        object.__setattr__(self, "lookup", np.repeat(np.arange(len(f), dtype=np.uint32), f.astype(np.int64)))


def normalize(counts: np.ndarray) -> Table:
    """Counts scaled to a power of two at least four times the used ids; every used id keeps one."""
    counts = np.asarray(counts, np.float64)
    used = np.flatnonzero(counts)
    scale = max(12, (4 * max(1, len(used)) - 1).bit_length())
    freq = np.zeros(len(counts), np.int64)
    if len(used) == 0:
        return Table(freq, scale)
    total = 1 << scale
    freq[used] = np.maximum(1, np.floor(counts[used] / counts.sum() * total).astype(np.int64))
    # What rounding lost or took goes to or comes from the most frequent ids.
    order = used[np.argsort(-counts[used], kind="stable")]
    over = total - int(freq.sum())
    if over > 0:
        freq[order[0]] += over
    for i in order:
        if over >= 0:
            break
        back = min(int(freq[i]) - 1, -over)
        freq[i] -= back
        over += back
    return Table(freq, scale)


def encode(ids: np.ndarray, table: Table, lanes: int = 1024, interval: int = 128) -> bytes:
    n = len(ids)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    if n == 0:
        return HEAD.pack(MAGIC, VERSION, table.scale, lanes, 0, 0, interval, 0, crc)
    steps = -(-n // lanes)
    filler = int(np.argmax(table.freq))
    grid = np.full(steps * lanes, filler, np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    if (table.freq[grid] == 0).any():
        raise ValueError("an id has no frequency")
    x = np.full(lanes, LOW, U)
    shift, scale = U(31 - table.scale + 32), U(table.scale)
    words, marks = [], {}
    for s in range(steps - 1, -1, -1):
        f, c = table.freq[grid[s]], table.start[grid[s]]
        big = x >= (f << shift)
        out = (x[big] & U(0xFFFFFFFF)).astype("<u4")
        words.append(out)
        x[big] >>= U(32)
        q = x // f
        x = (q << scale) + (x - q * f) + c
        if s % interval == 0:
            marks[s] = x.copy()
    words.reverse()
    read = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    body = b"".join(struct.pack("<I", int(read[s])) + marks[s].astype("<u8").tobytes() for s in sorted(marks))
    return HEAD.pack(MAGIC, VERSION, table.scale, lanes, n, int(read[-1]), interval, len(marks), crc) + body + np.concatenate(words).tobytes()


def decode(block: bytes, table: Table, first_checkpoint: int = 0) -> np.ndarray:
    """The ids from a checkpoint on; from the first one, all ids, held against the checksum."""
    magic, version, scale, lanes, n, count, interval, marks, crc = HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION or scale != table.scale:
        raise ValueError("not a block of this table")
    at, each = HEAD.size, 4 + 8 * lanes
    words = np.frombuffer(block, "<u4", count, at + each * marks).astype(U)
    if n == 0:
        return np.zeros(0, np.uint32)
    spot = at + each * first_checkpoint
    p = struct.unpack_from("<I", block, spot)[0]
    x = np.frombuffer(block, "<u8", lanes, spot + 4).astype(U)
    steps, begin = -(-n // lanes), first_checkpoint * interval
    out = np.empty((steps - begin, lanes), np.uint32)
    mask, bits = U((1 << scale) - 1), U(scale)
    for s in range(steps - begin):
        slot = x & mask
        ids = table.lookup[slot.astype(np.int64)]
        out[s] = ids
        x = table.freq[ids] * (x >> bits) + slot - table.start[ids]
        small = np.flatnonzero(x < LOW)
        x[small] = (x[small] << U(32)) | words[p:p + len(small)]
        p += len(small)
    ids = out.reshape(-1)[:n - begin * lanes]
    if first_checkpoint == 0 and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block does not match")
    return ids
