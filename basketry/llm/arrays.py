"""Array helpers that run inside Spark tasks: tokens, fingerprints and compact encodings as numpy vectors.

Texts are read as one byte vector per chunk; words, hashes and windows are vectors over it, so no helper
loops over words or bytes in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Word separators of every operator here: space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Sort key of a row without a doc_id: behind every document that has one.
NO_ID = np.iinfo(np.int64).max

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * U(2) + U(1)
#: Odd, so every power has an inverse modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = (n // (1 << 18) + 1) * (1 << 18)
        out = []
        for base in (BASES[which], pow(BASES[which], -1, 2**64)):
            p = np.full(size, base, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[which] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_sums(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial over ``values``; ``windows`` reads fingerprints of ranges from them."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(which, len(values))[0], out=out[1:])
    return out


def windows(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
    """Fingerprints of the ranges [start, stop); equal content gives equal values wherever it stands."""
    inverse = powers(which, len(sums))[1]
    return mix((sums[stop] - sums[start]) * inverse[start] + (stop - start).astype(U) * U(0x632BE59BD9B4E019))


class Chunk:
    """Consecutive documents of one batch: ids, bytes and document offsets, and a flag for each if the rows have one."""

    def __init__(self, ids: np.ndarray, has_id: np.ndarray, data: np.ndarray, offsets: np.ndarray, flag: np.ndarray | None = None):
        self.ids, self.has_id, self.data, self.offsets, self.flag = ids, has_id, data, offsets, flag

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def keys(self) -> np.ndarray:
        """doc_id with NO_ID for null."""
        return np.where(self.has_id, self.ids, NO_ID)

    def part(self, keep: np.ndarray) -> Chunk:
        """The documents marked in ``keep``."""
        which = np.flatnonzero(keep)
        lengths = np.diff(self.offsets)[which]
        data = np.concatenate([self.data[self.offsets[i] : self.offsets[i + 1]] for i in which]) if len(which) else self.data[:0]
        return Chunk(self.ids[which], self.has_id[which], data, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, size: int):
    """Cut Arrow batches of (doc_id, text) into chunks of about ``size`` bytes; a longer text stays whole in one.

    Small batches are joined, so a chunk is full unless the partition ends.
    """
    held: list[Chunk] = []
    total = 0

    def joined(parts: list[Chunk]) -> Chunk:
        if len(parts) == 1:
            return parts[0]
        lengths = np.concatenate([np.diff(p.offsets) for p in parts])
        return Chunk(
            np.concatenate([p.ids for p in parts]),
            np.concatenate([p.has_id for p in parts]),
            np.concatenate([p.data for p in parts]),
            np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
            None if parts[0].flag is None else np.concatenate([p.flag for p in parts]),
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        id_column = batch.column(0)
        has_id = np.asarray(id_column.is_valid())
        ids = np.asarray(id_column.fill_null(0).cast(pa.int64()))
        data, offsets = text_bytes(batch.column(1))
        flag = np.asarray(batch.column(2)) if batch.num_columns > 2 else None
        at = 0
        while at < len(ids):
            stop = int(np.searchsorted(offsets, offsets[at] + max(size - total, 1), side="right"))
            stop = min(max(stop - 1, at + 1), len(ids))
            held.append(Chunk(ids[at:stop], has_id[at:stop], data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], None if flag is None else flag[at:stop]))
            total += int(offsets[stop] - offsets[at])
            at = stop
            if total >= size or at < len(ids):
                yield joined(held)
                held, total = [], 0
    if held:
        yield joined(held)


class Words:
    """The words of a chunk: byte ranges, document of each, first word of each document."""

    def __init__(self, chunk: Chunk, lower: bool = False, second: bool = False):
        data, offsets = chunk.data, chunk.offsets
        if lower:
            data = LOWER[data]
        n = len(data)
        solid = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        self.start = np.flatnonzero(solid & (before | edge[:-1]))
        self.stop = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = windows(prefix_sums(BYTE_CODES[0][data], 0), self.start, self.stop, 0)
        if second:
            self.hash2 = windows(prefix_sums(BYTE_CODES[1][data], 1), self.start, self.stop, 1)

    def __len__(self) -> int:
        return len(self.start)


def pack_planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, lowest first, without the planes that are zero throughout."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(raw[:, :width].T).tobytes()


def unpack_planes(blob: bytes, dtype=np.uint64) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    raw = np.zeros((planes.shape[1], np.dtype(dtype).itemsize), np.uint8)
    raw[:, : min(width, raw.shape[1])] = planes.T[:, : raw.shape[1]]
    return raw.reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned integers as byte planes of their differences."""
    if not len(keys):
        return pack_planes(keys)
    return pack_planes(np.concatenate([keys[:1], np.diff(keys)]))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(blob), dtype=U)


def group_starts(keys: np.ndarray) -> np.ndarray:
    """Positions where a new value starts in sorted ``keys``."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def coverage(start: np.ndarray, stop, size: int) -> np.ndarray:
    """How many of the ranges [start, stop) cover each position."""
    stop = np.broadcast_to(stop, start.shape)
    return np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(stop, minlength=size + 1))[:size]


def marked_runs(mask: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Maximal marked runs of each document (its positions start at ``first``) as lists of (start, stop)."""
    n, docs = len(mask), len(first) - 1
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    padded = np.concatenate([[False], mask, [False]])
    start = np.flatnonzero(mask & (~padded[:-2] | edge[:-1]))
    stop = np.flatnonzero(mask & (~padded[2:] | edge[1:])) + 1
    doc = np.searchsorted(first, start, side="right") - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))]).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start - first[doc]), pa.array(stop - first[doc])], ["start", "stop"])
    return pa.ListArray.from_arrays(offsets, spans)


def binary_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow strings or binaries from bytes and offsets."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]
    return pa.Array.from_buffers(kind, len(offsets) - 1, buffers)
