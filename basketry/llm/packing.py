"""Packing documents into sequences of bounded length by a configuration linear program.

Only the histogram of piece lengths (one count per length up to the capacity) reaches the driver. There the program
"cover all pieces with as few patterns as possible" is solved by multiplicative weights: a length's price falls as it
gets covered, and a knapsack over the capacity prices the next patterns. The fractional solution is rounded to whole
copies and the program solved anew for what is left; when rounding places nothing more, the rest is filled best-fit, in
counts too. Tasks then give each piece its slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm import exchange as X
from basketry.llm.arrays import BYTE_CODES, SPACE, U, Chunk, chunks, group_starts, prefix_sums, windows

CHUNK_BYTES = 2 << 20
#: Word tokens a task remembers; beyond it the memory starts anew, which costs time only.
REMEMBERED = 1 << 20
PIECES = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, block bigint, place bigint"
#: White space beyond ASCII (UTF-8), at which texts cannot be cut into independent words.
WIDE_SPACE = tuple(map(chr, (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class Encoder:
    """Token ids of whole texts, computed word by word and remembered.

    Byte-level BPE splits at the start of every run of white space, so the ids of a text are those of its words with
    the space before them. Texts with white space that is not ASCII are encoded as one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.wide = [w.encode() for w in WIDE_SPACE]
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that start with a space: in a row of " word" texts exactly the first id of each.
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, U)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        #: Place 0 holds the id that ends a document.
        self.pool = np.zeros(1, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Remember the ids of texts; plain " word" texts are encoded many at a time, as one line."""
        plain = np.array([t[0] == " " and t[1:2] not in ("", " ", "\n", "\t", "\r", "\x0b", "\x0c") for t in texts], bool)
        ids = np.zeros(0, np.uint32)
        size = np.zeros(len(texts), np.int64)
        where = np.flatnonzero(plain)
        if len(where):
            lines = ["".join(texts[i] for i in where[a : a + 1000]) for a in range(0, len(where), 1000)]
            ids = np.concatenate([np.array(line, np.uint32) for line in self.encode(lines)])
            first = np.flatnonzero(self.opens[ids])
            size[where] = np.diff(np.append(first, len(ids)))
        rest = np.flatnonzero(~plain)
        others = self.encode([texts[i] for i in rest])
        size[rest] = [len(i) for i in others]
        at = np.empty(len(texts), np.int64)
        at[where] = len(self.pool) + np.cumsum(size[where]) - size[where]
        at[rest] = len(self.pool) + len(ids) + np.cumsum(size[rest]) - size[rest]
        self.pool = np.concatenate([self.pool, ids, np.array([x for i in others for x in i], np.uint32)])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def documents(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk, each document ended by id 0, and the documents' offsets."""
        data, offsets = chunk.data, chunk.offsets
        raw = data.tobytes()
        whole = np.zeros(len(chunk), bool)
        if any(w in raw for w in self.wide):
            whole = np.array([any(w in chunk.text(i) for w in self.wide) for i in range(len(chunk))])
        space = SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[:-1] &= ~np.repeat(whole, np.diff(offsets))
        cut[offsets] = True
        start = np.flatnonzero(cut[:-1])
        stop = np.append(start[1:], len(data))
        doc = np.searchsorted(offsets, start, side="right") - 1
        key = windows(prefix_sums(BYTE_CODES[0][data], 0), start, stop, 0)
        unique, first, which = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == unique if len(self.keys) else np.zeros(len(unique), bool)
        if not known.all():
            if len(self.keys) > REMEMBERED:
                self.clear()
                known[:] = False
            new = first[~known]
            self.learn(unique[~known], [raw[a:b].decode() for a, b in zip(start[new].tolist(), stop[new].tolist(), strict=True)])
            place = np.searchsorted(self.keys, unique)
        at, size = self.at[place][which], self.size[place][which]
        # One more entry per document: the end.
        last = np.searchsorted(doc, np.arange(len(chunk)), side="right")
        at, size, doc = np.insert(at, last, 0), np.insert(size, last, 1), np.insert(doc, last, np.arange(len(chunk)))
        ends = np.cumsum(size)
        ids = self.pool[np.arange(int(ends[-1])) + np.repeat(at - (ends - size), size)]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=len(chunk)))]).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _pieces(path: str, capacity: int, with_ids: bool):
    def step(batches):
        tool = encoder(path)
        for block, chunk in zip(X.block_ids(), chunks(batches, CHUNK_BYTES)):  # noqa: B905
            ids, offsets = tool.documents(chunk)
            size = np.diff(offsets)
            count = -(-size // capacity)
            first = size - (count - 1) * capacity
            doc = np.repeat(np.arange(len(chunk)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            length = np.where(piece == 0, first[doc], capacity)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            left = offsets[doc] + start
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(left.tolist(), (left + length).tolist(), strict=True)]
            # Place of each piece among those of its length in this block.
            order = np.argsort(length, kind="stable")
            starts = group_starts(length[order])
            place = np.empty(len(doc), np.int64)
            place[order] = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
            columns = [
                pa.array(chunk.ids[doc], mask=~chunk.has_id[doc]), pa.array(piece.astype(np.int32)), pa.array(start),
                pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), block)), pa.array(place),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "place"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(np.append(left, offsets[-1]).astype(np.int32), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return step


def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to the capacity the greatest total value of lengths, and the length to take first."""
    capacity = len(value) - 1
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = value[1 : c + 1] + best[c - 1 :: -1] if c > 1 else value[1:2] + best[:1]
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], choice[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, choice


def filling(choice: np.ndarray, room: int) -> list[int]:
    """The lengths the knapsack takes for a room."""
    picked = []
    while room > 0:
        if choice[room]:
            picked.append(int(choice[room]))
            room -= picked[-1]
        else:
            room -= 1
    return picked


def best_pattern(value: np.ndarray) -> np.ndarray:
    """Lengths (each any number of times) of the greatest total value within the capacity, by dynamic programming."""
    return np.bincount(filling(knapsack(value)[1], len(value) - 1), minlength=len(value))


#: A pattern as its lengths and how often it holds each.
Pattern = tuple[tuple[int, ...], tuple[int, ...]]


def fractional(counts: np.ndarray, rounds: int, step: float = 0.25, sharp: float = 1.0, bulk: float = 0.5) -> dict[Pattern, float]:
    """Patterns and fractional copies of the configuration program, by multiplicative weights.

    A length's price starts near its tokens (the dual prices of a program that meets the token bound; long pieces, which
    fit with less, a little above) and falls by a factor with the share of it that is covered. One knapsack prices the
    best pattern *around every length* at once, so a round raises each length at most once, and most of them. It ends
    when every length is covered, or after ``rounds``.
    """
    capacity = len(counts) - 1
    have = np.flatnonzero(counts)
    # Prices differ in the fifth digit, so that equal fills give mixed patterns in place of the shortest length's.
    start = np.zeros(capacity + 1)
    start[have] = have * (1 + bulk * have / capacity) * (1 + 1e-4 * np.random.default_rng(0).random(capacity + 1)[have])
    share = np.zeros(capacity + 1)
    found: dict[Pattern, float] = {}
    for _ in range(rounds):
        uncovered = have[share[have] < 1 - 1e-9]
        if not len(uncovered):
            break
        price = start * np.exp(-sharp * share)
        best, choice = knapsack(price)
        worth = price[uncovered] + best[capacity - uncovered]
        raised = np.zeros(capacity + 1, bool)
        for length in uncovered[np.argsort(-worth, kind="stable")].tolist():
            pieces = [] if raised[length] else [length, *filling(choice, capacity - length)]
            if not pieces or raised[pieces].any():
                continue
            lengths, times = np.unique(pieces, return_counts=True)
            times = np.minimum(times, counts[lengths])
            amount = step * float((counts[lengths] / times).min())
            raised[lengths] = True
            share[lengths] += times * amount / counts[lengths]
            key = (tuple(lengths.tolist()), tuple(times.tolist()))
            found[key] = found.get(key, 0.0) + amount
    return found


def programmed(counts: np.ndarray, rounds: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """What the program places, and the counts it leaves.

    A solution is rounded to whole copies, full patterns only, as far as there are pieces; the program is then solved
    anew for the rest, until rounding places nothing more.
    """
    left = counts.astype(np.int64).copy()
    capacity = len(counts) - 1
    result: list[tuple[np.ndarray, int]] = []
    placed = True
    while placed and left.any():
        placed = False
        solution = fractional(left, rounds).items()
        # Long pieces first, which few patterns can take; then what the program uses most.
        for (lengths, times), amount in sorted(solution, key=lambda e: (-e[0][0][-1], -e[1], e[0])):
            at, n = np.array(lengths), np.array(times)
            copies = min(max(1, round(amount)), int((left[at] // n).min()))
            if copies and (at * n).sum() == capacity:
                pattern = np.zeros(capacity + 1, np.int32)
                pattern[at] = n
                result.append((pattern, copies))
                left[at] -= n * copies
                placed = True
    return result, left


def best_fit(counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns that place all pieces, each sequence taking the longest that fits again and again."""
    left = counts.copy()
    capacity = len(counts) - 1
    result: list[tuple[np.ndarray, int]] = []
    while left.any():
        pattern = np.zeros(capacity + 1, np.int32)
        gap = capacity
        while True:
            fits = np.flatnonzero((left[: gap + 1] - pattern[: gap + 1]) > 0)
            if not len(fits):
                break
            pattern[fits[-1]] += 1
            gap -= int(fits[-1])
        used = pattern > 0
        copies = int((left[used] // pattern[used]).min())
        result.append((pattern, copies))
        left[used] -= pattern[used].astype(np.int64) * copies
    return result


def plan(counts: np.ndarray, rounds: int = 80) -> list[tuple[np.ndarray, int]]:
    """Patterns (copies of each length) and how often each is used; together they hold exactly ``counts``."""
    patterns, left = programmed(counts, rounds)
    return patterns + best_fit(left)


def slots(patterns: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, ...]:
    """For each length its runs of slots: length, first rank, first sequence and offset, sorted by length and rank."""
    rows = []
    given: dict[int, int] = {}
    sequence = 0
    for pattern, copies in patterns:
        offset = 0
        for length in np.flatnonzero(pattern)[::-1].tolist():
            for _ in range(int(pattern[length])):
                rank = given.get(length, 0)
                rows.append((length, rank, sequence, offset))
                given[length] = rank + copies
                offset += length
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


def _assign(table: tuple[np.ndarray, ...]):
    length, rank, sequence, offset = table
    key = (length << 44) + rank

    def step(batches):
        for batch in batches:
            size = np.asarray(batch.column("length")).astype(np.int64)
            mine = np.asarray(batch.column("place")) + np.asarray(batch.column("before"))
            at = np.searchsorted(key, (size << 44) + mine, side="right") - 1
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("place", "before", "block")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence[at] + mine - rank[at]), pa.array(offset[at])],
                [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    return step


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts, end each with id 0, and cut those longer than ``capacity`` (the first piece is the shorter)."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return X.document_columns(docs).mapInArrow(_pieces(tokenizer, capacity, with_ids), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as the configuration program finds.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and offset.

    Null or empty text: the end token alone. Repeated rows are packed each. A null doc_id stays null. Extra columns
    are ignored; an empty table gives no piece. Long texts are encoded in blocks of whole documents.

    Memory: a task holds 2 MB of text or one longer document; the driver holds one count per length and a plan whose
    size follows the capacity and not the corpus.
    """
    pieces = X.written(token_pieces(docs, tokenizer, capacity, with_ids))
    per_block = X.written(pieces.groupBy("block", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    table = slots(plan(counts))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = per_block.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    more = ", ids array<int>" if with_ids else ""
    schema = f"doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint{more}, sequence_id bigint, offset bigint"
    columns = [*(c for c in pieces.columns), "before"]
    return pieces.join(before, ["block", "length"]).select(*columns).mapInArrow(_assign(table), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from ``pack(..., with_ids=True)``; a group holds at most ``capacity`` tokens."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract view: byte-level BPE, sequences of 2048 tokens."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return packed.withColumn("length", F.col("length").cast("bigint"))
