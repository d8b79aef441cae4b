"""Deduplication of exact byte repeats by prefix-free parsing.

A rolling hash over ``trigger`` bytes cuts each text into phrases: a phrase runs from one trigger to the end of the
next, so equal text gives equal phrases whatever stands around it, and no phrase is a prefix of another. The
dictionary is the set of distinct phrases, the parse their sequence. A position's place in corpus order follows from
the rest of its phrase (a dictionary suffix) and the phrases after it (a parse suffix). Only the first ``width``
bytes of a suffix count here, so the order is needed to bring equal prefixes together and not to rank the rest:
suffixes are sorted by name (fingerprint), and a neighbour with the same name is a common prefix of ``width`` bytes.

Four Spark rounds narrow the suffixes down. The dictionary: phrases that occur once rule out every suffix whose
prefix contains them. The parse: a stretch of starts between two triggers is sorted as one, by the name of all bytes
its prefixes cover. What is left are stretches of which only a part may repeat; the third round tells which repeated
stretches stand before the same phrase as one of those, and the fourth compares the single positions of both.

Names travel with the least document id of their block, so the same rounds tell which bytes an earlier document has.
Of a repeated stretch only the document with the least id is in doubt, since an earlier one may hold a part of it in
a stretch of another name. That one stands for all in the third and fourth round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import exchange as X
from basketry.llm.arrays import BYTE_CODES, NO_ID, U, Chunk, binary_array, chunks, coverage, group_starts, marked_runs, pack_sorted, prefix_sums, unpack_sorted, windows

CHUNK_BYTES = 2 << 20
#: Phrases only rule suffixes out, so 48 bits do: a clash costs a needless check, never a wrong answer.
PHRASE_MASK = U(0xFFFFFFFFFFFF0000)
RESULT = (
    "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, n_earlier bigint, kept binary, "
    "removed array<struct<start:bigint,stop:bigint>>"
)


class Parse:
    """Prefix-free parse of a chunk: start and stop of each whole phrase, and the triggers' positions."""

    def __init__(self, chunk: Chunk, trigger: int, mean: int):
        data, offsets = chunk.data, chunk.offsets
        self.sums = prefix_sums(BYTE_CODES[0][data], 0)
        n = len(data)
        at = np.arange(max(n - trigger + 1, 0))
        doc_end = np.repeat(offsets[1:], np.diff(offsets))
        self.doc_end = doc_end
        hashes = windows(self.sums, at, at + trigger, 0)
        hit = (hashes & U(mean - 1)) == 0
        hit &= at + trigger <= doc_end[: len(at)]
        self.triggers = np.flatnonzero(hit)
        same = doc_end[self.triggers[1:]] == doc_end[self.triggers[:-1]] if len(self.triggers) else np.zeros(0, bool)
        self.start = self.triggers[:-1][same]
        self.stop = self.triggers[1:][same] + trigger
        self.name = windows(self.sums, self.start, self.stop, 0)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the entry of each row, and whether the entry stands twice."""
    order = np.argsort(keys, kind="stable")
    starts = group_starts(keys[order])
    counts = np.diff(np.concatenate([starts, [len(keys)]]))
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(starts)), counts)
    return keys[order][starts], which, counts > 1


def _distinct_pairs(key: np.ndarray, more: np.ndarray):
    order = np.lexsort((more, key))
    k, m = key[order], more[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])]) if len(k) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    counts = np.diff(np.concatenate([starts, [len(k)]]))
    which = np.empty(len(k), np.int64)
    which[order] = np.cumsum(new) - 1
    return k[starts], m[starts], which, counts > 1


def _ids_at(chunk: Chunk, at: np.ndarray) -> np.ndarray:
    """Document id of each byte position."""
    return chunk.keys()[np.searchsorted(chunk.offsets, at, side="right") - 1]


def _least(which: np.ndarray, ids: np.ndarray, entries: int) -> np.ndarray:
    """Least document id of each entry."""
    out = np.full(entries, NO_ID)
    np.minimum.at(out, which, ids)
    return out


def _positions(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [start, stop), and the length of each range."""
    size = stop - start
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size), size


def _ask_phrases(trigger: int, mean: int, buckets: int):
    def step(batches):
        for block, chunk in zip(X.block_ids(), chunks(batches, CHUNK_BYTES)):  # noqa: B905
            keys, _, _ = _distinct(Parse(chunk, trigger, mean).name & PHRASE_MASK)
            asks = [(b, X.compress(pack_sorted(keys[s]))) for b, s in X.split_by_bucket(keys, buckets)]
            yield X.block_batch(block, asks, X.hold_chunk(chunk))

    return step


def _phrase_elsewhere(asks: list[bytes]) -> list[bytes]:
    keys = [unpack_sorted(X.decompress(blob)[0]) for blob in asks]
    sizes = np.array([len(k) for k in keys])
    _, which, twice = _distinct(np.concatenate(keys))
    return [X.compress(b.astype(np.uint8).tobytes()) for b in np.split(twice[which], np.cumsum(sizes)[:-1])]


def _names(chunk: Chunk, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96-bit names of byte ranges."""
    key = windows(prefix_sums(BYTE_CODES[0][chunk.data], 0), start, stop, 0)
    more = windows(prefix_sums(BYTE_CODES[1][chunk.data], 1), start, stop, 1)
    return key, (more >> U(32)).astype(np.uint32)


def _ask_stretches(trigger: int, mean: int, width: int, buckets: int):
    def step(block: int, hold: bytes, replies: list[bytes]) -> pa.Table:
        chunk, _ = X.held_chunk(hold)
        parse = Parse(chunk, trigger, mean)
        _, which, twice = _distinct(parse.name & PHRASE_MASK)
        shared = (twice | (X.flags(replies) > 0))[which] if len(which) else np.zeros(0, bool)
        n = len(chunk.data)
        # A suffix is ruled out if its first ``width`` bytes contain a phrase that occurs once.
        high = parse.start[~shared]
        doc_start = np.repeat(chunk.offsets[:-1], np.diff(chunk.offsets))
        low = np.maximum(parse.stop[~shared] - width, doc_start[high])
        fits = low <= high
        candidate = (coverage(low[fits], high[fits] + 1, n) == 0) & (np.arange(n) + width <= parse.doc_end)
        # Stretches: candidates between two triggers.
        cut = np.zeros(n + 1, bool)
        cut[parse.triggers] = True
        cut[chunk.offsets] = True
        padded = np.concatenate([[False], candidate, [False]])
        start = np.flatnonzero(candidate & (~padded[:-2] | cut[:-1]))
        stop = np.flatnonzero(candidate & (~padded[2:] | cut[1:])) + 1
        doc = np.searchsorted(chunk.offsets, start, side="right") - 1
        affected = np.zeros(len(chunk), bool)
        affected[doc] = True
        key, more = _names(chunk, start, stop - 1 + width)
        keys, mores, group, own = _distinct_pairs(key, more)
        least = _least(group, chunk.keys()[doc], len(keys))
        # The first whole phrase behind a stretch, for the starts whose prefix contains it; 0 stands for none.
        after = np.searchsorted(parse.start, stop - 1, side="right")
        there = after < len(parse.start)
        after = np.minimum(after, max(len(parse.start) - 1, 0))
        reach = np.where(there, parse.stop[after], 0) if len(parse.start) else np.zeros(len(start), np.int64)
        there &= reach <= stop - 1 + width
        phrase = np.where(there, parse.name[after], U(0)) if len(parse.start) else np.zeros(len(start), U)
        none = ~there | (reach > start + width)
        local = chunk.part(affected)
        shift = local.offsets[np.cumsum(affected) - 1][doc] - chunk.offsets[doc] if len(doc) else doc
        hold = X.hold_chunk(local, start + shift, stop + shift, group.astype(np.int32), own[group] if len(group) else own, phrase, none)
        rest = chunk.part(~affected)
        return pa.Table.from_batches(
            [X.block_batch(block, X.pair_asks(keys, mores, least, buckets), hold if affected.any() else None, X.hold_chunk(rest) if len(rest) else None)]
        )

    return step


def _ask_context(buckets: int):
    def step(block: int, hold: bytes, replies: list[bytes]) -> pa.Table:
        chunk, (start, stop, group, own, phrase, none) = X.held_chunk(hold)
        bits = X.flags(replies)[group] if len(group) else np.zeros(0, np.uint8)
        repeated = own | ((bits & 1) > 0)
        ids = _ids_at(chunk, start)
        earlier = (ids > _least(group, ids, int(group.max()) + 1)[group]) | ((bits & 2) > 0) if len(group) else np.zeros(0, bool)
        # Phrases are marked before which an unresolved stretch stands, or repeated stretches of two names.
        use = ~earlier
        weight = np.zeros(len(group), np.int64)
        weight[np.flatnonzero(use)[np.unique(group[use], return_index=True)[1]]] = 1
        weight[~repeated] = 2
        context = np.concatenate([phrase[use], np.zeros(int((none & use).sum()), U)])
        keys, which, _ = _distinct(context)
        mark = np.minimum(np.bincount(which, weights=np.concatenate([weight[use], weight[none & use]]), minlength=len(keys)), 2).astype(np.uint8)
        asks = [(b, X.compress(pack_sorted(keys[s]), mark[s].tobytes())) for b, s in X.split_by_bucket(keys, buckets)]
        hold = X.hold_chunk(chunk, start, stop, repeated, earlier, phrase, none)
        return pa.Table.from_batches([X.block_batch(block, asks, hold)])

    return step


def _marked_anywhere(asks: list[bytes]) -> list[bytes]:
    parts = [X.decompress(blob) for blob in asks]
    keys = [unpack_sorted(k) for k, _ in parts]
    sizes = np.array([len(k) for k in keys])
    mark = np.concatenate([np.frombuffer(m, np.uint8) for _, m in parts])
    _, which, _ = _distinct(np.concatenate(keys))
    anywhere = (np.bincount(which, weights=mark) > 1)[which].astype(np.uint8)
    return [X.compress(b.tobytes()) for b in np.split(anywhere, np.cumsum(sizes)[:-1])]


def _ask_positions(width: int, buckets: int):
    def step(block: int, hold: bytes, replies: list[bytes]) -> pa.Table:
        chunk, (start, stop, repeated, earlier, phrase, none) = X.held_chunk(hold)
        use = ~earlier
        context = np.concatenate([phrase[use], np.zeros(int((none & use).sum()), U)])
        keys, which, _ = _distinct(context)
        marked = X.flags(replies)[which] > 0 if len(which) else np.zeros(0, bool)
        asked = np.zeros(len(start), bool)
        asked[np.flatnonzero(use)] = marked[: int(use.sum())]
        asked[np.flatnonzero(none & use)] |= marked[int(use.sum()) :]
        asked |= ~repeated
        at, size = _positions(start[asked], stop[asked])
        key, more = _names(chunk, at, at + width)
        keys, mores, which, twice = _distinct_pairs(key, more)
        ids = np.repeat(_ids_at(chunk, start[asked]), size)
        least = _least(which, ids, len(keys))
        own = twice[which] + 2 * (ids > least[which]) if len(which) else twice
        hold = X.hold_chunk(
            chunk, start[repeated], stop[repeated], earlier[repeated], start[asked], stop[asked], which.astype(np.int32), own.astype(np.uint8)
        )
        return pa.Table.from_batches([X.block_batch(block, X.pair_asks(keys, mores, least, buckets), hold)])

    return step


def _cut(chunk: Chunk, gone: np.ndarray, earlier: np.ndarray) -> pa.Table:
    ends = np.concatenate([[0], np.cumsum(~gone)])
    spans = marked_runs(gone, chunk.offsets)
    return pa.table(
        {
            "doc_id": pa.array(chunk.ids, mask=~chunk.has_id),
            "n_bytes": pa.array(np.diff(chunk.offsets)),
            "n_removed": pa.array(np.diff(chunk.offsets) - np.diff(ends[chunk.offsets])),
            "n_spans": pa.array(np.diff(np.asarray(spans.offsets)).astype(np.int64)),
            "n_earlier": pa.array(np.diff(np.concatenate([[0], np.cumsum(earlier)])[chunk.offsets])),
            "kept": binary_array(chunk.data[~gone], ends[chunk.offsets], pa.binary()),
            "removed": spans,
        }
    )


def _finish(width: int):
    def step(block: int, hold: bytes, replies: list[bytes]) -> pa.Table:
        chunk, (start, stop, earlier, first, last, which, own) = X.held_chunk(hold)
        at, _ = _positions(first, last)
        bits = own | X.flags(replies)[which] if len(at) else own
        n = len(chunk.data)

        def covered(whole: np.ndarray, bit: int) -> np.ndarray:
            hit = at[(bits & bit) > 0]
            return (coverage(start[whole], stop[whole] - 1 + width, n) > 0) | (coverage(hit, hit + width, n) > 0)

        return _cut(chunk, covered(np.ones(len(start), bool), 1), covered(earlier, 2))

    return step


def _untouched(batches):
    for batch in batches:
        for blob in batch.column(0):
            chunk, _ = X.held_chunk(blob.as_py())
            yield from _cut(chunk, *np.zeros((2, len(chunk.data)), bool)).to_batches()


def remove_repeated_bytes(docs: DataFrame, width: int = 400, trigger: int = 12, mean: int = 32) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts at another place of the corpus.

    All occurrences go, the first one included; the other place may lie in the same document and may overlap; strings
    never cross documents and are judged on the input. Returns one row per input row: doc_id, n_bytes, n_removed,
    n_spans, kept (remaining bytes; a cut may split a character), removed (maximal byte ranges) and n_earlier: how many
    of the removed bytes are covered by a ``width``-byte string that also starts in a document with a smaller doc_id. A
    first copy and text that repeats in one document alone have none. Rows with one doc_id are not earlier than each
    other; a null doc_id counts as larger than all others.

    Null or empty text: no bytes. Texts shorter than ``width`` stay. Repeated rows are documents of their own and
    remove each other's text. A null doc_id is allowed; extra columns are ignored. An empty table gives none.
    ``mean`` must be a power of two.

    Memory: a task holds one block of 2 MB (or one longer document) or one bucket of names; buckets follow
    spark.sql.shuffle.partitions. Shuffled: about four bytes for each phrase of ``mean`` bytes, and twelve for each
    stretch and unresolved position (more where the doc_ids of a block lie far apart).
    """
    spark = docs.sparkSession
    buckets = X.bucket_count(spark)
    first = X.written(X.document_columns(docs).mapInArrow(_ask_phrases(trigger, mean, buckets), X.BLOCK_SCHEMA))
    second = X.written(X.resumed(first, X.answers(first, _phrase_elsewhere), _ask_stretches(trigger, mean, width, buckets), X.BLOCK_SCHEMA))
    X.dropped(first)
    third = X.written(X.resumed(second, X.answers(second, X.in_other_blocks), _ask_context(buckets), X.BLOCK_SCHEMA))
    fourth = X.written(X.resumed(third, X.answers(third, _marked_anywhere), _ask_positions(width, buckets), X.BLOCK_SCHEMA))
    X.dropped(third)
    cut = X.resumed(fourth, X.answers(fourth, X.in_other_blocks), _finish(width), RESULT)
    whole = second.where("done is not null").select("done").mapInArrow(_untouched, RESULT)
    return cut.unionByName(whole)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract view: bytes removed from each document and the digest of what stays; and how many an earlier document has."""
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"), "n_earlier")
