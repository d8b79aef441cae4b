"""Substring deduplication by recompression.

Every text becomes a sequence of symbols, first its words. A round names each maximal run of one symbol, then each
pair (left, right) whose symbols fall on the two sides of a hash split. A name is a fingerprint of what it stands
for, so all tasks give the same name to the same content with no dictionary to share, and equal substrings get equal
symbols but for a few at their ends. Each symbol carries its context: the words that decide that it is there. After
``rounds`` rounds Spark learns for every symbol whether it also stands in a document before or after this one. A
window of words can only occur elsewhere if every symbol whose context it contains does, so the few windows that pass
are the candidates; a second Spark round verifies them by 96-bit fingerprints of their whole word sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import exchange as X
from basketry.llm.arrays import U, Chunk, Words, binary_array, chunks, coverage, group_starts, marked_runs, mix, pack_planes, pack_sorted, prefix_sums, unpack_planes, unpack_sorted, windows

CHUNK_BYTES = 4 << 20
#: A symbol only filters candidates, so 48 bits do: a clash costs a needless check, never a wrong answer.
SYMBOL_MASK = U(0xFFFFFFFFFFFF0000)
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:bigint,stop:bigint>>"


def recompress(symbol: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after ``rounds`` rounds, with the first and last (exclusive) word of each one's context.

    A context that would pass a document's border is widened beyond it, so no window contains it.
    """
    low = np.arange(len(symbol))
    high = low + 1
    for level in range(rounds):
        if not len(symbol):
            break
        # Maximal runs; the neighbours that end a run belong to its context.
        border = np.concatenate([[True], doc[1:] != doc[:-1]])
        first = np.flatnonzero(border | np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        length = np.diff(np.concatenate([first, [len(symbol)]]))
        last = first + length - 1
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(symbol) - 1)
        at_start, at_end = border[first], np.concatenate([border[first[1:]], [True]])
        new_low = np.where(at_start, low[first] - 1, low[before])
        new_high = np.where(at_end, high[last] + 1, high[after])
        symbol = np.where(length > 1, mix(symbol[first] + length.astype(U) * U(0xA24BAED4963EE407)), symbol[first])
        low, high, doc = new_low, new_high, doc[first]
        # Pairs of a left and a right symbol; a symbol left alone depends on the neighbour it was not paired with.
        right = (mix(symbol + U((level + 1) * 0x9FB21C651E98DF25 % 2**64)) & U(1)).astype(bool)
        inside = np.concatenate([doc[1:] == doc[:-1], [False]])
        pair = np.zeros(len(symbol), bool)
        pair[:-1] = ~right[:-1] & right[1:]
        pair &= inside
        taken = np.concatenate([[False], pair[:-1]])
        follow = np.minimum(np.arange(len(symbol)) + 1, len(symbol) - 1)
        lead = np.maximum(np.arange(len(symbol)) - 1, 0)
        inside_before = np.concatenate([[False], inside[:-1]])
        pair_low, pair_high = np.minimum(low, low[follow]), np.maximum(high, high[follow])
        alone_low = np.where(right, np.where(inside_before, np.minimum(low, low[lead]), low - 1), low)
        alone_high = np.where(~right, np.where(inside, np.maximum(high, high[follow]), high + 1), high)
        name = mix(symbol * U(0xC2B2AE3D27D4EB4F) + mix(symbol[follow] + U(0x165667B19E3779F9)))
        symbol = np.where(pair, name, symbol)[~taken]
        low = np.where(pair, pair_low, alone_low)[~taken]
        high = np.where(pair, pair_high, alone_high)[~taken]
        doc = doc[~taken]
    return symbol, low, high


def _symbols(chunk: Chunk, rounds: int):
    """Words of a chunk, its symbols (document, context) and, by distinct symbol, the least and largest document."""
    words = Words(chunk, second=True)
    symbol, low, high = recompress(words.hash, words.doc, rounds)
    doc = words.doc[np.clip((low + high) // 2, 0, max(len(words) - 1, 0))] if len(symbol) else np.zeros(0, np.int64)
    symbol = symbol & SYMBOL_MASK
    order = np.argsort(symbol, kind="stable")
    starts = group_starts(symbol[order])
    keys = symbol[order][starts]
    ids = chunk.keys()[doc][order]
    least = np.minimum.reduceat(ids, starts) if len(starts) else ids[:0]
    most = np.maximum.reduceat(ids, starts) if len(starts) else ids[:0]
    which = np.empty(len(symbol), np.int64)
    which[order] = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(symbol)]])))
    return words, doc, low, high, keys, least, most, which


def _pack_ids(ids: np.ndarray) -> bytes:
    base = int(ids.min())
    return np.array([base], np.int64).tobytes() + pack_planes(ids.astype(U) - U(base & (2**64 - 1)))


def _unpack_ids(blob: bytes) -> np.ndarray:
    return (unpack_planes(blob[8:]) + np.frombuffer(blob, U, 1)[0]).astype(np.int64)


def _ask_symbols(rounds: int, buckets: int):
    def step(batches):
        for block, chunk in zip(X.block_ids(), chunks(batches, CHUNK_BYTES)):  # noqa: B905
            _, _, _, _, keys, least, most, _ = _symbols(chunk, rounds)
            asks = [
                (b, X.compress(pack_sorted(keys[s]), _pack_ids(least[s]), pack_planes(most[s].astype(U) - least[s].astype(U))))
                for b, s in X.split_by_bucket(keys, buckets)
            ]
            yield X.block_batch(block, asks, X.hold_chunk(chunk))

    return step


def _stands_elsewhere(asks: list[bytes]) -> list[bytes]:
    """Bit 0: the symbol stands in a document before all of the block's; bit 1: in one behind all of them."""
    keys, least, most = [], [], []
    for blob in asks:
        k, low, width = X.decompress(blob)
        low = _unpack_ids(low)
        keys.append(unpack_sorted(k))
        least.append(low)
        most.append((low.astype(U) + unpack_planes(width)).astype(np.int64))
    sizes = np.array([len(k) for k in keys])
    keys, least, most = np.concatenate(keys), np.concatenate(least), np.concatenate(most)
    order = np.argsort(keys, kind="stable")
    starts = group_starts(keys[order])
    counts = np.diff(np.concatenate([starts, [len(keys)]]))
    bits = np.empty(len(keys), np.uint8)
    bits[order] = (np.repeat(np.minimum.reduceat(least[order], starts), counts) < least[order]) + 2 * (
        np.repeat(np.maximum.reduceat(most[order], starts), counts) > most[order]
    )
    return [X.compress(b.tobytes()) for b in np.split(bits, np.cumsum(sizes)[:-1])]


def _verify_windows(asks: list[bytes]) -> list[bytes]:
    """Whether each window's word sequence stands in a document before all of the block's."""
    keys, more, least = [], [], []
    for blob in asks:
        k, m, ids = X.decompress(blob)
        keys.append(unpack_sorted(k))
        more.append(np.frombuffer(m, np.uint32))
        least.append(_unpack_ids(ids))
    sizes = np.array([len(k) for k in keys])
    keys, more, least = np.concatenate(keys), np.concatenate(more), np.concatenate(least)
    order = np.lexsort((more, keys))
    new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])])
    starts = np.flatnonzero(new)
    earlier = np.empty(len(keys), np.uint8)
    earlier[order] = np.repeat(np.minimum.reduceat(least[order], starts), np.diff(np.concatenate([starts, [len(keys)]]))) < least[order]
    return [X.compress(b.tobytes()) for b in np.split(earlier, np.cumsum(sizes)[:-1])]


def _ask_windows(rounds: int, width: int, buckets: int):
    def step(block: int, hold: bytes, replies: list[bytes]) -> pa.Table:
        chunk, _ = X.held_chunk(hold)
        words, doc, low, high, keys, least, most, which = _symbols(chunk, rounds)
        bits = X.flags(replies)
        ids = chunk.keys()
        n = len(words)
        is_start = np.arange(n) + width <= words.first[1:][words.doc] if n else np.zeros(0, bool)

        def possible(elsewhere: np.ndarray) -> np.ndarray:
            """Windows that contain the context of no symbol that stands nowhere else."""
            a, b = np.maximum(high - width, words.first[doc]), low
            bad = ~elsewhere & (a <= b)
            return is_start & (coverage(a[bad], b[bad] + 1, n) == 0)

        if n:
            before = possible(((bits & 1) > 0)[which] | (least[which] < ids[doc]))
            behind = possible(((bits & 2) > 0)[which] | (most[which] > ids[doc]))
        else:
            before = behind = is_start
        at = np.flatnonzero(before | behind)
        sums = prefix_sums(words.hash, 0), prefix_sums(words.hash2, 1)
        key = windows(sums[0], at, at + width, 0)
        more = (windows(sums[1], at, at + width, 1) >> U(32)).astype(np.uint32)
        order = np.lexsort((more, key))
        key, more, own = key[order], more[order], ids[words.doc[at]][order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])]) if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        first = np.minimum.reduceat(own, starts) if len(starts) else own
        group = np.cumsum(new) - 1
        asks = [
            (b, X.compress(pack_sorted(key[starts][s]), more[starts][s].tobytes(), _pack_ids(first[s])))
            for b, s in X.split_by_bucket(key[starts], buckets)
        ]
        # Only documents with a window that may stand before go on.
        open_ = before[at][order]
        affected = np.zeros(len(chunk), bool)
        affected[words.doc[at[order][open_]]] = True
        renumber = np.cumsum(affected) - 1
        at_doc = words.doc[at[order]][open_]
        local = chunk.part(affected)
        held = X.compact(
            local.ids, local.has_id, local.offsets, local.data,
            renumber[at_doc].astype(np.int32), (at[order][open_] - words.first[at_doc]).astype(np.int32),
            group[open_].astype(np.int32), (first[group[open_]] < own[open_]).astype(np.uint8),
        )
        rest = chunk.part(~affected)
        return pa.Table.from_batches([X.block_batch(block, asks, held if affected.any() else None, X.hold_chunk(rest) if len(rest) else None)])

    return step


def _cut(chunk: Chunk, doc: np.ndarray, position: np.ndarray, width: int) -> pa.Table:
    """Result rows after removing the windows of ``width`` words at ``position`` of ``doc``."""
    words = Words(chunk)
    at = words.first[doc] + position
    gone = coverage(at, at + width, len(words)) > 0
    kept = np.flatnonzero(~gone)
    # The kept words and one space behind each, copied in one pass; a document's last space is cut off below.
    size = (words.stop - words.start)[kept] + 1
    ends = np.cumsum(size)
    source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(words.start[kept] - (ends - size), size)
    out = chunk.data[np.minimum(source, len(chunk.data) - 1)] if len(source) else np.zeros(0, np.uint8)
    out = out.copy()
    out[ends - 1] = 32
    per_doc = np.bincount(words.doc[kept], minlength=len(chunk))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(words.doc[kept], weights=size, minlength=len(chunk)))]).astype(np.int64)
    last = np.zeros(len(out), bool)
    last[bounds[1:][per_doc > 0] - 1] = True
    bounds -= np.concatenate([[0], np.cumsum(per_doc > 0)])
    return pa.table(
        {
            "doc_id": pa.array(chunk.ids, mask=~chunk.has_id),
            "n_words": pa.array(words.count, pa.int64()),
            "n_removed": pa.array(words.count - per_doc, pa.int64()),
            "kept_text": binary_array(out[~last], bounds, pa.string()),
            "removed": marked_runs(gone, words.first),
        }
    )


def _finish(width: int):
    def step(block: int, hold: bytes, replies: list[bytes]) -> pa.Table:
        chunk, (doc, position, group, known) = X.held_chunk(hold)
        bits = X.flags(replies)
        hit = (known > 0) | (bits[group] > 0)
        return _cut(chunk, doc[hit].astype(np.int64), position[hit].astype(np.int64), width)

    return step


def _untouched(batches):
    none = np.zeros(0, np.int64)
    for batch in batches:
        for blob in batch.column(0):
            yield from _cut(X.held_chunk(blob.as_py())[0], none, none, 1).to_batches()


def remove_repeats(docs: DataFrame, width: int = 50, rounds: int = 5) -> DataFrame:
    """Remove every word covered by a ``width``-word window that also starts in a document with a smaller doc_id.

    Words are runs of characters other than white space (space and characters 9-13), compared byte for byte; windows
    never cross documents and are judged on the input. Returns one row per input row: doc_id, n_words, n_removed,
    kept_text (kept words joined by one space) and removed (maximal word ranges).

    Null or empty text: no words, empty kept_text. Text shorter than ``width``: kept. Rows with one doc_id are
    documents that do not remove each other's words; a null doc_id counts as larger than all others. Repeated text
    within one document stays unless an earlier document has it. Extra columns are ignored. An empty table gives none.

    Memory: a task holds one block of 4 MB (or one longer document), or one bucket of keys; buckets follow
    spark.sql.shuffle.partitions. Shuffled: about five bytes for each of the n * 0.75 ** rounds symbols.
    """
    spark = docs.sparkSession
    buckets = X.bucket_count(spark)
    first = X.written(X.document_columns(docs).mapInArrow(_ask_symbols(rounds, buckets), X.BLOCK_SCHEMA))
    second = X.written(X.resumed(first, X.answers(first, _stands_elsewhere), _ask_windows(rounds, width, buckets), X.BLOCK_SCHEMA))
    X.dropped(first)
    cut = X.resumed(second, X.answers(second, _verify_windows), _finish(width), RESULT)
    whole = second.where("done is not null").select("done").mapInArrow(_untouched, RESULT)
    return cut.unionByName(whole)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract view: words removed from each document and the digest of what stays."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))

