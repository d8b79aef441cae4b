"""Benchmark decontamination by spaced-seed hashing.

A seed looks at five of eight consecutive words; the masks differ in the three positions they ignore, so a changed
word leaves some mask untouched. Hashes of the benchmark's seeds are joined with those of the documents; each hit
fixes an alignment of a document with an item, and the aligned words around it are compared: the document is
contaminated if, in some window of the item's words, 80 % stand at the same places in the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm import exchange as X
from basketry.llm.arrays import U, Chunk, Words, mix, text_bytes

CHUNK_BYTES = 2 << 20
#: Offsets of the five words a seed looks at. Any three changed words of a window of 15 leave some seed untouched.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 7), (0, 1, 3, 4, 7))
#: Benchmark words in one index (about 100 bytes each).
PART_WORDS = 1 << 20


class Index:
    """Words of the benchmark items and their seeds, sorted by hash."""

    def __init__(self, items: Chunk, least: int, share: float):
        words = Words(items, lower=True)
        self.ids, self.first, self.count, self.hash = items.ids, words.first, words.count, words.hash
        self.has_id = items.has_id
        self.least, self.share = least, share
        seed, at = seeds(words)
        order = np.argsort(seed, kind="stable")
        self.seed, self.at, self.item = seed[order], at[order], words.doc[at[order]]
        # A bit per hash prefix sorts out nearly all document seeds before the search.
        self.bits = max(16, int(8 * max(len(seed), 1) - 1).bit_length())
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.seed >> U(64 - self.bits)).astype(np.int64)] = True


def seeds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every seed."""
    n = len(words)
    end = words.first[1:][words.doc] if n else np.zeros(0, np.int64)
    at = np.arange(n)
    found, places = [], []
    for m, mask in enumerate(MASKS):
        fits = at + mask[-1] < end
        value = np.full(n, (m + 1) * 0x9E3779B97F4A7C15 % 2**64, U)
        for k in mask:
            shifted = np.zeros(n, U)
            shifted[: max(n - k, 0)] = words.hash[k:]
            value = value * U(0xD1342543DE82EF95) + shifted
        found.append(mix(value)[fits])
        places.append(at[fits])
    return np.concatenate(found), np.concatenate(places)


def _aligned(index: Index, words: Words, doc: np.ndarray, item: np.ndarray, shift: np.ndarray):
    """Best window of each alignment (document, item, shift of the item's first word against the document's).

    Yields the alignments that reach the share: positions in the inputs, matched and compared words, word range.
    """
    for i in range(len(doc)):
        d, t, s = int(doc[i]), int(item[i]), int(shift[i])
        n, m = int(words.count[d]), int(index.count[t])
        low, high = max(0, -s), min(m, n - s)
        width = min(m, index.least)
        if high - low < width or width == 0:
            continue
        a = words.hash[words.first[d] + s + low : words.first[d] + s + high]
        same = a == index.hash[index.first[t] + low : index.first[t] + high]
        sums = np.concatenate([[0], np.cumsum(same)])
        inside = sums[width:] - sums[:-width]
        good = np.flatnonzero(inside >= index.share * width)
        if len(good):
            best = int(inside.max())
            yield i, best, width, s + low + int(good[0]), s + low + int(good[-1]) + width


def find(index: Index, chunk: Chunk):
    """Verified overlaps of a chunk: document, item, matched, compared, start, stop (words)."""
    words = Words(chunk, lower=True)
    seed, at = seeds(words)
    use = index.maybe[(seed >> U(64 - index.bits)).astype(np.int64)] if len(seed) else np.zeros(0, bool)
    seed, at = seed[use], at[use]
    low, high = np.searchsorted(index.seed, seed, "left"), np.searchsorted(index.seed, seed, "right")
    size = high - low
    ends = np.cumsum(size)
    entry = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - size), size)
    at = np.repeat(at, size)
    item = index.item[entry]
    shift = (at - words.first[words.doc[at]]) - (index.at[entry] - index.first[item])
    alignments = np.unique(np.stack([words.doc[at], item, shift], axis=1), axis=0) if len(at) else np.zeros((0, 3), np.int64)
    doc, item, shift = alignments.T
    rows = [(int(doc[i]), int(item[i]), best, width, start, stop) for i, best, width, start, stop in _aligned(index, words, doc, item, shift)]
    return words, rows


def _search(index: Index):
    """Add what a chunk shares with ``index`` to the findings so far."""

    def step(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0).field("text"))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
                n = stop - at
                part = batch.slice(at, n)
                chunk = Chunk(np.zeros(n, np.int64), np.ones(n, bool), data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
                yield pa.RecordBatch.from_arrays([part.column(0), *_findings(index, chunk, part)], batch.schema.names)
                at = stop

    return step


def _findings(index: Index, chunk: Chunk, before: pa.RecordBatch) -> list[pa.Array]:
    words, rows = find(index, chunk)
    count = pa.array(words.count, pa.int64())
    if not rows:
        return [count, *before.columns[2:]]
    items, best, spans = (before.column(i).to_pylist() for i in (2, 3, 4))
    for doc, item, matched, compared, start, stop in rows:
        items[doc] = sorted({*items[doc], int(index.ids[item])})
        best[doc] = max(best[doc], matched / compared)
        spans[doc] = merged([*spans[doc], {"start": start, "stop": stop}])
    return [count, pa.array(items, before.column(2).type), pa.array(best), pa.array(spans, before.column(4).type)]


def merged(spans: list[dict]) -> list[dict]:
    """Spans joined where they touch or overlap."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], s["stop"])):
        if out and s["start"] <= out[-1]["stop"]:
            out[-1] = {"start": out[-1]["start"], "stop": max(out[-1]["stop"], s["stop"])}
        else:
            out.append(dict(s))
    return out


def indexes(benchmark: DataFrame, window: int, share: float, words: int = PART_WORDS):
    """The benchmark as indexes of bounded size, so a task never holds more than one part of it."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    for item, text in rows.toLocalIterator():
        ids.append(item)
        texts.append(text)
        held += len(text.split())
        if held >= words:
            yield _index(ids, texts, window, share)
            ids, texts, held = [], [], 0
    if ids:
        yield _index(ids, texts, window, share)


def _index(ids: list[int], texts: list[str], window: int, share: float) -> Index:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    return Index(Chunk(np.array(ids, np.int64), np.ones(len(ids), bool), data, offsets), window, share)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 15, share: float = 0.8, part_words: int = PART_WORDS) -> DataFrame:
    """Find documents that hold passages of ``benchmark`` (item_id, text), with words changed here and there.

    A document is contaminated by an item if ``share`` of some ``window`` consecutive words of the item (of all its
    words, if it has fewer) stand in the document at the same distances. Words are compared with A-Z lower-cased.
    Returns one row per input row: row (all its columns), n_words, item_ids (ascending), best_share and overlaps
    (word ranges, merged). With 15 words and up to three of them changed some mask always hits.

    Null or empty text: no words, no items. Items that are null or have fewer than five words are no evidence and are
    ignored; items of five to seven words are found unless their only five-word seeds are broken. Repeated rows get
    equal findings. Columns of any name are kept inside ``row``. An empty benchmark finds nothing.

    The benchmark is read in parts of ``part_words`` words, a stated set that every document is held against; each
    part is one step over the documents, and every fourth step is written to the shared folder.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = rows.selectExpr("row", "0L AS n_words", "cast(array() AS array<bigint>) AS item_ids", "0D AS best_share", "cast(array() AS array<struct<start:bigint,stop:bigint>>) AS overlaps")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in found.schema.fields])
    none = _index([], [], window, share)
    found = found.mapInArrow(_search(none), schema) if benchmark.isEmpty() else found
    for i, index in enumerate(indexes(benchmark, window, share, part_words)):
        if i and i % 4 == 0:
            found = X.written(found)
        found = found.mapInArrow(_search(index), schema)
    return found


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "row.doc_id", "n_words", F.expr("size(item_ids) > 0").alias("contaminated"), "item_ids", "best_share", "overlaps"
    )
