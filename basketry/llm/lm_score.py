"""Language-model scores by deleted interpolation.

A word's probability mixes the maximum-likelihood bigram estimate with the smoothed unigram one. The mixture weight
depends on how often the context was seen (a bucket for each power of two) and is learned by expectation-maximisation
on deleted counts: each training token is held out of the counts that predict it, so all training data serves.

Documents stay in blocks. A block asks once for the counts of its distinct words, then once for those of its distinct
bigrams; a word that occurs in one block alone needs no second question. What the weights need is a histogram by bucket
and likelihood ratio, whose size is fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import exchange as X
from basketry.llm.arrays import U, Chunk, Words, chunks, group_starts, mix, pack_planes, pack_sorted, unpack_planes, unpack_sorted

CHUNK_BYTES = 6 << 20
#: Words are hashed so many bytes at a time.
PART_BYTES = 1 << 20
END, START = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
#: First byte of a reply.
WORD, BIGRAM = 1, 2
BUCKETS = 48
#: Bins of the natural logarithm of the ratio of bigram to unigram estimate; the last bin holds ratio zero.
WIDTH, LOW, BINS = 0.02, -20.0, 3001
STATE = X.BLOCK_SCHEMA + ", cells array<int>, counts array<bigint>"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of every document, each document's followed by END, and the offsets."""
    parts, sizes, at = [], [], 0
    while at < len(chunk):
        stop = max(at + 1, int(np.searchsorted(chunk.offsets, chunk.offsets[at] + PART_BYTES, side="right")) - 1)
        part = Chunk(chunk.ids[at:stop], chunk.has_id[at:stop], chunk.data[chunk.offsets[at] : chunk.offsets[stop]], chunk.offsets[at : stop + 1] - chunk.offsets[at])
        words = Words(part, lower=True)
        parts.append(np.insert(words.hash, words.first[1:], END))
        sizes.append(words.count + 1)
        at = stop
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    starts = group_starts(values[order])
    which = np.empty(len(values), np.int64)
    which[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))
    return values[order][starts], which


def _blocks(batches):
    for block, chunk in zip(X.block_ids(), chunks(batches, CHUNK_BYTES)):  # noqa: B905
        yield X.block_batch(block, [], X.hold_chunk(chunk, chunk.flag, level=5))


def _ask_words(buckets: int):
    def step(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk, (held_out,) = X.held_chunk(blob.as_py())
                token, offsets = tokens(chunk)
                unseen = np.repeat(held_out, np.diff(offsets))
                keys, which = _distinct(token)
                total = np.bincount(which, minlength=len(keys)).astype(U)
                left_out = np.bincount(which[unseen], minlength=len(keys)).astype(U)
                asks = [(b, X.compress(pack_sorted(keys[s]), pack_planes(total[s]), pack_planes(left_out[s]))) for b, s in X.split_by_bucket(keys, buckets)]
                yield X.block_batch(block, asks)

    return step


def _count_words(asks: list[bytes]):
    """For each word twice its training count, plus one if no other block has it; the bucket's tokens and types."""
    parts = [X.decompress(blob) for blob in asks]
    keys = [unpack_sorted(p[0]) for p in parts]
    sizes = np.array([len(k) for k in keys])
    total = np.concatenate([unpack_planes(p[1]) for p in parts])
    seen = total - np.concatenate([unpack_planes(p[2]) for p in parts])
    _, which = _distinct(np.concatenate(keys))
    count = np.bincount(which, weights=seen.astype(np.float64)).astype(U)
    alone = np.bincount(which) == 1
    reply = (count * U(2) + alone.astype(U))[which]
    return [X.compress(pack_planes(r)) for r in np.split(reply, np.cumsum(sizes)[:-1])], [int(count.sum()), int((count > 0).sum())]


def _count_bigrams(asks: list[bytes]) -> list[bytes]:
    parts = [X.decompress(blob) for blob in asks]
    keys = [unpack_sorted(p[0]) for p in parts]
    sizes = np.array([len(k) for k in keys])
    _, which = _distinct(np.concatenate(keys))
    count = np.bincount(which, weights=np.concatenate([unpack_planes(p[1]) for p in parts]).astype(np.float64)).astype(U)
    return [X.compress(pack_planes(r)) for r in np.split(count[which], np.cumsum(sizes)[:-1])]


def _replies(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([unpack_planes(X.decompress(b)[0]) for b in blobs]) if blobs else np.zeros(0, U)


def _bigrams(code: np.ndarray, offsets: np.ndarray, types: int):
    """Distinct bigrams (context code or ``types`` for a document's start, word code) and the bigram of each token."""
    context = np.empty(len(code), np.int64)
    context[1:] = code[:-1]
    context[offsets[:-1]] = types
    pairs, which = _distinct(context * (types + 1) + code)
    return pairs // (types + 1), pairs % (types + 1), which


class Block:
    """A block's tokens as codes of its distinct words, its distinct bigrams, and what the word counts tell of them."""

    def __init__(self, hold: bytes, words: list[bytes]):
        self.chunk, (self.held_out,) = X.held_chunk(hold)
        token, self.offsets = tokens(self.chunk)
        self.keys, self.code = _distinct(token)
        reply = _replies(words)
        self.count, alone = reply >> U(1), (reply & U(1)) > 0
        self.context, self.word, self.which = _bigrams(self.code, self.offsets, len(self.keys))
        self.learn = np.repeat(~self.held_out, np.diff(self.offsets))
        self.own = np.bincount(self.which[self.learn], minlength=len(self.word)).astype(U)
        # A word no other block has brings no bigram that another block has.
        asked = np.flatnonzero(~(alone[self.word] | np.append(alone, False)[self.context]))
        name = mix(np.append(self.keys, START)[self.context[asked]] * U(0x9E3779B97F4A7C15) + mix(self.keys[self.word[asked]]))
        order = np.argsort(name, kind="stable")
        self.name, self.asked = name[order], asked[order]


def _ask_bigrams(buckets: int):
    def step(block: int, hold: bytes, replies: list[bytes]) -> pa.Table:
        b = Block(hold, replies)
        own = b.own[b.asked]
        asks = [(k, X.compress(pack_sorted(b.name[s]), pack_planes(own[s]))) for k, s in X.split_by_bucket(b.name, buckets)]
        return pa.Table.from_batches([X.block_batch(block, asks)])

    return step


class Estimates:
    """What a block knows of each of its distinct bigrams: both estimates, and the same with one token deleted."""

    def __init__(self, context, word, count, pair, train_tokens: int, train_types: int, train_docs: int):
        c_word = count[word].astype(np.float64)
        c_context = np.append(count.astype(np.float64), float(train_docs))[context]
        c_pair = pair.astype(np.float64)
        self.known = c_word > 0
        self.uniform = train_tokens + train_types + 1.0
        self.word = (c_word + 1) / self.uniform
        self.bigram = c_pair / np.maximum(c_context, 1)
        self.seen = c_context > 0
        self.bucket = np.minimum(np.log2(np.maximum(c_context, 1)).astype(np.int64), BUCKETS - 1)
        less = np.maximum(c_word, 1) / (self.uniform - 1)
        deleted = np.maximum(c_pair - 1, 0) / np.maximum(c_context - 1, 1)
        with np.errstate(divide="ignore"):
            bin_ = np.clip(np.floor((np.log(deleted / less) - LOW) / WIDTH), 0, BINS - 2)
        self.cell = self.bucket * BINS + np.where(deleted > 0, bin_, BINS - 1).astype(np.int64)


def _tally(totals):
    """Put each block's deleted tokens into cells, and hold the counts for scoring; the first replies are of words."""

    def step(block: int, hold: bytes, replies: list[bytes]) -> pa.Table:
        b = Block(hold, [r[1:] for r in replies if r[0] == WORD])
        counts = b.own.copy()
        counts[b.asked] = _replies([r[1:] for r in replies if r[0] == BIGRAM])
        e = Estimates(b.context, b.word, b.count, counts, *totals)
        cells = np.bincount(e.cell[b.which[b.learn]], minlength=BUCKETS * BINS)
        used = np.flatnonzero(cells)
        # Frequent words get small codes, which pack well.
        order = np.argsort(-np.bincount(b.code, minlength=len(b.keys)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[b.code]
        pairs = np.append(rank, len(rank))[b.context] * (len(rank) + 1) + rank[b.word]
        state = X.compress(
            X.compact(b.chunk.ids, b.chunk.has_id, b.held_out, b.offsets),
            *(pack_planes(x.astype(U)) for x in (code, b.count[order], counts[np.argsort(pairs)])), level=3,
        )
        batch = X.block_batch(block, [], state)
        return pa.Table.from_arrays(
            [*batch.columns, pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([cells[used]], pa.list_(pa.int64()))],
            [*batch.schema.names, "cells", "counts"],
        )

    return step


def mixture_weights(cells: dict[int, int], rounds: int = 500) -> np.ndarray:
    """Weight of the bigram estimate in each context-frequency bucket, by expectation-maximisation on deleted counts."""
    table = np.zeros(BUCKETS * BINS)
    for cell, n in cells.items():
        table[cell] = n
    table = table.reshape(BUCKETS, BINS)
    ratio = np.append(np.exp(LOW + WIDTH * (np.arange(BINS - 1) + 0.5)), 0.0)
    weight = np.full(BUCKETS, 0.5)
    total = table.sum(axis=1)
    for _ in range(rounds):
        part = weight[:, None] * ratio / (weight[:, None] * ratio + 1 - weight[:, None])
        new = np.where(total > 0, (table * part).sum(axis=1) / np.maximum(total, 1), weight)
        new = np.clip(new, 1e-9, 1 - 1e-9)
        if np.abs(new - weight).max() < 1e-9:
            break
        weight = new
    return weight


def _score(totals, weight: np.ndarray):
    def step(batches):
        for batch in batches:
            for blob in batch.column(0):
                head, *arrays = X.decompress(blob.as_py())
                ids, has_id, held_out, offsets = X.expand(head)
                code, count, pair = (unpack_planes(x) for x in arrays)
                context, word, which = _bigrams(code.astype(np.int64), offsets, len(count))
                e = Estimates(context, word, count, pair, *totals)
                share = np.where(e.seen, weight[e.bucket], 0.0)
                mixed = np.log10(share * e.bigram + (1 - share) * e.word)[which]
                base = np.log10(e.word)[which]
                known = e.known[which]
                first = offsets[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=~has_id), pa.array(held_out), pa.array(np.diff(offsets)),
                        pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(mixed, first)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return step


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn an interpolated bigram model from the rows where ``held_out`` is false and score all whole texts.

    Returns one row per input row: doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in training),
    train_tokens, base_score (add-one unigram) and score (the model's log10 probability of the text).

    Null or empty text: the end token alone. A null flag counts as not held out. Repeated rows all count. With no
    training row every token has the base probability. A null doc_id stays null; extra columns are ignored; an empty
    table gives none.

    Memory: a task holds one block of 6 MB (or one longer document) or one bucket of counts; the driver holds 48 weights
    and a histogram of fixed size.
    """
    spark = docs.sparkSession
    buckets = X.bucket_count(spark)
    flag = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), flag.alias("held_out"))
    blocks = X.written(rows.mapInArrow(_blocks, X.BLOCK_SCHEMA)).select("block", "hold")
    words = X.written(X.answers(blocks.mapInArrow(_ask_words(buckets), X.BLOCK_SCHEMA), _count_words))
    sums = words.where("tally is not null").agg(F.sum(F.col("tally")[0]), F.sum(F.col("tally")[1])).first()
    totals = (int(sums[0] or 0), int(sums[1] or 0), rows.where("not held_out").count())
    pairs = X.answers(X.resumed(blocks, words, _ask_bigrams(buckets), X.BLOCK_SCHEMA), _count_bigrams)

    def marked(replies: DataFrame, kind: int) -> DataFrame:
        """Replies behind their kind; those of bigrams get the later bucket numbers."""
        bucket = (F.col("bucket") + (kind - WORD) * buckets).alias("bucket")
        return replies.select("block", bucket, F.concat(F.lit(bytes([kind])), "answer").alias("answer"))

    both = marked(words, WORD).unionByName(marked(pairs, BIGRAM))
    third = X.written(X.resumed(blocks, both, _tally(totals), STATE))
    X.dropped(blocks)
    X.dropped(words)
    cells = third.select(F.explode(F.arrays_zip("cells", "counts")).alias("c")).groupBy("c.cells").agg(F.sum("c.counts").alias("n"))
    weight = mixture_weights({r.cells: r.n for r in cells.collect()})
    scored = third.where("hold is not null").select("hold").mapInArrow(_score(totals, weight), SCORES)
    return scored.withColumn("train_tokens", F.lit(totals[0]).cast("bigint"))


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    """Contract view: learns where crc32(doc_id) mod 7 is not 2, scores everything."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    out = score_documents(docs, held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
