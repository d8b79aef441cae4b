"""Exchange of keys between blocks of documents and the tasks that own the keys.

A block is a few MB of documents. It asks for facts about its keys (counts, or whether a key stands elsewhere)
with one packed request per bucket; the task that owns a bucket answers every block in the order of its keys.
Each block holds a key once, so a key that occurs in a third of all rows costs one entry per block, and keys are
spread by hash, so no key or document group gathers anywhere. All of it is written through ordinary shuffles;
tables between rounds lie in the shared checkpoint folder, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.arrays import Chunk, pack_planes, pack_sorted, unpack_planes, unpack_sorted
from basketry.session import materialised

#: A row is a request ("ask": packed keys for a bucket), what the block needs to go on ("hold"), or finished ("done").
BLOCK_SCHEMA = "block bigint, bucket int, ask binary, hold binary, done binary"
#: The tallies of a bucket stand in one of its rows.
ANSWER_SCHEMA = "block bigint, bucket int, answer binary, tally array<bigint>"
_arrow_block = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("ask", "hold", "done")]])


def document_columns(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and named others) alone, so extra columns never clash or travel."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), *more)


def bucket_count(spark: SparkSession) -> int:
    """Buckets follow the number of shuffle partitions, so a bucket's share of the keys stays alike at any size."""
    return 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key by range of the leading bits: sorted keys fall into ascending buckets."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def compress(*parts: bytes, level: int = 1) -> bytes:
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(parts))


def decompress(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    ends = 8 + 8 * n + np.cumsum(sizes)
    return [raw[e - s : e] for s, e in zip(sizes, ends, strict=True)]


def compact(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed binary."""
    return compress(*[a.dtype.str.encode().ljust(8) + np.ascontiguousarray(a).tobytes() for a in arrays], level=level)


def expand(blob: bytes) -> list[np.ndarray]:
    return [np.frombuffer(p, np.dtype(p[:8].strip().decode()), offset=8) for p in decompress(blob)]


def block_batch(block: int, asks: Iterable[tuple[int, bytes]], hold: bytes | None = None, done: bytes | None = None) -> pa.RecordBatch:
    """One block's requests, what it holds, and what needs no further round."""
    rows = [(b, a, None, None) for b, a in asks]
    rows += [(None, None, hold, None)] * (hold is not None) + [(None, None, None, done)] * (done is not None)
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip([[block] * len(rows), *columns], _arrow_block, strict=True)], schema=_arrow_block
    )


def hold_chunk(chunk: Chunk, *more: np.ndarray, level: int = 1) -> bytes:
    return compact(chunk.ids, chunk.has_id, chunk.offsets, chunk.data, *more, level=level)


def held_chunk(blob: bytes) -> tuple[Chunk, list[np.ndarray]]:
    ids, has_id, offsets, data, *more = expand(blob)
    return Chunk(ids, has_id, data, offsets), more


def flags(replies: list[bytes]) -> np.ndarray:
    """Replies of one byte per key, in the order of the block's keys."""
    return np.concatenate([np.frombuffer(decompress(r)[0], np.uint8) for r in replies]) if replies else np.zeros(0, np.uint8)


def pair_asks(keys: np.ndarray, more: np.ndarray, least: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Requests of distinct 96-bit fingerprints, sorted by ``keys``, with the least document id the block has for each."""
    out = []
    for b, s in split_by_bucket(keys, buckets):
        # Ids of one block lie close together, so their distances from the least take few bytes.
        ids = least[s].view(np.uint64)
        base = least[s].min(keepdims=True)
        out.append((b, compress(pack_sorted(keys[s]), more[s].tobytes(), base.tobytes(), pack_planes(ids - base.view(np.uint64)))))
    return out


def in_other_blocks(asks: list[bytes]) -> list[bytes]:
    """For each 96-bit fingerprint, bit 0: another block holds it too; bit 1: another block has it under a smaller document id."""
    parts = [decompress(blob) for blob in asks]
    keys = [unpack_sorted(p[0]) for p in parts]
    sizes = np.array([len(k) for k in keys])
    keys, more = np.concatenate(keys), np.concatenate([np.frombuffer(p[1], np.uint32) for p in parts])
    least = np.concatenate([(unpack_planes(p[3]) + np.frombuffer(p[2], np.uint64)).view(np.int64) for p in parts])
    order = np.lexsort((more, keys))
    new = np.concatenate([[True], (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])])
    starts = np.flatnonzero(new)
    counts = np.diff(np.concatenate([starts, [len(keys)]]))
    bits = np.empty(len(keys), np.uint8)
    bits[order] = np.repeat(counts > 1, counts) + 2 * (np.repeat(np.minimum.reduceat(least[order], starts), counts) < least[order])
    return [compress(b.tobytes()) for b in np.split(bits, np.cumsum(sizes)[:-1])]


def split_by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """Slices of sorted ``keys`` by bucket, without the empty ones."""
    if not len(keys):
        return []
    which = buckets_of(keys, buckets)
    starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    stops = np.concatenate([starts[1:], [len(keys)]])
    return [(int(which[a]), slice(int(a), int(b))) for a, b in zip(starts, stops, strict=True)]


def block_ids() -> Iterator[int]:
    """Ids unique among the tasks of one job."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def written(frame: DataFrame) -> DataFrame:
    return materialised(frame)


def dropped(frame: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more, and let Spark drop the shuffles behind it."""
    spark = frame.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    # Shuffle files go when the driver collects what made them.
    gc.collect()
    spark._jvm.System.gc()


def answers(table: DataFrame, answer: Callable) -> DataFrame:
    """Let each bucket's owner answer: ``answer`` gets the blocks' packed requests and returns one reply for each, and
    may return a list of tallies of its bucket besides."""

    def own(group: pa.Table) -> pa.Table:
        replies = answer(group.column("ask").to_pylist())
        replies, tally = replies if isinstance(replies, tuple) else (replies, None)
        return pa.table(
            {
                "block": group.column("block"),
                "bucket": group.column("bucket").cast(pa.int32()),
                "answer": pa.array(replies, pa.binary()),
                "tally": pa.array([tally] + [None] * (len(replies) - 1), pa.list_(pa.int64())),
            }
        )

    return table.where("ask is not null").select("block", "bucket", "ask").groupBy("bucket").applyInArrow(own, ANSWER_SCHEMA)


def resumed(table: DataFrame, replies: DataFrame, go_on: Callable, schema: str | T.StructType) -> DataFrame:
    """Hand every block what it holds and its replies in the order of its buckets.

    ``go_on(block, hold, replies)`` yields Arrow tables. A block without requests gets no reply and still goes on.
    """

    def step(key, held: pa.Table, answered: pa.Table):
        order = np.argsort(np.asarray(answered.column("bucket").fill_null(0)), kind="stable") if answered.num_rows else []
        column = answered.column("answer")
        blobs = [column[int(i)].as_py() for i in order]
        block = key[0].as_py()
        parts = [go_on(block, row.as_py(), blobs) for row in held.column("hold")]
        return pa.concat_tables(parts) if len(parts) > 1 else parts[0]

    held = table.where("hold is not null").select("block", "hold")
    replies = replies.select("block", "bucket", "answer")
    return held.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(step, schema)
