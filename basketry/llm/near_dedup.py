"""MinHash near-duplicate groups.

Each text is a set of word shingles. Its signature holds ``bands * rows`` minima of universal hashes; texts that agree
on a whole band are candidates. Equal sets become one class first, so thousands of copies count once. Within a bucket
only links to a pivot are tried, the member that shares most buckets, and connected components (alternating
large-star and small-star) settle most of the rest. Classes that share their strongest pivot but not their component
are then compared on their sets, block against block, each block giving one link per pair of components it joins; last
come buckets that still hold several components under different pivots. Every link is confirmed on the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import exchange as X
from basketry.llm.arrays import U, Chunk, Words, chunks, mix, pack_sorted, unpack_sorted

CHUNK_BYTES = 1 << 20
#: Values hashed at a time: they stay in the processor's cache.
TILE = 1 << 15
BLOCK = 512
SIGNATURE_ROWS = "doc_id bigint, n_shingles bigint, set_key binary, signature binary"


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every document of a chunk, ascending, and the documents' offsets into them.

    A shingle is ``size`` words in a row, A-Z lower-cased; fewer words make one shingle of all of them, none make none.
    """
    words = Words(chunk, lower=True)
    count = words.count
    n = len(words)
    value = mix(words.hash)
    for k in range(1, size):
        shifted = np.zeros(n, U)
        shifted[: n - k] = words.hash[k:]
        # Positions whose shingle would pass the end keep what the document still has: only a short text uses it.
        inside = np.arange(n) + k < words.first[1:][words.doc]
        value = np.where(inside, mix(value * U(0x9E3779B97F4A7C15) + shifted), value)
    position = np.arange(n) - words.first[:-1][words.doc]
    use = (position + size <= count[words.doc]) | ((position == 0) & (count[words.doc] < size))
    value, doc = value[use], words.doc[use]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]) if len(value) else np.zeros(0, bool)
    value, doc = value[new], doc[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(chunk)))]).astype(np.int64)


def set_keys(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 128-bit fingerprint of each set, as rows of two words."""
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(value * U(c)), dtype=U)]) for c in (0xD1B54A32D192ED03, 0xABC98388FB8FAC03)]
    size = np.diff(offsets).astype(U)
    return np.stack([mix(s[offsets[1:]] - s[offsets[:-1]] + size) for s in sums], axis=1)


def hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(97))
    a, b = rng.integers(0, 2**63, size=(2, count), dtype=np.uint64)
    return a * U(2) + U(1), b


def signatures(value: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """16 bits of each minimum of ``count`` universal hashes; rows of empty sets are not meaningful."""
    a, b = hash_family(count)
    docs = len(offsets) - 1
    low = np.full((docs, count), np.iinfo(np.uint64).max, U)
    at = 0
    while at < docs:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TILE, side="right")) - 1)
        filled = np.flatnonzero(np.diff(offsets[at : stop + 1])) + at
        if len(filled):
            base, end = int(offsets[at]), int(offsets[stop])
            # A set larger than a tile is cut into tiles whose minima are combined.
            for left in range(base, end, TILE):
                tile = value[left : min(left + TILE, end)]
                inside = filled[(offsets[filled + 1] > left) & (offsets[filled] < left + len(tile))]
                starts = np.maximum(offsets[inside] - left, 0)
                buffer = np.empty(len(tile), U)
                rows = slice(int(inside[0]), int(inside[-1]) + 1) if len(inside) == inside[-1] - inside[0] + 1 else inside
                for k in range(count):
                    np.multiply(tile, a[k], out=buffer)
                    buffer += b[k]
                    low[rows, k] = np.minimum(low[rows, k], np.minimum.reduceat(buffer, starts))
        at = stop
    return (mix(low) & U(0xFFFF)).astype(np.uint16)


def _sign(size: int, count: int):
    def step(batches):
        for chunk in chunks(batches, CHUNK_BYTES):
            value, offsets = shingle_sets(chunk, size)
            n = np.diff(offsets)
            keys, signs = set_keys(value, offsets), signatures(value, offsets, count)
            blank = n == 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk.ids, mask=~chunk.has_id),
                    pa.array(n),
                    pa.array([k.tobytes() for k in keys], pa.binary(), mask=blank),
                    pa.array([s.tobytes() for s in signs], pa.binary(), mask=blank),
                ],
                ["doc_id", "n_shingles", "set_key", "signature"],
            )

    return step


def _packed_sets(size: int):
    """set_key and text of every document with words; texts travel compressed."""

    def step(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for chunk in chunks(batches, CHUNK_BYTES):
            value, offsets = shingle_sets(chunk, size)
            keys = set_keys(value, offsets)
            some = np.flatnonzero(np.diff(offsets))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i].tobytes() for i in some], pa.binary()),
                    pa.array([squeeze.compress(chunk.text(i)) for i in some], pa.binary()),
                ],
                ["set_key", "packed"],
            )

    return step


def _to_sets(size: int):
    """Texts back to shingle sets, for the classes that are candidates."""

    def step(batches):
        for batch in batches:
            texts = [zstandard.ZstdDecompressor().decompress(t.as_py()) for t in batch.column(1)]
            lengths = np.array([len(t) for t in texts], np.int64)
            chunk = Chunk(np.zeros(len(texts), np.int64), np.ones(len(texts), bool), np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
            value, offsets = shingle_sets(chunk, size)
            packed = [pack_sorted(value[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "shingles"])

    return step


def _similar(threshold: float):
    """Keep pairs whose signatures agree often enough; six standard errors of slack leave true links alone."""

    def step(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (batch.column(2), batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((a == b).mean(axis=1) >= least_share(threshold, a.shape[1])))

    return step


def least_share(threshold: float, count: int) -> float:
    return threshold - 6 * math.sqrt(threshold * (1 - threshold) / count)


def _confirmed(percent: int):
    """Keep pairs with 100 * intersection >= percent * union on the full sets."""

    def step(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = unpack_sorted(x.as_py()), unpack_sorted(y.as_py())
                both = np.intersect1d(x, y, assume_unique=True).size
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return step


def _compare_sets(percent: int):
    """Links between different components among the sets of one pair of blocks; one link per pair it joins."""

    def step(group: pa.Table) -> pa.Table:
        node, comp, side = (np.asarray(group.column(c).combine_chunks()) for c in ("node", "component", "side"))
        signs = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(len(node), -1)
        packed = group.column("shingles")
        sets = [unpack_sorted(packed[i].as_py()) for i in range(len(node))]
        least = least_share(percent / 100, signs.shape[1])
        root = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        right = np.flatnonzero(side != 0)
        links = []
        for i in np.flatnonzero(side != 1):
            near = right[comp[right] != comp[i]]
            for j in near[(signs[near] == signs[i]).mean(axis=1) >= least]:
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x == y:
                    continue
                both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[max(x, y)] = min(x, y)
                    links.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return step


def _compare_signatures(threshold: float):
    """Pairs of one pair of blocks under different pivots and in different components whose signatures agree."""

    def step(group: pa.Table) -> pa.Table:
        node, comp, side, home = (np.asarray(group.column(c).combine_chunks()) for c in ("node", "component", "side", "home"))
        signs = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(len(node), -1)
        right = np.flatnonzero(side != 0)
        least = least_share(threshold, signs.shape[1])
        a, b = [], []
        for i in np.flatnonzero(side != 1):
            near = right[(comp[right] != comp[i]) & (home[right] != home[i])]
            near = near[(signs[near] == signs[i]).mean(axis=1) >= least]
            a.append(np.minimum(node[i], node[near]))
            b.append(np.maximum(node[i], node[near]))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return step


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Deal the rows of each home (with its ``size``) into blocks and meet every block with every other."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    return (
        rows.withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "home", "node", "component",
            F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )


def _across_homes(placed: DataFrame) -> DataFrame:
    """Blocks of the buckets that hold several components and several homes.

    A bucket's main home (most members) needs no comparison within itself: its members meet only the blocks of the
    other members, so a large bucket with a few strangers costs about one row per member.
    """
    main = placed.groupBy("bucket").agg(F.mode("home", True).alias("main"))
    rows = placed.join(main, "bucket").withColumn("strange", F.col("home") != F.col("main"))
    sizes = rows.groupBy("bucket").agg(
        F.sum(F.col("strange").cast("long")).alias("others"), F.count("*").alias("all"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    sizes = sizes.where("others > 0 and low < high").select(
        "bucket", F.ceil(F.col("others") / BLOCK).cast("int").alias("few"), F.ceil((F.col("all") - F.col("others")) / BLOCK).cast("int").alias("many")
    )

    def meet(left, right, side):
        return F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"), F.lit(side).cast("int").alias("side"))

    own = F.pmod(F.xxhash64("node"), F.when(F.col("strange"), F.col("few")).otherwise(F.col("many"))).cast("int")
    few, many = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("few", "many"))
    with_few = F.transform(
        few, lambda k: F.when(k == F.col("own"), meet(k, k, 2)).when(F.col("own") < k, meet(F.col("own"), k, 0)).otherwise(meet(k, F.col("own"), 1))
    )
    with_many = F.transform(many, lambda k: meet(F.col("own"), F.col("few") + k, 0))
    main_side = F.transform(few, lambda k: meet(k, F.col("few") + F.col("own"), 1))
    return (
        rows.join(sizes, "bucket")
        .withColumn("own", own)
        .withColumn("met", F.explode(F.when(F.col("strange"), F.concat(with_few, with_many)).otherwise(main_side)))
        .select("bucket", "node", "component", "home", "met.left", "met.right", "met.side")
    )


def connected(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reached) of every node of the undirected ``edges`` (a, b).

    Alternates large-star and small-star until the edges settle; every round is written to the shared folder.
    """
    edges = X.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = X.written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = state(after)
        X.dropped(edges)
        edges = after
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """Group documents whose sets of word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id of the group) and kept
    (doc_id = component_id). A pair at the threshold is missed with probability (1 - s ** rows) ** bands, 5e-7 here.

    Null text or text without words: empty set, linked with nothing, a group of its own. Fewer words than a shingle:
    the whole sequence is the one shingle. Repeated rows are one class and share a group; rows with one doc_id are
    separate documents. A null doc_id joins groups; its component_id is null if no member has an id, and it is kept
    only then. Extra columns are ignored; an empty table gives none.

    Memory: a task holds 1 MB of text, or two blocks of 512 signatures. Copies cost one row each; a bucket costs one
    row per class and only unsettled buckets are compared pair by pair, in blocks over many tasks.
    """
    spark = docs.sparkSession
    source = X.document_columns(docs)
    signed = X.written(source.mapInArrow(_sign(shingle_words, bands * rows), SIGNATURE_ROWS))
    classes = X.written(
        signed.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("smallest"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    # Buckets with two classes or more; the pivot of a bucket is the member that meets most classes over all its bands.
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    members = classes.select("node", "signature", band.alias("band")).select(
        "node", F.xxhash64(F.expr(f"substring(signature, band * {2 * rows} + 1, {2 * rows})"), "band").alias("bucket")
    )
    counts = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = X.written(members.join(counts, "bucket"))
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    pivots = members.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("pivot"))
    led = X.written(members.join(pivots, "bucket"))
    home = X.written(led.groupBy("node").agg(F.max("pivot").alias("pivot")).select("node", F.col("pivot.node").alias("home")))
    pairs = (
        led.select("node", F.col("pivot.node").alias("pivot"))
        .where("node <> pivot")
        .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        .distinct()
    )
    signs = classes.select("node", "signature")
    texts = source.mapInArrow(_packed_sets(shingle_words), "set_key binary, packed binary").groupBy("set_key").agg(F.first("packed").alias("packed"))
    keys = classes.select("node", "set_key").join(home.select("node"), "node")
    sets = X.written(texts.join(keys, "set_key").select("node", "packed").mapInArrow(_to_sets(shingle_words), "node bigint, shingles binary"))

    def agreeing(pairs: DataFrame) -> DataFrame:
        both = pairs.join(signs.withColumnsRenamed({"node": "a", "signature": "sign_a"}), "a").join(
            signs.withColumnsRenamed({"node": "b", "signature": "sign_b"}), "b"
        )
        return both.select("a", "b", "sign_a", "sign_b").mapInArrow(_similar(percent / 100), "a bigint, b bigint")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "set_a"}), "a").join(
            sets.withColumnsRenamed({"node": "b", "shingles": "set_b"}), "b"
        )
        return X.written(both.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a bigint, b bigint"))

    def with_component(rows: DataFrame) -> DataFrame:
        return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    edges = confirmed(agreeing(pairs))
    found = connected(edges)
    placed = with_component(home)
    spread = placed.groupBy("home").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    blocks = _in_blocks(placed.join(spread.where("low < high").select("home", "size"), "home")).join(signs, "node").join(sets, "node")
    more = X.written(blocks.groupBy("home", "left", "right").applyInArrow(_compare_sets(percent), "a bigint, b bigint"))
    edges = edges.unionByName(more)
    found = connected(edges)
    placed = with_component(members.select("bucket", "node").join(home, "node"))
    blocks = _across_homes(placed).join(signs, "node")
    rest = X.written(blocks.groupBy("bucket", "left", "right").applyInArrow(_compare_signatures(percent / 100), "a bigint, b bigint").distinct())
    if not rest.isEmpty():
        found = connected(edges.unionByName(confirmed(rest)))

    named = (
        classes.select("node", "set_key", "smallest")
        .join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = named.join(least, "component").select("set_key", "component_id")
    return (
        signed.select("doc_id", "n_shingles", "set_key")
        .join(named, "set_key", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.expr("doc_id <=> component_id"))
    )


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract view: two-word shingles, similarity 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2)
