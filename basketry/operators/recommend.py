"""Market baskets and collaborative filtering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import ensure_checkpoint_dir, materialised, parts

#: Users of a block, at most, and users whose products with a block of items are made at a time.
USERS, STRIP = 65_536, 256
#: Purchases of a block in the factorisation, about; blocks at least.
PURCHASES, BLOCKS = 1 << 21, 10


def baskets(rows: DataFrame, by: Sequence[str | Column], item: str) -> DataFrame:
    """``(items)``: the distinct items of each basket, a basket being the rows equal in ``by``; null items drop out.

    Equal (basket, item) rows are merged before the shuffle.
    """
    named = rows.select(*[(F.col(b) if isinstance(b, str) else b).alias(f"b{i}") for i, b in enumerate(by)], F.col(item).cast("string").alias("item"))
    keys = [f"b{i}" for i in range(len(by))]
    distinct = named.filter(F.col("item").isNotNull()).distinct()
    return distinct.groupBy(*keys).agg(F.collect_list("item").alias("items"))


def frequent_items(baskets: DataFrame, least_count: int) -> tuple[DataFrame, DataFrame]:
    """Frequent item sets ``(items, n)`` and rules ``(antecedent, consequent, n, support, confidence, lift)``.

    Every set in at least ``least_count`` baskets is found.  Mining goes by conditional trees: each group of items gets the
    baskets cut to what can precede its items, so no task sees all of a frequent item's baskets whole.  Rules
    have one consequent and come from the counts of the sets.
    """
    kept = materialised(baskets.select("items"))
    total = kept.count()
    # Half a basket less, so that the share never rounds above the wanted count.
    least = max((least_count - 0.5) / max(total, 1), 0.0)
    found = FPGrowth(itemsCol="items", minSupport=min(least, 1.0)).fit(kept).freqItemsets
    sets = materialised(found.select(F.sort_array("items").alias("items"), F.col("freq").alias("n")))
    split = sets.filter(F.size("items") > 1).select("items", "n", F.explode("items").alias("consequent"))
    split = split.withColumn("antecedent", F.array_except("items", F.array("consequent")))
    before = sets.select(F.col("items").alias("antecedent"), F.col("n").alias("n_before"))
    after = sets.filter(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("n").alias("n_after"))
    confidence = F.col("n") / F.col("n_before")
    rules = split.join(before, "antecedent").join(after, "consequent").select(
        "antecedent",
        "consequent",
        "n",
        (F.col("n") / F.lit(total)).alias("support"),
        confidence.alias("confidence"),
        (confidence / (F.col("n_after") / F.lit(total))).alias("lift"),
    )
    return sets, rules


def factorise(counts: DataFrame, user: str, item: str, n: str = "n", rank: int = 10, rounds: int = 10, weight: float = 40.0, regular: float = 0.1, seed: int = 42) -> ALSModel:
    """Alternating least squares on purchase counts, taken as confidence ``1 + weight n`` in a preference.

    Both ids must be whole numbers in the integer range.  A task holds the purchases of one block and the factors they need,
    so blocks grow in number, not in size.  Every round is written out, so that its shuffle of item factors can go.
    """
    blocks = max(BLOCKS, -(-counts.count() // PURCHASES))
    ensure_checkpoint_dir(counts.sparkSession)
    als = ALS(
        rank=rank, maxIter=rounds, regParam=regular, alpha=weight, implicitPrefs=True, seed=seed, userCol=user, itemCol=item, ratingCol=n,
        numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=1,
    )
    return als.fit(counts.select(F.col(user).cast("int").alias(user), F.col(item).cast("int").alias(item), F.col(n).cast("float").alias(n)))


def recommendations(model: ALSModel, k: int, user: str, item: str) -> DataFrame:
    """``(user, rank, item, score)``: the k best items of every user, ties by item.

    Blocks of users read all blocks of items, longest factors first, some users at a time. No product exceeds the
    lengths of its factors, so a user leaves when the items to come are too short to be among its best.
    """
    spark = model.userFactors.sparkSession
    n_users = model.userFactors.count()
    n_blocks = max(-(-n_users // USERS), min(32, -(-n_users // 1024)), 1)

    def flat(rows: pa.Table | pa.RecordBatch) -> bytes:
        return np.asarray(rows.column("features").to_pylist(), np.float32).tobytes()

    def users(rows: pa.Table) -> pa.Table:
        ids = np.asarray(rows.column("id").to_numpy(), np.int64).tobytes()
        return pa.table({"block": rows.column("block").slice(0, 1), "place": pa.array([-1]), "ids": pa.array([ids], pa.binary()), "vectors": pa.array([flat(rows)], pa.binary())})

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                ids, longest = np.asarray(rows.column("id").to_numpy(), np.int64), max(rows.column("length").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([-longest]), pa.array([ids.tobytes()], pa.binary()), pa.array([flat(rows)], pa.binary())], ["longest", "ids", "vectors"])

    fields = "ids binary, vectors binary"
    dealt = model.userFactors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    asked = materialised(dealt.groupBy("block").applyInArrow(users, f"block bigint, place bigint, {fields}"))
    squares = F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ranged = model.itemFactors.withColumn("length", F.sqrt(squares)).repartitionByRange(F.col("length").desc())
    offered = materialised(ranged.sortWithinPartitions(F.col("length").desc()).mapInArrow(items, f"longest double, {fields}"))
    met = asked.select("block").crossJoin(offered).unionByName(asked.select("block", F.lit(float("-inf")).alias("longest"), "ids", "vectors"))
    rank = model.rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
                vectors = np.frombuffer(batch.column("vectors")[i].as_buffer(), np.float32).reshape(-1, rank)
                if batch.column("block")[i].as_py() != block:
                    if best:
                        yield from best.rows()
                    # The users of a block come before any item.
                    block, best = batch.column("block")[i].as_py(), _Best(ids.copy(), vectors.copy(), k)
                else:
                    best.offer(ids, vectors, -batch.column("longest")[i].as_py())
        if best:
            yield from best.rows()

    ordered = met.repartition(parts(spark), "block").sortWithinPartitions("block", "longest")
    found = ordered.mapInArrow(run, "user bigint, rank int, item bigint, score double")
    return found.select(F.col("user").cast("int").alias(user), "rank", F.col("item").cast("int").alias(item), "score")


class _Best:
    """The best items so far of a block of users."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        # A little more than the length, for what single precision rounds.
        self.length = np.linalg.norm(vectors.astype(float), axis=1) * (1 + 1e-5)
        self.score = np.full((len(ids), k), -np.inf, np.float32)
        self.item = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, vectors: np.ndarray, longest: float) -> None:
        """Items of at most this length, longer ones first."""
        open_ = np.flatnonzero(self.length * longest + 1e-12 >= self.score[:, -1])
        for at in range(0, len(open_), STRIP):
            rows = open_[at : at + STRIP]
            products = self.vectors[rows] @ vectors.T
            least = self.score[rows, -1]
            if len(ids) > self.k:
                # What a row's k-th best product leaves behind cannot stay; needed once, while the list fills.
                unfilled = np.flatnonzero(least == -np.inf)
                if len(unfilled):
                    least[unfilled] = np.partition(products[unfilled], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            row, column = np.nonzero(products >= least[:, None])
            touched = np.unique(row)
            if not len(touched):
                continue
            score = np.concatenate([self.score[rows[touched]].ravel(), products[row, column]])
            item = np.concatenate([self.item[rows[touched]].ravel(), ids[column]])
            owner = np.concatenate([np.repeat(np.arange(len(touched)), self.k), np.searchsorted(touched, row)])
            order = np.lexsort((item, -score, owner))
            place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            order, place = order[place < self.k], place[place < self.k]
            self.score[rows[touched][owner[order]], place] = score[order]
            self.item[rows[touched][owner[order]], place] = item[order]

    def rows(self) -> Iterator[pa.RecordBatch]:
        row, place = np.nonzero(self.score > -np.inf)
        columns = [self.ids[row], (place + 1).astype(np.int32), self.item[row, place], self.score[row, place].astype(float)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["user", "rank", "item", "score"])


def scored(model: ALSModel, pairs: DataFrame, user: str, item: str) -> DataFrame:
    """``pairs`` with the product of their factors as ``score``; pairs without factors drop out."""
    users = model.userFactors.select(F.col("id").alias(user), F.col("features").alias("uf"))
    items = model.itemFactors.select(F.col("id").alias(item), F.col("features").alias("if"))
    product = F.aggregate(F.zip_with("uf", "if", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(users, user).join(items, item).withColumn("score", product).drop("uf", "if")


def reconstruction(model: ALSModel, counts: DataFrame, user: str, item: str, n: str = "n", weight: float = 40.0) -> DataFrame:
    """One row: bought pairs, their mean score, the mean score over all pairs, and the weighted squared error over all pairs.

    Sums over all pairs need no pairs: they follow from the Gram matrices and sums of the factors.
    """

    def gram(factors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
        d = model.rank
        cells = [F.sum(F.col("features")[i].cast("double") * F.col("features")[j].cast("double")) for i in range(d) for j in range(d)]
        sums = [F.sum(F.col("features")[i].cast("double")) for i in range(d)]
        row = factors.agg(F.count(F.lit(1)), *sums, *cells).first()
        return np.array(row[1 + d :], float).reshape(d, d), np.array(row[1 : d + 1], float), row[0]

    (gu, su, nu), (gi, si, ni) = gram(model.userFactors), gram(model.itemFactors)
    all_squares, all_sum = float((gu * gi).sum()), float(su @ si)
    confidence = 1 + weight * F.col(n)
    bought = scored(model, counts, user, item)
    gap = (1 - F.col("score")) * (1 - F.col("score"))
    return bought.agg(
        F.count(F.lit(1)).alias("bought"),
        F.avg("score").alias("bought_score"),
        F.lit(all_sum / (nu * ni)).alias("mean_score"),
        (F.sum(confidence * gap) + all_squares - F.sum(F.col("score") * F.col("score"))).alias("squared_error"),
    )
