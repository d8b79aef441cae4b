"""Purchase sequences, masked rows, splits, next-item scores and ranking metrics.

A customer's history is never gathered whole.  Sequences keep the newest ``max_len`` purchases, which
the planner's group limit cuts before the shuffle; fills and next-item pairs work per customer and day
and pass one row per day between days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import ranks
from basketry.operators.sales import pct
from basketry.session import materialised
from basketry.sources.tables import seeded_key

# Reserved tokens and the label of positions that are not predicted.
PAD, MASK, FIRST_ITEM, IGNORE = 0, 1, 2, -100
MASK_PROB, RANDOM_PROB, KEEP_PROB = 0.15, 0.10, 0.10
PRIME = 2_147_483_647


# --- tokens -----------------------------------------------------------------------------------------


def token_registry(
    transactions: DataFrame,
    segments: DataFrame | None = None,
    channels: bool = False,
    n_price_bins: int | None = None,
) -> DataFrame:
    """``(kind, value, key, token)``; items from 2 in id order, then SEG=, CH= and PB= prefixes."""

    def values(df: DataFrame, column: str, order: int, kind: str) -> DataFrame:
        value = F.col(column).cast("long")
        return df.select(F.lit(order).alias("o"), F.lit(kind).alias("kind"), value.alias("value")).filter(
            value.isNotNull()
        )

    parts = [values(transactions, "article_id", 0, "ITEM")]
    if segments is not None:
        parts.append(values(segments, "customer_cluster", 1, "SEG"))
    if channels:
        parts.append(values(transactions, "sales_channel_id", 2, "CH"))
    if n_price_bins:
        parts.append(values(transactions.sparkSession.range(n_price_bins), "id", 3, "PB"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    counts = every.groupBy(F.lit(0).alias("g"), F.struct("o", "value", "kind").alias("entry")).agg(
        F.least(F.count(F.lit(1)), F.lit(1)).alias("n")
    )
    numbered = ranks.running_counts(counts, ["g"], "entry", few_groups=True)
    key = F.concat(F.col("entry.kind"), F.lit("="), F.col("entry.value").cast("string"))
    return numbered.select(
        "entry.kind",
        "entry.value",
        F.when(F.col("entry.kind") == "ITEM", F.col("entry.value").cast("string")).otherwise(key).alias("key"),
        (F.col("below") + FIRST_ITEM).alias("token"),
    )


def tokens_of(registry: DataFrame, kind: str, value: str, token: str) -> DataFrame:
    """Lookup table of one kind of token."""
    return registry.filter(F.col("kind") == kind).select(F.col("value").alias(value), F.col("token").alias(token))


def decode(tokens: DataFrame, registry: DataFrame, column: str = "token") -> DataFrame:
    """Tokens back to articles; prefix and reserved tokens get null."""
    return tokens.join(tokens_of(registry, "ITEM", "article_id", column), column, "left")


# --- price bands, fills, last channel ------------------------------------------------------------------


def price_bands(df: DataFrame, n_bins: int = 10, by_distinct: bool = False, price: str = "price") -> DataFrame:
    """E5: band of every row by dense rank of its price over the number of rows.

    As published the divisor is the row count, so repeated prices crowd into the low bands;
    ``by_distinct`` divides by the number of distinct prices.  Bands rise with the price, so the lowest price of each,
    at most ``n_bins`` numbers, tells the band of every row where it is read.
    """
    size = F.col("n_distinct") if by_distinct else df.agg(F.count(price)).scalar()
    band = F.floor(F.greatest(F.least(F.col("dense_rank") / size * n_bins, F.lit(n_bins - 1.0)), F.lit(0.0)))
    starts = ranks.dense_ranks(df, price).groupBy(band.cast("int").alias("band")).agg(F.min("value").alias("start")).collect()
    x = F.col(price).cast("double")
    here = F.when(F.isnan(x), F.lit(None).cast("int"))
    for r in sorted(starts, key=lambda r: -r["band"]):
        here = here.when(x >= F.lit(r["start"]), F.lit(r["band"]))
    return df.withColumn("price_bin", here)


def fill_prices(df: DataFrame, key: str = "customer_id", day: str = "t_dat", value: str = "price") -> DataFrame:
    """Forward, then backward fill within the customer, ordered by day, article, channel and price.

    Only customers with a missing price are ordered at all.
    """
    rows = df
    # Written, so that the joins know its size.
    holes = materialised(rows.filter(F.col(value).isNull()).select(F.col(key).alias("hole")).distinct())
    mine = F.col(key).eqNullSafe(F.col("hole"))
    complete, df = rows.join(holes, mine, "left_anti"), rows.join(holes, mine, "left_semi")
    order = [F.col("article_id"), F.col("sales_channel_id"), F.col(value).asc_nulls_first()]
    known = F.col(value).isNotNull()
    position = F.struct("article_id", "sales_channel_id", value)
    days = df.groupBy(key, day).agg(
        F.max_by(value, F.when(known, position)).alias("day_last"),
        F.min_by(value, F.when(known, position)).alias("day_first"),
    )
    per_key = Window.partitionBy(key).orderBy(day)
    carried = days.select(
        key,
        day,
        F.last("day_last", True).over(per_key.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("day_first", True).over(per_key.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    same_day = Window.partitionBy(key, day).orderBy(*order)
    forward = F.last(value, True).over(same_day.rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first(value, True).over(same_day.rowsBetween(0, Window.unboundedFollowing))
    filled = df.withColumns({"f": forward, "b": backward}).join(carried, [key, day], "left")
    return complete.unionByName(filled.withColumn(value, F.coalesce("f", "before", "b", "after")).select(*rows.columns))


def customer_bands(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Integer part of the median band per customer; a customer holds at most ``n_bins`` bands."""
    banded = price_bands(df, n_bins)
    return banded.groupBy("customer_id").agg(F.floor(F.median("price_bin")).cast("int").alias("price_band"))


def last_channel(df: DataFrame) -> DataFrame:
    """Channel of the last purchase, ties by article, then channel."""
    return df.groupBy("customer_id").agg(
        F.max_by("sales_channel_id", F.struct("t_dat", "article_id", "sales_channel_id")).alias("last_channel")
    )


# --- sequences ----------------------------------------------------------------------------------------------


def deduplicate(transactions: DataFrame) -> DataFrame:
    """J2."""
    return transactions.dropDuplicates()


def prepare_sequences(
    transactions: DataFrame,
    registry: DataFrame,
    segments: DataFrame | None = None,
    channels: bool = False,
    n_price_bins: int | None = None,
    max_len: int = 100,
    min_len: int = 2,
    dedupe: bool = True,
) -> DataFrame:
    """``(customer_id, sequence, prefix_length, last_item)``.

    Prefix tokens (segment, channel, price band) come first; then the newest items that fit, in order
    of day and article.  Customers with fewer than ``min_len`` purchases are left out.
    """
    # Read once per prefix, for the counts and for the items.
    tx = materialised(deduplicate(transactions) if dedupe else transactions)
    prefixes: list[tuple[DataFrame, str, str]] = []
    if segments is not None:
        prefixes.append((segments.select("customer_id", "customer_cluster"), "customer_cluster", "SEG"))
    if channels:
        prefixes.append((last_channel(tx), "last_channel", "CH"))
    if n_price_bins:
        prefixes.append((customer_bands(fill_prices(tx), n_price_bins), "price_band", "PB"))
    room = max_len - len(prefixes)
    newest = Window.partitionBy("customer_id").orderBy(F.col("t_dat").desc(), F.col("article_id").desc())
    items = (
        tx.select("customer_id", "t_dat", "article_id")
        .withColumn("back", F.row_number().over(newest))
        .filter(F.col("back") <= room)
        .join(tokens_of(registry, "ITEM", "article_id", "token"), "article_id")
        .groupBy("customer_id")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "token"))).alias("items"))
    )
    enough = tx.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_len)
    out = items.join(enough.select("customer_id"), "customer_id", "left_semi")
    names = []
    for table, column, kind in prefixes:
        names.append(f"{kind}_token")
        tokens = tokens_of(registry, kind, column, f"{kind}_token")
        out = out.join(table.join(tokens, column).select("customer_id", f"{kind}_token"), "customer_id", "left")
    body = F.transform("items", lambda t: t["token"])
    head = F.array_compact(F.array(*[F.col(n) for n in names])) if names else F.array().cast("array<bigint>")
    return out.select(
        "customer_id",
        F.concat(head, body).alias("sequence"),
        F.size(head).alias("prefix_length"),
        F.element_at(body, -1).alias("last_item"),
    )


def _score(base: Column, position: Column, salt: int) -> Column:
    """Pseudo-random number below PRIME from a per-row base and a position; plain integer arithmetic."""
    x = (base + (position + 1) * (69_621 * (2 * salt + 1)) + salt) % PRIME
    x = (x * x + 48_271 * salt + 12_345) % PRIME
    return (x * 16_807) % PRIME


def row_base(key: Column, seed: int) -> Column:
    return F.conv(F.substring(seeded_key(key, seed), 1, 12), 16, 10).cast("long") % PRIME


def mask_sequences(
    sequences: DataFrame,
    vocab_size: int,
    seed: int = 42,
    mask_prob: float = MASK_PROB,
    random_prob: float = RANDOM_PROB,
    keep_prob: float = KEEP_PROB,
) -> DataFrame:
    """``input`` and ``labels`` beside each sequence.

    The share ``mask_prob`` of the positions after the prefix, at least one, is chosen; of those most
    become MASK, some a random token, some stay.  Other positions are labelled -100.
    """
    base = row_base(F.col("customer_id"), seed)
    rows = sequences.withColumn("base", base)
    positions = F.sequence(F.col("prefix_length"), F.size("sequence") - 1)
    order = F.array_sort(F.transform(positions, lambda i: F.struct(_score(F.col("base"), i, 1).alias("s"), i.alias("i"))))
    wanted = F.greatest(F.lit(1), F.floor((F.size("sequence") - F.col("prefix_length")) * mask_prob).cast("int"))
    rows = rows.withColumn("chosen", F.transform(F.slice(order, 1, wanted), lambda t: t["i"]))
    rows = rows.withColumn("places", F.sequence(F.lit(0), F.size("sequence") - 1))

    def replaced(token: Column, i: Column) -> Column:
        u = _score(F.col("base"), i, 2) / float(PRIME)
        other = FIRST_ITEM + _score(F.col("base"), i, 3) % (vocab_size - FIRST_ITEM)
        changed = F.when(u < 1 - random_prob - keep_prob, F.lit(MASK).cast("long")).when(u < 1 - keep_prob, other)
        return F.when(F.array_contains("chosen", i), changed.otherwise(token)).otherwise(token)

    def label(token: Column, i: Column) -> Column:
        return F.when(F.array_contains("chosen", i), token).otherwise(F.lit(IGNORE).cast("long"))

    return rows.withColumns(
        {"input": F.zip_with("sequence", "places", replaced), "labels": F.zip_with("sequence", "places", label)}
    ).drop("base", "chosen", "places")


def evaluation_rows(sequences: DataFrame) -> DataFrame:
    """Only the last position is masked and labelled."""
    n = F.size("sequence")
    ignore = F.lit(IGNORE).cast("long")
    return sequences.withColumns(
        {
            "input": F.concat(F.slice("sequence", 1, n - 1), F.array(F.lit(MASK).cast("long"))),
            "labels": F.concat(F.array_repeat(ignore, n - 1), F.array(F.element_at("sequence", -1))),
        }
    )


def pad_left(rows: DataFrame, max_len: int) -> DataFrame:
    """The newest ``max_len`` positions, padded on the left, with the attention mask."""

    def fit(column: str, filler: int) -> Column:
        n = F.size(column)
        # slice() gives nothing when its start lies before the array.
        tail = F.when(n > max_len, F.slice(column, n - max_len + 1, max_len)).otherwise(F.col(column))
        return F.concat(F.array_repeat(F.lit(filler).cast("long"), F.greatest(F.lit(max_len) - n, F.lit(0))), tail)

    n = F.least(F.size("input"), F.lit(max_len))
    return rows.withColumns(
        {
            "input_ids": fit("input", PAD),
            "label_ids": fit("labels", IGNORE),
            "attention_mask": F.concat(F.array_repeat(F.lit(0), max_len - n), F.array_repeat(F.lit(1), n)),
        }
    )


# --- splits ---------------------------------------------------------------------------------------------


def split_customers(df: DataFrame, key: str = "customer_id", validation: float = 0.1, seed: int = 42) -> DataFrame:
    """``split`` by hashed customer: no count is needed and a customer never moves."""
    u = row_base(F.col(key), seed) / float(PRIME)
    return df.withColumn("split", F.when(u < validation, "validation").otherwise("train"))


def split_by_date(transactions: DataFrame, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Train, validation and test by day."""
    ends = ranks.scalar_struct(transactions, first=F.min("t_dat"), last=F.max("t_dat"))
    days = F.datediff(ends["last"], ends["first"]) + 1
    train_days, valid_days = F.floor(days * train).cast("int"), F.floor(days * validation).cast("int")
    train_end = F.date_add(ends["first"], train_days)
    valid_end = F.date_add(train_end, valid_days)
    return transactions.withColumn(
        "split",
        F.when(F.col("t_dat") <= train_end, "train").when(F.col("t_dat") <= valid_end, "validation").otherwise("test"),
    )


def split_summary(split: DataFrame) -> DataFrame:
    """Boundaries, counts and shares per part."""
    total = split.agg(F.count(F.lit(1))).scalar()
    return (
        split.groupBy("split")
        .agg(
            F.min("t_dat").alias("first_date"),
            F.max("t_dat").alias("last_date"),
            F.count(F.lit(1)).alias("transactions"),
            F.count_distinct("customer_id").alias("customers"),
        )
        .withColumn("pct", pct(F.col("transactions"), total))
    )


# --- next item ---------------------------------------------------------------------------------------------


def next_items(transactions: DataFrame) -> DataFrame:
    """``(customer_id, item, next_item)`` of consecutive purchases by day and article.

    Pairs inside a day come from a window per customer and day; pairs across days from one row per
    customer and day.
    """
    in_day = Window.partitionBy("customer_id", "t_dat").orderBy("article_id")
    inside = transactions.select(
        "customer_id", F.col("article_id").alias("item"), F.lead("article_id").over(in_day).alias("next_item")
    ).filter(F.col("next_item").isNotNull())
    days = transactions.groupBy("customer_id", "t_dat").agg(
        F.min("article_id").alias("first"), F.max("article_id").alias("last")
    )
    by_day = Window.partitionBy("customer_id").orderBy("t_dat")
    across = days.select(
        "customer_id", F.col("last").alias("item"), F.lead("first").over(by_day).alias("next_item")
    ).filter(F.col("next_item").isNotNull())
    return inside.unionByName(across)


def transition_scores(transactions: DataFrame, k: int) -> DataFrame:
    """The ``k`` best next items per item, ``(item, candidate, score, rank)``.

    Observed followers come first, scored 1 + their share; the most popular items fill the rest,
    scored by their share of all purchases.
    """
    counts = next_items(transactions).groupBy("item", "next_item").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("item").orderBy(F.col("n").desc(), "next_item")
    totals = counts.groupBy("item").agg(F.sum("n").alias("total"))
    followers = (
        counts.withColumn("i", F.row_number().over(best))
        .filter(F.col("i") <= k)
        .join(totals, "item")
        .groupBy("item")
        .agg(
            F.collect_list(F.struct((-(1 + F.col("n") / F.col("total"))).alias("cost"), F.col("next_item").alias("candidate"))).alias("own"),
            F.collect_list("next_item").alias("followed"),
        )
    )
    popularity = transactions.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    total = transactions.agg(F.count(F.lit(1))).scalar()
    popular = (
        popularity.orderBy(F.col("n").desc(), "article_id")
        .limit(k)
        .agg(F.collect_list(F.struct((-(F.col("n") / total)).alias("cost"), F.col("article_id").alias("candidate"))).alias("l"))
    )
    # Followers score above 1 and the rest at most 1, so each item sorts its few candidates by itself; unfolded before a
    # grouping, they would fill a table of k rows per item in whatever few tasks read the items.
    items = transactions.select(F.col("article_id").alias("item")).distinct().join(followers, "item", "left")
    rest = F.filter("popular", lambda c: ~F.coalesce(F.array_contains("followed", c["candidate"]), F.lit(False)))
    ranked = (
        items.withColumn("popular", popular.scalar())
        .withColumn("own", F.coalesce("own", F.slice("popular", 1, 0)))
        .withColumn("best", F.slice(F.sort_array(F.concat("own", rest)), 1, k))
        .select("item", F.posexplode("best").alias("at", "c"))
    )
    return ranked.select("item", "c.candidate", (-F.col("c.cost")).alias("score"), (F.col("at") + 1).alias("rank"))


def leave_last_out(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows, and ``(customer_id, truth, context)``: last item and the item before it."""
    back = Window.partitionBy("customer_id").orderBy(F.col("t_dat").desc(), F.col("article_id").desc())
    last_two = (
        transactions.select("customer_id", "t_dat", "article_id")
        .withColumn("back", F.row_number().over(back))
        .filter(F.col("back") <= 2)
        .groupBy("customer_id")
        .agg(
            F.max(F.when(F.col("back") == 1, F.col("article_id"))).alias("truth"),
            F.max(F.when(F.col("back") == 2, F.col("article_id"))).alias("context"),
            F.max("t_dat").alias("truth_day"),
        )
        .filter(F.col("context").isNotNull())
    )
    # The held-out purchase and its copies on the same day leave the training rows.
    train = transactions.hint("merge").join(
        last_two.select("customer_id", F.col("truth").alias("article_id"), F.col("truth_day").alias("t_dat")),
        ["customer_id", "article_id", "t_dat"],
        "left_anti",
    )
    return train, last_two.drop("truth_day")


def top_predictions(scores: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Candidates of every case by its context item, with the correct one marked.

    Cases are few bytes in a file and many in a hash table, so they meet sorted and never pass the driver.
    """
    return cases.hint("merge").join(scores.filter(F.col("rank") <= k), F.col("context") == F.col("item")).select(
        "customer_id", "truth", "candidate", "score", "rank", (F.col("candidate") == F.col("truth")).alias("correct")
    )


def rank_top(scored: DataFrame, k: int) -> DataFrame:
    """Rank of the ``k`` best items per customer from ``(customer_id, item, score)``."""
    w = Window.partitionBy("customer_id").orderBy(F.col("score").desc(), "item")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranking_metrics(ranked: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Recall@K and NDCG@K with one relevant item; no case gives 0.

    ``ranked`` is (customer_id, item, rank), ``truth`` is (customer_id, item), which meet sorted as in ``top_predictions``.
    """
    hits = truth.hint("merge").join(ranked.select("customer_id", "item", "rank"), ["customer_id", "item"], "left")
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.when(F.col("rank") <= k, 1.0).otherwise(0.0).alias("hit"),
                F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0).alias("gain"),
            )
            for k in ks
        ]
    )
    sums = hits.select(F.explode(cells).alias("c")).groupBy("c.k").agg(
        F.count(F.lit(1)).alias("cases"), F.avg("c.hit").alias("recall"), F.avg("c.gain").alias("ndcg")
    )
    wanted = truth.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    return wanted.join(sums, "k", "left").fillna(0)


def compare_metrics(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two metric tables per K with the difference."""
    left = first.select("k", F.col("recall").alias("recall_1"), F.col("ndcg").alias("ndcg_1"))
    right = second.select("k", F.col("recall").alias("recall_2"), F.col("ndcg").alias("ndcg_2"))
    return left.join(right, "k").withColumns(
        {"recall_change": F.col("recall_2") - F.col("recall_1"), "ndcg_change": F.col("ndcg_2") - F.col("ndcg_1")}
    )


# --- descriptions -------------------------------------------------------------------------------------------


def sequence_statistics(sequences: DataFrame) -> DataFrame:
    """Lengths of the sequences and their prefixes."""
    sized = sequences.select(F.size("sequence").alias("length"), "prefix_length")
    q = ranks.quantile_struct(sized, "length", {"median": 0.5, "p95": 0.95})
    return sized.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.avg("length").alias("mean_length"),
        F.avg("prefix_length").alias("mean_prefix"),
    ).select("*", q["median"].alias("median_length"), q["p95"].alias("p95_length"))


def vocabulary_make_up(registry: DataFrame) -> DataFrame:
    """Tokens per kind."""
    return registry.groupBy("kind").agg(F.count(F.lit(1)).alias("tokens"))
