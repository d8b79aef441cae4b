"""Customer features: recency, frequency, spend, category entropies, price sensitivity, consistency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import parts
from basketry.sources.tables import require_columns

REQUIRED = {
    "customers": ["customer_id"],
    "transactions": ["t_dat", "customer_id", "article_id", "price"],
    "articles": ["article_id", "product_group_name", "colour_group_name", "garment_group_name"],
}
#: Attributes whose spread makes a customer's profile.
PROFILE_KINDS = {"group": "product_group_name", "colour": "colour_group_name", "garment": "garment_group_name"}
FEATURES = [
    "recency",
    "frequency",
    "monetary",
    "purchase_diversity_score",
    "price_sensitivity_index",
    "colour_preference_entropy",
    "style_consistency_score",
]


def attach_attributes(transactions: DataFrame, articles: DataFrame, attributes: list[str]) -> DataFrame:
    """Left lookup of article attributes; the optimizer broadcasts the articles if they are small."""
    return transactions.join(articles.select("article_id", *attributes), "article_id", "left")


def sample_customers(
    customers: DataFrame, transactions: DataFrame, n: int
) -> tuple[DataFrame, DataFrame]:
    """First ``n`` customers by id and the facts of those customers."""
    kept = customers.orderBy("customer_id").limit(n)
    return kept, transactions.join(kept.select("customer_id"), "customer_id", "left_semi")


def _last_day(transactions: DataFrame) -> Column:
    return transactions.agg(F.max("t_dat")).scalar()


def rfm(transactions: DataFrame) -> DataFrame:
    """Days since last purchase (at least 1), number of purchases, total spend."""
    reference = F.date_add(_last_day(transactions), 1)
    return (
        transactions.groupBy("customer_id")
        .agg(
            F.max("t_dat").alias("last_date"),
            F.count(F.lit(1)).alias("frequency"),
            F.sum("price").alias("monetary"),
        )
        .select(
            "customer_id",
            F.greatest(F.datediff(reference, "last_date"), F.lit(1)).cast("long").alias("recency"),
            "frequency",
            "monetary",
        )
    )


def price_sensitivity(transactions: DataFrame) -> DataFrame:
    """Sample standard deviation over mean; customers without one are left out."""
    return (
        transactions.groupBy("customer_id")
        .agg(F.try_divide(F.stddev_samp("price"), F.avg("price")).alias("price_sensitivity_index"))
        .dropna(subset=["price_sensitivity_index"])
    )


def category_counts(transactions: DataFrame, articles: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``(customer_id, kind, category, n)``: purchases per category of several attributes at once.

    ``kinds`` maps an output prefix to an attribute.  Facts shrink to (customer, article) counts
    before the lookup, so a busy customer brings each article once.  Both counts are made in as many parts as there
    are shuffle partitions: their tables hold a part, not what one reader's bytes unfold to.
    """
    n_parts = parts(transactions.sparkSession)
    facts = transactions.select("customer_id", "article_id").repartition(n_parts, "customer_id", "article_id")
    pairs = facts.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("category")) for k, c in kinds.items()]
    )
    return (
        attach_attributes(pairs, articles, list(kinds.values()))
        .drop("article_id")
        .repartition(n_parts, "customer_id")
        .select("customer_id", "n", F.explode(cells).alias("cell"))
        .filter(F.col("cell.category").isNotNull())
        .groupBy("customer_id", F.col("cell.kind").alias("kind"), F.col("cell.category").alias("category"))
        .agg(F.sum("n").alias("n"))
    )


def profile_of(counts: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Entropy (base 2) and number of categories per customer and kind, from ``category_counts``.

    With N purchases, H = log2 N - sum(n log2 n) / N.
    """

    def per_kind(kind: str) -> list[Column]:
        here = F.col("kind") == kind
        total = F.sum(F.when(here, F.col("n")))
        spread = F.sum(F.when(here, F.col("n") * F.log2("n")))
        return [
            F.abs(F.log2(total) - spread / total).alias(f"{kind}_entropy"),
            F.count(F.when(here, F.lit(1))).alias(f"{kind}_categories"),
        ]

    return counts.groupBy("customer_id").agg(*[c for k in kinds for c in per_kind(k)])


def category_profile(transactions: DataFrame, articles: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Entropy and number of categories per customer for several attributes at once."""
    return profile_of(category_counts(transactions, articles, kinds), list(kinds))


def consistency(entropy: Column, categories: Column) -> Column:
    """1 - H / log2(categories), one category counts as fully consistent, clipped to [0, 1]."""
    raw = F.when(categories == 1, F.lit(1.0)).otherwise(1 - F.try_divide(entropy, F.log2(categories)))
    return F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))


def behaviour_of(profile: DataFrame) -> DataFrame:
    """The scores of a profile over ``PROFILE_KINDS``."""
    return profile.select(
        "customer_id",
        F.col("group_entropy").alias("purchase_diversity_score"),
        F.col("colour_entropy").alias("colour_preference_entropy"),
        consistency(F.col("garment_entropy"), F.col("garment_categories")).alias("style_consistency_score"),
    )


def customer_features(
    transactions: DataFrame,
    customers: DataFrame,
    articles: DataFrame,
    created_at: str | None = None,
) -> DataFrame:
    """One row per customer; customers without purchases get the documented defaults."""
    for name, frame in (("customers", customers), ("transactions", transactions), ("articles", articles)):
        require_columns(frame, REQUIRED[name], name)
    behaviour = behaviour_of(category_profile(transactions, articles, PROFILE_KINDS))
    reference = F.date_add(_last_day(transactions), 1)
    no_purchase_recency = (F.datediff(reference, transactions.agg(F.min("t_dat")).scalar()) + 1).cast("long")
    wide = (
        customers.select("customer_id")
        .join(rfm(transactions), "customer_id", "left")
        .join(price_sensitivity(transactions), "customer_id", "left")
        .join(behaviour, "customer_id", "left")
    )
    out = wide.select(
        "customer_id",
        F.coalesce("recency", no_purchase_recency).alias("recency"),
        F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"),
        *[
            F.coalesce(c, F.lit(0.0)).alias(c)
            for c in ("monetary", "purchase_diversity_score", "price_sensitivity_index", "colour_preference_entropy")
        ],
        F.coalesce("style_consistency_score", F.lit(1.0)).alias("style_consistency_score"),
        reference.cast("string").alias("rfm_reference_date"),
    )
    if created_at is not None:
        out = out.withColumn("features_created_at", F.lit(created_at))
    return out
