"""Rule-based segments and cluster profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import ranks
from basketry.operators.sales import pct, with_cumulative, with_shares

QUINTILES = {"e1": 0.2, "e2": 0.4, "e3": 0.6, "e4": 0.8}


# --- scores and stages --------------------------------------------------------------------------


def quintile(value: Column, edges: Column) -> Column:
    """1 to 5 by right-closed intervals, so equal values always share a score."""
    out = F.when(value <= edges["e1"], 1)
    for i, e in enumerate(("e2", "e3", "e4"), start=2):
        out = out.when(value <= edges[e], i)
    return out.otherwise(5)


def rfm_scores(features: DataFrame, invert_recency: bool = False) -> DataFrame:
    """Quintile scores and their sum.

    Recency ascends with the number of days, as published; ``invert_recency`` makes 5 the most recent.
    """
    edges = ranks.quantile_map(features, ["recency", "frequency", "monetary"], QUINTILES)

    def score(column: str) -> Column:
        return quintile(F.col(column).cast("double"), edges[column])

    recency = score("recency")
    return features.select(
        "customer_id",
        (6 - recency if invert_recency else recency).alias("r_score"),
        score("frequency").alias("f_score"),
        score("monetary").alias("m_score"),
    ).withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def lifecycle_stage(recency: Column, frequency: Column) -> Column:
    """D31. Two purchases more than 90 days ago fall through to Inactive, as published."""
    return (
        F.when((recency <= 30) & (frequency >= 3), "Active High-Value")
        .when((recency <= 30) & (frequency < 3), "Active Low-Frequency")
        .when((recency > 30) & (recency <= 90) & (frequency >= 2), "At Risk")
        .when((recency > 90) & (frequency >= 3), "Dormant High-Value")
        .when(frequency == 1, "One-Time Purchaser")
        .otherwise("Inactive")
    )


def value_tier(monetary: Column, cuts: Column) -> Column:
    """D31."""
    return (
        F.when(monetary >= cuts["high"], "High Value")
        .when(monetary >= cuts["medium"], "Medium Value")
        .otherwise("Low Value")
    )


def with_stages(features: DataFrame) -> DataFrame:
    cuts = ranks.quantile_struct(features, "monetary", {"high": 0.8, "medium": 0.5})
    return features.withColumns(
        {
            "lifecycle_stage": lifecycle_stage(F.col("recency"), F.col("frequency")),
            "value_tier": value_tier(F.col("monetary"), cuts),
        }
    )


def stage_distribution(staged: DataFrame, stage: str) -> DataFrame:
    """Customers and value per stage or tier, with shares."""
    grouped = staged.groupBy(stage).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("monetary").alias("value"),
        F.avg("monetary").alias("mean_value"),
    )
    return with_shares(grouped, {"customers": "customer_pct", "value": "value_pct"})


def base_and_concentration(features: DataFrame) -> DataFrame:
    """D32."""
    high = ranks.quantile_struct(features, "monetary", {"q": 0.8})["q"]
    n, freq, money = F.count(F.lit(1)), F.col("frequency"), F.col("monetary")
    top = money >= high
    return features.agg(
        n.alias("customers"),
        F.count_if(freq > 0).alias("active"),
        F.count_if(freq > 1).alias("repeat"),
        F.count_if(freq == 1).alias("one_time"),
        pct(F.count_if(freq > 1), F.count_if(freq > 0)).alias("retention_pct"),
        F.count_if(top).alias("top_customers"),
        F.sum(F.when(top, money)).alias("top_revenue"),
        pct(F.sum(F.when(top, money)), F.sum(money)).alias("top_revenue_pct"),
        F.try_divide(F.sum(money), n).alias("mean_value"),
        F.try_divide(F.max(money), F.avg(money)).alias("max_over_mean"),
    )


# Thresholds of the level classification, (feature, above this High, above this Medium).
LEVELS = (
    ("purchase_diversity_score", 2.0, 1.0),
    ("price_sensitivity_index", 0.5, 0.2),
    ("style_consistency_score", 0.7, 0.4),
)


def behaviour_levels(features: DataFrame) -> DataFrame:
    """High, Medium or Low mean behaviour per feature."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean"), F.lit(h).alias("h"), F.lit(m).alias("m"))
            for c, h, m in LEVELS
        ]
    )
    means = features.agg(*[F.avg(c).alias(c) for c, _, _ in LEVELS]).select(F.explode(cells).alias("c"))
    level = F.when(F.col("c.mean") > F.col("c.h"), "High").when(F.col("c.mean") > F.col("c.m"), "Medium")
    return means.select("c.feature", "c.mean", level.otherwise("Low").alias("level"))


def high_value_profile(features: DataFrame, columns: Sequence[str], q: float = 0.9) -> DataFrame:
    """Mean profile of the active customers at or above the spend quantile."""
    active = features.filter(F.col("frequency") > 0)
    cut = ranks.quantile_struct(active, "monetary", {"q": q})["q"]
    return active.filter(F.col("monetary") >= cut).agg(
        F.count(F.lit(1)).alias("customers"), *[F.avg(c).alias(f"mean_{c}") for c in columns]
    )


def catalogue_diversity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct share, share of the top category, concentration level and variety rule."""
    from basketry.operators.profiling import value_counts

    per_column = value_counts(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum("n").alias("n_rows"),
        F.max("n").alias("top"),
    )
    share = pct(F.col("top"), F.col("n_rows"))
    return per_column.select(
        "column",
        "distinct_values",
        F.try_divide("distinct_values", "n_rows").alias("diversity"),
        share.alias("top_pct"),
        F.when(share > 50, "High").when(share > 25, "Medium").otherwise("Low").alias("concentration"),
        F.when(F.col("distinct_values") < 10, "expand")
        .when(F.col("distinct_values") > 100, "consolidate")
        .otherwise("keep")
        .alias("variety"),
    )


# --- cluster tables -------------------------------------------------------------------------------


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """Size, share and cumulative share per cluster, largest first; unlabelled rows are left out."""
    sizes = df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    return with_cumulative(with_shares(sizes, {"size": "pct"}), "size", "running", cluster).withColumn(
        "cumulative_pct", pct(F.col("running"), F.sum("size").over(Window.partitionBy(F.lit(1))))
    )


def balance_class(cv: Column) -> Column:
    return F.when(cv < 0.5, "Well-balanced").when(cv < 1.0, "Moderately balanced").otherwise("Imbalanced")


def cluster_balance(df: DataFrame, cluster: str) -> DataFrame:
    """Shares of the largest 3, 5 and 10 clusters, size ratio and balance class."""
    order = F.row_number().over(Window.orderBy(F.col("size").desc(), cluster))
    ranked = cluster_sizes(df, cluster).withColumn("rank", order)
    total = F.sum("size")
    cv = F.try_divide(F.stddev_samp("size"), F.avg("size"))
    return ranked.agg(
        F.count(F.lit(1)).alias("clusters"),
        total.alias("labelled"),
        *[pct(F.sum(F.when(F.col("rank") <= k, F.col("size"))), total).alias(f"top{k}_pct") for k in (3, 5, 10)],
        F.max("size").alias("largest"),
        F.min("size").alias("smallest"),
        F.try_divide(F.max("size"), F.min("size")).alias("size_ratio"),
        cv.alias("cv"),
        balance_class(cv).alias("balance"),
    )


def crosstab(df: DataFrame, cluster: str, category: str) -> DataFrame:
    """Share of each category within its cluster, long form."""
    counts = df.groupBy(cluster, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("row_pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy(cluster))))


def crosstab_wide(df: DataFrame, cluster: str, category: str, values: Sequence) -> DataFrame:
    """The same, one column per category value."""
    wide = df.groupBy(cluster).pivot(category, list(values)).count()
    total = sum((F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in values), F.lit(0))
    return wide.select(cluster, *[pct(F.coalesce(F.col(f"`{v}`"), F.lit(0)), total).alias(str(v)) for v in values])


def dominant_category(df: DataFrame, cluster: str, category: str) -> DataFrame:
    """Most frequent category per cluster, ties to the smaller value."""
    counts = df.groupBy(cluster, category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(cluster).orderBy(F.col("n").desc(), F.col(category).asc_nulls_last())
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") == 1)
    return top.select(cluster, F.col(category).alias("dominant"), F.col("n").alias("dominant_n"))


def cluster_statistics(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Count, mean, std, extremes and exact quartiles of one column per cluster."""
    moments = df.groupBy(cluster).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = ranks.quantiles(
        df.select(cluster, F.col(value).cast("double").alias("value")),
        {"q1": 0.25, "median": 0.5, "q3": 0.75},
        [cluster],
    )
    return moments.join(quartiles, cluster)


def cluster_means(df: DataFrame, cluster: str, features: Sequence[str], booleans: Sequence[str] = ()) -> DataFrame:
    """Means per cluster; boolean columns as rates in percent."""
    return df.groupBy(cluster).agg(
        *[F.avg(c).alias(c) for c in features],
        *[(F.avg(F.col(c).cast("double")) * 100).alias(f"{c}_pct") for c in booleans],
    )


def standardise_rows(means: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Z-scores of the features within each row (population std; no spread gives 0)."""
    n = len(features)
    total = sum((F.col(c) for c in features), F.lit(0.0))
    mean = total / n
    spread = F.sqrt(sum(((F.col(c) - mean) ** 2 for c in features), F.lit(0.0)) / n)
    return means.select(
        cluster, *[F.coalesce(F.try_divide(F.col(c) - mean, spread), F.lit(0.0)).alias(c) for c in features]
    )


def deviations(df: DataFrame, cluster: str, features: Sequence[str], at_least: float = 10.0) -> DataFrame:
    """Features whose cluster mean departs from the overall mean by more than ``at_least`` percent."""
    # Sums and counts per cluster carry the overall mean as well: one pass.
    parts = df.groupBy(cluster).agg(
        *[F.sum(c).alias(f"s_{c}") for c in features], *[F.count(c).alias(f"n_{c}") for c in features]
    )
    everything = Window.partitionBy(F.lit(1))
    cells = []
    for c in features:
        overall = F.try_divide(F.sum(f"s_{c}").over(everything), F.sum(f"n_{c}").over(everything))
        mean = F.try_divide(f"s_{c}", f"n_{c}")
        cells.append(
            F.struct(
                F.lit(c).alias("feature"),
                mean.alias("mean"),
                (F.try_divide(mean - overall, overall) * 100).alias("deviation_pct"),
            )
        )
    rows = parts.select(cluster, F.array(*cells).alias("cells")).select(cluster, F.explode("cells").alias("c"))
    return rows.select(cluster, "c.*").filter(F.abs("deviation_pct") > at_least)


def sub_population_insight(df: DataFrame, value: str, q: float, label: str) -> DataFrame:
    """Rows at or above a quantile: how many, their most frequent label, and its share."""
    cut = ranks.quantile_struct(df, value, {"q": q})["q"]
    counts = (
        df.filter(F.col(value) >= cut).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.agg(
        F.sum("n").alias("members"),
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("top_label"),
        pct(F.max("n"), F.sum("n")).alias("top_label_pct"),
    )


def label_overlap(df: DataFrame, left: str, right: str) -> DataFrame:
    """Rows labelled by one, the other, and both clusterings."""
    a, b = F.col(left).isNotNull(), F.col(right).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(a).alias("left_labelled"),
        F.count_if(b).alias("right_labelled"),
        F.count_if(a & b).alias("both_labelled"),
        pct(F.count_if(a & b), F.count(F.lit(1))).alias("both_pct"),
    )


def attach_labels(df: DataFrame, labels: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join label tables; entities without a label keep null."""
    for table in labels:
        df = df.join(table, key, "left")
    return df


def label_summary(df: DataFrame, label: str, noise: int = -1, by: Sequence[str] = ()) -> DataFrame:
    """Rows, clusters, noise share and share of the largest cluster among labelled rows, per group if asked."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    real = F.col(label) != noise
    return counts.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.count_if(real).alias("clusters"),
        pct(F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)), F.sum("n")).alias("noise_pct"),
        pct(F.max(F.when(real, F.col("n"))), F.sum(F.when(real, F.col("n")))).alias("largest_pct"),
    )


def first_members(df: DataFrame, cluster: str, order: Column, k: int) -> DataFrame:
    """Up to ``k`` members per cluster in the given order."""
    w = Window.partitionBy(cluster).orderBy(order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def interpret_clusters(
    df: DataFrame, cluster: str, key: str, categories: Sequence[str], n_ids: int = 20, k: int = 5
) -> DataFrame:
    """I16: size, share, first ids, and the ``k`` leading values of each category column, as text."""
    ids = (
        first_members(df.select(cluster, key), cluster, F.col(key), n_ids)
        .groupBy(cluster)
        .agg(F.array_join(F.sort_array(F.collect_list(key)).cast("array<string>"), ",").alias("first_ids"))
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categories]
    )
    counts = (
        df.select(cluster, F.explode(cells).alias("c"))
        .groupBy(cluster, "c.column", "c.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy(cluster, "column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    tops = (
        counts.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .groupBy(cluster, "column")
        .agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("rank", "value", "n"))),
                    lambda t: F.concat(t["value"], F.lit(":"), t["n"].cast("string")),
                ),
                ",",
            ).alias("top_values")
        )
    )
    sizes = with_shares(df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size")), {"size": "pct"})
    return tops.join(sizes, cluster).join(ids, cluster)


# --- customer cluster profiles and labels ----------------------------------------------------------

PROFILE_MEANS = {
    "avg_recency": "recency",
    "avg_frequency": "frequency",
    "avg_monetary": "monetary",
    "avg_diversity_score": "purchase_diversity_score",
    "avg_price_sensitivity": "price_sensitivity_index",
    "avg_colour_entropy": "colour_preference_entropy",
    "avg_style_consistency": "style_consistency_score",
}
APPROACHES = ("rfm", "preference", "behavioural", "hybrid")

# Label rules per approach, tried in order; short names are defined in ``business_label``.
LABEL_RULES: Mapping[str, Sequence[tuple[str, str]]] = {
    "rfm": (
        ("r <= 30 AND f >= 10 AND m >= 500", "Champions (High Value, High Engagement)"),
        ("r <= 30 AND f >= 5", "Loyal Customers (Recent & Frequent)"),
        ("m >= 300 AND f >= 5", "Big Spenders (High Value)"),
        ("r >= 60 AND f <= 3", "At Risk (Declining Engagement)"),
        ("r >= 70", "Lost Customers (Dormant)"),
        ("TRUE", "Developing Customers (Moderate Activity)"),
    ),
    "preference": (
        ("d >= 2.0 AND c >= 2.5 AND s <= 0.3", "Fashion Explorers (High Variety, Low Consistency)"),
        ("d >= 1.5 AND p <= 0.8 AND s >= 0.7", "Premium Style Loyalists"),
        ("p >= 1.5 AND d <= 1.0", "Value-Focused Minimalists"),
        ("c >= 3.0 AND d >= 1.2", "Colour & Style Adventurers"),
        ("s >= 0.8 AND d <= 1.5", "Consistent Style Followers"),
        ("p >= 1.2 AND c <= 2.0", "Budget-Conscious Traditionalists"),
        ("TRUE", "Moderate Preference Shoppers"),
    ),
    "hybrid": (
        ("f >= 8 AND m >= 400 AND d >= 1.5", "Premium Fashion Enthusiasts"),
        ("f >= 5 AND d >= 1.2 AND p <= 0.8", "Diverse Style Seekers"),
        ("m >= 200 AND p >= 1.2", "Budget-Conscious Shoppers"),
        ("r <= 30 AND f >= 3", "Regular Customers"),
        ("r >= 60", "Inactive Customers"),
        ("TRUE", "Casual Shoppers"),
    ),
    "behavioural": (
        ("f >= 10 AND m >= 500 AND age <= 35", "Young Fashion Leaders"),
        ("f >= 8 AND m >= 300 AND act >= 80", "Highly Engaged Customers"),
        ("age >= 50 AND m >= 200", "Mature Valuable Customers"),
        ("f <= 2 AND m <= 100", "Minimal Engagement"),
        ("TRUE", "Standard Customers"),
    ),
}
RULE_NAMES = {
    "r": "avg_recency",
    "f": "avg_frequency",
    "m": "avg_monetary",
    "d": "avg_diversity_score",
    "p": "avg_price_sensitivity",
    "c": "avg_colour_entropy",
    "s": "avg_style_consistency",
    "age": "avg_age",
    "act": "active_pct",
}


def cluster_profiles(df: DataFrame, cluster: str, approach: str) -> DataFrame:
    """Size, share and mean features per cluster; demographics for the behavioural approach."""
    means = dict(list(PROFILE_MEANS.items())[:3]) if approach == "rfm" else dict(PROFILE_MEANS)
    aggs = [F.avg(c).alias(n) for n, c in means.items()]
    if approach == "behavioural":
        aggs += [
            F.avg("age").alias("avg_age"),
            (F.avg("Active") * 100).alias("active_pct"),
            pct(F.count_if(F.col("club_member_status") == "ACTIVE"), F.count(F.lit(1))).alias("club_member_pct"),
        ]
    grouped = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *aggs)
    return with_shares(grouped, {"size": "pct"})


def business_label(profiles: DataFrame, approach: str, name: str = "business_label") -> DataFrame:
    """First matching rule of the approach."""
    if approach not in LABEL_RULES:
        raise ValueError(f"unknown approach {approach!r}: use one of {', '.join(APPROACHES)}")
    short = {s: F.col(c) for s, c in RULE_NAMES.items() if c in profiles.columns}
    cases = " ".join(f"WHEN {rule} THEN '{label}'" for rule, label in LABEL_RULES[approach])
    named = profiles.withColumns(short)
    return named.withColumn(name, F.expr(f"CASE {cases} END")).drop(*short)


def age_group(age: Column) -> Column:
    """G8."""
    out = F.when(age < 25, "Under 25")
    for limit, name in ((35, "25-34"), (45, "35-44"), (55, "45-54")):
        out = out.when(age < limit, name)
    return out.otherwise("55+")
