"""Behaviour of customers over time, baskets and channels.

Facts are first summed per customer and day (and channel, or article), so what later steps order or group has at most one
row per customer and day, however busy the customer or the day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import ranks
from basketry.operators.features import attach_attributes
from basketry.session import materialised

# Observation periods in days.
HORIZONS = (7, 30, 90, 365)
#: A calendar month, for rates.
MONTH_DAYS = 30.4375


def day_histogram(transactions: DataFrame) -> DataFrame:
    """``(customer_id, t_dat, n, priced, spend, squares)``: one row per customer and day."""
    price = F.col("price")
    return transactions.groupBy("customer_id", "t_dat").agg(
        F.count(F.lit(1)).alias("n"), F.count(price).alias("priced"), F.sum(price).alias("spend"), F.sum(price * price).alias("squares")
    )


def _deviation(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from sums; null below two values."""
    spread = F.greatest(squares - total * total / n, F.lit(0.0))
    return F.when(n > 1, F.sqrt(spread / F.nullif(n - 1, F.lit(0))))


def horizon_features(transactions: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Per customer and horizon of the last ``w`` days up to the newest day: ``frequency_<w>d`` (purchases),
    ``basket_size_<w>d`` (purchases per shopping day) and ``sensitivity_<w>d`` (standard deviation of the price over its mean).

    The facts are read once, into a day histogram; all horizons come from one aggregation of it.  A customer
    without purchases in a horizon has frequency 0 and no other value.
    """
    days = materialised(day_histogram(transactions))
    age = F.datediff(days.agg(F.max("t_dat")).scalar(), F.col("t_dat"))
    inside = days.withColumn("age", age)
    out = []
    for w in horizons:
        here = F.col("age") < w
        n, total, squares = (F.sum(F.when(here, F.col(c))) for c in ("priced", "spend", "squares"))
        purchases = F.sum(F.when(here, F.col("n")))
        out += [
            F.coalesce(purchases, F.lit(0)).alias(f"frequency_{w}d"),
            F.try_divide(purchases, F.count_if(here)).alias(f"basket_size_{w}d"),
            F.try_divide(_deviation(n, total, squares), total / n).alias(f"sensitivity_{w}d"),
        ]
    return inside.groupBy("customer_id").agg(*out)


def percent_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``(value, name)``: share of the other rows that have a smaller value; 0 for a single row.  No row is sorted with
    all others: ranks come from counts per value, cut into ranges."""
    counts = df.groupBy(F.lit(0).alias("all"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = ranks.running_counts(counts, ["all"])
    share = F.coalesce(F.try_divide(F.col("below"), F.col("total") - 1), F.lit(0.0))
    return placed.select(F.col("value").alias(value), share.cast("double").alias(name))


def activity_features(transactions: DataFrame) -> DataFrame:
    """P5 per customer: ``recency`` in days (at least 1) and its ``recency_percentile``; ``per_month`` (purchases per month
    of the lifespan, at least one month); mean and sample deviation of the gaps between shopping days (``gap_mean``,
    ``gap_std``); ``spend_volatility`` (deviation of the price); ``late_share`` (purchases in the later half of the lifespan)."""
    days = materialised(day_histogram(transactions))
    reference = F.date_add(days.agg(F.max("t_dat")).scalar(), 1)
    order = Window.partitionBy("customer_id").orderBy("t_dat")
    whole = Window.partitionBy("customer_id")
    gaps = days.withColumns(
        {
            "gap": F.datediff("t_dat", F.lag("t_dat").over(order)),
            "first": F.min("t_dat").over(whole),
            "last": F.max("t_dat").over(whole),
        }
    )
    late = 2 * F.datediff("t_dat", "first") > F.datediff("last", "first")
    per = gaps.groupBy("customer_id").agg(
        F.max("last").alias("last"),
        F.max("first").alias("first"),
        F.sum("n").alias("frequency"),
        F.avg("gap").alias("gap_mean"),
        F.stddev_samp("gap").alias("gap_std"),
        _deviation(F.sum("priced"), F.sum("spend"), F.sum("squares")).alias("spend_volatility"),
        (F.coalesce(F.sum(F.when(late, F.col("n"))), F.lit(0)) / F.sum("n")).alias("late_share"),
    )
    per = per.withColumn("recency", F.greatest(F.datediff(reference, "last"), F.lit(1)))
    months = F.greatest((F.datediff("last", "first") + 1) / F.lit(MONTH_DAYS), F.lit(1.0))
    per = materialised(per.withColumn("per_month", F.col("frequency") / months))
    return per.join(percent_rank(per, "recency", "recency_percentile"), "recency").select(
        "customer_id", "recency", "recency_percentile", "per_month", "gap_mean", "gap_std", "spend_volatility", "late_share"
    )


def basket_features(transactions: DataFrame, articles: DataFrame, department: str = "product_group_name") -> DataFrame:
    """P6 per customer: ``weekend_ratio``, the quarter and month with most purchases (``peak_quarter``, ``peak_month``),
    ``items_per_day``, ``most_items``, ``spend_per_day`` and ``cross_category_ratio``, the share of shopping days with
    articles of several departments.  A shopping day is one basket: baskets are grouped first, then customers."""
    lines = transactions.groupBy("customer_id", "t_dat", "article_id").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("spend"))
    named = attach_attributes(lines, articles, [department])
    kinds = named.groupBy("customer_id", "t_dat", department).agg(F.sum("n").alias("n"), F.sum("spend").alias("spend"))
    days = kinds.groupBy("customer_id", "t_dat").agg(
        F.sum("n").alias("n"), F.sum("spend").alias("spend"), F.count(department).alias("departments")
    )
    weekend = F.dayofweek("t_dat").isin(1, 7)
    units = {"quarter": (F.quarter("t_dat"), 4), "month": (F.month("t_dat"), 12)}
    seasons = [
        F.coalesce(F.sum(F.when(unit == i, F.col("n"))), F.lit(0)).alias(f"{name}{i}")
        for name, (unit, last) in units.items()
        for i in range(1, last + 1)
    ]
    per = days.groupBy("customer_id").agg(
        (F.coalesce(F.sum(F.when(weekend, F.col("n"))), F.lit(0)) / F.sum("n")).alias("weekend_ratio"),
        F.avg("n").alias("items_per_day"),
        F.max("n").alias("most_items"),
        F.avg("spend").alias("spend_per_day"),
        (F.count_if(F.col("departments") > 1) / F.count(F.lit(1))).alias("cross_category_ratio"),
        *seasons,
    )

    def peak(name: str) -> Column:
        last = units[name][1]
        counts = F.array(*[f"{name}{i}" for i in range(1, last + 1)])
        return F.array_position(counts, F.array_max(counts)).cast("int").alias(f"peak_{name}")

    return per.select(
        "customer_id", "weekend_ratio", peak("quarter"), peak("month"), "items_per_day", "most_items", "spend_per_day", "cross_category_ratio"
    )


def channel_features(transactions: DataFrame, online: int = 2) -> DataFrame:
    """P8 per customer: ``online_ratio``, ``multi_channel``, ``switches`` (changes of channel from one visit to the next),
    ``runs`` of visits in one channel, and ``longest_run`` in visits.

    A visit is a day in one channel; visits of one day go by channel number.  Purchases without channel are left out.
    """
    known = transactions.filter(F.col("sales_channel_id").isNotNull())
    visits = known.groupBy("customer_id", "t_dat", "sales_channel_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("customer_id").orderBy("t_dat", "sales_channel_id")
    changed = F.col("sales_channel_id") != F.lag("sales_channel_id").over(order)
    visits = visits.withColumn("changed", F.coalesce(changed, F.lit(False)).cast("int"))
    # Gaps and islands: the number of changes so far names the run.
    visits = visits.withColumn("run", F.sum("changed").over(order))
    runs = visits.groupBy("customer_id", "run").agg(
        F.count(F.lit(1)).alias("visits"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("sales_channel_id") == online, F.col("n"))).alias("online"),
        F.min("sales_channel_id").alias("low"),
        F.max("sales_channel_id").alias("high"),
    )
    return runs.groupBy("customer_id").agg(
        (F.coalesce(F.sum("online"), F.lit(0)) / F.sum("n")).alias("online_ratio"),
        (F.min("low") != F.max("high")).alias("multi_channel"),
        (F.count(F.lit(1)) - 1).alias("switches"),
        F.count(F.lit(1)).alias("runs"),
        F.max("visits").alias("longest_run"),
    )


def loyalty_features(transactions: DataFrame, articles: DataFrame, family: str = "product_type_name", popular: int = 100) -> DataFrame:
    """P9 per customer: ``family_loyalty``, the share of purchases in a family bought before (null families are left out);
    ``explored``, the families bought; ``popular_alignment``, the share of purchases among the ``popular`` articles with most
    buyers (ties by article).  The list of popular articles is bounded by its length."""
    pairs = transactions.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"))
    best = pairs.groupBy("article_id").agg(F.count(F.lit(1)).alias("buyers"))
    best = best.orderBy(F.col("buyers").desc(), "article_id").limit(popular).select("article_id", F.lit(True).alias("popular"))
    named = attach_attributes(pairs, articles, [family]).join(best, "article_id", "left")
    families = named.groupBy("customer_id", family).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("popular"), F.col("n"))).alias("popular"))
    known = F.col(family).isNotNull()
    bought = F.sum(F.when(known, F.col("n")))
    return families.groupBy("customer_id").agg(
        F.try_divide(bought - F.count(family), bought).alias("family_loyalty"),
        F.count(family).alias("explored"),
        (F.coalesce(F.sum("popular"), F.lit(0)) / F.sum("n")).alias("popular_alignment"),
    )
