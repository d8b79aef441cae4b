"""Sales figures: daily series, calendar patterns, business figures, value segments, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import ranks


def pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def daily(transactions: DataFrame) -> DataFrame:
    """D2."""
    return transactions.groupBy("t_dat").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("price").alias("revenue"),
        F.count_distinct("customer_id").alias("customers"),
        F.avg("price").alias("average_value"),
    )


def moving_average(daily_sales: DataFrame, value: str = "revenue", days: int = 7) -> DataFrame:
    """Trailing mean over ``days`` rows, null until that many exist; input is one row per day."""
    w = Window.orderBy("t_dat").rowsBetween(-(days - 1), 0)
    full = F.count(F.lit(1)).over(w) == days
    return daily_sales.withColumn(f"{value}_ma{days}", F.when(full, F.avg(value).over(w)))


def customer_totals(transactions: DataFrame) -> DataFrame:
    """D3."""
    return (
        transactions.groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.round(F.sum("price"), 6).alias("total_spend"),
            F.avg("price").alias("average_value"),
            F.min("t_dat").alias("first_date"),
            F.max("t_dat").alias("last_date"),
        )
        .withColumn("lifespan_days", F.datediff("last_date", "first_date"))
    )


def customer_totals_summary(totals: DataFrame) -> DataFrame:
    """Statistics over the per-customer totals."""
    mid = ranks.quantile_map(totals, ["transactions", "total_spend"], {"m": 0.5})
    return totals.agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("transactions").alias("mean_transactions"),
        F.max("transactions").alias("max_transactions"),
        F.avg("total_spend").alias("mean_spend"),
        F.max("total_spend").alias("max_spend"),
        F.avg("lifespan_days").alias("mean_lifespan"),
    ).select(
        "*",
        mid["transactions"]["m"].alias("median_transactions"),
        mid["total_spend"]["m"].alias("median_spend"),
    )


def calendar_patterns(transactions: DataFrame) -> DataFrame:
    """Month and weekday (Monday = 1) totals from one scan, both in long form."""
    days = transactions.groupBy("t_dat").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("revenue"), F.count("price").alias("priced")
    )
    part = F.explode(
        F.array(
            F.struct(F.lit("month").alias("part"), F.month("t_dat").alias("position")),
            F.struct(F.lit("weekday").alias("part"), (F.weekday("t_dat") + 1).alias("position")),
        )
    )
    return (
        days.select(part.alias("p"), "n", "revenue", "priced")
        .groupBy("p.part", "p.position")
        .agg(
            F.sum("n").alias("transactions"),
            F.sum("revenue").alias("revenue"),
            F.try_divide(F.sum("revenue"), F.sum("priced")).alias("mean_price"),
        )
    )


def calendar_peaks(patterns: DataFrame) -> DataFrame:
    """Strongest position per calendar part and its swing, (max - min) / mean."""
    return patterns.groupBy("part").agg(
        F.max_by("position", F.struct("revenue", -F.col("position"))).alias("peak"),
        F.max("revenue").alias("peak_revenue"),
        (F.try_divide(F.max("revenue") - F.min("revenue"), F.avg("revenue")) * 100).alias("variation_pct"),
    )


def business_figures(transactions: DataFrame) -> DataFrame:
    """D6."""
    base = transactions.agg(
        F.sum("price").alias("revenue"),
        F.count(F.lit(1)).alias("transactions"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("article_id").alias("articles"),
        (F.datediff(F.max("t_dat"), F.min("t_dat")) + 1).alias("period_days"),
    )
    return base.withColumns(
        {
            "revenue_per_customer": F.try_divide("revenue", "customers"),
            "revenue_per_transaction": F.try_divide("revenue", "transactions"),
            "transactions_per_customer": F.try_divide("transactions", "customers"),
            "revenue_per_day": F.try_divide("revenue", "period_days"),
            "transactions_per_day": F.try_divide("transactions", "period_days"),
        }
    )


def top_articles(transactions: DataFrame, k: int = 10) -> DataFrame:
    """D7."""
    totals = transactions.groupBy("article_id").agg(
        F.round(F.sum("price"), 6).alias("revenue"),
        F.count(F.lit(1)).alias("transactions"),
        F.avg("price").alias("average_price"),
    )
    return totals.orderBy(F.col("revenue").desc(), "article_id").limit(k)


def value_segments(totals: DataFrame, high: float = 0.9, medium: float = 0.7) -> DataFrame:
    """High / Medium / Low by spend quantiles, with totals and shares per segment."""
    cut = ranks.quantile_struct(totals, "total_spend", {"high": high, "medium": medium})
    segment = (
        F.when(F.col("total_spend") >= cut["high"], "High Value")
        .when(F.col("total_spend") >= cut["medium"], "Medium Value")
        .otherwise("Low Value")
    )
    by_segment = totals.groupBy(segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("total_spend").alias("revenue"),
        F.avg("total_spend").alias("average_spend"),
        F.avg("transactions").alias("average_transactions"),
    )
    return with_shares(by_segment, {"customers": "customer_pct", "revenue": "revenue_pct"})


def with_shares(grouped: DataFrame, shares: dict[str, str]) -> DataFrame:
    """Share of the grand total; for grouped tables of bounded size."""
    everything = Window.partitionBy(F.lit(1))
    return grouped.withColumns(
        {name: pct(F.col(c), F.sum(c).over(everything)) for c, name in shares.items()}
    )


def with_cumulative(grouped: DataFrame, value: str, name: str, *tiebreak: str) -> DataFrame:
    """Running sum, largest first; for grouped tables of bounded size."""
    w = Window.orderBy(F.col(value).desc(), *tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    return grouped.withColumn(name, F.sum(value).over(w))


def purchase_insights(transactions: DataFrame) -> DataFrame:
    """Repeat rate, high-value rate, share of prices within 10% of the median price."""
    totals = customer_totals(transactions)
    high = ranks.quantile_struct(totals, "total_spend", {"q": 0.8})["q"]
    mid = ranks.quantile_struct(transactions, "price", {"q": 0.5})["q"]
    near = transactions.agg(
        pct(
            F.count_if((F.col("price") >= mid * 0.9) & (F.col("price") <= mid * 1.1)),
            F.count(F.lit(1)),
        ).alias("p")
    ).scalar()
    return totals.agg(
        pct(F.count_if(F.col("transactions") > 1), F.count(F.lit(1))).alias("repeat_pct"),
        pct(F.count_if(F.col("total_spend") >= high), F.count(F.lit(1))).alias("high_value_pct"),
    ).select("*", near.alias("near_median_pct"))


def activity(transactions: DataFrame) -> DataFrame:
    """Sparsity of the customer by article matrix and activity per customer."""
    pairs = transactions.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"))
    per_customer = pairs.groupBy("customer_id").agg(
        F.sum("n").alias("transactions"), F.count(F.lit(1)).alias("articles")
    )
    n_articles = transactions.agg(F.count_distinct("article_id")).scalar()
    return per_customer.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("transactions").alias("interactions"),
        F.sum("articles").alias("pairs"),
        F.avg("transactions").alias("mean_transactions"),
        F.max("transactions").alias("max_transactions"),
        F.avg("articles").alias("mean_articles"),
        F.max("articles").alias("max_articles"),
    ).select(
        "*",
        n_articles.alias("articles"),
        (1 - F.try_divide(F.col("pairs"), F.col("customers") * n_articles)).alias("sparsity"),
    )
