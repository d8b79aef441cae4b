"""Row filters, key restriction, period overlap, ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.text import trimmed


def last_days(transactions: DataFrame, days: int = 90, date: str = "t_dat") -> DataFrame:
    """B1: rows at most ``days`` before the newest date, inclusive.

    The bound is a scalar subquery of the column's own type, which the Parquet scan receives as a
    pushed filter.
    """
    kind = transactions.schema[date].dataType
    bound = transactions.agg(F.date_sub(F.max(date), days).cast(kind)).scalar()
    return transactions.filter(F.col(date) >= bound)


def fact_statistics(transactions: DataFrame) -> DataFrame:
    """B2: one row of counts and the date range."""
    return transactions.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("article_id").alias("articles"),
        F.min("t_dat").alias("first_date"),
        F.max("t_dat").alias("last_date"),
    )


def retained_statistics(kept: DataFrame, original: DataFrame) -> DataFrame:
    """B2: statistics of the kept facts and the share of the original they make up."""
    total = original.agg(F.count(F.lit(1))).scalar()
    return fact_statistics(kept).withColumn(
        "retained_pct", F.try_divide(F.col("transactions") * 100.0, total)
    )


def keep_referenced(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Dimension rows whose key occurs in the facts."""
    return dimension.join(facts.select(key), key, "left_semi")


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts before and after a filter, with the rate kept."""
    kept = after.agg(F.count(F.lit(1))).scalar()
    return before.agg(F.count(F.lit(1)).alias("before")).select(
        "before",
        kept.alias("after"),
        (F.col("before") - kept).alias("removed"),
        F.try_divide(kept * 100.0, F.col("before")).alias("kept_pct"),
    )


def min_activity(transactions: DataFrame, key: str, at_least: int) -> DataFrame:
    """Facts of the keys that occur ``at_least`` times."""
    active = transactions.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    return transactions.join(active.select(key), key, "left_semi")


def valid_texts(df: DataFrame, text: str = "detail_desc", sentinel: str = "no_description") -> DataFrame:
    """Trimmed, non-empty texts that are not the sentinel."""
    clean = trimmed(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(text, clean).filter((F.lower(text) != sentinel) & (F.length(text) > 0))


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without any null."""
    return df.dropna(subset=list(columns) if columns else None)


def completeness(df: DataFrame) -> DataFrame:
    """Number and share of complete rows."""
    full: Column = F.lit(True)
    for c in df.columns:
        full = full & F.col(f"`{c}`").isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(full).alias("complete")).withColumn(
        "complete_pct", F.try_divide(F.col("complete") * 100.0, F.col("n_rows"))
    )


def drop_types(df: DataFrame, types: tuple[type, ...]) -> DataFrame:
    """Drop columns of the given types, for example boolean quality flags."""
    return df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, types)])


def with_provenance(df: DataFrame, **constants) -> DataFrame:
    """Constant provenance columns; times are passed in so that reruns agree."""
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys two periods share, as counts and shares."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return (
        a.intersect(b)
        .agg(F.count(F.lit(1)).alias("shared"))
        .select(
            "shared",
            a.agg(F.count(F.lit(1))).scalar().alias("left_keys"),
            b.agg(F.count(F.lit(1))).scalar().alias("right_keys"),
        )
        .withColumns(
            {
                "pct_of_left": F.try_divide(F.col("shared") * 100.0, F.col("left_keys")),
                "pct_of_right": F.try_divide(F.col("shared") * 100.0, F.col("right_keys")),
            }
        )
    )


def top_k(df: DataFrame, value: Column, k: int, *tiebreak: str) -> DataFrame:
    """the ``k`` largest rows by ``value``, ties by the given columns."""
    return df.orderBy(value.desc(), *tiebreak).limit(k)


def multi_sort(df: DataFrame, *order: Column | str) -> DataFrame:
    """F2."""
    return df.orderBy(*order)
