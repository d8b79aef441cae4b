"""Column statistics, schema and quality reports, value counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import ranks
from basketry.sources.tables import columns_like, numeric_columns

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
TAILS = {"p95": 0.95, "p99": 0.99}


def numeric_statistics(
    df: DataFrame,
    columns: Sequence[str],
    qs: Mapping[str, float] | None = None,
    **extra: Callable[[Column], Column],
) -> DataFrame:
    """One row per column: count, nulls, mean, std, min, max and quantiles.

    ``extra`` adds aggregates, as functions of the column.
    """
    qs = dict(QUARTILES, **TAILS) if qs is None else qs
    out = column_moments(df, columns, extra)
    return out.join(ranks.column_quantiles(df, columns, qs), "column", "left") if qs else out


def column_moments(
    df: DataFrame, columns: Sequence[str], extra: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """One wide aggregation over the rows as they are, turned into one row per column."""
    metrics = {
        "count": F.count,
        "nulls": lambda x: F.count_if(x.isNull()),
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        **extra,
    }
    aggregates = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        number = F.when(~F.isnan(x), x)
        aggregates.append(F.struct(F.lit(c).alias("column"), *[f(number).alias(m) for m, f in metrics.items()]).alias(f"c{i}"))
    wide = df.agg(*aggregates)
    cells = F.array(*[F.col(f"c{i}") for i in range(len(columns))])
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D47."""
    return numeric_statistics(df, columns, QUARTILES).drop("nulls")


def to_metrics(stats: DataFrame) -> DataFrame:
    """Wide statistics to (column, metric, value) rows."""
    names = [c for c in stats.columns if c != "column"]
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
    )
    return stats.select("column", F.explode(cells).alias("m")).select("column", "m.metric", "m.value")


def feature_summary(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics per feature and the share of customers with purchases."""
    stats = numeric_statistics(
        features, columns, {"median": 0.5}, positive=lambda x: F.count_if(x > 0)
    )
    frequency = F.when(F.col("column") == "frequency", F.col("positive"))
    return (
        stats.withColumns(
            {
                "customers": F.col("count") + F.col("nulls"),
                "active": F.max(frequency).over(Window.partitionBy(F.lit(1))),
            }
        )
        .withColumn("active_rate", F.try_divide("active", "customers"))
        .withColumnRenamed("column", "feature")
        .drop("count", "positive")
    )


def quantile_table(df: DataFrame, column: str, fractions: Sequence[float]) -> DataFrame:
    """One row per fraction."""
    names = {f"q{i}": q for i, q in enumerate(fractions)}
    wide = ranks.column_quantiles(df, [column], names)
    cells = F.array(
        *[F.struct(F.lit(q).alias("fraction"), F.col(n).alias("value")) for n, q in names.items()]
    )
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def melt_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(column, value)`` with every value as text; nulls are kept."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    )
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return melt_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column with their share."""
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    return (
        value_counts(df, columns)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .withColumn("pct", F.try_divide(F.col("n") * 100.0, n_rows))
    )


def schema_analysis(df: DataFrame) -> DataFrame:
    """Type, nulls and distinct values per column; null counts as one distinct value."""
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    dtype = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return (
        value_counts(df, df.columns)
        .groupBy("column")
        .agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count(F.lit(1)).alias("distinct_values"),
        )
        .select(
            "column",
            dtype[F.col("column")].alias("dtype"),
            "nulls",
            F.try_divide(F.col("nulls") * 100.0, n_rows).alias("null_pct"),
            "distinct_values",
            F.try_divide(F.col("distinct_values") * 100.0, n_rows).alias("distinct_pct"),
        )
    )


def quality_metrics(df: DataFrame) -> DataFrame:
    """Cells, nulls, completeness and duplicate rows; one row."""
    nulls: Column = F.lit(0)
    for c in df.columns:
        nulls = nulls + F.col(f"`{c}`").isNull().cast("int")
    whole_row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    width = len(df.columns)
    # Row counts per distinct row: the wide rows meet their copies by hash, pre-aggregated.
    return (
        df.groupBy(whole_row.alias("r"), nulls.alias("nulls"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.col("n") * F.col("nulls")).alias("null_cells"),
            F.sum(F.col("n") - 1).alias("duplicate_rows"),
        )
        .withColumns(
            {
                "cells": F.col("n_rows") * width,
                "null_pct": F.try_divide(F.col("null_cells") * 100.0, F.col("n_rows") * width),
                "completeness": 100 - F.try_divide(F.col("null_cells") * 100.0, F.col("n_rows") * width),
                "duplicate_pct": F.try_divide(F.col("duplicate_rows") * 100.0, F.col("n_rows")),
            }
        )
    )


def looks_like_id(name: Column) -> Column:
    """D19, name rule."""
    low = F.lower(name)
    return (
        low.endswith("id") | low.startswith("id_") | low.contains("uuid") | low.contains("guid")
    )


def probable_ids(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Identifier-like by name or by share of distinct values."""
    return schema_analysis(df).select(
        "column",
        (looks_like_id(F.col("column")) | (F.col("distinct_pct") / 100 >= threshold)).alias("probable_id"),
    )


def numeric_summary(df: DataFrame) -> DataFrame:
    """Statistics of numeric columns that are not identifiers, rounded to four places."""
    columns = numeric_columns(df)
    keep = probable_ids(df.select(*columns)).filter(~F.col("probable_id")).select("column")
    stats = numeric_statistics(df, columns, QUARTILES).join(keep, "column", "left_semi")
    return stats.withColumns(
        {c: F.round(c, 4) for c in stats.columns if c not in ("column", "count", "nulls")}
    )


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Distinct values, the ``k`` most frequent ones and the mean length per text column."""
    columns = list(columns or columns_like(df, types=(T.StringType,)))
    counts = value_counts(df, columns)
    totals = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.try_divide(
            F.sum(F.char_length("value") * F.col("n")), F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
        ).alias("mean_length"),
    )
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    tops = (
        counts.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .groupBy("column")
        .agg(
            F.array_join(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("rank", "value", "n"))),
                    lambda t: F.concat(F.coalesce(t["value"], F.lit("<null>")), F.lit("="), t["n"].cast("string")),
                ),
                ", ",
            ).alias("top_values")
        )
    )
    return totals.join(tops, "column")


def quality_recommendations(df: DataFrame) -> DataFrame:
    """Rules over the quality metrics and the schema analysis, one row per finding."""
    table_rules = quality_metrics(df).select(
        F.explode(
            F.array(
                F.when(F.col("null_pct") > 10, "high missing values"),
                F.when(F.col("duplicate_pct") > 5, "significant duplicates"),
            )
        ).alias("finding"),
        F.lit("<table>").alias("column"),
    )
    column_rules = schema_analysis(df).select(
        F.explode(
            F.array(
                F.when(F.col("distinct_pct") > 95, "potential id"),
                F.when(F.col("distinct_values").between(2, 10), "low cardinality"),
            )
        ).alias("finding"),
        "column",
    )
    return table_rules.unionByName(column_rules).filter(F.col("finding").isNotNull())


def data_profile(df: DataFrame) -> DataFrame:
    """Schema, numeric statistics and most frequent values as one (section, column, metric, value)."""

    def rows(section: str, table: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
        cells = F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value"))
                for m in metrics
            ]
        )
        return table.select(
            F.lit(section).alias("section"), F.col(key).alias("column"), F.explode(cells).alias("c")
        ).select("section", "column", "c.metric", "c.value")

    schema = rows("schema", schema_analysis(df), "column", ["dtype", "nulls", "distinct_values"])
    quality = rows(
        "quality",
        quality_metrics(df).withColumn("table", F.lit("<table>")),
        "table",
        ["n_rows", "null_cells", "duplicate_rows"],
    )
    stats = numeric_statistics(df, numeric_columns(df), QUARTILES)
    stats = stats.withColumns({m: F.round(m, 4) for m in ("mean", "std", "min", "max", *QUARTILES)})
    numeric = rows("numeric", stats, "column", ["mean", "std", "min", "max", *QUARTILES])
    text = columns_like(df, types=(T.StringType,))
    parts = [schema, quality, numeric]
    if text:
        parts.append(rows("frequent", top_values(df, text, 1), "column", ["value", "n"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def key_quality(df: DataFrame, key: str) -> DataFrame:
    """D35."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("distinct_keys"),
        F.count_if(F.col(key).isNull()).alias("null_keys"),
    ).withColumn("unique_keys", F.col("n_rows") == F.col("distinct_keys"))
