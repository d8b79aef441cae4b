"""Outlier detection for all numeric columns together."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import ranks
from basketry.operators.profiling import column_moments
from basketry.sources.tables import numeric_columns

PERCENTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p01": 0.01, "p99": 0.99}


def outlier_columns(df: DataFrame) -> list[str]:
    """D28, column rule: numeric and not named like an identifier."""
    return [c for c in numeric_columns(df) if not c.lower().endswith("id")]


def _number(column: str) -> Column:
    x = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(x), x)


def _table(df: DataFrame, rows: dict[str, dict[str, float]], outlier: Callable[[Column, dict], Column], keep: Sequence[str]) -> DataFrame:
    """One row per column: the number of outliers by its bounds, from one wide aggregation, and the bounds in ``keep``."""
    spark = df.sparkSession
    counts = df.agg(*[F.count_if(outlier(_number(c), b)).alias(f"n{i}") for i, (c, b) in enumerate(rows.items())]).first() if rows else None
    table = [(c, *[b[k] for k in keep], counts[f"n{i}"]) for i, (c, b) in enumerate(rows.items())]
    schema = "column string, " + "".join(f"{k} double, " for k in keep) + "outliers bigint"
    return spark.createDataFrame(table, schema).select("column", *keep, "outliers")


def _known(found: dict[str, dict[str, float | None]]) -> dict[str, dict[str, float]]:
    """Columns that hold any number."""
    return {c: dict(q) for c, q in found.items() if None not in q.values()}


def _outside(low: str, high: str) -> Callable[[Column, dict], Column]:
    return lambda x, b: (x < F.lit(b[low])) | (x > F.lit(b[high]))


def iqr_outliers(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """D24."""
    rows = _known(ranks.exact_quantiles(df, columns, {"q1": 0.25, "q3": 0.75}))
    for b in rows.values():
        spread = multiplier * (b["q3"] - b["q1"])
        b |= {"lower": b["q1"] - spread, "upper": b["q3"] + spread}
    return _table(df, rows, _outside("lower", "upper"), ["q1", "q3", "lower", "upper"])


def _score(x: Column, mean: float | None, std: float | None) -> Column:
    """Distance from the mean in standard deviations; null without spread."""
    return F.abs((x - F.lit(mean)) / F.lit(std)) if std else F.lit(None).cast("double")


def zscore_outliers(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """No spread, no outlier."""
    stats = {r["column"]: {"mean": r["mean"], "std": r["std"]} for r in column_moments(df, columns, {}).filter("count > 0").collect()}
    return _table(df, stats, lambda x, b: _score(x, b["mean"], b["std"]) > threshold, ["mean", "std"])


def _gaps(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.select(*[F.abs(_number(c) - F.lit(m)).alias(c) for c, m in medians.items()])


def median_deviations(df: DataFrame, medians: dict[str, float]) -> dict[str, float | None]:
    """Median absolute deviation per column."""
    found = ranks.exact_quantiles(_gaps(df, medians), list(medians), {"mad": 0.5})
    return {c: q["mad"] for c, q in found.items()}


def _modified(x: Column, median: float, mad: float) -> Column:
    return F.abs(0.6745 * (x - F.lit(median)) / F.lit(mad)) if mad else F.lit(None).cast("double")


def modified_zscore_outliers(df: DataFrame, columns: Sequence[str], threshold: float = 3.5) -> DataFrame:
    """No deviation, no outlier."""
    rows = _known(ranks.exact_quantiles(df, columns, {"median": 0.5}))
    for c, mad in median_deviations(df, {c: b["median"] for c, b in rows.items()}).items():
        rows[c]["mad"] = mad
    return _table(df, rows, lambda x, b: _modified(x, b["median"], b["mad"]) > threshold, ["median", "mad"])


def percentile_outliers(
    df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99
) -> DataFrame:
    """D27."""
    rows = _known(ranks.exact_quantiles(df, columns, {"lower": low, "upper": high}))
    return _table(df, rows, _outside("lower", "upper"), ["lower", "upper"])


def outlier_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All four methods for all columns in a fixed number of passes; no row is shuffled."""
    columns = list(columns or outlier_columns(df))
    rows = _known(ranks.exact_quantiles(df, columns, PERCENTILES))
    stats = {r["column"]: r for r in column_moments(df, list(rows), {}).collect()} if rows else {}
    mads = median_deviations(df, {c: b["median"] for c, b in rows.items()}) if rows else {}
    methods = {
        "outliers_iqr": _outside("lower_iqr", "upper_iqr"),
        "outliers_zscore": lambda x, b: _score(x, b["mean"], b["std"]) > 3.0,
        "outliers_modified": lambda x, b: _modified(x, b["median"], b["mad"]) > 3.5,
        "outliers_percentile": _outside("p01", "p99"),
    }
    counts = []
    for i, (c, b) in enumerate(rows.items()):
        b |= {k: stats[c][k] for k in ("count", "nulls", "mean", "std", "min", "max")}
        spread = b["q3"] - b["q1"]
        b |= {"mad": mads[c], "iqr": spread, "lower_iqr": b["q1"] - 1.5 * spread, "upper_iqr": b["q3"] + 1.5 * spread}
        counts += [F.count_if(rule(_number(c), b)).alias(f"{name}{i}") for name, rule in methods.items()]
    found = df.agg(*counts).first() if counts else None
    names = ["count", "nulls", "mean", "std", "min", "max", *PERCENTILES, "mad", "iqr", "lower_iqr", "upper_iqr"]
    table = [(c, *[b[k] for k in names], *[found[f"{m}{i}"] for m in methods], b["count"] + b["nulls"]) for i, (c, b) in enumerate(rows.items())]
    schema = ", ".join(f"{k} {'bigint' if k in ('count', 'nulls') else 'double'}" for k in names)
    schema = f"column string, {schema}, " + ", ".join(f"{m} bigint" for m in [*methods, "total"])
    return df.sparkSession.createDataFrame(table, schema)


def outlier_recommendations(summary: DataFrame) -> DataFrame:
    """Priority tier and findings per column."""
    share = F.try_divide(F.col("outliers_iqr") * 100.0, F.col("total"))
    # No positive minimum means an unbounded ratio.
    unbounded = F.col("min") <= 0
    ratio = F.try_divide(F.col("max"), F.col("min"))
    methods = F.array_distinct(
        F.array("outliers_iqr", "outliers_zscore", "outliers_modified", "outliers_percentile")
    )
    money = F.lower("column").isin("price", "amount", "cost", "value")
    findings = F.array_compact(
        F.array(
            F.when(share > 10, "high outlier share")
            .when(share > 5, "moderate outliers")
            .when(share > 1, "some outliers"),
            F.when(unbounded | (ratio > 1000), "extremely wide range").when(ratio > 100, "wide range"),
            F.when(F.size(methods) > 3, "methods disagree"),
            F.when(F.col("std") > F.col("mean") * 2, "high variability"),
            F.when((F.col("min") < 0) & money, "negative values"),
        )
    )
    tier = F.when(share > 5, "high").when(share > 1, "moderate").otherwise("clean")
    return summary.select(
        "column",
        tier.alias("priority"),
        F.when(F.size(findings) == 0, "clean data").otherwise(F.array_join(findings, "; ")).alias("findings"),
    )


# --- sketched quantiles (P1) -------------------------------------------------------------------------


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = 400) -> DataFrame:
    """``(by…, column, sketch)``: one mergeable quantile sketch per column (and group), from one pass over the rows.

    A sketch has a bounded size, whatever the number of rows; its rank error is ``ranks.sketch_error(k)``.
    """
    wide = df.groupBy(*by).agg(*[F.kll_sketch_agg_double(_number(c), F.lit(k)).alias(f"s{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)])
    return wide.select(*by, F.explode(cells).alias("cell")).select(*by, "cell.*")


def merged_sketches(sketches: DataFrame, by: Sequence[str] = (), k: int = 400) -> DataFrame:
    """Sketches of parts (days, files) as one per column (and group)."""
    return sketches.groupBy(*by, "column").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketch_bounds(sketches: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """``(…, column, n, q1, q3, lower, upper)`` of sketches; null where a column holds no number."""
    n = F.kll_sketch_get_n_double("sketch")
    at = F.kll_sketch_get_quantile_double("sketch", F.array(F.lit(0.25), F.lit(0.75)))
    found = sketches.withColumn("n", n).withColumn("q", F.when(F.col("n") > 0, at)).drop("sketch")
    found = found.withColumns({"q1": F.col("q")[0], "q3": F.col("q")[1]}).drop("q")
    spread = multiplier * (F.col("q3") - F.col("q1"))
    return found.withColumns({"lower": F.col("q1") - spread, "upper": F.col("q3") + spread})


def flagged(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with ``<column>_outlier`` for every column of ``bounds`` (one row per column); null values are not flagged."""
    rows = {r["column"]: r for r in bounds.collect()}
    flags = {f"{c}_outlier": F.coalesce(_outside("lower", "upper")(_number(c), b), F.lit(False)) for c, b in rows.items() if b["lower"] is not None}
    return df.withColumns(flags)
