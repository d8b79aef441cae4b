"""Tables behind charts: histograms, box plots, Q-Q points, density, correlation, time series."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import ranks
from basketry.session import materialised
from basketry.sources.tables import columns_like, numeric_columns

KENDALL_BUCKET = 100_000  # rows per value bucket of the rank correlation


def histogram(df: DataFrame, column: str, bins: int = 50, upper_quantile: float | None = None) -> DataFrame:
    """K1: equal-width bins over the value range, after an optional cut at an upper quantile."""
    cells = ranks.melt(df, [column])
    if upper_quantile is not None:
        cells = cells.filter(F.col("value") <= ranks.quantile_struct(df, column, {"q": upper_quantile})["q"])
    ends = ranks.scalar_struct(cells, low=F.min("value"), high=F.max("value"))
    # A constant column gets a range of one around its value.
    flat = ends["low"] == ends["high"]
    low = F.when(flat, ends["low"] - 0.5).otherwise(ends["low"])
    width = F.when(flat, F.lit(1.0)).otherwise(ends["high"] - ends["low"]) / bins
    placed = F.least(F.floor((F.col("value") - low) / width), F.lit(bins - 1))
    counts = cells.groupBy(placed.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bin", (low + F.col("bin") * width).alias("start"), (low + (F.col("bin") + 1) * width).alias("end"), "n"
    )


def box_statistics(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """K2: quartiles, whiskers at the last value within 1.5 IQR, number of points beyond."""
    cells = ranks.melt(df, [column], by)
    keys = [*by, "column"]
    quartiles = ranks.quantiles(cells, {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        cells.join(quartiles, keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def normal_grid(points: int) -> list[tuple[float, float]]:
    """Probabilities at the middle of equal slices and their standard normal quantiles."""
    ps = [(i + 0.5) / points for i in range(points)]
    return [(p, NormalDist().inv_cdf(p)) for p in ps]


def qq_points(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """K3: sample quantiles beside normal quantiles."""
    grid = normal_grid(points)
    wide = ranks.column_quantiles(df, [column], {f"q{i}": p for i, (p, _) in enumerate(grid)})
    cells = F.array(
        *[
            F.struct(F.lit(p).alias("p"), F.lit(z).alias("normal"), F.col(f"q{i}").alias("sample"))
            for i, (p, z) in enumerate(grid)
        ]
    )
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def density_curve(df: DataFrame, column: str, points: int = 50) -> DataFrame:
    """K4: Gaussian kernel density on an even grid, bandwidth std * n^(-1/5).

    Works on distinct values with their counts, each of which adds to every grid point.
    """
    counts = ranks.value_counts(ranks.melt(df, [column]), [], "value")
    s = ranks.scalar_struct(
        ranks.melt(df, [column]),
        n=F.count(F.lit(1)),
        std=F.stddev_samp("value"),
        low=F.min("value"),
        high=F.max("value"),
    )
    width = s["std"] * F.pow(s["n"].cast("double"), F.lit(-0.2))
    span = s["high"] - s["low"]
    at = (s["low"] - span / 2) + F.col("point") * (2 * span / (points - 1))
    spread = counts.select("value", "n", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    z = (at - F.col("value")) / width
    return spread.groupBy("point").agg(
        F.first(at).alias("x"),
        (F.sum(F.col("n") * F.exp(-z * z / 2)) / F.first(s["n"] * width * float(np.sqrt(2 * np.pi)))).alias("density"),
    )


# --- correlation ----------------------------------------------------------------------------------


def _pairs_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise Pearson coefficients in one aggregation, pairs with a null skipped per pair."""
    names = list(combinations(columns, 2))
    coefficients = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(names)])
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r"))
            for i, (a, b) in enumerate(names)
        ]
    )
    return coefficients.select(F.explode(cells).alias("c")).select("c.*")


def _ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every value replaced by its average rank."""
    table = ranks.average_ranks(df, columns)
    out = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        mine = table.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("rank").alias(f"{c}__rank"))
        out = out.join(mine, c, "left")
    return out.select(*[F.col(f"{c}__rank").alias(c) for c in columns])


def _order_sum(y: np.ndarray, w: np.ndarray) -> float:
    """Sum over positions i < j of sign(y[j] - y[i]) * w[i] * w[j], by halving."""
    m = len(y)
    if m <= 64:
        return float((np.triu(np.sign(y[None, :] - y[:, None]), 1) * np.outer(w, w)).sum())
    h = m // 2
    left = np.argsort(y[:h], kind="stable")
    ly, cum = y[:h][left], np.concatenate([[0.0], np.cumsum(w[:h][left])])
    below = cum[np.searchsorted(ly, y[h:], "left")]
    above = cum[-1] - cum[np.searchsorted(ly, y[h:], "right")]
    return float((w[h:] * (below - above)).sum()) + _order_sum(y[:h], w[:h]) + _order_sum(y[h:], w[h:])


def _concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Concordant minus discordant weight of distinct weighted points."""
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order]
    same_x = pd.Series(w).groupby(x).agg(["sum", lambda v: float((v * v).sum())]).to_numpy()
    return _order_sum(y, w) - float(((same_x[:, 0] ** 2 - same_x[:, 1]) / 2).sum())


def _bucketed(points: DataFrame, axis: str, buckets: int) -> DataFrame:
    """Add ``<axis>b`` (ordered value bucket) and ``<axis>hot`` (bucket of one frequent value)."""
    counts = points.groupBy(F.lit(0).alias("g"), axis).agg(F.sum("n").alias("n"))
    ranked = ranks.running_counts(counts, ["g"], axis)
    hot = F.col("n") * buckets > F.col("total")
    slot = F.floor(F.col("below") * buckets / F.col("total")) * 2
    keys = ranked.select(
        axis, (slot + hot.cast("int")).cast("long").alias(f"{axis}b"), hot.alias(f"{axis}hot")
    )
    return points.join(keys, axis)


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """K5: exact Kendall tau-b of two columns without forming pairs of rows.

    Distinct points fall into value buckets on either axis.  Pairs in different buckets on both axes
    are counted on the bucket grid; the others lie in one x bucket or in one y bucket, where an
    O(m log m) count runs per bucket (pairs sharing both buckets are subtracted once).  A value
    frequent enough to fill a bucket has its own, and ties add nothing there, so no task ever
    receives it.
    """
    points = (
        df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        .filter(ranks.usable(F.col("x")) & ranks.usable(F.col("y")))
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    n_rows = points.agg(F.sum("n")).first()[0] or 0
    buckets = int(min(512, max(4, -(-n_rows // KENDALL_BUCKET))))
    placed = _bucketed(_bucketed(points, "x", buckets), "y", buckets)

    def local(g: pd.DataFrame) -> pd.DataFrame:
        s = _concordance(g["x"].to_numpy(), g["y"].to_numpy(), g["n"].to_numpy(dtype=float))
        return pd.DataFrame({"s": [s * g["sign"].iloc[0]]})

    kinds = F.filter(
        F.array(
            F.when(~F.col("xhot"), F.struct(F.lit("x").alias("k"), F.col("xb").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(1).alias("sign"))),
            F.when(~F.col("yhot"), F.struct(F.lit("y").alias("k"), F.col("yb").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(1).alias("sign"))),
            F.when(
                ~F.col("xhot") & ~F.col("yhot"),
                F.struct(F.lit("xy").alias("k"), F.col("xb").alias("i"), F.col("yb").alias("j"), F.lit(-1).alias("sign")),
            ),
        ),
        lambda k: k.isNotNull(),
    )
    near = (
        placed.select("x", "y", "n", F.explode(kinds).alias("kind"))
        .select("x", "y", "n", "kind.*")
        .groupBy("k", "i", "j")
        .applyInPandas(local, "s double")
    )

    def grid(g: pd.DataFrame) -> pd.DataFrame:
        t = g.pivot_table(index="xb", columns="yb", values="n", aggfunc="sum", fill_value=0).to_numpy(dtype=float)
        before = np.zeros_like(t)
        before[1:] = np.cumsum(t, axis=0)[:-1]
        cum = np.cumsum(before, axis=1)
        low = np.hstack([np.zeros((len(t), 1)), cum[:, :-1]])
        high = cum[:, -1:] - cum
        return pd.DataFrame({"s": [float((t * (low - high)).sum())]})

    # At most (2 * 512)^2 cells, whatever the number of rows.
    far = (
        placed.groupBy("xb", "yb")
        .agg(F.sum("n").alias("n"))
        .groupBy(F.lit(0).alias("g"))
        .applyInPandas(lambda g: grid(g), "s double")
    )
    score = near.unionByName(far).agg(F.sum("s")).scalar()

    def ties(axis: str) -> Column:
        c = F.col("n").cast("double")
        per_value = points.groupBy(axis).agg(F.sum("n").alias("n"))
        return per_value.agg(F.sum(c * (c - 1) / 2)).scalar()

    total = F.sum("n").cast("double")
    pairs = total * (total - 1) / 2
    return points.agg(
        F.lit(a).alias("a"),
        F.lit(b).alias("b"),
        pairs.alias("pairs"),
    ).select("a", "b", F.try_divide(score, F.sqrt((F.col("pairs") - ties("x")) * (F.col("pairs") - ties("y")))).alias("r"))


def correlation(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """K5: coefficients of all column pairs in long form ``(a, b, r)``."""
    if method == "pearson":
        return _pairs_table(df, columns)
    if method == "spearman":
        return _pairs_table(_ranked(df, columns), columns)
    if method == "kendall":
        tables = [kendall(df, a, b) for a, b in combinations(columns, 2)]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out
    raise ValueError(f"unknown correlation method {method!r}")


def strong_pairs(pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """K6: pairs with |r| above the threshold, strongest first."""
    return pairs.filter(F.abs("r") > threshold).orderBy(F.abs("r").desc(), "a", "b")


# --- time series ------------------------------------------------------------------------------------

PERIODS = {"D": "day", "W": "week", "M": "month"}


def time_series(df: DataFrame, date: str, value: str, freq: str = "D") -> DataFrame:
    """K7: sum per day, week or month, sorted."""
    period = F.to_date(F.date_trunc(PERIODS[freq], F.col(date)))
    return (
        df.groupBy(period.alias("period")).agg(F.sum(value).alias(value)).orderBy("period")
    )


def rolling_band(series: DataFrame, value: str) -> DataFrame:
    """Rolling mean, std and one-std band over min(30, n / 4) periods, if that is more than one.

    ``series`` has one row per period.
    """
    size = min(30, series.count() // 4)
    names = ("rolling_mean", "rolling_std", "upper", "lower")
    if size <= 1:
        return series.withColumns({n: F.lit(None).cast("double") for n in names})
    w = Window.orderBy("period").rowsBetween(-(size - 1), 0)
    full = F.count(F.lit(1)).over(w) == size
    mean, std = F.avg(value).over(w), F.stddev_samp(value).over(w)
    values = (mean, std, mean + std, mean - std)
    return series.withColumns({n: F.when(full, v) for n, v in zip(names, values)})


def segmentation(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """K9: rows clustered on standardised columns (nulls as 0): size, share, mean and median per cluster and column."""
    from basketry.operators.cluster import segment_on

    rows = materialised(df.select(F.monotonically_increasing_id().alias("row"), *columns))
    _, summary = segment_on(rows, "row", columns, k)
    total = F.sum("size").over(Window.partitionBy("column"))
    return summary.withColumn("share_pct", 100.0 * F.col("size") / total)


#: Columns and clusters of the bundle's segmentation.
SEGMENT_COLUMNS, SEGMENTS = 6, 5


def eda_bundle(df: DataFrame, date: str | None = None, value: str | None = None, bins: int = 50) -> dict[str, DataFrame]:
    """K9: every report for one table, with the columns chosen by type: profile, outliers, a histogram per numeric column,
    frequent values, correlation, segmentation on the first numeric columns (three at least), and the series of ``value``."""
    from basketry.operators.outliers import outlier_summary
    from basketry.operators.profiling import data_profile, top_values

    numeric = [c for c in numeric_columns(df) if not c.lower().endswith("id")]
    text = columns_like(df, types=(T.StringType,))
    out = {"profile": data_profile(df)}
    if numeric:
        out["outliers"] = outlier_summary(df, numeric)
    for c in numeric:
        out[f"histogram_{c}"] = histogram(df, c, bins)
    if text:
        out["top_values"] = top_values(df, text)
    if len(numeric) > 1:
        out["correlation"] = correlation(df, numeric)
    if len(numeric) > 2:
        out["segmentation"] = segmentation(df, numeric[:SEGMENT_COLUMNS], SEGMENTS)
    if date and value:
        out["time_series"] = time_series(df, date, value)
    return out
