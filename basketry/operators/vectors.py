"""Statistics and principal components of vector columns (``array<double>``)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from basketry.functions import ranks
from basketry.operators.text import unit_length
from basketry.session import materialised


def pca(df: DataFrame, key: str, k: int, vector: str = "vector", normalise: bool = False) -> tuple[DataFrame, list[float]]:
    """Coordinates on the first ``k`` principal components and their variance ratios.

    ML's PCA does not centre what it projects, so the mean is taken off first.
    """
    rows = df.select(key, array_to_vector(vector).alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    out = model.transform(centred).select(key, vector_to_array("p").alias("vector"))
    if normalise:
        out = out.withColumn("vector", unit_length(F.col("vector")))
    return out, [float(x) for x in model.explainedVariance]


def loadings(df: DataFrame, names: list[str], k: int = 2, vector: str = "vector") -> DataFrame:
    """Mean absolute loading of every feature on the first ``k`` components."""
    rows = df.select(array_to_vector(vector).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    weight = np.abs(model.pc.toArray()).mean(axis=1)
    table = [(n, float(w)) for n, w in zip(names, weight)]
    return df.sparkSession.createDataFrame(table, "feature string, importance double")


def explained_variance(spark, ratios: list[float], target: float = 0.95) -> DataFrame:
    """K8: ratio and running sum per component, and whether the target is reached by it."""
    rows = [
        (i, float(r), float(c), bool(c >= target))
        for i, (r, c) in enumerate(zip(ratios, accumulate(ratios)), start=1)
    ]
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double, reached boolean")


def components_needed(ratios: list[float], target: float = 0.95) -> int | None:
    """K8: components to reach the target, none if all fall short."""
    return next((i for i, c in enumerate(accumulate(ratios), start=1) if c >= target), None)


def cells(df: DataFrame, *keep: str, vector: str = "vector") -> DataFrame:
    """Long form ``(keep…, dim, v)``; aggregations over it combine before the shuffle."""
    return df.select(*keep, F.posexplode(vector).alias("dim", "v"))


def dimension_statistics(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Statistics per dimension."""
    return cells(df, vector=vector).groupBy("dim").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def matrix_checks(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Missing cells, global statistics and the range of the per-dimension ones, from one scan."""
    value = F.when(~F.isnan("v"), F.col("v"))
    per_dim = (
        cells(df, vector=vector)
        .groupBy("dim")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(value).alias("k"),
            F.avg(value).alias("m"),
            F.var_pop(value).alias("s2"),
            F.min(value).alias("lo"),
            F.max(value).alias("hi"),
        )
    )
    total = F.sum("k")
    mean = F.sum(F.col("k") * F.col("m")) / total
    second = F.sum(F.col("k") * (F.col("s2") + F.col("m") * F.col("m"))) / total
    return per_dim.agg(
        F.sum("n").alias("cells"),
        F.sum(F.col("n") - F.col("k")).alias("missing"),
        mean.alias("mean"),
        F.sqrt(second - mean * mean).alias("std"),
        F.min("lo").alias("min"),
        F.max("hi").alias("max"),
        F.min("m").alias("min_mean"),
        F.max("m").alias("max_mean"),
        F.min(F.sqrt("s2")).alias("min_std"),
        F.max(F.sqrt("s2")).alias("max_std"),
    )


def component_variance(df: DataFrame, k: int, vector: str = "vector") -> DataFrame:
    """Dimensions of the largest (population) variance."""
    per_dim = cells(df, vector=vector).groupBy("dim").agg(F.var_pop("v").alias("variance"))
    rank = F.row_number().over(Window.orderBy(F.col("variance").desc(), "dim"))
    return per_dim.withColumn("rank", rank).filter(F.col("rank") <= k)


def mean_variance(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Mean over dimensions of the sample variance and standard deviation."""
    per_dim = cells(df, vector=vector).groupBy("dim").agg(
        F.var_samp("v").alias("var"), F.stddev_samp("v").alias("std")
    )
    return per_dim.agg(F.avg("var").alias("mean_variance"), F.avg("std").alias("mean_std"))


def cluster_spread(df: DataFrame, cluster: str, vector: str = "vector") -> DataFrame:
    """Size, mean and compactness (mean of the per-dimension standard deviations) per cluster."""
    per_dim = cells(df, cluster, vector=vector).groupBy(cluster, "dim").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")
    )
    return per_dim.groupBy(cluster).agg(
        F.max("n").alias("size"), F.avg("m").alias("mean"), F.avg("s").alias("compactness")
    )

def gram(df: DataFrame, vector: str = "vector") -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and centred Gram matrix (scatter) of the vectors.

    Each task returns one d x d matrix, the matrices of groups of tasks are added by further tasks; the driver holds d x d.
    """
    first = df.select(vector).first()
    if first is None:
        raise ValueError("no vectors")
    d = len(first[0])
    # Around the first vector, so that a far-off mean costs no digits.
    middle = np.array(first[0], dtype=float)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), dtype=float) - middle
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        slot = TaskContext.get().partitionId() % slots
        sums = np.concatenate([[n], total, square.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["slot", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in group.column("sums").to_pylist())
        return pa.table({"slot": group.column("slot").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = df.select(vector)
    slots = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    parts = rows.mapInArrow(local, "slot int, sums binary").groupBy("slot").applyInArrow(add, "slot int, sums binary").collect()
    sums = sum(np.frombuffer(r["sums"], np.float64) for r in parts)
    n, total, square = int(sums[0]), sums[1 : d + 1], sums[d + 1 :].reshape(d, d)
    return n, middle + total / n, square - np.outer(total, total) / n


def reconstruction_errors(df: DataFrame, key: str, k: int, vector: str = "vector") -> tuple[DataFrame, np.ndarray]:
    """``(key, energy, residual)`` and the variances of all components, largest first.

    ``energy`` is the squared distance from the mean, ``residual`` what the first ``k`` principal components leave of it.
    """
    n, mean, scatter = gram(df, vector)
    variance, axes = np.linalg.eigh(scatter)
    basis = axes[:, ::-1][:, :k]
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), dtype=float) - mean
                rest = x - (x @ basis) @ basis.T
                columns = [batch.column(0).cast(to_arrow_type(kind)), pa.array((x * x).sum(1)), pa.array((rest * rest).sum(1))]
                yield pa.RecordBatch.from_arrays(columns, [key, "energy", "residual"])

    out = df.select(key, vector).mapInArrow(run, f"{key} {kind.simpleString()}, energy double, residual double")
    return out, np.maximum(variance[::-1], 0) / n


def reconstruction_outliers(df: DataFrame, key: str, k: int, share: float = 0.01, vector: str = "vector") -> DataFrame:
    """``(key, energy, residual, outlier)``: rows whose residual is above the ``1 - share`` quantile of all residuals."""
    errors = materialised(reconstruction_errors(df, key, k, vector)[0])
    limit = ranks.exact_quantiles(errors, ["residual"], {"limit": 1 - share})["residual"]["limit"]
    return errors.withColumn("outlier", F.col("residual") > F.lit(limit))
