"""Partition clustering: preparation, fits, the choice of k, projections, export."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators import cluster_metrics as metrics
from basketry.operators import mixture, segments, vectors
from basketry.operators.encode import label_encode, standardise
from basketry.session import materialised
from basketry.sources.tables import write_parquet

# Feature sets of the approaches.
RFM = ["recency", "frequency", "monetary"]
PREFERENCE = [
    "purchase_diversity_score",
    "price_sensitivity_index",
    "colour_preference_entropy",
    "style_consistency_score",
]
FEATURE_SETS = {
    "rfm": RFM,
    "preference": PREFERENCE,
    "behavioural": [*RFM, *PREFERENCE, "age", "FN", "Active"],
    "hybrid": [*RFM, *PREFERENCE],
}
ENCODED = ["club_member_status", "fashion_news_frequency"]


def prepare_features(df: DataFrame, approach: str, key: str = "customer_id") -> DataFrame:
    """``(key, vector)`` of the standardised features of an approach."""
    if approach not in FEATURE_SETS:
        raise ValueError(f"unknown approach {approach!r}")
    columns = list(FEATURE_SETS[approach])
    # Written: codes, means and the result each read the features, which may be long to make.
    data = materialised(df.select(key, *columns, *(ENCODED if approach == "behavioural" else [])))
    if approach == "behavioural":
        data = label_encode(data, ENCODED)
        columns += [f"{c}_encoded" for c in ENCODED]
    scaled = standardise(data, columns)
    return scaled.select(key, F.array(*[F.col(c) for c in columns]).alias("vector"))


def _ml_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.col(vector).alias("vector"), array_to_vector(vector).alias("features"))


def _renumber(predicted: DataFrame, key: str) -> DataFrame:
    """Cluster ids by size, largest first, then by centre: fits of equal quality get equal ids."""
    order = [
        r["prediction"]
        for r in metrics.centres(predicted, "prediction")
        .orderBy(F.col("size").desc(), "centre")
        .select("prediction")
        .collect()
    ]
    ids = F.create_map(*[F.lit(x) for new, old in enumerate(order) for x in (old, new)])
    return predicted.select(key, ids[F.col("prediction")].alias("cluster"))


def kmeans(
    df: DataFrame, key: str, k: int, seed: int = 42, n_init: int = 1, vector: str = "vector"
) -> tuple[DataFrame, float]:
    """I4: ``(key, cluster)`` and inertia of the best of ``n_init`` starts."""
    rows = _ml_rows(df, key, vector).persist(StorageLevel.MEMORY_AND_DISK)
    fits = [KMeans(k=k, seed=seed + i, featuresCol="features").fit(rows) for i in range(n_init)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    inertia = float(best.summary.trainingCost)
    # Written before the input is released: the labels are few bytes a row.
    out = materialised(_renumber(best.transform(rows), key))
    rows.unpersist()
    return out, inertia


def bisecting(df: DataFrame, key: str, k: int, seed: int = 42, vector: str = "vector") -> DataFrame:
    """Divisive hierarchical clustering; takes the place of an agglomerative one, which needs all
    pairwise distances in one place."""
    rows = _ml_rows(df, key, vector).persist(StorageLevel.MEMORY_AND_DISK)
    out = materialised(_renumber(BisectingKMeans(k=k, seed=seed, featuresCol="features").fit(rows).transform(rows), key))
    rows.unpersist()
    return out


def gaussian_mixtures(
    df: DataFrame, key: str, ks: Sequence[int], seed: int = 42, vector: str = "vector"
) -> dict[int, tuple[mixture.Mixture, list[float]]]:
    """I14 for several sizes at once, each started from k-means: mixture and log-likelihood of every round."""
    rows = materialised(df.select(key, vector))
    one = rows.select(key, F.lit(0).alias("cluster"))
    starts = {k: kmeans(rows, key, k, seed, vector=vector)[0] if k > 1 else one for k in ks}
    return mixture.fit_mixtures(rows, key, starts, vector)


def gaussian_mixture(
    df: DataFrame, key: str, k: int, seed: int = 42, vector: str = "vector"
) -> tuple[DataFrame, float, int]:
    """``(key, cluster, probability)``, log-likelihood and number of parameters (full covariance)."""
    fit, history = gaussian_mixtures(df, key, [k], seed, vector)[k]
    return mixture.memberships(df, key, fit, vector), history[-1], fit.parameters


def aic_curve(df: DataFrame, key: str, ks: Sequence[int], seed: int = 42, vector: str = "vector") -> DataFrame:
    """2 p - 2 log L per k, and the log-likelihood of the first round."""
    rows = []
    for k, (fit, history) in gaussian_mixtures(df, key, ks, seed, vector).items():
        rows.append((k, history[0], history[-1], fit.parameters, 2.0 * fit.parameters - 2.0 * history[-1]))
    return df.sparkSession.createDataFrame(
        rows, "k int, first_log_likelihood double, log_likelihood double, parameters int, aic double"
    )


def k_curve(
    df: DataFrame, key: str, ks: Sequence[int], seed: int = 42, n_init: int = 1, vector: str = "vector"
) -> DataFrame:
    """Inertia, silhouette, Calinski-Harabasz and Davies-Bouldin per k; one pass over the block
    pairs scores the labellings of all k.  The inertia is that of the labels, around the means of their clusters."""
    data = materialised(df.select(key, vector))
    fits = {k: kmeans(data, key, k, seed, n_init, vector) for k in ks}
    labels = [labels.select(F.lit(k).alias("k"), key, "cluster") for k, (labels, _) in fits.items()]
    labels = materialised(functools.reduce(DataFrame.unionByName, labels))
    mean = {r["k"]: r["silhouette"] for r in metrics.silhouettes(data, labels, key, "cluster", "k", vector).collect()}
    rows = []
    for k in fits:
        fitted = data.join(labels.filter(F.col("k") == k), key)
        ch = metrics.calinski_harabasz(fitted, "cluster", vector).first()
        rows.append((k, ch["within"], mean[k], ch["calinski_harabasz"], metrics.davies_bouldin(fitted, "cluster", vector)))
    return df.sparkSession.createDataFrame(
        rows, "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double"
    )


def curve_differences(curve: DataFrame, value: str = "inertia") -> DataFrame:
    """First drop and second difference along k; the curve has one row per k."""
    w = Window.orderBy("k")
    x, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    return curve.withColumns({"drop": before - x, "second_difference": before - 2 * x + after})


def choose_k(curve: DataFrame) -> DataFrame:
    """K by best silhouette, Calinski-Harabasz and Davies-Bouldin, and by the two elbow rules:
    A, the k after the largest drop of inertia; B, the k of the largest second difference."""
    bent = curve_differences(curve)
    first = F.struct  # ties go to the smaller k
    return bent.agg(
        F.max_by("k", first("silhouette", -F.col("k"))).alias("k_silhouette"),
        F.max_by("k", first("calinski_harabasz", -F.col("k"))).alias("k_calinski_harabasz"),
        F.min_by("k", first("davies_bouldin", "k")).alias("k_davies_bouldin"),
        F.max_by("k", F.when(F.col("drop").isNotNull(), first("drop", -F.col("k")))).alias("k_elbow_drop"),
        F.max_by(
            "k", F.when(F.col("second_difference").isNotNull(), first("second_difference", -F.col("k")))
        ).alias("k_elbow_bend"),
    )


def project_2d(df: DataFrame, labels: DataFrame, key: str, vector: str = "vector") -> tuple[DataFrame, list[float]]:
    """``(key, cluster, pc1, pc2)`` and the variance ratios of the two components."""
    points, ratios = vectors.pca(df, key, 2, vector)
    out = points.join(labels, key).select(
        *[c for c in labels.columns], F.col("vector")[0].alias("pc1"), F.col("vector")[1].alias("pc2")
    )
    return out, ratios


def compare(results: dict[str, tuple[DataFrame, DataFrame]], key: str, vector: str = "vector") -> DataFrame:
    """One row per approach: clusters and scores. ``results`` holds (vectors, labels) pairs."""
    rows = []
    for name, (data, labels) in results.items():
        fitted = data.join(labels, key).persist(StorageLevel.MEMORY_AND_DISK)
        ch = metrics.calinski_harabasz(fitted, "cluster", vector).first()
        rows.append(
            (
                name,
                ch["clusters"],
                metrics.silhouette(fitted, key, "cluster", vector),
                ch["calinski_harabasz"],
                metrics.davies_bouldin(fitted, "cluster", vector),
            )
        )
        fitted.unpersist()
    spark = next(iter(results.values()))[0].sparkSession
    return spark.createDataFrame(
        rows, "approach string, clusters bigint, silhouette double, calinski_harabasz double, davies_bouldin double"
    )


def enriched_customers(
    features: DataFrame, clusterings: dict[str, DataFrame], created_at: str, path: str | None = None
) -> DataFrame:
    """Features with a cluster id and a business label per approach, and provenance; written if asked."""
    out = features
    for approach, labels in clusterings.items():
        id_col, label_col = f"{approach}_cluster", f"{approach}_label"
        named = labels.withColumnRenamed("cluster", id_col)
        profiles = segments.cluster_profiles(features.join(named, "customer_id"), id_col, approach)
        names = segments.business_label(profiles, approach, label_col).select(id_col, label_col)
        out = segments.attach_labels(out, [named], "customer_id").join(names, id_col, "left")
    out = out.withColumns(
        {"clustering_created_at": F.lit(created_at), "clustering_approaches": F.lit(",".join(clusterings))}
    )
    if path:
        write_parquet(out, path)
    return out


def segment_on(df: DataFrame, key: str, columns: Sequence[str], k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Clusters on the given columns (nulls count as 0), and size, mean and median per cluster."""
    # Written: the scaling, the fit and the summary each read the columns.
    filled = materialised(df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]))
    scaled = standardise(filled, list(columns)).select(key, F.array(*columns).alias("vector"))
    labels, _ = kmeans(scaled, key, k, seed)
    return labels, segment_summary(filled.join(labels, key), "cluster", columns)


def segment_summary(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Size, mean and exact median of every column per cluster."""
    from basketry.functions import ranks

    long = ranks.melt(df, columns, [cluster])
    stats = long.groupBy(cluster, "column").agg(F.count(F.lit(1)).alias("size"), F.avg("value").alias("mean"))
    return stats.join(ranks.quantiles(long, {"median": 0.5}, [cluster, "column"]), [cluster, "column"])
