"""Categorical encoding, scaling and combination with embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import ranks
from basketry.operators.profiling import melt_text
from basketry.operators.text import svd
from basketry.sources.tables import columns_like

# Candidate attributes in order of relevance.
CATEGORICAL_FEATURES = (
    "product_type_name",
    "product_group_name",
    "colour_group_name",
    "department_name",
    "garment_group_name",
    "perceived_colour_value_name",
    "perceived_colour_master_name",
    "graphical_appearance_name",
    "index_name",
    "section_name",
)
METADATA_COLUMNS = (
    "product_group_name",
    "department_name",
    "section_name",
    "garment_group_name",
    "colour_group_name",
    "graphical_appearance_name",
)
ONE_HOT_LIMIT = 15


def distinct_counts(df: DataFrame, columns: Sequence[str], count_null: bool = False) -> dict[str, int]:
    """Distinct values per column from one aggregation over (column, value) pairs."""
    values = melt_text(df, columns)
    if not count_null:
        values = values.filter(F.col("value").isNotNull())
    table = values.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    found = {r["column"]: r["n"] for r in table.collect()}
    return {c: found.get(c, 0) for c in columns}


def select_categorical(df: DataFrame, candidates: Sequence[str] = CATEGORICAL_FEATURES) -> list[str]:
    """Candidates that exist and have more than one distinct value."""
    present = [c for c in candidates if c in df.columns]
    counts = distinct_counts(df, present, count_null=True) if present else {}
    return [c for c in present if counts[c] > 1]


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, code)``, values numbered alphabetically from 0; null counts as "Unknown"."""
    values = melt_text(df, columns).select("column", F.coalesce("value", F.lit("Unknown")).alias("value"))
    distinct = ranks.value_counts(values, ["column"]).withColumn("n", F.least("n", F.lit(1)))
    return ranks.running_counts(distinct, ["column"]).select("column", "value", F.col("below").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_encoded`` for every column."""
    if not columns:
        return df
    codes = label_codes(df, columns)
    for c in columns:
        mine = codes.filter(F.col("column") == c).select(
            F.col("value").alias(f"{c}__value"), F.col("code").cast("double").alias(f"{c}_encoded")
        )
        value = F.coalesce(F.col(c).cast("string"), F.lit("Unknown"))
        df = df.withColumn(f"{c}__value", value).join(mine, f"{c}__value", "left").drop(f"{c}__value")
    return df


def one_hot(df: DataFrame, columns: Sequence[str], drop_first: bool = True) -> tuple[DataFrame, list[str]]:
    """0/1 columns per value in alphabetical order, null last, the first value dropped."""
    values = melt_text(df, columns).distinct().orderBy("column", F.col("value").asc_nulls_last()).collect()
    made: dict[str, Column] = {}
    for c in columns:
        for v in [r["value"] for r in values if r["column"] == c][1 if drop_first else 0 :]:
            made[f"{c}_{v}"] = F.col(c).cast("string").eqNullSafe(v).cast("double")
    return df.withColumns(made), list(made)


def encode_categorical(df: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One-hot up to 15 values, label codes beyond."""
    counts = distinct_counts(df, columns)
    low = [c for c in columns if counts[c] <= ONE_HOT_LIMIT]
    high = [c for c in columns if counts[c] > ONE_HOT_LIMIT]
    out, names = one_hot(df.select(key, *columns), low) if low else (df.select(key, *columns), [])
    names = names + [f"{c}_encoded" for c in high]
    return label_encode(out, high).select(key, *[F.col(f"`{n}`") for n in names]), names


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population variance; a constant column only loses its mean."""
    stats = df.agg(
        *[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        scale = stats[f"s{i}"] or 1.0
        scaled[c] = (F.col(f"`{c}`").cast("double") - F.lit(stats[f"m{i}"])) / F.lit(float(scale))
    return df.withColumns(scaled)


def join_on_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows present in both."""
    return left.join(right, key)


def combined_features(
    embeddings: DataFrame, articles: DataFrame, key: str = "article_id", prefix: str = "svd_"
) -> tuple[DataFrame, list[str]]:
    """Embedding columns and encoded attributes, all standardised, with the feature names."""
    wide = columns_like(embeddings, prefix=prefix)
    if not wide:
        raise ValueError(f"no embedding columns start with {prefix!r}")
    encoded, names = encode_categorical(articles, key, select_categorical(articles))
    joined = join_on_key(embeddings.select(key, *wide), encoded, key)
    return standardise(joined, [*wide, *names]), [*wide, *names]


def feature_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The feature list as a table."""
    return df.sparkSession.createDataFrame(list(enumerate(names)), "position int, feature string")


def with_metadata(
    embeddings: DataFrame, articles: DataFrame, key: str = "article_id", columns: Sequence[str] | None = None
) -> DataFrame:
    """Embeddings beside raw attributes, default attributes where none are given."""
    chosen = [c for c in (columns or METADATA_COLUMNS) if c in articles.columns]
    return join_on_key(embeddings, articles.select(key, *chosen), key)


def categorical_vectors(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """H17, first step: every value of every column as one position of a sparse vector."""
    filled = df.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c) for c in columns])
    index = [f"{c}__i" for c in columns]
    hot = [f"{c}__h" for c in columns]
    stages = [
        StringIndexer(inputCols=list(columns), outputCols=index, stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False),
        VectorAssembler(inputCols=hot, outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(filled).transform(filled).select(key, "features")


def categorical_svd(
    df: DataFrame, key: str, columns: Sequence[str], limit: int = 50
) -> tuple[DataFrame, np.ndarray]:
    """One-hot, at most ``limit`` and one less than the width components, unit rows."""
    vectors = categorical_vectors(df, key, columns)
    width = vectors.first()["features"].size
    if width < 2:
        raise ValueError("one-hot encoding gives fewer than two columns")
    out, singular, _ = svd(vectors, key, min(limit, width - 1))
    return out, singular
