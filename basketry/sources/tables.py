"""Scans, sinks and schema handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS_CSV = T.StructType(
    [
        T.StructField("t_dat", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("article_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("sales_channel_id", T.LongType()),
    ]
)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A1."""
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A2: header row; types come from ``schema`` or, failing that, an extra inference pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A4: choose the reader by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return read_parquet(spark, path)
    if suffix == "csv":
        return read_csv(spark, path, schema)
    raise ValueError(f"unsupported file type {suffix!r}: use .csv or .parquet")


def first_rows(df: DataFrame, n: int, order_by: Sequence[str] = ()) -> DataFrame:
    """A3: the first ``n`` rows, by key where a reproducible choice matters."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """A5."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """A6."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """Report tables as JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def require_columns(df: DataFrame, required: Sequence[str], name: str = "table") -> DataFrame:
    """Raise with the names of missing columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks required columns: {', '.join(missing)}")
    return df


def columns_like(
    df: DataFrame,
    prefix: str | None = None,
    suffix: str | tuple[str, ...] | None = None,
    types: tuple[type, ...] | None = None,
) -> list[str]:
    """Column names by prefix, suffix and type."""
    return [
        f.name
        for f in df.schema.fields
        if (prefix is None or f.name.startswith(prefix))
        and (suffix is None or f.name.endswith(suffix))
        and (types is None or isinstance(f.dataType, types))
    ]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = (), max_distinct: int = 100) -> list[str]:
    """Text and boolean columns; without any, integer columns with few distinct values."""
    named = [c for c in columns_like(df, types=(T.StringType, T.BooleanType)) if c not in exclude]
    if named:
        return named
    whole = [c for c in columns_like(df, types=(T.IntegralType,)) if c not in exclude]
    if not whole:
        return []
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in whole]).first()
    return [c for c in whole if counts[c] <= max_distinct]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_like(df, types=(T.NumericType,))


def file_information(df: DataFrame) -> DataFrame:
    """A10: name, size, type and modification time of the files behind a scanned table."""
    meta = df.select("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time")
    return meta.distinct().withColumn("file_type", F.element_at(F.split("file_name", r"\."), -1))


def seeded_key(key: Column, seed: int) -> Column:
    """Portable pseudo-random sort key: the same rows are drawn on every run and every engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all), drawn by hashed key."""
    return df.orderBy(seeded_key(F.col(key), seed), key).limit(n)


def pack_vector(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Wide embedding columns to one array per id."""
    wide = sorted(columns_like(df, prefix=prefix))
    return df.select(key, F.array(*[F.col(c).cast("double") for c in wide]).alias("vector"))


def unpack_vector(df: DataFrame, key: str, prefix: str, size: int, vector: str = "vector") -> DataFrame:
    """One array per id to wide columns ``<prefix>001`` onward."""
    return df.select(key, *[F.col(vector)[i].alias(f"{prefix}{i + 1:03d}") for i in range(size)])


def write_cleaned(
    tables: dict[str, DataFrame], output_dir: str, write_csv_too: bool = False
) -> dict[str, str]:
    """Write every cleaned table and return where each went."""
    paths = {}
    for name, df in tables.items():
        paths[name] = write_parquet(df, f"{output_dir}/{name}_cleaned.parquet")
        if write_csv_too:
            paths[f"{name}_csv"] = write_csv(df, f"{output_dir}/{name}_cleaned.csv")
    return paths
