"""Customer features kept up to date by versions of new transactions.

The state is three Parquet tables in one folder, each partitioned by version and by a bucket of customers:

``totals``    what one version adds to a customer: last date, purchases, spend, moments of the price
``counts``    what it adds to a customer's purchases per category
``features``  the features, without recency, of the customers it touched, complete as of that version

The first two hold partial aggregates that merge in any split of the days, so adding a version writes its own partials,
reads the partials of the customers it touched, and writes their features.  A version is overwritten as a whole:
repeating a refresh that was cut off gives the same state, and no version is ever changed by a later one.
Days are expected in any order and split; a transaction belongs to exactly one version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators.features import PROFILE_KINDS, behaviour_of, category_counts, profile_of

#: Folders of customers per version; a refresh opens those of the customers it touched.
BUCKETS = 32


def totals(transactions: DataFrame) -> DataFrame:
    """Partial aggregates per customer: ``(customer_id, first_date, last_date, frequency, monetary, priced, mean, m2)``.

    ``m2`` is the sum of squared gaps from the mean; two of them merge without losing digits.
    """
    return transactions.groupBy("customer_id").agg(
        F.min("t_dat").alias("first_date"),
        F.max("t_dat").alias("last_date"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum("price").alias("monetary"),
        F.count("price").alias("priced"),
        F.coalesce(F.avg("price"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop("price") * F.count("price"), F.lit(0.0)).alias("m2"),
    )


def _merged_moments(parts: Column) -> Column:
    """Fold of (priced, mean, m2) structs: the parallel update of mean and squared gaps."""

    def add(a: Column, b: Column) -> Column:
        n = a["priced"] + b["priced"]
        gap = b["mean"] - a["mean"]
        both = F.struct(
            n.alias("priced"),
            (a["mean"] + gap * b["priced"] / n).alias("mean"),
            (a["m2"] + b["m2"] + gap * gap * a["priced"] * b["priced"] / n).alias("m2"),
        )
        return F.when(b["priced"] == 0, a).otherwise(both)

    start = F.struct(F.lit(0).cast("bigint").alias("priced"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(parts, start, add)


def merge_totals(parts: DataFrame) -> DataFrame:
    """One row per customer from any number of partial rows; a customer has one row per version it appears in."""
    moments = F.sort_array(F.collect_list(F.struct("first_date", "last_date", "priced", "mean", "m2")))
    moments = F.transform(moments, lambda m: F.struct(m["priced"].alias("priced"), m["mean"].alias("mean"), m["m2"].alias("m2")))
    merged = parts.groupBy("customer_id").agg(
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.sum("frequency").alias("frequency"),
        F.sum("monetary").alias("monetary"),
        _merged_moments(moments).alias("moments"),
    )
    return merged.select("customer_id", "first_date", "last_date", "frequency", "monetary", "moments.*")


def merge_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("customer_id", "kind", "category").agg(F.sum("n").alias("n"))


def features_of(merged: DataFrame, counts: DataFrame) -> DataFrame:
    """Features of D15 without what depends on the reference day, from merged partials."""
    deviation = F.sqrt(F.try_divide(F.col("m2"), F.nullif(F.col("priced") - 1, F.lit(0))))
    scores = behaviour_of(profile_of(counts, list(PROFILE_KINDS)))
    return merged.join(scores, "customer_id", "left").select(
        "customer_id",
        "first_date",
        "last_date",
        "frequency",
        "monetary",
        "purchase_diversity_score",
        F.when(F.col("priced") > 1, F.try_divide(deviation, F.col("mean"))).alias("price_sensitivity_index"),
        "colour_preference_entropy",
        "style_consistency_score",
    )


def _write(df: DataFrame, path: str, table: str, version: int) -> T.StructType:
    """Write one version of a table; returns the schema of all its versions."""
    bucket = F.pmod(F.xxhash64("customer_id"), F.lit(BUCKETS)).cast("int")
    rows = df.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "customer_id")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{table}/version={version}")
    return T.StructType([*df.schema.fields, T.StructField("version", T.IntegerType()), T.StructField("bucket", T.IntegerType())])


def read(spark: SparkSession, path: str, table: str, version: int | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A table of the state, up to a version, with its columns ``version`` and ``bucket``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(f"{path}/{table}")
    return rows if version is None else rows.filter(F.col("version") <= version)


def refresh(path: str, version: int, transactions: DataFrame, articles: DataFrame) -> DataFrame:
    """Add the transactions of one version and return the new features of the customers they touch.

    Versions count up. Only the partials of touched customers are read: their buckets by folder, their rows by a
    semi-join. What a version holds does not depend on the size of the history.
    """
    spark = transactions.sparkSession
    schemas = {
        "totals": _write(totals(transactions), path, "totals", version),
        "counts": _write(category_counts(transactions, articles, PROFILE_KINDS), path, "counts", version),
    }
    new = read(spark, path, "totals", version, schemas["totals"]).filter(F.col("version") == version)
    touched = new.select("customer_id", "bucket")
    # At most BUCKETS numbers: they choose the folders to open.
    buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]

    def history(table: str) -> DataFrame:
        rows = read(spark, path, table, version, schemas[table]).filter(F.col("bucket").isin(buckets))
        return rows.join(touched.select("customer_id"), "customer_id", "left_semi").drop("version", "bucket")

    schema = _write(features_of(merge_totals(history("totals")), merge_counts(history("counts"))), path, "features", version)
    return read(spark, path, "features", version, schema).filter(F.col("version") == version).drop("version", "bucket")


def current_features(path: str, customers: DataFrame, version: int | None = None) -> DataFrame:
    """D15 from the state: one row per customer, with the defaults of customers without purchases.

    The newest row of each customer counts; recency and its default come from the days seen so far.
    """
    spark = customers.sparkSession
    rows = read(spark, path, "features", version).drop("bucket")
    newest = rows.groupBy("customer_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "version"]), "version").alias("row"))
    newest = newest.select("row.*")
    days = newest.agg(F.struct(F.max("last_date").alias("last"), F.min("first_date").alias("first")).alias("days")).scalar()
    reference = F.date_add(days["last"], 1)
    recency = F.when(F.col("last_date").isNotNull(), F.greatest(F.datediff(reference, "last_date"), F.lit(1)))
    return customers.select("customer_id").join(newest, "customer_id", "left").select(
        "customer_id",
        F.coalesce(recency, F.datediff(reference, days["first"]) + 1).cast("long").alias("recency"),
        F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"),
        *[
            F.coalesce(c, F.lit(0.0)).alias(c)
            for c in ("monetary", "purchase_diversity_score", "price_sensitivity_index", "colour_preference_entropy")
        ],
        F.coalesce("style_consistency_score", F.lit(1.0)).alias("style_consistency_score"),
        reference.cast("string").alias("rfm_reference_date"),
    )


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Merge all versions into version 0 of a state in a new folder; later refreshes go on there from version 1."""
    merged, counts = merge_totals(read(spark, path, "totals")), merge_counts(read(spark, path, "counts"))
    parts = []
    for table, rows in (("totals", merged), ("counts", counts)):
        schema = _write(rows, to, table, 0)
        parts.append(read(spark, to, table, 0, schema).drop("version", "bucket"))
    _write(features_of(*parts), to, "features", 0)
