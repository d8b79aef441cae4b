"""Scans, sinks and schema handling."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import cleaning
from basketry.plans.q_cleaning import ARTICLE_STEPS, CUSTOMER_STEPS, TRANSACTION_STEPS
from basketry.plans.registry import query
from basketry.session import shared_folder
from basketry.sources import tables, views
from basketry.sources.views import with_views


@query("a01_parquet_scan", "SELECT p_partkey, p_retailprice FROM part")
def a01(spark, d):
    return tables.read_parquet(spark, f"{d}/part.parquet").select("p_partkey", "p_retailprice")


@query(
    "a02_csv_round_trip",
    with_views(
        "tx",
        """SELECT t_dat, customer_id, article_id, price, sales_channel_id::BIGINT AS sales_channel_id FROM tx""",
    ),
)
def a02(spark, d):
    """A6 then A2 with an explicit schema, then the date parse of G2."""
    path = tables.write_csv(views.transactions(spark, d), shared_folder(spark, "transactions") + ".csv")
    out = tables.read_table(spark, path, tables.TRANSACTIONS_CSV)
    return out.withColumns({"t_dat": F.to_date("t_dat"), "customer_id": F.col("customer_id").cast("bigint")})


@query("a03_first_rows", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50")
def a03(spark, d):
    c = views.table(spark, d, "customer").select("c_custkey", "c_name")
    return tables.first_rows(c, 50, ["c_custkey"])


@query("a04_read_by_suffix", "SELECT s_suppkey, s_acctbal FROM supplier")
def a04(spark, d):
    return tables.read_table(spark, f"{d}/supplier.parquet").select("s_suppkey", "s_acctbal")


@query("a05_parquet_round_trip", with_views("ar", "SELECT * FROM ar"))
def a05(spark, d):
    path = tables.write_parquet(views.articles(spark, d), shared_folder(spark, "articles") + ".parquet")
    return tables.read_table(spark, path)


@query(
    "a07_json_round_trip",
    "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY o_orderstatus",
)
def a07(spark, d):
    report = (
        views.table(spark, d, "orders")
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    )
    path = tables.write_json(report, shared_folder(spark, "report") + ".json")
    return spark.read.schema("o_orderstatus string, n bigint, mean_price double").json(path)


@query("a08_required_columns", with_views("cu", "SELECT customer_id, age FROM cu"))
def a08(spark, d):
    return tables.require_columns(views.customers(spark, d), ["customer_id", "age"], "customers").select(
        "customer_id", "age"
    )


@query(
    "a09_columns_by_rule",
    with_views("ar", "SELECT prod_name, product_group_name, garment_group_name, colour_group_name, product_type_name FROM ar"),
)
def a09(spark, d):
    df = views.articles(spark, d)
    return df.select(*tables.categorical_columns(df, exclude=["article_id"]))


@query("a10_file_information", "SELECT 'orders.parquet' AS file_name, 'parquet' AS file_type, true AS has_bytes, true AS dated FROM orders LIMIT 1")
def a10(spark, d):
    found = tables.file_information(views.table(spark, d, "orders"))
    dated = F.col("file_modification_time") <= F.current_timestamp()
    # A table may also be a folder of part files.
    name = F.when(F.col("file_name").startswith("part-"), "orders.parquet").otherwise(F.col("file_name"))
    return found.groupBy(name.alias("file_name"), "file_type").agg(F.every(F.col("file_size") > 0).alias("has_bytes"), F.every(dated).alias("dated"))


@query("a12_random_sample", "SELECT c_custkey, c_acctbal FROM customer ORDER BY md5(c_custkey || ':42'), c_custkey LIMIT 100")
def a12(spark, d):
    return tables.random_sample(views.table(spark, d, "customer"), 100, "c_custkey").select("c_custkey", "c_acctbal")


@query(
    "a13_vector_round_trip",
    "SELECT vec_id, "
    + ", ".join(f"embedding[{i + 1}]::DOUBLE AS svd_{i + 1:03d}" for i in range(64))
    + " FROM embeddings",
)
def a13(spark, d):
    e = views.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    wide = tables.unpack_vector(e, "vec_id", "svd_", 64)
    return tables.unpack_vector(tables.pack_vector(wide, "vec_id", "svd_"), "vec_id", "svd_", 64)


def _column_values(source, columns):
    """Filled cells per column, and the sum of the numbers or flags in it."""
    return " UNION ALL ".join(
        f"""SELECT '{source}' AS name, '{c}' AS "column", count({c}) AS filled, round({f"sum({c}::DOUBLE)" if numeric else "NULL::DOUBLE"}, 2) AS total FROM {source}"""
        for c, numeric in columns.items()
    )


_TRANSACTIONS = dict(t_dat=0, customer_id=1, article_id=1, price=1, sales_channel_id=1, price_outlier_capped=1, sales_channel_corrected=1, price_percentile_calibrated=1)
_CUSTOMERS = dict(customer_id=1, FN=1, Active=1, club_member_status=0, fashion_news_frequency=0, age=1, postal_code=0)
_CUSTOMERS |= {f"{c}_imputed": 1 for c in list(_CUSTOMERS)[1:]} | dict(age_corrected=1)
_ARTICLES = dict(article_id=1, product_code=1, prod_name=0, detail_desc=0, product_type_no=1, graphical_appearance_no=1, product_type_name=0, colour_group_name=0)
_ARTICLES |= dict(product_type_no_negative_fixed=1, graphical_appearance_no_negative_fixed=1, product_code_invalid=1)
_CLEANED = {"transactions": ("rtx", TRANSACTION_STEPS, _TRANSACTIONS), "customers": ("rcu", CUSTOMER_STEPS, _CUSTOMERS), "articles": ("rar", ARTICLE_STEPS, _ARTICLES)}


@query(
    "a14_write_cleaned_tables",
    "WITH "
    + ", ".join(f"{n} AS ({with_views(view, 'SELECT * FROM cleaned', steps)})" for n, (view, steps, _) in _CLEANED.items())
    + " "
    + " UNION ALL ".join(_column_values(n, columns) for n, (_, _, columns) in _CLEANED.items())
    + """ UNION ALL SELECT 'cleaning_report', 'customers_rows_before', 1, (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_custkey % 10 = 0)""",
)
def a14(spark, d):
    paths = cleaning.clean_all(
        views.raw_transactions(spark, d), views.raw_customers(spark, d), views.raw_articles(spark, d), shared_folder(spark, "cleaned"), write_csv_too=True
    )
    parts = []
    for name, (_, _, columns) in _CLEANED.items():
        # The text copies must say the same as the columnar ones.
        table = tables.read_table(spark, paths[f"{name}_{'csv' if name == 'customers' else 'parquet'}"])
        cells = [
            F.struct(F.lit(c).alias("column"), F.count(c).alias("filled"), (F.round(F.sum(F.col(c).cast("double")), 2) if numeric else F.lit(None).cast("double")).alias("total"))
            for c, numeric in columns.items()
        ]
        parts.append(table.agg(F.array(*cells).alias("cells")).select(F.lit(name).alias("name"), F.explode("cells").alias("c")).select("name", "c.*"))
    report = spark.read.json(paths["cleaning_report"]).filter("dataset = 'customers' AND category = 'rows' AND column = 'before'")
    parts.append(report.select(F.lit("cleaning_report").alias("name"), F.lit("customers_rows_before").alias("column"), F.lit(1).cast("long").alias("filled"), F.col("count").cast("double").alias("total")))
    return functools.reduce(DataFrame.unionByName, parts)
