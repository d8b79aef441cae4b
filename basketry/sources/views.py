"""The three retail tables, derived from the order-line tables, plus variants with defects.

``transactions``, ``customers`` and ``articles`` are clean; the ``raw_*`` variants carry the nulls,
invalid codes and duplicate rows that the cleaning operators repair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.filters import last_days


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str, days: int | None = None) -> DataFrame:
    """All transactions, or those of the last ``days`` before the newest date.

    The date is cut from a time stamp, so the bound is put on the stored column, where the scan of the facts takes it.
    """
    lines = table(spark, sf_dir, "lineitem")
    if days is not None:
        lines = last_days(lines, days, "l_shipdate")
    orders = table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_shipdate").cast("date").alias("t_dat"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("article_id"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("sales_channel_id"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("article_id"),
        (F.col("p_partkey") * 97).alias("product_code"),
        F.col("p_name").alias("prod_name"),
        F.col("p_brand").alias("product_group_name"),
        F.col("p_type").alias("garment_group_name"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("colour_group_name"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("product_type_name"),
        F.col("p_size").alias("product_type_no"),
        (F.col("p_size") % 7).alias("graphical_appearance_no"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("customer_id"),
        F.when(key % 3 == 0, 0.0).otherwise(1.0).alias("FN"),
        F.when(key % 4 == 0, 0.0).otherwise(1.0).alias("Active"),
        F.col("c_mktsegment").alias("club_member_status"),
        F.when(F.col("c_nationkey") < 12, "Regularly").otherwise("NONE").alias("fashion_news_frequency"),
        (14 + key % 90).alias("age"),
        F.col("c_nationkey").cast("string").alias("postal_code"),
        F.col("c_acctbal").alias("balance"),
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text dates (one in 41 unreadable), null keys, null prices, bad channels."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    mix = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    part = F.col("l_partkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.when(mix % 41 == 0, "not a date")
        .when(mix % 43 == 0, None)
        .otherwise(F.col("l_shipdate").cast("date").cast("string"))
        .alias("t_dat"),
        F.when(mix % 37 == 0, None).otherwise(F.col("o_custkey")).alias("customer_id"),
        F.when(mix % 59 == 0, None).otherwise(part).alias("article_id"),
        F.when(mix % 23 == 0, None)
        .otherwise(F.col("l_extendedprice") / 1_000_000)
        .alias("price"),
        F.when(part % 29 == 0, None)
        .when(part % 31 == 0, 9)
        .when(F.col("l_linestatus") == "F", 1)
        .otherwise(2)
        .alias("sales_channel_id"),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null attributes, out-of-range ages, one customer in ten twice."""
    base = customers(spark, sf_dir)
    key = F.col("customer_id")
    dirty = base.select(
        key,
        F.when(key % 3 == 0, None).otherwise(F.col("FN")).alias("FN"),
        F.when(key % 4 == 0, None).otherwise(F.col("Active")).alias("Active"),
        F.when(key % 7 == 0, None).otherwise(F.col("club_member_status")).alias("club_member_status"),
        F.when(key % 11 == 0, None)
        .otherwise(F.col("fashion_news_frequency"))
        .alias("fashion_news_frequency"),
        F.when(key % 13 == 0, None).otherwise(F.col("age")).alias("age"),
        F.when(key % 17 == 0, None).otherwise(F.col("postal_code")).alias("postal_code"),
    )
    return dirty.unionAll(dirty.filter(key % 10 == 0))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null names and codes, negative codes, one article in eight twice."""
    base = articles(spark, sf_dir)
    key = F.col("article_id")
    dirty = base.select(
        key,
        F.when(key % 19 == 0, None).otherwise(F.col("product_code")).alias("product_code"),
        F.when(key % 7 == 0, None).otherwise(F.col("prod_name")).alias("prod_name"),
        F.when(key % 5 == 0, None).otherwise(F.col("prod_name")).alias("detail_desc"),
        F.when(key % 13 == 0, -1)
        .when(key % 11 == 0, None)
        .otherwise(F.col("product_type_no"))
        .alias("product_type_no"),
        F.when(key % 17 == 0, -1).otherwise(F.col("graphical_appearance_no")).alias(
            "graphical_appearance_no"
        ),
        F.when(key % 9 == 0, None).otherwise(F.col("product_type_name")).alias("product_type_name"),
        F.when(key % 14 == 0, None).otherwise(F.col("colour_group_name")).alias("colour_group_name"),
    )
    return dirty.unionAll(dirty.filter(key % 8 == 0))


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as article descriptions, some missing and some with the sentinel text."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.alias("article_id"),
        F.when(doc % 11 == 0, None)
        .when(doc % 17 == 0, " No_Description ")
        .otherwise(F.col("text"))
        .alias("detail_desc"),
    )


# The same tables for DuckDB, as common table expressions.
CTE = {
    "tx": """tx AS (SELECT CAST(l_shipdate AS DATE) AS t_dat, o_custkey AS customer_id, l_partkey AS article_id,
  l_extendedprice AS price, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS sales_channel_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "ar": """ar AS (SELECT p_partkey AS article_id, p_partkey * 97 AS product_code, p_name AS prod_name,
  p_brand AS product_group_name, p_type AS garment_group_name, split_part(p_name, ' ', 1) AS colour_group_name,
  split_part(p_name, ' ', 2) AS product_type_name, p_size AS product_type_no, p_size % 7 AS graphical_appearance_no
  FROM part)""",
    "cu": """cu AS (SELECT c_custkey AS customer_id, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS FN,
  CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS Active, c_mktsegment AS club_member_status,
  CASE WHEN c_nationkey < 12 THEN 'Regularly' ELSE 'NONE' END AS fashion_news_frequency,
  14 + c_custkey % 90 AS age, CAST(c_nationkey AS VARCHAR) AS postal_code, c_acctbal AS balance FROM customer)""",
    "rtx": """rtx0 AS (SELECT *, l_orderkey * 7 + l_linenumber AS mix FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rtx AS (SELECT CASE WHEN mix % 41 = 0 THEN 'not a date' WHEN mix % 43 = 0 THEN NULL
    ELSE strftime(l_shipdate, '%Y-%m-%d') END AS t_dat,
  CASE WHEN mix % 37 = 0 THEN NULL ELSE o_custkey END AS customer_id,
  CASE WHEN mix % 59 = 0 THEN NULL ELSE l_partkey END AS article_id,
  CASE WHEN mix % 23 = 0 THEN NULL ELSE l_extendedprice / 1000000 END AS price,
  CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN 9
    WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS sales_channel_id FROM rtx0)""",
    "rcu": """rcu0 AS (SELECT c_custkey AS customer_id,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1.0::DOUBLE END AS FN,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1.0::DOUBLE END AS Active,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS club_member_status,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_nationkey < 12 THEN 'Regularly' ELSE 'NONE' END AS fashion_news_frequency,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 14 + c_custkey % 90 END AS age,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS postal_code FROM customer),
rcu AS (SELECT * FROM rcu0 UNION ALL SELECT * FROM rcu0 WHERE customer_id % 10 = 0)""",
    "rar": """rar0 AS (SELECT p_partkey AS article_id, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_partkey * 97 END AS product_code,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS prod_name,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS detail_desc,
  CASE WHEN p_partkey % 13 = 0 THEN -1 WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS product_type_no,
  CASE WHEN p_partkey % 17 = 0 THEN -1 ELSE p_size % 7 END AS graphical_appearance_no,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END AS product_type_name,
  CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE split_part(p_name, ' ', 1) END AS colour_group_name FROM part),
rar AS (SELECT * FROM rar0 UNION ALL SELECT * FROM rar0 WHERE article_id % 8 = 0)""",
    "rtext": """rtext AS (SELECT doc_id AS article_id, CASE WHEN doc_id % 11 = 0 THEN NULL
  WHEN doc_id % 17 = 0 THEN ' No_Description ' ELSE "text" END AS detail_desc FROM documents)""",
}


def with_views(names: str, body: str, extra: str = "") -> str:
    """SQL text: the named views, optional further expressions, then ``body``."""
    parts = [CTE[n] for n in names.split()]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body
