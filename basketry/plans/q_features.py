"""Customer features (C1, C3, D11-D15, D16, D35) and sampling of customers."""

from pyspark.sql import functions as F

from basketry.operators import features, profiling
from basketry.plans.registry import query
from basketry.sources import views
from basketry.sources.views import with_views


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "c01_attribute_lookup",
    with_views(
        "tx ar",
        """SELECT garment_group_name, count(*) AS n, round(sum(price), 2) AS revenue
FROM tx LEFT JOIN ar USING (article_id) GROUP BY garment_group_name""",
    ),
)
def c01(spark, d):
    joined = features.attach_attributes(
        views.transactions(spark, d), views.articles(spark, d), ["garment_group_name"]
    )
    return joined.groupBy("garment_group_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("revenue")
    )


RFM = """SELECT customer_id, greatest(date_diff('day', max(t_dat), (SELECT max(t_dat) FROM tx) + 1), 1) AS recency,
 count(*) AS frequency, round(sum(price), 4) AS monetary FROM tx GROUP BY customer_id"""


@query("d11_rfm", with_views("tx", RFM))
def d11(spark, d):
    return _rounded(features.rfm(views.transactions(spark, d)), ["monetary"], 4)


def entropy_sql(column):
    return f"""SELECT customer_id, abs(-sum(p * log2(p))) AS h, count(*) AS k FROM (
  SELECT customer_id, n / sum(n) OVER (PARTITION BY customer_id) AS p FROM (
    SELECT customer_id, {column}, count(*) AS n FROM tx JOIN ar USING (article_id)
    WHERE {column} IS NOT NULL GROUP BY customer_id, {column})) GROUP BY customer_id"""


@query(
    "d12_category_entropy",
    with_views(
        "tx ar",
        "SELECT g.customer_id, round(g.h, 6) + 0.0 AS diversity, round(c.h, 6) + 0.0 AS colour FROM g JOIN c USING (customer_id)",
        f"g AS ({entropy_sql('product_group_name')}), c AS ({entropy_sql('colour_group_name')})",
    ),
)
def d12(spark, d):
    p = features.category_profile(
        views.transactions(spark, d),
        views.articles(spark, d),
        {"group": "product_group_name", "colour": "colour_group_name"},
    )
    return p.select(
        "customer_id",
        F.round("group_entropy", 6).alias("diversity"),
        F.round("colour_entropy", 6).alias("colour"),
    )


@query(
    "d13_price_sensitivity",
    with_views(
        "tx",
        """SELECT customer_id, round(stddev_samp(price) / avg(price), 6) AS price_sensitivity_index
FROM tx GROUP BY customer_id HAVING count(*) > 1""",
    ),
)
def d13(spark, d):
    return _rounded(features.price_sensitivity(views.transactions(spark, d)), ["price_sensitivity_index"])


CONSISTENCY = """CASE WHEN k = 1 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - h / log2(k))) END"""


@query(
    "d14_style_consistency",
    with_views(
        "tx ar",
        f"SELECT customer_id, round({CONSISTENCY}, 6) AS style_consistency_score FROM s",
        f"s AS ({entropy_sql('garment_group_name')})",
    ),
)
def d14(spark, d):
    p = features.category_profile(
        views.transactions(spark, d), views.articles(spark, d), {"garment": "garment_group_name"}
    )
    score = features.consistency(F.col("garment_entropy"), F.col("garment_categories"))
    return p.select("customer_id", F.round(score, 6).alias("style_consistency_score"))


FEATURE_EXTRA = f"""rfm AS ({RFM}),
ps AS (SELECT customer_id, stddev_samp(price) / avg(price) AS v FROM tx GROUP BY customer_id HAVING count(*) > 1),
eg AS ({entropy_sql('product_group_name')}), ec AS ({entropy_sql('colour_group_name')}),
es AS ({entropy_sql('garment_group_name')}),
feat AS (SELECT cu.customer_id,
 coalesce(rfm.recency, (SELECT date_diff('day', min(t_dat), max(t_dat)) + 2 FROM tx)) AS recency,
 coalesce(frequency, 0) AS frequency, round(coalesce(monetary, 0), 4) AS monetary,
 round(coalesce(eg.h, 0), 6) AS purchase_diversity_score, round(coalesce(ps.v, 0), 6) AS price_sensitivity_index,
 round(coalesce(ec.h, 0), 6) AS colour_preference_entropy,
 round(coalesce(CASE WHEN es.k = 1 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - es.h / log2(es.k))) END, 1.0), 6)
   AS style_consistency_score,
 CAST((SELECT max(t_dat) + 1 FROM tx) AS VARCHAR) AS rfm_reference_date
 FROM cu LEFT JOIN rfm USING (customer_id) LEFT JOIN ps USING (customer_id) LEFT JOIN eg USING (customer_id)
 LEFT JOIN ec USING (customer_id) LEFT JOIN es USING (customer_id))"""


ROUND_FEATURES = {
    "monetary": 4,
    "purchase_diversity_score": 6,
    "price_sensitivity_index": 6,
    "colour_preference_entropy": 6,
    "style_consistency_score": 6,
}


def feature_table(spark, d):
    """Rounded feature table, the input of the segmentation queries."""
    out = features.customer_features(
        views.transactions(spark, d), views.customers(spark, d), views.articles(spark, d)
    )
    return out.withColumns({c: F.round(c, n) for c, n in ROUND_FEATURES.items()})


@query("d15_customer_features", with_views("tx ar cu", "SELECT * FROM feat", FEATURE_EXTRA))
def d15(spark, d):
    return feature_table(spark, d)


# The same features over the last 90 days, where most customers have no purchase (C3 fills).
@query(
    "c03_features_with_gaps",
    with_views(
        "tx ar cu",
        "SELECT * FROM feat",
        "allx AS (SELECT * FROM tx WHERE t_dat >= (SELECT max(t_dat) FROM tx) - 90),\n"
        + FEATURE_EXTRA.replace("FROM tx", "FROM allx"),
    ),
)
def c03(spark, d):
    out = features.customer_features(
        views.transactions(spark, d, days=90), views.customers(spark, d), views.articles(spark, d)
    )
    return out.withColumns({c: F.round(c, n) for c, n in ROUND_FEATURES.items()})


@query(
    "a11_customer_sample",
    with_views(
        "tx cu",
        """SELECT customer_id, count(*) AS n, round(sum(price), 2) AS spend FROM tx
WHERE customer_id IN (SELECT customer_id FROM cu ORDER BY customer_id LIMIT 100) GROUP BY customer_id""",
    ),
)
def a11(spark, d):
    _, facts = features.sample_customers(views.customers(spark, d), views.transactions(spark, d), 100)
    return facts.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("spend")
    )


_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
 round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
 count(*) - count({c}) AS nulls, count(*) AS customers, count(*) FILTER (frequency > 0) AS active,
 round(count(*) FILTER (frequency > 0) / count(*), 4) AS active_rate FROM feat"""
    for c in features.FEATURES
)


@query("d16_feature_summary", with_views("tx ar cu", _SUMMARY, FEATURE_EXTRA))
def d16(spark, d):
    out = profiling.feature_summary(feature_table(spark, d), features.FEATURES)
    return _rounded(out, ["mean", "median", "std", "min", "max", "active_rate"], 4)


@query(
    "d35_key_quality",
    with_views(
        "rcu",
        """SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS distinct_keys, count(*) - count(customer_id) AS null_keys,
 count(*) = count(DISTINCT customer_id) AS unique_keys FROM rcu""",
    ),
)
def d35(spark, d):
    return profiling.key_quality(views.raw_customers(spark, d), "customer_id")
