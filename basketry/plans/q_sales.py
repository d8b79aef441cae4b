"""Fact filters and sales figures."""

from pyspark.sql import functions as F

from basketry.operators import filters, sales
from basketry.plans.registry import query
from basketry.sources import views
from basketry.sources.views import with_views


def rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


RECENT = "recent AS (SELECT * FROM tx WHERE t_dat >= (SELECT max(t_dat) FROM tx) - INTERVAL 90 DAY)"


@query("b01_last_90_days", with_views("tx", "SELECT * FROM recent", RECENT))
def b01(spark, d):
    return views.transactions(spark, d, days=90)


@query(
    "b02_fact_statistics",
    with_views(
        "tx",
        """SELECT count(*) AS transactions, count(DISTINCT customer_id) AS customers, count(DISTINCT article_id) AS articles,
min(t_dat) AS first_date, max(t_dat) AS last_date, round(count(*) * 100.0 / (SELECT count(*) FROM tx), 4) AS retained_pct
FROM recent""",
        RECENT,
    ),
)
def b02(spark, d):
    tx = views.transactions(spark, d)
    return rounded(filters.retained_statistics(views.transactions(spark, d, days=90), tx), ["retained_pct"])


@query(
    "b03_referenced_dimension",
    with_views("tx cu", "SELECT cu.* FROM cu WHERE customer_id IN (SELECT customer_id FROM recent)", RECENT),
)
def b03(spark, d):
    recent = views.transactions(spark, d, days=90)
    return filters.keep_referenced(views.customers(spark, d), recent, "customer_id")


@query(
    "b04_retention",
    with_views(
        "tx ar",
        """SELECT b AS before, a AS "after", b - a AS removed, round(a * 100.0 / b, 4) AS kept_pct FROM
(SELECT (SELECT count(*) FROM ar) AS b, (SELECT count(*) FROM ar WHERE article_id IN (SELECT article_id FROM recent)) AS a)""",
        RECENT,
    ),
)
def b04(spark, d):
    ar = views.articles(spark, d)
    recent = views.transactions(spark, d, days=90)
    return rounded(filters.retention(ar, filters.keep_referenced(ar, recent, "article_id")), ["kept_pct"])


@query(
    "c04_active_facts",
    with_views(
        "tx",
        """SELECT customer_id, count(*) AS n, count(DISTINCT article_id) AS articles FROM tx
GROUP BY customer_id HAVING count(*) >= 30""",
    ),
)
def c04(spark, d):
    kept = filters.min_activity(views.transactions(spark, d), "customer_id", 30)
    return kept.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("article_id").alias("articles")
    )


OVERLAP = """a AS (SELECT DISTINCT customer_id FROM tx WHERE year(t_dat) = 1996),
b AS (SELECT DISTINCT customer_id FROM tx WHERE year(t_dat) = 1997)"""


@query(
    "c08_period_overlap",
    with_views(
        "tx",
        """SELECT s AS shared, l AS left_keys, r AS right_keys, round(s * 100.0 / l, 4) AS pct_of_left,
round(s * 100.0 / r, 4) AS pct_of_right FROM (SELECT (SELECT count(*) FROM a JOIN b USING (customer_id)) AS s,
(SELECT count(*) FROM a) AS l, (SELECT count(*) FROM b) AS r)""",
        OVERLAP,
    ),
)
def c08(spark, d):
    tx = views.transactions(spark, d)
    overlap = filters.key_overlap(
        tx.filter(F.year("t_dat") == 1996), tx.filter(F.year("t_dat") == 1997), "customer_id"
    )
    return rounded(overlap, ["pct_of_left", "pct_of_right"])


@query(
    "f01_intersect_customers",
    with_views("tx", "SELECT customer_id FROM a INTERSECT SELECT customer_id FROM b", OVERLAP),
)
def f01(spark, d):
    tx = views.transactions(spark, d)
    return (
        tx.filter(F.year("t_dat") == 1996)
        .select("customer_id")
        .intersect(tx.filter(F.year("t_dat") == 1997).select("customer_id"))
    )


DAILY = """daily AS (SELECT t_dat, count(*) AS transactions, sum(price) AS revenue,
 count(DISTINCT customer_id) AS customers, avg(price) AS average_value FROM tx GROUP BY t_dat)"""


@query(
    "d02_daily_sales",
    with_views(
        "tx",
        "SELECT t_dat, transactions, round(revenue, 2) AS revenue, customers, round(average_value, 8) AS average_value FROM daily",
        DAILY,
    ),
)
def d02(spark, d):
    return rounded(rounded(sales.daily(views.transactions(spark, d)), ["revenue"], 2), ["average_value"], 8)


@query(
    "e01_moving_average",
    with_views(
        "tx",
        """SELECT x.t_dat, round(x.revenue, 2) AS revenue, CASE WHEN count(y.t_dat) = 7 THEN round(avg(y.revenue), 2) END
 AS revenue_ma7 FROM n x JOIN n y ON y.i BETWEEN x.i - 6 AND x.i GROUP BY x.t_dat, x.revenue""",
        DAILY + ", n AS (SELECT *, row_number() OVER (ORDER BY t_dat) AS i FROM daily)",
    ),
)
def e01(spark, d):
    out = sales.moving_average(sales.daily(views.transactions(spark, d)))
    return rounded(out.select("t_dat", "revenue", "revenue_ma7"), ["revenue", "revenue_ma7"], 2)


TOTALS = """totals AS (SELECT customer_id, count(*) AS transactions, round(sum(price), 6) AS total_spend,
 avg(price) AS average_value, min(t_dat) AS first_date, max(t_dat) AS last_date,
 date_diff('day', min(t_dat), max(t_dat)) AS lifespan_days FROM tx GROUP BY customer_id)"""


@query(
    "d03_customer_totals",
    with_views(
        "tx",
        "SELECT * REPLACE (round(total_spend, 2) AS total_spend, round(average_value, 4) AS average_value) FROM totals",
        TOTALS,
    ),
)
def d03(spark, d):
    out = sales.customer_totals(views.transactions(spark, d))
    return rounded(rounded(out, ["total_spend"], 2), ["average_value"])


@query(
    "d04_customer_totals_summary",
    with_views(
        "tx",
        """SELECT count(*) AS customers, round(avg(transactions), 4) AS mean_transactions,
 max(transactions) AS max_transactions, round(avg(total_spend), 2) AS mean_spend, round(max(total_spend), 2) AS max_spend,
 round(avg(lifespan_days), 4) AS mean_lifespan, median(transactions) AS median_transactions,
 round(median(total_spend), 2) AS median_spend FROM totals""",
        TOTALS,
    ),
)
def d04(spark, d):
    out = sales.customer_totals_summary(sales.customer_totals(views.transactions(spark, d)))
    return rounded(
        rounded(out, ["mean_transactions", "mean_lifespan"]), ["mean_spend", "max_spend", "median_spend"], 2
    )


PATTERNS = """patterns AS (SELECT 'month' AS part, month(t_dat) AS position, count(*) AS transactions,
  sum(price) AS revenue, avg(price) AS mean_price FROM tx GROUP BY month(t_dat)
 UNION ALL SELECT 'weekday', isodow(t_dat), count(*), sum(price), avg(price) FROM tx GROUP BY isodow(t_dat))"""


@query(
    "d05_calendar_patterns",
    with_views(
        "tx",
        "SELECT * REPLACE (round(revenue, 2) AS revenue, round(mean_price, 4) AS mean_price) FROM patterns",
        PATTERNS,
    ),
)
def d05(spark, d):
    out = sales.calendar_patterns(views.transactions(spark, d))
    return rounded(rounded(out, ["revenue"], 2), ["mean_price"])


@query(
    "d05_calendar_peaks",
    with_views(
        "tx",
        """SELECT part, arg_max(position, revenue) AS peak, round(max(revenue), 2) AS peak_revenue,
 round((max(revenue) - min(revenue)) / avg(revenue) * 100, 4) AS variation_pct FROM patterns GROUP BY part""",
        PATTERNS,
    ),
)
def d05_peaks(spark, d):
    out = sales.calendar_peaks(sales.calendar_patterns(views.transactions(spark, d)))
    return rounded(rounded(out, ["peak_revenue"], 2), ["variation_pct"])


@query(
    "d06_business_figures",
    with_views(
        "tx",
        """SELECT round(r, 2) AS revenue, t AS transactions, c AS customers, a AS articles, p AS period_days,
 round(r / c, 4) AS revenue_per_customer, round(r / t, 4) AS revenue_per_transaction,
 round(t / c, 4) AS transactions_per_customer, round(r / p, 4) AS revenue_per_day, round(t / p, 4) AS transactions_per_day
FROM (SELECT sum(price) AS r, count(*) AS t, count(DISTINCT customer_id) AS c, count(DISTINCT article_id) AS a,
 date_diff('day', min(t_dat), max(t_dat)) + 1 AS p FROM tx)""",
    ),
)
def d06(spark, d):
    out = sales.business_figures(views.transactions(spark, d))
    return rounded(
        rounded(out, ["revenue"], 2),
        [
            "revenue_per_customer",
            "revenue_per_transaction",
            "transactions_per_customer",
            "revenue_per_day",
            "transactions_per_day",
        ],
    )


@query(
    "d07_top_articles",
    with_views(
        "tx",
        """SELECT article_id, round(sum(price), 2) AS revenue, count(*) AS transactions, round(avg(price), 4) AS average_price
FROM tx GROUP BY article_id ORDER BY round(sum(price), 6) DESC, article_id LIMIT 10""",
    ),
)
def d07(spark, d):
    out = sales.top_articles(views.transactions(spark, d))
    return rounded(rounded(out, ["revenue"], 2), ["average_price"])


@query(
    "d08_value_segments",
    with_views(
        "tx",
        """SELECT segment, count(*) AS customers, round(sum(total_spend), 2) AS revenue,
 round(avg(total_spend), 2) AS average_spend, round(avg(transactions), 4) AS average_transactions,
 round(count(*) * 100.0 / (SELECT count(*) FROM seg), 4) AS customer_pct,
 round(sum(total_spend) * 100 / (SELECT sum(total_spend) FROM seg), 4) AS revenue_pct FROM seg GROUP BY segment""",
        TOTALS
        + """, seg AS (SELECT *, CASE
  WHEN total_spend >= (SELECT quantile_cont(total_spend, 0.9) FROM totals) THEN 'High Value'
  WHEN total_spend >= (SELECT quantile_cont(total_spend, 0.7) FROM totals) THEN 'Medium Value'
  ELSE 'Low Value' END AS segment FROM totals)""",
    ),
)
def d08(spark, d):
    out = sales.value_segments(sales.customer_totals(views.transactions(spark, d)))
    return rounded(
        rounded(out, ["revenue", "average_spend"], 2), ["average_transactions", "customer_pct", "revenue_pct"]
    )


@query(
    "d09_purchase_insights",
    with_views(
        "tx",
        """SELECT round(count(*) FILTER (transactions > 1) * 100.0 / count(*), 4) AS repeat_pct,
 round(count(*) FILTER (total_spend >= (SELECT quantile_cont(total_spend, 0.8) FROM totals)) * 100.0 / count(*), 4) AS high_value_pct,
 (SELECT round(avg(CASE WHEN price >= m * 0.9 AND price <= m * 1.1 THEN 100.0 ELSE 0 END), 4)
  FROM tx, (SELECT median(price) AS m FROM tx)) AS near_median_pct FROM totals""",
        TOTALS,
    ),
)
def d09(spark, d):
    out = sales.purchase_insights(views.transactions(spark, d))
    return rounded(out, ["repeat_pct", "high_value_pct", "near_median_pct"])


@query(
    "d30_activity",
    with_views(
        "tx",
        """SELECT count(*) AS customers, sum(t)::BIGINT AS interactions, sum(a)::BIGINT AS pairs, round(avg(t), 4) AS mean_transactions,
 max(t) AS max_transactions, round(avg(a), 4) AS mean_articles, max(a) AS max_articles,
 (SELECT count(DISTINCT article_id) FROM tx) AS articles,
 round(1 - sum(a) / (count(*) * (SELECT count(DISTINCT article_id) FROM tx)), 6) AS sparsity
FROM (SELECT customer_id, count(*) AS t, count(DISTINCT article_id) AS a FROM tx GROUP BY customer_id)""",
    ),
)
def d30(spark, d):
    out = sales.activity(views.transactions(spark, d))
    return rounded(rounded(out, ["mean_transactions", "mean_articles"]), ["sparsity"], 6)


GROUPS = """grp AS (SELECT product_group_name, count(*) AS transactions, round(sum(price), 2) AS revenue
 FROM tx JOIN ar USING (article_id) GROUP BY product_group_name)"""


def _group_sales(spark, d):
    joined = views.transactions(spark, d).join(views.articles(spark, d), "article_id")
    return joined.groupBy("product_group_name").agg(
        F.count(F.lit(1)).alias("transactions"), F.round(F.sum("price"), 2).alias("revenue")
    )


@query(
    "e03_cumulative_share",
    with_views(
        "tx ar",
        """SELECT g.product_group_name, g.transactions, round(g.transactions * 100.0 / (SELECT sum(transactions) FROM grp), 4) AS share,
 (SELECT sum(h.transactions) FROM grp h WHERE h.transactions > g.transactions OR
   (h.transactions = g.transactions AND h.product_group_name <= g.product_group_name))::BIGINT AS running FROM grp g""",
        GROUPS,
    ),
)
def e03(spark, d):
    out = sales.with_shares(_group_sales(spark, d).drop("revenue"), {"transactions": "share"})
    return rounded(
        sales.with_cumulative(out, "transactions", "running", "product_group_name"), ["share"]
    )


@query(
    "e04_share_of_total",
    with_views(
        "tx ar",
        """SELECT product_group_name, transactions, revenue, round(revenue * 100 / (SELECT sum(revenue) FROM grp), 4) AS revenue_pct
FROM grp""",
        GROUPS,
    ),
)
def e04(spark, d):
    return rounded(sales.with_shares(_group_sales(spark, d), {"revenue": "revenue_pct"}), ["revenue_pct"])


@query("f02_multi_key_sort", with_views("tx", "SELECT * FROM tx ORDER BY customer_id, t_dat, article_id"))
def f02(spark, d):
    return filters.multi_sort(views.transactions(spark, d), "customer_id", "t_dat", "article_id")


@query(
    "f03_top_k_by_size",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20",
)
def f03(spark, d):
    c = views.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return filters.top_k(c, F.abs("c_acctbal"), 20, "c_custkey")


@query(
    "g01_date_parts",
    with_views(
        "tx",
        """SELECT year(t_dat) AS y, quarter(t_dat) AS q, month(t_dat) AS m, isodow(t_dat) AS wd, count(*) AS n,
 min(date_diff('day', t_dat, DATE '2001-12-31')) AS nearest_days FROM tx GROUP BY ALL""",
    ),
)
def g01(spark, d):
    day = F.col("t_dat")
    return (
        views.transactions(spark, d)
        .groupBy(
            F.year(day).alias("y"),
            F.quarter(day).alias("q"),
            F.month(day).alias("m"),
            (F.weekday(day) + 1).alias("wd"),
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.datediff(F.lit("2001-12-31").cast("date"), day)).alias("nearest_days"),
        )
    )
