"""Behaviour over time, baskets and channels."""

from pyspark.sql import functions as F

from basketry.operators import behaviour
from basketry.plans.registry import query
from basketry.sources import views
from basketry.sources.views import with_views


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _horizon_sql(w):
    here = f"FILTER (age < {w})"
    return f"""count(*) {here} AS frequency_{w}d, round(count(*) {here} / nullif(count(DISTINCT t_dat) {here}, 0), 6) AS basket_size_{w}d,
 round(stddev_samp(price) {here} / avg(price) {here}, 6) AS sensitivity_{w}d"""


@query(
    "p04_horizon_features",
    with_views(
        "tx",
        f"""SELECT customer_id, {', '.join(_horizon_sql(w) for w in behaviour.HORIZONS)}
FROM (SELECT *, date_diff('day', t_dat, (SELECT max(t_dat) FROM tx)) AS age FROM tx) GROUP BY customer_id""",
    ),
)
def p04(spark, d):
    out = behaviour.horizon_features(views.transactions(spark, d))
    return rounded(out, [c for c in out.columns if c.startswith(("basket", "sens"))])


@query(
    "p05_activity",
    with_views(
        "tx",
        """SELECT customer_id, recency, round(percent_rank() OVER (ORDER BY recency), 6) AS recency_percentile, round(per_month, 6) AS per_month,
 round(gap_mean, 6) AS gap_mean, round(gap_std, 6) AS gap_std, round(spend_volatility, 4) AS spend_volatility, round(late_share, 6) AS late_share
FROM per JOIN gap USING (customer_id)""",
        """span AS (SELECT customer_id, min(t_dat) AS f, max(t_dat) AS l FROM tx GROUP BY customer_id),
per AS (SELECT customer_id, greatest(date_diff('day', max(l), (SELECT max(t_dat) + 1 FROM tx)), 1)::INT AS recency,
  count(*) / greatest((date_diff('day', max(f), max(l)) + 1) / 30.4375::DOUBLE, 1.0) AS per_month, stddev_samp(price) AS spend_volatility,
  count(*) FILTER (2 * date_diff('day', f, t_dat) > date_diff('day', f, l)) / count(*) AS late_share FROM tx JOIN span USING (customer_id) GROUP BY customer_id),
gap AS (SELECT customer_id, avg(g) AS gap_mean, stddev_samp(g) AS gap_std FROM (SELECT customer_id,
  date_diff('day', lag(t_dat) OVER (PARTITION BY customer_id ORDER BY t_dat), t_dat) AS g FROM (SELECT DISTINCT customer_id, t_dat FROM tx)) GROUP BY customer_id)""",
    ),
)
def p05(spark, d):
    out = behaviour.activity_features(views.transactions(spark, d))
    out = rounded(out, ["recency_percentile", "per_month", "gap_mean", "gap_std", "late_share"])
    return rounded(out, ["spend_volatility"], 4)


@query(
    "p06_baskets_and_seasons",
    with_views(
        "tx ar",
        """SELECT customer_id, round(weekend_ratio, 6) AS weekend_ratio, (SELECT min(q) FROM qs WHERE qs.customer_id = c.customer_id AND qs.n = qs.best) AS peak_quarter,
 (SELECT min(m) FROM ms WHERE ms.customer_id = c.customer_id AND ms.n = ms.best) AS peak_month, round(items_per_day, 6) AS items_per_day, most_items,
 round(spend_per_day, 8) AS spend_per_day, round(cross_category_ratio, 6) AS cross_category_ratio FROM c JOIN b USING (customer_id)""",
        """t AS (SELECT tx.*, product_group_name FROM tx LEFT JOIN ar USING (article_id)),
c AS (SELECT customer_id, count(*) FILTER (dayofweek(t_dat) IN (0, 6)) / count(*) AS weekend_ratio FROM t GROUP BY customer_id),
day AS (SELECT customer_id, t_dat, count(*) AS n, sum(price) AS spend, count(DISTINCT product_group_name) AS k FROM t GROUP BY ALL),
b AS (SELECT customer_id, avg(n) AS items_per_day, max(n) AS most_items, avg(spend) AS spend_per_day,
  count(*) FILTER (k > 1) / count(*) AS cross_category_ratio FROM day GROUP BY customer_id),
qs AS (SELECT *, max(n) OVER (PARTITION BY customer_id) AS best FROM (SELECT customer_id, quarter(t_dat)::INT AS q, count(*) AS n FROM t GROUP BY ALL)),
ms AS (SELECT *, max(n) OVER (PARTITION BY customer_id) AS best FROM (SELECT customer_id, month(t_dat)::INT AS m, count(*) AS n FROM t GROUP BY ALL))""",
    ),
)
def p06(spark, d):
    out = behaviour.basket_features(views.transactions(spark, d), views.articles(spark, d))
    out = rounded(out, ["weekend_ratio", "items_per_day", "cross_category_ratio"])
    return rounded(out, ["spend_per_day"], 8)


@query(
    "p08_channels",
    with_views(
        "tx",
        """SELECT customer_id, round(online_ratio, 6) AS online_ratio, multi_channel, switches, runs, longest_run FROM r JOIN o USING (customer_id)""",
        """v AS (SELECT customer_id, t_dat, sales_channel_id AS ch FROM tx GROUP BY ALL),
s AS (SELECT *, coalesce(ch <> lag(ch) OVER w, false)::INT AS sw FROM v WINDOW w AS (PARTITION BY customer_id ORDER BY t_dat, ch)),
i AS (SELECT *, sum(sw) OVER (PARTITION BY customer_id ORDER BY t_dat, ch) AS run FROM s),
g AS (SELECT customer_id, run, count(*) AS visits, sum(sw) AS sw FROM i GROUP BY ALL),
r AS (SELECT customer_id, sum(sw)::BIGINT AS switches, count(*) AS runs, max(visits) AS longest_run FROM g GROUP BY customer_id),
o AS (SELECT customer_id, count(*) FILTER (sales_channel_id = 2) / count(*) AS online_ratio, count(DISTINCT sales_channel_id) > 1 AS multi_channel
  FROM tx GROUP BY customer_id)""",
    ),
)
def p08(spark, d):
    return rounded(behaviour.channel_features(views.transactions(spark, d)), ["online_ratio"])


@query(
    "p09_loyalty",
    with_views(
        "tx ar",
        """SELECT customer_id, round((count(*) - count(DISTINCT f)) / count(*), 6) AS family_loyalty, count(DISTINCT f) AS explored,
 round(count(*) FILTER (pop) / count(*), 6) AS popular_alignment FROM t GROUP BY customer_id""",
        """best AS (SELECT article_id FROM tx GROUP BY article_id ORDER BY count(DISTINCT customer_id) DESC, article_id LIMIT 100),
t AS (SELECT customer_id, product_type_name AS f, article_id IN (SELECT article_id FROM best) AS pop FROM tx JOIN ar USING (article_id))""",
    ),
)
def p09(spark, d):
    out = behaviour.loyalty_features(views.transactions(spark, d), views.articles(spark, d))
    return rounded(out, ["family_loyalty", "popular_alignment"])
