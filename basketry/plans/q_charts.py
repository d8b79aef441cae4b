"""Tables behind charts."""

import functools
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import charts
from basketry.plans.q_profiling import LINE_COLUMNS, OUTLIER_CTES
from basketry.plans.registry import query
from basketry.sources import views
from basketry.sources.views import with_views


def rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def histogram_sql(bins, where=""):
    return f"""SELECT bin, round(lo + bin * w, 4) AS start, round(lo + (bin + 1) * w, 4) AS "end", count(*) AS n FROM
(SELECT least(floor((price - lo) / w), {bins - 1})::BIGINT AS bin, lo, w FROM (SELECT price FROM tx {where}),
 (SELECT min(price) AS lo, (max(price) - min(price)) / {bins} AS w FROM tx {where})) GROUP BY bin, lo, w"""


@query("k01_histogram", with_views("tx", histogram_sql(50)))
def k01(spark, d):
    return rounded(charts.histogram(views.transactions(spark, d), "price", 50), ["start", "end"])


@query(
    "k01_histogram_cut",
    with_views("tx", histogram_sql(100, "WHERE price <= (SELECT quantile_cont(price, 0.95) FROM tx)")),
)
def k01_cut(spark, d):
    return rounded(charts.histogram(views.transactions(spark, d), "price", 100, 0.95), ["start", "end"])


def box_sql(key):
    group = f"GROUP BY {key}" if key else ""
    using = f"JOIN q USING ({key})" if key else ", q"
    return f"""SELECT {key + "," if key else ""} 'price' AS "column", round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
 min(price) FILTER (price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
 max(price) FILTER (price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER (NOT price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM j {using} GROUP BY ALL""", f"""j AS (SELECT tx.*, garment_group_name FROM tx JOIN ar USING (article_id)),
q AS (SELECT {key + "," if key else ""} quantile_cont(price, 0.25) AS q1, median(price) AS median,
 quantile_cont(price, 0.75) AS q3 FROM j {group})"""


@query("k02_box_statistics", with_views("tx ar", *box_sql("")))
def k02(spark, d):
    return rounded(charts.box_statistics(views.transactions(spark, d), "price"), ["q1", "median", "q3"])


@query("k02_box_statistics_by_group", with_views("tx ar", *box_sql("garment_group_name")))
def k02_by(spark, d):
    joined = views.transactions(spark, d).join(views.articles(spark, d), "article_id")
    return rounded(charts.box_statistics(joined, "price", ["garment_group_name"]), ["q1", "median", "q3"])


@query(
    "k03_qq_points",
    with_views(
        "tx",
        " UNION ALL ".join(
            f"SELECT {p}::DOUBLE AS p, {z!r}::DOUBLE AS normal, round(quantile_cont(price, {p}), 4) AS sample FROM tx"
            for p, z in charts.normal_grid(50)
        ),
    ),
)
def k03(spark, d):
    return rounded(charts.qq_points(views.transactions(spark, d), "price"), ["sample"])


@query(
    "k04_density_curve",
    """SELECT point, round(x, 4) AS x, round(sum(exp(-0.5 * ((x - c_acctbal) / h) * ((x - c_acctbal) / h))) / (n * h * sqrt(2 * pi())), 10) AS density
FROM customer, (SELECT (i)::INT AS point, lo - (hi - lo) / 2 + i * (2 * (hi - lo) / 49) AS x, h, n FROM
 (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, stddev_samp(c_acctbal) * count(*) ** (-0.2) AS h, count(*) AS n FROM customer),
 range(50) t(i)) GROUP BY point, x, h, n""",
)
def k04(spark, d):
    out = charts.density_curve(views.table(spark, d, "customer"), "c_acctbal")
    return rounded(rounded(out, ["x"]), ["density"], 10)


LINES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pairs_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {source}" for a, b in combinations(columns, 2)
    )


@query("k05_correlation_pearson", pairs_sql("lineitem", LINES))
def k05(spark, d):
    return rounded(charts.correlation(views.table(spark, d, "lineitem"), LINES), ["r"], 6)


_RANKS = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in LINES
)


@query("k05_correlation_spearman", f"WITH rk AS (SELECT {_RANKS} FROM lineitem) " + pairs_sql("rk", LINES))
def k05_spearman(spark, d):
    return rounded(charts.correlation(views.table(spark, d, "lineitem"), LINES, "spearman"), ["r"], 6)


@query(
    "k05_correlation_kendall",
    """WITH p AS (SELECT c_acctbal AS x, c_nationkey AS y, c_custkey AS k FROM customer),
s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) AS n0, count(*) FILTER (a.x = b.x) AS n1,
 count(*) FILTER (a.y = b.y) AS n2 FROM p a JOIN p b ON a.k < b.k)
SELECT 'c_acctbal' AS a, 'c_nationkey' AS b, round(s / sqrt((n0 - n1)::DOUBLE * (n0 - n2)), 6) AS r FROM s""",
)
def k05_kendall(spark, d):
    out = charts.correlation(views.table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "kendall")
    return rounded(out, ["r"], 6)


PARTS = ["p_partkey", "p_size", "p_retailprice"]


@query("k06_strong_pairs", f"SELECT * FROM ({pairs_sql('part', PARTS)}) WHERE abs(r) > 0.3")
def k06(spark, d):
    return rounded(charts.strong_pairs(charts.correlation(views.table(spark, d, "part"), PARTS)), ["r"], 6)


@query(
    "k07_time_series",
    with_views("tx", "SELECT CAST(date_trunc('week', t_dat) AS DATE) AS period, round(sum(price), 2) AS price FROM tx GROUP BY 1"),
)
def k07(spark, d):
    return rounded(charts.time_series(views.transactions(spark, d), "t_dat", "price", "W"), ["price"], 2)


@query(
    "e02_rolling_band",
    with_views(
        "tx",
        """SELECT x.period, round(x.price, 2) AS price, CASE WHEN count(*) = 20 THEN round(avg(y.price), 2) END AS rolling_mean,
 CASE WHEN count(*) = 20 THEN round(stddev_samp(y.price), 2) END AS rolling_std,
 CASE WHEN count(*) = 20 THEN round(avg(y.price) + stddev_samp(y.price), 2) END AS upper,
 CASE WHEN count(*) = 20 THEN round(avg(y.price) - stddev_samp(y.price), 2) END AS lower
FROM s x JOIN s y ON y.i BETWEEN x.i - 19 AND x.i GROUP BY x.period, x.price""",
        """s AS (SELECT *, row_number() OVER (ORDER BY period) AS i FROM
 (SELECT CAST(date_trunc('month', t_dat) AS DATE) AS period, sum(price) AS price FROM tx GROUP BY 1))""",
    ),
)
def e02(spark, d):
    series = charts.time_series(views.transactions(spark, d), "t_dat", "price", "M")
    out = charts.rolling_band(series, "price")
    return rounded(out, ["price", "rolling_mean", "rolling_std", "upper", "lower"], 2)


def _unpivot(report, item, table, metrics):
    return [f"SELECT '{report}' AS report, {item}::VARCHAR AS item, '{name}' AS metric, round(({expression})::DOUBLE, 4) AS value FROM {table}" for name, expression in metrics.items()]


def bundle_sql():
    """All reports of the bundle over the order lines as (report, item, metric, value)."""
    outliers = ["outliers_iqr", "outliers_zscore", "outliers_modified", "outliers_percentile"]
    parts = _unpivot("outliers", '"column"', "summary", {m: m for m in [*outliers, "mean", "median", "mad"]})
    for c in LINE_COLUMNS:
        ends = f"SELECT min({c}) AS lo, (max({c}) - min({c})) / 50 AS w FROM lineitem"
        table = f"(SELECT least(floor(({c} - lo) / w), 49)::BIGINT AS bin, count(*) AS n FROM lineitem, ({ends}) GROUP BY 1)"
        parts += _unpivot(f"histogram_{c}", "bin", table, {"n": "n"})
        profile = {"nulls": f"count(*) - count({c})", "distinct_values": f"count(DISTINCT {c})", "mean": f"avg({c})", "std": f"stddev_samp({c})", "median": f"median({c})"}
        parts += _unpivot("profile", f"'{c}'", "lineitem GROUP BY ALL", profile)
        parts += _unpivot("segmentation", f"'{c}'", "lineitem GROUP BY ALL", {"clusters": "max(5)", "size": "count(*)", "mean": f"avg({c})", "share_pct": "max(100)"})
    for a, b in combinations(LINE_COLUMNS, 2):
        parts += _unpivot("correlation", f"'{a}|{b}'", "lineitem GROUP BY ALL", {"r": f"corr({a}, {b})"})
    days = "(SELECT CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1)"
    parts += _unpivot("time_series", "strftime(d, '%Y-%m-%d')", days, {"value": "s"})
    return f"WITH {OUTLIER_CTES} " + " UNION ALL ".join(parts)


@query("k09_eda_bundle", bundle_sql())
def k09(spark, d):
    lines = views.table(spark, d, "lineitem").select("l_shipdate", *LINE_COLUMNS)
    bundle = charts.eda_bundle(lines, "l_shipdate", "l_extendedprice")

    def long(report, table, item, metrics):
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(F.col(m).cast("double"), 4).alias("value")) for m in metrics])
        return table.select(F.lit(report).alias("report"), item.cast("string").alias("item"), F.explode(cells).alias("c")).select("report", "item", "c.*")

    named = F.col("column")
    outliers = ["outliers_iqr", "outliers_zscore", "outliers_modified", "outliers_percentile"]
    parts = [long("outliers", bundle["outliers"], named, [*outliers, "mean", "median", "mad"])]
    profile = bundle["profile"].filter(F.col("column").isin(LINE_COLUMNS) & F.col("metric").isin("nulls", "distinct_values", "mean", "std", "median"))
    parts.append(profile.select(F.lit("profile").alias("report"), named.alias("item"), "metric", F.round(F.col("value").cast("double"), 4).alias("value")))
    parts += [long(r, t, F.col("bin"), ["n"]) for r, t in bundle.items() if r.startswith("histogram")]
    # Clusters differ between implementations, what they add up to does not.
    total = F.sum("size")
    whole = bundle["segmentation"].groupBy("column").agg(
        F.count(F.lit(1)).alias("clusters"), total.alias("size"), (F.sum(F.col("size") * F.col("mean")) / total).alias("mean"), F.sum("share_pct").alias("share_pct")
    )
    parts.append(long("segmentation", whole, named, ["clusters", "size", "mean", "share_pct"]))
    parts.append(long("correlation", bundle["correlation"], F.concat_ws("|", "a", "b"), ["r"]))
    series = bundle["time_series"].withColumnRenamed("l_extendedprice", "value")
    parts.append(long("time_series", series, F.col("period"), ["value"]))
    return functools.reduce(DataFrame.unionByName, parts)
