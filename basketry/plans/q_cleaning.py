"""Cleaning and repair (B5-B33, C6, F4-type conversions)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators import cleaning, filters
from basketry.plans.registry import query
from basketry.sources import views
from basketry.sources.views import with_views


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "b05_missing_key_counts",
    with_views(
        "rtx",
        """SELECT count(*) FILTER (t_dat IS NULL) AS dropped_t_dat,
 count(*) FILTER (t_dat IS NOT NULL AND customer_id IS NULL) AS dropped_customer_id,
 count(*) FILTER (t_dat IS NOT NULL AND customer_id IS NOT NULL AND article_id IS NULL) AS dropped_article_id FROM rtx""",
    ),
)
def b05_counts(spark, d):
    return cleaning.missing_key_counts(views.raw_transactions(spark, d))


KEYED = "k AS (SELECT * FROM rtx WHERE t_dat IS NOT NULL AND customer_id IS NOT NULL AND article_id IS NOT NULL)"
MEDIANS = "med AS (SELECT article_id, median(price) AS m FROM k GROUP BY article_id)"
FILLED = """filled AS (SELECT t_dat, customer_id, k.article_id, coalesce(price, m) AS price, sales_channel_id
 FROM k LEFT JOIN med USING (article_id))"""


@query("b05_drop_missing_keys", with_views("rtx", "SELECT * FROM k", KEYED))
def b05(spark, d):
    return cleaning.drop_missing_keys(views.raw_transactions(spark, d))


@query(
    "b06_fill_group_median",
    with_views(
        "rtx",
        "SELECT t_dat, customer_id, article_id, round(price, 10) AS price, sales_channel_id FROM filled",
        ",\n".join([KEYED, MEDIANS, FILLED]),
    ),
)
def b06(spark, d):
    keyed = cleaning.drop_missing_keys(views.raw_transactions(spark, d))
    return rounded(cleaning.fill_with_group_median(keyed, "article_id", "price"), ["price"], 10)


@query(
    "c06_group_statistic_joined_back",
    with_views(
        "tx",
        """SELECT t_dat, customer_id, article_id, price, round(median(price) OVER (PARTITION BY article_id), 4) AS group_median
FROM tx""",
    ),
)
def c06(spark, d):
    tx = views.transactions(spark, d)
    medians = cleaning.group_median(tx, "article_id", "price")
    out = tx.join(medians, "article_id").drop("sales_channel_id")
    return rounded(out, ["group_median"], 4)


MODE = """(SELECT sales_channel_id FROM {t} WHERE sales_channel_id IS NOT NULL {w}
 GROUP BY sales_channel_id ORDER BY count(*) DESC, sales_channel_id LIMIT 1)"""


@query(
    "b07_fill_mode",
    with_views(
        "rtx",
        f"""SELECT coalesce(sales_channel_id, {MODE.format(t="rtx", w="")}) AS sales_channel_id, count(*) AS n
FROM rtx GROUP BY 1""",
    ),
)
def b07(spark, d):
    filled = cleaning.fill_with_mode(views.raw_transactions(spark, d), "sales_channel_id")
    return filled.groupBy("sales_channel_id").agg(F.count(F.lit(1)).alias("n"))


B08 = """SELECT customer_id, coalesce(FN, 0) AS FN, coalesce(Active, 0) AS Active,
 coalesce(club_member_status, 'NONE') AS club_member_status,
 coalesce(fashion_news_frequency, 'NONE') AS fashion_news_frequency, coalesce(postal_code, 'NONE') AS postal_code,
 FN IS NULL AS "FN_imputed", Active IS NULL AS "Active_imputed", club_member_status IS NULL AS club_member_status_imputed,
 fashion_news_frequency IS NULL AS fashion_news_frequency_imputed, postal_code IS NULL AS postal_code_imputed"""


@query("b08_fill_constants", with_views("rcu", B08 + ", age FROM rcu"))
def b08(spark, d):
    return cleaning.fill_with_constants(views.raw_customers(spark, d))


@query(
    "b09_fill_median_age",
    with_views(
        "rcu",
        """SELECT customer_id, coalesce(age, (SELECT median(age) FROM rcu))::DOUBLE AS age, age IS NULL AS age_imputed FROM rcu""",
    ),
)
def b09(spark, d):
    return cleaning.fill_with_median(views.raw_customers(spark, d).select("customer_id", "age"), "age")


B10 = """SELECT article_id, coalesce(product_code, 0) AS product_code, coalesce(prod_name, 'UNKNOWN') AS prod_name,
 coalesce(detail_desc, 'NO_DESCRIPTION') AS detail_desc, coalesce(product_type_no, 0) AS product_type_no,
 coalesce(graphical_appearance_no, 0) AS graphical_appearance_no,
 coalesce(product_type_name, 'UNKNOWN') AS product_type_name, coalesce(colour_group_name, 'UNKNOWN') AS colour_group_name"""


@query("b10_fill_articles", with_views("rar", B10 + " FROM rar"))
def b10(spark, d):
    return cleaning.fill_articles(views.raw_articles(spark, d))


@query(
    "b11_cap_prices",
    with_views(
        "rtx",
        """SELECT customer_id, article_id, CASE WHEN price < 0.003542 THEN 0.003542 WHEN price > 0.061847 THEN 0.061847
 ELSE price END AS price, price < 0.003542 OR price > 0.061847 AS price_outlier_capped FROM rtx""",
    ),
)
def b11(spark, d):
    df = views.raw_transactions(spark, d).select("customer_id", "article_id", "price")
    return cleaning.treat_price_outliers(df)


@query(
    "b12_remove_price_outliers",
    with_views(
        "rtx",
        """SELECT customer_id, article_id, price, false AS price_outlier_capped FROM rtx
WHERE price BETWEEN 0.003542 AND 0.084729""",
    ),
)
def b12(spark, d):
    df = views.raw_transactions(spark, d).select("customer_id", "article_id", "price")
    return cleaning.treat_price_outliers(df, "remove")


@query(
    "b13_repair_negative_codes",
    with_views(
        "rar",
        """SELECT article_id, CASE WHEN product_type_no < 0 THEN 0 ELSE product_type_no END AS product_type_no,
 coalesce(product_type_no < 0, false) AS product_type_no_negative_fixed FROM rar""",
    ),
)
def b13(spark, d):
    df = views.raw_articles(spark, d).select("article_id", "product_type_no")
    return cleaning.repair_negative_codes(df, ["product_type_no"])


@query(
    "b14_repair_channel",
    with_views(
        "rtx",
        f"""SELECT customer_id, article_id, CASE WHEN sales_channel_id IN (1, 2) THEN sales_channel_id ELSE
 {MODE.format(t="rtx", w="AND sales_channel_id IN (1, 2)")} END AS sales_channel_id,
 NOT sales_channel_id IN (1, 2) AS sales_channel_corrected FROM rtx""",
    ),
)
def b14(spark, d):
    df = views.raw_transactions(spark, d).select("customer_id", "article_id", "sales_channel_id")
    return cleaning.repair_domain(df, "sales_channel_id", (1, 2), "sales_channel_corrected")


@query(
    "b15_repair_age",
    with_views(
        "rcu",
        """SELECT customer_id, CASE WHEN age BETWEEN 16 AND 100 THEN age ELSE
 (SELECT median(age) FROM rcu WHERE age BETWEEN 16 AND 100) END::DOUBLE AS age,
 NOT age BETWEEN 16 AND 100 AS age_corrected FROM rcu""",
    ),
)
def b15(spark, d):
    df = views.raw_customers(spark, d).select("customer_id", "age")
    return cleaning.repair_range(df, "age", 16, 100, "age_corrected")


@query(
    "b16_flag_product_code",
    with_views(
        "rar",
        "SELECT article_id, product_code, NOT product_code BETWEEN 100000 AND 999999 AS product_code_invalid FROM rar",
    ),
)
def b16(spark, d):
    df = views.raw_articles(spark, d).select("article_id", "product_code")
    return cleaning.flag_range(df, "product_code", 100000, 999999, "product_code_invalid")


@query(
    "b17_ensure_flags",
    with_views("cu", "SELECT customer_id, false AS age_corrected, false AS age_imputed FROM cu"),
)
def b17(spark, d):
    df = views.customers(spark, d).select("customer_id")
    return cleaning.ensure_flags(df, age_corrected=False, age_imputed=False)


def calibrated_sql(source):
    """Price calibration over a table ``source`` with a price column, written as a join to its knots."""
    targets = ", ".join(f"({q}, {t})" for q, t in cleaning.TARGET_PRICES.items())
    return f"""srt AS (SELECT price, row_number() OVER (ORDER BY price) - 1 AS i, count(*) OVER () AS n
 FROM {source} WHERE price IS NOT NULL),
tgt(q, y) AS (VALUES {targets}),
kq AS (SELECT price AS x, y FROM tgt JOIN srt ON i = floor(q * (n - 1) + 0.5)),
ends AS (SELECT min(price) AS lo, max(price) AS hi FROM {source}),
kn AS (SELECT * FROM kq UNION ALL
 SELECT lo, 2.99 * 0.8 FROM ends WHERE lo < (SELECT min(x) FROM kq) UNION ALL
 SELECT hi, 149.99 * 1.2 FROM ends WHERE hi > (SELECT max(x) FROM kq)),
knots AS (SELECT x, min(y) AS y_in, max(y) AS y_out FROM kn GROUP BY x),
segs AS (SELECT x AS x0, y_out AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y_in) OVER (ORDER BY x) AS y1 FROM knots),
cal AS (SELECT s.* EXCLUDE (price), CASE WHEN s.price IS NOT NULL THEN
  round_even(greatest(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (s.price - x0) * (y1 - y0) / (x1 - x0) END, 0.99), 2)
  END::DOUBLE AS price FROM {source} s LEFT JOIN segs ON s.price >= x0 AND (x1 IS NULL OR s.price < x1))"""


@query(
    "b18_calibrate_prices",
    with_views("tx", "SELECT customer_id, article_id, price FROM cal", calibrated_sql("tx")),
)
def b18(spark, d):
    out = cleaning.calibrate_prices(views.transactions(spark, d))
    return out.select("customer_id", "article_id", "price")


@query(
    "b19_convert_prices",
    with_views(
        "tx",
        """SELECT customer_id, article_id, round(price * 25.0 / (SELECT median(price) FROM tx), 2) AS price,
 round(price * 25.0 * 10.5 / (SELECT median(price) FROM tx), 2) AS price_sek,
 round(price * 25.0 / (SELECT median(price) FROM tx), 2) AS price_eur FROM tx""",
    ),
)
def b19(spark, d):
    out = cleaning.convert_prices(views.transactions(spark, d), target_median=25.0, keep_columns=True)
    return out.select("customer_id", "article_id", "price", "price_sek", "price_eur")


@query(
    "b19_convert_prices_to_minimum",
    with_views(
        "tx",
        "SELECT customer_id, article_id, round(price * 3.99 / (SELECT min(price) FROM tx), 2) AS price FROM tx",
    ),
)
def b19_min(spark, d):
    out = cleaning.convert_prices(views.transactions(spark, d), target_min=3.99)
    return out.select("customer_id", "article_id", "price")


@query(
    "b19_convert_prices_to_quantile",
    with_views(
        "tx",
        """SELECT customer_id, article_id,
 round(price * 250.0 / (SELECT price FROM (SELECT price, row_number() OVER (ORDER BY price) - 1 AS i, count(*) OVER () AS n FROM tx)
 WHERE i = round_even((n - 1) * 0.99, 0)), 2) AS price FROM tx""",
    ),
)
def b19_quantile(spark, d):
    out = cleaning.convert_prices(views.transactions(spark, d), target_quantile=(0.99, 250.0))
    return out.select("customer_id", "article_id", "price")


@query(
    "b20_cap_eur_prices",
    with_views(
        "tx",
        """SELECT customer_id, article_id, greatest(least(e, 300.0), 20.0) AS price, greatest(least(e, 300.0), 20.0) AS price_eur,
 e < 20 OR e > 300 AS price_eur_outlier_capped FROM (SELECT *, price / 200 AS e FROM tx)""",
    ),
)
def b20(spark, d):
    tx = views.transactions(spark, d).withColumn("price_eur", F.col("price") / 200)
    return cleaning.cap_eur_prices(tx, 20.0, 300.0).drop("t_dat", "sales_channel_id")


@query(
    "b21_normalise_types",
    with_views(
        "rtx",
        """SELECT TRY_CAST(t_dat AS DATE) AS t_dat, customer_id, article_id, price,
 sales_channel_id::BIGINT AS sales_channel_id FROM rtx""",
    ),
)
def b21(spark, d):
    return cleaning.normalise_transaction_types(views.raw_transactions(spark, d))


_CATEGORICAL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + (count(*) > count({c}))::INT AS distinct_values,
 (count(DISTINCT {c}) + (count(*) > count({c}))::INT) / count(*) < 0.5 AS categorical FROM rar"""
    for c in ("prod_name", "detail_desc", "product_type_name", "colour_group_name")
)


@query("b22_categorical_candidates", with_views("rar", _CATEGORICAL))
def b22(spark, d):
    return cleaning.categorical_candidates(views.raw_articles(spark, d))


@query("b23_drop_duplicates", with_views("rcu", "SELECT DISTINCT * FROM rcu"))
def b23(spark, d):
    return cleaning.drop_duplicate_rows(views.raw_customers(spark, d))


@query(
    "b24_valid_texts",
    with_views(
        "rtext",
        r"""SELECT * FROM (SELECT article_id, regexp_replace(coalesce(detail_desc, ''), '^\s+|\s+$', '', 'g') AS detail_desc FROM rtext)
WHERE length(detail_desc) > 0 AND lower(detail_desc) <> 'no_description'""",
    ),
)
def b24(spark, d):
    return filters.valid_texts(views.raw_texts(spark, d))


@query(
    "b25_complete_rows",
    with_views(
        "rcu",
        """SELECT * FROM rcu WHERE FN IS NOT NULL AND Active IS NOT NULL AND club_member_status IS NOT NULL
 AND fashion_news_frequency IS NOT NULL AND age IS NOT NULL AND postal_code IS NOT NULL""",
    ),
)
def b25(spark, d):
    return filters.complete_rows(views.raw_customers(spark, d))


@query(
    "b25_completeness",
    with_views(
        "rcu",
        """SELECT count(*) AS n_rows, count(*) FILTER (c) AS complete, round(count(*) FILTER (c) * 100.0 / count(*), 4) AS complete_pct
FROM (SELECT FN IS NOT NULL AND Active IS NOT NULL AND club_member_status IS NOT NULL
 AND fashion_news_frequency IS NOT NULL AND age IS NOT NULL AND postal_code IS NOT NULL AS c FROM rcu)""",
    ),
)
def b25_counts(spark, d):
    return rounded(filters.completeness(views.raw_customers(spark, d)), ["complete_pct"], 4)


CUSTOMER_STEPS = f"""ded AS (SELECT DISTINCT * FROM rcu),
fil AS ({B08}, coalesce(age, (SELECT median(age) FROM ded))::DOUBLE AS age, age IS NULL AS age_imputed FROM ded),
cleaned AS (SELECT * EXCLUDE (age), CASE WHEN age BETWEEN 16 AND 100 THEN age ELSE
 (SELECT median(age) FROM fil WHERE age BETWEEN 16 AND 100) END AS age, NOT age BETWEEN 16 AND 100 AS age_corrected FROM fil)"""


@query(
    "b26_drop_flags",
    with_views(
        "rcu",
        """SELECT customer_id, FN, Active, club_member_status, fashion_news_frequency, postal_code, age FROM cleaned""",
        CUSTOMER_STEPS,
    ),
)
def b26(spark, d):
    return filters.drop_types(cleaning.clean_customers(views.raw_customers(spark, d)), (T.BooleanType,))


@query(
    "b27_provenance",
    with_views("cu", "SELECT customer_id, 'hybrid' AS approach, '2026-01-01T00:00:00' AS created_at FROM cu"),
)
def b27(spark, d):
    return filters.with_provenance(
        views.customers(spark, d).select("customer_id"), approach="hybrid", created_at="2026-01-01T00:00:00"
    )


TRANSACTION_STEPS = ",\n".join(
    [
        KEYED,
        MEDIANS,
        FILLED,
        f"""step AS (SELECT t_dat, customer_id, article_id, CASE WHEN price < 0.003542 THEN 0.003542
  WHEN price > 0.061847 THEN 0.061847 ELSE price END AS price, price < 0.003542 OR price > 0.061847 AS price_outlier_capped,
  coalesce(sales_channel_id, {MODE.format(t="filled", w="")}) AS ch FROM filled),
fixed AS (SELECT * EXCLUDE (ch), CASE WHEN ch IN (1, 2) THEN ch ELSE
  (SELECT ch FROM step WHERE ch IN (1, 2) GROUP BY ch ORDER BY count(*) DESC, ch LIMIT 1) END::BIGINT AS sales_channel_id,
  NOT ch IN (1, 2) AS sales_channel_corrected FROM step)""",
        calibrated_sql("fixed"),
        """cleaned AS (SELECT * REPLACE (TRY_CAST(t_dat AS DATE) AS t_dat), true AS price_percentile_calibrated FROM cal)""",
    ]
)


@query("b28_clean_transactions", with_views("rtx", "SELECT * FROM cleaned", TRANSACTION_STEPS))
def b28(spark, d):
    return cleaning.clean_transactions(views.raw_transactions(spark, d))


@query("b29_clean_customers", with_views("rcu", "SELECT * FROM cleaned", CUSTOMER_STEPS))
def b29(spark, d):
    return cleaning.clean_customers(views.raw_customers(spark, d))


ARTICLE_STEPS = f"""fil AS ({B10} FROM (SELECT DISTINCT * FROM rar)),
cleaned AS (SELECT * REPLACE (greatest(product_type_no, 0) AS product_type_no,
  greatest(graphical_appearance_no, 0) AS graphical_appearance_no), product_type_no < 0 AS product_type_no_negative_fixed,
  graphical_appearance_no < 0 AS graphical_appearance_no_negative_fixed,
  NOT product_code BETWEEN 100000 AND 999999 AS product_code_invalid FROM fil)"""


@query("b30_clean_articles", with_views("rar", "SELECT * FROM cleaned", ARTICLE_STEPS))
def b30(spark, d):
    return cleaning.clean_articles(views.raw_articles(spark, d))


_RAW_COLUMNS = ["customer_id", "FN", "Active", "club_member_status", "fashion_news_frequency", "age", "postal_code"]
_FLAGS = [f"{c}_imputed" for c in _RAW_COLUMNS[1:]] + ["age_corrected"]
_REPORT = " UNION ALL ".join(
    [
        "SELECT 'customers' AS dataset, 'rows' AS category, 'before' AS \"column\", count(*) AS count FROM rcu",
        "SELECT 'customers', 'duplicates', 'row', (SELECT count(*) FROM rcu) - (SELECT count(*) FROM ded)",
        "SELECT 'customers', 'rows', 'after', count(*) FROM cleaned",
    ]
    + [f"SELECT 'customers', 'missing', '{c}', count(*) - count({c}) FROM rcu" for c in _RAW_COLUMNS]
    + [f"SELECT 'customers', 'flag', '{f}', count(*) FILTER (\"{f}\") FROM cleaned" for f in _FLAGS]
)


@query("b31_cleaning_report", with_views("rcu", _REPORT, CUSTOMER_STEPS))
def b31(spark, d):
    raw = views.raw_customers(spark, d)
    return cleaning.cleaning_report("customers", raw, cleaning.clean_customers(raw))


def _metrics(source):
    fields = {
        "count": "count(age)",
        "nulls": "count(*) - count(age)",
        "mean": "avg(age)",
        "std": "stddev_samp(age)",
        "min": "min(age)",
        "max": "max(age)",
        "q1": "quantile_cont(age, 0.25)",
        "median": "median(age)",
        "q3": "quantile_cont(age, 0.75)",
        "p95": "quantile_cont(age, 0.95)",
        "p99": "quantile_cont(age, 0.99)",
    }
    return " UNION ALL ".join(
        f"SELECT 'age' AS \"column\", '{m}' AS metric, round(({e})::DOUBLE, 4) AS v FROM {source}"
        for m, e in fields.items()
    )


@query(
    "b32_before_after",
    with_views(
        "rcu",
        f"""SELECT "column", metric, a.v AS "before", b.v AS "after" FROM ({_metrics("rcu")}) a
FULL JOIN ({_metrics("cleaned")}) b USING ("column", metric)""",
        CUSTOMER_STEPS,
    ),
)
def b32(spark, d):
    raw = views.raw_customers(spark, d)
    out = cleaning.compare_statistics(raw, cleaning.clean_customers(raw), ["age"])
    return rounded(out, ["before", "after"], 4)


@query(
    "b33_final_article_columns",
    with_views(
        "rar",
        "SELECT article_id, prod_name, product_type_name, colour_group_name, detail_desc, product_type_no FROM cleaned",
        ARTICLE_STEPS,
    ),
)
def b33(spark, d):
    cleaned = cleaning.clean_articles(views.raw_articles(spark, d))
    return cleaning.select_article_columns(cleaned, ["product_type_no"])


@query(
    "b28_optional_rules",
    with_views(
        "rtx rcu",
        r"""SELECT p AS price_violations, c AS postal_code_violations FROM
(SELECT count(*) FILTER (NOT price BETWEEN 0.001 AND 1.0) AS p FROM rtx),
(SELECT count(*) FILTER (NOT regexp_matches(postal_code, '^\d{5}$') AND postal_code <> 'NONE') AS c FROM rcu)""",
    ),
)
def b28_rules(spark, d):
    prices = cleaning.rule_violations(views.raw_transactions(spark, d))
    postal = cleaning.rule_violations(views.raw_customers(spark, d).select("postal_code"))
    return prices.select("price_violations", postal.scalar().alias("postal_code_violations"))
