"""Profiling and outliers."""

from pyspark.sql import functions as F

from basketry.functions import ranks
from basketry.operators import outliers, profiling
from basketry.plans.registry import query
from basketry.session import materialised
from basketry.sources import views
from basketry.sources.views import with_views


def rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


PRICE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_COLUMNS = PRICE_COLUMNS + ["l_linenumber"]


def line_numbers(spark, d):
    return views.table(spark, d, "lineitem").select(*LINE_COLUMNS)


def stats_sql(source, columns, quantiles):
    qs = ", ".join(f"round(quantile_cont({{c}}, {q}), 4) AS {n}" for n, q in quantiles.items())
    one = f"""SELECT '{{c}}' AS "column", count({{c}}) AS count, count(*) - count({{c}}) AS nulls, round(avg({{c}}), 4) AS mean,
 round(stddev_samp({{c}}), 4) AS std, round(min({{c}})::DOUBLE, 4) AS min, round(max({{c}})::DOUBLE, 4) AS max, {qs} FROM {source}"""
    return " UNION ALL ".join(one.format(c=c) for c in columns)


ALL_QS = {**profiling.QUARTILES, **profiling.TAILS}


@query("d01_column_statistics", stats_sql("lineitem", LINE_COLUMNS, ALL_QS))
def d01(spark, d):
    out = profiling.numeric_statistics(line_numbers(spark, d), LINE_COLUMNS)
    return rounded(out, ["mean", "std", "min", "max", *ALL_QS])


@query(
    "d47_describe",
    "SELECT * EXCLUDE (nulls) FROM (" + stats_sql("events", ["value"], profiling.QUARTILES) + ")",
)
def d47(spark, d):
    out = profiling.describe(views.table(spark, d, "events"), ["value"])
    return rounded(out, ["mean", "std", "min", "max", *profiling.QUARTILES])


FRACTIONS = [0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]


@query(
    "d45_quantile_table",
    with_views(
        "tx",
        " UNION ALL ".join(
            f"SELECT {q}::DOUBLE AS fraction, round(quantile_cont(price, {q}), 4) AS value FROM tx" for q in FRACTIONS
        ),
    ),
)
def d45(spark, d):
    return rounded(profiling.quantile_table(views.transactions(spark, d), "price", FRACTIONS), ["value"])


def _counts_sql(source, columns, as_text):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {as_text.format(c=c)} AS value, count(*) AS n FROM {source} GROUP BY ALL"
        for c in columns
    )


RAR_TEXT = ["prod_name", "detail_desc", "product_type_name", "colour_group_name"]
RAR_ALL = ["article_id", "product_code", *RAR_TEXT[:2], "product_type_no", "graphical_appearance_no", *RAR_TEXT[2:]]


@query(
    "d10_top_values",
    with_views(
        "rar",
        """SELECT "column", value, n, rank, round(n * 100.0 / (SELECT count(*) FROM rar), 4) AS pct FROM
(SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS LAST) AS rank FROM vc) WHERE rank <= 10""",
        f"vc AS ({_counts_sql('rar', RAR_TEXT, '{c}')})",
    ),
)
def d10(spark, d):
    return rounded(profiling.top_values(views.raw_articles(spark, d), RAR_TEXT), ["pct"])


def schema_sql(source, types):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) - count({c}) AS nulls,
 round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_pct,
 count(DISTINCT {c}) + (count(*) > count({c}))::INT AS distinct_values,
 round((count(DISTINCT {c}) + (count(*) > count({c}))::INT) * 100.0 / count(*), 4) AS distinct_pct FROM {source}"""
        for c, t in types.items()
    )


RAR_TYPES = {
    "article_id": "bigint",
    "product_code": "bigint",
    "prod_name": "string",
    "detail_desc": "string",
    "product_type_no": "int",
    "graphical_appearance_no": "int",
    "product_type_name": "string",
    "colour_group_name": "string",
}


@query("d17_schema_analysis", with_views("rar", schema_sql("rar", RAR_TYPES)))
def d17(spark, d):
    return rounded(profiling.schema_analysis(views.raw_articles(spark, d)), ["null_pct", "distinct_pct"])


_NULLS = " + ".join(f"({c} IS NULL)::INT" for c in RAR_TYPES)
QUALITY = f"""q AS (SELECT count(*) AS n_rows, sum({_NULLS})::BIGINT AS null_cells,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM rar)) AS duplicate_rows, count(*) * 8 AS cells FROM rar),
quality AS (SELECT *, round(null_cells * 100.0 / cells, 4) AS null_pct, round(100 - null_cells * 100.0 / cells, 4) AS completeness,
 round(duplicate_rows * 100.0 / n_rows, 4) AS duplicate_pct FROM q)"""


@query("d18_quality_metrics", with_views("rar", "SELECT * FROM quality", QUALITY))
def d18(spark, d):
    out = profiling.quality_metrics(views.raw_articles(spark, d))
    return rounded(out, ["null_pct", "completeness", "duplicate_pct"])


IDS = """ids AS (SELECT "column", (regexp_matches("column", '(id$|^id_|uuid|guid)') OR distinct_pct >= 95) AS probable_id FROM sch)"""


@query(
    "d19_probable_ids",
    with_views("rar", "SELECT * FROM ids", f"sch AS ({schema_sql('rar', RAR_TYPES)}), {IDS}"),
)
def d19(spark, d):
    return profiling.probable_ids(views.raw_articles(spark, d))


ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}


@query(
    "d20_numeric_summary",
    f"WITH sch AS ({schema_sql('orders', ORDER_TYPES)}), {IDS} SELECT * FROM ("
    + stats_sql("orders", ORDER_TYPES, profiling.QUARTILES)
    + ') WHERE "column" IN (SELECT "column" FROM ids WHERE NOT probable_id)',
)
def d20(spark, d):
    return profiling.numeric_summary(views.table(spark, d, "orders"))


@query(
    "d21_categorical_summary",
    with_views(
        "rar",
        """SELECT "column", count(*) AS distinct_values, round(sum(length(value) * n) / sum(n) FILTER (value IS NOT NULL), 4) AS mean_length,
 string_agg(coalesce(value, '<null>') || '=' || n, ', ' ORDER BY rank) FILTER (rank <= 5) AS top_values
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS LAST) AS rank FROM vc) GROUP BY "column\"""",
        f"vc AS ({_counts_sql('rar', RAR_TEXT, '{c}')})",
    ),
)
def d21(spark, d):
    return rounded(profiling.categorical_summary(views.raw_articles(spark, d)), ["mean_length"])


@query(
    "d22_quality_recommendations",
    with_views(
        "rar",
        """SELECT 'high missing values' AS finding, '<table>' AS "column" FROM quality WHERE null_pct > 10
UNION ALL SELECT 'significant duplicates', '<table>' FROM quality WHERE duplicate_pct > 5
UNION ALL SELECT 'potential id', "column" FROM sch WHERE distinct_pct > 95
UNION ALL SELECT 'low cardinality', "column" FROM sch WHERE distinct_values > 1 AND distinct_values <= 10""",
        f"sch AS ({schema_sql('rar', RAR_TYPES)}), {QUALITY}",
    ),
)
def d22(spark, d):
    return profiling.quality_recommendations(views.raw_articles(spark, d))


RAR_NUMERIC = ["article_id", "product_code", "product_type_no", "graphical_appearance_no"]
_PROFILE_STATS = ["mean", "std", "min", "max", "q1", "median", "q3"]


@query(
    "d23_data_profile",
    with_views(
        "rar",
        "SELECT section, \"column\", metric, value FROM ("
        + """SELECT 'schema' AS section, "column", 'dtype' AS metric, dtype AS value FROM sch
UNION ALL SELECT 'schema', "column", 'nulls', nulls::VARCHAR FROM sch
UNION ALL SELECT 'schema', "column", 'distinct_values', distinct_values::VARCHAR FROM sch
UNION ALL SELECT 'quality', '<table>', 'n_rows', n_rows::VARCHAR FROM quality
UNION ALL SELECT 'quality', '<table>', 'null_cells', null_cells::VARCHAR FROM quality
UNION ALL SELECT 'quality', '<table>', 'duplicate_rows', duplicate_rows::VARCHAR FROM quality
UNION ALL SELECT 'frequent', "column", 'value', value FROM top
UNION ALL SELECT 'frequent', "column", 'n', n::VARCHAR FROM top"""
        + "".join(
            f" UNION ALL SELECT 'numeric', \"column\", '{m}', {m}::DOUBLE::VARCHAR FROM st" for m in _PROFILE_STATS
        )
        + ")",
        f"sch AS ({schema_sql('rar', RAR_TYPES)}), {QUALITY}, st AS ({stats_sql('rar', RAR_NUMERIC, profiling.QUARTILES)}), "
        + f"vc AS ({_counts_sql('rar', RAR_TEXT, '{c}')}), "
        + """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS LAST) AS rank
 FROM vc) WHERE rank = 1)""",
    ),
)
def d23(spark, d):
    return profiling.data_profile(views.raw_articles(spark, d))


def bounds_sql(columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS total, count({c}) AS count, count(*) - count({c}) AS nulls,
 avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, quantile_cont({c}, 0.25) AS q1,
 median({c}) AS median, quantile_cont({c}, 0.75) AS q3, quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.99) AS p99,
 (SELECT median(abs({c} - (SELECT median({c}) FROM lineitem))) FROM lineitem) AS mad FROM lineitem"""
        for c in columns
    )


CELLS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS v FROM lineitem" for c in LINE_COLUMNS)
OUTLIER_CTES = f"""b AS ({bounds_sql(LINE_COLUMNS)}), cells AS ({CELLS}),
o AS (SELECT "column", count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers_iqr,
 count(*) FILTER (std > 0 AND abs(v - mean) / std > 3) AS outliers_zscore,
 count(*) FILTER (mad > 0 AND abs(0.6745 * (v - median) / mad) > 3.5) AS outliers_modified,
 count(*) FILTER (v < p01 OR v > p99) AS outliers_percentile FROM cells JOIN b USING ("column") GROUP BY "column"),
summary AS (SELECT * FROM b JOIN o USING ("column"))"""


def outlier_query(name, select, fn, digits):
    @query(name, f"WITH {OUTLIER_CTES} SELECT \"column\", {select} FROM summary")
    def run(spark, d):
        out = fn(line_numbers(spark, d), LINE_COLUMNS)
        return rounded(out, [c for c in out.columns if c not in ("column", "outliers")], digits)

    return run


outlier_query(
    "d24_iqr_outliers",
    """outliers_iqr AS outliers, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 4) AS lower,
 round(q3 + 1.5 * (q3 - q1), 4) AS upper""",
    outliers.iqr_outliers,
    4,
)
outlier_query(
    "d25_zscore_outliers",
    "outliers_zscore AS outliers, round(mean, 4) AS mean, round(std, 4) AS std",
    outliers.zscore_outliers,
    4,
)
outlier_query(
    "d26_modified_zscore_outliers",
    "outliers_modified AS outliers, round(median, 4) AS median, round(mad, 4) AS mad",
    outliers.modified_zscore_outliers,
    4,
)
outlier_query(
    "d27_percentile_outliers",
    "outliers_percentile AS outliers, round(p01, 4) AS lower, round(p99, 4) AS upper",
    outliers.percentile_outliers,
    4,
)
_SUMMARY_FLOATS = ["mean", "std", "min", "max", "q1", "median", "q3", "p01", "p99", "mad", "iqr", "lower_iqr", "upper_iqr"]


@query(
    "d28_outlier_summary",
    f"""WITH {OUTLIER_CTES} SELECT "column", count, nulls, total, outliers_iqr, outliers_zscore, outliers_modified, outliers_percentile,
 round(q3 - q1, 4) AS iqr, round(q1 - 1.5 * (q3 - q1), 4) AS lower_iqr, round(q3 + 1.5 * (q3 - q1), 4) AS upper_iqr, """
    + ", ".join(f"round({c}, 4) AS {c}" for c in _SUMMARY_FLOATS[:10])
    + " FROM summary",
)
def d28(spark, d):
    return rounded(outliers.outlier_summary(line_numbers(spark, d)), _SUMMARY_FLOATS)


@query(
    "d29_outlier_recommendations",
    f"""WITH {OUTLIER_CTES}, s AS (SELECT *, outliers_iqr * 100.0 / total AS share, CASE WHEN min > 0 THEN max / min ELSE 'inf'::DOUBLE END AS ratio,
 list_count(list_distinct([outliers_iqr, outliers_zscore, outliers_modified, outliers_percentile])) AS kinds FROM summary)
SELECT "column", CASE WHEN share > 5 THEN 'high' WHEN share > 1 THEN 'moderate' ELSE 'clean' END AS priority,
 coalesce(nullif(concat_ws('; ', CASE WHEN share > 10 THEN 'high outlier share' WHEN share > 5 THEN 'moderate outliers'
   WHEN share > 1 THEN 'some outliers' END,
  CASE WHEN ratio > 1000 THEN 'extremely wide range' WHEN ratio > 100 THEN 'wide range' END,
  CASE WHEN kinds > 3 THEN 'methods disagree' END, CASE WHEN std > mean * 2 THEN 'high variability' END,
  CASE WHEN min < 0 AND "column" IN ('price', 'amount', 'cost', 'value') THEN 'negative values' END), ''), 'clean data') AS findings
FROM s""",
)
def d29(spark, d):
    return outliers.outlier_recommendations(outliers.outlier_summary(line_numbers(spark, d)))


# One sketch per column and return flag, merged; its quartiles must lie within twice the stated rank error.
@query(
    "p01_sketched_quartiles",
    " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, true AS q1_within, true AS q3_within, true AS fences_hold FROM lineitem""" for c in LINE_COLUMNS),
)
def p01(spark, d):
    lines = views.table(spark, d, "lineitem").select("l_returnflag", *LINE_COLUMNS)
    parts = outliers.quantile_sketches(lines, LINE_COLUMNS, ["l_returnflag"])
    bounds = materialised(outliers.sketch_bounds(outliers.merged_sketches(parts)))
    rows = {r["column"]: r for r in bounds.collect()}
    counts = []
    for i, c in enumerate(LINE_COLUMNS):
        for name in ("q1", "q3"):
            x = F.col(c).cast("double")
            counts += [F.count_if(x < rows[c][name]).alias(f"{name}_below{i}"), F.count_if(x <= rows[c][name]).alias(f"{name}_upto{i}")]
    found = lines.agg(*counts).first()
    slack = 2 * ranks.sketch_error(400)

    def within(name, q, i, n):
        return found[f"{name}_below{i}"] <= (q + slack) * n and found[f"{name}_upto{i}"] >= (q - slack) * n

    flagged = outliers.flagged(lines, bounds)
    table = []
    for i, c in enumerate(LINE_COLUMNS):
        n = rows[c]["n"]
        spread = 1.5 * (rows[c]["q3"] - rows[c]["q1"])
        exact = F.count_if((F.col(c) < rows[c]["q1"] - spread) | (F.col(c) > rows[c]["q3"] + spread)) == F.count_if(f"{c}_outlier")
        table.append((c, n, within("q1", 0.25, i, n), within("q3", 0.75, i, n), flagged.agg(exact).first()[0]))
    return spark.createDataFrame(table, '`column` string, n bigint, q1_within boolean, q3_within boolean, fences_hold boolean')
