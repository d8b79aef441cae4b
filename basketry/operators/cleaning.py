"""Cleaning and repair of the three tables.

No step looks at the data to decide what to do: every expression is always applied and is a no-op on
clean input, so the plan and the output schema do not depend on the data.  Global values a step needs
(mode, median, quantiles) come from one small job each and enter the plan as literals, which keeps a
chain of repairs a single narrow pass.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import ranks
from basketry.session import materialised
from basketry.sources.tables import columns_like, write_cleaned, write_json

# The retailer's cleaning rules.
CRITICAL = ("t_dat", "customer_id", "article_id")
PRICE_CAP = (0.003542, 0.061847)
PRICE_KEEP = (0.003542, 0.084729)
VALID_CHANNELS = (1, 2)
AGE_RANGE = (16, 100)
PRODUCT_CODE_RANGE = (100000, 999999)
CUSTOMER_FILLS = {
    "FN": 0.0,
    "Active": 0.0,
    "club_member_status": "NONE",
    "fashion_news_frequency": "NONE",
    "postal_code": "NONE",
}
TARGET_PRICES = {
    0.01: 2.99,
    0.05: 4.99,
    0.10: 7.99,
    0.25: 12.99,
    0.50: 19.99,
    0.75: 29.99,
    0.90: 49.99,
    0.95: 79.99,
    0.99: 149.99,
}
OPTIONAL_RULES = {"price": (0.001, 1.0), "postal_code": r"^\d{5}$"}


# --- missing values ---------------------------------------------------------------------------


def drop_missing_keys(df: DataFrame, columns: Sequence[str] = CRITICAL) -> DataFrame:
    """B5."""
    return df.dropna(subset=list(columns))


def missing_key_counts(df: DataFrame, columns: Sequence[str] = CRITICAL) -> DataFrame:
    """Rows lost per step; a row with two null keys counts for the first of them."""
    counts, earlier_ok = [], F.lit(True)
    for c in columns:
        counts.append(F.count_if(earlier_ok & F.col(c).isNull()).alias(f"dropped_{c}"))
        earlier_ok = earlier_ok & F.col(c).isNotNull()
    return df.agg(*counts)


def group_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median of ``value`` per ``key``; a key with a third of all rows is no hot spot."""
    return ranks.quantiles(df.select(key, value), {"group_median": 0.5}, [key], value)


def fill_with_group_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Null values take the median of their group and stay null where the group has none.

    Only the rows with a null meet the medians, and are written once; all others stay where they are read.
    """
    missing = F.col(value).isNull()
    medians = group_median(df, key, value).withColumnRenamed("group_median", value)
    filled = df.filter(missing).drop(value).join(medians, key, "left").select(*df.columns)
    return df.filter(~missing).unionByName(materialised(filled))


def mode_of(df: DataFrame, column: str) -> Column:
    """Most frequent value as a literal; the smallest value wins ties."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    row = counts.orderBy(F.col("n").desc(), column).first()
    return F.lit(row[column] if row else None)


def median_of(df: DataFrame, column: str) -> Column:
    return F.lit(ranks.quantile_values(df, column, {"m": 0.5})["m"])


def fill_with_mode(df: DataFrame, column: str, source: DataFrame | None = None) -> DataFrame:
    """``source`` may hold the same rows in a cheaper form."""
    return df.withColumn(column, F.coalesce(F.col(column), mode_of(source or df, column)))


def fill_with_constants(df: DataFrame, fills: Mapping[str, object] = CUSTOMER_FILLS) -> DataFrame:
    """Constant fills, each with an ``<column>_imputed`` flag."""
    present = {c: v for c, v in fills.items() if c in df.columns}
    return df.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in present.items()},
            **{f"{c}_imputed": F.col(c).isNull() for c in present},
        }
    )


def fill_with_median(df: DataFrame, column: str = "age") -> DataFrame:
    """Global median fill with flag; the column becomes a double."""
    return df.withColumns(
        {
            column: F.coalesce(F.col(column).cast("double"), median_of(df, column)),
            f"{column}_imputed": F.col(column).isNull(),
        }
    )


def fill_articles(df: DataFrame) -> DataFrame:
    """Unknown names, missing descriptions and zero codes, chosen by column name and type."""
    fills: dict[str, Column] = {}
    for field in df.schema.fields:
        name, text = field.name, isinstance(field.dataType, T.StringType)
        if name == "detail_desc":
            fills[name] = F.coalesce(F.col(name), F.lit("NO_DESCRIPTION"))
        elif text and name.endswith(("_name", "_desc", "product_code")):
            fills[name] = F.coalesce(F.col(name), F.lit("UNKNOWN"))
        elif isinstance(field.dataType, T.NumericType) and name.endswith(("_no", "_code")):
            fills[name] = F.coalesce(F.col(name), F.lit(0).cast(field.dataType))
    return df.withColumns(fills)


# --- outliers and range rules -------------------------------------------------------------------


def cap(df: DataFrame, column: str, low: float, high: float, flag: str) -> DataFrame:
    """Clip to bounds and flag; null stays null and has a null flag."""
    value = F.col(column)
    return df.withColumns(
        {
            column: F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value),
            flag: (value < low) | (value > high),
        }
    )


def treat_price_outliers(df: DataFrame, method: str = "iqr") -> DataFrame:
    """B11 (``iqr``: clip) or B12 (``remove``: drop rows outside)."""
    if method == "iqr":
        return cap(df, "price", *PRICE_CAP, "price_outlier_capped")
    if method == "remove":
        kept = df.filter(F.col("price").between(*PRICE_KEEP))
        return kept.withColumn("price_outlier_capped", F.lit(False))
    raise ValueError(f"unknown outlier method {method!r}: use 'iqr' or 'remove'")


def repair_negative_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Negative codes become 0, with ``<column>_negative_fixed``."""
    return df.withColumns(
        {
            **{c: F.when(F.col(c) < 0, F.lit(0)).otherwise(F.col(c)) for c in columns},
            **{f"{c}_negative_fixed": F.coalesce(F.col(c) < 0, F.lit(False)) for c in columns},
        }
    )


def repair_domain(
    df: DataFrame, column: str, valid: Sequence, flag: str, source: DataFrame | None = None
) -> DataFrame:
    """Values outside the domain become the mode of the valid rows."""
    ok = F.col(column).isin(*valid)
    mode = mode_of((source or df).filter(ok), column)
    return df.withColumns({column: F.when(ok, F.col(column)).otherwise(mode), flag: ~ok})


def repair_range(df: DataFrame, column: str, low: float, high: float, flag: str) -> DataFrame:
    """Values outside the range become the median of the values inside it."""
    ok = F.col(column).between(low, high)
    median = median_of(df.filter(ok), column)
    return df.withColumns(
        {column: F.when(ok, F.col(column).cast("double")).otherwise(median), flag: ~ok}
    )


def flag_range(df: DataFrame, column: str, low: float, high: float, flag: str) -> DataFrame:
    """B16."""
    return df.withColumn(flag, ~F.col(column).between(low, high))


def ensure_flags(df: DataFrame, **defaults: bool) -> DataFrame:
    """Quality flags that no step has set get their default."""
    return df.withColumns({f: F.lit(v) for f, v in defaults.items() if f not in df.columns})


def rule_violations(df: DataFrame) -> DataFrame:
    """Rows that break the optional price-range and postal-pattern rules."""
    checks = []
    if "price" in df.columns:
        checks.append(F.count_if(~F.col("price").between(*OPTIONAL_RULES["price"])).alias("price_violations"))
    if "postal_code" in df.columns:
        bad = ~F.col("postal_code").rlike(OPTIONAL_RULES["postal_code"]) & (F.col("postal_code") != "NONE")
        checks.append(F.count_if(bad).alias("postal_code_violations"))
    return df.agg(*checks)


# --- prices ---------------------------------------------------------------------------------------


def interpolate(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear map through rising knots, constant outside; repeated knots take the last."""
    out = F.when(x >= knots[-1][0], F.lit(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        if x1 > x0:
            out = out.when(x >= x0, y0 + (x - x0) * (y1 - y0) / (x1 - x0))
    return out.when(x < knots[0][0], F.lit(knots[0][1]))


def calibrate_prices(
    df: DataFrame,
    targets: Mapping[float, float] = TARGET_PRICES,
    overwrite: bool = True,
    digits: int = 2,
    floor: float = 0.99,
) -> DataFrame:
    """Map the quantiles of the price column onto target prices, linearly in between.

    The minimum maps to 0.8 of the first target and the maximum to 1.2 of the last.
    """
    wanted = {"low": 0.0, **{str(q): q for q in sorted(targets)}, "high": 1.0}
    at = ranks.quantile_values(df, "price", wanted, "nearest")
    if at["low"] is None:
        raise ValueError("no price to calibrate on")
    knots = [(at[str(q)], targets[q]) for q in sorted(targets)]
    if at["low"] < knots[0][0]:
        knots.insert(0, (at["low"], knots[0][1] * 0.8))
    if at["high"] > knots[-1][0]:
        knots.append((at["high"], knots[-1][1] * 1.2))
    mapped = F.greatest(interpolate(F.col("price"), knots), F.lit(floor))
    value = F.when(F.col("price").isNotNull(), F.bround(mapped, digits))
    return df.withColumn("price" if overwrite else "price_eur", value)


def convert_prices(
    df: DataFrame,
    scale: float = 1000.0,
    per_eur: float = 10.5,
    digits: int = 2,
    overwrite: bool = True,
    keep_columns: bool = False,
    target_median: float | None = None,
    target_quantile: tuple[float, float] | None = None,
    target_min: float | None = None,
) -> DataFrame:
    """Linear conversion, optionally scaled so that a median, quantile or minimum hits a target."""
    if scale <= 0 or per_eur <= 0:
        raise ValueError("scale and per_eur must be positive")
    # The last target given decides the ratio; one division per price keeps ties at half a cent as they are.
    statistic, target = None, None
    if target_median:
        statistic, target = median_of(df, "price"), float(target_median)
    if target_quantile:
        q, target = target_quantile[0], float(target_quantile[1])
        statistic = F.lit(ranks.quantile_values(df, "price", {"q": q}, "nearest")["q"])
    if target_min:
        statistic, target = F.lit(df.agg(F.min("price")).first()[0]), float(target_min)
    price = F.col("price")
    plain_sek, plain_eur = price * float(scale), price * float(scale) / per_eur
    if statistic is None:
        sek, eur = plain_sek, plain_eur
    else:
        sek = F.when(statistic > 0, price * target * per_eur / statistic).otherwise(plain_sek)
        eur = F.when(statistic > 0, price * target / statistic).otherwise(plain_eur)
    out = df.withColumns({"price_sek": F.round(sek, digits), "price_eur": F.round(eur, digits)})
    if overwrite:
        out = out.withColumn("price", F.col("price_eur"))
    return out if keep_columns else out.drop("price_sek", "price_eur")


def cap_eur_prices(df: DataFrame, low: float, high: float) -> DataFrame:
    """Cap the converted price, mirror it to ``price`` and flag."""
    column = "price_eur" if "price_eur" in df.columns else "price"
    out = cap(df, column, low, high, "price_eur_outlier_capped")
    return out.withColumn("price", F.col(column)) if "price" in df.columns else out


# --- types and duplicates -------------------------------------------------------------------------


def normalise_transaction_types(df: DataFrame) -> DataFrame:
    """Dates, ids, prices and channels in their types; what cannot be read becomes null."""
    day = F.col("t_dat")
    if isinstance(df.schema["t_dat"].dataType, T.StringType):
        day = F.try_to_date(day, "yyyy-MM-dd") if hasattr(F, "try_to_date") else day.try_cast("date")
    return df.withColumns(
        {
            "t_dat": day.cast("date"),
            "article_id": F.col("article_id").try_cast("bigint"),
            "price": F.col("price").try_cast("double"),
            "sales_channel_id": F.col("sales_channel_id").try_cast("bigint"),
        }
    )


def categorical_candidates(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Text columns whose distinct share lies below the threshold."""
    from basketry.operators.profiling import schema_analysis

    text = columns_like(df, types=(T.StringType,))
    return schema_analysis(df.select(*text)).select(
        "column",
        "distinct_values",
        (F.col("distinct_pct") / 100 < threshold).alias("categorical"),
    )


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """B23."""
    return df.dropDuplicates()


# --- whole tables ---------------------------------------------------------------------------------


def clean_transactions(df: DataFrame, outlier_method: str = "iqr", calibrate: bool = True) -> DataFrame:
    """The rows are written once, since medians, modes, calibration and the final pass all read them."""
    return _clean_transactions(materialised(drop_missing_keys(df)), outlier_method, calibrate)


def _clean_transactions(keyed: DataFrame, outlier_method: str = "iqr", calibrate: bool = True) -> DataFrame:
    """B28 of rows that have their keys and are cheap to read again."""
    out = fill_with_group_median(keyed, "article_id", "price")
    out = fill_with_mode(out, "sales_channel_id", source=keyed)
    out = treat_price_outliers(out, outlier_method)
    # Clipping keeps every row, so the channel mode needs no price; removal changes the rows.
    source = fill_with_mode(keyed, "sales_channel_id") if outlier_method == "iqr" else out
    out = repair_domain(out, "sales_channel_id", VALID_CHANNELS, "sales_channel_corrected", source=source)
    if calibrate:
        out = calibrate_prices(out)
    out = ensure_flags(
        out,
        price_outlier_capped=False,
        sales_channel_corrected=False,
        price_percentile_calibrated=True,
    )
    return normalise_transaction_types(out)


def clean_customers(df: DataFrame) -> DataFrame:
    """B29."""
    out = fill_with_constants(drop_duplicate_rows(df))
    out = fill_with_median(out, "age")
    out = repair_range(out, "age", *AGE_RANGE, "age_corrected")
    return ensure_flags(out, **{f"{c}_imputed": False for c in [*CUSTOMER_FILLS, "age"]}, age_corrected=False)


def clean_articles(df: DataFrame) -> DataFrame:
    """B30."""
    out = fill_articles(drop_duplicate_rows(df))
    codes = [c for c in ("product_type_no", "graphical_appearance_no") if c in df.columns]
    out = repair_negative_codes(out, codes)
    if isinstance(out.schema["product_code"].dataType, T.NumericType):
        out = flag_range(out, "product_code", *PRODUCT_CODE_RANGE, "product_code_invalid")
    return ensure_flags(out, product_code_invalid=False)


def select_article_columns(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The final article table: id, every name column, description and given extras."""
    return df.select(
        "article_id", *columns_like(df, suffix="_name"), *[c for c in ("detail_desc", *extra) if c in df.columns]
    )


# --- reports --------------------------------------------------------------------------------------


def _report_rows(one_row: DataFrame, dataset: str, names: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Turn one row of counts into (dataset, category, column, count) rows."""
    cells = F.array(
        *[
            F.struct(
                F.lit(category).alias("category"),
                F.lit(column).alias("column"),
                F.col(name).cast("long").alias("count"),
            )
            for name, (category, column) in names.items()
        ]
    )
    return one_row.select(F.lit(dataset).alias("dataset"), F.explode(cells).alias("c")).select("dataset", "c.*")


def cleaning_report(dataset: str, raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows before and after, nulls found per column, duplicates, and rows per quality flag."""
    nulls = {f"null_{c}": ("missing", c) for c in raw.columns}
    before = raw.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_distinct(F.struct(*raw.columns)).alias("distinct_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in raw.columns],
    ).withColumn("duplicates", F.col("rows_in") - F.col("distinct_rows"))
    flags = columns_like(cleaned, types=(T.BooleanType,))
    after = cleaned.agg(
        F.count(F.lit(1)).alias("rows_out"), *[F.count_if(F.col(f)).alias(f) for f in flags]
    )
    return _report_rows(
        before, dataset, {"rows_in": ("rows", "before"), "duplicates": ("duplicates", "row"), **nulls}
    ).unionByName(
        _report_rows(after, dataset, {"rows_out": ("rows", "after"), **{f: ("flag", f) for f in flags}})
    )


def clean_all(
    transactions: DataFrame, customers: DataFrame, articles: DataFrame, output_dir: str, report: bool = True, write_csv_too: bool = False
) -> dict[str, str]:
    """Clean and write all three tables; returns the path of each as ``<table>_parquet`` (and ``<table>_csv``), and of
    the report of all three as ``cleaning_report``."""
    # The steps and the report read the transactions several times, whatever joins are behind them.
    transactions = materialised(transactions)
    raw = {"transactions": transactions, "customers": customers, "articles": articles}
    cleaned = {"transactions": _clean_transactions(drop_missing_keys(transactions)), "customers": clean_customers(customers), "articles": clean_articles(articles)}
    paths = write_cleaned(cleaned, output_dir, write_csv_too)
    paths = {name if name.endswith("_csv") else f"{name}_parquet": path for name, path in paths.items()}
    if report:
        # The report reads the written tables, so nothing is cleaned twice.
        parts = [cleaning_report(n, raw[n], df.sparkSession.read.parquet(paths[f"{n}_parquet"])) for n, df in cleaned.items()]
        paths["cleaning_report"] = write_json(functools.reduce(DataFrame.unionByName, parts), f"{output_dir}/cleaning_report.json")
    return paths


def compare_statistics(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric statistics before and after, side by side per (column, metric)."""
    from basketry.operators.profiling import numeric_statistics, to_metrics

    left = to_metrics(numeric_statistics(before, columns)).withColumnRenamed("value", "before")
    right = to_metrics(numeric_statistics(after, columns)).withColumnRenamed("value", "after")
    return left.join(right, ["column", "metric"], "full")
