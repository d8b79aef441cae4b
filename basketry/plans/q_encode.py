"""Encoding, scaling and combination with embeddings."""

from pyspark.sql import functions as F

from basketry.operators import encode
from basketry.plans.registry import query
from basketry.sources import tables, views
from basketry.sources.views import with_views


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


CANDIDATES = ["product_group_name", "garment_group_name", "colour_group_name", "product_type_name"]


#: All dimensions of the embeddings, as columns of a DuckDB query.
WIDE = ", ".join(f"embedding[{i + 1}]::DOUBLE AS svd_{i + 1:03d}" for i in range(64))


def wide_embeddings(spark, d, size=64):
    e = views.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("article_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return tables.unpack_vector(e, "article_id", "svd_", size)


@query(
    "h12_select_categorical",
    with_views(
        "ar",
        "SELECT feature FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n FROM ar"
            for c in CANDIDATES
        )
        + ") WHERE n > 1",
    ),
)
def h12(spark, d):
    chosen = encode.select_categorical(views.articles(spark, d))
    return spark.createDataFrame([(c,) for c in chosen], "feature string")


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "h13_encode_categorical",
    with_views(
        "ar",
        """SELECT article_id, (dense_rank() OVER (ORDER BY product_group_name) - 1)::DOUBLE AS product_group_name_encoded, """
        + ", ".join(f"""(garment_group_name = '{t}')::INT::DOUBLE AS "garment_group_name_{t}\"""" for t in TYPES[1:])
        + " FROM ar",
    ),
)
def h13(spark, d):
    out, _ = encode.encode_categorical(
        views.articles(spark, d), "article_id", ["product_group_name", "garment_group_name"]
    )
    return out


@query(
    "i02_label_encoding",
    with_views(
        "rcu",
        """SELECT customer_id, (dense_rank() OVER (ORDER BY coalesce(club_member_status, 'Unknown')) - 1)::DOUBLE
 AS club_member_status_encoded, (dense_rank() OVER (ORDER BY coalesce(fashion_news_frequency, 'Unknown')) - 1)::DOUBLE
 AS fashion_news_frequency_encoded FROM rcu""",
    ),
)
def i02(spark, d):
    out = encode.label_encode(views.raw_customers(spark, d), ["club_member_status", "fashion_news_frequency"])
    return out.select("customer_id", "club_member_status_encoded", "fashion_news_frequency_encoded")


@query(
    "i03_standardise",
    """SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6)
 AS c_acctbal, 0.0::DOUBLE AS one FROM customer""",
)
def i03(spark, d):
    c = views.table(spark, d, "customer").select("c_custkey", "c_acctbal").withColumn("one", F.lit(1.0))
    return rounded(encode.standardise(c, ["c_acctbal", "one"]), ["c_acctbal"])


@query(
    "c02_embeddings_with_codes",
    with_views(
        "ar",
        f"""SELECT article_id, {WIDE}, code AS product_group_name_encoded FROM embeddings
JOIN (SELECT article_id, (dense_rank() OVER (ORDER BY product_group_name) - 1)::DOUBLE AS code FROM ar) ON article_id = vec_id""",
    ),
)
def c02(spark, d):
    codes = encode.label_encode(views.articles(spark, d), ["product_group_name"]).select(
        "article_id", "product_group_name_encoded"
    )
    return encode.join_on_key(wide_embeddings(spark, d), codes, "article_id")


COLOURS = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
KINDS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
#: One-hot columns of all attributes with few values, the first value of each dropped.
_HOT = [("garment_group_name", t) for t in TYPES[1:]] + [("colour_group_name", t) for t in COLOURS[1:]] + [("product_type_name", t) for t in KINDS[1:]]
_SCALED = [f"svd_{i + 1:03d}" for i in range(64)] + ["product_group_name_encoded"] + [f"{c}_{t}" for c, t in _HOT]


@query(
    "h14_combined_scaled",
    with_views(
        "ar",
        "SELECT article_id, "
        + ", ".join(
            f'round(("{c}" - avg("{c}") OVER ()) / coalesce(nullif(stddev_pop("{c}") OVER (), 0), 1), 6) AS "{c}"' for c in _SCALED
        )
        + " FROM j",
        f"""j AS (SELECT article_id, {WIDE}, e.* EXCLUDE (article_id) FROM embeddings
 JOIN (SELECT article_id, (dense_rank() OVER (ORDER BY product_group_name) - 1)::DOUBLE AS product_group_name_encoded, """
        + ", ".join(f"""({c} = '{t}')::INT::DOUBLE AS "{c}_{t}\"""" for c, t in _HOT)
        + " FROM ar) e ON article_id = vec_id)",
    ),
)
def h14(spark, d):
    out, names = encode.combined_features(wide_embeddings(spark, d), views.articles(spark, d))
    return rounded(out, names)


# Embedding columns, then the one-hot columns by attribute and value, then the label codes.
_NAMES = [f"svd_{i + 1:03d}" for i in range(64)]
_NAMES += [f"{c}_{t}" for c in ("product_type_name", "colour_group_name", "garment_group_name") for a, t in _HOT if a == c] + ["product_group_name_encoded"]


@query("h15_combined_feature_names", f"SELECT (i - 1)::INT AS position, ({_NAMES})[i] AS feature FROM range(1, {len(_NAMES) + 1}) r(i)")
def h15(spark, d):
    _, names = encode.combined_features(wide_embeddings(spark, d), views.articles(spark, d))
    return encode.feature_names(views.articles(spark, d), names)


@query(
    "h16_embeddings_with_metadata",
    with_views(
        "ar",
        f"""SELECT article_id, {WIDE}, product_group_name, garment_group_name, colour_group_name
FROM embeddings JOIN ar ON article_id = vec_id""",
    ),
)
def h16(spark, d):
    return encode.with_metadata(wide_embeddings(spark, d), views.articles(spark, d))


# A row has one 1 per attribute, so the squared singular values of all components add up to rows times attributes.
@query("h17_categorical_svd", with_views("ar", f"SELECT article_id, true AS unit_length, count(*) OVER () * {len(CANDIDATES)} AS energy FROM ar"))
def h17(spark, d):
    out, singular = encode.categorical_svd(views.articles(spark, d), "article_id", CANDIDATES)
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    unit = F.abs(norm - 1) < 1e-9
    return out.select("article_id", unit.alias("unit_length"), F.lit(int(round(float((singular**2).sum())))).cast("bigint").alias("energy"))
