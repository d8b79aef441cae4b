"""Rule-based segments and cluster profiles."""

from pyspark.sql import functions as F

from basketry.operators import features, segments
from basketry.plans.q_features import FEATURE_EXTRA, feature_table
from basketry.plans.registry import query
from basketry.sources import views
from basketry.sources.views import with_views


def rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def on_features(body, extra=""):
    return with_views("tx ar cu", body, FEATURE_EXTRA + (",\n" + extra if extra else ""))


def _quintile_sql(c):
    edges = [f"(SELECT quantile_cont({c}, {q}) FROM feat)" for q in (0.2, 0.4, 0.6, 0.8)]
    return " + ".join(["1"] + [f"({c} > {e})::INT" for e in edges])


@query(
    "e06_rfm_scores",
    on_features(
        f"""SELECT *, r_score + f_score + m_score AS rfm_score FROM (SELECT customer_id, {_quintile_sql("recency")} AS r_score,
 {_quintile_sql("frequency")} AS f_score, {_quintile_sql("monetary")} AS m_score FROM feat)"""
    ),
)
def e06(spark, d):
    return segments.rfm_scores(feature_table(spark, d))


STAGES = """staged AS (SELECT *, CASE WHEN recency <= 30 AND frequency >= 3 THEN 'Active High-Value'
 WHEN recency <= 30 AND frequency < 3 THEN 'Active Low-Frequency' WHEN recency > 30 AND recency <= 90 AND frequency >= 2 THEN 'At Risk'
 WHEN recency > 90 AND frequency >= 3 THEN 'Dormant High-Value' WHEN frequency = 1 THEN 'One-Time Purchaser'
 ELSE 'Inactive' END AS lifecycle_stage,
 CASE WHEN monetary >= (SELECT quantile_cont(monetary, 0.8) FROM feat) THEN 'High Value'
 WHEN monetary >= (SELECT quantile_cont(monetary, 0.5) FROM feat) THEN 'Medium Value' ELSE 'Low Value' END AS value_tier FROM feat)"""


def stage_query(name, stage):
    @query(
        name,
        on_features(
            f"""SELECT {stage}, count(*) AS customers, round(sum(monetary), 2) AS value, round(avg(monetary), 4) AS mean_value,
 round(count(*) * 100.0 / (SELECT count(*) FROM feat), 4) AS customer_pct,
 round(sum(monetary) * 100 / (SELECT sum(monetary) FROM feat), 4) AS value_pct FROM staged GROUP BY {stage}""",
            STAGES,
        ),
    )
    def run(spark, d):
        out = segments.stage_distribution(segments.with_stages(feature_table(spark, d)), stage)
        return rounded(rounded(out, ["value"], 2), ["mean_value", "customer_pct", "value_pct"])

    return run


stage_query("d31_lifecycle_stages", "lifecycle_stage")
stage_query("d31_value_tiers", "value_tier")


@query(
    "d32_base_and_concentration",
    on_features(
        """SELECT count(*) AS customers, count(*) FILTER (frequency > 0) AS active, count(*) FILTER (frequency > 1) AS repeat,
 count(*) FILTER (frequency = 1) AS one_time,
 round(count(*) FILTER (frequency > 1) * 100.0 / count(*) FILTER (frequency > 0), 4) AS retention_pct,
 count(*) FILTER (monetary >= h) AS top_customers, round(sum(monetary) FILTER (monetary >= h), 2) AS top_revenue,
 round(sum(monetary) FILTER (monetary >= h) * 100 / sum(monetary), 4) AS top_revenue_pct,
 round(avg(monetary), 4) AS mean_value, round(max(monetary) / avg(monetary), 4) AS max_over_mean
FROM feat, (SELECT quantile_cont(monetary, 0.8) AS h FROM feat)"""
    ),
)
def d32(spark, d):
    out = segments.base_and_concentration(feature_table(spark, d))
    return rounded(
        rounded(out, ["top_revenue"], 2), ["retention_pct", "top_revenue_pct", "mean_value", "max_over_mean"]
    )


@query(
    "d33_behaviour_levels",
    on_features(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, round(avg({c}), 6) AS mean,
 CASE WHEN avg({c}) > {h} THEN 'High' WHEN avg({c}) > {m} THEN 'Medium' ELSE 'Low' END AS level FROM feat"""
            for c, h, m in segments.LEVELS
        )
    ),
)
def d33(spark, d):
    return rounded(segments.behaviour_levels(feature_table(spark, d)), ["mean"], 6)


@query(
    "d34_high_value_profile",
    on_features(
        "SELECT count(*) AS customers, "
        + ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in features.FEATURES)
        + """ FROM feat WHERE frequency > 0 AND monetary >=
 (SELECT quantile_cont(monetary, 0.9) FROM feat WHERE frequency > 0)"""
    ),
)
def d34(spark, d):
    out = segments.high_value_profile(feature_table(spark, d), features.FEATURES)
    return rounded(out, [f"mean_{c}" for c in features.FEATURES])


CATALOGUE = ["product_group_name", "garment_group_name", "colour_group_name", "product_type_name", "prod_name"]


@query(
    "d36_catalogue_diversity",
    with_views(
        "ar",
        """SELECT "column", k AS distinct_values, round(k / n, 6) AS diversity, round(t * 100.0 / n, 4) AS top_pct,
 CASE WHEN t * 100.0 / n > 50 THEN 'High' WHEN t * 100.0 / n > 25 THEN 'Medium' ELSE 'Low' END AS concentration,
 CASE WHEN k < 10 THEN 'expand' WHEN k > 100 THEN 'consolidate' ELSE 'keep' END AS variety FROM ("""
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) AS k, sum(c) AS n, max(c) AS t FROM
 (SELECT count(*) AS c FROM ar GROUP BY {c})"""
            for c in CATALOGUE
        )
        + ")",
    ),
)
def d36(spark, d):
    out = segments.catalogue_diversity(views.articles(spark, d), CATALOGUE)
    return rounded(rounded(out, ["diversity"], 6), ["top_pct"])


# Cluster reports run on a fixed labelling, so that SQL can check them: the label column of the
# embeddings for articles, the age group for customers.
SIZES = "sz AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label)"


def embeddings(spark, d):
    return views.table(spark, d, "embeddings").select("vec_id", "label")


@query(
    "d37_cluster_sizes",
    f"""WITH {SIZES} SELECT label, size, round(size * 100.0 / (SELECT sum(size) FROM sz), 4) AS pct,
 (sum(size) OVER w)::BIGINT AS running, round(sum(size) OVER w * 100.0 / (SELECT sum(size) FROM sz), 4) AS cumulative_pct FROM sz
WINDOW w AS (ORDER BY size DESC, label ROWS UNBOUNDED PRECEDING)""",
)
def d37(spark, d):
    return rounded(segments.cluster_sizes(embeddings(spark, d), "label"), ["pct", "cumulative_pct"])


@query(
    "d37_cluster_balance",
    f"""WITH {SIZES}, r AS (SELECT *, row_number() OVER (ORDER BY size DESC, label) AS i FROM sz)
SELECT count(*) AS clusters, sum(size)::BIGINT AS labelled, round(sum(size) FILTER (i <= 3) * 100.0 / sum(size), 4) AS top3_pct,
 round(sum(size) FILTER (i <= 5) * 100.0 / sum(size), 4) AS top5_pct, round(sum(size) FILTER (i <= 10) * 100.0 / sum(size), 4) AS top10_pct,
 max(size) AS largest, min(size) AS smallest, round(max(size) / min(size), 4) AS size_ratio,
 round(stddev_samp(size) / avg(size), 4) AS cv, CASE WHEN stddev_samp(size) / avg(size) < 0.5 THEN 'Well-balanced'
 WHEN stddev_samp(size) / avg(size) < 1 THEN 'Moderately balanced' ELSE 'Imbalanced' END AS balance FROM r""",
)
def d37_balance(spark, d):
    out = segments.cluster_balance(embeddings(spark, d), "label")
    return rounded(out, ["top3_pct", "top5_pct", "top10_pct", "size_ratio", "cv"])


AGE_CASE = """CASE WHEN age < 25 THEN 'Under 25' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44'
 WHEN age < 55 THEN '45-54' ELSE '55+' END"""
SEGS = f"seg AS (SELECT *, {AGE_CASE} AS age_group FROM cu)"


def by_age(spark, d):
    return views.customers(spark, d).withColumn("age_group", segments.age_group(F.col("age")))


@query(
    "g08_age_groups",
    with_views("cu", "SELECT age_group, count(*) AS n FROM seg GROUP BY age_group", SEGS),
)
def g08(spark, d):
    return by_age(spark, d).groupBy("age_group").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d38_crosstab",
    with_views(
        "cu",
        """SELECT age_group, club_member_status, count(*) AS n,
 round(count(*) * 100.0 / (SELECT count(*) FROM seg t WHERE t.age_group = seg.age_group), 4) AS row_pct
FROM seg GROUP BY age_group, club_member_status""",
        SEGS,
    ),
)
def d38(spark, d):
    return rounded(segments.crosstab(by_age(spark, d), "age_group", "club_member_status"), ["row_pct"])


@query(
    "d38_crosstab_wide",
    with_views(
        "cu",
        """SELECT age_group, round(count(*) FILTER (fashion_news_frequency = 'Regularly') * 100.0 / count(*), 4) AS "Regularly",
 round(count(*) FILTER (fashion_news_frequency = 'NONE') * 100.0 / count(*), 4) AS "NONE" FROM seg GROUP BY age_group""",
        SEGS,
    ),
)
def d38_wide(spark, d):
    out = segments.crosstab_wide(by_age(spark, d), "age_group", "fashion_news_frequency", ["Regularly", "NONE"])
    return rounded(out, ["Regularly", "NONE"])


@query(
    "d39_cluster_statistics",
    with_views(
        "cu",
        """SELECT age_group, count(*) AS count, round(avg(balance), 4) AS mean, round(stddev_samp(balance), 4) AS std,
 min(balance) AS min, max(balance) AS max, round(quantile_cont(balance, 0.25), 4) AS q1, round(median(balance), 4) AS median,
 round(quantile_cont(balance, 0.75), 4) AS q3,
 (SELECT club_member_status FROM seg t WHERE t.age_group = seg.age_group GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant,
 (SELECT count(*) FROM seg t WHERE t.age_group = seg.age_group GROUP BY club_member_status ORDER BY 1 DESC LIMIT 1) AS dominant_n
FROM seg GROUP BY age_group""",
        SEGS,
    ),
)
def d39(spark, d):
    c = by_age(spark, d)
    out = segments.cluster_statistics(c, "age_group", "balance").join(
        segments.dominant_category(c, "age_group", "club_member_status"), "age_group"
    )
    return rounded(out, ["mean", "std", "q1", "median", "q3"])


@query(
    "d40_cluster_means",
    with_views(
        "cu",
        """SELECT age_group, round((a - m) / s, 4) AS age, round((b - m) / s, 4) AS balance, round((f - m) / s, 4) AS "FN" FROM
(SELECT *, (a + b + f) / 3 AS m, sqrt((a * a + b * b + f * f) / 3 - ((a + b + f) / 3) ** 2) AS s FROM
 (SELECT age_group, avg(age) AS a, avg(balance) AS b, avg(FN) AS f FROM seg GROUP BY age_group))""",
        SEGS,
    ),
)
def d40(spark, d):
    cols = ["age", "balance", "FN"]
    means = segments.cluster_means(by_age(spark, d), "age_group", cols)
    return rounded(segments.standardise_rows(means, "age_group", cols), cols)


@query(
    "d40_boolean_rates",
    with_views(
        "cu",
        """SELECT age_group, round(avg(age), 4) AS age, round(avg((FN > 0)::INT) * 100, 4) AS news_pct FROM seg GROUP BY age_group""",
        SEGS,
    ),
)
def d40_rates(spark, d):
    c = by_age(spark, d).withColumn("news", F.col("FN") > 0)
    return rounded(segments.cluster_means(c, "age_group", ["age"], ["news"]), ["age", "news_pct"])


@query(
    "d41_deviations",
    with_views(
        "cu",
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"""SELECT age_group, '{c}' AS feature, round(avg({c}), 4) AS mean,
 round((avg({c}) / (SELECT avg({c}) FROM cu) - 1) * 100, 4) AS deviation_pct FROM seg GROUP BY age_group"""
            for c in ("age", "balance", "FN")
        )
        + ") WHERE abs(deviation_pct) > 10",
        SEGS,
    ),
)
def d41(spark, d):
    out = segments.deviations(by_age(spark, d), "age_group", ["age", "balance", "FN"])
    return rounded(out, ["mean", "deviation_pct"])


@query(
    "d42_sub_population",
    with_views(
        "cu",
        """SELECT sum(n)::BIGINT AS members, arg_max(age_group, (n, -o)) AS top_label, round(max(n) * 100.0 / sum(n), 4) AS top_label_pct
FROM (SELECT age_group, count(*) AS n, row_number() OVER (ORDER BY age_group) AS o FROM seg
 WHERE balance >= (SELECT quantile_cont(balance, 0.8) FROM cu) GROUP BY age_group)""",
        SEGS,
    ),
)
def d42(spark, d):
    out = segments.sub_population_insight(by_age(spark, d), "balance", 0.8, "age_group")
    return rounded(out, ["top_label_pct"])


@query(
    "d44_label_summary",
    """SELECT count(*) AS n_rows, count(DISTINCT label) FILTER (label <> 0) AS clusters,
 round(count(*) FILTER (label = 0) * 100.0 / count(*), 4) AS noise_pct,
 round((SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings WHERE label <> 0 GROUP BY label)) * 100.0
  / count(*) FILTER (label <> 0), 4) AS largest_pct FROM embeddings""",
)
def d44(spark, d):
    return rounded(segments.label_summary(embeddings(spark, d), "label", noise=0), ["noise_pct", "largest_pct"])


@query(
    "c05_attach_labels",
    with_views(
        "ar",
        """SELECT article_id, product_group_name, label FROM ar LEFT JOIN embeddings ON article_id = vec_id""",
    ),
)
def c05(spark, d):
    labels = embeddings(spark, d).withColumnRenamed("vec_id", "article_id")
    arts = views.articles(spark, d).select("article_id", "product_group_name")
    return segments.attach_labels(arts, [labels], "article_id")


@query(
    "c07_merge_label_sets",
    with_views(
        "tx ar cu",
        """SELECT customer_id, age_group, lifecycle_stage, value_tier FROM seg LEFT JOIN staged USING (customer_id)""",
        FEATURE_EXTRA + ",\n" + STAGES + ",\n" + SEGS,
    ),
)
def c07(spark, d):
    staged = segments.with_stages(feature_table(spark, d))
    return segments.attach_labels(
        by_age(spark, d).select("customer_id", "age_group"),
        [staged.select("customer_id", "lifecycle_stage"), staged.select("customer_id", "value_tier")],
        "customer_id",
    )


@query(
    "c09_label_overlap",
    with_views(
        "rcu",
        """SELECT count(*) AS n_rows, count(club_member_status) AS left_labelled, count(fashion_news_frequency) AS right_labelled,
 count(*) FILTER (club_member_status IS NOT NULL AND fashion_news_frequency IS NOT NULL) AS both_labelled,
 round(count(*) FILTER (club_member_status IS NOT NULL AND fashion_news_frequency IS NOT NULL) * 100.0 / count(*), 4) AS both_pct FROM rcu""",
    ),
)
def c09(spark, d):
    out = segments.label_overlap(views.raw_customers(spark, d), "club_member_status", "fashion_news_frequency")
    return rounded(out, ["both_pct"])


@query(
    "e10_first_members",
    """SELECT label, vec_id, position FROM (SELECT label, vec_id,
 row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':42'), vec_id) AS position FROM embeddings) WHERE position <= 5""",
)
def e10(spark, d):
    from basketry.sources.tables import seeded_key

    order = F.struct(seeded_key(F.col("vec_id"), 42), F.col("vec_id"))
    return segments.first_members(embeddings(spark, d), "label", order, 5)


CATS = ["product_group_name", "garment_group_name", "colour_group_name", "product_type_name", "prod_name"]


@query(
    "i16_interpret_clusters",
    with_views(
        "ar",
        """SELECT label, "column", top_values, size, pct, first_ids FROM
(SELECT label, "column", string_agg(value || ':' || n, ',' ORDER BY i) AS top_values FROM (SELECT *,
  row_number() OVER (PARTITION BY label, "column" ORDER BY n DESC, value) AS i FROM vc) WHERE i <= 5 GROUP BY label, "column")
JOIN (SELECT label, count(*) AS size, round(count(*) * 100.0 / (SELECT count(*) FROM lab), 4) AS pct FROM lab GROUP BY label) USING (label)
JOIN (SELECT label, string_agg(article_id, ',' ORDER BY article_id) AS first_ids FROM (SELECT label, article_id,
  row_number() OVER (PARTITION BY label ORDER BY article_id) AS i FROM lab) WHERE i <= 20 GROUP BY label) USING (label)""",
        "lab AS (SELECT ar.*, label FROM ar JOIN embeddings ON article_id = vec_id), vc AS ("
        + " UNION ALL ".join(
            f"SELECT label, '{c}' AS \"column\", {c} AS value, count(*) AS n FROM lab GROUP BY ALL" for c in CATS
        )
        + ")",
    ),
)
def i16(spark, d):
    labelled = views.articles(spark, d).join(
        embeddings(spark, d).withColumnRenamed("vec_id", "article_id"), "article_id"
    )
    return rounded(segments.interpret_clusters(labelled, "label", "article_id", CATS), ["pct"])


def profile_sql(approach):
    means = list(segments.PROFILE_MEANS.items())[: 3 if approach == "rfm" else None]
    cols = [f"avg({c}) AS {n}" for n, c in means]
    if approach == "behavioural":
        cols += [
            "avg(age) AS avg_age",
            "avg(Active) * 100 AS active_pct",
            "avg((club_member_status = 'ACTIVE')::INT) * 100 AS club_member_pct",
        ]
    return f"""prof AS (SELECT age_group, count(*) AS size, count(*) * 100.0 / (SELECT count(*) FROM seg) AS pct,
 {", ".join(cols)} FROM seg JOIN feat USING (customer_id) GROUP BY age_group)"""


def label_case(approach):
    out = []
    for rule, label in segments.LABEL_RULES[approach]:
        words = [segments.RULE_NAMES.get(w, w) for w in rule.split(" ")]
        out.append(f"WHEN {' '.join(words)} THEN '{label}'")
    return "CASE " + " ".join(out) + " END"


def profiles(spark, d, approach):
    joined = by_age(spark, d).join(feature_table(spark, d), "customer_id")
    out = segments.cluster_profiles(joined, "age_group", approach)
    return segments.business_label(out, approach)


def profile_query(approach):
    extra = [n for n in ("avg_age", "active_pct", "club_member_pct")] if approach == "behavioural" else []
    means = list(segments.PROFILE_MEANS)[: 3 if approach == "rfm" else None] + extra + ["pct"]
    body = (
        "SELECT age_group, size, "
        + ", ".join(f"round({m}, 4) AS {m}" for m in means)
        + f", {label_case(approach)} AS business_label FROM prof"
    )

    @query(f"i17_profile_{approach}", on_features(body, SEGS + ",\n" + profile_sql(approach)))
    def run(spark, d):
        return rounded(profiles(spark, d, approach), means)

    return run


for _approach in segments.APPROACHES:
    profile_query(_approach)
del _approach


# Every rule of every approach, reached by scaling the customer features to the range of the rules.
_SCALED = """scaled AS (SELECT customer_id, recency % 100 AS avg_recency, frequency % 12 AS avg_frequency,
 monetary::BIGINT % 700 AS avg_monetary, purchase_diversity_score * 0.7 AS avg_diversity_score,
 price_sensitivity_index * 2.5 AS avg_price_sensitivity, colour_preference_entropy * 1.2 AS avg_colour_entropy,
 style_consistency_score * 5 AS avg_style_consistency, age AS avg_age, customer_id % 101 AS active_pct
 FROM feat JOIN cu USING (customer_id))"""


def label_query(approach):
    @query(
        f"i18_labels_{approach}",
        on_features(f"SELECT customer_id, {label_case(approach)} AS business_label FROM scaled", _SCALED),
    )
    def run(spark, d):
        f = feature_table(spark, d).join(views.customers(spark, d).select("customer_id", "age"), "customer_id")
        scaled = f.select(
            "customer_id",
            (F.col("recency") % 100).alias("avg_recency"),
            (F.col("frequency") % 12).alias("avg_frequency"),
            (F.rint("monetary").cast("bigint") % 700).alias("avg_monetary"),
            (F.col("purchase_diversity_score") * 0.7).alias("avg_diversity_score"),
            (F.col("price_sensitivity_index") * 2.5).alias("avg_price_sensitivity"),
            (F.col("colour_preference_entropy") * 1.2).alias("avg_colour_entropy"),
            (F.col("style_consistency_score") * 5).alias("avg_style_consistency"),
            F.col("age").alias("avg_age"),
            (F.col("customer_id") % 101).alias("active_pct"),
        )
        return segments.business_label(scaled, approach).select("customer_id", "business_label")

    return run


for _approach in segments.APPROACHES:
    label_query(_approach)
del _approach
