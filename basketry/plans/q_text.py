"""Texts (G6, G7, H1-H11, K8, D43, D46)."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.functions.text import embedding_text
from basketry.operators import filters, text, vectors
from basketry.plans.registry import query
from basketry.session import materialised
from basketry.sources import views
from basketry.sources.views import with_views


def rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


VALID = r"""valid AS (SELECT * FROM (SELECT article_id, regexp_replace(coalesce(detail_desc, ''), '^\s+|\s+$', '', 'g') AS detail_desc
 FROM rtext) WHERE length(detail_desc) > 0 AND lower(detail_desc) <> 'no_description')"""
CLEAN = r"""clean AS (SELECT article_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(detail_desc), '[^a-z]', ' ', 'g'),
 '\b[a-z]\b', ' ', 'g'), '\s+', ' ', 'g')) AS detail_desc FROM valid)"""


def valid(spark, d):
    return filters.valid_texts(views.raw_texts(spark, d))


def clean(spark, d):
    return text.light_clean(valid(spark, d), "detail_desc")


@query("h01_light_clean", with_views("rtext", "SELECT * FROM clean", f"{VALID}, {CLEAN}"))
def h01(spark, d):
    return clean(spark, d)


STOP = ", ".join(f"'{w}'" for w in (*text.STOP_WORDS, text.SENTINEL, "de"))
WORDS = rf"""toks AS (SELECT article_id, w, i FROM (SELECT article_id, unnest(x) AS w, unnest(range(len(x))) AS i FROM
 (SELECT article_id, regexp_extract_all(lower(detail_desc), '[\p{{L}}\p{{M}}]+') AS x FROM valid))
 WHERE length(w) >= 2 AND w NOT IN ({STOP}))"""


@query(
    "h02_words",
    with_views(
        "rtext",
        """SELECT v.article_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS words FROM valid v LEFT JOIN toks USING (article_id)
GROUP BY v.article_id""",
        f"{VALID}, {WORDS}",
    ),
)
def h02(spark, d):
    tokens = text.words(F.col("detail_desc"), ["DE"])
    return valid(spark, d).select("article_id", F.array_join(tokens, " ").alias("words"))


# A dictionary derived from the corpus: a word in -s stands for the word without it, if that occurs.
@query(
    "h03_normalise_words",
    with_views(
        "rtext",
        """SELECT article_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS words FROM toks LEFT JOIN dict ON w = surface
GROUP BY article_id""",
        f"""{VALID}, {WORDS}, dict AS (SELECT DISTINCT a.w AS surface, b.w AS lemma FROM toks a
 JOIN (SELECT DISTINCT w FROM toks) b ON a.w = b.w || 's')""",
    ),
)
def h03(spark, d):
    # Words are taken from the texts once, and the distinct ones found once, for both sides of the dictionary.
    tokens = materialised(valid(spark, d).select("article_id", text.words(F.col("detail_desc"), ["DE"]).alias("words")))
    surface = materialised(tokens.select(F.explode("words").alias("surface")).distinct())
    dictionary = surface.join(
        surface.select(F.concat("surface", F.lit("s")).alias("plural"), F.col("surface").alias("lemma")),
        F.col("surface") == F.col("plural"),
    ).select(surface["surface"], "lemma")
    out = text.normalise_words(tokens, "article_id", "words", dictionary)
    return out.select("article_id", F.array_join("words", " ").alias("words"))


GRAMS = r"""w1 AS (SELECT article_id, unnest(x) AS w, unnest(range(len(x))) AS i FROM
 (SELECT article_id, list_filter(string_split(detail_desc, ' '), lambda t: length(t) >= 2) AS x FROM clean)),
grams AS (SELECT article_id, w AS term FROM w1 UNION ALL SELECT a.article_id, a.w || ' ' || b.w FROM w1 a
 JOIN w1 b ON a.article_id = b.article_id AND b.i = a.i + 1),
tc AS (SELECT article_id, term, count(*) AS tf FROM grams GROUP BY ALL),
size AS (SELECT CASE WHEN n < 5000 THEN greatest(1, round_even(0.002 * n, 0)) ELSE greatest(5, round_even(0.001 * n, 0)) END AS least,
 0.8 * n AS most, CASE WHEN n >= 100000 THEN 50000 ELSE 20000 END AS kept FROM (SELECT count(*) AS n FROM clean)),
top AS (SELECT term, df, tf FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, row_number() OVER (ORDER BY sum(tf) DESC, term) AS place
 FROM tc GROUP BY term HAVING count(*) >= (SELECT least FROM size) AND count(*) <= (SELECT most FROM size)) WHERE place <= (SELECT kept FROM size)),
vocab AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_id FROM top)"""
TEXT_CTES = f"{VALID}, {CLEAN}, {GRAMS}"


def fitted(spark, d):
    """Texts, their number and the vocabulary, whose bounds follow that number."""
    docs = materialised(text.light_clean(filters.valid_texts(views.raw_texts(spark, d)), "detail_desc"))
    n = docs.count()
    return docs, n, text.vocabulary(docs, "article_id", "detail_desc", n, **text.tfidf_defaults(n))


@query("h04_vocabulary", with_views("rtext", "SELECT * FROM vocab", TEXT_CTES))
def h04(spark, d):
    return fitted(spark, d)[2]


@query(
    "h05_vocabulary_defaults",
    with_views(
        "rtext",
        """SELECT n AS n_docs, CASE WHEN n < 5000 THEN greatest(1, round_even(0.002 * greatest(n, 1), 0))
 ELSE greatest(5, round_even(0.001 * n, 0)) END::BIGINT AS min_df, 0.8::DOUBLE AS max_df,
 CASE WHEN n >= 100000 THEN 50000 ELSE 20000 END::BIGINT AS max_features FROM (SELECT count(*) AS n FROM valid)""",
        VALID,
    ),
)
def h05(spark, d):
    docs = valid(spark, d)
    chosen = text.tfidf_defaults(docs.count())
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).select(
        "n_docs",
        F.lit(chosen["min_df"]).cast("long").alias("min_df"),
        F.lit(chosen["max_df"]).alias("max_df"),
        F.lit(chosen["max_features"]).cast("long").alias("max_features"),
    )


WEIGHTS = """raw AS (SELECT article_id, term_id, tc.tf * (ln((1 + (SELECT count(*) FROM clean)) / (1 + df)) + 1) AS w
 FROM tc JOIN vocab USING (term)), len AS (SELECT article_id, sqrt(sum(w * w)) AS l FROM raw GROUP BY article_id)"""


@query(
    "h06_tfidf",
    with_views(
        "rtext",
        "SELECT article_id, term_id, round(w / l, 6) AS weight FROM raw JOIN len USING (article_id)",
        f"{TEXT_CTES}, {WEIGHTS}",
    ),
)
def h06(spark, d):
    docs, n, vocab = fitted(spark, d)
    return rounded(text.tfidf(docs, "article_id", "detail_desc", vocab, n), ["weight"], 6)


# Scoring other texts (the conversations) with the vocabulary of the product texts.
@query(
    "h07_score_new_texts",
    with_views(
        "rtext",
        "SELECT article_id, term_id, round(w / l, 6) AS weight FROM nraw JOIN nlen USING (article_id)",
        rf"""{TEXT_CTES}, new AS (SELECT conv_id * 1000 + turn AS article_id, string_split(trim(regexp_replace(regexp_replace(regexp_replace(
  lower("text"), '[^a-z]', ' ', 'g'), '\b[a-z]\b', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS x FROM conversations),
n1 AS (SELECT article_id, unnest(x) AS w, unnest(range(len(x))) AS i FROM
 (SELECT article_id, list_filter(x, lambda t: length(t) >= 2) AS x FROM new)),
ng AS (SELECT article_id, w AS term FROM n1 UNION ALL SELECT a.article_id, a.w || ' ' || b.w FROM n1 a
 JOIN n1 b ON a.article_id = b.article_id AND b.i = a.i + 1),
nraw AS (SELECT article_id, term_id, count(*) * (ln((1 + (SELECT count(*) FROM clean)) / (1 + df)) + 1) AS w
 FROM ng JOIN vocab USING (term) GROUP BY article_id, term_id, df),
nlen AS (SELECT article_id, sqrt(sum(w * w)) AS l FROM nraw GROUP BY article_id)""",
    ),
)
def h07(spark, d):
    _, n, vocab = fitted(spark, d)
    new = views.table(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("article_id"), F.col("text").alias("detail_desc")
    )
    new = text.light_clean(new, "detail_desc")
    return rounded(text.tfidf(new, "article_id", "detail_desc", vocab, n), ["weight"], 6)


# Unit rows for every text, singular values that fall, and no more of the matrix than there is: each row has length one.
@query(
    "h08_svd_of_tfidf",
    with_views("rtext", "SELECT article_id, true AS unit_length, true AS falling, true AS bounded FROM clean", TEXT_CTES),
)
def h08(spark, d):
    docs, n, vocab = fitted(spark, d)
    matrix = text.tfidf_vectors(docs, "article_id", "detail_desc", vocab, n)
    out, singular, _ = text.svd(matrix, "article_id", 20)
    falling = all(a >= b for a, b in zip(singular, singular[1:], strict=False))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    unit = (F.abs(norm - 1) < 1e-9) | (norm == 0)
    return out.select("article_id", unit.alias("unit_length"), F.lit(falling).alias("falling"), F.lit(bool((singular**2).sum() <= n)).alias("bounded"))


EMBEDDING_TEXT = r"""et AS (SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(trim(regexp_replace("text", '\s+', ' ', 'g')),
 '[^\p{L}\p{M}\p{N}_ \-.,!?]', ' ', 'g'), '\s+', ' ', 'g')), ''), 'no description available') AS t FROM documents)"""


def embedding_texts(spark, d):
    return views.table(spark, d, "documents").select("doc_id", embedding_text(F.col("text")).alias("t"))


@query("h09_embedding_text", f"WITH {EMBEDDING_TEXT} SELECT * FROM et")
def h09(spark, d):
    return embedding_texts(spark, d)


@query(
    "h10_embed_texts",
    f"""WITH {EMBEDDING_TEXT}, c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS dim, count(*) AS n FROM
 (SELECT doc_id, unnest(string_split(t, ' ')) AS w FROM et) GROUP BY ALL)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""",
)
def h10(spark, d):
    out = text.embed(embedding_texts(spark, d), "doc_id", "t", text.hashing_encoder(64))
    flat = out.select("doc_id", F.posexplode("vector").alias("dim", "value")).filter(F.col("value") != 0)
    return rounded(flat.withColumn("dim", F.col("dim").cast("long")), ["value"], 6)


def embedding_vectors(spark, d):
    return views.table(spark, d, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")
    )


E_ENERGY = """c AS (SELECT vec_id, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings),
e AS (SELECT vec_id, sum((v - m) ** 2) AS energy FROM (SELECT *, avg(v) OVER (PARTITION BY dim) AS m FROM c) GROUP BY vec_id)"""


# All components together keep every point's distance from the mean.
@query("h11_pca", f"WITH {E_ENERGY} SELECT vec_id, round(energy, 6) AS energy, true AS unit_length FROM e")
def h11(spark, d):
    data = materialised(embedding_vectors(spark, d))
    out, _ = vectors.pca(data, "vec_id", 64)
    energy = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    unit = F.aggregate(text.unit_length(F.col("vector")), F.lit(0.0), lambda s, x: s + x * x)
    return out.select("vec_id", F.round(energy, 6).alias("energy"), (F.abs(unit - 1) < 1e-9).alias("unit_length"))


# The variances of all components add up to that of all dimensions; each ratio is one component's share of it.
@query(
    "k08_explained_variance",
    f"""WITH {E_ENERGY} SELECT i::INT AS component, true AS falling, true AS runs_up, round((SELECT sum(energy) / count(*) FROM e), 6) AS total_variance,
 i = 64 AS is_whole FROM range(1, 65) r(i)""",
)
def k08(spark, d):
    data = materialised(embedding_vectors(spark, d))
    _, ratios = vectors.pca(data, "vec_id", 64)
    table = vectors.explained_variance(spark, ratios)
    order = Window.orderBy("component")
    errors, variances = vectors.reconstruction_errors(data, "vec_id", 1)
    total = errors.agg(F.avg("energy")).first()[0]
    share = F.element_at(F.array(*[F.lit(float(v)) for v in variances]), F.col("component"))
    return table.select(
        "component",
        F.coalesce(F.col("ratio") <= F.lag("ratio").over(order) + 1e-12, F.lit(True)).alias("falling"),
        (F.abs(F.col("cumulative") - F.sum("ratio").over(order)) < 1e-9).alias("runs_up"),
        F.round(F.lit(total) * F.col("ratio") / (share / F.lit(float(variances.sum()))), 6).alias("total_variance"),
        (F.col("cumulative") > 1 - 1e-9).alias("is_whole"),
    )


# What the first components leave, and what there was: distances from the mean, and the variance of all dimensions.
@query("p02_reconstruction_errors", f"WITH {E_ENERGY} SELECT vec_id, round(energy, 6) AS energy, true AS left_over FROM e")
def p02(spark, d):
    out, _ = vectors.reconstruction_errors(embedding_vectors(spark, d), "vec_id", 8)
    left = F.col("residual").between(0, F.col("energy") + 1e-9)
    return out.select("vec_id", F.round("energy", 6).alias("energy"), left.alias("left_over"))


@query(
    "p02_reconstruction_outliers",
    f"""WITH {E_ENERGY} SELECT count(*) AS points, round(sum(energy), 6) AS energy, round(sum(energy), 6) AS from_components, true AS residual_adds_up,
 count(*) - 1 - floor(0.99 * (count(*) - 1))::BIGINT AS outliers FROM e""",
)
def p02_outliers(spark, d):
    data = materialised(embedding_vectors(spark, d))
    flagged = materialised(vectors.reconstruction_outliers(data, "vec_id", 8))
    _, variances = vectors.reconstruction_errors(data, "vec_id", 8)
    n = F.count(F.lit(1))
    return flagged.agg(
        n.alias("points"),
        F.round(F.sum("energy"), 6).alias("energy"),
        F.round(n * F.lit(float(variances.sum())), 6).alias("from_components"),
        (F.abs(F.sum("residual") - n * F.lit(float(variances[8:].sum()))) < 1e-6).alias("residual_adds_up"),
        F.count_if("outlier").alias("outliers"),
    )


E_CELLS = "cells AS (SELECT label, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(
    "d43_component_variance",
    f"""WITH {E_CELLS} SELECT dim, round(var_pop(v), 8) AS variance, row_number() OVER (ORDER BY var_pop(v) DESC, dim) AS rank
FROM cells GROUP BY dim QUALIFY rank <= 10""",
)
def d43(spark, d):
    return rounded(vectors.component_variance(embedding_vectors(spark, d), 10), ["variance"], 8)


@query(
    "d43_mean_variance",
    f"""WITH {E_CELLS} SELECT round(avg(v), 8) AS mean_variance, round(avg(s), 8) AS mean_std FROM
(SELECT var_samp(v) AS v, stddev_samp(v) AS s FROM cells GROUP BY dim)""",
)
def d43_mean(spark, d):
    return rounded(vectors.mean_variance(embedding_vectors(spark, d)), ["mean_variance", "mean_std"], 8)


@query(
    "d46_matrix_checks",
    f"""WITH {E_CELLS} SELECT count(*) AS cells, count(*) - count(v) AS missing, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS std,
 round(min(v), 8) AS min, round(max(v), 8) AS max, (SELECT round(min(m), 8) FROM x) AS min_mean, (SELECT round(max(m), 8) FROM x) AS max_mean,
 (SELECT round(min(s), 8) FROM x) AS min_std, (SELECT round(max(s), 8) FROM x) AS max_std
FROM cells""".replace(
        "SELECT count(*) AS cells", ", x AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY dim) SELECT count(*) AS cells"
    ),
)
def d46(spark, d):
    out = vectors.matrix_checks(embedding_vectors(spark, d))
    return rounded(out, [c for c in out.columns if c not in ("cells", "missing")], 8)


@query(
    "d46_dimension_statistics",
    f"""WITH {E_CELLS} SELECT dim, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS std, round(min(v), 8) AS min,
 round(max(v), 8) AS max FROM cells GROUP BY dim""",
)
def d46_dims(spark, d):
    out = vectors.dimension_statistics(embedding_vectors(spark, d))
    return rounded(out, ["mean", "std", "min", "max"], 8)


@query(
    "i22_cluster_embedding_statistics",
    f"""WITH {E_CELLS} SELECT label, any_value(n) AS size, round(avg(m), 8) AS mean, round(avg(s), 8) AS compactness FROM
(SELECT label, dim, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY label, dim) GROUP BY label""",
)
def i22(spark, d):
    return rounded(vectors.cluster_spread(embedding_vectors(spark, d), "label"), ["mean", "compactness"], 8)


def as_vectors(spark, d):
    """Embeddings as ML vectors, the input of the clustering queries."""
    return embedding_vectors(spark, d).select("vec_id", "label", array_to_vector("vector").alias("features"))
