"""Clustering and its evaluation."""

import functools

from pyspark.sql import functions as F

from basketry.operators import cluster, density, segments, vectors
from basketry.operators import cluster_metrics as metrics
from basketry.plans.q_features import FEATURE_EXTRA, feature_table
from basketry.plans.q_text import embedding_vectors
from basketry.plans.registry import query
from basketry.session import materialised
from basketry.sources import views
from basketry.sources.views import with_views


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def full_features(spark, d):
    return feature_table(spark, d).join(views.customers(spark, d), "customer_id")


def _z(c):
    return f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)"


def prepare_query(approach):
    cols = list(cluster.FEATURE_SETS[approach])
    source = "feat JOIN cu USING (customer_id)"
    if approach == "behavioural":
        cols += ["cl", "fa"]
        source = """(SELECT *, dense_rank() OVER (ORDER BY club_member_status) - 1 AS cl,
 dense_rank() OVER (ORDER BY fashion_news_frequency) - 1 AS fa FROM feat JOIN cu USING (customer_id))"""

    @query(
        f"i01_features_{approach}",
        with_views(
            "tx ar cu",
            "SELECT customer_id, "
            + ", ".join(f"round({_z(c)}, 4) AS f{i:02d}" for i, c in enumerate(cols))
            + f" FROM {source}",
            FEATURE_EXTRA,
        ),
    )
    def run(spark, d):
        out = cluster.prepare_features(full_features(spark, d), approach)
        return out.select(
            "customer_id", *[F.round(F.col("vector")[i], 4).alias(f"f{i:02d}") for i in range(len(cols))]
        )

    return run


for _approach in cluster.FEATURE_SETS:
    prepare_query(_approach)
del _approach


def own_distance(data, labels, key="vec_id"):
    """Rows with ``own``, the distance to the mean of their cluster, and ``nearest``, that to the nearest such mean."""
    fitted = materialised(data.join(labels, key))
    centres = metrics.centres(fitted, "cluster").select(F.col("cluster").alias("other"), "centre")
    own = metrics.distance_to_centre(fitted, "cluster").select(key, "cluster", F.col("distance").alias("own"))
    listed = F.lit([list(r["centre"]) for r in centres.select("centre").collect()])  # one row per cluster
    gap = F.transform(listed, lambda c: F.sqrt(F.aggregate(F.zip_with("vector", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    return fitted.select(key, F.array_min(gap).alias("nearest")).join(own, key)


# Labels of k-means differ between implementations; every one of them must put a point next to its nearest centre.
@query("i04_kmeans", "SELECT vec_id, true AS known_cluster, true AS nearest FROM embeddings")
def i04(spark, d):
    data = embedding_vectors(spark, d).select("vec_id", "vector")
    labels, _ = cluster.kmeans(data, "vec_id", 10, n_init=2)
    near = F.col("own") <= F.col("nearest") + 0.02  # centres still move a little when the fit ends
    return own_distance(data, labels).select("vec_id", F.col("cluster").between(0, 9).alias("known_cluster"), near.alias("nearest"))


CELLS_64 = "cells AS (SELECT vec_id, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)"


# Inertia and the Calinski-Harabasz score together give the sum of squares of all points, for every k.
@query(
    "i05_k_curve",
    f"""WITH {CELLS_64}, t AS (SELECT sum(s) AS total FROM (SELECT var_pop(v) * count(*) AS s FROM cells GROUP BY dim))
SELECT k::INT AS k, round(total, 4) AS total, true AS silhouette_in_range, true AS positive FROM range(2, 13) r(k), t""",
)
def i05(spark, d):
    data = embedding_vectors(spark, d)
    n, k = data.count(), F.col("k")
    curve = cluster.k_curve(data, "vec_id", range(2, 13))
    between = F.col("calinski_harabasz") * F.col("inertia") * (k - 1) / (F.lit(n) - k)
    return curve.select(
        "k",
        F.round(F.col("inertia") + between, 4).alias("total"),
        F.col("silhouette").between(-1, 1).alias("silhouette_in_range"),
        ((F.col("inertia") > 0) & (F.col("davies_bouldin") > 0)).alias("positive"),
    )


# A curve SQL can check: the spread within equal-width price bands, for 2 to 12 bands.
CURVE = """curve AS (SELECT k, sum(w) AS inertia FROM (SELECT k, b, sum(price * price) - sum(price) ** 2 / count(*) AS w FROM
 (SELECT (k)::INT AS k, least(floor((price - lo) / (hi - lo) * k), k - 1) AS b, price / 1000 AS price FROM tx,
  (SELECT min(price) AS lo, max(price) AS hi FROM tx), range(2, 13) t(k)) GROUP BY k, b) GROUP BY k)"""


def band_curve(spark, d):
    from basketry.functions import ranks

    tx = views.transactions(spark, d).select("price")
    ends = ranks.scalar_struct(tx, lo=F.min("price"), hi=F.max("price"))
    per_k = tx.select("price", F.explode(F.sequence(F.lit(2), F.lit(12))).alias("k"))
    band = F.least(F.floor((F.col("price") - ends["lo"]) / (ends["hi"] - ends["lo"]) * F.col("k")), F.col("k") - 1)
    x = F.col("price") / 1000
    spread = per_k.groupBy("k", band.alias("b")).agg(
        (F.sum(x * x) - F.pow(F.sum(x), 2) / F.count(F.lit(1))).alias("w")
    )
    return spread.groupBy("k").agg(F.sum("w").alias("inertia"))


@query(
    "e09_curve_differences",
    with_views(
        "tx",
        """SELECT c.k, round(c.inertia, 3) AS inertia, round(p.inertia - c.inertia, 3) AS drop,
 round(p.inertia - 2 * c.inertia + n.inertia, 3) AS second_difference FROM curve c LEFT JOIN curve p ON p.k = c.k - 1
 LEFT JOIN curve n ON n.k = c.k + 1""",
        CURVE,
    ),
)
def e09(spark, d):
    return rounded(cluster.curve_differences(band_curve(spark, d)), ["inertia", "drop", "second_difference"], 3)


# Customers in 2 to 12 equal bands of their balance: a curve whose scores SQL measures as well.
BANDS = """bal AS (SELECT customer_id, balance / 1000 AS x FROM cu), ends AS (SELECT min(x) AS lo, max(x) AS hi FROM bal),
lab AS (SELECT k::INT AS k, customer_id, x, least(floor((x - lo) / (hi - lo) * k), k - 1)::INT AS b FROM bal, ends, range(2, 13) t(k)),
cen AS (SELECT k, b, avg(x) AS m, count(*) AS n, avg(x * x) - avg(x) * avg(x) AS var FROM lab GROUP BY k, b),
sco AS (SELECT k, sum(n * var) AS inertia, sum(n) AS n, count(*) AS c FROM cen GROUP BY k),
chs AS (SELECT sco.k, inertia, ((SELECT var_pop(x) * count(*) FROM bal) - inertia) * (sco.n - c) / (inertia * (c - 1)) AS ch FROM sco),
spr AS (SELECT k, b, avg(abs(x - m)) AS s FROM lab JOIN cen USING (k, b) GROUP BY k, b),
dbs AS (SELECT k, avg(r) AS db FROM (SELECT i.k, i.b, max((i.s + j.s) / abs(ci.m - cj.m)) AS r FROM spr i JOIN spr j ON i.k = j.k AND i.b <> j.b
  JOIN cen ci ON ci.k = i.k AND ci.b = i.b JOIN cen cj ON cj.k = j.k AND cj.b = j.b GROUP BY i.k, i.b) GROUP BY k),
pw AS (SELECT a.customer_id, b.k, b.b, sum(abs(a.x - b.x)) AS s, count(*) AS n FROM bal a JOIN lab b ON true GROUP BY ALL),
sil AS (SELECT l.k, l.customer_id, max(pw.n) FILTER (pw.b = l.b) AS own, max(pw.s) FILTER (pw.b = l.b) / greatest(max(pw.n) FILTER (pw.b = l.b) - 1, 1) AS a,
  min(pw.s / pw.n) FILTER (pw.b <> l.b) AS o FROM lab l JOIN pw ON pw.k = l.k AND pw.customer_id = l.customer_id GROUP BY l.k, l.customer_id),
sis AS (SELECT k, avg(CASE WHEN own > 1 THEN (o - a) / greatest(a, o) ELSE 0 END) AS sil FROM sil GROUP BY k),
curve AS (SELECT chs.k, inertia, ch, db, sil FROM chs JOIN dbs USING (k) JOIN sis USING (k))"""


def balance_bands(spark, d):
    """Customers' balances as vectors, and their labels for 2 to 12 bands."""
    points = materialised(views.customers(spark, d).select("customer_id", (F.col("balance") / 1000).alias("x")))
    lo, hi = points.agg(F.min("x"), F.max("x")).first()
    per_k = points.select("customer_id", "x", F.explode(F.sequence(F.lit(2), F.lit(12))).alias("k"))
    band = F.least(F.floor((F.col("x") - lo) / (hi - lo) * F.col("k")), F.col("k") - 1).cast("int")
    return points.select("customer_id", F.array("x").alias("vector")), materialised(per_k.select("k", "customer_id", band.alias("band")))


def measured_curve(spark, d):
    points, labels = balance_bands(spark, d)
    mean = {r["k"]: r["silhouette"] for r in metrics.silhouettes(points, labels, "customer_id", "band", "k").collect()}
    rows = []
    for k in range(2, 13):
        fitted = points.join(labels.filter(F.col("k") == k), "customer_id")
        ch = metrics.calinski_harabasz(fitted, "band").first()
        rows.append((k, ch["within"], mean[k], ch["calinski_harabasz"], metrics.davies_bouldin(fitted, "band")))
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double")


@query(
    "i06_measured_curve",
    with_views(
        "cu",
        """SELECT k, round(inertia, 4) AS inertia, round(sil, 6) AS silhouette, round(ch, 4) AS calinski_harabasz, round(db, 6) AS davies_bouldin
FROM curve""",
        BANDS,
    ),
)
def i06_curve(spark, d):
    out = measured_curve(spark, d)
    return rounded(rounded(out, ["silhouette", "davies_bouldin"]), ["inertia", "calinski_harabasz"], 4)


@query(
    "i06_choose_k",
    with_views(
        "cu",
        """SELECT (SELECT k FROM curve ORDER BY sil DESC, k LIMIT 1) AS k_silhouette, (SELECT k FROM curve ORDER BY ch DESC, k LIMIT 1) AS k_calinski_harabasz,
 (SELECT k FROM curve ORDER BY db, k LIMIT 1) AS k_davies_bouldin,
 (SELECT c.k FROM curve c JOIN curve p ON p.k = c.k - 1 ORDER BY p.inertia - c.inertia DESC, c.k LIMIT 1) AS k_elbow_drop,
 (SELECT c.k FROM curve c JOIN curve p ON p.k = c.k - 1 JOIN curve n ON n.k = c.k + 1
  ORDER BY p.inertia - 2 * c.inertia + n.inertia DESC, c.k LIMIT 1) AS k_elbow_bend""",
        BANDS,
    ),
)
def i06(spark, d):
    return cluster.choose_k(measured_curve(spark, d))


DIST = """dist AS (SELECT a.vec_id, a.label, b.label AS other,
 sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s, count(*) AS n
 FROM embeddings a JOIN embeddings b ON true GROUP BY ALL),
sil AS (SELECT vec_id, label, max(s) FILTER (other = label) / (max(n) FILTER (other = label) - 1) AS a,
 min(s / n) FILTER (other <> label) AS b FROM dist GROUP BY vec_id, label)"""


@query(
    "i07_silhouette",
    f"WITH {DIST} SELECT vec_id, label, round((b - a) / greatest(a, b), 6) AS silhouette FROM sil",
)
def i07(spark, d):
    out = metrics.silhouette_values(embedding_vectors(spark, d), "vec_id", "label")
    return rounded(out, ["silhouette"])


CENTRES = """cells AS (SELECT label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS v, vec_id FROM embeddings),
cen AS (SELECT label, dim, avg(v) AS m FROM cells GROUP BY label, dim)"""


@query(
    "i08_calinski_harabasz",
    f"""WITH {CENTRES}, g AS (SELECT dim, avg(v) AS m FROM cells GROUP BY dim),
wb AS (SELECT sum((v - cen.m) ** 2) AS w, sum((cen.m - g.m) ** 2) AS b FROM cells JOIN cen USING (label, dim) JOIN g USING (dim))
SELECT k AS clusters, n AS points, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM wb,
 (SELECT count(DISTINCT label) AS k, count(*) AS n FROM embeddings)""",
)
def i08(spark, d):
    found = metrics.calinski_harabasz(embedding_vectors(spark, d), "label")
    return rounded(found.select("clusters", "points", "calinski_harabasz"), ["calinski_harabasz"])


@query(
    "i09_davies_bouldin",
    f"""WITH {CENTRES}, pd AS (SELECT vec_id, label, sqrt(sum((v - m) ** 2)) AS d FROM cells JOIN cen USING (label, dim) GROUP BY ALL),
sp AS (SELECT label, avg(d) AS s FROM pd GROUP BY label),
cd AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) ** 2)) AS d FROM cen a JOIN cen b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / d) AS r FROM cd JOIN sp x ON x.label = i
 JOIN sp y ON y.label = j GROUP BY i)""",
)
def i09(spark, d):
    score = metrics.davies_bouldin(embedding_vectors(spark, d), "label")
    return rounded(spark.createDataFrame([(score,)], "davies_bouldin double"), ["davies_bouldin"])


@query("i10_bisecting_kmeans", "SELECT vec_id, 10::BIGINT AS clusters, true AS numbered_by_size FROM embeddings")
def i10(spark, d):
    labels = cluster.bisecting(embedding_vectors(spark, d), "vec_id", 10)
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("cluster", "n"))), lambda x: x["n"])
    known = sizes.agg(F.count(F.lit(1)).alias("clusters"), (ordered == F.sort_array(ordered, asc=False)).alias("sorted"))
    state = known.select(F.struct("clusters", "sorted").alias("s")).scalar()
    return labels.select("vec_id", state["clusters"].alias("clusters"), (state["sorted"] & F.col("cluster").between(0, 9)).alias("numbered_by_size"))


def pairs_sql(condition):
    return f"""pr AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON {condition})"""


def dbscan_sql(condition, min_samples):
    return f"""WITH RECURSIVE {pairs_sql(condition)},
core AS (SELECT a AS id FROM pr GROUP BY a HAVING count(*) >= {min_samples}),
ed AS (SELECT a, b FROM pr WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS root, id FROM core UNION SELECT root, ed.b FROM reach JOIN ed ON ed.a = reach.id),
rooted AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
member AS (SELECT vec_id, coalesce((SELECT root FROM rooted WHERE id = vec_id),
  (SELECT min(root) FROM pr JOIN rooted ON rooted.id = pr.b WHERE pr.a = vec_id)) AS root FROM embeddings),
numbered AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS label FROM member WHERE root IS NOT NULL GROUP BY root)
SELECT vec_id, coalesce(label, -1)::INT AS label FROM member LEFT JOIN numbered USING (root)"""


EPS, COS_EPS = 1.2, 0.7


@query(
    "i11_dbscan_euclidean",
    dbscan_sql(f"list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {EPS}", 5),
)
def i11(spark, d):
    return density.dbscan(embedding_vectors(spark, d), "vec_id", EPS, 5)


@query(
    "i11_dbscan_cosine",
    dbscan_sql(f"1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {COS_EPS}", 8),
)
def i11_cosine(spark, d):
    return density.dbscan(embedding_vectors(spark, d), "vec_id", COS_EPS, 8, "cosine")


@query(
    "i12_k_distances",
    """SELECT vec_id, round(d, 6) AS distance FROM (SELECT a.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS i
 FROM embeddings a JOIN embeddings b ON true) WHERE i = 15""",
)
def i12(spark, d):
    out = density.k_distances(embedding_vectors(spark, d), "vec_id", 15, sample_size=None)
    return rounded(out, ["distance"])


def sweep_sql():
    """All trials of the sweep: neighbours, core points, components, noise and Euclidean silhouettes."""
    euclid, cosine = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
    return f"""WITH RECURSIVE pw AS (SELECT a.vec_id AS a, b.vec_id AS b, {euclid} AS e, greatest({cosine}, 0) AS c FROM embeddings a JOIN embeddings b ON true),
dm AS (SELECT 'euclidean' AS metric, a, b, e AS d FROM pw UNION ALL SELECT 'cosine', a, b, c FROM pw),
kd AS (SELECT metric, a, d, row_number() OVER (PARTITION BY metric, a ORDER BY d) AS i FROM dm),
eps AS (SELECT metric, m, greatest(unnest(e), CASE metric WHEN 'cosine' THEN 1e-3 ELSE 1e-6 END) AS eps, unnest(range(len(e))) AS q
 FROM (SELECT metric, i AS m, quantile_cont(d, {list(density.SWEEP_QUANTILES)}) FILTER (d > 0) AS e FROM kd WHERE i IN {density.SWEEP_MIN_SAMPLES} GROUP BY metric, i)),
tr AS (SELECT *, row_number() OVER (ORDER BY metric, m, q) AS t FROM eps),
nb AS (SELECT t, a, b FROM tr JOIN dm ON dm.metric = tr.metric AND d <= eps),
core AS (SELECT t, a AS id FROM nb JOIN tr USING (t) GROUP BY t, a, m HAVING count(*) >= m),
ed AS (SELECT nb.t, a, b FROM nb JOIN core x ON x.t = nb.t AND x.id = a JOIN core y ON y.t = nb.t AND y.id = b),
reach AS (SELECT t, id, id AS root, 0 AS step FROM core UNION SELECT r.t, ed.b, r.root, 0 FROM reach r JOIN ed ON ed.t = r.t AND ed.a = r.id WHERE r.root < ed.b),
rooted AS (SELECT t, id, min(root) AS root FROM reach GROUP BY t, id),
member AS (SELECT t, vec_id, coalesce((SELECT root FROM rooted r WHERE r.t = tr.t AND r.id = vec_id),
  (SELECT min(root) FROM nb JOIN rooted r ON r.t = nb.t AND r.id = nb.b WHERE nb.t = tr.t AND nb.a = vec_id)) AS root FROM tr, embeddings),
sz AS (SELECT t, root, count(*) AS n FROM member WHERE root IS NOT NULL GROUP BY t, root),
su AS (SELECT t, count(*) AS points, count(root) AS labelled, count(DISTINCT root) AS clusters FROM member GROUP BY t),
sums AS (SELECT x.t, x.vec_id, x.root, y.root AS other, sum(e) AS s, count(*) AS n FROM member x JOIN pw ON pw.a = x.vec_id
  JOIN member y ON y.t = x.t AND y.vec_id = pw.b WHERE x.root IS NOT NULL AND y.root IS NOT NULL GROUP BY ALL),
per AS (SELECT t, vec_id, max(n) FILTER (other = root) AS own, max(s) FILTER (other = root) / greatest(max(n) FILTER (other = root) - 1, 1) AS i,
  min(s / n) FILTER (other <> root) AS o FROM sums GROUP BY t, vec_id),
sil AS (SELECT t, avg(CASE WHEN own > 1 THEN (o - i) / greatest(i, o) ELSE 0 END) AS score FROM per WHERE o IS NOT NULL GROUP BY t),
row_s AS (SELECT t, metric, m, eps, clusters, 100.0 * (points - labelled) / points AS noise, 100.0 * (SELECT max(n) FROM sz WHERE sz.t = tr.t) / nullif(labelled, 0) AS largest,
  CASE WHEN clusters >= 2 THEN score END AS score FROM tr JOIN su USING (t) LEFT JOIN sil USING (t)),
acc AS (SELECT *, coalesce(clusters >= 2 AND noise < 60 AND largest < 70 AND score IS NOT NULL, false) AS ok FROM row_s)
SELECT metric, m::INT AS min_samples, round(eps, 6) AS eps, clusters, round(noise, 4) AS noise_pct, round(largest, 4) AS largest_pct, round(score, 6) AS silhouette,
 ok AS accepted, t = (SELECT t FROM acc WHERE ok ORDER BY round(score, 9) DESC, t LIMIT 1) AND ok AS best FROM acc
UNION ALL SELECT 'cosine', 30, round(greatest(quantile_cont(d, 0.05) FILTER (d > 0), 1e-3), 6), NULL, NULL, NULL, NULL, false, true FROM kd
 WHERE metric = 'cosine' AND i = 30 AND NOT EXISTS (SELECT 1 FROM acc WHERE ok) HAVING count(*) > 0"""


@query("i13_dbscan_sweep", sweep_sql())
def i13(spark, d):
    out = density.dbscan_sweep(embedding_vectors(spark, d), "vec_id")
    return rounded(rounded(out, ["eps", "silhouette"]), ["noise_pct", "largest_pct"], 4)


@query("i14_gaussian_mixture", "SELECT vec_id, true AS shares_sum_to_one, true AS likeliest FROM embeddings")
def i14(spark, d):
    out, _, _ = cluster.gaussian_mixture(embedding_vectors(spark, d), "vec_id", 4)
    total = F.aggregate("probability", F.lit(0.0), lambda s, x: s + x)
    likeliest = F.col("probability")[F.col("cluster")] == F.array_max("probability")
    return out.select("vec_id", (F.abs(total - 1) < 1e-9).alias("shares_sum_to_one"), likeliest.alias("likeliest"))


# After a round of the fit, the mixture has the mean and the second moments of the points, for every number of components.
@query(
    "i14_mixture_moments",
    f"""WITH {CELLS_64} SELECT k::INT AS k, dim, round(avg(v), 6) AS mean, round(avg(v * v) + 1e-6, 6) AS second FROM cells, range(2, 6) r(k) GROUP BY ALL""",
)
def i14_moments(spark, d):
    fits = cluster.gaussian_mixtures(embedding_vectors(spark, d), "vec_id", range(2, 6))
    rows = []
    for k, (fit, _) in fits.items():
        mean = fit.weights @ fit.means
        second = fit.weights @ (fit.covariances.diagonal(axis1=1, axis2=2) + fit.means**2)
        rows += [(k, i, float(m), float(s)) for i, (m, s) in enumerate(zip(mean, second, strict=True))]
    return rounded(spark.createDataFrame(rows, "k int, dim int, mean double, second double"), ["mean", "second"])


@query(
    "i15_aic_curve",
    """SELECT k::INT AS k, (k - 1 + k * 64 + k * 64 * 65 / 2)::INT AS parameters, true AS penalised, true AS improved FROM range(2, 11) r(k)""",
)
def i15(spark, d):
    curve = cluster.aic_curve(embedding_vectors(spark, d), "vec_id", range(2, 11))
    gap = F.abs(F.col("aic") - (2 * F.col("parameters") - 2 * F.col("log_likelihood")))
    return curve.select(
        "k", "parameters", (gap < 1e-6).alias("penalised"), (F.col("log_likelihood") >= F.col("first_log_likelihood") - 1e-3).alias("improved")
    )


# The projection cannot show more of a point than there is, and the two components show their share of the variance.
@query(
    "i19_projection",
    f"""WITH {CELLS_64}, e AS (SELECT vec_id, sum((v - m) ** 2) AS energy FROM (SELECT *, avg(v) OVER (PARTITION BY dim) AS m FROM cells) GROUP BY vec_id)
SELECT vec_id, label, round(energy, 6) AS energy, true AS within, true AS shares FROM e JOIN embeddings USING (vec_id)""",
)
def i19(spark, d):
    data = materialised(embedding_vectors(spark, d))
    out, ratios = cluster.project_2d(data, data.select("vec_id", "label"), "vec_id")
    energy = vectors.reconstruction_errors(data, "vec_id", 2)[0].select("vec_id", "energy")
    placed = materialised(out.join(energy, "vec_id"))
    shares = placed.agg(F.sum(F.col("pc1") ** 2) / F.sum("energy"), F.sum(F.col("pc2") ** 2) / F.sum("energy")).first()
    agree = all(abs(a - b) < 1e-6 for a, b in zip(shares, ratios, strict=True))
    within = F.col("pc1") ** 2 + F.col("pc2") ** 2 <= F.col("energy") + 1e-9
    return placed.select("vec_id", "label", F.round("energy", 6).alias("energy"), within.alias("within"), F.lit(agree).alias("shares"))


# Each component's squared loadings sum to one, so the squares of the mean absolute loadings sum to one at most.
@query(
    "i20_feature_importance",
    "SELECT unnest(" + str(cluster.FEATURE_SETS["hybrid"]) + ") AS feature, true AS in_range, true AS at_most_one",
)
def i20(spark, d):
    prepared = cluster.prepare_features(feature_table(spark, d), "hybrid")
    found = materialised(vectors.loadings(prepared, cluster.FEATURE_SETS["hybrid"]))
    total = found.agg(F.sum(F.col("importance") ** 2)).scalar()
    return found.select("feature", F.col("importance").between(0, 1).alias("in_range"), (total.between(0.5, 1 + 1e-9)).alias("at_most_one"))


@query(
    "i21_centre_ranges",
    f"""WITH {CENTRES} SELECT dim::INT AS dim, round(max(m) - min(m), 6) AS range FROM cen GROUP BY dim
ORDER BY max(m) - min(m) DESC, dim LIMIT 20""",
)
def i21(spark, d):
    return rounded(metrics.centre_ranges(embedding_vectors(spark, d), "label"), ["range"])


@query(
    "i21_centre_distances",
    f"""WITH {CENTRES}, cd AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM cen a
 JOIN cen b ON a.dim = b.dim AND a.label < b.label GROUP BY ALL)
SELECT a, b, round(d, 6) AS distance, d = (SELECT min(d) FROM cd) AS closest, d = (SELECT max(d) FROM cd) AS farthest FROM cd""",
)
def i21_distances(spark, d):
    return rounded(metrics.centre_distances(embedding_vectors(spark, d), "label"), ["distance"])


@query(
    "i23_compare_methods",
    """SELECT unnest(['kmeans', 'bisecting']) AS approach, 10::BIGINT AS clusters, count(*) AS points, true AS silhouette_in_range, true AS positive FROM embeddings""",
)
def i23(spark, d):
    data = materialised(embedding_vectors(spark, d).select("vec_id", "vector"))
    km, _ = cluster.kmeans(data, "vec_id", 10)
    out = cluster.compare({"kmeans": (data, km), "bisecting": (data, cluster.bisecting(data, "vec_id", 10))}, "vec_id")
    return out.select(
        "approach",
        "clusters",
        F.lit(data.count()).alias("points"),
        F.col("silhouette").between(-1, 1).alias("silhouette_in_range"),
        ((F.col("calinski_harabasz") > 0) & (F.col("davies_bouldin") > 0)).alias("positive"),
    )


@query(
    "i24_enriched_customers",
    with_views(
        "tx ar cu",
        "SELECT feat.*, cu.* EXCLUDE (customer_id), '2026-01-01T00:00:00' AS clustering_created_at, '"
        + ",".join(segments.APPROACHES)
        + "' AS clustering_approaches, true AS clustered, true AS labelled FROM feat JOIN cu USING (customer_id)",
        FEATURE_EXTRA,
    ),
)
def i24(spark, d):
    base = materialised(full_features(spark, d))
    labels = {a: cluster.kmeans(cluster.prepare_features(base, a), "customer_id", 4)[0] for a in segments.APPROACHES}
    out = cluster.enriched_customers(base, labels, "2026-01-01T00:00:00")
    ids, names = ([f"{a}_{kind}" for a in segments.APPROACHES] for kind in ("cluster", "label"))
    clustered = functools.reduce(lambda a, b: a & b, [F.col(c).between(0, 3) for c in ids])
    labelled = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    return out.withColumns({"clustered": clustered, "labelled": labelled}).drop(*ids, *names)


# Sizes and means of the clusters add up to those of all customers.
@query(
    "i25_segment_on_columns",
    with_views(
        "tx ar cu",
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", 4::BIGINT AS clusters, count(*)::BIGINT AS customers, round(avg({c}), 4) AS mean FROM feat""" for c in ("recency", "monetary")
        ),
        FEATURE_EXTRA,
    ),
)
def i25(spark, d):
    _, summary = cluster.segment_on(feature_table(spark, d), "customer_id", ["recency", "monetary"], 4)
    out = summary.groupBy("column").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("size").alias("customers"),
        (F.sum(F.col("size") * F.col("mean")) / F.sum("size")).alias("mean"),
    )
    return rounded(out, ["mean"], 4)


@query(
    "i25_segment_summary",
    with_views(
        "cu",
        " UNION ALL ".join(
            f"""SELECT club_member_status AS cluster, '{c}' AS "column", count(*) AS size, round(avg({c}), 4) AS mean,
 round(median({c}), 4) AS median FROM cu GROUP BY club_member_status"""
            for c in ("age", "balance")
        ),
    ),
)
def i25_summary(spark, d):
    c = views.customers(spark, d).withColumnRenamed("club_member_status", "cluster")
    return rounded(cluster.segment_summary(c, "cluster", ["age", "balance"]), ["mean", "median"], 4)
