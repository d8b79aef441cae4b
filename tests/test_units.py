"""Operators on small hand-made frames with values worked out by hand or by brute force."""

import math
from collections import Counter
from datetime import date
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.functions import ranks
from basketry.functions.text import embedding_text, letters_only
from basketry.operators import (
    charts,
    cleaning,
    cluster,
    density,
    encode,
    features,
    filters,
    outliers,
    profiling,
    segments,
    sequences,
    text,
    vectors,
)
from basketry.operators import cluster_metrics as metrics
from basketry.sources import tables


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*columns).collect()]


# --- ranks ----------------------------------------------------------------------------------------


def test_quantiles_with_many_cuts_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 400, 3000).astype(float)
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, value double")
    counts = ranks.value_counts(df, ["g"])
    ranked = ranks.running_counts(counts, ["g"], cut_rate=10).toPandas()
    assert (ranked["total"] == 3000).all()
    for value, below in zip(ranked["value"], ranked["below"]):
        assert below == (x < value).sum()


def test_buckets_of_one_group_are_counted_apart(spark):
    """the rows of a constant group, or of one column, go to tasks by bucket and not by group."""
    values = spark.range(3000).select(F.lit("g").alias("g"), (F.col("id") % 700).cast("double").alias("value"))
    counts = ranks.value_counts(values.unionByName(values.limit(5).withColumn("g", F.lit(None).cast("string"))), ["g"])
    ranked = ranks.running_counts(counts, ["g"], cut_rate=10, few_groups=True)
    expected = ranks.running_counts(counts, ["g"], cut_rate=10).select(ranked.columns)
    assert Counter(map(tuple, ranked.collect())) == Counter(map(tuple, expected.collect()))
    assert "LeftOuter" in plan(expected) and "LeftOuter" not in plan(ranked)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])
def test_linear_quantile(spark, q):
    x = [1.0, 2.0, 2.0, 4.0, 10.0, 11.0]
    df = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "value double")
    got = ranks.quantile_values(df, "value", {"q": q})["q"]
    assert got == pytest.approx(np.quantile(x, q))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "value double")
    assert ranks.quantile_values(df, "value", {"q": 0.5}) == {"q": None}


def test_hot_group_and_value(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        F.when(F.col("id") < 900, 7.0).otherwise(F.col("id").cast("double")).alias("value"),
    )
    got = {r["g"]: r["m"] for r in ranks.quantiles(df, {"m": 0.5}, ["g"]).collect()}
    assert got["hot"] == 7.0 and got["2000"] == 2000.0 and len(got) == 2001


# --- features --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def shop(spark):
    tx = spark.createDataFrame(
        [
            (date(2020, 1, 1), 1, 10, 5.0),
            (date(2020, 1, 3), 2, 10, 1.0),
            (date(2020, 1, 4), 2, 10, 3.0),
            (date(2020, 1, 5), 3, 10, 2.0),
            (date(2020, 1, 10), 3, 11, 2.0),
        ],
        "t_dat date, customer_id int, article_id int, price double",
    )
    arts = spark.createDataFrame(
        [(10, "a", "red", "x"), (11, "b", "red", "y")],
        "article_id int, product_group_name string, colour_group_name string, garment_group_name string",
    )
    return tx, spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "customer_id int"), arts


def test_customer_features(shop):
    tx, customers, arts = shop
    rows = {r["customer_id"]: r for r in features.customer_features(tx, customers, arts).collect()}
    one, two, three, none = (rows[i] for i in (1, 2, 3, 4))
    assert (one["recency"], one["frequency"], one["monetary"], one["price_sensitivity_index"]) == (10, 1, 5.0, 0.0)
    assert one["style_consistency_score"] == 1.0 and one["purchase_diversity_score"] == 0.0
    assert two["price_sensitivity_index"] == pytest.approx(math.sqrt(2) / 2)
    assert three["purchase_diversity_score"] == pytest.approx(1.0)
    assert three["style_consistency_score"] == pytest.approx(0.0) and three["recency"] == 1
    # No purchase: the whole span and two days, zeros, fully consistent.
    assert (none["recency"], none["frequency"], none["monetary"], none["style_consistency_score"]) == (11, 0, 0.0, 1.0)
    assert one["rfm_reference_date"] == "2020-01-11"


def test_missing_column_is_named(shop):
    tx, customers, arts = shop
    with pytest.raises(ValueError, match="price"):
        features.customer_features(tx.drop("price"), customers, arts)


# --- cleaning ---------------------------------------------------------------------------------------


def test_row_null_in_two_keys_counts_once(spark):
    df = spark.createDataFrame(
        [(None, None, 1), ("d", None, 1), ("d", "c", None), ("d", "c", 1)],
        "t_dat string, customer_id string, article_id int",
    )
    assert tuple(cleaning.missing_key_counts(df).first()) == (1, 1, 1)
    assert cleaning.drop_missing_keys(df).count() == 1


def test_fill_group_median_keeps_null_without_price(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 4.0), (1, None), (2, None)], "article_id int, price double")
    got = cleaning.fill_with_group_median(df, "article_id", "price")
    assert Counter(tuple(r) for r in got.collect()) == Counter([(1, 1.0), (1, 4.0), (1, 2.5), (2, None)])


def test_only_rows_without_a_value_meet_the_medians(spark):
    """rows that have a price are read where they are, so no join stands in the plan."""
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 4.0), (1, "c", None), (None, "d", None), (None, "e", 2.0)], "k int, n string, p double")
    got = cleaning.fill_with_group_median(df, "k", "p")
    assert "Join" not in plan(got) and "Exchange" not in plan(got)
    assert Counter(map(tuple, got.collect())) == Counter([(1, "a", 1.0), (1, "b", 4.0), (1, "c", 2.5), (None, "d", None), (None, "e", 2.0)])


def test_transactions_are_joined_once_however_often_they_are_read(spark):
    """the report and the steps read written rows."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [("2024-01-01", 1, 7, 0.01, 1), ("2024-01-02", 2, 7, None, 9), ("bad", 3, 8, 0.02, None), (None, 4, 8, 0.03, 2)]
    df = spark.createDataFrame(rows, "t_dat string, customer_id bigint, article_id bigint, price double, sales_channel_id bigint")
    cleaned = cleaning.clean_transactions(df.mapInArrow(counted, df.schema))
    assert cleaned.count() == 3
    assert read.value == 4


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(2,), (1,), (1,), (2,), (None,)], "c int")
    assert values(cleaning.fill_with_mode(df, "c"), "c") == [(1,), (1,), (1,), (2,), (2,)]


def test_price_interpolation_equals_numpy(spark):
    knots = [(0.0, 1.0), (1.0, 3.0), (1.0, 5.0), (4.0, 6.0)]
    x = [-1.0, 0.0, 0.5, 1.0, 2.5, 4.0, 9.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r[0] for r in df.select(cleaning.interpolate(F.col("x"), knots)).collect()]
    assert got == pytest.approx(np.interp(x, *zip(*knots)))


def test_unknown_outlier_method(spark):
    with pytest.raises(ValueError, match="cap"):
        cleaning.treat_price_outliers(spark.createDataFrame([(1.0,)], "price double"), "cap")


def test_null_price_has_null_flag(spark):
    df = spark.createDataFrame([(None,), (9.0,)], "price double")
    rows = cleaning.treat_price_outliers(df).collect()
    assert rows[0]["price_outlier_capped"] is None and rows[1]["price"] == cleaning.PRICE_CAP[1]


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame(
        [(1, None, 1.0, "A", "x", 12, None), (2, 1.0, None, None, None, 40, "p"), (2, 1.0, None, None, None, 40, "p")],
        "customer_id int, FN double, Active double, club_member_status string, fashion_news_frequency string,"
        " age bigint, postal_code string",
    )
    once = cleaning.clean_customers(df)
    twice = cleaning.clean_customers(once.select(*df.columns))
    assert Counter(once.select(*df.columns).collect()) == Counter(twice.select(*df.columns).collect())
    assert once.count() == 2


def test_unreadable_types_become_null(spark):
    df = spark.createDataFrame([("2020-02-30", "x", "1.5", "2")], "t_dat string, article_id string, price string, sales_channel_id string")
    row = cleaning.normalise_transaction_types(df).first()
    assert row["t_dat"] is None and row["article_id"] is None and row["price"] == 1.5 and row["sales_channel_id"] == 2


# --- profiling and outliers -------------------------------------------------------------------------


def test_constant_column_has_no_outliers(spark):
    df = spark.createDataFrame([(5.0, float(i)) for i in range(20)] + [(5.0, 1000.0)], "flat double, x double")
    z = {r["column"]: r["outliers"] for r in outliers.zscore_outliers(df, ["flat", "x"]).collect()}
    m = {r["column"]: r["outliers"] for r in outliers.modified_zscore_outliers(df, ["flat", "x"]).collect()}
    assert z == {"flat": 0, "x": 1} and m == {"flat": 0, "x": 1}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    row = profiling.numeric_statistics(df, ["x"]).first()
    assert (row["count"], row["nulls"], row["mean"], row["median"]) == (2, 2, 2.0, 2.0)


def test_quality_metrics(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "x int, y string")
    row = profiling.quality_metrics(df).first()
    assert (row["n_rows"], row["null_cells"], row["duplicate_rows"]) == (3, 1, 1)


# --- charts -----------------------------------------------------------------------------------------


def brute_tau(x, y):
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in combinations(range(len(x)), 2))
    n0 = len(x) * (len(x) - 1) / 2
    t1 = sum(c * (c - 1) / 2 for c in Counter(x).values())
    t2 = sum(c * (c - 1) / 2 for c in Counter(y).values())
    return s / math.sqrt((n0 - t1) * (n0 - t2))


@pytest.mark.parametrize("seed", [0, 1])
def test_kendall_with_ties_and_hot_values(spark, seed, monkeypatch):
    monkeypatch.setattr(charts, "KENDALL_BUCKET", 30)
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(300) < 0.35, 7, rng.integers(0, 200, 300)).astype(float)
    y = np.where(rng.random(300) < 0.3, 3, x + rng.integers(-90, 90, 300)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, b double")
    assert charts.kendall(df, "a", "b").first()["r"] == pytest.approx(brute_tau(list(x), list(y)))


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,)] * 4, "x double")
    rows = charts.histogram(df, "x", 4).collect()
    assert sum(r["n"] for r in rows) == 4 and rows[0]["start"] <= 2.0 <= rows[0]["end"]


# --- segments ----------------------------------------------------------------------------------------


def test_quintiles_share_scores_on_ties(spark):
    df = spark.createDataFrame([(i, i, 1, float(i)) for i in range(10)], "customer_id int, recency int, frequency int, monetary double")
    rows = segments.rfm_scores(df).collect()
    assert {r["f_score"] for r in rows} == {1}
    assert [r["r_score"] for r in sorted(rows, key=lambda r: r["customer_id"])] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_two_purchases_long_ago_are_inactive(spark):
    df = spark.createDataFrame([(100, 2), (100, 1), (100, 3), (10, 2)], "r int, f int")
    got = [r[0] for r in df.select(segments.lifecycle_stage(F.col("r"), F.col("f"))).collect()]
    assert got == ["Inactive", "One-Time Purchaser", "Dormant High-Value", "Active Low-Frequency"]


# --- text and encoding --------------------------------------------------------------------------------


def test_text_cleaning(spark):
    df = spark.createDataFrame([("A T-Shirt,  size 4\nX",), ("***",)], "t string")
    assert [r[0] for r in df.select(letters_only(F.col("t"))).collect()] == ["shirt size", ""]
    assert [r[0] for r in df.select(embedding_text(F.col("t"))).collect()] == [
        "A T-Shirt, size 4 X",
        "no description available",
    ]


def test_tfidf_vectors_equal_the_table(spark):
    docs = spark.createDataFrame([(1, "red shirt red"), (2, "blue shirt"), (3, "red hat"), (4, "")], "id int, t string")
    vocab = text.vocabulary(docs, "id", "t", 4, 1, 1.0, 100)
    table = {(r["id"], r["term_id"]): r["weight"] for r in text.tfidf(docs, "id", "t", vocab, 4).collect()}
    for row in text.tfidf_vectors(docs, "id", "t", vocab, 4).collect():
        for i, w in zip(row["features"].indices, row["features"].values):
            assert table.pop((row["id"], int(i))) == pytest.approx(w)
    assert not table
    terms = {r["term"]: r["df"] for r in vocab.collect()}
    assert terms["red shirt"] == 1 and terms["shirt red"] == 1 and terms["red"] == 2


def test_words_keep_duplicates(spark):
    df = spark.createDataFrame([("The red, RED hat no_description x 12",)], "t string")
    assert df.select(text.words(F.col("t"), ["Hat"])).first()[0] == ["red", "red", "description"]


def test_svd_reconstructs(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 6))
    rows = vectors.array_to_vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, v array<double>")
    out, singular, basis = text.svd(df.select("id", rows("v").alias("features")), "id", 2, normalise=False)
    assert singular == pytest.approx(np.linalg.svd(m)[1][:2])
    assert basis.T @ basis == pytest.approx(np.eye(2), abs=1e-8)
    got = np.array([r["vector"] for r in out.orderBy("id").collect()]) @ basis.T
    assert got == pytest.approx(m, abs=1e-8)


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(40, 3)) * [3, 1, 0.2] + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, vector array<double>")
    out, ratios = vectors.pca(df, "id", 3)
    s = np.linalg.svd(m - m.mean(0))[1] ** 2
    assert ratios == pytest.approx(s / s.sum())
    got = np.array([r["vector"] for r in out.orderBy("id").collect()])
    assert np.abs(got) == pytest.approx(np.abs((m - m.mean(0)) @ np.linalg.svd(m - m.mean(0))[2].T), abs=1e-8)
    assert vectors.components_needed([0.6, 0.3, 0.1]) == 3


def test_encoding(spark):
    df = spark.createDataFrame([(1, "b", "k"), (2, "a", None), (3, "c", "k"), (4, None, "k")], "id int, g string, one string")
    out, names = encode.encode_categorical(df, "id", ["g"])
    assert names == ["g_b", "g_c", "g_None"]
    assert values(out, "id", *names) == [(1, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 1.0)]
    codes = encode.label_encode(df, ["g"]).select("id", "g_encoded")
    assert values(codes, "id", "g_encoded") == [(1, 2.0), (2, 1.0), (3, 3.0), (4, 0.0)]
    assert encode.select_categorical(df, ["g", "one", "missing"]) == ["g", "one"]


# --- clusters ------------------------------------------------------------------------------------------


def blobs(spark, n=60, copies=0):
    rng = np.random.default_rng(5)
    points = [rng.normal(loc=(10 * (i % 3), 0), scale=0.5).tolist() for i in range(n)]
    points += [[0.0, 0.0]] * copies + [[50.0, 50.0]]
    return points, spark.createDataFrame(list(enumerate(points)), "id bigint, vector array<double>")


def brute_dbscan(points, eps, m):
    x = np.array(points)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= m
    root = np.where(core, np.arange(len(x)), -1)
    changed = True
    while changed:
        new = root.copy()
        for i in np.nonzero(core)[0]:
            new[i] = root[near[i] & core].min()
        changed, root = bool((new != root).any()), new
    for i in np.nonzero(~core)[0]:
        touching = near[i] & core
        root[i] = root[touching].min() if touching.any() else -1
    sizes = Counter(r for r in root if r >= 0)
    number = {r: i for i, r in enumerate(sorted(sizes, key=lambda r: (-sizes[r], r)))}
    return [number.get(r, -1) for r in root]


@pytest.mark.parametrize("copies", [0, 40])
def test_dbscan_equals_brute_force(spark, copies, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 8)
    points, df = blobs(spark, copies=copies)
    got = [l for _, l in values(density.dbscan(df, "id", 0.6, 4), "id", "label")]
    assert got == brute_dbscan(points, 0.6, 4)


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    got = density.connected_components(edges.unionByName(spark.createDataFrame([(101, 100)], "u bigint, v bigint")))
    roots = dict(values(got, "pid", "root"))
    assert {roots[i] for i in range(1, 60)} == {0} and roots[101] == 100


@pytest.mark.parametrize("metric,p", [("euclidean", 2), ("cosine", 2), ("hamming", 2), ("minkowski", 3)])
def test_k_distances_sample_and_blocks_agree(spark, metric, p, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 16)
    _, df = blobs(spark)
    a = density.k_distances(df, "id", 4, metric, p, sample_size=1000)
    b = density.k_distances(df, "id", 4, metric, p, sample_size=None)
    assert [r["distance"] for r in a.collect()] == pytest.approx([r["distance"] for r in b.collect()])


def test_kmeans_finds_the_blobs_and_scores(spark):
    points, df = blobs(spark)
    labels, inertia = cluster.kmeans(df.filter("id < 60"), "id", 3)
    got = [l for _, l in values(labels, "id", "cluster")]
    assert len({(i % 3, l) for i, l in enumerate(got)}) == 3 and inertia > 0
    fitted = df.join(labels, "id")
    assert metrics.silhouette(fitted, "id", "cluster") > 0.8
    assert metrics.davies_bouldin(fitted, "cluster") < 0.3
    x = np.array(points[:60])
    total = ((x - x.mean(0)) ** 2).sum()
    row = metrics.calinski_harabasz(fitted, "cluster").first()
    assert row["calinski_harabasz"] == pytest.approx(((total - inertia) / 2) / (inertia / 57), rel=1e-6)


# --- sequences -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def history(spark):
    rows = [(1, date(2020, 1, d), 100 + d, 1.0 * d, 1 + d % 2) for d in range(1, 8)] + [
        (2, date(2020, 1, 1), 101, 5.0, 1),
        (2, date(2020, 1, 1), 101, 5.0, 1),
        (3, date(2020, 1, 2), 101, 9.0, 2),
        (3, date(2020, 1, 2), 102, None, 2),
    ]
    return spark.createDataFrame(rows, "customer_id int, t_dat date, article_id int, price double, sales_channel_id int")


def test_sequences_keep_the_newest(history):
    registry = sequences.token_registry(history, channels=True)
    out = sequences.prepare_sequences(history, registry, channels=True, max_len=4, min_len=2)
    rows = {r["customer_id"]: r for r in out.collect()}
    # Items 101..107 are tokens 2..8, CH=1 and CH=2 are 9 and 10.
    assert rows[1]["sequence"] == [10, 6, 7, 8] and rows[1]["prefix_length"] == 1 and rows[1]["last_item"] == 8
    assert rows[3]["sequence"] == [10, 2, 3]
    assert 2 not in rows  # one purchase once its copy is dropped
    kept = sequences.prepare_sequences(history, registry, max_len=4, dedupe=False)
    assert {r["customer_id"] for r in kept.collect()} == {1, 2, 3}


def test_padding_and_masking(history):
    registry = sequences.token_registry(history)
    seq = sequences.prepare_sequences(history, registry, max_len=10)
    masked = sequences.mask_sequences(seq, 20)
    for r in masked.collect():
        hit = [i for i, l in enumerate(r["labels"]) if l != sequences.IGNORE]
        assert len(hit) == max(1, int(len(r["sequence"]) * 0.15))
        assert all(r["labels"][i] == r["sequence"][i] for i in hit)
        assert all(a == b for i, (a, b) in enumerate(zip(r["input"], r["sequence"])) if i not in hit)
    for r in sequences.pad_left(masked, 5).collect():
        n = min(5, len(r["input"]))
        assert r["input_ids"] == [0] * (5 - n) + r["input"][-5:]
        assert r["attention_mask"] == [0] * (5 - n) + [1] * n
        assert r["label_ids"] == [-100] * (5 - n) + r["labels"][-5:]


def test_fill_prices_across_days(spark):
    df = spark.createDataFrame(
        [(1, date(2020, 1, d), 1, p, 1) for d, p in [(1, None), (2, 4.0), (3, None), (4, 6.0)]] + [(2, date(2020, 1, 1), 1, None, 1)],
        "customer_id int, t_dat date, article_id int, price double, sales_channel_id int",
    )
    got = sequences.fill_prices(df).orderBy("customer_id", "t_dat").collect()
    assert [r["price"] for r in got] == [4.0, 4.0, 4.0, 6.0, None]


def test_next_items(history):
    got = values(sequences.next_items(history.filter("customer_id = 1")), "item", "next_item")
    assert got == [(100 + i, 101 + i) for i in range(1, 7)]


def test_next_item_scores_equal_a_plain_count(spark):
    """each item ranks its followers and the popular items by itself; no table of pairs is grouped."""
    rng = np.random.default_rng(5)
    rows = [(int(c), date(2024, 1, int(d)), None if a == 11 else int(a)) for c, d, a in zip(rng.integers(0, 9, 80), rng.integers(1, 28, 80), rng.integers(0, 12, 80))]
    df = spark.createDataFrame(rows, "customer_id int, t_dat date, article_id int")
    followers, popular = Counter(tuple(r)[1:] for r in sequences.next_items(df).collect()), Counter(a for _, _, a in rows)
    totals = Counter()
    for (item, _), n in followers.items():
        totals[item] += n
    order = lambda p: (-p[1], p[0] is not None, p[0] or 0)
    best = sorted(popular.items(), key=order)[:3]
    want = set()
    for item in popular:
        scores = {c: n / 80 for c, n in best}
        own = sorted(((c, n) for (i, c), n in followers.items() if i == item and i is not None), key=order)[:3]
        scores |= {c: 1 + n / totals[item] for c, n in own}
        want |= {(item, c, x, k) for k, (c, x) in enumerate(sorted(scores.items(), key=order)[:3], 1)}
    scored = sequences.transition_scores(df, 3)
    assert set(map(tuple, scored.collect())) == want
    assert dict(scored.dtypes) == {"item": "int", "candidate": "int", "score": "double", "rank": "int"}
    grouped = [line for line in plan(scored).splitlines() if "Aggregate(keys=" in line]
    assert grouped and not any("candidate" in line.split("]")[0] for line in grouped)


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 3)], "customer_id int, item int, rank int")
    truth = spark.createDataFrame([(1, 8), (2, 9), (3, 1)], "customer_id int, item int")
    got = {r["k"]: (r["recall"], r["ndcg"]) for r in sequences.ranking_metrics(ranked, truth, [1, 2, 3]).collect()}
    assert got[1] == (0.0, 0.0) and got[2] == pytest.approx((1 / 3, 1 / math.log2(3) / 3))
    assert got[3] == pytest.approx((2 / 3, (1 / math.log2(3) + 0.5) / 3))
    empty = sequences.ranking_metrics(ranked, truth.limit(0), [5]).first()
    assert (empty["recall"], empty["ndcg"]) == (0.0, 0.0)


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(2000).select(F.col("id").alias("customer_id"))
    counts = dict(values(sequences.split_customers(df).groupBy("split").count(), "split", "count"))
    assert counts["train"] + counts["validation"] == 2000 and 140 < counts["validation"] < 260


# --- plans ------------------------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["b01_last_90_days", "c03_features_with_gaps"])
def test_recent_filter_reaches_the_scan(spark, name):
    from basketry.plans import queries

    assert "GreaterThanOrEqual(l_shipdate" in plan(queries()[name](spark, "/root/testdata/sf0.001"))


def test_scores_cover_all_points(spark):
    """More points than any block: every one is scored, and against all."""
    rng = np.random.default_rng(4)
    n = 11_000
    x = np.concatenate([rng.normal(0, 1, (n // 2, 2)), rng.normal(4, 1, (n // 2, 2))])
    rows = [(i, int(i >= n // 2), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, label int, vector array<double>")
    got = {r.id: r.silhouette for r in metrics.silhouette_values(df, "id", "label").collect()}
    assert len(got) == n
    for i in (0, n // 2, n - 1):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        own = (np.arange(n) >= n // 2) == (i >= n // 2)
        inner, outer = d[own].sum() / (own.sum() - 1), d[~own].mean()
        assert got[i] == pytest.approx((outer - inner) / max(inner, outer))


def test_history_is_cut_before_the_shuffle(history):
    registry = sequences.token_registry(history)
    assert "WindowGroupLimit" in plan(sequences.prepare_sequences(history, registry, max_len=4))


def test_unsupported_file_type(spark):
    with pytest.raises(ValueError, match="xlsx"):
        tables.read_table(spark, "/tmp/none.xlsx")
