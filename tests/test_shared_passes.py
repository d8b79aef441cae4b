"""Quantiles from sketches, several labellings or settings in one pass, mixtures with few points."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.functions import ranks
from basketry.operators import cluster, cluster_metrics, density, mixture, outliers, text, vectors

QS = {"low": 0.0, "p01": 0.01, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p99": 0.99, "high": 1.0}


def columns(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        heavy = rng.choice([0.0, 0.0, 1.0, rng.random()])
        rows.append((rng.gauss(0, 1e6), heavy, float(i % 3), None if i % 5 else float("nan"), i * 7 % 101))
    return rows


@pytest.mark.parametrize("size", [256, 4096])
@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_exact_quantiles_of_any_sketch_size(spark, monkeypatch, size, method):
    """Small sketches need several passes, and err; the result stays exact."""
    monkeypatch.setattr(ranks, "SKETCH", size)
    rows = columns(3000)
    df = spark.createDataFrame(rows, "wide double, heavy double, few double, none double, whole bigint").repartition(5)
    got = ranks.exact_quantiles(df, df.columns, QS, method)
    for i, c in enumerate(df.columns):
        values = sorted(r[i] for r in rows if r[i] is not None and not math.isnan(r[i]))
        for name, q in QS.items():
            if not values:
                assert got[c][name] is None
            elif method == "nearest":
                assert got[c][name] == values[math.floor(q * (len(values) - 1) + 0.5)]
            else:
                assert got[c][name] == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_exact_quantiles_of_awkward_columns(spark):
    df = spark.createDataFrame([(math.inf, 5.0), (-math.inf, 5.0), (1.0, 5.0), (None, 5.0)], "a double, b double")
    got = ranks.exact_quantiles(df, ["a", "b"], {"m": 0.5, "top": 1.0})
    assert got == {"a": {"m": 1.0, "top": math.inf}, "b": {"m": 5.0, "top": 5.0}}
    assert ranks.exact_quantiles(df.limit(0), ["a"], {"m": 0.5}) == {"a": {"m": None}}
    assert ranks.quantile_values(df, "b", {"q": 0.1}) == {"q": 5.0}


def test_outliers_without_numbers_or_spread(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (50.0, None)] + [(1.0, None)] * 9, "x double, empty double")
    for found in (outliers.iqr_outliers(df, df.columns), outliers.modified_zscore_outliers(df, df.columns), outliers.outlier_summary(df)):
        assert [r["column"] for r in found.collect()] == ["x"]
    assert outliers.modified_zscore_outliers(df, ["x"]).first()["outliers"] == 0  # no deviation, no outlier
    assert outliers.iqr_outliers(df, ["x"]).first()["outliers"] == 1


def test_sketches_merge(spark):
    rows = [(i % 3, float(i * 37 % 1000)) for i in range(1000)] + [(3, None)]
    df = spark.createDataFrame(rows, "part int, x double")
    parts = outliers.quantile_sketches(df, ["x"], ["part"])
    assert parts.count() == 4
    bounds = outliers.sketch_bounds(outliers.merged_sketches(parts)).first()
    assert bounds["n"] == 1000 and abs(bounds["q1"] - 250) < 20 and abs(bounds["q3"] - 750) < 20
    flagged = outliers.flagged(df.unionAll(spark.createDataFrame([(9, 5000.0)], "part int, x double")), outliers.sketch_bounds(outliers.merged_sketches(parts)))
    assert flagged.filter("x_outlier").count() == 1 and flagged.filter("x IS NULL AND x_outlier").count() == 0


def brute_silhouette(x, labels):
    out = {}
    for i, own in enumerate(labels):
        if own is None:
            continue
        mean = {}
        for c in {c for c in labels if c is not None}:
            d = [math.dist(x[i], x[j]) for j, other in enumerate(labels) if other == c and j != i]
            mean[c] = sum(d) / len(d) if d else None
        others = [m for c, m in mean.items() if c != own]
        if not others:
            out[i] = None
        else:
            out[i] = 0.0 if mean[own] is None else (min(others) - mean[own]) / max(min(others), mean[own])
    return out


@pytest.mark.parametrize("block", [7, 8192])
def test_silhouettes_of_several_labellings(spark, monkeypatch, block):
    monkeypatch.setattr(cluster_metrics, "BLOCK", block)
    monkeypatch.setattr(cluster_metrics, "BLOCK_FIELDS", 64)
    rng = random.Random(5)
    x = [[rng.gauss(4 * (i % 3), 1), rng.random()] for i in range(600 if block > 100 else 60)]
    labellings = {
        "a": [i % 3 for i in range(len(x))],
        "b": [rng.randrange(2) for _ in x],
        "alone": [7 if i == 0 else 1 for i in range(len(x))],
        "one": [4 for _ in x],
        "noise": [None if i % 4 else i % 3 for i in range(len(x))],
    }
    points = spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(x)], "id string, vector array<double>")
    labels = spark.createDataFrame([(t, f"p{i}", c) for t, cs in labellings.items() for i, c in enumerate(cs)], "run string, id string, c int")
    got = {(r["run"], r["id"]): r["silhouette"] for r in cluster_metrics.silhouette_points(points, labels, "id", "c", "run").collect()}
    want = {(t, f"p{i}"): s for t, cs in labellings.items() for i, s in brute_silhouette(x, cs).items()}
    assert set(got) == set(want)
    for k, s in want.items():
        assert got[k] == (None if s is None else pytest.approx(s, abs=1e-9))


def test_silhouettes_hold_few_rows_of_distances(spark, monkeypatch):
    whole = cluster_metrics.pairwise

    def few(a, b):
        assert len(a) <= 128
        return whole(a, b)

    monkeypatch.setattr(cluster_metrics, "pairwise", few)
    rng = random.Random(6)
    x = [[rng.gauss(4 * (i % 3), 1), rng.random()] for i in range(300)]
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(x)], "id bigint, vector array<double>, c int").repartition(3)
    got = {r["id"]: r["silhouette"] for r in cluster_metrics.silhouette_values(df, "id", "c").collect()}
    assert got == {i: pytest.approx(s, abs=1e-9) for i, s in brute_silhouette(x, [i % 3 for i in range(300)]).items()}


def test_silhouettes_on_a_line_need_no_pairs(spark, monkeypatch):
    """Vectors of one number meet no blocks; equal and distant numbers, several ranges and a missing number are scored alike."""
    monkeypatch.setattr(cluster_metrics, "RANGE", 50)
    monkeypatch.setattr(cluster_metrics, "pairwise", None)
    rng = random.Random(8)
    x = [[rng.choice([5.0, rng.gauss(0, 3), 1e6 + rng.random()])] for _ in range(300)]
    labellings = {
        "a": [rng.randrange(3) for _ in x],
        "b": [int(v[0] > 4) + 2 * int(v[0] > 1e5) for v in x],
        "same": [int(i % 2) if v[0] == 5.0 else None for i, v in enumerate(x)],
        "alone": [7 if i == 0 else 1 for i in range(len(x))],
        "one": [4 for _ in x],
        "noise": [None if i % 4 else i % 3 for i in range(len(x))],
    }
    points = spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(x)], "id string, vector array<double>")
    labels = spark.createDataFrame([(t, f"p{i}", c) for t, cs in labellings.items() for i, c in enumerate(cs)], "run string, id string, c int")
    got = {(r["run"], r["id"]): r["silhouette"] for r in cluster_metrics.silhouette_points(points, labels, "id", "c", "run").collect()}
    assert all(s == 0 for (t, _), s in got.items() if t == "same")
    want = {(t, f"p{i}"): s for t, cs in labellings.items() if t != "same" for i, s in brute_silhouette(x, cs).items()}
    assert set(want) == {k for k in got if k[0] != "same"}
    for k, s in want.items():
        assert got[k] == (None if s is None else pytest.approx(s, abs=1e-9))
    gaps = spark.createDataFrame([(1, [None], 0), (2, [1.0], 0), (3, [2.0], 1), (4, [2.5], 1), (5, [9.0], 2)], "id int, vector array<double>, c int")
    got = {r["id"]: r["silhouette"] for r in cluster_metrics.silhouette_values(gaps, "id", "c").collect()}
    assert got[5] == 0 and all(math.isnan(got[i]) for i in (1, 2, 3, 4))


def test_trials_share_a_pass_and_keys_may_be_text(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 16)
    rng = random.Random(3)
    x = [[rng.gauss(3 * (i % 4), 0.5), rng.gauss(0, 0.5)] for i in range(120)] + [[50.0, 50.0]] * 3
    df = spark.createDataFrame([(f"k{i:03}", v) for i, v in enumerate(x)], "id string, vector array<double>")
    settings = [(0.3, 4), (0.6, 4), (0.6, 9), (5.0, 2)]
    many = density.dbscan_trials(df, "id", settings)
    got = {t: {r["id"]: r["label"] for r in many.filter(F.col("t") == t).collect()} for t in range(len(settings))}
    for t, (eps, m) in enumerate(settings):
        near = [[j for j in range(len(x)) if math.dist(x[i], x[j]) <= eps] for i in range(len(x))]
        core = {i for i in range(len(x)) if len(near[i]) >= m}
        root = {i: i for i in core}
        changed = True
        while changed:
            changed = False
            for i in core:
                low = min(root[j] for j in near[i] if j in core)
                if low < root[i]:
                    root[i], changed = low, True
        for i in range(len(x)):
            if i not in core and any(j in core for j in near[i]):
                root[i] = min(root[j] for j in near[i] if j in core)
        sizes = {}
        for r in root.values():
            sizes[r] = sizes.get(r, 0) + 1
        number = {r: n for n, r in enumerate(sorted(sizes, key=lambda r: (-sizes[r], r)))}
        assert got[t] == {f"k{i:03}": number[root[i]] if i in root else -1 for i in range(len(x))}, settings[t]


def test_nearest_distances_for_several_k(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 8)
    rng = random.Random(9)
    x = [[rng.random(), rng.random()] for _ in range(50)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id bigint, vector array<double>")
    got = {r["id"]: r["distances"] for r in density.nearest_distances(df, "id", [1, 5, 60]).collect()}
    for i in range(50):
        d = sorted(math.dist(x[i], y) for y in x)
        assert got[i][:2] == pytest.approx([d[0], d[4]], abs=1e-7) and got[i][2] is None


def test_blocks_in_strips_and_shared_keys(spark, monkeypatch):
    """Crowded and empty regions, blocks cut into strips; candidates are merged as tables, without a window over all of them."""
    monkeypatch.setattr(density, "BLOCK", 40)
    monkeypatch.setattr(density, "STRIP", 7)
    rng = random.Random(4)
    x = [[rng.gauss(0, 0.3), rng.gauss(0, 0.3)] for _ in range(90)] + [[rng.uniform(-5, 5), rng.uniform(-5, 5)] for _ in range(60)]
    df = spark.createDataFrame([(f"k{i:03}", v) for i, v in enumerate(x)], "id string, vector array<double>")
    near = [[j for j, y in enumerate(x) if math.dist(x[i], y) <= 0.4] for i in range(len(x))]
    core = {i for i, js in enumerate(near) if len(js) >= 5}
    root = {i: i for i in core}
    while (low := {i: min(root[j] for j in near[i] if j in core) for i in core}) != root:
        root = low
    root |= {i: min(root[j] for j in near[i] if j in core) for i in range(len(x)) if i not in core and core.intersection(near[i])}
    order = sorted(set(root.values()), key=lambda r: (-list(root.values()).count(r), r))
    got = {r["id"]: r["label"] for r in density.dbscan(df, "id", 0.4, 5).collect()}
    assert got == {f"k{i:03}": order.index(root[i]) if i in root else -1 for i in range(len(x))}
    found = density.nearest_distances(df, "id", [3])
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: r["distances"][0] for r in found.collect()}
    assert got == {f"k{i:03}": pytest.approx(sorted(math.dist(v, y) for y in x)[2], abs=1e-9) for i, v in enumerate(x)}
    twice = density.nearest_distances(df.unionAll(df), "id", [1, 3])
    assert twice.count() == len(x) and all(r["distances"][0] == 0 for r in twice.collect())


def test_mixture_of_fewer_points_than_parameters(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (12, 10)), rng.normal(6, 1, (9, 10)), np.zeros((4, 10))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>").repartition(3)
    for k, (fit, history) in cluster.gaussian_mixtures(df, "id", [1, 2, 4]).items():
        assert fit.weights.sum() == pytest.approx(1) and all(np.isfinite(history)) and history[-1] >= history[0] - 1e-3
        assert fit.weights @ fit.means == pytest.approx(x.mean(0), abs=1e-8)
        rows = mixture.memberships(df, "id", fit).collect()
        assert len(rows) == len(x) and all(sum(r["probability"]) == pytest.approx(1) for r in rows)
    one = cluster.gaussian_mixtures(df, "id", [1])[1][0]
    assert one.covariances[0] == pytest.approx(np.cov(x.T, bias=True) + 1e-6 * np.eye(10), abs=1e-8)


def test_mixture_finds_well_separated_groups(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.5, (80, 2)) for m in (0, 8)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    rows, _, parameters = cluster.gaussian_mixture(df, "id", 2)
    label = {r["id"]: r["cluster"] for r in rows.collect()}
    assert len({label[i] for i in range(80)}) == 1 and len(set(label.values())) == 2 and parameters == 1 + 4 + 6
    curve = {r["k"]: r["aic"] for r in cluster.aic_curve(df, "id", [1, 2]).collect()}
    assert curve[2] < curve[1]


def test_reconstruction_errors_equal_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(1000, 1, (90, 5)) @ rng.normal(0, 1, (5, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>").repartition(4)
    out, variances = vectors.reconstruction_errors(df, "id", 2)
    centred = x - x.mean(0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    rest = centred - centred @ axes[:2].T @ axes[:2]
    got = {r["id"]: r for r in out.collect()}
    for i in range(90):
        assert got[i]["energy"] == pytest.approx((centred[i] ** 2).sum()) and got[i]["residual"] == pytest.approx((rest[i] ** 2).sum(), abs=1e-6)
    assert variances == pytest.approx(s**2 / 90, abs=1e-6)
    flagged = vectors.reconstruction_outliers(df, "id", 2, share=0.1)
    assert flagged.filter("outlier").count() == 9


def test_terms_are_counted_in_chunks(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("aa bb cc dd x é ßß".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None, "aa", "x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").repartition(3)
    for chunk, high in ((1, 2), (50, 3), (1 << 24, 3)):
        monkeypatch.setattr(text, "CHUNK_CHARS", chunk)
        want = {}
        for t in texts:
            words = [w for w in (t or "").split(" ") if len(w) >= 2]
            grams = [" ".join(words[i : i + n]) for n in range(1, high + 1) for i in range(len(words) - n + 1)]
            for g in grams:
                want.setdefault(g, [0, 0])[1] += 1
            for g in set(grams):
                want[g][0] += 1
        got = {r["term"]: [r["df"], r["tf"]] for r in text.term_totals(df, "t", 1, high).collect()}
        assert got == want
    vocab = text.vocabulary(df.fillna("", ["t"]), "id", "t", 64, 2, 0.9, 10)
    weights = text.tfidf(df, "id", "t", vocab, 64).groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert weights and all(r["n"] == pytest.approx(1) for r in weights)
    assert text.tfidf(df, "id", "t", vocab.limit(0), 64).count() == 0


def test_texts_are_encoded_once(spark):
    """unfolding the vectors filters them, which must not encode the texts a second time."""
    called = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            called.add(len(texts))
            return np.array([[len(t), 0.0, float(t.count("a"))] for t in texts])

        return encode

    df = spark.createDataFrame([(i, "ab" * (i % 7)) for i in range(40)], "id bigint, t string").coalesce(1)
    out = text.embed(df, "id", "t", load)
    flat = out.select("id", F.posexplode("vector").alias("at", "x")).filter("x != 0").collect()
    assert called.value == 40
    got = {(r["id"], r["at"]): r["x"] for r in flat}
    assert got == {k: pytest.approx(x) for i in range(40) if i % 7 for k, x in (((i, 0), 2 / 5**0.5), ((i, 2), 1 / 5**0.5))}
    assert text.embed(df.limit(0), "id", "t", load, normalise=False).count() == 0


def test_counting_terms_takes_little_memory(spark):
    """what a chunk of texts needs while its terms are counted stays below 150 MB."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    words = np.array([f"w{'abcdefghij'[i % 10]}{i}" for i in range(30_000)])
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words[rng.integers(0, 30_000, 400)]) for _ in range(4000)])], ["t"])
    tracemalloc.start()
    counted = [text._counted(chunk.column(0), 1, 2)[3].sum() for chunk in text._chunks(iter([batch]), 0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(counted) == 4000 * (400 + 399) and peak < 150e6


def test_a_callers_stop_words_replace_the_list(spark):
    df = spark.createDataFrame([("The red Shirt and no_description a",)], "t string")
    rows = df.select(text.words(F.col("t")).alias("a"), text.words(F.col("t"), (), ["RED"]).alias("b"), text.words(F.col("t"), ["shirt"]).alias("c")).first()
    assert rows["a"] == ["red", "shirt", "description"] and rows["b"] == ["the", "shirt", "and", "no", "description"] and rows["c"] == ["red", "description"]


def test_features_are_made_once(spark):
    """Scaling reads its input several times; what makes the features runs once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def costly(x):
        made.add(1)
        return float(x)

    rows = [(i, *[float(i * j % 7) for j in range(7)]) for i in range(30)]
    df = spark.createDataFrame(rows, "customer_id bigint, " + ", ".join(f"{c} double" for c in cluster.FEATURE_SETS["hybrid"]))
    prepared = cluster.prepare_features(df.withColumn("recency", costly("recency")), "hybrid")
    assert prepared.count() == 30 and prepared.agg(F.abs(F.sum(F.col("vector")[0])) < 1e-9).first()[0] and made.value == 30
    _, summary = cluster.segment_on(df.withColumn("recency", costly("recency")), "customer_id", ["recency", "monetary"], 2)
    assert summary.agg(F.sum("size")).first()[0] == 60 and made.value == 60


def test_pairs_of_blocks_are_never_shuffled(spark, tmp_path):
    """Blocks meet by reading, not by a join that deals out a copy of both for every pair."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(900, 4)).tolist())], "id bigint, vector array<double>")
    labels = df.select("id", (F.col("id") % 3).alias("c"))
    for found in (density.nearest_distances(df, "id", [15]), cluster_metrics.silhouette_points(df, labels, "id", "c", "run")):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert found.count() == 900


def test_silhouettes_of_equal_labellings_and_small_pieces(spark, monkeypatch):
    """Equal labellings are scored once, under each name; pieces of a block are scored by several tasks."""
    monkeypatch.setattr(cluster_metrics, "BLOCK_FIELDS", 64)
    rng = random.Random(15)
    x = [[rng.gauss(4 * (i % 3), 1), rng.random()] for i in range(90)]
    labellings = {"a": [i % 3 for i in range(90)], "b": [rng.randrange(4) for _ in x], "c": [i % 3 for i in range(90)]}
    points = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id bigint, vector array<double>")
    labels = spark.createDataFrame([(t, i, c) for t, cs in labellings.items() for i, c in enumerate(cs)], "run string, id bigint, c int")
    got = {(r["run"], r["id"]): (r["c"], r["silhouette"]) for r in cluster_metrics.silhouette_points(points, labels, "id", "c", "run").collect()}
    assert got == {(t, i): (cs[i], pytest.approx(s, abs=1e-9)) for t, cs in labellings.items() for i, s in brute_silhouette(x, cs).items()}
