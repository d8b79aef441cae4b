"""Incremental features, similarity joins, baskets, factorisation and behaviour against brute force."""

import datetime as dt
import itertools
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.operators import behaviour, incremental, recommend, sequences, similarity
from basketry.operators.features import PROFILE_KINDS, category_counts, customer_features
from basketry.plans import q_text

FACTS = "t_dat date, customer_id bigint, article_id bigint, price double, sales_channel_id int"
DAY = dt.date(2024, 1, 1)


def facts(n=400, customers=25, days=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        customer = 0 if rng.random() < 0.3 else rng.randrange(customers)
        price = None if rng.random() < 0.05 else round(rng.uniform(1, 100), 2)
        rows.append((DAY + dt.timedelta(rng.randrange(days)), customer, rng.randrange(30), price, rng.choice([1, 2, 2, None])))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    articles = [(i, f"{'red blue'.split()[i % 2]} p{i % 5}", f"g{i % 4}" if i % 9 else None, f"c{i % 3}", f"k{i % 6}", f"f{i % 7}" if i % 8 else None) for i in range(30)]
    names = "article_id bigint, prod_name string, product_group_name string, colour_group_name string, garment_group_name string, product_type_name string"
    return spark.createDataFrame(facts(), FACTS), spark.createDataFrame([(i,) for i in range(30)], "customer_id bigint"), spark.createDataFrame(articles, names)


def rows_of(df, digits=9):
    def value(v):
        return round(v, digits) if isinstance(v, float) else v

    return sorted((tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(incremental, "BUCKETS", 8)


# --- P12 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_of_the_days_gives_the_features_of_all(tables, tmp_path, seed):
    tx, customers, articles = tables
    rng, path = random.Random(seed), str(tmp_path / "state")
    days = list(range(60))
    rng.shuffle(days)
    cuts = sorted(rng.sample(range(1, 60), 3))
    for version, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60], strict=True), start=1):
        chosen = [DAY + dt.timedelta(x) for x in days[a:b]]
        incremental.refresh(path, version, tx.filter(F.col("t_dat").isin(chosen)), articles)
        if version == 2 and seed == 2:
            incremental.compact(tx.sparkSession, path, str(tmp_path / "compacted"))
            path = str(tmp_path / "compacted")
    want = customer_features(tx, customers, articles)
    assert rows_of(incremental.current_features(path, customers)) == rows_of(want)


def test_a_refresh_reads_and_writes_touched_customers_only(spark, tables, tmp_path):
    tx, customers, articles = tables
    path = str(tmp_path / "state")
    few = tx.filter(F.col("customer_id").isin(3, 4)).filter(F.col("t_dat") >= DAY + dt.timedelta(50))
    incremental.refresh(path, 1, tx.filter(F.col("t_dat") < DAY + dt.timedelta(50)), articles)
    files = [f.removeprefix("file://") for t in ("totals", "counts", "features") for f in spark.read.parquet(f"{path}/{t}").inputFiles()]
    before = {f: os.path.getmtime(f) for f in files}
    # Partials of other buckets may vanish without the refresh noticing.
    touched = {r[0] for r in few.select(F.pmod(F.xxhash64("customer_id"), F.lit(incremental.BUCKETS))).distinct().collect()}
    hidden = [f for f in before if "/features/" not in f and not any(f"bucket={b}/" in f for b in touched)]
    assert hidden
    contents = {}
    for f in hidden:
        with open(f, "rb") as file:
            contents[f] = file.read()
        with open(f, "wb") as file:
            file.write(b"not parquet")
    new = incremental.refresh(path, 2, few, articles)
    assert {r["customer_id"] for r in new.collect()} == {r["customer_id"] for r in few.select("customer_id").distinct().collect()}
    for f, data in contents.items():
        with open(f, "wb") as file:
            file.write(data)
    assert all(os.path.getmtime(f) == t for f, t in before.items() if f not in contents)


def test_repeating_a_refresh_changes_nothing(tables, tmp_path):
    tx, customers, articles = tables
    path = str(tmp_path / "state")
    for version, more in ((1, False), (2, True), (2, True), (1, False)):
        part = F.col("t_dat") >= DAY + dt.timedelta(30)
        incremental.refresh(path, version, tx.filter(part if more else ~part), articles)
    assert rows_of(incremental.current_features(path, customers)) == rows_of(customer_features(tx, customers, articles))
    early = tx.filter(F.col("t_dat") < DAY + dt.timedelta(30))
    assert rows_of(incremental.current_features(path, customers, 1)) == rows_of(customer_features(early, customers, articles))


def test_a_version_without_transactions(tables, tmp_path):
    tx, customers, articles = tables
    path = str(tmp_path / "state")
    incremental.refresh(path, 1, tx, articles)
    assert incremental.refresh(path, 2, tx.filter("false"), articles).count() == 0
    assert rows_of(incremental.current_features(path, customers)) == rows_of(customer_features(tx, customers, articles))


# --- P10 ---------------------------------------------------------------------------------------------


def term_sets(n, seed, vocabulary=14, most=7):
    rng = random.Random(seed)
    return {i: {f"t{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(rng.randint(1, most))} for i in range(n)}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("chunk", [2, 2048])
def test_jaccard_join_finds_every_pair(spark, monkeypatch, threshold, chunk):
    monkeypatch.setattr(similarity, "CHUNK", chunk)
    sets = term_sets(150, 7)
    long = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s] * 2, "id bigint, term string")
    links, members = similarity.jaccard_join(long, "id", threshold)
    class_of = {r["id"]: r["class_id"] for r in members.collect()}
    assert class_of == {i: min(j for j, s in sets.items() if s == sets[i]) for i in sets}
    got = links.collect()
    want = {}
    for a, b in itertools.combinations(sorted(set(class_of.values())), 2):
        share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if share >= threshold:
            want[a, b] = share
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == pytest.approx(want) and len(got) == len(want)
    counts = {r["id"]: (r["equal"], r["similar"]) for r in similarity.link_counts(links, members, "id").collect()}
    for i, s in sets.items():
        others = [j for j in sets if j != i]
        equal = sum(sets[j] == s for j in others)
        assert counts[i] == (equal, sum(len(sets[j] & s) / len(sets[j] | s) >= threshold for j in others) - equal)


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.9])
def test_cosine_join_finds_every_pair(spark, threshold):
    sets = term_sets(120, 11)
    rng = random.Random(2)
    counts = {(i, t): rng.randint(1, 3) for i, s in sets.items() for t in s}
    long = spark.createDataFrame([(i, t, n) for (i, t), n in counts.items()], "id bigint, term string, n bigint")
    links, members = similarity.cosine_join(similarity.tfidf_terms(long, "id", len(sets)), "id", threshold)
    df = Counter(t for s in sets.values() for t in s)
    vectors = {}
    for i, s in sets.items():
        w = {t: counts[i, t] * (math.log((1 + len(sets)) / (1 + df[t])) + 1) for t in s}
        length = math.sqrt(sum(x * x for x in w.values()))
        vectors[i] = {t: x / length for t, x in w.items()}
    got = {r["id"]: r["equal"] + r["similar"] for r in similarity.link_counts(links, members, "id").collect()}
    for i, v in vectors.items():
        want = sum(sum(x * w.get(t, 0) for t, x in v.items()) >= threshold - 1e-9 for j, w in vectors.items() if j != i)
        assert got[i] == want


def test_counts_compare_in_single_precision_and_are_exact(spark, monkeypatch):
    """Products that single precision cannot tell from the threshold are counted as in double precision."""
    kinds, whole = set(), similarity._products

    def products(l, r, n):
        kinds.add(l.w.dtype.name)
        return whole(l, r, n)

    rows = [(0, "a", 1.0)]
    for i, gap in enumerate([0.0, 1e-8, -1e-8, 3e-8, -3e-8, -5e-10, 2e-6, -2e-6, 0.1, -0.1], start=1):
        rows += [(i, "a", 0.5 + gap), (i, f"z{i}", math.sqrt(1 - (0.5 + gap) ** 2))]
    weights = spark.createDataFrame(rows, "id bigint, term string, w double")
    got = {r["id"]: r["similar"] for r in similarity.cosine_counts(weights, "id", 0.5).collect()}
    assert got[0] == 6 and [i for i in range(1, 11) if got[i]] == [1, 2, 4, 6, 7, 9]
    assert rows_of(similarity.cosine_counts(weights, "id", 0.5)) == rows_of(similarity.link_counts(*similarity.cosine_join(weights, "id", 0.5), "id"))
    rng, n = np.random.default_rng(5), 40
    x = rng.random((n, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    numbers = {"size": np.full(n, 6, np.int32), "code": np.tile(np.arange(6, dtype=np.int32), n), "w": x.ravel(), "prefix": np.full(n, 6, np.int32)}
    columns = {f"{s}_{c}": pa.array([v.tobytes()], pa.binary()) for s in "lr" for c, v in numbers.items()}
    columns |= {f"{s}_terms": pa.array([list("abcdef")]) for s in "lr"} | {"term": pa.array(["a"]), "lchunk": pa.array([0]), "rchunk": pa.array([1])}
    monkeypatch.setattr(similarity, "_products", products)
    batch, similar = pa.RecordBatch.from_pydict(columns), lambda l, r, product: (product >= 0.9 - 1e-9, product)
    found = np.concatenate([close for _, _, close, _ in similarity._meetings(batch, similar, 0.9)])
    assert (found == (x @ x.T >= 0.9 - 1e-9)).all() and "float32" in kinds


def test_joins_of_nothing(spark):
    links, members = similarity.jaccard_join(spark.createDataFrame([], "id bigint, term string"), "id", 0.5)
    assert links.count() == 0 and members.count() == 0


def test_mean_vectors(spark, tables):
    tx, _, _ = tables
    vectors = spark.createDataFrame([(i, [float(i), i * i / 7.0]) for i in range(20)], "article_id bigint, vector array<double>")
    got = {r["customer_id"]: r["vector"] for r in similarity.mean_vectors(tx, vectors, "article_id").collect()}
    bought = defaultdict(list)
    for _, c, a, _, _ in facts():
        if a < 20:
            bought[c].append((a, a * a / 7.0))
    assert set(got) == set(bought)
    for c, v in bought.items():
        assert got[c] == pytest.approx(np.mean(v, axis=0))


# --- P13 ---------------------------------------------------------------------------------------------


def test_frequent_items_and_rules_equal_brute_force(spark):
    rng = random.Random(4)
    made = [{f"i{min(rng.randrange(9), rng.randrange(9))}" for _ in range(rng.randint(1, 6))} for _ in range(150)]
    rows = [(b, x) for b, s in enumerate(made) for x in s] + [(0, x) for x in made[0]] + [(500, None)]
    held = recommend.baskets(spark.createDataFrame(rows, "basket bigint, item string"), ["basket"], "item")
    assert held.count() == 150
    sets, rules = recommend.frequent_items(held, 12)
    want = Counter(c for s in made for k in range(1, len(s) + 1) for c in itertools.combinations(sorted(s), k))
    want = {c: n for c, n in want.items() if n >= 12}
    assert {tuple(r["items"]): r["n"] for r in sets.collect()} == want
    got = {(tuple(r["antecedent"]), r["consequent"]): r for r in rules.collect()}
    assert set(got) == {(tuple(x for x in c if x != y), y) for c in want if len(c) > 1 for y in c}
    for (a, y), r in got.items():
        n = want[tuple(sorted([*a, y]))]
        assert (r["n"], r["support"], r["confidence"]) == (n, pytest.approx(n / 150), pytest.approx(n / want[a]))
        assert r["lift"] == pytest.approx(n / want[a] / (want[y,] / 150))


def test_factorisation_recommends_and_sums_up(spark):
    rng = random.Random(8)
    rows = [(u, i, rng.randint(1, 3)) for u in range(40) for i in range(30) if (u % 2 == i % 2) and rng.random() < 0.5]
    counts = spark.createDataFrame(rows, "u int, i int, n int")
    model = recommend.factorise(counts, "u", "i", rank=4, rounds=6)
    users = {r["id"]: np.array(r["features"], float) for r in model.userFactors.collect()}
    items = {r["id"]: np.array(r["features"], float) for r in model.itemFactors.collect()}
    best = recommend.recommendations(model, 5, "u", "i").collect()
    for u, f in users.items():
        want = sorted((float(f @ g) for g in items.values()), reverse=True)[:5]
        mine = sorted((r for r in best if r["u"] == u), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and [r["score"] for r in mine] == pytest.approx(want, abs=1e-4)
    assert np.mean([r["i"] % 2 == r["u"] % 2 for r in best]) > 0.9  # each half of the users buys one half of the items
    found = recommend.reconstruction(model, counts, "u", "i").first()
    bought = {(u, i): n for u, i, n in rows}
    scores = {(u, i): float(f @ g) for u, f in users.items() for i, g in items.items()}
    error = sum((1 + 40 * bought[p]) * (1 - s) ** 2 if p in bought else s * s for p, s in scores.items())
    assert found["squared_error"] == pytest.approx(error, rel=1e-6)
    assert found["mean_score"] == pytest.approx(np.mean(list(scores.values())))
    assert found["bought_score"] == pytest.approx(np.mean([scores[p] for p in bought])) and found["bought"] == len(bought)


def test_blocks_of_a_factorisation_grow_in_number(spark, monkeypatch):
    rng = random.Random(9)
    counts = spark.createDataFrame([(u, i, rng.randint(1, 3)) for u in range(60) for i in rng.sample(range(40), 10)], "u int, i int, n int")
    assert recommend.factorise(counts, "u", "i", rank=3, rounds=2).userFactors.rdd.getNumPartitions() == 10
    monkeypatch.setattr(recommend, "PURCHASES", 40)
    model = recommend.factorise(counts, "u", "i", rank=3, rounds=3)
    assert model.userFactors.rdd.getNumPartitions() == model.itemFactors.rdd.getNumPartitions() == 15
    assert model.userFactors.count() == 60 and model.itemFactors.count() == 40
    best = recommend.recommendations(model, 4, "u", "i")
    assert best.count() == 240
    found = recommend.reconstruction(model, counts, "u", "i").first()
    assert found["bought"] == 600 and found["bought_score"] > found["mean_score"]


# --- P4, P5, P6, P8, P9 --------------------------------------------------------------------------------


def by_customer():
    out = defaultdict(list)
    for row in facts():
        out[row[1]].append(row)
    return out


def std(values):
    return float(np.std(values, ddof=1)) if len(values) > 1 else None


def test_horizons(tables):
    last = max(r[0] for r in facts())
    got = {r["customer_id"]: r for r in behaviour.horizon_features(tables[0], (1, 7, 30)).collect()}
    for c, rows in by_customer().items():
        for w in (1, 7, 30):
            here = [r for r in rows if (last - r[0]).days < w]
            prices = [r[3] for r in here if r[3] is not None]
            assert got[c][f"frequency_{w}d"] == len(here)
            assert got[c][f"basket_size_{w}d"] == (pytest.approx(len(here) / len({r[0] for r in here})) if here else None)
            want = std(prices)
            assert got[c][f"sensitivity_{w}d"] == (None if want is None else pytest.approx(want / np.mean(prices), abs=1e-9))


def test_activity(tables):
    last = max(r[0] for r in facts()) + dt.timedelta(1)
    got = {r["customer_id"]: r for r in behaviour.activity_features(tables[0]).collect()}
    recency = {c: max((last - max(r[0] for r in rows)).days, 1) for c, rows in by_customer().items()}
    for c, rows in by_customer().items():
        days = sorted({r[0] for r in rows})
        gaps = [(b - a).days for a, b in itertools.pairwise(days)]
        assert got[c]["recency"] == recency[c]
        assert got[c]["recency_percentile"] == pytest.approx(sum(v < recency[c] for v in recency.values()) / (len(recency) - 1))
        assert got[c]["gap_std"] == (None if len(gaps) < 2 else pytest.approx(std(gaps)))
        assert got[c]["gap_mean"] == (None if not gaps else pytest.approx(np.mean(gaps)))
        assert got[c]["spend_volatility"] == pytest.approx(std([r[3] for r in rows if r[3] is not None]))
        late = sum(2 * (r[0] - days[0]).days > (days[-1] - days[0]).days for r in rows)
        assert got[c]["late_share"] == pytest.approx(late / len(rows))
        assert got[c]["per_month"] == pytest.approx(len(rows) / max(((days[-1] - days[0]).days + 1) / 30.4375, 1))


def test_percent_rank_of_ties_and_one_row(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, 1)], "id int, v int")
    assert {r["v"]: r["p"] for r in behaviour.percent_rank(df, "v", "p").collect()} == {1: 0.0, 5: pytest.approx(1 / 3), 9: 1.0}
    assert behaviour.percent_rank(df.limit(1), "v", "p").collect()[0]["p"] == 0.0


def test_baskets_and_channels_and_loyalty(tables):
    tx, _, articles = tables
    named = {r["article_id"]: r for r in articles.collect()}
    baskets = {r["customer_id"]: r for r in behaviour.basket_features(tx, articles).collect()}
    channels = {r["customer_id"]: r for r in behaviour.channel_features(tx).collect()}
    loyalty = {r["customer_id"]: r for r in behaviour.loyalty_features(tx, articles, popular=5).collect()}
    buyers = Counter(a for _, a in {(r[1], r[2]) for r in facts()})
    best = sorted(buyers, key=lambda a: (-buyers[a], a))[:5]
    for c, rows in by_customer().items():
        days = defaultdict(list)
        for r in rows:
            days[r[0]].append(r)
        b = baskets[c]
        assert b["weekend_ratio"] == pytest.approx(sum(r[0].weekday() > 4 for r in rows) / len(rows))
        months = Counter(r[0].month for r in rows)
        assert b["peak_month"] == min(m for m, n in months.items() if n == max(months.values())) and b["peak_quarter"] == 1
        assert (b["items_per_day"], b["most_items"]) == (pytest.approx(len(rows) / len(days)), max(map(len, days.values())))
        kinds = [len({named[r[2]]["product_group_name"] for r in x} - {None}) for x in days.values()]
        assert b["cross_category_ratio"] == pytest.approx(sum(k > 1 for k in kinds) / len(days))
        spend = [sum(r[3] for r in x if r[3] is not None) for x in days.values() if any(r[3] is not None for r in x)]
        assert b["spend_per_day"] == pytest.approx(np.mean(spend))
        visits = [ch for _, ch in sorted({(r[0], r[4]) for r in rows if r[4] is not None})]
        runs = [len(list(g)) for _, g in itertools.groupby(visits)]
        ch = channels[c]
        assert (ch["switches"], ch["runs"], ch["longest_run"]) == (len(runs) - 1, len(runs), max(runs))
        known = [r[4] for r in rows if r[4] is not None]
        assert ch["online_ratio"] == pytest.approx(sum(k == 2 for k in known) / len(known)) and ch["multi_channel"] == (len(set(known)) > 1)
        families = [named[r[2]]["product_type_name"] for r in rows]
        families = [f for f in families if f is not None]
        assert loyalty[c]["family_loyalty"] == pytest.approx((len(families) - len(set(families))) / len(families))
        assert loyalty[c]["explored"] == len(set(families))
        assert loyalty[c]["popular_alignment"] == pytest.approx(sum(r[2] in best for r in rows) / len(rows))


def test_links_are_counted_where_they_are_found(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CHUNK", 40)
    sets = term_sets(150, 5)
    long = spark.createDataFrame([(i, t, 1 + i % 3) for i, s in sets.items() for t in s], "id bigint, term string, n bigint")
    weights = similarity.tfidf_terms(long, "id", len(sets))
    for join, counts, rows in ((similarity.jaccard_join, similarity.jaccard_counts, long), (similarity.cosine_join, similarity.cosine_counts, weights)):
        assert rows_of(counts(rows, "id", 0.5)) == rows_of(similarity.link_counts(*join(rows, "id", 0.5), "id"))
    # Chunks are few bytes and much work: they meet in all parts.
    pairs, _, _ = similarity._jaccard(long, "id", 0.5)
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("dense", [-1.0, 0.1, 2.0])
def test_products_of_sparse_rows(monkeypatch, dense):
    monkeypatch.setattr(similarity, "DENSE", dense)
    rng = np.random.default_rng(3)
    sides, whole = [], []
    for n in (30, 17):
        x = rng.random((n, 12)) * (rng.random((n, 12)) < 0.3)
        row, code = np.nonzero(x)
        sides.append(similarity._Side((x > 0).sum(1), row, code, x[row, code], np.ones(len(row), bool)))
        whole.append(x)
    assert similarity._products(*sides, 12) == pytest.approx(whole[0] @ whole[1].T)
    assert similarity._products(sides[0].cut(10, 20), sides[1], 12) == pytest.approx(whole[0][10:20] @ whole[1].T)


def test_best_items_equal_sorted_products(monkeypatch):
    monkeypatch.setattr(recommend, "STRIP", 7)
    rng = np.random.default_rng(8)
    users, items = rng.normal(size=(50, 4)).astype(np.float32), rng.normal(size=(40, 4)).astype(np.float32)
    items[30:] = items[:10]
    items = items[np.argsort(-np.linalg.norm(items, axis=1), kind="stable")]
    for k in (3, 45):
        best = recommend._Best(np.arange(50), users, k)
        for at in range(0, 40, 9):
            part = items[at : at + 9]
            best.offer(np.arange(at, at + len(part)), part, float(np.linalg.norm(part, axis=1).max()))
        rows = next(best.rows()).to_pydict()
        assert len(rows["user"]) == 50 * min(k, 40)
        scores = users @ items.T
        for u in range(50):
            want = sorted(scores[u], reverse=True)[:k]
            assert [s for s, x in zip(rows["score"], rows["user"], strict=True) if x == u] == pytest.approx(want, abs=1e-5)


def test_recommendations_are_the_best_products(spark):
    rng = random.Random(4)
    bought = spark.createDataFrame([(u, i, 1 + (u + i) % 3) for u in range(60) for i in rng.sample(range(25), 5)], "u bigint, i bigint, n bigint")
    model = recommend.factorise(bought, "u", "i", rank=3, rounds=2)
    got = recommend.recommendations(model, 4, "u", "i").orderBy("u", "rank").collect()
    users = {r["id"]: np.array(r["features"]) for r in model.userFactors.collect()}
    items = {r["id"]: np.array(r["features"]) for r in model.itemFactors.collect()}
    for u, v in users.items():
        mine = [r for r in got if r["u"] == u]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4] and len({r["i"] for r in mine}) == 4
        assert [r["score"] for r in mine] == pytest.approx(sorted((float(v @ w) for w in items.values()), reverse=True)[:4], abs=1e-5)
        assert all(abs(r["score"] - float(v @ items[r["i"]])) < 1e-5 for r in mine)


def test_counts_of_categories_and_mean_vectors_are_made_in_all_parts(spark, tables):
    tx, _, articles = tables
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "article_id bigint, vector array<double>")
    assert category_counts(tx, articles, PROFILE_KINDS).rdd.getNumPartitions() == wanted
    assert similarity.mean_vectors(tx, vectors, "article_id").rdd.getNumPartitions() == wanted


def test_cases_are_never_broadcast(spark):
    cases = spark.createDataFrame([(c, c % 3, c % 2) for c in range(9)], "customer_id bigint, truth bigint, context bigint")
    scores = spark.createDataFrame([(i, x, 1.0 / (1 + x), x + 1) for i in range(2) for x in range(3)], "item bigint, candidate bigint, score double, rank int")
    ranked = sequences.top_predictions(scores, cases, 3).withColumnRenamed("candidate", "item")
    hits = sequences.ranking_metrics(ranked, cases.select("customer_id", F.col("truth").alias("item")), [1, 3])
    assert [(r["k"], r["cases"], r["recall"]) for r in hits.orderBy("k").collect()] == [(1, 9, pytest.approx(1 / 3)), (3, 9, 1.0)]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") == 2


def test_words_are_taken_from_the_texts_once(spark, tmp_path):
    texts = [(1, "Two cats, one cat"), (2, "dogs and birds"), (3, "a bird"), (4, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = q_text.h03(spark, str(tmp_path))
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]
    got = {r["article_id"]: r["words"].split() for r in out.collect()}
    assert set(got) == {1, 2, 3} and got[1].count("cat") == 2 and "bird" in got[2] and "dogs" in got[2]
