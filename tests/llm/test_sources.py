"""Source divergence and source mixing against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import source_divergence as divergence
from basketry.llm import source_mixing as mixing

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def price(count, n, v):
    return 1 + 1_000_000_000 * (count + 2) // (n + 2 * v)


def gain(p, q):
    return (p - q) * (p - q) // (p + q)


def brute_divergence(rows, least):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        mine = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        n = {s: sum(c.values()) for s, c in mine.items()}
        total = {t: sum(c[t] for c in mine.values()) for t in kept}
        p = {s: {t: price(c[t], n[s], len(kept)) for t in kept} for s, c in mine.items()}
        q = {t: price(total[t], sum(n.values()), len(kept)) for t in kept}
        for s in mine:
            pairs = [(o, sum(gain(p[s][t], p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, gain(p[s][t], q[t])) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 3, 10])
def test_divergence_equals_brute_force(docs, rows, least):
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, least).collect())
    assert got == brute_divergence(rows, least)


def test_divergence_of_many_sources(spark):
    """More sources than a tile, groups without terms, languages without kept terms, large counts."""
    rows = [(i, f"{'Alpha ' * (i % 5)} b{i % 7} ß{i % 3} 9x", "en", f"s{i % 70}") for i in range(400)]
    rows += [(900, "the " * 5000, "en", "s1"), (901, None, "en", "empty"), (902, "12 ! 3", "en", None), (903, "lonely", "xx", "a"), (904, None, "xx", "b")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.source_divergence(frame).collect())
    assert got == brute_divergence(rows, 10)
    assert {r[1] for r in got if r[0] == "xx" and r[2] == "pair" and r[4] == 0} == {"a", "b"}


def test_divergence_of_nothing(empty):
    assert divergence.source_divergence(empty).count() == 0


def test_both_products_agree(monkeypatch):
    rng = np.random.default_rng(1)
    left = np.stack([rng.integers(0, 4, 500), 4 + rng.integers(0, 9, 500)], axis=1)
    right = np.stack([rng.integers(0, 30, 500), 30 + rng.integers(0, 2, 500), 32 + rng.integers(0, 5, 500)], axis=1)

    def table():
        a, b, n = divergence.joint_tables(left, right, (13, 37))
        return {(int(x), int(y)): int(z) for x, y, z in zip(a, b, n, strict=True)}

    dense = table()
    monkeypatch.setattr(divergence, "DENSE_FIELDS", 0)
    assert dense == table() == {k: n for k, n in Counter((int(x), int(y)) for i in range(500) for x in left[i] for y in right[i]).items()}


def test_terms_of_long_texts_are_never_cut(monkeypatch):
    text = ("Ab çd 1 " * 40 + "é" * 90 + " z").encode()
    whole = [t.translate(LOWER).encode() for t in TERM.findall(text.decode())]
    for size in (1, 3, 16, 50):
        monkeypatch.setattr(divergence, "SPLIT_BYTES", size)
        assert [t for part in divergence.terms_of(text) for t in part] == whole


def test_prices_are_exact_beyond_long():
    assert divergence._prices(np.array([10**13]), 3 * 10**13, 7)[0] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 14)


def targets(sizes, weights=(1, 2, 3), most=3, budget=None):
    """Share, stop at the cap, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()) if budget is None else budget, set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = most * sizes[s]
            left -= most * sizes[s]
        free -= above
    return out


def check_mix(frame, rows, **how):
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets(dict(sizes), **how)
    got = mixing.mixed_documents(frame, **how).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted(
        (r[0] is None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in rows
    )
    key = {}
    for r in rows:
        key.setdefault((r[0], len(WORD.findall(r[1] or ""))), set()).add(r[3])
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= how.get("most", 3) * r["size"]
        sources = {s for s in key[r["doc_id"], r["size"]] if sizes[s] == r["source_size"] and abs(want[s] - r["target"]) < 1e-6}
        assert sources
        taken[min(sources, key=str)] += r["taken"]
    total = sum(taken.values())
    assert abs(total - round(sum(want.values()))) <= (0 if total else 1)
    for s in want:
        assert abs(taken[s] - want[s]) <= len(want) + 1, s
    return got


def test_mix_meets_its_targets(docs, rows):
    check_mix(docs, rows)


def test_mix_of_uneven_sources(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "big") for i in range(700)]
    rows += [(1000 + i, "w", "en", f"s{i % 13:02}") for i in range(90)] + [(2000, "w " * 20_000, "en", "one long"), (2001, "a\x0bb\x0cc\td\re\nf", "en", None)]
    rows += [(3000, None, "en", "no words"), (3001, " \n", "en", "no words")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(5)
    got = check_mix(frame, rows)
    again = mixing.mixed_documents(frame.repartition(2)).collect()
    assert sorted(got) == sorted(again)
    check_mix(frame, rows, weights=(5, 1), most=2, budget=9_000)


def test_mix_in_many_ranges(spark, monkeypatch):
    """Ranges change nothing but who sorts what."""
    rows = [(i, "w " * (i % 11), "en", f"s{i * i % 5}") for i in range(900)] + [(7, "w w", "en", "s0")] * 40
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(4)
    whole = sorted(mixing.mixed_documents(frame).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    monkeypatch.setattr(mixing, "RANGES_AT_ONCE", 3)
    assert sorted(mixing.mixed_documents(frame).collect()) == whole
    check_mix(frame, rows)


def test_the_mix_is_sorted_by_virtual_finish_time(spark):
    rows = [(i, "w " * (1 + i % 6), "en", "ab"[i % 3 == 0]) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    pieces = mixing.mix(mixing.queued(frame)).orderBy("position").collect()
    finish = [(p["finish"], p["queue"]) for p in pieces]
    assert finish == sorted(finish)
    assert [p["position"] for p in pieces] == [sum(p["words"] for p in pieces[:i]) for i in range(len(pieces))]
    # At any time, no queue is ahead of its share by more than its longest document.
    sent, target = Counter(), {p["queue"]: 0 for p in pieces}
    for r in mixing.queued(frame).select("queue", "target").distinct().collect():
        target[r["queue"]] = r["target"]
    for p in pieces:
        sent[p["queue"]] += p["words"]
        assert all(abs(sent[q] - p["finish"] * target[q]) <= 7 for q in target)
    order = [p["doc_id"] for p in pieces if p["queue"] == 0 and p["pass"] == 0]
    assert order == sorted(order, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))


def test_mix_of_nothing(empty, spark):
    assert mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (None, " ", None)], "doc_id bigint, text string, source string")
    assert sorted(r["taken"] for r in mixing.mixed_documents(blank).collect()) == [0, 0]


def test_words_are_counted_as_the_pattern_counts_them(spark):
    texts = ["", " ", "a", " a  b\t\n", "a\x0bb", "\x1cx\x85y z", "\x00 \x01", "é ß"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.words(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == {t: len(WORD.findall(t)) for t in texts}
