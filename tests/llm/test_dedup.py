"""The three deduplication operators against brute force on the awkward corpus."""

from collections import Counter

import numpy as np
import pytest

from basketry.llm import near_dedup
from basketry.llm.arrays import U, mix
from basketry.llm.near_dedup import connected, near_duplicates
from basketry.llm.substring_dedup import recompress, remove_repeats
from basketry.llm.suffix_dedup import remove_repeated_bytes

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def marked(n, starts, width):
    gone = [False] * n
    for p in starts:
        gone[p : p + width] = [True] * width
    return gone


@pytest.mark.parametrize("width", [40, 400])
def test_byte_repeats(docs, rows, width):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(d[p : p + width] for _, d in data for p in range(len(d) - width + 1))
    want = []
    for i, d in data:
        gone = marked(len(d), [p for p in range(len(d) - width + 1) if seen[d[p : p + width]] > 1], width)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(docs, width, 6, 8 if width == 40 else 32).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[2] for w in want)


@pytest.mark.parametrize("width", [40, 400])
def test_bytes_an_earlier_document_has(docs, rows, width):
    check_earlier(docs, rows, width)


def test_earlier_documents_with_part_of_a_passage(spark):
    """Copies of copies: passages cut anywhere, so one stretch has several names, under far, negative, null and repeated ids."""
    rng = np.random.default_rng(12)
    prose = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    passages = [prose(300) for _ in range(4)]
    texts = []
    for _ in range(60):
        pieces = []
        for _ in range(int(rng.integers(1, 4))):
            p = passages[int(rng.integers(0, 4))]
            a = int(rng.integers(0, 150))
            pieces += [p[a : a + int(rng.integers(30, 250))], prose(int(rng.integers(0, 15)))]
        texts += ["".join(pieces)] * int(rng.integers(1, 4))
    ids = [int(i) for i in rng.permutation(len(texts)) * 3 - 50]
    ids[:4] = [None, -(1 << 62), 1 << 62, ids[5]]
    rows = list(zip(ids, texts, strict=True))
    check_earlier(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), rows, 40)


def check_earlier(docs, rows, width):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    last = 1 << 63
    first = {}
    for i, d in data:
        for p in range(len(d) - width + 1):
            k = d[p : p + width]
            first[k] = min(first.get(k, last), last if i is None else i)
    want = []
    for i, d in data:
        own = last if i is None else i
        want.append((i, len(d), sum(marked(len(d), [p for p in range(len(d) - width + 1) if first[d[p : p + width]] < own], width))))
    out = remove_repeated_bytes(docs, width, 6, 8 if width == 40 else 32).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_earlier) for r in out], key=str) == sorted(want, key=str)
    assert 0 < sum(w[2] for w in want) < sum(r.n_removed for r in out)


@pytest.mark.parametrize(("width", "rounds"), [(8, 2), (50, 5)])
def test_word_repeats(docs, rows, width, rounds):
    data = [(r[0], (r[1] or "").encode().split()) for r in rows]
    last = 1 << 63
    first = {}
    for i, w in data:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, last), last if i is None else i)
    want = []
    for i, w in data:
        own = last if i is None else i
        gone = marked(len(w), [p for p in range(len(w) - width + 1) if first[tuple(w[p : p + width])] < own], width)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        want.append((i, len(w), sum(gone), kept))
    out = remove_repeats(docs, width, rounds).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out], key=str) == sorted(want, key=str)
    assert all(r.n_removed == sum(s.stop - s.start for s in r.removed) for r in out)
    assert any(w[2] for w in want)


def test_contexts_decide_symbols():
    """A symbol whose context lies in both of two equal stretches stands in both."""
    rng = np.random.default_rng(3)
    word = lambda n: mix(rng.integers(0, 5, n).astype(U) + U(1))
    shared = word(60)
    texts = [np.concatenate([word(int(rng.integers(0, 30))), shared, word(int(rng.integers(0, 30)))]) for _ in range(2)]
    for rounds in range(1, 5):
        sides = []
        for t in texts:
            at = next(p for p in range(len(t)) if (t[p : p + 60] == shared).all())
            symbol, low, high = recompress(t, np.zeros(len(t), np.int64), rounds)
            inside = (low >= at) & (high <= at + 60)
            sides.append({(int(a) - at, int(b) - at, int(s)) for a, b, s in zip(low[inside], high[inside], symbol[inside], strict=True)})
        assert sides[0] == sides[1]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, size):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().translate(LOWER).split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        least = min(ids, default=None)
        want.append((r[0], len(sets[i]), least, r[0] == least))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, size).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("block", [3, 512])
def test_crowds_are_compared_in_blocks(spark, monkeypatch, block):
    """Copies around the threshold of one another: every link counts, whatever the size of a block."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = [[f"b{g}x{i}" for i in range(80)] for g in range(2)]
    texts = []
    for k in range(60):
        w = list(base[k % 2])
        for p in rng.choice(80, int(rng.integers(2, 9)), replace=False):
            w[p] = f"n{k}x{p}"
        texts.append(" ".join(w))
    sets = [frozenset(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    group = list(range(60))
    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 2).collect()}
    assert got == dict(enumerate(group)) and 4 < len(set(group)) < 60


def test_near_copies_without_a_common_centre(spark):
    """A chain of copies, each near its neighbours only, is one group; texts at 0.7 to it stay out."""
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(words[k * 5 : k * 5 + 60])) for k in range(20)] + [(100, " ".join(words[:48] + [f"q{i}" for i in range(12)]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 2).collect()}
    assert got == {**{k: 0 for k in range(20)}, 100: 100}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 150: 100, 200: 100}


def test_empty_tables(empty):
    assert remove_repeated_bytes(empty).count() == remove_repeats(empty).count() == near_duplicates(empty).count() == 0
