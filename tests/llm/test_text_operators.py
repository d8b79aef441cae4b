"""Scoring, language, formatting, decontamination, quality and private data against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basketry.llm import chat_format as chat
from basketry.llm.decontamination import MASKS, contamination
from basketry.llm.language_id import UNDETERMINED, codewords, identify, train
from basketry.llm.lm_score import score_documents
from basketry.llm.private_data import find_private, redacted, spelled
from basketry.llm.quality_rules import quality

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def test_scores(docs, rows):
    held = lambda r: r[0] is not None and r[0] % 7 == 2
    texts = [(r, [*words(r[1]), None]) for r in rows]
    learn = [t for r, t in texts if not held(r)]
    count = Counter(w for t in learn for w in t)
    pair = Counter(p for t in learn for p in zip([0, *t[:-1]], t, strict=True))
    context = {**count, 0: len(learn)}
    n, v = sum(count.values()), len(count)
    cells = {}
    for (h, w), k in pair.items():
        c = context[h]
        cells.setdefault(int(math.log2(c)), []).append(((k - 1) / (c - 1) if c > 1 else 0.0, count[w] / (n + v), k))
    weight = {}
    for b, items in cells.items():
        x = 0.5
        for _ in range(500):
            x = sum(k * x * f2 / (x * f2 + (1 - x) * f1) for f2, f1, k in items) / sum(k for *_, k in items)
            x = min(max(x, 1e-9), 1 - 1e-9)
        weight[b] = x
    want = []
    for r, t in texts:
        base = [(count[w] + 1) / (n + v + 1) for w in t]
        score = 0.0
        for h, w, p in zip([0, *t[:-1]], t, base, strict=True):
            c = context.get(h, 0)
            x = weight[int(math.log2(c))] if c else 0.0
            score += math.log10(x * pair[h, w] / max(c, 1) + (1 - x) * p)
        want.append((r[0], held(r), len(t), sum(count[w] > 0 for w in t), sum(map(math.log10, base)), score))
    got = [tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")) for r in score_documents(docs, F.col("doc_id") % 7 == 2).collect()]
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4]) and g[5] == pytest.approx(w[5], rel=2e-3)


def test_scores_without_training_rows(docs, empty):
    assert score_documents(empty, F.lit(False)).count() == 0
    assert all(r.score == pytest.approx(r.base_score) and r.n_known == 0 for r in score_documents(docs, F.lit(True)).collect())


def test_codewords_differ():
    for n in (1, 2, 4, 6, 7, 30):
        code = codewords(n)
        assert len({tuple(c) for c in code}) == n
    assert min((a != b).sum() for i, a in enumerate(codewords(30)) for b in codewords(30)[:i]) >= 10


def test_language(spark, docs, rows, empty):
    rng = random.Random(1)
    kinds = {"aa": "ka li mo nu re".split(), "bb": "zu wex yiq jov pah".split(), "cc": "ère çon ôte îlu ûna".split()}
    make = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(2)) for _ in range(n))
    sample = [(i, make(k, rng.randint(3, 40)), k) for i, k in enumerate(list(kinds) * 40)]
    model = train(spark.createDataFrame(sample[:60], "doc_id bigint, text string, lang string"))
    out = identify(spark.createDataFrame(sample[60:], "doc_id bigint, text string, lang string"), model).collect()
    assert sum(r.lang_pred == r.row.lang for r in out) >= 0.98 * len(out)
    out = identify(docs, train(docs.select("text", "lang"))).collect()
    assert len(out) == len(rows) and set(out[0].row.asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "row", "node", "place"}
    for r in out:
        letter = r.row.text is not None and any(c.isalpha() for c in r.row.text)
        assert (r.lang_pred == UNDETERMINED) == (not letter) and 0 <= r.score <= 1
    blank = train(empty.select("text", "lang"))
    assert {r.lang_pred for r in identify(docs, blank).collect()} == {UNDETERMINED}
    assert identify(empty, model).count() == 0


def test_chat_round_trip_of_hostile_text():
    rng = random.Random(1)
    parts = ["<", "|", "\\", "n", "<|im_start|>", "<|im_end|>", "\n", "a", "<|im_end|>\n", "<n|", "im_end"]
    for _ in range(20000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randint(0, k))) for k in (4, 7))
        formatted = chat.round_trip(role, text)
        assert [(r, t) for r, t, _, _ in chat.parse(formatted * 2)] == [(role, text)] * 2
    with pytest.raises(ValueError, match="no turn"):
        list(chat.parse("x"))


def test_chat_digests(spark, monkeypatch):
    turns = [(1, 1, "assistant", "b <|im_end|>"), (1, 0, "user", "a"), (1, 1, "assistant", "b <|im_end|>"), (2, 0, "assistant", None), (2, None, None, "é" * 50), (None, 0, "user", "x"), (3, 0, "user", "y" * 40)]
    turns += [(4, i, "assistant", f"long {i} <|im_start|>" * 20000) for i in range(6)]
    frame = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id bigint, turn bigint, role string, text string, segment string")
    segments = chat.format_conversations(frame)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(segments).collect()}
    assert segments.where("conv_id = 4").count() > 1
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        n, turns_sha, chars, loss_sha, _ = got[conv]
        assert (n, turns_sha, chars, loss_sha) == (len(mine), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_masks_survive_three_changes():
    from itertools import combinations

    for changed in combinations(range(15), 3):
        assert any(not {o + k for k in m} & set(changed) for m in MASKS for o in range(15 - m[-1]))


def test_contamination(spark, docs, rows, empty):
    rng = random.Random(2)
    w = [f"t{i}" for i in range(500)]
    items = [(k, " ".join(rng.choice(w) for _ in range(n))) for k, n in enumerate([40, 25, 15, 9, 6, 3])] + [(None, "x y z a b c"), (9, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = []
    for k, item in items[:6]:
        for changes in (0, 3):
            t = item.split()
            for p in rng.sample(range(len(t)), min(changes, len(t))):
                t[p] = "changed"
            texts.append(" ".join(rng.choice(w) for _ in range(20)) + " " + " ".join(t).upper() + " " + " ".join(rng.choice(w) for _ in range(20)))
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, None, "c"), (77, "", "c")], "doc_id bigint, text string, item_ids string")

    def truth(text):
        d, found = words(text), []
        for k, item in items:
            t = words(item)
            m = min(15, len(t))
            if k is None or len(t) < 5:
                continue
            for s in range(-len(t) + m, len(d) - m + 1):
                same = [0 <= s + p < len(d) and d[s + p] == t[p] for p in range(len(t))]
                spans = [same[a : a + m] for a in range(len(t) - m + 1) if s + a >= 0 and s + a + m <= len(d)]
                if any(sum(x) >= 0.8 * m for x in spans):
                    found.append(k)
                    break
        return found

    for part in (1 << 20, 30):
        got = {r.row.doc_id: (r.item_ids, r.overlaps) for r in contamination(frame, bench, part_words=part).collect()}
        for i, t in enumerate(texts):
            assert got[i][0] == truth(t), (i, t)
            assert bool(got[i][1]) == bool(got[i][0])
        assert got[None][0] == got[77][0] == []
    assert {tuple(r.item_ids) for r in contamination(docs, bench.limit(0)).collect()} == {()}
    assert contamination(docs, bench).count() == len(rows) and contamination(empty, bench).count() == 0


def test_quality(docs, rows, empty):
    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    want = []
    for r in rows:
        x = r[1] or ""
        w = pattern.findall(x)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = {p + k for p in range(len(w) - 2) if seen[w[p], w[p + 1], w[p + 2]] > 1 for k in range(3)}
        lines = [t for t in x.split("\n") if pattern.search(t)]
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(repeat), failed))
    out = quality(docs).collect()
    got = [(r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not any(r.kept and r.base_failed for r in out)
    assert quality(empty).count() == 0


def test_quality_verdicts(spark):
    good = "\n".join("Here " + " ".join(f"w{i}x{k}" for k in range(9)) + "." for i in range(8))
    menu = "\n".join("Home | About | Contact | News | Shop | Login | Help" for _ in range(12))
    cut = "\n".join(f"item {i} without any closing mark" for i in range(20))
    frame = spark.createDataFrame([(1, good), (2, good + "\n" + menu[:51]), (3, menu), (4, cut), (5, good + "\nAll rights reserved.")], "doc_id bigint, text string")
    got = {r.row.doc_id: (r.kept, r.cleaned) for r in quality(frame).collect()}
    assert [got[i][0] for i in range(1, 6)] == [True, True, False, False, True]
    assert got[2][1] == got[5][1] == got[1][1] == good


HARD = [
    "a@b.c_d@e.f x@y@z.com .@a.b a@b. a@-.-",
    "1.2.3.4.5 256.1.1.1 000255.1.1.1 1.2.3 9999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 12345678901234567890 4242424242424242",
    "+1 (555) 123-4567 +12 +1((((2 ++49 30 1234567- +1.2.3.4.5.6.7.8.9.0",
    "é mail ünïcode@x.org 𝒳 4242424242424242 +1 (555) 123-4567",
    "9" * 5000 + " " + "a" * 5000 + "@" + "b.c" * 10 + " " + "1.1." * 900,
]


def seeds(x):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(k, m):
        d = re.sub("[^0-9]", "", m)
        if k == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if k == "phone":
            return 10 <= len(d) <= 15
        total = sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d)))
        return k == "email" or 14 <= len(d) <= 19 and total % 10 == 0

    found = sorted((m.start(), rank, k, m.end()) for rank, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, x) if holds(k, m[0]))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


def test_private_seeds(spark, docs, rows, empty):
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate([*HARD, "", None])], "doc_id bigint, text string, spans string")
    got = {r.doc_id: r.s for r in find_private(frame).select("row.doc_id", spelled(F.filter("spans", lambda s: s["base"])).alias("s")).collect()}
    for i, t in enumerate([*HARD, "", None]):
        assert got[i] == seeds(t or ""), i
    assert find_private(docs).count() == len(rows) and find_private(empty).count() == 0


def test_private_data_in_a_text_of_many_numbers(spark):
    """100,000 number tokens in one text, an address or phone number among each hundred: time follows the tokens."""
    words = [f"{i * 7919 % 100003:05d}" for i in range(100_000)]
    for i in range(0, 100_000, 100):
        words[i] = f"call +1 (017) 555-{i // 100:04d}" if i % 200 else f"u{i}@example.org"
    text = "\n".join(words)
    frame = spark.createDataFrame([(1, text), (2, "é " * 300 + "a@b.org")], "doc_id bigint, text string")
    began = time.monotonic()
    out = {r.doc_id: r for r in find_private(frame).select("row.doc_id", spelled(F.col("spans")).alias("s"), redacted(F.col("row.text"), F.col("spans")).alias("t")).collect()}
    assert time.monotonic() - began < 60
    assert out[1].s == seeds(text) and out[2].s == "email:600:607" and out[2].t == "é " * 300 + "[EMAIL]"
    plain, at = [], 0
    for span in out[1].s.split(","):
        kind, start, stop = span.split(":")
        plain += [text[at : int(start)], f"[{kind.upper()}]"]
        at = int(stop)
    assert out[1].t == "".join(plain) + text[at:]


def test_redaction_of_overlapping_spans(spark):
    """More spans than a block, some inside others, against one pass over the text."""
    text = "".join(chr(97 + i % 26) for i in range(4000))
    spans = sorted((i * 5, i * 5 + (23 if i % 40 == 0 else 3), "card" if i % 3 else "ip") for i in range(700))
    wanted, at = "", 0
    for start, stop, kind in spans:
        if start >= at:
            wanted += text[at:start] + f"[{kind.upper()}]"
        at = max(at, stop)
    frame = spark.createDataFrame([(text, [(k, a, b) for a, b, k in spans])], "t string, spans array<struct<kind:string,start:int,stop:int>>")
    assert frame.select(redacted(F.col("t"), F.col("spans"))).first()[0] == wanted + text[at:]


def test_private_contexts(spark):
    """Card numbers with a typing error stand where proper ones do; numbers in other places stay."""
    cards = ["4111111111111111", "4242424242424242", "5555555555554444", "378282246310005", "6011111111111117", "30569309025904"]
    rows = [(i, f"page {i} my card number {c} thanks") for i, c in enumerate(cards)]
    rows += [(50, "again my card number 4111111111111112 thanks"), (51, "order total 4111111111111112345 units"), (52, "part code 4111111111111113 shelf")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: (r.spans, r.t) for r in find_private(frame).select("row.doc_id", "spans", redacted(F.col("row.text"), F.col("spans")).alias("t")).collect()}
    assert [(s.kind, s.start, s.stop, s.base) for s in out[50][0]] == [("card", 21, 37, False)]
    assert out[50][1] == "again my card number [CARD] thanks"
    assert out[52][0] == [] and out[0][1] == "page 0 my card number [CARD] thanks"


def test_private_contexts_of_spaced_numbers(spark):
    """Phones and cards written in groups teach the words around them, and are found by them without their strict form."""
    rows = [(100 + i, f"page {i} please call me on +1 (017) 555-78{i:02d} today") for i in range(40)]
    ends = [next(c for c in range(10) if seeds(f"411111111111{i:03d}{c}")) for i in range(200, 240)]
    rows += [(200 + i, f"my card number 4111 1111 1111 {200 + i:03d}{c} thanks") for i, c in enumerate(ends)]
    new = {
        50: ("again call me on (017) 555-7713 today", "phone", "(017) 555-7713"),
        51: ("again call me on 017 555 7714 today", "phone", "017 555 7714"),
        52: ("again call me on 017-555.7715 today", "phone", "017-555.7715"),
        53: ("again my card number 4111 1111 1111 1112 thanks", "card", "4111 1111 1111 1112"),
        54: ("again my card number 4111-1111-1111-1113, thanks", "card", "4111-1111-1111-1113"),
        55: ("again call me on (017) 555-7716 4111 1111 1111 1114 thanks", "card", "4111 1111 1111 1114"),
    }
    rows += [(i, t) for i, (t, _, _) in new.items()] + [(60, "between 1914 1918 1939 1945 wars"), (61, "order 017 555 7799 units")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: r.spans for r in find_private(frame).select("row.doc_id", "spans").collect()}
    for i, (t, kind, value) in new.items():
        start = t.index(value)
        assert (kind, start, start + len(value), False) in [(s.kind, s.start, s.stop, s.base) for s in out[i]], (i, out[i])
    assert all(len(out[i]) == 1 for i in (50, 51, 52, 53, 54))
    assert out[60] == [] and out[61] == [] and all(s.base for i in (*range(100, 140), *range(200, 240)) for s in out[i])
