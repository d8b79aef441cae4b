"""Conversation repair against a table of all edits with the audit kept as text."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from basketry.llm.conversation_repair import SEGMENT_CHARS, cheapest_edits, damaged, op13_conversation_repair, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, segment string, fault int, n int"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WHITE = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    for conv, turn, role, text, *_ in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        elif fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fault == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)


def brute_edits(turns, faults):
    """(cost, audit, repaired turns) by the recurrence over rows and states, comparing whole audits."""
    n, best = len(turns), {}
    for i in range(n, -1, -1):
        found = {q: [(0, "", [])] if i == n and q in (0, 3) else [] for q in range(4)}
        for q in range(4):
            if i == n:
                continue
            (role, text), fault = turns[i], faults[i]
            later = lambda to: best[i + 1, to]
            cost, audit, rest = later(q)
            found[q].append((cost + 4, "D" + audit, rest))
            if fault in ("blank", "duplicate"):
                continue
            cut = 3 * (fault == "truncated")
            if (q, role[:1]) in NEXT:
                cost, audit, rest = later(NEXT[q, role[:1]])
                found[q].append((cost + cut, "K" + audit, [(role, text), *rest]))
            for new in ("user", "assistant"):
                if (q, new[0]) in NEXT:
                    cost, audit, rest = later(NEXT[q, new[0]])
                    found[q].append((cost + cut + 3, "R" + audit, [(new, text), *rest]))
        for _ in range(4):  # insertions stay at the row
            for q in range(4):
                for new in ("user", "assistant"):
                    to = NEXT.get((q, new[0]))
                    for cost, audit, rest in list(found[to]) if to is not None else []:
                        if audit.count("I") < n + 4:
                            found[q].append((cost + 3, "I" + audit, [(new, ""), *rest]))
            found = {q: sorted(f, key=lambda x: x[:2])[:1] for q, f in found.items()}
        for q in range(4):
            best[i, q] = found[q][0]
    return best[0, 0]


def brute(rows):
    conversations = defaultdict(list)
    for conv, *_ in rows:
        conversations[conv] = []
    for conv, *row in brute_damage(rows):
        conversations[conv].append(row)
    for conv, found in conversations.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in found:
            end = text.rstrip(WHITE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else None if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
        known = [t for t, _, _ in found if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, fixed = brute_edits([tuple(r[1:]) for r in found], faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        yield (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)


def awkward():
    rng, rows = random.Random(3), []
    texts = ["Yes.", "no", "", " \n", "Why?", "x!", "tail . ", "á", None, "..", "Yes."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "Ärzte"]
    for conv in [*range(40), None]:
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(roles), rng.choice(texts), "clash", 1, 2))
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t}.", None, None, None) for t in range(800)]
    rows += [(101, t, "user", "again", None, None, None) for t in range(300)]
    rows += [(200 + c, t, r, x, None, None, None) for c in range(30) for t, (r, x) in enumerate([("system", "S."), ("user", "a?"), ("assistant", "b.")])]
    return rows + rows[:5]


def save(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    return str(path)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force_on_awkward_rows(spark, tmp_path):
    rows = awkward()
    assert as_rows(op13_conversation_repair(spark, save(spark, tmp_path, rows))) == sorted(brute(rows), key=repr)


def test_query_equals_brute_force_on_the_test_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(op13_conversation_repair(spark, sf_dir)) == sorted(brute(rows), key=repr)


def test_conversations_longer_than_a_segment(spark, tmp_path):
    long = "w" * (SEGMENT_CHARS * 2 // 3)
    rows = [(1, t, ("assistant", "user")[t % 2], f"{long}{t // 2}{end}", None, None, None) for t, end in enumerate(["", ".", "!", " ", "?", "."])]
    rows += [(2, 0, "user", "short.", None, None, None)]
    assert as_rows(op13_conversation_repair(spark, save(spark, tmp_path, rows))) == sorted(brute(rows), key=repr)
    found = repair(spark.createDataFrame(rows, SCHEMA)).where("conv_id = 1").orderBy("segment").collect()
    assert len(found) > 2 and [r["segment"] for r in found] == list(range(len(found)))


def test_edits_of_all_short_signatures(spark):
    from itertools import product

    symbols = "suaoSUAO-"
    signatures = ["".join(s) for n in range(4) for s in product(symbols, repeat=n)]
    frame = spark.createDataFrame([(s,) for s in signatures], "signature string").unionAll(spark.createDataFrame([("ua",)], "signature string"))
    got = {r["signature"]: (r["cost"], r["edits"]) for r in cheapest_edits(frame).collect()}
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "-": "user"}
    for s in signatures:
        faults = ["blank" if c == "-" else "truncated" if c.isupper() else None for c in s]
        assert got[s] == brute_edits([(names[c.lower()], "") for c in s], faults)[:2], s
    assert len(got) == len(signatures)


def test_a_long_signature_needs_no_recursion(spark):
    frame = spark.createDataFrame([("ua" * 100_000,), ("a" + "ua" * 100_000,), ("",)], "signature string")
    got = {len(r["signature"]): (r["cost"], r["edits"]) for r in cheapest_edits(frame).collect()}
    assert got[200_000] == (0, "K" * 200_000) and got[200_001] == (3, "I" + "K" * 200_001) and got[0] == (0, "")


def test_empty_table(spark, tmp_path):
    assert op13_conversation_repair(spark, save(spark, tmp_path, [])).count() == 0
    assert damaged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_ids_and_texts_are_one_space(spark):
    rows = [(None, None, None, None)] + [(None, t, None, None) for t in range(60)]
    got = damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert as_rows(got) == sorted(brute_damage(rows), key=repr)
    assert got.where(F.col("text").isNull() | F.col("role").isNull()).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_order_of_rows_does_not_matter(spark, tmp_path, order):
    rows = awkward()[::order]
    got = as_rows(op13_conversation_repair(spark, save(spark, tmp_path, rows)))
    assert got == sorted(brute(rows), key=repr)
