"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams predicts whether the text's
language has it. The classifiers are log-odds of n-gram rates, learned in one pass over all labelled documents from
counts by language. A text's margins (mean log-odds per n-gram, in units of each classifier's typical margin) are
decoded to the codeword with the least weighted loss; a small gap to the next codeword marks the text ambiguous.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.arrays import U, mix, powers

#: Hashed n-grams per order; a model holds 3 * 4096 weights per bit and language, whatever the corpus.
BINS = 1 << 12
ORDERS = (2, 3, 4)
#: Texts are cut into tiles of so many bytes for counting, so memory does not follow the longest text.
TILE = 1 << 18
#: Features travel in slices of this size.
SLICE = 1 << 10
#: N-gram shares are summed as whole numbers of this fraction.
SHARE = 1 << 30
#: Most languages a model takes; their counts travel to the driver (96 KB each).
MAX_LANGUAGES = 300
SHARPNESS = 4.0
AMBIGUOUS = 0.5
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


#: ASCII characters that are no letters count as a space.
FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def _folded(text: str) -> bytes:
    return b" " + text.lower().encode().translate(FOLD) + b" "


def profiles(texts: list[str]) -> np.ndarray:
    """Counts of hashed byte n-grams of each text; runs of text are counted tile by tile."""
    out = np.zeros((len(texts), len(ORDERS) * BINS), np.float32)
    data = [_folded(t) for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    base = powers(0, 8)[0]
    for left in range(0, len(raw), TILE):
        tile = raw[left : left + TILE + ORDERS[-1]].astype(U)
        n = min(TILE, len(raw) - left)
        rows = doc[left : left + n]
        low = int(rows[0])
        height = int(rows[-1]) - low + 1
        value = np.zeros(n, U)
        for k in range(ORDERS[-1]):
            part = tile[k : k + n]
            value[: len(part)] += (part + U(1)) * base[k]
            if k + 1 in ORDERS:
                inside = np.arange(left, left + n) + k < ends[left : left + n]
                bin_ = (mix(value) & U(BINS - 1)).astype(np.int64) + ORDERS.index(k + 1) * BINS
                # Dense counts for a few texts at a time.
                for r in range(0, height, 64):
                    a, b = np.searchsorted(rows, (low + r, low + min(r + 64, height)))
                    use = inside[a:b]
                    flat = (rows[a:b][use] - low - r) * (len(ORDERS) * BINS) + bin_[a:b][use]
                    span = min(64, height - r)
                    out[low + r : low + r + span] += np.bincount(flat, minlength=span * out.shape[1]).reshape(span, -1)
    return out


def codewords(count: int) -> np.ndarray:
    """Codewords of +1 and -1: exhaustive for few languages, else seeded random ones kept far apart."""
    if count == 1:
        return np.ones((1, 1), np.int8)
    if count <= 6:
        bits = np.arange(1, 2 ** (count - 1))
        return np.stack([np.ones(len(bits), np.int8)] + [np.where(bits >> i & 1, -1, 1).astype(np.int8) for i in range(count - 1)])
    width = math.ceil(10 * math.log2(count))
    best, gap = None, -1
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.int8), size=(count, width))
        code[:, np.abs(code.sum(axis=0)) == count] *= np.where(np.arange(count) % 2, 1, -1)[:, None].astype(np.int8)
        same = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(same, -width)
        if width - same.max() > gap:
            best, gap = code, width - same.max()
    return best


def slices(batch: pa.RecordBatch, rows: int = 128):
    """A batch in parts of a few rows, so that few texts are Python strings at a time."""
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _count_by_language(batches):
    """Per language and slice of features the sum of its documents' n-gram shares, as whole numbers, so that the sum
    does not depend on the order of rows. Every document weighs alike, whatever its length."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch):
            texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
            rows = profiles(texts)
            shares = np.rint(rows / np.maximum(rows.sum(axis=1, keepdims=True), 1) * SHARE).astype(np.int64)
            mine = np.array(langs)
            for lang in set(langs):
                total = shares[mine == lang].sum(axis=0)
                totals[lang] = totals[lang] + total if lang in totals else total
    for lang, total in totals.items():
        pieces = total.reshape(-1, SLICE)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(pieces)), pa.array(range(len(pieces)), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())],
            ["lang", "slice", "sums"],
        )


def _added(key, group):
    total = np.zeros(SLICE, np.int64)
    for x in group.column("sums"):
        total += np.frombuffer(x.as_py(), np.int64)
    return pa.table({"lang": [key[0].as_py()], "slice": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


class Model:
    """Languages, codewords, and per bit: feature weights, threshold, typical margin and trust."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, middle: np.ndarray, scale: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.middle, self.scale, self.trust = languages, code, weights, middle, scale, trust


def train(labelled: DataFrame) -> Model:
    """Learn from all rows of ``labelled`` (text, lang); rows that lack either are left out.

    Tasks send one vector of 12,288 counts per language; the driver gets one per language (at most MAX_LANGUAGES).
    """
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    schema = "lang string, slice int, sums binary"
    parts = rows.mapInArrow(_count_by_language, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(256)))
    parts = parts.groupBy("lang", "slice", "salt").applyInArrow(_added, schema).groupBy("lang", "slice").applyInArrow(_added, schema)
    found: dict[str, list] = {}
    for r in parts.limit((MAX_LANGUAGES + 1) * len(ORDERS) * BINS // SLICE).collect():
        found.setdefault(r.lang, []).append((r.slice, np.frombuffer(r.sums, np.int64)))
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return fit({lang: np.concatenate([x for _, x in sorted(v, key=lambda p: p[0])]) for lang, v in found.items()})


def fit(sums: dict[str, np.ndarray]) -> Model:
    """Classifiers from each language's n-gram shares."""
    names = sorted(sums)
    features = len(ORDERS) * BINS
    if not names:
        return Model([], np.ones((0, 1), np.int8), np.zeros((features, 1), np.float32), np.zeros(1), np.ones(1), np.ones(1))
    code = codewords(len(names))
    share = np.stack([sums[n] for n in names]).astype(np.float64).reshape(len(names), len(ORDERS), BINS)
    share += (share.sum(axis=2, keepdims=True) + 1) * 0.1 / BINS
    share = (share / share.sum(axis=(1, 2), keepdims=True)).reshape(len(names), features)
    columns = []
    for bit in code.T:
        plus, minus = share[bit > 0], share[bit < 0]
        if not len(minus):
            columns.append((np.zeros(features), -1.0, 1.0, 1.0))
            continue
        w = np.log(plus.mean(axis=0)) - np.log(minus.mean(axis=0))
        margin = share @ w
        low, high = margin[bit > 0].min(), margin[bit < 0].max()
        gap = max((low - high) / 2, 1e-4)
        # A classifier whose sides lie far apart for its spread is trusted more.
        columns.append((w, (low + high) / 2, gap, gap / np.abs(margin - (low + high) / 2).max()))
    weights, middle, scale, trust = zip(*columns, strict=True)
    return Model(names, code, np.stack(weights, axis=1).astype(np.float32), np.array(middle), np.array(scale), np.array(trust))


def decode(model: Model, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Languages by falling share of belief, and the shares, for each row of n-gram counts."""
    margin = (counts @ model.weights / np.maximum(counts.sum(axis=1, keepdims=True), 1) - model.middle) / model.scale
    agree = np.clip(margin[:, None, :] * model.code[None].astype(np.float64), -15, 15)
    loss = np.log1p(np.exp(-2 * agree)) @ (model.trust / model.trust.sum())
    belief = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
    belief /= belief.sum(axis=1, keepdims=True)
    order = np.argsort(-belief, axis=1, kind="stable")
    return order, np.take_along_axis(belief, order, axis=1)


def _predict(model: Model):
    def step(batches):
        for batch in batches:
            for part in slices(batch):
                yield judged(part)

    def judged(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column(0).field("text").to_pylist()
        lang, second, score = [UNDETERMINED] * len(texts), [None] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model.languages else []
        if known:
            order, belief = decode(model, profiles([texts[i] for i in known]))
            for i, o, b in zip(known, order, belief, strict=True):
                lang[i], score[i] = model.languages[o[0]], b[0]
                second[i] = model.languages[o[1]] if len(o) > 1 else None
        columns = [part.column(0), pa.array(lang), pa.array(score), pa.array(second, pa.string()), pa.array(score < AMBIGUOUS)]
        return pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score", "second", "ambiguous"])

    return step


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Predict the language of every whole text.

    Returns one row per input row: row (all its columns), lang_pred, score (belief, 0 to 1), second (the runner-up)
    and ambiguous (belief under one half). Only the text is looked at.

    Null text, text without a letter, or a model that learned from no row: ``und`` with score 0 and ambiguous. Long
    texts are counted tile by tile. Repeated rows are predicted alike; columns of any name are kept inside ``row``.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([*rows.schema.fields])
    for name, kind in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("second", T.StringType()), ("ambiguous", T.BooleanType())):
        schema.add(name, kind)
    return rows.mapInArrow(_predict(model), schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract view: learns where crc32(doc_id) mod 4 is not 2, predicts everywhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = train(docs.where(~held_out).select("text", "lang"))
    out = identify(docs.select("doc_id", "text").withColumn("held_out", held_out).select("doc_id", "text", "held_out"), model)
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score", "second", "ambiguous")
