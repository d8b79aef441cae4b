"""Product texts: cleaning, vocabulary, TF-IDF weights, latent components, encoder embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.text import letters_only

SENTINEL = "no_description"

# English stop words.
STOP_WORDS = tuple(
    """a about after again all also an and any are as at be because been before being between both but by can could
did do does doing down during each few for from further had has have having he her here hers him his how i if in into is
it its just me more most my no nor not now of off on once only or other our out over own same she should so some such
than that the their them then there these they this those through to too under until up very was we were what when where
which while who whom why will with would you your""".split()
)


def light_clean(df: DataFrame, text: str) -> DataFrame:
    """H1."""
    return df.withColumn(text, letters_only(F.col(text)))


def words(text: Column, extra_stop_words: Sequence[str] = (), stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """H2: lower-case alphabetic words of two letters or more that are not stop words, in order.

    ``stop_words`` takes the place of the English list; the sentinel of missing texts is always left out.
    """
    stop = F.array(*[F.lit(w.lower()) for w in (*stop_words, SENTINEL, *extra_stop_words)])
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}]+)"), 1)
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))


def normalise_words(docs: DataFrame, key: str, tokens: str, dictionary: DataFrame) -> DataFrame:
    """H3: replace each word by its dictionary form; ``dictionary`` has (surface, lemma), surface unique."""
    flat = docs.select(key, F.posexplode(tokens).alias("position", "surface"))
    return (
        flat.join(dictionary, "surface", "left")
        .groupBy(key)
        .agg(
            F.transform(
                F.sort_array(
                    F.collect_list(F.struct("position", F.coalesce("lemma", "surface").alias("word")))
                ),
                lambda t: t["word"],
            ).alias(tokens)
        )
    )


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """Word n-grams of a token array, ``low`` to ``high`` words long."""
    grams, parts = tokens, []
    for n in range(1, high + 1):
        if n > 1:
            # Each shorter gram but the last, followed by the word after it.
            pairs = F.zip_with(
                F.slice(grams, 1, F.size(tokens) - (n - 1)),
                F.slice(tokens, n, F.size(tokens) - (n - 1)),
                lambda gram, word: F.concat_ws(" ", gram, word),
            )
            grams = F.when(F.size(tokens) >= n, pairs).otherwise(F.array().cast("array<string>"))
        if n >= low:
            parts.append(grams)
    return F.concat(*parts)


def clean_tokens(text: Column) -> Column:
    """Words of a cleaned text; an empty text has none."""
    return F.filter(F.split(text, " "), lambda w: F.length(w) >= 2)


def tfidf_defaults(n_docs: int) -> dict[str, float]:
    """H5: document-frequency floor and vocabulary size by corpus size."""
    n = max(n_docs, 1)
    min_df = max(1, round(0.002 * n)) if n_docs < 5000 else max(5, round(0.001 * n))
    return {"min_df": min_df, "max_df": 0.8, "max_features": 50_000 if n_docs >= 100_000 else 20_000}


#: Characters of the texts that are counted or encoded at a time; counting takes some 40 bytes for each.
CHUNK_CHARS = 2 << 20


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to about CHUNK_CHARS of text; a longer text has a chunk of its own."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_CHARS, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _counted(texts: pa.Array, low: int, high: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of cleaned texts, and per text and n-gram: text, place of the n-gram, count."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    flat, doc = lists.flatten(), np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
    keep = np.asarray(pc.greater_equal(pc.utf8_length(flat), 2))
    words = flat.filter(pa.array(keep)).dictionary_encode()
    doc, word = doc[keep], np.asarray(words.indices, dtype=np.int64)
    single = words.dictionary
    names, code, first = single, word, np.arange(len(word))
    found, offset = [], 0
    for n in range(1, high + 1):
        if n > 1:
            # A longer gram is a shorter one and the word after it, in the same text.
            last = first + n - 1
            inside = last < len(word)
            inside[inside] = doc[first[inside]] == doc[last[inside]]
            first, last, code = first[inside], last[inside], code[inside]
            pairs, code = np.unique(code * len(single) + word[last], return_inverse=True)
            before, after = (np.divmod(pairs, len(single))) if len(single) else (pairs, pairs)
            names = pc.binary_join_element_wise(names.take(pa.array(before)), single.take(pa.array(after)), " ")
        if n >= low:
            found.append((names, code + offset, doc[first]))
            offset += len(names)
    names = pa.concat_arrays([x for x, _, _ in found])
    code, doc = (np.concatenate(x) for x in list(zip(*found, strict=True))[1:])
    keys, count = np.unique(doc * max(len(names), 1) + code, return_counts=True)
    doc, code = np.divmod(keys, max(len(names), 1))
    return names, doc, code, count


def term_totals(docs: DataFrame, text: str, low: int = 1, high: int = 2) -> DataFrame:
    """``(term, df, tf)`` over all documents.

    A document's terms are counted where it is read, and the documents of a chunk are added up before anything travels,
    so a frequent term costs one row per chunk.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 0):
            names, _, code, n = _counted(chunk.column(0), low, high)
            df, tf = np.bincount(code, minlength=len(names)), np.bincount(code, n, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names, pa.array(df, pa.int64()), pa.array(tf, pa.int64())], ["term", "df", "tf"])

    partial = docs.select(text).mapInArrow(count, "term string, df bigint, tf bigint")
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def vocabulary(
    docs: DataFrame,
    key: str,
    text: str,
    n_docs: int,
    min_df: int,
    max_df: float,
    max_features: int,
    low: int = 1,
    high: int = 2,
) -> DataFrame:
    """H4: ``(term, df, tf, term_id)``: terms within the document-frequency bounds, the most frequent
    ``max_features`` of them (ties by term), numbered alphabetically; ``docs`` has one row per document."""
    kept = (
        term_totals(docs, text, low, high)
        .filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
        .orderBy(F.col("tf").desc(), "term")
        .limit(max_features)
    )
    return kept.withColumn("term_id", F.row_number().over(Window.orderBy("term")) - 1)


def tfidf(docs: DataFrame, key: str, text: str, vocab: DataFrame, n_docs: int, low: int = 1, high: int = 2) -> DataFrame:
    """H6, H7: ``(key, term_id, weight)`` with smoothed idf, unit length per document.

    For new documents pass the fitted vocabulary and its document count; unknown terms drop out.  Weights are made
    where the document is read, and nothing is shuffled: the vocabulary, at most ``max_features`` terms, goes to the tasks.
    """
    rows = vocab.select("term", "term_id", "df").collect()
    idf = np.array([np.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0 for r in rows])
    shared = docs.sparkSession.sparkContext.broadcast(([r["term"] for r in rows], np.array([r["term_id"] for r in rows], np.int64), idf))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, ids, scale = shared.value
        known = pa.array(terms, pa.string())
        for chunk in _chunks(batches, 1):
            names, doc, code, n = _counted(chunk.column(1), low, high)
            place = np.asarray(pc.fill_null(pc.index_in(names, value_set=known), -1), dtype=np.int64)[code]
            doc, n, place = doc[place >= 0], n[place >= 0], place[place >= 0]
            weight = n * scale[place] if len(place) else np.zeros(0)
            length = np.sqrt(np.bincount(doc, weight * weight, chunk.num_rows))
            columns = [chunk.column(0).take(pa.array(doc)), pa.array(ids[place] if len(place) else [], pa.int64()), pa.array(weight / length[doc])]
            yield pa.RecordBatch.from_arrays(columns, [key, "term_id", "weight"])

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, term_id bigint, weight double"
    return docs.select(key, text).mapInArrow(weigh, schema)


def tfidf_vectors(
    docs: DataFrame, key: str, text: str, vocab: DataFrame, n_docs: int, low: int = 1, high: int = 2
) -> DataFrame:
    """H6 as one sparse vector per document, without any shuffle of the documents.

    The vocabulary (at most ``max_features`` terms) travels to the driver once.
    """
    terms = vocab.orderBy("term_id").select("term", "df").collect()
    if not terms:
        raise ValueError("empty vocabulary")
    counter = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in terms], inputCol="terms", outputCol="counts"
    )
    idf = Vectors.dense([float(np.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0) for r in terms])
    weigh = ElementwiseProduct(scalingVec=idf, inputCol="counts", outputCol="weighted")
    unit = Normalizer(p=2.0, inputCol="weighted", outputCol="features")
    grams = docs.select(key, ngrams(clean_tokens(F.col(text)), low, high).alias("terms"))
    return unit.transform(weigh.transform(counter.transform(grams))).select(key, "features")


def unit_length(vector: Column) -> Column:
    """Array scaled to length one; a zero array stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def _lists(rows: np.ndarray) -> pa.Array:
    """A matrix as one array of numbers per row."""
    n, size = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(rows.reshape(-1)))


def project(vectors: DataFrame, key: str, basis: np.ndarray, features: str = "features") -> DataFrame:
    """Row vectors times a (size x k) basis, as ``(key, vector)`` arrays, read where they lie in the Arrow batches."""
    shared = vectors.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            out = np.empty((b.num_rows, v.shape[1]))
            for row, idx, val in zip(out, b.column(1), b.column(2), strict=True):
                part = v[idx.values.to_numpy()] if idx.is_valid else v
                np.matmul(val.values.to_numpy(), part, out=row)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(out)], [key, "vector"])

    parts = vectors.select(key, F.unwrap_udt(features).alias("u")).select(
        key, F.col("u.indices").alias("idx"), F.col("u.values").alias("val")
    )
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, vector array<double>"
    return parts.mapInArrow(run, schema)


def svd(vectors: DataFrame, key: str, k: int, features: str = "features", normalise: bool = True):
    """H8: truncated SVD of the (uncentred) rows: projected rows, singular values, right vectors.

    The decomposition runs on the rows where they are; only the (size x k) right vectors travel.
    """
    # The solver reads the rows once per iteration.
    kept = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    rows = MLUtils.convertVectorColumnsFromML(kept.select(features), features)
    result = RowMatrix(rows).computeSVD(k, computeU=False)
    basis = result.V.toArray()
    kept.unpersist()
    out = project(vectors, key, basis, features)
    if normalise:
        out = out.withColumn("vector", unit_length(F.col("vector")))
    return out, result.s.toArray(), basis


# --- encoder embeddings -----------------------------------------------------------------------------

Encoder = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, key: str, text: str, load_encoder: Callable[[], Encoder], normalise: bool = True) -> DataFrame:
    """Embed texts with a caller-supplied encoder, loaded once per Python worker.

    A text is encoded once, in chunks of about CHUNK_CHARS.  (A call in a column would be planned a second time under each
    filter that a later step puts on the vectors, with Python workers of its own.)
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder()
        for chunk in _chunks(batches, 1):
            vectors = np.array(encoder(chunk.column(1).to_pylist()), dtype=float)
            if normalise:
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = np.divide(vectors, norms, out=vectors, where=norms > 0)
            yield pa.RecordBatch.from_arrays([chunk.column(0), _lists(vectors)], [key, "vector"])

    schema = f"{key} {df.schema[key].dataType.simpleString()}, vector array<double>"
    return df.select(key, text).mapInArrow(encode, schema)


def hashing_encoder(size: int = 64) -> Callable[[], Encoder]:
    """Deterministic stand-in for a language model: word counts in hashed positions."""

    def load() -> Encoder:
        from hashlib import md5

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size))
            for row, t in zip(out, texts):
                for w in t.split(" "):
                    row[int(md5(w.encode()).hexdigest()[:8], 16) % size] += 1
            return out

        return encode

    return load
