"""How far the sources of a language differ, term by term, by products of one-hot levels.

A source gives a term a price that depends on nothing but the term's count there, its *level*. Two sources are compared
through their joint table: how many terms have level a in one and b in the other. With one indicator column per (source,
level), all joint tables are the product of that matrix with its own transpose. Terms are dealt into blocks of like
frequency, so that few levels meet in a block; a block multiplies its rows exactly, prices its joint tables and returns
one number per pair of sources. Sums over blocks are exact, since pricing is linear in the tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.exchange import written

#: Terms in fewer documents of a language are left out.
LEAST_DOCS = 10
#: Terms listed per source.
TOP_TERMS = 10
#: Price of certainty.
UNIT = 1_000_000_000
#: Distinct terms a task counts before it hands its counts on, bytes it splits at a time.
HELD_TERMS, SPLIT_BYTES = 200_000, 1 << 24
#: Counts of a term in a source that meet in one block; sources multiplied at a time.
BLOCK_CELLS, TILE = 65_536, 32
#: Joint tables of at most so many fields are multiplied as dense matrices.
DENSE_FIELDS = 1 << 16

#: Term characters (letters of ASCII, lower-cased, and all bytes beyond ASCII) stay; all else parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length."""
    at = 0
    while at < len(data):
        stop = at + SPLIT_BYTES
        part = data[at:stop].translate(_TERM_BYTES)
        while stop < len(data) and part[-1] != 32:  # never cut a term
            more = data[stop : stop + SPLIT_BYTES].translate(_TERM_BYTES)
            cut = more.find(b" ") + 1 or len(more)
            part, stop = part + more[:cut], stop + cut
        yield part.split()
        at = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and document counts per (lang, source, term); a row without term says that the source exists."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (counts, documents) in held.items():
            n = len(counts) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    pa.array([source] * n, pa.string()),
                    pa.array([None, *counts], pa.binary()),
                    pa.array([0, *counts.values()], pa.int64()),
                    pa.array([0, *(documents[t] for t in counts)], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts, documents = held.setdefault((lang, source), (Counter(), Counter()))
            distinct: set[bytes] = set()
            for terms in terms_of(text):
                counts.update(terms)
                distinct.update(terms)
            documents.update(distinct)
        if sum(len(c) for c, _ in held.values()) > HELD_TERMS:
            yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(lang, source, term, n, total, first)``: counts of kept terms per source, of the language in ``total``; ``first``
    marks one row per (lang, term). Every source has one more row without a term."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    partial = rows.select("lang", "source", F.col("text").cast("binary")).mapInArrow(
        _counted, "lang string, source string, term binary, n bigint, docs bigint"
    )
    counts = partial.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    term = Window.partitionBy("lang", "term")
    return (
        counts.withColumns(
            {"in_lang": F.sum("docs").over(term), "total": F.sum("n").over(term), "first": F.min("source").over(term) == F.col("source")}
        )
        .where(F.col("term").isNull() | (F.col("in_lang") >= least_docs))
        .select("lang", "source", "term", "n", "total", "first")
    )


def _prices(counts: np.ndarray, n: int, kept: int) -> np.ndarray:
    """Price of each count, in whole numbers of any size."""
    return np.array([1 + UNIT * (int(c) + 2) // (n + 2 * kept) for c in counts], np.int64)


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def joint_tables(left: np.ndarray, right: np.ndarray, widths: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Product of two one-hot matrices, as the fields that are not zero: left column, right column, number of rows.

    ``left`` and ``right`` hold one indicator column per row and source; ``widths`` are the numbers of columns.
    """
    rows, fields = len(left), widths[0] * widths[1]
    if fields <= DENSE_FIELDS and rows < 1 << 24:  # exact in single precision
        ones = []
        for columns, width in ((left, widths[0]), (right, widths[1])):
            one = np.zeros((rows, width), np.float32)
            one[np.arange(rows)[:, None], columns] = 1
            ones.append(one)
        table = ones[0].T @ ones[1]
        a, b = np.nonzero(table)
        return a, b, table[a, b].astype(np.int64)
    # Too many levels for a dense table: the same product, field by field.
    found = []
    for column in left.T:
        found.append(np.unique(column[:, None] * np.int64(widths[1]) + right, return_counts=True))
    keys, n = (np.concatenate(x) for x in zip(*found, strict=True))
    return keys // widths[1], keys % widths[1], n


def _levels(cell_source, cell_row, cell_n, sources, rows, of):
    """Indicator column per (row, source) of a tile, and source and price of each column. Level 0: the term is absent."""
    columns = np.empty((rows, len(sources)), np.int64)
    owner, price, width = [], [], 0
    for i, s in enumerate(sources):
        mine = cell_source == s
        levels, code = np.unique(np.concatenate([[0], cell_n[mine]]), return_inverse=True)
        columns[:, i] = width + code[0]
        columns[cell_row[mine], i] = width + code[1:]
        owner.append(np.full(len(levels), i))
        price.append(_prices(levels, *of[s]))
        width += len(levels)
    return columns, np.concatenate(owner), np.concatenate(price)


def _pair_sums(cells: tuple[np.ndarray, ...], n_terms: int, of: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Summed gain of every pair of sources over the terms of a block."""
    source, term, n = cells
    for lo in range(0, len(of), TILE):
        for hi in range(lo, len(of), TILE):
            tiles = [np.arange(x, min(x + TILE, len(of))) for x in (lo, hi)]
            here = np.isin(source, np.concatenate(tiles))
            present, row = np.unique(term[here], return_inverse=True)
            sides = [_levels(source[here], row, n[here], t, len(present), of) for t in tiles]
            total = np.zeros((len(tiles[0]), len(tiles[1])), np.int64)
            if len(present):
                a, b, count = joint_tables(sides[0][0], sides[1][0], (len(sides[0][1]), len(sides[1][1])))
                np.add.at(total, (sides[0][1][a], sides[1][1][b]), count * _gain(sides[0][2][a], sides[1][2][b]))
            # Terms that neither tile has are at level 0 everywhere.
            none = [np.concatenate([_prices(np.zeros(1), *of[s]) for s in t]) for t in tiles]
            total += (n_terms - len(present)) * _gain(none[0][:, None], none[1][None, :])
            i, j = np.nonzero(tiles[0][:, None] < tiles[1][None, :])
            yield tiles[0][i], tiles[1][j], total[i, j]


_BLOCK = pa.schema([("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _block(key, block):
    """One block: partial sums per pair of sources, and the best terms of each source."""
    about = block.filter(pc.is_null(block.column("term")))
    cells = block.filter(pc.is_valid(block.column("term")))
    names = about.column("source").to_pylist()
    sizes, kept, in_lang = (about.column(c).to_pylist() for c in ("n", "kept", "lang_n"))
    number = {s: i for i, s in enumerate(names)}
    source = np.array([number[s] for s in cells.column("source").to_pylist()], np.int64)
    texts = cells.column("term").to_pylist()
    terms = sorted(set(texts), key=str.encode)
    place = {t: i for i, t in enumerate(terms)}
    term = np.array([place[t] for t in texts], np.int64)
    n = np.asarray(cells.column("n"), np.int64)

    of = list(zip(sizes, kept, strict=True))
    out = [pa.table({"source": [], "part": [], "item": [], "value": []}, schema=_BLOCK)]
    for a, b, value in _pair_sums((source, term, n), len(terms), of):
        out.append(pa.table([pa.array([names[i] for i in a]), pa.array(["pair"] * len(a)), pa.array([names[i] for i in b]), pa.array(value)], schema=_BLOCK))

    total = np.zeros(len(terms), np.int64)
    np.add.at(total, term, n)
    p, q = np.empty(len(n), np.int64), _prices(total, in_lang[0], kept[0])[term]
    for s in np.unique(source):
        mine = source == s
        p[mine] = _prices(n[mine], *of[s])
    value = _gain(p, q)
    order = np.lexsort((term, -value, source))
    order = order[(p > q)[order]]
    at = np.flatnonzero(np.concatenate([[True], source[order][1:] != source[order][:-1]])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(at, np.diff(np.concatenate([at, [len(order)]])))
    best = order[rank < TOP_TERMS]
    out.append(pa.table([pa.array([names[i] for i in source[best]]), pa.array(["term"] * len(best)), pa.array([terms[i] for i in term[best]]), pa.array(value[best])], schema=_BLOCK))
    found = pa.concat_tables(out)
    return found.add_column(0, "lang", pa.array([key[0].as_py()] * found.num_rows, pa.string()))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of documents (lang, source, text): each source against every other of
    its language (part ``pair``), and the terms it uses most beyond the language's measure (part ``term``, to rank 10).

    Terms are runs of letters and of characters beyond ASCII, only A-Z lower-cased. Null lang, source or text: empty; an
    empty lang or source is a group like any other, a group without terms takes part at level 0. Repeated rows count as
    documents of their own. Ties of value rank by item, in UTF-8 order. Extra columns are ignored; an empty table gives none.

    A frequent term or a large source costs a row per task that counts it. Blocks hold BLOCK_CELLS counts, or all
    those of one term, and one row per source of their language. Pairs of sources are as many as the result has.
    """
    counts = written(term_counts(docs, least_docs))
    real = F.col("term").isNotNull()
    # Tables of one row per source, or per language and power of two: written, so that joins know their size.
    per_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("all"), F.sum(F.when(real, F.col("n"))).alias("n"), F.count_if(real & F.col("first")).alias("first"))
    lang = Window.partitionBy("lang")
    sources = written(
        per_source.select(
            "lang",
            "source",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.sum("first").over(lang).alias("kept"),
            F.coalesce(F.sum("n").over(lang), F.lit(0)).alias("lang_n"),
        )
    )
    cells = counts.where(real).select("lang", "source", "term", "n", F.floor(F.log2("total")).cast("int").alias("power"))
    sizes = written(cells.groupBy("lang", "power").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CELLS).cast("int").alias("parts")))
    cells = cells.join(sizes, ["lang", "power"]).select("*", F.pmod(F.xxhash64("term"), "parts").cast("int").alias("block")).drop("parts")
    blocks = sizes.select("lang", "power", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    about = blocks.join(sources, "lang")
    rows = cells.unionByName(about, allowMissingColumns=True).select("lang", "power", "block", "source", "term", "n", "kept", "lang_n")
    priced = rows.groupBy("lang", "power", "block").applyInArrow(
        _block, "lang string, source string, part string, item string, value bigint"
    )
    priced = written(priced)

    other = sources.select("lang", F.col("source").alias("item"))
    every = sources.select("lang", "source").join(other, "lang").where("source != item")
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", both.alias("two"), "value").select("lang", "two.source", "two.item", "value")
    pairs = every.join(pairs, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    terms = priced.where("part = 'term'").select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract view: all documents."""
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP11_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce("text", ''), '{_UPPER}', '{_UPPER.lower()}') AS body FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lm AS (SELECT lang, term, v, sum(n) AS n FROM m GROUP BY ALL),
p AS (SELECT *, 1 + ({UNIT} * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM m),
q AS (SELECT *, 1 + ({UNIT} * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM lm),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0) AS value
  FROM g JOIN g o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
  ON s.lang = g.lang AND s.source = g.source AND s.item = o.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang,
  source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
