"""Line-first quality rules, in DataFrame expressions alone.

Each line is judged first: it fails if it does not end like a sentence, reads like a menu or decoration, shouts, holds a
boilerplate phrase, or repeats an earlier line. Failing lines are removed; a document is rejected if too small a part of
its text stays, if it is too short, or if its own words repeat too much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters and phrases of the line rules.
SYMBOLS = "#*$%&|<>"
CLOSING = r"""[.!?…:;]["'”’»)\]]*$"""
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "terms of use",
)
WHITE = " \t\n\x0b\f\r"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row: lambda variables are bound, columns may be inlined."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Runs of characters other than space and the control characters 9 to 13."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def joined_length(words: Column) -> Column:
    """Characters of the words together."""
    return F.length(F.concat_ws("", words))


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, its first occurrence included.

    Windows are told apart by 64-bit hashes. Most texts repeat none, which the number of distinct hashes shows; in the
    others hashes are sorted with their positions, so the work per text is n log n.
    """

    def positions(ordered: Column) -> Column:
        # A window repeats if a neighbour in hash order has its hash.
        def at(j: Column) -> Column:
            here = F.get(ordered, j)
            same = F.get(ordered, j - 1)["h"].eqNullSafe(here["h"]) | F.get(ordered, j + 1)["h"].eqNullSafe(here["h"])
            return F.when(same, here["i"])

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(ordered) - 1), at), lambda p: p.isNotNull())

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("total"))

        def add(acc: Column, p: Column) -> Column:
            return F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total"))

        return F.aggregate(F.sort_array(places), start, add, lambda acc: acc["total"])

    def count(windows: Column) -> Column:
        placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        none = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(none, F.lit(0).cast("bigint")).otherwise(covered(let(F.sort_array(placed), positions)))

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    windows = let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(let(windows, count))


def blank(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(WHITE))) == 0


def line_fails(line: Column) -> Column:
    """Name of the first rule a line fails, or null. A line without a word passes: there is nothing to remove."""
    n_words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    symbols = F.regexp_count(line, F.lit(f"[{SYMBOLS}]"))
    marks = F.regexp_count(line, F.lit("[!?]"))
    noisy = line.rlike(f"[{SYMBOLS}!?]")

    def phrase(lower: Column) -> Column:
        found = F.lit(False)
        for p in BOILERPLATE:
            found = found | F.contains(lower, F.lit(p))
        return found

    # The end of the line decides; a long line that holds sentences may be cut short.
    closed = F.right(F.rtrim(line, F.lit(WHITE)), F.lit(4)).rlike(CLOSING)
    sentences = (F.contains(line, F.lit(". ")) | F.contains(line, F.lit(", "))) & (n_words >= 12)
    return (
        F.when(noisy & (symbols * 10 >= n_words * 3), "navigation")
        .when(noisy & (n_words >= 3) & (marks * 10 >= n_words * 5), "punctuation")
        .when(~closed & ~sentences, F.when(~blank(line), "punctuation"))
        .when(let(F.lower(line), phrase), "boilerplate")
    )


def quality(docs: DataFrame, least_words: int = 50, least_share: float = 0.5) -> DataFrame:
    """Judge and clean every whole text.

    Returns one row per input row: row (all its columns), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than ``least_words`` words, or more than half of them in repeated three-word windows),
    kept_share (word characters on passing lines), kept, and cleaned (the passing lines).

    Null or empty text: no words, base_failed, cleaned empty. A text is one row's work whatever its length; equal rows
    are judged alike. Columns of any name are kept inside ``row``; an empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    lines = F.filter(F.split("text", "\n"), lambda x: ~blank(x))

    def counted(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            joined_length(words).cast("bigint").alias("word_chars"),
            repeated_window_words(words).alias("n_repeat_words"),
        )

    def judged(full: Column) -> Column:
        def clean(once: Column) -> Column:
            good = F.filter(once, lambda x: line_fails(x).isNull())
            return F.struct(F.size(once).alias("n_once"), F.size(full).alias("n_full"), good.alias("good"))

        return let(F.array_distinct(full), clean)

    found = rows.select(
        "row",
        let(words_of(F.col("text")), counted).alias("w"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("bigint").alias("n_symbols"),
        let(lines, judged).alias("l"),
    )
    base = (F.col("w.n_words") < least_words) | (100 * F.col("w.n_repeat_words") > 50 * F.col("w.n_words"))
    # Nothing is counted again where no line was lost.
    stays = F.when(F.size("l.good") == F.col("l.n_full"), F.col("w.word_chars")).otherwise(joined_length(words_of(F.concat_ws("\n", "l.good"))))
    share = F.when(F.col("w.word_chars") > 0, stays / F.col("w.word_chars")).otherwise(0.0)
    return found.select(
        "row",
        "w.n_words",
        "w.word_chars",
        "n_symbols",
        (F.col("l.n_full") - F.col("l.n_once")).cast("bigint").alias("n_dup_lines"),
        "w.n_repeat_words",
        base.alias("base_failed"),
        share.alias("kept_share"),
        (~base & (share >= least_share)).alias("kept"),
        F.concat_ws("\n", "l.good").alias("cleaned"),
    )


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract view: base counts and the verdict for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_share"
    )


#: The contract view in DuckDB's SQL: words and lines are unnested and counted.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x09-\x0D ]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
nrep AS (SELECT r, count(DISTINCT p) AS n FROM rep GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT r, line, count(*) AS c FROM l WHERE regexp_matches(line, '[^\x09-\x0D ]') GROUP BY r, line),
f AS (SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS n,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS s, length(regexp_replace(line, '[^!?]', '', 'g')) AS m,
  right(regexp_replace(line, '[\x09-\x0D ]+$', ''), 4) AS e FROM u),
j AS (SELECT r, c, length(regexp_replace(line, '[\x09-\x0D ]', '', 'g')) AS chars,
  NOT (s * 10 >= n * 3 OR (n >= 3 AND m * 10 >= n * 5)
   OR NOT (regexp_matches(e, '[.!?…:;]["''”’»)\]]*$') OR (n >= 12 AND (contains(line, '. ') OR contains(line, ', '))))
   OR regexp_matches(lower(line), 'BOILERPLATE')) AS good FROM f),
p AS (SELECT r, sum(c - 1) AS dup, sum(CASE WHEN good THEN chars ELSE 0 END) AS stays FROM j GROUP BY r),
b AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x09-\x0D ]', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(nrep.n, 0) AS n_repeat_words,
  coalesce(stays, 0) AS stays FROM w LEFT JOIN nrep ON nrep.r = w.r LEFT JOIN p ON p.r = w.r),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN stays / word_chars::DOUBLE ELSE 0.0 END AS kept_share FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
 n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
 NOT base_failed AND kept_share >= 0.5 AS kept, kept_share FROM v
""".replace("BOILERPLATE", "|".join(BOILERPLATE))
