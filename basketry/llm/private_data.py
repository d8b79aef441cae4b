"""Personal data by bootstrapped contextual extraction, in DataFrame expressions alone.

Strict patterns find the seeds: mail addresses, IP addresses, card and phone numbers. Every token with a digit or an @
is a candidate, and so is every row of digit groups joined by single spaces and every seed that spans spaces; what stands
around it (the words before, the word behind, a label inside) are its patterns. Spark scores the graph of patterns and
candidate values in rounds: a pattern is trusted by the share of its values that are known, a value by the patterns it stands in. Values of a fitting form in trusted patterns are found to be of the
seeds' kind and join the known ones for the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.exchange import written
from basketry.llm.quality_rules import let

# The seed patterns, in the order that ranks kinds. A match starts where the match before ended or where
# no longer one could have started, which finds the leftmost matches without trying every position of a long run.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Text without the pattern's rarest part needs no search.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
# The first, an inner and the last token of a number written in groups with single spaces.
GROUP = r"\(?[0-9](?:[0-9.()-]*[0-9])?\)?"
LEAD = r"(?:[A-Za-z_.-]+[=:])?"
FIRST, INNER, LAST = rf"^{LEAD}[\"'(<\[]*\+?{GROUP}$", rf"^{GROUP}$", rf"^{GROUP}[\"')>\].,;:!?]*$"
# Digits of a card or phone number: other groups are not joined.
LEAST_DIGITS, MOST_DIGITS = 8, 19
SPAN = "array<struct<kind:string,rank:int,start:int,stop:int,base:boolean>>"
#: Elements of an array that are worked on together: what a step costs within a text.
BLOCK = 256
CANDIDATE = "array<struct<value:string,start:int,stop:int,patterns:array<string>,joined:boolean>>"
SEED = "array<struct<kind:string,rank:int,start:int,stop:int,base:boolean,value:string,patterns:array<string>>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the checksum of a string of digits holds."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, 1).cast("int")
        doubled = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + doubled

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The check a match of ``kind`` must pass."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.right(p, F.lit(3))).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def blocks(values: Column, use) -> Column:
    """``use(block, b)`` of consecutive blocks of an array; its results, one array for each block, in a row."""
    count = F.greatest(F.ceil(F.size(values) / BLOCK).cast("int"), F.lit(1))
    return F.flatten(F.transform(F.sequence(F.lit(0), count - 1), lambda b: use(F.slice(values, b * BLOCK + 1, BLOCK), b)))


def running(values: Column, add) -> Column:
    """For each element of an array of numbers the fold, from 0, of those before it.

    Blocks are folded first, so an element costs half a block and a block the blocks before it; no array grows.
    """
    zero = F.lit(0)

    def folded(values: Column) -> Column:
        def inner(totals: Column) -> Column:
            def of_block(block: Column, b: Column) -> Column:
                earlier = F.aggregate(F.slice(totals, 1, b), zero, add)
                return let(earlier, lambda first: F.transform(block, lambda _, k: F.aggregate(F.slice(block, 1, k), first, add)))

            return blocks(values, of_block)

        return let(blocks(values, lambda block, b: F.array(F.aggregate(block, zero, add))), inner)

    return let(values, folded)


def matched(text: Column, pattern: str, use) -> Column:
    """``use(pieces, matches, starts)`` of the leftmost non-overlapping matches, the texts around them and their places.

    The texts between matches give the positions (code points), so a text is scanned twice and never by position.
    """

    def with_pieces(pieces: Column) -> Column:
        def with_matches(matches: Column) -> Column:
            steps = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))

            def with_ends(before: Column) -> Column:
                starts = F.transform(before, lambda at, i: at + F.length(F.get(pieces, i)))
                return let(starts, lambda starts: use(pieces, matches, starts))

            return let(running(steps, lambda x, y: x + y), with_ends)

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_matches)

    return let(F.split(text, pattern, -1), with_pieces)


def placed(text: Column, pattern: str, make) -> Column:
    """``make(before, match, after, start)`` of every leftmost non-overlapping match; null results are left out."""

    def use(pieces: Column, matches: Column, starts: Column) -> Column:
        return F.transform(matches, lambda m, i: make(F.get(pieces, i), m, F.get(pieces, i + 1), F.get(starts, i)))

    return F.filter(matched(text, pattern, use), lambda x: x.isNotNull())


def around(before: Column, lead: Column, after: Column) -> Column:
    """The patterns of a value: words before it, the word behind it, a label in front."""
    left = F.lower(F.regexp_extract(before, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    two = F.lower(F.regexp_extract(before, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1))
    right = F.lower(F.regexp_extract(after, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1))
    label = F.lower(F.regexp_extract(lead, r"^([A-Za-z_.-]+[=:])", 1))

    patterns = F.array(F.concat(F.lit("left "), left), F.concat(F.lit("left two "), two), F.concat(F.lit("right "), right), F.concat(F.lit("label "), label))
    return F.filter(patterns, lambda p: ~p.endswith(" "))


def base_seeds(text: Column) -> Column:
    """All seeds of a text, by start, then kind; those that span spaces with their value and patterns."""
    found = []
    for rank, (kind, pattern) in enumerate(KINDS.items()):

        def make(before: Column, match: Column, after: Column, start: Column, kind=kind, rank=rank) -> Column:
            spaced = match.contains(" ")
            glued = F.regexp_extract(before, r"[^\x20\x09-\x0D]*$", 0)
            # As with tokens, no word with a digit or @ is a pattern.
            words = around(F.regexp_replace(before, r"[^\x20\x09-\x0D]+$", ""), glued, F.regexp_replace(after, r"^[^\x20\x09-\x0D]+", ""))
            span = F.struct(
                F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"),
                (start + F.length(match)).alias("stop"), F.lit(True).alias("base"),
                F.when(spaced, match).alias("value"), F.when(spaced, F.filter(words, lambda p: ~p.rlike("[0-9@]"))).alias("patterns"),
            )
            return F.when(holds(kind, match), span)

        none = F.array().cast(SEED)
        found.append(F.when(text.rlike(NEEDS[kind]), placed(text, pattern, make).cast(SEED)).otherwise(none))
    return in_order(F.concat(*found), ("value", "patterns"))


def in_order(spans: Column, more: tuple[str, ...] = ()) -> Column:
    def fields(s: Column, *names: str) -> Column:
        return F.struct(*[s[n].alias(n) for n in (*names, *more)])

    keyed = F.transform(spans, lambda s: fields(s, "start", "rank", "stop", "kind", "base"))
    return F.transform(F.sort_array(keyed), lambda s: fields(s, "kind", "rank", "start", "stop", "base"))


def spelled(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def candidates(text: Column) -> Column:
    """Every token with a digit or an @, and every row of digit groups joined by single spaces: value, place and patterns.

    ``joined`` tells rows of groups; ``whole`` is false where a longer candidate holds this one.
    """

    def one(before: Column, match: Column, after: Column, start: Column, joined: bool) -> Column:
        # A row keeps the parenthesis of its area code.
        opening = r"(?:[\"'<\[]|\((?![0-9]+\)))*" if joined else r"[\"'(<\[]*"

        def led(lead: Column) -> Column:
            def made(value: Column) -> Column:
                at = start + F.length(lead)
                return F.when(
                    F.length(value) >= 4,
                    F.struct(
                        value.alias("value"), at.alias("start"), (at + F.length(value)).alias("stop"),
                        around(before, lead, after).alias("patterns"), F.lit(joined).alias("joined"),
                    ),
                )

            return let(F.regexp_replace(F.substring(match, F.length(lead) + 1, F.length(match)), r"[\"')>\].,;:!?]+$", ""), made)

        return let(F.regexp_extract(match, rf"^{LEAD}{opening}", 0), led)

    def at_token(pieces: Column, matches: Column, i: Column, here: Column) -> Column:
        """The candidates that start at a token, the longest first."""
        before, match = F.get(pieces, i), F.get(matches, i)
        single = F.array(one(before, match, F.get(pieces, i + 1), here, False))
        none = F.array().cast(CANDIDATE)

        def follows(j: Column) -> Column:
            return F.coalesce((F.get(pieces, i + j) == " ") & F.get(matches, i + j).rlike(LAST), F.lit(False))

        def extend(acc: Column, j: Column) -> Column:
            def grown(row: Column) -> Column:
                n, goes = F.length(digits(row)), acc["open"] & follows(j)
                longer = F.array(one(before, row, F.get(pieces, i + j + 1), here, True))
                return F.struct(
                    row.alias("row"),
                    (goes & (n < MOST_DIGITS) & F.coalesce(F.get(matches, i + j).rlike(INNER), F.lit(False))).alias("open"),
                    F.when(goes & n.between(LEAST_DIGITS, MOST_DIGITS), F.concat(longer, acc["out"])).otherwise(acc["out"]).alias("out"),
                )

            step = let(F.concat(acc["row"], F.lit(" "), F.coalesce(F.get(matches, i + j), F.lit(""))), grown)
            return F.when(acc["open"] & (F.get(pieces, i + j) == " "), step).otherwise(acc.withField("open", F.lit(False)))

        start = F.struct(match.alias("row"), F.lit(True).alias("open"), none.alias("out"))
        rows = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_DIGITS - 1)), start, extend, lambda acc: acc["out"])
        rows = F.when(follows(F.lit(1)) & match.rlike(FIRST), rows).otherwise(none)
        return F.filter(F.concat(rows, single), lambda x: x.isNotNull())

    def use(pieces: Column, matches: Column, starts: Column) -> Column:
        def marked(found: Column) -> Column:
            def whole(here: Column, i: Column) -> Column:
                # A row of groups ends within this many tokens: no earlier one reaches further.
                near = F.slice(found, F.greatest(i - MOST_DIGITS, F.lit(0)) + 1, F.least(i, F.lit(MOST_DIGITS)))
                reach = F.coalesce(F.array_max(F.transform(near, lambda f: F.get(f, F.lit(0))["stop"])), F.lit(0))
                return let(reach, lambda r: F.transform(here, lambda c, k: c.withField("whole", (k == 0) & (c["stop"] > r))))

            return F.flatten(F.transform(found, whole))

        return let(F.transform(matches, lambda m, i: at_token(pieces, matches, i, F.get(starts, i))), marked)

    return matched(text, TOKEN, use)


def fits(kind: str, value: Column) -> Column:
    """Whether a value without a seed's strict form could still be of its kind."""
    n = F.length(digits(value))
    if kind == "email":
        return value.rlike(r"^[^@]+@[^@]*[A-Za-z][^@]*$")
    if kind == "ip":
        return value.rlike(r"^[0-9]+(?:[.:][0-9]+){3,}[^\x20]*$")
    if kind == "card":
        return n.between(13, 19) & value.rlike(r"^[0-9Xx*.\x20-]+$")
    return n.between(8, 15) & value.rlike(r"^[+(]?[0-9().\x20-]+$")


def discovered(occurrences: DataFrame, rounds: int, trust: float, support: int) -> DataFrame:
    """Values and kinds that the pattern graph finds, from rows of (value, known kind or null, whole, patterns).

    Copies of a text add nothing: a pattern counts distinct values. Candidates inside longer ones can be found, but only
    whole ones count.
    """
    kinds = F.array(*[F.when(F.col("known").eqNullSafe(F.lit(k)) | (F.col("known").isNull() & fits(k, F.col("value"))), F.lit(k)) for k in KINDS])
    edges = written(
        occurrences.select("value", "known", "whole", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value")
        .agg(F.max("known").alias("known"), F.max("whole").alias("whole"))
        .select("pattern", "value", "known", "whole", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))
    )
    # All distinct values of a pattern, of whatever form, are in the denominator.
    size = occurrences.where("whole").select("value", F.explode("patterns").alias("pattern")).distinct().groupBy("pattern").agg(F.count("*").alias("size"))
    found = edges.where(F.lit(False)).select("value", "kind", F.lit(0.0).alias("score"))
    for _ in range(rounds):
        scored = edges.join(found, ["value", "kind"], "left").withColumn(
            "score", F.when(F.col("known").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
        )
        patterns = (
            scored.groupBy("pattern", "kind")
            .agg(F.sum(F.when(F.col("whole"), F.col("score"))).alias("weight"), F.sum(F.col("known").isNotNull().cast("int")).alias("seeds"))
            .join(size, "pattern")
            .where(f"seeds >= {support}")
            .select("pattern", "kind", F.least(F.lit(0.999), F.col("weight") / F.col("size")).alias("confidence"))
        )
        found = written(
            edges.where("known is null")
            .join(patterns, ["pattern", "kind"])
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"), F.max("confidence").alias("best"))
            .where(F.col("best") >= trust)
            .select("value", "kind", "score")
        )
    return found.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def find_private(docs: DataFrame, keep: list[str] | None = None, rounds: int = 3, trust: float = 0.8, support: int = 5) -> DataFrame:
    """Find personal data in every whole text.

    Returns one row per input row: row (the columns named in ``keep``, by default all) and spans (kind, rank, start,
    stop, base), by start, then kind; places are code points, stop is exclusive. Base spans are the strict matches;
    others come from patterns in which at least ``support`` distinct seeds of a kind make up ``trust`` of all values.

    Null or empty text: no spans. Matches that fail their check are dropped without another try. Very long texts are
    searched whole, by expressions that do not recurse. Repeated rows get equal spans and add no weight to a pattern.
    Columns of any name are kept inside ``row``; an empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    columns = docs.columns if keep is None else keep
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(None).cast("string").alias("none"))
    rows = docs.select(text.alias("text"), kept.alias("row"))
    rows = written(
        rows.select("row", base_seeds(F.col("text")).alias("seeds"), candidates(F.col("text")).alias("tokens")).withColumn(
            "place", F.monotonically_increasing_id()
        )
    )

    # A seed that spans spaces is one candidate in place of its tokens; no row of groups crosses a seed.
    def against_seeds(t: Column, near: Column) -> Column:
        def kept(over: Column) -> Column:
            known = F.get(over, F.lit(0))["kind"]
            return F.struct(
                *[t[c].alias(c) for c in ("value", "start", "stop", "patterns")], (t["whole"] | known.isNotNull()).alias("whole"), known.alias("known"),
                ((F.size(over) == 0) | ~(t["joined"] | F.exists(over, lambda s: s["value"].isNotNull()))).alias("stays"),
            )

        return let(F.filter(near, lambda s: (s["start"] < t["stop"]) & (s["stop"] > t["start"])), kept)

    def of_block(block: Column, _: Column) -> Column:
        """Tokens of a block look only at the seeds that touch the block."""
        first, last = F.array_min(F.transform(block, lambda t: t["start"])), F.array_max(F.transform(block, lambda t: t["stop"]))
        ends = F.struct(first.alias("first"), last.alias("last"))
        near = let(ends, lambda e: F.filter("seeds", lambda s: (s["start"] < e["last"]) & (s["stop"] > e["first"])))
        return let(near, lambda near: F.transform(block, lambda t: against_seeds(t, near)))

    def as_candidate(s: Column) -> Column:
        true = F.lit(True)
        return F.struct(*[s[c].alias(c) for c in ("value", "start", "stop", "patterns")], true.alias("whole"), s["kind"].alias("known"), true.alias("stays"))

    spaced = F.transform(F.filter("seeds", lambda s: s["value"].isNotNull()), as_candidate)
    tokens = rows.select("place", F.explode(F.concat(blocks(F.col("tokens"), of_block), spaced)).alias("t")).select("place", "t.*").where("stays")
    new = discovered(tokens.select("value", "known", "whole", "patterns"), rounds, trust, support)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    # Of found values one within another the longest is kept.
    longest_first = Window.partitionBy("place", "kind").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    more = (
        tokens.where("known is null")
        .join(new, "value")
        .withColumn("reach", F.max("stop").over(longest_first))
        .where("reach is null or stop > reach")
        .groupBy("place")
        .agg(F.collect_list(F.struct("kind", rank.alias("rank"), "start", "stop", F.lit(False).alias("base"))).cast(SPAN).alias("more"))
    )
    base = in_order(F.col("seeds"))
    return rows.join(more, "place", "left").select(
        "row", F.when(F.col("more").isNull(), base).otherwise(in_order(F.concat(base, F.coalesce("more", F.array().cast(SPAN))))).alias("spans")
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""

    def use(reach: Column) -> Column:
        ends = F.transform(spans, lambda s, i: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), F.get(reach, i).alias("reach")))

        def of_block(block: Column, _: Column) -> Column:
            first, last = F.get(block, F.lit(0))["reach"], F.get(block, F.size(block) - 1)["start"]

            # Positions are found in the block's part of the text, not in all of it.
            def cut(part: Column) -> Column:
                def one(s: Column) -> Column:
                    clear = F.substring(part, s["reach"] - first + 1, s["start"] - s["reach"])
                    return F.when(s["start"] >= s["reach"], F.concat(clear, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

                return F.transform(block, one)

            return let(F.substring(text, first + 1, F.greatest(last - first, F.lit(0))), cut)

        tail = F.substring(text, F.array_max(F.transform(spans, lambda s: s["stop"])) + 1, F.length(text))
        return F.concat(F.concat_ws("", let(ends, lambda e: blocks(e, of_block))), tail)

    return F.when(F.size(spans) > 0, let(running(F.transform(spans, lambda s: s["stop"]), lambda x, y: F.greatest(x, y)), use)).otherwise(text)


def op7_private_data(spark, sf_dir: str) -> DataFrame:
    """Contract view: seeds by kind, the digest of their spans, and all spans."""
    found = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    return found.select("row.doc_id", *map(count, KINDS), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
