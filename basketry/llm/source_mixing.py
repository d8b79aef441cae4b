"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, passed through again where its target is above its size. A document
is finished, in virtual time, when its queue has sent so many words, divided by the queue's target. All queues sorted
by virtual finish time are the mix; it is cut at the budget of words. A document across the end of its queue's target
is queued in two pieces, so the cut leaves every source within a few words of its target.

Running sums over a source, or over the mix, are taken in ranges: rows fall into ranges by their place (of the shuffle,
or in virtual time), ranges are summed first, and each range is sorted by a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.exchange import written

#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: A document is used at most so often.
MOST_PASSES = 3
#: Rows of a range on average, ranges that are summed at a time.
RANGE_ROWS, RANGES_AT_ONCE = 8192, 1024


def words(text: Column) -> Column:
    """Number of runs of anything but white space (blank, tab, line breaks, vertical tab, form feed)."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, " +"))).cast("bigint")


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, budget: int | None = None) -> DataFrame:
    """``(queue, source, source_size, rows, target)`` from ``(source, source_size, rows)``, one row per source.

    Queues are numbered by source (UTF-8 order, null last) and weigh ``weights`` in turn. They share the budget (all
    words, if not given); no target is above ``most`` times its source, and what that leaves goes to the others by weight.
    The sources, one row each, are sorted in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    every = Window.partitionBy()
    queues = sizes.withColumn("queue", F.row_number().over(order) - 1)
    queues = queues.withColumns(
        {
            "weight": F.element_at(turn, (F.col("queue") % len(weights) + 1).cast("int")).cast("bigint"),
            "cap": F.col("source_size") * most,
            "budget": F.sum("source_size").over(every) if budget is None else F.lit(budget).cast("bigint"),
        }
    )
    # In the order of cap by weight, a queue is capped if its share of what the earlier ones leave is above its cap.
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), "queue").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    queues = queues.withColumn("capped", left.cast("double") * F.col("weight") / weight > F.col("cap"))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    share = left.cast("double") * F.col("weight") / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)
    return queues.select("queue", "source", "source_size", "rows", target.alias("target"))


def _before(rows: DataFrame, by: list[str], place: str, weight: str, order: list[str]) -> DataFrame:
    """Add ``before``: the weight of all rows of the group (``by``) that stand earlier, by range ``place``, then ``order``."""
    ranges = rows.groupBy(*by, place).agg(F.sum(weight).alias("held"))
    some = F.floor(F.col(place) / RANGES_AT_ONCE).alias("some")
    far = ranges.groupBy(*by, some).agg(F.sum("held").alias("held"))
    sofar = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    far = far.select(*by, "some", F.coalesce(F.sum("held").over(sofar(*by).orderBy("some")), F.lit(0)).alias("far"))
    near = ranges.select(*by, place, some, F.coalesce(F.sum("held").over(sofar(*by, some).orderBy(place)), F.lit(0)).alias("near"))
    offsets = near.join(far, [*by, "some"]).select(*by, place, (F.col("near") + F.col("far")).alias("offset"))
    within = F.coalesce(F.sum(weight).over(sofar(*by, place).orderBy(*order)), F.lit(0))
    placed = rows.withColumn("within", within).join(offsets, [*by, place])
    return placed.withColumn("before", F.col("within") + F.col("offset")).drop("within", "offset")


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, budget: int | None = None) -> DataFrame:
    """``(row, doc_id, size, queue, source_size, target, before)``: all rows with their place in their shuffled queue.

    The shuffle goes by the MD5 of doc_id, so reruns agree; ties go by doc_id and size, and rows equal in both are alike.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    # Written, so that the join knows its size.
    queues = written(shares(sizes, weights, most, budget))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    first = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    place = F.floor(first * F.ceil(F.col("rows") / RANGE_ROWS) / F.lit(1 << 32))
    named = rows.withColumn("key", key).join(queues.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    named = named.withColumn("place", place).select("row", "doc_id", "size", "queue", "source_size", "target", "key", "place")
    return _before(named, ["queue"], "place", "size", ["key", "doc_id", "size"]).drop("key", "place")


def mix(queue: DataFrame, most: int = MOST_PASSES, budget: int | None = None) -> DataFrame:
    """The mix of ``queued`` rows, in pieces: row, doc_id, queue, pass, first_word, words, finish and position (words of
    the mix before the piece). Pieces of one document that touch are one run of words cut at its source's target.

    Documents without words are never taken. Copies no budget can reach (further behind their target than there are
    sources, as no more than that is left over by rounding) are not sorted.
    """
    share = F.floor("target").cast("bigint")
    sources = queue.groupBy("queue").agg(F.max("target").alias("target"))
    total = F.sum("target") if budget is None else F.lit(budget)
    known = sources.agg(F.struct(F.count(F.lit(1)).alias("sources"), F.round(total).cast("bigint").alias("budget")).alias("s"))
    known = written(known).select("s").scalar()
    last = F.least(F.lit(most - 1), F.floor((share + known["sources"]) / F.col("source_size")))
    passes = F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))
    copies = queue.where("size > 0").withColumn("pass", F.explode(passes))
    begin = F.col("before") + F.col("pass") * F.col("source_size")
    copies = copies.withColumns({"begin": begin, "share": share}).where(F.col("begin") < share + known["sources"])
    end = F.col("begin") + F.col("size")
    whole = F.array(F.struct(F.col("begin").alias("from"), end.alias("to")))
    cut = F.array(F.struct(F.col("begin").alias("from"), F.col("share").alias("to")), F.struct(F.col("share").alias("from"), end.alias("to")))
    across = (F.col("begin") < F.col("share")) & (F.col("share") < end)
    pieces = copies.withColumn("piece", F.explode(F.when(across, cut).otherwise(whole)))
    length = F.col("piece.to") - F.col("piece.from")
    finish = F.try_divide(F.col("piece.to").cast("double"), "target")
    pieces = pieces.select("row", "doc_id", "queue", "pass", "piece.from", (F.col("piece.from") - F.col("begin")).alias("first_word"), length.alias("length"), finish.alias("finish"))
    pieces = written(pieces)
    # Queues send at even pace, so equal stretches of virtual time hold about equally many rows.
    ranges = pieces.agg(F.ceil(F.count(F.lit(1)) / RANGE_ROWS).alias("ranges")).scalar()
    pieces = pieces.withColumn("range", F.floor(F.col("finish") * ranges).cast("bigint")).withColumn("mix", F.lit(0))
    ordered = _before(pieces, ["mix"], "range", "length", ["finish", "queue", "from"])
    taken = F.greatest(F.lit(0), F.least("length", known["budget"] - F.col("before")))
    return ordered.select("row", "doc_id", "queue", "pass", "first_word", taken.alias("words"), "finish", F.col("before").alias("position")).where("words > 0")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, budget: int | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of documents (doc_id, text, source): the words the mix
    takes of it, repeats counted.

    Null text: no words. Rows without source form the last queue. Rows with one doc_id stay apart; equal rows stand next
    to each other in their queue. Empty texts are taken 0 times. Extra columns are ignored; an empty table gives none.
    Texts never travel, only sizes do.
    """
    queue = written(queued(docs, weights, most, budget))
    taken = mix(queue, most, budget).groupBy("row").agg(F.sum("words").alias("taken"))
    out = queue.join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract view: all documents mixed to as many words as they have."""
    return mixed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


OP12_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
  len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS queue FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][(queue % 3 + 1)::INT] AS weight, {MOST_PASSES} * source_size AS cap, sum(source_size) OVER () AS budget FROM s),
c AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, queue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  * weight / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, queue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) > cap AS capped FROM w),
t AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE (budget - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE * weight
  / sum(weight) FILTER (NOT capped) OVER () END AS target, count(*) OVER () AS sources FROM c),
q AS (SELECT d.n, d.doc_id, d.size, t.queue, t.source_size, t.target, floor(t.target)::BIGINT AS share, t.sources, t.budget,
  sum(d.size) OVER (PARTITION BY t.queue ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, before + pass * source_size AS begins FROM q, range({MOST_PASSES}) r(pass) WHERE size > 0),
p AS (SELECT n, queue, target, budget, begins AS f, begins + size AS e FROM o WHERE NOT (begins < share AND share < begins + size)
  UNION ALL SELECT n, queue, target, budget, begins, share FROM o WHERE begins < share AND share < begins + size
  UNION ALL SELECT n, queue, target, budget, share, begins + size FROM o WHERE begins < share AND share < begins + size),
x AS (SELECT n, e - f AS length, budget, sum(e - f) OVER (ORDER BY e / target, queue, f ROWS UNBOUNDED PRECEDING) - (e - f) AS position
  FROM p WHERE target > 0),
k AS (SELECT n, sum(greatest(0, least(length, budget - position))) AS taken FROM x GROUP BY n)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::BIGINT AS taken FROM q LEFT JOIN k ON k.n = q.n"""
