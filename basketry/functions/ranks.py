"""Exact ranks and quantiles that never sort a whole group in one task.

Every function starts from *value counts*: one row per (group, value) with the number of rows that
hold it, made by an ordinary hash aggregation with map-side combine, so a group or a single value
that holds a third of all rows costs no more than any other.  A running count over a huge group is
then cut into value ranges ("buckets").  The cut points are the distinct values whose hash is
divisible by ``CUT_RATE``; they depend on the data alone, so a retried task sees the same cuts, and
groups with few distinct values have none and stay in one piece.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.session import materialised

CUT_RATE = 131_072  # distinct values per bucket, on average


def usable(value: Column) -> Column:
    """Null and NaN both count as missing."""
    return value.isNotNull() & ~F.isnan(value)


def melt(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Long form ``(by…, column, value)`` of numeric columns as doubles, null and NaN dropped."""
    number = {c: F.col(f"`{c}`").cast("double") for c in columns}
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.when(~F.isnan(x), x).alias("value"))
            for c, x in number.items()
        ]
    )
    cells = df.select(*by, F.explode(pairs).alias("cell")).select(*by, "cell.column", "cell.value")
    return cells.filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def running_counts(
    counts: DataFrame,
    by: Sequence[str],
    value: str = "value",
    weight: str = "n",
    cut_rate: int = CUT_RATE,
    few_groups: bool = False,
) -> DataFrame:
    """Add ``below`` (weight of smaller values in the group) and ``total`` (weight of the group).

    ``counts`` has one row per (group, value).  With ``few_groups`` (a constant, the names of columns) the cut points come as
    one value: a join on such a group would deal all its rows to one task, and its buckets with them.
    """
    by = list(by)
    if few_groups:
        # Branches with and without the value of the cut points share no shuffle.
        counts = materialised(counts)
    # The condition reads the weight too, so it stays above the aggregation that made the counts and
    # all branches below share one shuffle.
    cuts = (
        counts.filter(F.when(F.col(weight) > 0, F.pmod(F.xxhash64(value), F.lit(cut_rate))) == 0)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(value)).alias("cuts"))
    )
    bucket = F.size(F.filter("cuts", lambda cut: cut <= F.col(value)))
    if few_groups:
        entries = F.collect_list(F.struct(F.struct(*by).alias("group"), "cuts"))
        known = cuts.agg(F.map_from_entries(entries).alias("m")).scalar()
        placed = counts.withColumn("cuts", F.element_at(known, F.struct(*by)))
    else:
        placed = counts.join(cuts, by, "left")
    cut_up = placed.withColumn("bucket", F.when(F.col("cuts").isNull(), 0).otherwise(bucket)).drop("cuts")
    per_group = Window.partitionBy(*by)
    earlier = per_group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut_up.groupBy(*by, "bucket")
        .agg(F.sum(weight).alias("bucket_weight"))
        .select(
            *by,
            "bucket",
            F.coalesce(F.sum("bucket_weight").over(earlier), F.lit(0)).alias("offset"),
            F.sum("bucket_weight").over(per_group).alias("total"),
        )
    )
    within = (
        Window.partitionBy(*by, "bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut_up.withColumn("inner", F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .join(offsets, [*by, "bucket"])
        .withColumn("below", F.col("offset") + F.col("inner"))
        .drop("bucket", "offset", "inner")
    )


def _quantile(q: float, method: str, value: str) -> Column:
    """Aggregate over a running count that reads the value at a position of the sorted group."""
    position = f"({float(q)!r}D * (total - 1))"

    def pick(at: str) -> str:
        return f"max(CASE WHEN below <= {at} AND {at} < below + n THEN `{value}` END)"

    if method == "nearest":
        return F.expr(pick(f"floor({position} + 0.5D)"))
    if method != "linear":
        raise ValueError(f"unknown quantile method {method!r}")
    low, high = pick(f"floor({position})"), pick(f"ceil({position})")
    return F.expr(f"{low} + ({high} - {low}) * max({position} - floor({position}))")


def quantiles(
    df: DataFrame,
    qs: Mapping[str, float],
    by: Sequence[str],
    value: str = "value",
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles of a long table, one row per group, one column per entry of ``qs``.

    ``linear`` interpolates between neighbours; ``nearest`` returns an existing value.
    """
    ranked = running_counts(value_counts(df.filter(usable(F.col(value).cast("double"))), by, value), by, value)
    return ranked.groupBy(*by).agg(*[_quantile(q, method, value).alias(name) for name, q in qs.items()])


def column_quantiles(
    df: DataFrame, columns: Sequence[str], qs: Mapping[str, float], method: str = "linear"
) -> DataFrame:
    """Exact quantiles of several columns in one plan: one row per column."""
    return quantiles(melt(df, columns), qs, ["column"], method=method)


def quantile_struct(
    df: DataFrame, column: str, qs: Mapping[str, float], method: str = "linear"
) -> Column:
    """Quantiles of one column as a one-row scalar subquery; read fields by name."""
    table = column_quantiles(df, [column], qs, method)
    return table.agg(F.struct(*[F.max(name).alias(name) for name in qs]).alias("s")).scalar()


def quantile_map(
    df: DataFrame, columns: Sequence[str], qs: Mapping[str, float], method: str = "linear"
) -> Column:
    """Quantiles of several columns as one scalar subquery: a map from column name to a struct."""
    entry = F.struct(F.col("column"), F.struct(*qs).alias("s"))
    table = column_quantiles(df, columns, qs, method)
    return table.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def quantile_values(
    df: DataFrame, column: str, qs: Mapping[str, float], method: str = "linear"
) -> dict[str, float | None]:
    """Quantiles of one column as driver values, for use as literals in long expression chains."""
    return exact_quantiles(df, [column], qs, method)[column]


def scalar_struct(df: DataFrame, **aggregates: Column) -> Column:
    """Several global aggregates as one scalar subquery; read fields by name."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("s")).scalar()


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average rank (1-based, ties share the mean) per (column, value)."""
    ranked = running_counts(value_counts(melt(df, columns), ["column"]), ["column"], few_groups=True)
    return ranked.select(
        "column", "value", (F.col("below") + (F.col("n") + 1) / 2).alias("rank")
    )


def dense_ranks(df: DataFrame, column: str) -> DataFrame:
    """``(value, dense_rank, n_distinct)`` of one column over its distinct values."""
    distinct = value_counts(melt(df, [column]), ["column"]).withColumn("n", F.least("n", F.lit(1)))
    return running_counts(distinct, ["column"], few_groups=True).select(
        "value", (F.col("below") + 1).alias("dense_rank"), F.col("total").alias("n_distinct")
    )


#: Size of the sketches that bracket exact quantiles; up to so many values, a sketch is the values themselves.
SKETCH = 4096


def sketch_error(k: int) -> float:
    """Normalised rank error of a sketch of size ``k``, held with 99% confidence for each quantile."""
    return 2.296 / k**0.9723


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], qs: Mapping[str, float], method: str = "linear"
) -> dict[str, dict[str, float | None]]:
    """Exact quantiles of numeric columns as driver values; no row is shuffled.

    A pass counts what lies below a bracket around each wanted position and on its ends, and sketches what lies strictly inside; the sketch gives the next bracket, a hundred times narrower.  Once a bracket holds no more values than a
    sketch keeps, the sketch has the value itself.  A bracket that turns out not to hold its position is opened again, so the
    result never depends on the sketch.
    """
    numbers = df.select(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    counts = [F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))]
    sketches = [F.kll_sketch_agg_double(f"c{i}", F.lit(SKETCH)).alias(f"s{i}") for i in range(len(columns))]
    first = numbers.agg(*counts, *sketches).first()
    places = {}  # (column, quantile): the two positions between which the quantile lies
    for i in range(len(columns)):
        for name, q in qs.items():
            at = float(q) * (first[f"n{i}"] - 1)
            if first[f"n{i}"]:
                places[i, name] = (math.floor(at + 0.5),) * 2 if method == "nearest" else (math.floor(at), math.ceil(at))
    wanted = {(i, p): (bytes(first[f"s{i}"]), first[f"n{i}"], p) for (i, _), ps in places.items() for p in ps}
    value: dict[tuple[int, int], float] = {}  # (column, position)
    brackets = _settled(df.sparkSession, wanted, value)
    while brackets:
        brackets = _narrowed(numbers, brackets, value)
    out: dict[str, dict[str, float | None]] = {c: dict.fromkeys(qs) for c in columns}
    for (i, name), (low, high) in places.items():
        a, b = value[i, low], value[i, high]
        at = float(qs[name]) * (first[f"n{i}"] - 1)
        out[columns[i]][name] = a if a == b or method == "nearest" else a + (b - a) * (at - math.floor(at))
    return out


def _settled(
    spark: SparkSession, wanted: dict[tuple[int, int], tuple[bytes, int, int]], value: dict[tuple[int, int], float]
) -> dict[tuple[int, int], tuple[float, float]]:
    """Read positions off their sketches (sketch, number of values, position): whole sketches give the value, others a
    bracket some rank errors wide."""
    if not wanted:
        return {}
    found = []
    for sketch, n, position in wanted.values():
        slack = 0.0 if n <= SKETCH else 3 * sketch_error(SKETCH)
        at = [min(max((position + 0.5) / n + x, 0.0), 1.0) for x in (-slack, slack)]
        found.append(F.kll_sketch_get_quantile_double(F.lit(sketch), F.array(*map(F.lit, at))))
    row = spark.range(1).select(*[f.alias(f"q{k}") for k, f in enumerate(found)]).first()
    left = {}
    for (slot, (_, n, _)), (low, high) in zip(wanted.items(), row, strict=True):
        if n <= SKETCH:
            value[slot] = low
        else:
            left[slot] = (low, high)
    return left


def _narrowed(
    numbers: DataFrame, brackets: dict[tuple[int, int], tuple[float, float]], value: dict[tuple[int, int], float]
) -> dict[tuple[int, int], tuple[float, float]]:
    """One pass: positions whose value is certain now go to ``value``, the others get a new bracket."""
    groups = {g: s for s, g in enumerate(dict.fromkeys((i, *ends) for (i, _), ends in brackets.items()))}
    within, aggregates = {}, []
    for (i, lo, hi), s in groups.items():
        x = F.col(f"c{i}")
        within[s] = (x > F.lit(lo)) & (x < F.lit(hi))
        aggregates += [
            F.count_if(x < F.lit(lo)).alias(f"below{s}"),
            F.count_if(x == F.lit(lo)).alias(f"low{s}"),
            F.count_if(within[s]).alias(f"n{s}"),
            F.count_if((x == F.lit(hi)) & (x > F.lit(lo))).alias(f"high{s}"),
        ]
    row = numbers.agg(*aggregates).first()
    left, inside = {}, {}
    for (i, p), (lo, hi) in brackets.items():
        s = groups[i, lo, hi]
        below, low, n, high = (row[f"{name}{s}"] for name in ("below", "low", "n", "high"))
        if p < below:
            left[i, p] = (-math.inf, lo)
        elif p < below + low:
            value[i, p] = lo
        elif p < below + low + n:
            inside[i, p] = (s, n, p - below - low)
        elif p < below + low + n + high:
            value[i, p] = hi
        else:
            left[i, p] = (hi, math.inf)
    if inside:
        # Few rows lie inside; they are picked out before anything is sketched.
        open_groups = {s: f"c{i}" for (i, _), (s, _, _) in inside.items()}
        some = functools.reduce(lambda a, b: a | b, [within[s] for s in open_groups])
        sketches = [F.kll_sketch_agg_double(F.when(within[s], F.col(c)), F.lit(SKETCH)).alias(f"s{s}") for s, c in open_groups.items()]
        row = numbers.filter(some).agg(*sketches).first()
    return left | _settled(numbers.sparkSession, {slot: (bytes(row[f"s{s}"]), n, at) for slot, (s, n, at) in inside.items()}, value)
