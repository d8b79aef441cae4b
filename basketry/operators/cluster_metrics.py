"""Quality of a labelling and tables over cluster centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as pa_type

from basketry.operators.blocks import meetings
from basketry.operators.vectors import cells
from basketry.session import materialised
from basketry.sources.tables import random_sample

#: Points in a block, at most; every block meets every other. With many clusters a block has fewer points, so that its
#: table of points by clusters has BLOCK_FIELDS fields at most.
BLOCK, BLOCK_FIELDS = 8192, 1 << 22
#: Rows of a block whose distances to another block are held at once.
STRIP = 128
#: Points of a line scored in one task.
RANGE = 1 << 16


def pairwise(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", p: float = 2.0) -> np.ndarray:
    """Distances between the rows of two matrices."""
    if metric == "euclidean":
        sa, sb = (a * a).sum(1), (b * b).sum(1)
        out = (-2 * a) @ b.T
        out += sa[:, None]
        out += sb
        # Nearly equal rows lose digits in this form: do those again, one by one.
        rows = np.flatnonzero(~(out.min(1, initial=np.inf) >= 1e-6 * (sa + sb.max(initial=0))))
        i, j = np.nonzero(out[rows] < 1e-6 * (sa[rows, None] + sb))
        np.sqrt(np.maximum(out, 0, out=out), out=out)
        out[rows[i], j] = np.sqrt(((a[rows[i]] - b[j]) ** 2).sum(1))
        return out
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        out = a @ b.T
        out /= np.where(na > 0, na, 1)[:, None]
        out /= np.where(nb > 0, nb, 1)
        return np.maximum(np.subtract(1, out, out=out), 0, out=out)
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        gap = np.abs(b - row)
        if metric == "hamming":
            out[i] = (gap != 0).mean(1)
        elif metric == "manhattan":
            out[i] = gap.sum(1)
        elif metric == "minkowski":
            out[i] = (gap**p).sum(1) ** (1 / p)
        else:
            raise ValueError(f"unknown metric {metric!r}")
    return out


def silhouette_values(
    df: DataFrame, key: str, cluster: str, vector: str = "vector", sample_size: int | None = None, seed: int = 42
) -> DataFrame:
    """Euclidean silhouette ``(key, cluster, silhouette)`` of every point.

    Without ``sample_size`` all points are scored against all, as in ``silhouette_points``.  With it a seeded sample is both scored and the reference set.
    Points alone in their cluster score 0; with fewer than two clusters there is no score.
    """
    if sample_size is None:
        return silhouette_points(df, df.select(key, cluster), key, cluster, "labelling", vector).drop("labelling")
    sample = random_sample(df.select(key, cluster, vector).filter(F.col(cluster).isNotNull()), sample_size, key, seed)
    rows = sample.collect()
    labels, code = np.unique(np.array([r[cluster] for r in rows]), return_inverse=True) if rows else (np.array([]), np.array([], int))
    shared = df.sparkSession.sparkContext.broadcast(
        (np.array([r[vector] for r in rows], dtype=float), np.eye(len(labels))[code] if len(rows) else None, labels)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, member, names = shared.value
        sizes = member.sum(0)
        for b in batches:
            for start in range(0, len(b), 1024):
                part = b.iloc[start : start + 1024]
                mine = np.searchsorted(names, part[cluster].to_numpy())
                total = pairwise(np.array(part[vector].tolist(), dtype=float), points) @ member
                i = np.arange(len(part))
                own = sizes[mine]
                inner = total[i, mine] / np.maximum(own - 1, 1)
                other = total / sizes
                other[i, mine] = np.inf
                outer = other.min(1)
                s = np.where(own > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)
                yield pd.DataFrame({key: part[key], cluster: part[cluster], "silhouette": s})

    fields = df.schema
    schema = f"{key} {fields[key].dataType.simpleString()}, {cluster} {fields[cluster].dataType.simpleString()}, silhouette double"
    if len(labels) < 2:
        return sample.select(key, cluster, F.lit(None).cast("double").alias("silhouette"))
    return sample.repartition(key).mapInPandas(run, schema)


def silhouettes(
    points: DataFrame, labels: DataFrame, key: str, cluster: str, by: str | None = None, vector: str = "vector"
) -> DataFrame:
    """Mean Euclidean silhouette per labelling, ``(by, silhouette)``; null with fewer than two clusters."""
    by = by or "labelling"
    values = silhouette_points(points, labels, key, cluster, by, vector)
    return values.groupBy(by).agg(F.avg("silhouette").alias("silhouette"))


def _line_scores(rows: DataFrame, n_points: int, sizes: np.ndarray, run_of: np.ndarray) -> DataFrame:
    """``rows`` (``x__``, a number, and the ``codes`` of the point's clusters) with ``scores``, a silhouette per run.

    On a line the distances to a cluster follow from counts and sums of what lies below a point.  Points equal in
    number and clusters are scored once; ranges of numbers are scored apart, knowing what each cluster has below them.
    """
    width, runs = len(sizes), int(run_of.max()) + 1
    merged = materialised(rows.groupBy("x__", "codes").agg(F.count(F.lit(1)).alias("w__")))
    n_ranges = -(-n_points // RANGE)
    cuts = merged.approxQuantile("x__", [i / n_ranges for i in range(1, n_ranges)], 0.1 / n_ranges) if n_ranges > 1 else []
    cuts = sorted(set(cuts))
    at = F.size(F.filter(F.lit(cuts), lambda cut: cut <= F.col("x__"))) if cuts else F.lit(0)
    cells = merged.select("x__", "w__", at.alias("range"), F.explode("codes").alias("code")).filter("code >= 0")
    # Sums run from the least number of each cluster, so that they keep their digits.
    ends = {r["code"]: r for r in cells.groupBy("code").agg(F.min("x__").alias("low"), F.max("x__").alias("high")).collect()}
    usable = np.array([bool(np.isfinite([ends[c]["low"], ends[c]["high"]]).all()) for c in range(width)])
    low = np.array([ends[c]["low"] if usable[c] else 0.0 for c in range(width)])
    gap = F.when(F.isnan("x__"), 0.0).otherwise(F.col("x__") - F.lit(low.tolist())[F.col("code")])
    counts, sums = np.zeros((len(cuts) + 2, width)), np.zeros((len(cuts) + 2, width))
    for r in cells.groupBy("range", "code").agg(F.sum("w__").alias("n"), F.sum(F.col("w__") * gap).alias("s")).collect():
        counts[r["range"] + 1, r["code"]], sums[r["range"] + 1, r["code"]] = r["n"], r["s"]
    shared = rows.sparkSession.sparkContext.broadcast((counts.cumsum(0), sums.cumsum(0)))

    def score(group: pa.Table) -> pa.Table:
        below, total = (t[group.column("range")[0].as_py()] for t in shared.value)
        all_sums = shared.value[1][-1]
        x, w = (np.asarray(group.column(c).combine_chunks()) for c in ("x__", "w__"))
        codes = np.asarray(group.column("codes").combine_chunks().flatten()).reshape(-1, runs)
        order = np.argsort(x, kind="stable")
        value = np.full((len(x), runs), np.nan)
        for t in range(runs):
            mine, own = np.flatnonzero(run_of == t), codes[:, t]
            if len(mine) < 2:
                continue
            inner, outer = np.zeros(len(x)), np.full(len(x), np.inf)
            for c in mine:
                held = order[own[order] == c]
                place = np.searchsorted(x[held], x, side="right")
                n = below[c] + np.concatenate([[0], np.cumsum(w[held])])[place]
                s = total[c] + np.concatenate([[0.0], np.cumsum(w[held] * (x[held] - low[c]))])[place]
                far = np.maximum((x - low[c]) * (2 * n - sizes[c]) + all_sums[c] - 2 * s, 0) if usable[c] else np.full(len(x), np.nan)
                inner = np.where(own == c, far / max(sizes[c] - 1, 1), inner)
                outer = np.where(own == c, outer, np.minimum(outer, far / sizes[c]))
            score = (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300)
            value[:, t] = np.where(sizes[own] > 1, score, 0.0)
        several = np.bincount(run_of, minlength=runs) > 1
        scores = pa.array(value.ravel(), pa.float64(), mask=~np.tile(several, len(x)))
        offsets = np.arange(0, len(x) * runs + 1, runs, dtype=np.int32)
        return pa.table({"x__": group.column("x__"), "codes": group.column("codes"), "scores": pa.ListArray.from_arrays(offsets, scores)})

    scored = merged.withColumn("range", at).groupBy("range").applyInArrow(score, "x__ double, codes array<int>, scores array<double>")
    return rows.join(scored, ["x__", "codes"])


def silhouette_points(points: DataFrame, labels: DataFrame, key: str, cluster: str, by: str, vector: str = "vector") -> DataFrame:
    """``(by, key, cluster, silhouette)`` of every point under several labellings ``(by, key, cluster)`` at once.

    A block of packed vectors meets all others in one task, whatever the number of labellings, and keeps one table of
    distance sums (points by clusters) meanwhile; no distance or sum travels.  The clusters of all labellings, with
    their sizes, are known to every task.  Vectors of one number are scored from running counts and sums, without pairs.
    """
    spark = points.sparkSession
    labels = labels.filter(F.col(cluster).isNotNull())
    if by not in labels.columns:
        labels = labels.withColumn(by, F.lit(0))
    kinds = {name: labels.schema[name].dataType.simpleString() for name in (by, key, cluster)}
    schema = f"{by} {kinds[by]}, {key} {kinds[key]}, {cluster} {kinds[cluster]}, silhouette double"
    clusters = labels.groupBy(by, cluster).agg(F.count(F.lit(1)).alias("n")).orderBy(by, cluster).collect()
    if not clusters:
        return spark.createDataFrame([], schema)
    # Runs of the same labels are scored once.
    alike: dict[tuple, list] = {}
    signs = labels.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key, cluster).cast("decimal(20,0)")).alias("a"), F.sum(F.hash(key, cluster).cast("long")).alias("b"))
    for r in signs.orderBy(by).collect():
        alike.setdefault((r["n"], r["a"], r["b"]), []).append(r[by])
    twins = {same[0]: same for same in alike.values()}
    clusters = [r for r in clusters if r[by] in twins]
    runs = sorted({r[by] for r in clusters})
    sizes, names = np.array([r["n"] for r in clusters], float), [r[cluster] for r in clusters]
    run_of = np.array([runs.index(r[by]) for r in clusters])
    coded = spark.createDataFrame(
        [(r[by], r[cluster], i, int(run_of[i])) for i, r in enumerate(clusters)], f"{by} {kinds[by]}, {cluster} {kinds[cluster]}, code__ int, run__ int"
    )
    of_run = F.map_from_entries(F.collect_list(F.struct("run__", "code__")))
    codes = labels.join(coded, [by, cluster]).groupBy(key).agg(of_run.alias("of_run"))
    in_order = F.transform(F.sequence(F.lit(0), F.lit(len(runs) - 1)), lambda i: F.coalesce(F.col("of_run")[i], F.lit(-1)))
    labelled = materialised(points.select(key, vector).join(codes.select(key, in_order.alias("codes")), key))
    width = len(clusters)
    n_points, low, high = labelled.agg(F.count(F.lit(1)), F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low == high == 1:
        placed = labelled.withColumn("x__", F.coalesce(F.col(vector)[0].cast("double"), F.lit(float("nan"))))
        found = _line_scores(placed.select(key, "x__", "codes"), n_points, sizes, run_of).select(
            key, F.posexplode(F.arrays_zip("codes", "scores")).alias("run__", "cell")
        )
        found = found.select(key, "run__", F.col("cell.codes").alias("code__"), F.col("cell.scores").alias("silhouette"))
        of_run = spark.createDataFrame([(i, twin) for i, run in enumerate(runs) for twin in twins[run]], f"run__ int, {by} {kinds[by]}")
        return found.join(coded.drop(by), ["run__", "code__"]).join(of_run, "run__").select(by, key, cluster, "silhouette")
    n_blocks = max(1, -(-n_points // min(BLOCK, max(256, -(-n_points // 8)))))
    # Points of a block that a task scores, enough tasks for all.
    most = min(max(1, BLOCK_FIELDS // width), max(256, -(-n_points // 32)))
    arrow = {name: pa_type(labels.schema[name].dataType) for name in (by, key, cluster)}

    def pack(rows):
        x = np.array(rows.column(vector).to_pylist(), dtype=np.float64)
        code = np.array(rows.column("codes").to_pylist(), dtype=np.int32)
        # Points of the same clusters lie together.
        order = np.lexsort(code.T[::-1])
        keys = rows.column(key).take(pa.array(order)).to_pylist()
        return pa.table(
            {
                "part": pa.array([rows.column("part")[0].as_py()], pa.int64()),
                "keys": pa.array([keys], pa.list_(rows.schema.field(key).type)),
                "x": pa.array([x[order].tobytes()], pa.binary()),
                "codes": pa.array([code[order].tobytes()], pa.binary()),
            }
        )

    part = F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("part")
    blocks = labelled.select(key, vector, "codes", part).groupBy("part")
    blocks = materialised(blocks.applyInArrow(pack, f"part bigint, keys array<{kinds[key]}>, x binary, codes binary"))

    def table(codes: pa.Scalar) -> np.ndarray:
        return np.frombuffer(codes.as_buffer(), np.int32).reshape(-1, len(runs))

    def groups(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Where points of other clusters begin and, per run, the order of those groups by cluster, where a cluster begins there, and its code."""
        starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]).any(1)]))
        found = []
        for own in codes[starts].T:
            order = np.argsort(own, kind="stable")
            order = order[own[order] >= 0]
            first = np.flatnonzero(np.diff(own[order], prepend=-1))
            found.append((order, first, own[order][first]))
        return starts, found

    def scores(keys: pa.Array, codes: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t, run in enumerate(runs):
            own = codes[:, t]
            rows, mine = np.flatnonzero(own >= 0), np.flatnonzero(run_of == t)
            at, place = np.arange(len(rows)), own[rows] - mine[0]
            value = [None] * len(rows)
            if len(mine) > 1 and len(rows):
                mean = total[np.ix_(rows, mine)]
                n = sizes[own[rows]]
                inner = mean[at, place] / np.maximum(n - 1, 1)
                mean = mean / sizes[mine]
                mean[at, place] = np.inf
                outer = mean.min(1)
                value = np.where(n > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)
            columns = [keys.take(pa.array(rows)).cast(arrow[key]), pa.array([names[c] for c in own[rows]], arrow[cluster]), pa.array(value, pa.float64())]
            for twin in twins[run]:
                yield pa.RecordBatch.from_arrays([pa.array([twin] * len(rows), arrow[by]), *columns], [by, key, cluster, "silhouette"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                # Blocks are read where they lie in the batch; of its own block a task keeps keys, codes and sums.
                own = (batch.column("l_part")[k].as_py(), batch.column("l_piece")[k].as_py())
                if own not in held:
                    codes = table(batch.column("l_codes")[k]).copy()
                    keys = pa.array(batch.column("l_keys")[k].as_py(), batch.schema.field("l_keys").type.value_type)
                    held[own] = (keys, codes, np.zeros((len(codes), width)))
                starts, found = groups(table(batch.column("r_codes")[k]))
                x, y = (np.frombuffer(batch.column(f"{s}_x")[k].as_buffer(), np.float64).reshape(n, -1) for s, n in (("l", len(held[own][1])), ("r", len(table(batch.column("r_codes")[k])))))
                total = held[own][2]
                for at in range(0, len(x), STRIP):
                    near = np.add.reduceat(pairwise(x[at : at + STRIP], y), starts, axis=1)
                    for order, first, codes in found:
                        if len(order):
                            total[at : at + STRIP, codes] += np.add.reduceat(near[:, order], first, axis=1)
        for block in held.values():
            yield from scores(*block)

    def cut(c: str) -> Column:
        entry = F.length(c) / F.size("keys")
        return F.substring(F.col(c), (F.col("piece") * most * entry + 1).cast("int"), (most * entry).cast("int")).alias(c)

    piece = F.explode(F.sequence(F.lit(0), F.floor((F.size("keys") - 1) / most).cast("int"))).alias("piece")
    pieces = blocks.select("*", piece).select("part", "piece", F.slice("keys", F.col("piece") * most + 1, F.lit(most)).alias("keys"), cut("x"), cut("codes"))
    return meetings(pieces, blocks.select("x", "codes"), ["part", "piece"]).mapInArrow(run, schema)


def silhouette(df: DataFrame, key: str, cluster: str, vector: str = "vector", sample_size: int | None = None) -> float | None:
    """Mean silhouette, over all points unless a sample is asked for."""
    return silhouette_values(df, key, cluster, vector, sample_size).agg(F.avg("silhouette")).first()[0]


def silhouette_squared(df: DataFrame, cluster: str, vector: str = "vector") -> float:
    """The variant with squared distances, one pass over all points."""
    rows = df.select(F.col(cluster).cast("int").alias("prediction"), array_to_vector(vector).alias("features"))
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(rows)


def _moments(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    return cells(df, cluster, vector=vector).groupBy(cluster, "dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")
    )


def calinski_harabasz(df: DataFrame, cluster: str, vector: str = "vector") -> DataFrame:
    """I8: one row with clusters, points, score, and the sums of squares within the clusters and in all, from counts and
    sums per (cluster, dimension)."""
    per_dim = _moments(df, cluster, vector)
    dims = per_dim.groupBy("dim").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        (F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")).alias("total"),
    )
    return dims.agg(
        F.max("k").alias("clusters"), F.max("n").alias("points"), F.sum("within").alias("w"), F.sum("total").alias("t")
    ).select(
        "clusters",
        "points",
        F.try_divide(
            (F.col("t") - F.col("w")) * (F.col("points") - F.col("clusters")),
            F.col("w") * (F.col("clusters") - 1),
        ).alias("calinski_harabasz"),
        F.col("w").alias("within"),
        F.col("t").alias("total"),
    )


def centres(df: DataFrame, cluster: str, vector: str = "vector") -> DataFrame:
    """Mean vector per cluster."""
    means = _moments(df, cluster, vector).select(cluster, "dim", (F.col("s") / F.col("n")).alias("m"), "n")
    return means.groupBy(cluster).agg(
        F.max("n").alias("size"),
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda t: t["m"]).alias("centre"),
    )


def distance_to_centre(df: DataFrame, cluster: str, vector: str = "vector") -> DataFrame:
    """Rows with their Euclidean distance to the mean of their cluster."""
    gap = F.aggregate(
        F.zip_with(F.col(vector), F.col("centre"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
    )
    joined = df.join(centres(df, cluster, vector).select(cluster, "centre"), cluster)
    return joined.withColumn("distance", F.sqrt(gap)).drop("centre")


def davies_bouldin(df: DataFrame, cluster: str, vector: str = "vector") -> float | None:
    """Only the centres and one spread per cluster reach the driver."""
    spread = distance_to_centre(df, cluster, vector).groupBy(cluster).agg(F.avg("distance").alias("spread"))
    rows = centres(df, cluster, vector).join(spread, cluster).collect()
    if len(rows) < 2:
        return None
    s = np.array([r["spread"] for r in rows])
    gaps = pairwise(*[np.array([r["centre"] for r in rows], dtype=float)] * 2)
    np.fill_diagonal(gaps, np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(gaps > 0, (s[:, None] + s[None, :]) / gaps, 0.0)
    return float(ratio.max(axis=1).mean())


def centre_ranges(df: DataFrame, cluster: str, k: int = 20, vector: str = "vector") -> DataFrame:
    """Dimensions by the range of the centres, widest first."""
    means = _moments(df, cluster, vector).select("dim", (F.col("s") / F.col("n")).alias("m"))
    return (
        means.groupBy("dim")
        .agg((F.max("m") - F.min("m")).alias("range"))
        .orderBy(F.col("range").desc(), "dim")
        .limit(k)
    )


def centre_distances(df: DataFrame, cluster: str, vector: str = "vector") -> DataFrame:
    """Distance between every two centres, with the closest and the farthest pair marked."""
    rows = centres(df, cluster, vector).orderBy(cluster).collect()
    names = [int(r[cluster]) for r in rows]
    gaps = pairwise(*[np.array([r["centre"] for r in rows], dtype=float)] * 2)
    pairs = [(names[i], names[j], float(gaps[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]
    table = df.sparkSession.createDataFrame(pairs, "a int, b int, distance double")
    low, high = (f(p[2] for p in pairs) if pairs else None for f in (min, max))
    return table.withColumns({"closest": F.col("distance") == F.lit(low), "farthest": F.col("distance") == F.lit(high)})
