"""Density clustering and neighbour distances on blocks of vectors.

Points meet as blocks: up to some thousand vectors packed in one row.  A task holds one block and reads the others one
after the other, so a crowded region becomes many equal tasks.  What is found about the points of a block stays with it:
tables of counts or distances, components linked inside the block.  Only edges between components of two blocks, and
what non-core points touch, are rows, never point pairs; several settings are counted and linked in the same visit.
Which blocks can hold neighbours follows from the triangle inequality: two points within eps differ by at most eps in
their distance to any fixed pivot, so they lie in the same or adjacent cells of the pivot grid.  Equal points are merged
first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import ranks
from basketry.operators.blocks import meetings
from basketry.operators.cluster_metrics import pairwise, silhouettes
from basketry.operators.segments import label_summary
from basketry.session import materialised
from basketry.sources.tables import random_sample, seeded_key

#: Points in a block, at most and at least (small inputs); distances of two blocks are made STRIP rows at a time.
BLOCK, SMALLEST, STRIP = 8192, 256, 128
PIVOTS = 2
#: What blocks hold as bytes; ``core`` and ``component`` have one entry per point and trial.
COLUMNS = {"vector": np.float64, "w": np.int64, "core": np.bool_, "component": np.int32}


def _pivots(points: DataFrame) -> np.ndarray:
    rows = points.orderBy(seeded_key(F.col("pid"), 7), "pid").limit(PIVOTS).select("vector").collect()
    return np.array([r["vector"] for r in rows], dtype=float)


def _with_cells(points: DataFrame, eps: float, metric: str, p: float) -> DataFrame:
    """Add ``cell``: the distances to the pivots in units of eps, rounded down."""
    # Cosine distance is no metric, but half the squared chord between unit vectors is the same number.
    radius = float(np.sqrt(2 * eps)) if metric == "cosine" else eps
    if radius <= 0 or (metric == "cosine" and eps >= 1):
        return points.withColumn("cell", F.array(*[F.lit(0).cast("long")] * PIVOTS))
    pivots = points.sparkSession.sparkContext.broadcast(_pivots(points))
    inner = "euclidean" if metric == "cosine" else metric

    @F.pandas_udf("array<bigint>")
    def cell(vectors: pd.Series) -> pd.Series:
        x, at = np.array(vectors.tolist(), dtype=float), pivots.value
        if metric == "cosine":
            x, at = _unit(x), _unit(at)
        steps = np.floor(pairwise(x, at, inner, p) / (radius * (1 + 1e-9))).astype(np.int64)
        return pd.Series(list(np.pad(steps, ((0, 0), (0, PIVOTS - steps.shape[1])))), index=vectors.index)

    return points.withColumn("cell", cell("vector"))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _block_size(n: int) -> int:
    """Points of a block: few blocks, as every task reads all blocks, but enough to keep all tasks busy."""
    return min(BLOCK, max(SMALLEST, -(-n // 32)))


def _packed(points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per ``part``: sorted ids as an array, the named columns as bytes, least and largest cell where there are any."""
    kind = points.schema["pid"].dataType.simpleString()
    boxed = "cell" in points.columns

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pid")
        packed = {c: np.array(rows.column(c).to_pylist(), dtype=COLUMNS[c]).tobytes() for c in columns}
        out = {"part": rows.column("part").slice(0, 1), "pids": pa.array([rows.column("pid").to_pylist()], pa.list_(rows.schema.field("pid").type))}
        if boxed:
            cells = np.array(rows.column("cell").to_pylist(), np.int64)
            out |= {"low": pa.array([cells.min(0).tolist()]), "high": pa.array([cells.max(0).tolist()])}
        return pa.table(out | {c: pa.array([data], pa.binary()) for c, data in packed.items()})

    box = ", low array<bigint>, high array<bigint>" if boxed else ""
    fields = f"part bigint, pids array<{kind}>{box}" + "".join(f", {c} binary" for c in columns)
    rows = points.select("part", "pid", *(["cell"] if boxed else []), *columns)
    return materialised(rows.groupBy("part").applyInArrow(pack, fields))


def _blocks(points: DataFrame, *columns: str) -> DataFrame:
    """Points in the order of their cells, cut into blocks of about equal size, whatever the sizes of the cells."""
    size = _block_size(points.count())
    cells = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit("all"))
    placed = ranks.running_counts(cells, ["all"], "cell", few_groups=True).select("cell", "n", "below")
    part = F.floor((F.col("below") + F.pmod(F.xxhash64("pid"), "n")) / size).cast("long")
    return _packed(points.join(placed, "cell").withColumn("part", part), columns)


def _adjacent() -> Column:
    """Whether points of the blocks ``l_`` and ``r_`` can lie in the same or adjacent cells."""
    met = F.lit(True)
    for i in range(PIVOTS):
        met = met & (F.col("l_low")[i] <= F.col("r_high")[i] + 1) & (F.col("r_low")[i] <= F.col("l_high")[i] + 1)
    return met


def _side(batch: pa.RecordBatch, i: int, name: str) -> dict:
    """Columns of one block at row ``i``, one row per point; numbers lie in the batch itself."""
    out = {"part": batch.column(f"{name}_part")[i].as_py()}
    if f"{name}_pids" in batch.schema.names:
        out["pids"] = batch.column(f"{name}_pids")[i].values
    for c, kind in COLUMNS.items():
        if f"{name}_{c}" in batch.schema.names:
            out[c] = np.frombuffer(batch.column(f"{name}_{c}")[i].as_buffer(), kind)
    n = len(next(out[c] for c in ("w", "pids") if c in out))
    return out | {c: out[c].reshape(n, -1) for c in out if c in COLUMNS}


def _kept(side: dict) -> dict:
    """A copy that outlives the batch."""
    return {c: v if c == "part" else pa.array(v.to_pylist(), v.type) if c == "pids" else v.copy() for c, v in side.items()}


def _strips(l: np.ndarray, r: np.ndarray, metric: str, p: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Distances of two blocks, some rows of the left one at a time."""
    for at in range(0, len(l), STRIP):
        rows = slice(at, at + STRIP)
        yield rows, pairwise(l[rows], r, metric, p)


def _near(l: np.ndarray, r: np.ndarray, eps: float, metric: str, p: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of two blocks within ``eps``: places in either and distances, some rows of the left one at a time."""
    for rows, distance in _strips(l, r, metric, p):
        at = np.flatnonzero((distance <= eps).ravel())
        i, j = np.divmod(at, len(r))
        yield rows.start + i, j, distance.ravel()[at]


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after the points u and v of each pair are found to be connected; smaller ones spread until nothing changes."""
    u, v = label[u], label[v]
    root = np.arange(len(label))
    while len(u):
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = root[root]
        if (root == before).all():
            break
    return root[label]


def _cored(blocks: DataFrame, settings: Sequence[tuple[float, int]], metric: str, p: float) -> DataFrame:
    """The blocks with ``core`` and ``component`` per trial: a core point's component is the place of the first point in its
    block that core points of the block connect it with, other points have -1."""
    radii = sorted({e for e, _ in settings})
    kind = blocks.schema["pids"].dataType.elementType.simpleString()

    def finished(block: dict, within: np.ndarray) -> pa.RecordBatch:
        core = np.stack([within[:, radii.index(e)] >= m for e, m in settings], axis=1)
        label = [np.arange(len(core)) for _ in settings]
        if core.any():
            for i, j, distance in _near(block["vector"], block["vector"], radii[-1], metric, p):
                for t, (e, _) in enumerate(settings):
                    at = np.flatnonzero((distance <= e) & core[i, t] & core[j, t] & (label[t][i] > label[t][j]))
                    if len(at):
                        label[t] = _joined(label[t], i[at], j[at])
        component = np.where(core, np.stack(label, axis=1), -1).astype(np.int32)
        numbers = [block["vector"], block["w"], core, component]
        columns = [pa.array([block["part"]], pa.int64()), *[pa.array([block[c].ravel().tolist()], pa.list_(pa.int64())) for c in ("low", "high")]]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(core)], pa.int32()), block["pids"]), *[pa.array([x.tobytes()], pa.binary()) for x in numbers]]
        return pa.RecordBatch.from_arrays(columns, ["part", "low", "high", "pids", *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                l, r = _side(batch, k, "l"), _side(batch, k, "r")
                if l["part"] not in held:
                    box = {c: np.array(batch.column(f"l_{c}")[k].as_py()) for c in ("low", "high")}
                    held[l["part"]] = (_kept(l | box), np.zeros((len(l["w"]), len(radii)), np.int64))
                sums, w = held[l["part"]][1], r["w"][:, 0].astype(float)
                for i, j, distance in _near(l["vector"], r["vector"], radii[-1], metric, p):
                    # By the least radius that reaches the neighbour.
                    cell = i * len(radii) + np.searchsorted(radii, distance)
                    sums += np.bincount(cell, w[j], sums.size).astype(np.int64).reshape(sums.shape)
        for block, sums in held.values():
            yield finished(block, sums.cumsum(1))

    met = meetings(blocks, blocks.drop("pids"), ["part"], _adjacent())
    fields = f"part bigint, low array<bigint>, high array<bigint>, pids array<{kind}>" + "".join(f", {c} binary" for c in COLUMNS)
    return materialised(met.mapInArrow(run, fields))


def _links(blocks: DataFrame, radii: Sequence[float], metric: str, p: float) -> DataFrame:
    """What blocks tell about each trial ``t``: edges that connect the components of two blocks (``core``), and for every other
    point the components it touches.  A component goes by the id of its first point."""
    kind = blocks.schema["pids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                l, r = _side(batch, k, "l"), _side(batch, k, "r")
                n, m = len(l["pids"]), len(r["pids"])
                # What this task has connected stays so: an edge is told once.
                labels = held.setdefault(l["part"], l["component"].astype(np.int64).T.copy())
                pairs: list[list[np.ndarray]] = [[] for _ in radii]
                touched: list[list[np.ndarray]] = [[] for _ in radii]
                for i, j, distance in _near(l["vector"], r["vector"], max(radii), metric, p):
                    for t, e in enumerate(radii):
                        at = np.flatnonzero((distance <= e) & r["core"][j, t])
                        own, other = i[at], r["component"][j[at], t].astype(np.int64)
                        core = l["core"][own, t]
                        touched[t].append(np.unique(own[~core] * m + other[~core]))
                        if r["part"] < l["part"]:
                            pairs[t].append(np.unique(labels[t][own[core]] * m + other[core]))
                for t in range(len(radii)):
                    at = np.unique(np.concatenate(touched[t])) if touched[t] else np.zeros(0, np.int64)
                    yield from edges(t, [l["pids"].take(pa.array(at // m))], [r["pids"].take(pa.array(at % m))], False)
                    met = np.unique(np.concatenate(pairs[t])) if pairs[t] else np.zeros(0, np.int64)
                    if len(met):
                        root = _joined(np.arange(n + m), met // m, n + met % m)
                        u = np.flatnonzero(root < np.arange(n + m))
                        inner, outer = u[u < n], u[u >= n]
                        ends = [l["pids"].take(pa.array(inner)), r["pids"].take(pa.array(outer - n))]
                        yield from edges(t, ends, [l["pids"].take(pa.array(root[u]))], True)
                        here = labels[t] >= 0
                        labels[t][here] = root[labels[t][here]]

    def edges(t: int, u: Sequence[pa.Array], v: Sequence[pa.Array], core: bool) -> Iterator[pa.RecordBatch]:
        u, v = pa.concat_arrays(u), pa.concat_arrays(v)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(u), pa.int32()), u, v, pa.array([core] * len(u))], ["t", "u", "v", "core"])

    held = blocks.drop("w")
    return meetings(held, held, ["part"], _adjacent()).mapInArrow(run, f"t int, u {kind}, v {kind}, core boolean")


def _points(blocks: DataFrame) -> DataFrame:
    """``(t, pid, w, component)`` per point and trial, the component by the id of its first point, null without one."""
    kind = blocks.schema["pids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = _side(batch, k, "l")
                for t, at in enumerate(block["component"].T):
                    first = block["pids"].take(pa.array(at, mask=at < 0))
                    columns = [pa.array([t] * len(at), pa.int32()), block["pids"], pa.array(block["w"][:, 0]), first]
                    yield pa.RecordBatch.from_arrays(columns, ["t", "pid", "w", "component"])

    rows = blocks.select(*[F.col(c).alias(f"l_{c}") for c in ("part", "pids", "w", "component")])
    return rows.mapInArrow(run, f"t int, pid {kind}, w bigint, component {kind}")


def connected_components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by…, pid, root)`` per vertex of ``(by…, u, v)`` edges, root the smallest id of its component.

    Alternates the large-star and small-star steps until the edges stay the same; every round is
    written out, so neither the plan nor the recovery from a lost executor grows with the rounds.
    """
    by = list(by)

    def star(both: DataFrame, low_only: bool) -> DataFrame:
        lowest = both.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(lowest, [*by, "u"])
        if low_only:
            moved = joined.select(*by, F.col("v"), "m").unionByName(joined.select(*by, F.col("u").alias("v"), "m"))
        else:
            moved = joined.filter(F.col("v") > F.col("u")).select(*by, "v", "m")
        moved = moved.filter(F.col("v") != F.col("m"))
        return moved.select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def turned(df: DataFrame) -> DataFrame:
        return df.select(*by, F.col("v").alias("u"), F.col("u").alias("v"))

    def signature(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(20,0)"))).first()

    current, before = materialised(edges), None
    while True:
        large = materialised(star(current.unionByName(turned(current)), low_only=False))
        down = large.filter(F.col("u") > F.col("v")).unionByName(turned(large.filter(F.col("u") < F.col("v"))))
        current = materialised(star(down, low_only=True))
        now = signature(current)
        if now == before:
            return current.select(*by, F.col("u").alias("pid"), F.col("v").alias("root"))
        before = now


def dbscan(
    df: DataFrame, key: str, eps: float, min_samples: int, metric: str = "euclidean", p: float = 2.0, vector: str = "vector"
) -> DataFrame:
    """``(key, label)``; noise is -1, clusters are numbered by size.

    A point counts itself among its neighbours.  A border point joins the core cluster with the
    smallest root among those it touches.  Keys may be of any type that can be ordered.
    """
    return dbscan_trials(df, key, [(eps, min_samples)], metric, p, vector).select(key, "label")


def dbscan_trials(
    df: DataFrame,
    key: str,
    settings: Sequence[tuple[float, int]],
    metric: str = "euclidean",
    p: float = 2.0,
    vector: str = "vector",
) -> DataFrame:
    """I11 for several (eps, min_samples) at once: ``(t, key, label)``, ``t`` the place of the setting.

    Blocks meet twice, whatever the number of settings: once to count neighbours, once to link core points.
    """
    data = df.select(key, F.col(vector).alias("vector"))
    merged = materialised(data.groupBy("vector").agg(F.min(key).alias("pid"), F.count(F.lit(1)).alias("w")))
    points = materialised(_with_cells(merged, max(e for e, _ in settings), metric, p))
    blocks = _cored(_blocks(points, "vector", "w"), settings, metric, p)
    links = materialised(_links(blocks, [e for e, _ in settings], metric, p))
    linked = materialised(connected_components(links.filter("core").select("t", "u", "v"), ["t"]))

    def rooted(rows: DataFrame, component: str) -> DataFrame:
        """Add ``root``, the smallest id of all that the component is connected with."""
        known = linked.withColumnRenamed("pid", component)
        return rows.join(known, ["t", component], "left").withColumn("root", F.coalesce("root", component))

    of = F.col("u").alias("pid")
    touched = rooted(links.filter("not core").select("t", of, F.col("v").alias("touched")), "touched").groupBy("t", "pid").agg(F.min("root").alias("border"))
    placed = rooted(_points(blocks), "component").join(touched, ["t", "pid"], "left")
    placed = materialised(placed.select("t", "pid", "w", F.coalesce("root", "border").alias("root")))
    sizes = placed.filter(F.col("root").isNotNull()).groupBy("t", "root").agg(F.sum("w").alias("size"))
    # Position by (size, root): a count of larger clusters, found without sorting them in one task.
    order = F.struct((-F.col("size")).alias("s"), "root")
    numbered = ranks.running_counts(
        sizes.select("t", order.alias("value"), "root", F.lit(1).cast("long").alias("n")), ["t"]
    ).select("t", "root", F.col("below").alias("label"))
    labelled = placed.join(numbered, ["t", "root"], "left").select("t", "pid", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))
    return data.join(merged.select("vector", "pid"), "vector").join(labelled, "pid").select("t", key, "label")


def nearest_distances(
    df: DataFrame, key: str, ks: Sequence[int], metric: str = "euclidean", p: float = 2.0, vector: str = "vector"
) -> DataFrame:
    """I12 for several k at once: ``(key, distances)``, the k-th nearest distance per entry of ``ks``, itself counted."""
    return _nearest(df, key, ks, [metric], p, vector).withColumnRenamed(metric, "distances")


def _nearest(df: DataFrame, key: str, ks: Sequence[int], metrics: Sequence[str], p: float, vector: str) -> DataFrame:
    """``nearest_distances`` by several metrics, one column each, from one visit.

    A block keeps a table of the largest k candidates per point and metric while it meets all others.
    """
    points = materialised(df.select(F.col(key).alias("pid"), F.col(vector).alias("vector")))
    n, kind = points.count(), points.schema["pid"].dataType.simpleString()
    most, n_blocks = max(ks), max(1, -(-n // _block_size(n)))
    # Any part will do; the ids of a part need not be distinct.
    blocks = _packed(points.withColumn("part", F.pmod(F.xxhash64("pid"), F.lit(n_blocks))), ["vector"])

    def least(found: np.ndarray, more: np.ndarray) -> None:
        """Keep the smallest numbers of each row of both; nan stands for none."""
        most_far = found.max(1)
        if np.isnan(most_far).any():
            found[:] = np.partition(np.concatenate([found, more], axis=1), most - 1, axis=1)[:, :most]
            return
        i, j = np.divmod(np.flatnonzero((more < most_far[:, None]).ravel()), more.shape[1])
        if len(i):
            counts = np.bincount(i, minlength=len(more))
            rows = np.flatnonzero(counts)
            fresh = np.full((len(rows), counts.max()), np.nan)
            fresh[np.repeat(np.arange(len(rows)), counts[rows]), np.arange(len(i)) - (np.cumsum(counts) - counts)[i]] = more[i, j]
            found[rows] = np.partition(np.concatenate([found[rows], fresh], axis=1), most - 1, axis=1)[:, :most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for k in range(batch.num_rows):
                l, y = _side(batch, k, "l"), np.frombuffer(batch.column("r_vector")[k].as_buffer())
                y = y.reshape(-1, l["vector"].shape[1])
                if l["part"] not in held:
                    held[l["part"]] = (_kept(l)["pids"], [np.full((len(l["pids"]), most), np.nan) for _ in metrics])
                for metric, found in zip(metrics, held[l["part"]][1], strict=True):
                    for rows, distance in _strips(l["vector"], y, metric, p):
                        least(found[rows], distance)
        for pids, tables in held.values():
            lists = []
            for found in tables:
                found = np.sort(found, axis=1)[:, : min(most, n)]
                offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                lists.append(pa.ListArray.from_arrays(offsets, pa.array(found.ravel())))
            yield pa.RecordBatch.from_arrays([pids, *lists], ["pid", *metrics])

    met = meetings(blocks, blocks.select("vector"), ["part"])
    lists = met.mapInArrow(run, f"pid {kind}" + "".join(f", {m} array<double>" for m in metrics))
    # Rows with one key share their candidates.
    lists = lists.groupBy("pid").agg(*[F.array_sort(F.flatten(F.collect_list(m))).alias(m) for m in metrics])
    return lists.select(F.col("pid").alias(key), *[F.array(*[F.get(m, F.lit(k - 1)) for k in ks]).alias(m) for m in metrics])


def k_distances(
    df: DataFrame,
    key: str,
    k: int,
    metric: str = "euclidean",
    p: float = 2.0,
    sample_size: int | None = None,
    seed: int = 42,
    vector: str = "vector",
) -> DataFrame:
    """Distance of every point to its k-th nearest, itself counted first, smallest first.

    With a sample the points and their neighbours both come from it.
    """
    points = df.select(key, vector)
    if sample_size is not None:
        points = random_sample(points, sample_size, key, seed)
    found = nearest_distances(points, key, [k], metric, p, vector)
    return found.select(key, F.col("distances")[0].alias("distance")).orderBy("distance", key)


# The published sweep.
SWEEP_METRICS = ("cosine", "euclidean")
SWEEP_MIN_SAMPLES = (15, 30, 60)
SWEEP_QUANTILES = (0.02, 0.05, 0.10, 0.15)
SMALLEST_EPS = {"cosine": 1e-3, "euclidean": 1e-6}

TRIALS = (
    "metric string, min_samples int, eps double, clusters bigint, noise_pct double, largest_pct double,"
    " silhouette double, accepted boolean, best boolean"
)


def dbscan_sweep(
    df: DataFrame,
    key: str,
    metrics=SWEEP_METRICS,
    min_samples=SWEEP_MIN_SAMPLES,
    fractions=SWEEP_QUANTILES,
    vector: str = "vector",
    sample_size: int | None = None,
) -> DataFrame:
    """One row per trial with its scores and whether it is acceptable; ``best`` marks the choice.

    eps comes from low quantiles of the positive k-distances (of a sample, if asked for).  A trial is acceptable with at
    least two clusters, under 60% noise and under 70% of the labelled points in one cluster.  Without any, the
    row marked best is a cautious cosine setting.

    All trials share one visit for the distances of neighbours, those of a metric one clustering run; all labellings are
    scored by one visit.
    """
    spark, trials, labellings = df.sparkSession, [], []
    data = df.select(key, vector)
    pool = data if sample_size is None else random_sample(data, sample_size, key, 42)

    def proposals(found: DataFrame, metric: str, wanted: Sequence[int], qs: Sequence[float]) -> dict[int, list[float]]:
        long = found.select(F.posexplode(metric).alias("i", "value")).filter(F.col("value").isNotNull())
        out = {}
        names = {f"q{i}": q for i, q in enumerate(qs)}
        tables = [ranks.quantiles(x, names, ["i"]).collect() for x in (long, long.filter(F.col("value") > 0))]
        for rows in tables:  # positive distances where there are any
            for r in rows:
                out[wanted[r["i"]]] = [max(r[n], SMALLEST_EPS.get(metric, 1e-6)) for n in names]
        return out

    nearest = materialised(_nearest(pool, key, min_samples, metrics, 2.0, vector)) if metrics and min_samples else None
    for metric in metrics:
        found = proposals(nearest, metric, min_samples, fractions) if min_samples else {}
        settings = [(eps, m) for m in min_samples for eps in found.get(m, [])]
        if settings:
            labels = dbscan_trials(data, key, settings, metric, vector=vector)
            labellings.append(labels.select((F.col("t") + len(trials)).cast("int").alias("t"), key, "label"))
            trials += [[metric, m, eps] for eps, m in settings]
    if trials:
        labels = materialised(functools.reduce(DataFrame.unionByName, labellings))
        summary = {r["t"]: r for r in label_summary(labels, "label", by=["t"]).collect()}
        scores = {r["t"]: r["silhouette"] for r in silhouettes(data, labels.filter(F.col("label") >= 0), key, "label", "t", vector).collect()}
        for t, trial in enumerate(trials):
            s = summary[t]
            score = scores.get(t) if s["clusters"] >= 2 else None
            ok = s["clusters"] >= 2 and s["noise_pct"] < 60 and s["largest_pct"] < 70 and score is not None
            trial += [s["clusters"], s["noise_pct"], s["largest_pct"], score, ok, False]
    good = [t for t in trials if t[7]]
    if good:
        max(good, key=lambda t: round(t[6], 9))[8] = True  # the first of equal trials
    else:
        if "cosine" in metrics and 30 in min_samples:
            least = nearest.select(F.array(F.col("cosine")[list(min_samples).index(30)]).alias("cosine"))
        else:
            least = materialised(_nearest(pool, key, [30], ["cosine"], 2.0, vector))
        cautious = proposals(least, "cosine", [30], [0.05]).get(30, [SMALLEST_EPS["cosine"]])[0]
        trials.append(["cosine", 30, cautious, None, None, None, None, False, True])
    return spark.createDataFrame([tuple(t) for t in trials], TRIALS)
