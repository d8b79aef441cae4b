"""Gaussian mixtures with full covariances, fitted by expectation maximisation on summed moments.

A task turns its points into memberships and returns, per component, their number, sum and sum of outer products; the
driver holds nothing but these sums and the parameters.  Mixtures of several sizes are fitted in the same passes.
A term on the diagonal keeps every covariance regular, also with fewer points than parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Variance added on the diagonal, change of the mean log-likelihood that ends a fit, and most rounds.
REGULAR, TOLERANCE, ROUNDS = 1e-6, 1e-3, 100


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray  # (k)
    means: np.ndarray  # (k, d)
    covariances: np.ndarray  # (k, d, d)

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return (k - 1) + k * d + k * d * (d + 1) // 2

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, per point and component."""
        k, d = self.means.shape
        out = np.empty((len(x), k))
        for j in range(k):
            root = _root(self.covariances[j])
            gap = np.linalg.solve(root, (x - self.means[j]).T)
            log_det = np.log(np.diag(root)).sum()
            out[:, j] = np.log(self.weights[j]) - 0.5 * (d * np.log(2 * np.pi) + (gap * gap).sum(0)) - log_det
        return out

    def memberships(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Membership probabilities and the log-likelihood of every point."""
        log = self.log_density(x)
        top = log.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log - top).sum(axis=1))
        return np.exp(log - total[:, None]), total


def _root(covariance: np.ndarray) -> np.ndarray:
    """Cholesky factor; where rounding has left a covariance indefinite, the diagonal term grows until it is not."""
    more = 0.0
    while True:
        try:
            return np.linalg.cholesky(covariance + more * np.eye(len(covariance)))
        except np.linalg.LinAlgError:
            more = max(10 * more, REGULAR)


def _moments(member: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Per component: number, sum and sum of outer products, in one row."""
    outer = np.stack([(x * m[:, None]).T @ x for m in member.T])
    return np.concatenate([member.sum(0)[:, None], member.T @ x, outer.reshape(len(outer), -1)], axis=1)


def _fitted(sums: np.ndarray, d: int) -> Mixture:
    n = sums[:, 0] + 10 * np.finfo(float).eps
    means = sums[:, 1 : d + 1] / n[:, None]
    covariances = sums[:, d + 1 :].reshape(-1, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    covariances = (covariances + covariances.transpose(0, 2, 1)) / 2 + REGULAR * np.eye(d)
    return Mixture(n / n.sum(), means, covariances)


def _summed(rows: DataFrame, tables, shapes: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """Sum of what ``tables(batch)`` returns per size: in each task, then by groups of tasks, then here."""
    slots = max(1, int(rows.rdd.getNumPartitions() ** 0.5))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(shape) for k, shape in shapes.items()}
        for batch in batches:
            if batch.num_rows:
                for k, table in tables(batch):
                    total[k] += table
        slot = TaskContext.get().partitionId() % slots
        columns = [pa.array([slot] * len(total), pa.int32()), pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "k", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in group.column("sums").to_pylist())
        return group.slice(0, 1).set_column(2, "sums", pa.array([total.tobytes()], pa.binary()))

    schema = "slot int, k int, sums binary"
    parts = rows.mapInArrow(local, schema).groupBy("slot", "k").applyInArrow(add, schema).collect()
    out = {k: np.zeros(shape) for k, shape in shapes.items()}
    for r in parts:
        out[r["k"]] += np.frombuffer(r["sums"], np.float64).reshape(shapes[r["k"]])
    return out


def _points(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float)


def fit_mixtures(rows: DataFrame, key: str, starts: dict[int, DataFrame], vector: str = "vector") -> dict[int, tuple[Mixture, list[float]]]:
    """A mixture per size, and the log-likelihoods of its rounds, the last one that of the result.

    ``starts`` holds a labelling ``(key, cluster)`` per size, as k-means gives it.  ``rows`` are read once per round:
    pass a written table.
    """
    spark = rows.sparkSession
    first = rows.select(vector).first()
    if first is None:
        raise ValueError("no points to fit a mixture to")
    d = len(first[0])
    middle = np.array(rows.select(*[F.avg(F.col(vector)[i]) for i in range(d)]).first(), dtype=float)
    found, history, before = {}, {k: [] for k in starts}, {}
    for k, labels in starts.items():

        def given(batch: pa.RecordBatch, k=k):
            x = _points(batch.column(0)) - middle
            yield k, _moments(np.eye(k)[np.asarray(batch.column(1), int)], x)

        sums = _summed(rows.join(labels, key).select(vector, "cluster"), given, {k: (k, 1 + d + d * d)})
        found[k] = _fitted(sums[k], d)
    n, active = rows.count(), set(starts)
    for turn in range(ROUNDS + 1):
        shared = spark.sparkContext.broadcast({k: found[k] for k in sorted(active)})

        def step(batch: pa.RecordBatch):
            x = _points(batch.column(0)) - middle
            for k, mixture in shared.value.items():
                member, log = mixture.memberships(x)
                table = _moments(member, x)
                yield k, np.concatenate([np.full((k, 1), log.sum()), table], axis=1)

        sums = _summed(rows.select(vector), step, {k: (k, 2 + d + d * d) for k in sorted(active)})
        shared.destroy()
        for k in sorted(active):
            log = float(sums[k][0, 0])
            history[k].append(log)
            if turn == ROUNDS or (k in before and abs(log - before[k]) / n < TOLERANCE):
                active.discard(k)  # the parameters that gave this likelihood stay
            else:
                before[k], found[k] = log, _fitted(sums[k][:, 1:], d)
        if not active:
            break
    return {k: (Mixture(m.weights, m.means + middle, m.covariances), history[k]) for k, m in found.items()}


def memberships(rows: DataFrame, key: str, mixture: Mixture, vector: str = "vector") -> DataFrame:
    """``(key, cluster, probability)``: the likeliest component and all membership probabilities."""
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                member, _ = mixture.memberships(_points(batch.column(1)))
                columns = [batch.column(0).cast(to_arrow_type(kind)), pa.array(member.argmax(1), pa.int32()), pa.array(member.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [key, "cluster", "probability"])

    return rows.select(key, vector).mapInArrow(run, f"{key} {kind.simpleString()}, cluster int, probability array<double>")

