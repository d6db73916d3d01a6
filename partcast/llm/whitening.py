"""Whitening of embeddings: principal components by shifted CholeskyQR.

Entries become whole numbers, floor(256 c).  The fit list holds each different vector once;
n is its size, S its sums.  The centred rows A are never formed as a table: every pass
reads the fit list, centres each row, applies the triangular factors found so far by forward
substitution, and adds up the d x d Gram matrix Q'Q of what results, task by task.  The first
pass adds a shift to the Gram matrix before its Cholesky factor is taken, so that badly
scaled directions do not break it; the next passes make the rows orthogonal to double
precision.  With A = Q R, R the product of the factors, the singular values and right vectors
of the small R give the covariance's eigenvalues (s^2 / n) and components.

Sums S are exact (whole numbers).  What reaches the driver is d sums and d (d + 1) / 2 Gram
cells a pass, combined by a shuffle: it depends on the dimensions, not on the rows.

Defined results: rows whose vector is null or holds null or non-finite entries are left out;
so are rows whose length is not that of most rows (the longer of equally frequent lengths);
repeated vectors are fitted once and returned for each row; an entry too large for a long
is the largest long; a deviation that no long holds is null; without any variance there is no
direction: ``whitened`` is null for components of no variance, ``explained`` is 0 for them
and null where the total is 0, ``identity_error`` covers the others; vectors of fewer than
four dimensions have as many components; equal eigenvalues have components in any rotation,
the same for all rows; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm.base import materialise

#: Components returned; entries are floor(SCALE * c); passes after which no more are made.
COMPONENTS, SCALE, PASSES = 4, 256, 6
#: Q'Q is taken for the identity when no cell is further off than this.
SETTLED = 1e-13
#: A component below this share of the whole variance has none.
NO_VARIANCE = 1e-14
_LONG = 2**63 - 1


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (array of longs) of the rows that remain."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = embeddings.where(F.col("embedding").isNotNull()).where(~bad).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == (common["d"] if common else 0))


def _matrices(batches, column: int = 0):
    """The batches that have rows, with the vectors of a column as a matrix."""
    for batch in batches:
        if len(batch):
            vectors = batch.column(column)
            yield batch, np.asarray(vectors.flatten()).reshape(len(vectors), -1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in longs where they fit, else in Python's whole numbers."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * largest + max(map(abs, sums), default=0) <= _LONG:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def squared_lengths(dev: np.ndarray) -> list[int | None]:
    if dev.dtype != object:
        largest = max(int(dev.max(initial=0)), -int(dev.min(initial=0)))
        if largest**2 * dev.shape[1] <= _LONG:
            return (dev * dev).sum(axis=1).tolist()
    exact = (sum(int(v) ** 2 for v in row) for row in dev)
    return [v if v <= _LONG else None for v in exact]


def _solve(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverses of the upper triangular factors, one after another."""
    for r in factors:
        q = np.empty_like(rows)
        for j in range(rows.shape[1]):
            q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        rows = q
    return rows


def _sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sum of each dimension."""
    def run(batches):
        import pyarrow as pa

        total = [0] * d
        for _, x in _matrices(batches):
            small = np.abs(x).max(initial=0) < 2**40 and x.min(initial=0) > -2**40
            total = [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(v) for v in total])], names=["i", "v"])

    parts = fit.mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {r["i"]: int(r["v"]) for r in parts.collect()}      # d rows
    return [found.get(i, 0) for i in range(d)]


def _gram(fit: DataFrame, width: int, rows_of) -> np.ndarray:
    """Sum of q'q over the rows q that ``rows_of`` makes of a batch's vectors."""
    upper = np.triu_indices(width)

    def run(batches):
        import pyarrow as pa

        total = np.zeros((width, width))
        for _, x in _matrices(batches):
            q = rows_of(x)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int64()), pa.array(total[upper])], names=["cell", "v"])

    cells = fit.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    gram = np.zeros((width, width))
    for r in cells.collect():                                  # width (width + 1) / 2 rows
        i, j = upper[0][r["cell"]], upper[1][r["cell"]]
        gram[i, j] = gram[j, i] = r["v"]
    return gram


def _cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper factor of gram + shift, the shift raised where it does not do."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, 1e-14 * float(np.trace(gram)), np.finfo(float).tiny)


@dataclass(frozen=True)
class Whitening:
    """n, S, the unit components (rows) with their eigenvalues, and the whole variance."""
    n: int
    sums: list
    components: np.ndarray
    eigenvalues: np.ndarray
    variance: float

    def project(self, dev: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows n x - S; a column each component with variance."""
        some = self.eigenvalues > NO_VARIANCE * self.variance
        centred = (dev / self.n).astype(float)
        return centred @ self.components[some].T / np.sqrt(self.eigenvalues[some])


def fit_whitening(fit: DataFrame, count: int = COMPONENTS) -> Whitening:
    """Shifted CholeskyQR over the fit list (column x, different vectors)."""
    row = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = row["n"], row["d"] or 0
    if not n or not d:
        return Whitening(n, [0] * d, np.zeros((0, d)), np.zeros(0), 0.0)
    sums = _sums(fit, d)
    factors: list[np.ndarray] = []
    for step in range(PASSES):
        done = tuple(factors)
        gram = _gram(fit, d, lambda x: _solve((deviations(x, n, sums) / n).astype(float), list(done)))
        trace = float(np.trace(gram))
        if not step:
            if not trace > 0:
                return Whitening(n, sums, np.eye(d)[:count], np.zeros(min(count, d)), 0.0)
            unit = np.finfo(float).eps / 2
            shift = 11 * (n * d + d * (d + 1)) * unit * float(np.linalg.eigvalsh(gram)[-1])
        else:
            shift = 0.0
        if step and np.abs(gram - np.eye(d)).max() <= SETTLED * max(1.0, d / 64):
            break
        factors.append(_cholesky(gram, shift))
    r = np.eye(d)
    for f in factors:
        r = f @ r
    _, s, right = np.linalg.svd(r)
    components = right[:count]
    lead = components[np.arange(len(components)), np.abs(components).argmax(axis=1)]
    components = components * np.sign(lead)[:, None]
    return Whitening(n, sums, components, s[:count] ** 2 / n, float((s**2).sum() / n))


def identity_error(fit: DataFrame, w: Whitening) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, by a pass of its own."""
    width = int((w.eigenvalues > NO_VARIANCE * w.variance).sum())
    if not width:
        return None
    cov = _gram(fit, width, lambda x: w.project(deviations(x, w.n, w.sums))) / w.n
    return float(np.abs(cov - np.eye(width)).max())


def whiten(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for every
    remaining vector and component."""
    rows = whole_numbers(embeddings)
    fit = materialise(rows.select("x").distinct(), "fit-list")
    w = fit_whitening(fit)
    error, k = identity_error(fit, w), len(w.eigenvalues)
    some = w.eigenvalues > NO_VARIANCE * w.variance
    explained = [float(e) / w.variance if ok else 0.0 for e, ok in zip(w.eigenvalues, some)] if w.variance > 0 else [None] * k

    def run(batches):
        import pyarrow as pa

        for batch, x in _matrices(batches, 1):
            dev = deviations(x, w.n, w.sums)
            white = np.full((len(dev), k), np.nan)
            white[:, some] = w.project(dev)
            none = np.isnan(white).reshape(-1)
            each = np.repeat(np.arange(len(dev)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(dev)), pa.int32()), pa.array(np.full(len(each), w.n), pa.int64()),
                 pa.array(squared_lengths(dev), pa.int64()).take(pa.array(each)), pa.array(white.reshape(-1), pa.float64(), mask=none),
                 pa.array(explained * len(dev), pa.float64()), pa.array([error] * len(each), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
