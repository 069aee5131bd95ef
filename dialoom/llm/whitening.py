"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Entries become whole numbers x = floor(64 c) + 1,000,000. The fit list is every different x vector once. One pass over
it sums x per dimension exactly; a second one sums products of x less the rounded mean, so nothing cancels, and the
remainder of the mean is taken off the d x d sum afterwards. That scatter matrix A is factored as A = P L L' P' with the
largest remaining diagonal entry as the next pivot, up to its numerical rank. Rotating pairs of columns of L until all
are orthogonal gives L V = U S: squared column norms over n are the eigenvalues of the covariance, columns divided by
their norms its eigenvectors, small ones too to full relative precision. A third pass measures the covariance of the
whitened fit list, a last one projects all rows.

What leaves the tasks is d sums, d (d + 1) / 2 products and k (k + 1) / 2 whitened products a partition, summed by Spark;
the driver holds d x d numbers (d: the vectors' length), never vectors. Hot copies of a vector collapse before the
shuffle of the fit list.

Defined cases: rows whose vector is null or empty, or holds a null, a non-finite entry or one beyond 2^40, are dropped;
so are rows of another length than that of most different vectors (ties: the longer). Repeated rows and ids are
whitened each. Fewer than two different vectors have no component, and a covariance of lower rank has fewer components
than asked: only those with a pivot above rounding are returned. A deviation that doesn't fit in a long is null. An
empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, whole_partition, written

SCALE, SHIFT = 64.0, 1_000_000
BOUND = 2.0**40                                               # of an entry: sums of a batch stay within longs
WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))
SWEEPS = 100


def pack(x: np.ndarray) -> list[bytes]:
    """x vectors as bytes: the narrowest whole numbers that hold x less the shift; equal vectors have equal bytes."""
    y = x - SHIFT
    top = np.abs(y).max(1)
    kind = (top > 32_767).astype(int) + (top > 2_147_483_647)
    out: list[bytes] = [b""] * len(y)
    for k, dtype in enumerate(WIDTHS):
        at = np.flatnonzero(kind == k)
        for i, row in zip(at.tolist(), y[at].astype(dtype)):
            out[i] = bytes([k]) + row.tobytes()
    return out


def unpack(cells: list[bytes]) -> np.ndarray:
    """x vectors (of one length) back from bytes."""
    kind = np.fromiter((c[0] for c in cells), np.int64, len(cells))
    dim = (len(cells[0]) - 1) // WIDTHS[kind[0]].itemsize
    out = np.empty((len(cells), dim), np.int64)
    for k, dtype in enumerate(WIDTHS):
        at = np.flatnonzero(kind == k)
        out[at] = np.frombuffer(b"".join(cells[i][1:] for i in at.tolist()), dtype).reshape(len(at), dim)
    return out + SHIFT


def positions(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, the rows that are usable and their x vectors."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)      # nulls become NaN
    with np.errstate(invalid="ignore"):
        good = np.abs(flat) <= BOUND
    start = np.cumsum(lengths) - lengths
    found = {}
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        at = start[rows][:, None] + np.arange(d)
        keep = good[at].all(1)
        if keep.any():
            found[d] = (rows[keep], np.floor(SCALE * flat[at[keep]]).astype(np.int64) + SHIFT)
    return found


def vectors(source: DataFrame) -> DataFrame:
    """dim and x (bytes) of usable rows."""

    def step(batch):
        for d, (_, x) in positions(batch.column("v")).items():
            yield {"dim": np.full(len(x), d, np.int64), "x": pack(x)}

    return arrow_map(source.select("v"), step, {"dim": "long", "x": "binary"})


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors, and exact sums per dimension."""

    @whole_partition
    def step(batches):
        n, s = 0, None
        for batch in batches:
            if batch.num_rows:
                x = unpack(batch.column("x").to_pylist())
                n += len(x)
                add = [int(v) for v in x.sum(0)]                        
                s = add if s is None else [a + b for a, b in zip(s, add)]
        if n:
            yield {"i": [-1, *range(len(s))], "s": [str(n), *map(str, s)]}

    got = arrow_map(fit.select("x"), step, {"i": "long", "s": "string"}).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by = {r["i"]: int(r["s"]) for r in got.collect()}
    return by.pop(-1, 0), [by[i] for i in sorted(by)]


def summed_products(fit: DataFrame, rows_of) -> np.ndarray:
    """Sum over all vectors of the outer products of what `rows_of` makes of them."""

    @whole_partition
    def step(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = rows_of(unpack(batch.column("x").to_pylist()))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield {"i": i, "j": j, "s": total[i, j]}

    got = arrow_map(fit.select("x"), step, {"i": "long", "j": "long", "s": "double"}).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    d = 1 + max(r["j"] for r in got)
    out = np.empty((d, d))
    for i, j, s in got:
        out[i, j] = out[j, i] = s
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (d x rank, rows in the order of `a`) with L L' = a, the largest remaining diagonal entry first."""
    a, d = a.copy(), len(a)
    left = np.diag(a).copy()
    floor = 4 * d * np.finfo(float).eps * max(left.max(), 0.0)
    columns, done = [], np.zeros(d, bool)
    for _ in range(d):
        p = int(np.argmax(np.where(done, -np.inf, left)))
        if done[p] or left[p] <= floor:
            break
        column = a[:, p].copy()
        for c in columns:
            column -= c * c[p]
        column[done] = 0.0
        column /= np.sqrt(left[p])
        column[p] = np.sqrt(left[p])
        done[p] = True
        left -= column**2
        columns.append(column)
    return np.array(columns).T if columns else np.empty((d, 0))


def jacobi(l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns rotated until orthogonal: (squared norms, unit columns), largest first.

    Pairs are met in rounds of a tournament; the pairs of a round have no column in common and turn together."""
    w = l.copy()
    if w.shape[1] % 2:
        w = np.column_stack((w, np.zeros(len(w))))
    r = w.shape[1]
    seats, tiny = np.arange(r), np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for _ in range(r - 1):
            p, q = seats[: r // 2], seats[r // 2:][::-1]
            a, b = w[:, p], w[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            far = np.abs(ab) > tiny * np.sqrt(aa * bb)
            if far.any():
                turned = True
                a, b, p, q = a[:, far], b[:, far], p[far], q[far]
                zeta = (bb[far] - aa[far]) / (2 * ab[far])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                w[:, p], w[:, q] = cos * a - cos * t * b, cos * t * a + cos * b
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if not turned:
            break
    norms = (w * w).sum(0)
    order = np.argsort(-norms, kind="stable")[: l.shape[1]]
    return norms[order], w[:, order] / np.sqrt(norms[order])


def whitened(table: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = table.sparkSession
    source = table.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    found = written(vectors(source).distinct(), "fit-list")
    lengths = found.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    out = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
    if lengths is None or lengths["n"] < 2:
        return arrow_map(source.limit(0), lambda batch: iter(()), out, keep=["vec_id"]).withColumnRenamed("vec_id", id_col)
    dim = lengths["dim"]
    fit = found.where(F.col("dim") == dim)
    n, s = sums(fit)
    near = np.array([round(Fraction(v, n)) for v in s], np.int64)             # the rounded mean
    rest = [v - n * int(m) for v, m in zip(s, near)]                          # n * (mean - rounded mean), exact
    delta = np.array([v / n for v in rest])
    scatter = summed_products(fit, lambda x: (x - near).astype(np.float64)) - n * np.outer(delta, delta)
    norms, axes = jacobi(pivoted_cholesky(scatter))
    norms, axes = norms[:components], axes[:, :components]
    share = norms / np.trace(scatter)
    project = axes / np.sqrt(norms / n)
    covariance = summed_products(fit, lambda x: ((x - near) - delta) @ project) / n
    error = float(np.abs(covariance - np.eye(len(norms))).max())
    k = len(norms)
    model = spark.sparkContext.broadcast((near, delta, project, share, rest))

    def step(batch):
        near, delta, project, share, rest = model.value
        rows, x = positions(batch.column("v")).get(dim, (None, None))
        if x is None:
            return
        y = x - near
        top = n * int(np.abs(y).max()) + max(abs(v) for v in rest)
        if top * top * dim < 2**63:
            off = n * y - np.array(rest, np.int64)
            deviation = (off * off).sum(1).tolist()
        else:
            deviation = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]
            deviation = [v if v < 2**63 else None for v in deviation]
        yield {"vec_id": batch.column("vec_id").take(pa.array(np.repeat(rows, k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)),
               "n": np.full(len(rows) * k, n, np.int64), "deviation": pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
               "whitened": ((y - delta) @ project).ravel(), "explained": np.tile(share, len(rows)), "identity_error": np.full(len(rows) * k, error)}

    return arrow_map(source, step, out, keep=["vec_id"]).withColumnRenamed("vec_id", id_col)
