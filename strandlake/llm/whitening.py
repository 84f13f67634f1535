"""Embedding whitening by LOBPCG (operator 12).

The covariance of the vectors is never formed.  Each step multiplies it by a
block of directions: tasks centre their rows, multiply them by the block and
by their own transpose, and send one partial block each; Spark adds these up.
The driver holds only blocks of dimension x 3 * components numbers.  A step
is a Rayleigh-Ritz projection on the current directions, their residuals and
the previous step's directions.  Steps go on until every wanted component's
residual, computed by a fresh distributed product, is below ``tolerance``
times the largest eigenvalue and no longer falls; only then are the rows
whitened.

Vectors are numbers x = floor(64 * c) + 1000000.  Sums of x and the deviations
are exact; rows are centred as (x - q) - r, q the whole part of the mean and r
the rest, so that no digit is lost to the large offset.

Defined results: a vector that is null, or holds a null or non-finite entry,
is dropped, and so is one shorter than the longest (it lacks entries); rows
may repeat or lack an id, each is a row of its own; x saturates at 2 ** 61 on
either side; a deviation beyond 64 bits is null.  Components without variance
(an eigenvalue under 1e-13 of the largest) can't be whitened and are left out,
so one row, equal rows and an empty table give no row.  Components of equal
eigenvalues are any basis of their space, the same for all rows.  Columns
other than the id and the vector are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, LIMIT = 64, 1_000_000, 1 << 61
#: Numbers of a block of rows in memory at once.
BLOCK = 1 << 20
#: An eigenvalue below this share of the largest counts as zero.
FLAT = 1e-13


@dataclass(frozen=True)
class Fit:
    """Exact sums of the fit list: n rows, and for each dimension the whole part and the rest of S / n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray  # S - n * whole, as Python ints

    @property
    def fraction(self) -> np.ndarray:
        return np.array([r / self.n for r in self.rest])


@dataclass(frozen=True)
class Components:
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    steps: int


def numbers(batch: pa.RecordBatch, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of the usable rows and their x, one row each; column ``v`` holds the vectors."""
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), d), False))
    for at in range(0, batch.num_rows, max(1, BLOCK // d)):
        part = batch.slice(at, max(1, BLOCK // d))
        c = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        good = np.isfinite(c).all(axis=1)
        if not good.all():
            part, c = part.filter(pa.array(good)), c[good]
        with np.errstate(over="ignore"):
            yield part, np.clip(np.floor(SCALE * c), -LIMIT, LIMIT).astype(np.int64) + OFFSET


def vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))


def fit(rows: DataFrame, d: int) -> Fit | None:
    """``rows`` (vec_id, v) -> n and the exact sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for _, x in numbers(batch, d):
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(28,0)")).alias(c)
    got = rows.select("v").mapInArrow(sums, "i long, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), exact("high"), exact("low")).orderBy("i").collect()
    if not got:
        return None
    n, s = got[0].n, [(int(r.high) << 32) + int(r.low) for r in got]
    whole = [x // n for x in s]
    return Fit(n, np.array(whole, dtype=np.int64), np.array([x - n * q for x, q in zip(s, whole, strict=True)], dtype=object))


def product(rows: DataFrame, of: Fit, block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times ``block``, and the covariance's trace, in one pass over the rows."""
    d, m = block.shape
    whole, fraction = of.whole, of.fraction

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, square, n = np.zeros((d, m)), 0.0, 0
        for batch in batches:
            for _, x in numbers(batch, d):
                y = (x - whole) - fraction
                out += y.T @ (y @ block)
                square, n = square + float(np.einsum("ij,ij->", y, y)), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * m + 1)), pa.array(np.r_[out.ravel(), square])], names=["cell", "v"])

    got = rows.select("v").mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(d * m + 1)
    flat[got["cell"].to_numpy()] = got["v"].to_numpy() / of.n
    return flat[:-1].reshape(d, m), float(flat[-1])


def against(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of ``block`` without what lies in ``bases``; directions that are lost to rounding are left out."""
    norm = np.linalg.norm(block, axis=0)
    block = block[:, norm > 0] / norm[norm > 0]
    for _ in range(3):
        for b in bases:
            block = block - b @ (b.T @ block)
        if not block.size:
            break
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8]
    return block


def components(rows: DataFrame, of: Fit, most: int = 32, tolerance: float = 1e-12, guard: int = 8, most_steps: int = 500, seed: int = 1) -> Components:
    """The leading eigenpairs of the covariance, by falling eigenvalue, with certified residuals."""
    d = len(of.whole)
    k, m = min(most, d), min(most + guard, d)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    vx, trace = product(rows, of, x)
    previous, reached = np.zeros((d, 0)), np.inf
    for step in range(1, most_steps + 1):
        inner = x.T @ vx
        e, c = np.linalg.eigh((inner + inner.T) / 2)
        e, c = e[::-1], c[:, ::-1]
        x, vx = x @ c, vx @ c
        residual = vx - x * e
        if e[0] <= 0:
            return Components(e[:0], x[:, :0], trace, 0.0, step)
        worst = float(np.linalg.norm(residual[:, :k], axis=0).max() / e[0])
        if worst <= tolerance and (worst > reached / 2 or worst <= 1e-15):
            kept = e[:k] > FLAT * e[0]
            q, e = x[:, :k][:, kept], e[:k][kept]
            # a fresh product of what is returned certifies it, and gives the covariance of the whitened rows
            vq, trace = product(rows, of, q)
            final = float(np.linalg.norm(vq - q * e, axis=0).max() / e[0])
            if final <= tolerance:
                covariance = (q.T @ vq) / np.sqrt(np.outer(e, e))
                return Components(e, q, trace, float(np.abs(covariance - np.eye(len(e))).max()), step)
        reached = min(reached, worst)
        w = against(residual, x)
        p = against(previous, x, w)
        fresh = np.hstack([w, p])
        if not fresh.size:
            vx, trace = product(rows, of, x)
            continue
        vf, trace = product(rows, of, fresh)
        basis, image = np.hstack([x, fresh]), np.hstack([vx, vf])
        inner = basis.T @ image
        _, c = np.linalg.eigh((inner + inner.T) / 2)
        c = c[:, ::-1][:, :m]
        previous = fresh @ c[m:]
        x, vx = basis @ c, image @ c
        x, r = np.linalg.qr(x)
        vx = np.linalg.solve(r.T, vx.T).T
    raise ArithmeticError(f"residual {worst:.1e} of the largest eigenvalue after {most_steps} steps; {tolerance:.1e} was asked for")


def deviations(x: np.ndarray, of: Fit) -> pa.Array:
    """For each row the exact sum over dimensions of (n * x - S) ** 2; null beyond 64 bits."""
    centred = x - of.whole
    top = of.n * (float(np.abs(centred).max(initial=0)) + 1)
    if top * top * x.shape[1] < 2.0**62:
        y = centred * of.n - of.rest.astype(np.int64)
        return pa.array((y * y).sum(axis=1))
    y = centred.astype(object) * of.n - of.rest
    return pa.array([v if v < 1 << 63 else None for v in (y * y).sum(axis=1)], pa.int64())


def whitened(rows: DataFrame, of: Fit, found: Components) -> DataFrame:
    """A row for each usable vector and component; nothing is shuffled."""
    d, k = found.vectors.shape
    turn, explained = found.vectors / np.sqrt(found.values), found.values / found.trace if k else found.values
    fraction, error = of.fraction, found.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in numbers(batch, d):
                b = len(x)
                if not b or not k:
                    continue
                at = pa.array(np.repeat(np.arange(b), k))
                z = ((x - of.whole) - fraction) @ turn
                columns = [part.column("vec_id").take(at), np.tile(np.arange(1, k + 1, dtype=np.int32), b), np.full(b * k, of.n), deviations(x, of).take(at), z.ravel(), np.tile(explained, b), np.full(b * k, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, most: int = 32, tolerance: float = 1e-12, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error."""
    rows = vectors(rows, id_col, vec_col)
    d = rows.agg(F.max(F.size("v"))).first()[0] or 0
    of = fit(rows, d) if d > 0 else None
    if of is None:
        of, found = Fit(0, np.zeros(1, np.int64), np.zeros(1, object)), Components(np.zeros(0), np.zeros((1, 0)), 0.0, 0.0, 0)
        return whitened(rows.limit(0), Fit(1, of.whole, of.rest), found)
    return whitened(rows, of, components(rows, of, most, tolerance))
