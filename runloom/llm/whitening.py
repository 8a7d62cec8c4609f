"""Whitening of embeddings: leading eigenpairs by Jacobi-Davidson, the covariance never formed.

The driver only holds a basis of a few dozen columns. Each product of the covariance with
a block of columns is one job over the distinct vectors: every block of rows is centred and
multiplied in its task, the tasks' partial products are summed in a few more. Corrections
of several Ritz pairs are solved side by side (MINRES on the projected shifted operator,
one job per step for all of them), the basis grows by them, Rayleigh-Ritz picks the next
pairs, and pairs whose residual is down to double precision are locked.

Entries are integers with a large common offset, so centring is exact first (whole part of
the mean) and rounded once (its fraction).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.session import stage_counted

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**40
"""Entries of a larger magnitude are refused: their squares would leave double precision."""
BLOCK_ROWS = 4096
SUMMED_IN = 4
GUARD, CORRECTED, INNER_STEPS, MOST_OUTER = 8, 8, 8, 200
TIGHT = 32 * np.finfo(float).eps
"""A residual this small, relative to the largest eigenvalue, is at rounding level."""

Operator = Callable[[np.ndarray], np.ndarray]


# -- the eigenproblem: dense numbers of the basis only; ``apply`` is a distributed product


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The block's columns made orthonormal, and orthogonal to the given bases; dependent ones are left out."""
    kept: list[np.ndarray] = []
    for column in block.T:
        size = np.linalg.norm(column)
        if not size > 0 or not np.isfinite(size):
            continue
        v = column / size
        for _ in range(3):
            for basis in against:
                v = v - basis @ (basis.T @ v)
            for other in kept:
                v = v - other * (other @ v)
            left = np.linalg.norm(v)
            if left < 1e-12:
                break
            v = v / left
        else:
            kept.append(v)
    return np.stack(kept, axis=1) if kept else np.zeros((len(block), 0))


def minres(apply: Operator, shifts: np.ndarray, fixed: np.ndarray, own: np.ndarray, rhs: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """Approximate corrections t_j orthogonal to ``fixed`` and ``own[:, j]`` for (A - shift_j) t_j = rhs_j, projected.

    The columns are independent MINRES runs in step, so that one product serves them all.
    A column rests once its residual is below ``goal`` times its right-hand side.
    """

    def project(x: np.ndarray) -> np.ndarray:
        x = x - fixed @ (fixed.T @ x)
        return x - own * (own * x).sum(0)

    v = project(rhs)
    beta = np.linalg.norm(v, axis=0)
    first = beta.copy()
    live = beta > 0
    v = v / np.where(live, beta, 1)
    before = np.zeros_like(v)
    t, w, w_before = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    eta, gamma, gamma_before = beta.copy(), np.ones_like(beta), np.ones_like(beta)
    sigma, sigma_before = np.zeros_like(beta), np.zeros_like(beta)
    carried = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        raw = project(apply(v) - v * shifts)
        alpha = (raw * v).sum(0)
        raw = raw - v * alpha - before * carried
        raw = raw - v * (raw * v).sum(0)
        following = np.linalg.norm(raw, axis=0)
        delta = gamma * alpha - gamma_before * sigma * carried
        rho1 = np.hypot(delta, following)
        rho2 = sigma * alpha + gamma_before * gamma * carried
        rho3 = sigma_before * carried
        live = live & (rho1 > 0)
        safe = np.where(rho1 > 0, rho1, 1)
        gamma_before, sigma_before = gamma, sigma
        gamma, sigma = delta / safe, following / safe
        w_new = (v - w_before * rho3 - w * rho2) / safe
        t = np.where(live, t + w_new * (gamma * eta), t)
        eta = -sigma * eta
        w_before, w = w, w_new
        before, v = v, raw / np.where(following > 0, following, 1)
        carried = following
        live = live & (np.abs(eta) > goal * first) & (following > 0)
    return project(t)


def jacobi_davidson(apply: Operator, width: int, wanted: int, tight: float = TIGHT) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues of a symmetric operator, falling, their unit vectors, and the largest residual.

    A pair is locked when its residual is at most ``tight`` times the largest eigenvalue, or when it
    has stopped falling within a hundred times that, which is rounding of the products themselves.
    """
    wanted = min(wanted, width)
    most = min(width, 3 * (wanted + GUARD))
    locked, values = np.zeros((width, 0)), np.zeros(0)
    basis = _orthonormal(np.random.default_rng(7).standard_normal((width, min(width, wanted + GUARD))))
    image = apply(basis)
    last: dict[int, float] = {}
    worst = 0.0
    for outer in range(MOST_OUTER):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = basis @ turn, image @ turn
        top = max(theta[0] if len(theta) else 0.0, values[0] if len(values) else 0.0)
        rest = ritz_image - ritz * theta
        rest = rest - locked @ (locked.T @ rest)
        sizes = np.linalg.norm(rest, axis=0)
        done = 0
        while done < len(theta) and len(values) + done < wanted:
            size, place = sizes[done], len(values) + done
            stuck = size <= 100 * tight * top and size >= 0.5 * last.get(place, np.inf)
            if not (size <= tight * top or stuck):
                break
            worst = max(worst, float(size))
            done += 1
        last = {len(values) + i: float(s) for i, s in enumerate(sizes)}
        locked, values = np.concatenate([locked, ritz[:, :done]], axis=1), np.concatenate([values, theta[:done]])
        basis, image, theta, rest, sizes = ritz[:, done:], ritz_image[:, done:], theta[done:], rest[:, done:], sizes[done:]
        missing = wanted - len(values)
        if missing <= 0:
            break
        if basis.shape[1] > most - CORRECTED:  # thick restart: the leading Ritz vectors stay
            keep = missing + GUARD
            basis, image = basis[:, :keep], image[:, :keep]
        chosen = slice(0, min(CORRECTED, missing))
        goal = max(2.0 ** -(outer + 1), 1e-3)
        fixed = np.concatenate([locked, basis[:, : chosen.stop]], axis=1)
        t = minres(apply, theta[chosen], fixed, basis[:, chosen], -rest[:, chosen], INNER_STEPS, goal)
        new = _orthonormal(np.concatenate([t, rest[:, chosen]], axis=1)[:, : width - locked.shape[1] - basis.shape[1]], locked, basis)
        if not new.shape[1]:  # the space is exhausted: a fresh direction, or what is here is all there is
            new = _orthonormal(np.random.default_rng(outer).standard_normal((width, 1)), locked, basis)
        if new.shape[1]:
            basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, apply(new)], axis=1)
    else:
        raise RuntimeError(f"{wanted - len(values)} of {wanted} eigenpairs not converged")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order], worst


# -- the covariance of a table of vectors


@dataclass(frozen=True)
class Moments:
    """Size of the fit list and its exact sums, as whole part and rest of the mean."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / max(self.n, 1)


@dataclass(frozen=True)
class Whitener:
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residual: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Exact sum over dimensions of (n x - S)^2; raises where a long cannot hold it."""
        m = self.moments
        off = [x - m.whole, np.broadcast_to(m.rest, x.shape)]
        if float(np.abs(off[0]).max(initial=0) + 1) ** 2 * float(m.n) ** 2 * x.shape[1] < 2.0**62:
            return ((m.n * off[0] - off[1]) ** 2).sum(1)
        exact = ((m.n * off[0].astype(object) - off[1].astype(object)) ** 2).sum(1)
        return np.array(exact, dtype=np.int64)  # OverflowError if too large


def usable() -> Column:
    """Is the vector there, with no null or non-finite entry?"""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of longs as rows; shorter ones are filled up with the x of an entry 0."""
    lengths = np.asarray(pc.list_value_length(vectors), dtype=np.int64)
    values = np.asarray(pc.list_flatten(vectors), dtype=np.int64)
    out = np.full((len(lengths), width), OFFSET, np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, x): usable vectors as whole numbers floor(64 c) + 1000000."""
    too_large = F.exists("embedding", lambda v: F.abs(v.cast("double")) > LARGEST)
    checked = F.when(too_large, F.raise_error(F.lit("an entry is too large to whiten"))).otherwise(
        F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("long") + OFFSET)
    )
    return rows.where(usable()).select("vec_id", checked.alias("x"))


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the fit list as bytes, so that each product starts from ready matrices."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            x = _matrix(batch.column("x").slice(lo, BLOCK_ROWS), width)
            yield pa.record_batch([pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["n", "body"])


def _block_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each block's exact sums of x - OFFSET by dimension."""
    for batch in batches:
        for body in batch.column("body"):
            s = (np.frombuffer(body.as_buffer(), np.int64).reshape(-1, width) - OFFSET).sum(0)
            yield pa.record_batch([pa.array(np.arange(width, dtype=np.int32)), pa.array(s)], names=["dim", "s"])


def _sums(blocks: DataFrame, compute: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of ``compute(x)`` over all blocks, as flat doubles: a row per task, then ``SUMMED_IN`` rows to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for body in batch.column("body"):
                part = compute(np.frombuffer(body.as_buffer(), np.int64).reshape(-1, width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _added(p for batch in batches for p in batch.column("total"))
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = blocks.select("body").mapInArrow(partial, "total binary").repartition(SUMMED_IN).mapInArrow(merged, "total binary")
    return _added(parts.toArrow().column("total"))


def _added(parts) -> np.ndarray | None:
    total = None
    for p in parts:
        part = np.frombuffer(p.as_buffer())
        total = part.copy() if total is None else total + part
    return total


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitener:
    """Eigenpairs of the covariance of the distinct vectors of ``x`` (column x, whole numbers).

    Directions without variance (fewer distinct vectors than dimensions) are no components;
    fewer than two distinct vectors have none.
    """
    spark = x.sparkSession
    width = x.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    if not width:
        return Whitener(Moments(0, np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0.0)
    packed = x.select("x").distinct().mapInArrow(functools.partial(_packed, width=width), "n long, body binary")
    blocks, counted = stage_counted(packed, {"n": F.sum("n")}, "fit_list")
    n = counted["n"]
    sums = blocks.mapInArrow(functools.partial(_block_sums, width=width), "dim int, s long")
    exact = [0] * width
    for r in sums.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # one row per dimension
        exact[r["dim"]] = int(r["s"])
    whole = [OFFSET + s // n for s in exact]
    moments = Moments(n, np.array(whole, np.int64), np.array([s % n for s in exact], np.int64))
    shared = spark.sparkContext.broadcast(moments)
    trace = float(_sums(blocks, lambda v: np.array([(shared.value.centred(v) ** 2).sum()]), width)[0]) / n

    def apply(columns: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(columns)

        def product(v: np.ndarray) -> np.ndarray:
            c = shared.value.centred(v)
            return c.T @ (c @ sent.value)

        found = _sums(blocks, product, width).reshape(columns.shape) / n
        sent.unpersist()
        return found

    values, vectors, residual = jacobi_davidson(apply, width, components)
    real = values > max(trace, 0.0) * width * np.finfo(float).eps
    values, vectors = values[real], vectors[:, real]
    k = len(values)
    if not k:
        return Whitener(moments, values, vectors, trace, 0.0, residual)
    axes = spark.sparkContext.broadcast(vectors / np.sqrt(values))

    def second(v: np.ndarray) -> np.ndarray:
        w = shared.value.centred(v) @ axes.value
        return np.concatenate([w.T @ w, w.sum(0, keepdims=True)])

    found = _sums(blocks, second, width).reshape(k + 1, k) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return Whitener(moments, values, vectors, trace, error, residual)


ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    w: Whitener = model.value
    k, width = len(w.values), len(w.moments.whole)
    explained = w.values / w.trace
    for whole in batches:
        for batch in (whole.slice(lo, BLOCK_ROWS) for lo in range(0, whole.num_rows, BLOCK_ROWS)):
            x, m = _matrix(batch.column("x"), width), batch.num_rows
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            columns = [
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.moments.n)),
                pa.array(np.repeat(w.deviation(x), k)), pa.array(w.whiten(x).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, w.identity_error)),
            ]
            yield pa.record_batch(columns, names=[c.split()[0] for c in ROWS.split(", ")])


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``rows``: (vec_id, embedding). A row per usable vector and component, columns of ``ROWS``.

    Vectors that are null or hold a null or non-finite entry have no rows. Repeated rows and rows
    without vec_id keep theirs; repeated vectors count once in the fit. Shorter vectors (an empty one
    too) are filled up with zeros. There are at most as many components as directions with variance, so an empty
    table and a table of equal vectors give no rows.
    """
    x = integers(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    model = fit(x, components)
    if not len(model.values):
        return rows.sparkSession.createDataFrame([], ROWS)
    return x.mapInArrow(functools.partial(_whitened, model=rows.sparkSession.sparkContext.broadcast(model)), ROWS)
