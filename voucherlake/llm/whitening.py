"""Whitening of embeddings: leading eigenvectors of the covariance by a block Jacobi-Davidson method, without the matrix.

The only thing done with the covariance V is V times a few vectors: one pass over the distinct vectors, centred in the
tasks, whose partial products are summed. On the driver lie the search space (vectors of one embedding's size) and
numbers of that size. Each round Rayleigh-Ritz takes the best vectors of the search space; those whose residual has
reached double precision are locked; for the others the projected correction equations
(1 - UU')(V - theta)(1 - UU') t = -r are solved by MINRES, all of them in step, so that one pass serves all, and the
corrections widen the space. A full space is cut back to its best Ritz vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlake.llm.staging import staged

#: Vectors in one stored block; search space at the most and after a cut; MINRES steps; rounds; residual over the largest value.
BLOCK_ROWS, SPACE, AFTER_CUT, INNER, ROUNDS = 4096, 40, 12, 5, 200
#: Stored bytes that one task multiplies, and partial sums that one task adds up.
TASK_BYTES, FAN_IN = 32 << 20, 1024
PRECISION = 64 * np.finfo(float).eps
SCALE = 256
Product = Callable[[np.ndarray], np.ndarray]


class Components(NamedTuple):
    """What whitening needs: distinct vectors, their sums, eigenvalues and vectors, the trace, and the error of the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None
    rounds: int
    passes: int


def _codes(vectors: pa.Array) -> Iterator[tuple[int, bytes] | None]:
    """(entries, packed whole numbers floor(SCALE * entry)) of each vector, None where it is null or not finite throughout.

    Equal numbers give equal bytes: each vector is packed as narrowly as its largest number allows.
    """
    for vector in vectors:
        values = vector.values
        if not vector.is_valid or values.null_count:
            yield None
            continue
        entries = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(entries).all():
            yield None
            continue
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(SCALE * entries), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        most = max(int(whole.max()), -int(whole.min()) - 1) if len(whole) else 0
        width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
        yield len(whole), bytes([width]) + whole.astype(f"<i{width}").tobytes()


def _whole(code: bytes) -> np.ndarray:
    return np.frombuffer(code, f"<i{code[0]}", offset=1).astype(np.int64)


def _packed(rows: DataFrame) -> DataFrame:
    """(vec_id, entries, code) of the rows (vec_id, embedding) that hold a finite vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = list(_codes(batch.column(1)))
            kept = [i for i, code in enumerate(codes) if code is not None]
            columns = [
                batch.column(0).take(pa.array(kept, pa.int64())),
                pa.array([codes[i][0] for i in kept], pa.int32()),
                pa.array([codes[i][1] for i in kept], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "entries", "code"])

    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInArrow(run, "vec_id long, entries int, code binary")


def _blocks(codes: DataFrame, size: int) -> DataFrame:
    """(rows, block): the vectors of so many distinct codes as one piece of doubles, and their exact sums as (high, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            for at in range(0, len(found), BLOCK_ROWS):
                whole = np.stack([_whole(code) for code in found[at : at + BLOCK_ROWS]])
                narrow = np.abs(whole).max(initial=0) < 1 << 24
                block = whole.astype("<f4" if narrow else "<f8").tobytes()
                high, low = (whole >> 32).sum(axis=0), (whole & 0xFFFFFFFF).sum(axis=0)
                columns = [
                    pa.array([len(whole)], pa.int64()),
                    pa.array([block], pa.binary()),
                    pa.array([high], pa.list_(pa.int64())),
                    pa.array([low], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["rows", "block", "high", "low"])

    return codes.mapInArrow(run, "rows long, block binary, high array<long>, low array<long>")


def _sums(blocks: DataFrame, size: int) -> tuple[int, list[int]]:
    """(n, exact sums by entry); size rows come to the driver."""
    both = F.arrays_zip("high", "low")
    parts = blocks.select("rows", F.posexplode(both).alias("i", "s")).groupBy("i")
    wide = "decimal(38,0)"
    found = parts.agg(F.sum("rows").alias("n"), F.sum(F.col("s.high").cast(wide)).alias("h"), F.sum(F.col("s.low").cast(wide)).alias("l"))
    rows = found.collect()
    sums = [0] * size
    for r in rows:
        sums[r["i"]] = (int(r["h"]) << 32) + int(r["l"])
    return (rows[0]["n"] if rows else 0), sums


def _over_blocks(blocks: DataFrame, tasks: int, size: int, shape: int, of: Callable[[np.ndarray], np.ndarray], mean: np.ndarray) -> np.ndarray:
    """The sum over all blocks of `of(centred block)`, an array of `shape` numbers, in one pass.

    Each task gives one partial sum; FAN_IN of them are added in a task, and the driver adds what these give.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for rows, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = block.as_buffer()
                x = np.frombuffer(raw, "<f4" if len(raw) == 4 * rows * size else "<f8").reshape(rows, size) - mean
                total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = blocks.select("rows", "block").mapInArrow(summed, "part binary")
    sums = parts.repartition(-(-tasks // FAN_IN)).mapInArrow(added, "part binary")
    return sum((np.frombuffer(row.part) for row in sums.collect()), np.zeros(shape))


def _minres(theta: float, locked: np.ndarray, residual: np.ndarray, steps: int, least: float) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """MINRES for (1 - UU')(V - theta)(1 - UU') t = -residual, U the columns of locked: yields a vector, is sent V times it."""

    def aside(v: np.ndarray) -> np.ndarray:
        return v - locked @ (locked.T @ v)

    b = aside(-residual)
    beta = float(np.linalg.norm(b))
    t = np.zeros_like(b)
    if beta == 0:
        return t
    v_old, v, start = np.zeros_like(b), b / beta, beta
    d_old, d = np.zeros_like(b), np.zeros_like(b)
    c_old, c, s_old, s, eta = 1.0, 1.0, 0.0, 0.0, beta
    beta = 0.0
    for _ in range(steps):
        w = aside((yield v) - theta * v)
        alpha = float(v @ w)
        w = w - alpha * v - beta * v_old
        beta_next = float(np.linalg.norm(w))
        delta, rho2 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta
        rho3 = s_old * beta
        rho1 = float(np.hypot(delta, beta_next))
        if rho1 == 0:
            break
        c_old, s_old = c, s
        c, s = delta / rho1, beta_next / rho1
        d_old, d = d, (v - rho3 * d_old - rho2 * d) / rho1
        t = t + c * eta * d
        eta = -s * eta
        if abs(eta) <= least * start or beta_next <= 1e-300:
            break
        v_old, v, beta = v, w / beta_next, beta_next
    return aside(t)


def _in_step(solvers: list[Generator], product: Product) -> list[np.ndarray]:
    """Runs the solvers side by side: what they wait for is multiplied in one pass."""
    done: list[np.ndarray | None] = [None] * len(solvers)
    waiting: dict[int, np.ndarray] = {}

    def resume(i: int, sent: np.ndarray | None) -> None:
        try:
            waiting[i] = solvers[i].send(sent)
        except StopIteration as end:
            done[i] = end.value
            waiting.pop(i, None)

    for i in range(len(solvers)):
        resume(i, None)
    while waiting:
        order = sorted(waiting)
        products = product(np.stack([waiting[i] for i in order], axis=1))
        for k, i in enumerate(order):
            resume(i, products[:, k])
    return done


def jacobi_davidson(product: Product, size: int, count: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, unit eigenvectors as columns, rounds) of the `count` largest of a symmetric matrix, given its product."""
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    fresh = np.random.default_rng(11).standard_normal((size, min(size, 2 * count)))
    scale = 0.0
    for rounds in range(1, ROUNDS + 1):
        added = []
        for column in fresh.T:
            column = column / max(np.linalg.norm(column), 1e-300)
            for _ in range(3):  # so that rounding leaves nothing along the basis
                column = column - basis @ (basis.T @ column)
                for other in added:
                    column = column - other * (other @ column)
                length = np.linalg.norm(column)
                if length < 1e-8:
                    break
                column = column / length
            else:
                if basis.shape[1] + len(added) < size:
                    added.append(column)
        if added:
            new = np.stack(added, axis=1)
            basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
        small = basis.T @ image
        theta, turns = np.linalg.eigh((small + small.T) / 2)
        theta, turns = theta[::-1], turns[:, ::-1]
        scale = max(scale, float(np.abs(theta).max(initial=0)))
        ritz, told = basis @ turns[:, :count], image @ turns[:, :count]
        residuals = told - ritz * theta[:count]
        open_pairs = [k for k in range(ritz.shape[1]) if np.linalg.norm(residuals[:, k]) > PRECISION * scale]
        if not open_pairs or not added:
            # what was carried through turns of the space is rounded: look at the products themselves once
            exact = product(ritz)
            residuals = exact - ritz * np.sum(ritz * exact, axis=0)
            if not added or np.linalg.norm(residuals, axis=0).max(initial=0) <= PRECISION * scale:
                return np.sum(ritz * exact, axis=0), ritz, rounds
            basis, image = ritz, exact
            open_pairs = list(range(ritz.shape[1]))
        elif basis.shape[1] + len(open_pairs) > min(SPACE, size):
            if basis.shape[1] >= size:
                fresh = np.zeros((size, 0))
                continue
            keep = min(AFTER_CUT, basis.shape[1])
            basis, image = basis @ turns[:, :keep], image @ turns[:, :keep]
        least = max(1e-2 * 0.25**rounds, 1e-6)
        solvers = [_minres(float(theta[k]), ritz[:, : k + 1], residuals[:, k], INNER, least) for k in open_pairs]
        fresh = np.stack(_in_step(solvers, product), axis=1)
    raise ArithmeticError(f"eigenvectors did not reach double precision in {ROUNDS} rounds")


def components(codes: DataFrame, size: int, count: int = 4) -> Components:
    """The leading components of the distinct codes (code) of vectors with `size` entries; those without variance are left out."""
    stored = codes.agg(F.sum(F.length("code"))).first()[0] or 0
    tasks = max(codes.sparkSession.sparkContext.defaultParallelism, -(-stored // TASK_BYTES))
    blocks = staged(_blocks(codes.coalesce(tasks), size), "blocks")
    n, sums = _sums(blocks, size)
    if not n or not size:
        return Components(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0, None, 0, 0)
    mean = np.array([total / n for total in sums])
    passes = 0

    def product(vectors: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        total = _over_blocks(blocks, tasks, size, vectors.size, lambda x: (x.T @ (x @ vectors)).ravel(), mean)
        return total.reshape(vectors.shape) / n

    trace = float(_over_blocks(blocks, tasks, size, 1, lambda x: np.array([np.vdot(x, x)]), mean)[0]) / n
    if trace == 0:
        return Components(n, sums, np.zeros(0), np.zeros((size, 0)), trace, None, 0, 1)
    values, vectors, rounds = jacobi_davidson(product, size, min(count, size))
    real = values > size * np.finfo(float).eps * trace
    values, vectors = values[real], vectors[:, real]
    scaled, k = vectors / np.sqrt(values), len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        y = x @ scaled
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    found = _over_blocks(blocks, tasks, size, k + k * k, moments, mean) / n
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return Components(n, sums, values, vectors, trace, float(np.abs(covariance - np.eye(k)).max(initial=0)), rounds, passes)


def _deviations(whole: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over the entries of (n * x - sum)^2 of each row, exact; None where it is beyond 64 bits."""
    widest = max((abs(n * int(x)) for x in (whole.max(initial=0), whole.min(initial=0))), default=0) + max(map(abs, sums), default=0)
    if widest * widest * max(1, len(sums)) < 1 << 63:
        apart = n * whole - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = whole.astype(object) * n - np.array(sums, object)
    return [d if d < 1 << 63 else None for d in (apart * apart).sum(axis=1).tolist()]


def whiten(rows: DataFrame, count: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row with a finite vector and each component.

    rows: (vec_id, embedding). Rows whose vector is null, or holds null or non-finite entries, are dropped. An entry counts as
    floor(256 * entry). The fit list is each distinct vector once: n vectors, whose mean and covariance (divisor n) whitening uses.
    component: from 1 by falling eigenvalue, `count` at most; vectors without variance in so many directions have fewer, and a
    table whose vectors are all equal has none and gives no rows. deviation: the exact sum of (n * x - sum)^2 over the entries,
    null beyond 64 bits; whitened: the centred vector along the unit eigenvector over the root of its eigenvalue; explained: the
    eigenvalue's share of the trace; identity_error: the largest entry of whitened's covariance minus the identity.
    All vectors have one size; should a table mix sizes, the one with most distinct vectors counts (of equals the larger) and rows of
    other sizes have no coordinates and are dropped. Repeated and null vec_ids keep their rows; other columns are not read.
    """
    packed = staged(_packed(rows), "vectors")
    distinct = staged(packed.groupBy("code").agg(F.first("entries").alias("entries")), "distinct")
    sizes = distinct.groupBy("entries").count().orderBy(F.desc("count"), F.desc("entries")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None or not sizes["entries"]:
        return packed.sparkSession.createDataFrame([], schema)
    size = int(sizes["entries"])
    fit = components(distinct.where(F.col("entries") == size).select("code"), size, count)
    k, scaled = len(fit.values), fit.vectors / np.sqrt(fit.values)
    mean = np.array([total / max(1, fit.n) for total in fit.sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            whole = np.stack([_whole(code) for code in batch.column(1).to_pylist()])
            several = np.repeat(np.arange(len(whole)), k)
            columns = [
                batch.column(0).take(pa.array(several)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(whole))),
                pa.array(np.full(len(several), fit.n, np.int64)),
                pa.array(_deviations(whole, fit.n, fit.sums), pa.int64()).take(pa.array(several)),
                pa.array(((whole - mean) @ scaled).ravel()),
                pa.array(np.tile(fit.values / fit.trace, len(whole))),
                pa.array(np.full(len(several), fit.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [part.split(" ")[0] for part in schema.split(", ")])

    return packed.where(F.col("entries") == size).select("vec_id", "code").mapInArrow(run, schema)
