"""Whitening of embeddings on their principal components, found by contour integration (FEAST).

Entries are counted as whole numbers x = floor(64 c) + 1000000. Two passes give the covariance V exactly: the first
sums every dimension, the second sums products of entries centred on the rounded means, in integers, and the rest of
the centring is exact too. So V doesn't depend on how rows are dealt, and each of its entries is a correctly rounded double.

Components: inertia counts (the signs of an LDL' factorisation of V - s I tell how many eigenvalues lie below s) bracket
the leading eigenvalues and cut the spectrum in its gaps into intervals of few eigenvalues each. For every interval one
task solves (z I - V) Y = B at complex points z of a circle through its ends, sums the solutions by Gauss-Legendre
quadrature to a projection on the interval's eigenvectors, and extracts Ritz pairs from it (Rayleigh-Ritz), until residuals
are at rounding level. An interval is accepted only if it yields as many eigenvalues as the inertia counts
of its ends differ by; else the search space grows. A last Rayleigh-Ritz step over all intervals makes the vectors
orthogonal across them, and the number of components found is compared with the inertia count once more.

Size: vectors are written once, as whole numbers, and read in parallel by each pass. What is collected or sent to tasks
has d x d numbers for d dimensions, whatever the number of rows. Partial products are summed by Spark.

Defined cases: a vector is left out if it is null or has an entry that is null, not finite or beyond 2^40; where
vectors differ in length, those of the commonest length (of equally common ones, the longer) are taken. Ids may
be null or repeated: every row is one vector. Equal eigenvalues have any orthonormal vectors, the same for all
rows; a component's largest entry is positive. Directions with less than 1e-10 of the variance can't be scaled and are
not returned, so one vector, or equal ones, give no rows; an empty table gives none. ``deviation`` is null beyond
the range of a long. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvgrid.llm.common import map_arrow, map_batches, stage

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
LIMIT = float(1 << 40)
#: Eigenvalues below this share of the variance count as zero.
FLAT = 1e-10
#: Most eigenvalues of an interval, unless they lie too close to be told apart.
PER_INTERVAL = 8
NODES = 8
ROUNDS = 40
EXACT = 1 << 53  # whole numbers below it are exact as doubles

WHOLE = T.DecimalType(38, 0)


# -- inertia -----------------------------------------------------------------

def below(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric ``v`` below ``shift``: negative pivots of LDL' with 1x1 and 2x2 pivots."""
    a = v - shift * np.eye(len(v))
    alpha, negative = (1 + 17 ** 0.5) / 8, 0
    while (n := len(a)) > 0:
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if n > 1 else 0
        most = column[r - 1] if n > 1 else 0.0
        if most == 0.0 or abs(a[0, 0]) >= alpha * most:
            pivot = 0
        else:
            rest = np.abs(a[r])
            rest[r] = 0.0
            wide = rest.max()
            pivot = 0 if abs(a[0, 0]) * wide >= alpha * most ** 2 else r if abs(a[r, r]) >= alpha * wide else None
        if pivot is not None:
            if pivot:
                _swap(a, 0, pivot)
            negative += a[0, 0] < 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0] / a[0, 0]) if a[0, 0] != 0 else a[1:, 1:]
        else:
            _swap(a, 1, r)
            negative += 1  # a 2x2 pivot has one eigenvalue of each sign
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
    return int(negative)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    a[[i, j]] = a[[j, i]]
    a[:, [i, j]] = a[:, [j, i]]


# -- intervals ---------------------------------------------------------------

def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues) of disjoint intervals that hold the ``wanted`` largest, cut in gaps."""
    d, size = len(v), float(np.trace(v))
    top = float(np.abs(v).sum(axis=1).max()) * 1.01
    floor = FLAT * size
    counts: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = d - below(v, s)
        return counts[s]

    usable = above(floor)
    wanted = min(wanted, usable)
    if not wanted:
        return []

    def bracket(k: int) -> tuple[float, float]:
        """Narrow bounds of the k-th largest eigenvalue, k from 1."""
        lo = max([floor, *(s for s, c in counts.items() if c >= k)])
        hi = min([top, *(s for s, c in counts.items() if c < k and s > lo)])
        while hi - lo > 1e-3 * hi:
            mid = (lo * hi) ** 0.5 if lo > 0 and hi > 2 * lo else (lo + hi) / 2
            lo, hi = (mid, hi) if above(mid) >= k else (lo, mid)
        return lo, hi

    cuts, at, places = [top], 0, []
    while at < wanted:
        # the next eigenvalues, as far as the interval may reach, and one beyond
        gaps = []
        k = at
        while k < usable:
            k += 1
            while len(places) < min(k + 1, usable):
                places.append(bracket(len(places) + 1))
            low = places[k - 1][0]
            nxt = places[k][1] if k < usable else floor
            if k == usable or low - nxt > 1e-3 * low:
                gaps.append(((low - nxt) / low, k, (low + nxt) / 2))
            if gaps and (k - at >= PER_INTERVAL or gaps[-1][1] >= wanted):
                break
        whole = [g for g in gaps if g[1] >= wanted]
        _, k, cut = whole[0] if whole else max(gaps)
        cuts.append(cut)
        at = k
    return [(lo, hi, above(lo) - above(hi)) for hi, lo in zip(cuts, cuts[1:])]


# -- contour integration -----------------------------------------------------

def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` between ``low`` and ``high``."""
    d = len(v)
    middle, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - nodes)  # the upper half circle; the lower one is its conjugate
    points = middle + radius * np.exp(1j * angles)
    norm = float(np.abs(v).sum(axis=1).max())
    width = min(d, 2 * count + 4)
    rng = np.random.default_rng(13)
    space, last = rng.standard_normal((d, width)), np.inf
    for step in range(ROUNDS):
        image = np.zeros_like(space)
        for z, angle, weight in zip(points, angles, weights):
            image += weight / 2 * (radius * np.exp(1j * angle) * np.linalg.solve(z * np.eye(d) - v, space)).real
        basis, scale, _ = np.linalg.svd(image, full_matrices=False)
        basis = basis[:, scale > scale[0] * 1e-14]
        basis, _ = np.linalg.qr(basis)
        values, mix = np.linalg.eigh(basis.T @ v @ basis)
        vectors = basis @ mix
        inside = (values > low) & (values < high)
        if inside.sum() >= count:
            error = np.linalg.norm(v @ vectors - vectors * values, axis=0)
            real = inside & (error <= 1e-9 * norm)  # the others are no eigenvalues, only of the projection
            worst = error[real].max(initial=0.0)
            if real.sum() == count and (worst <= 1e-15 * norm or worst > last / 2) and worst <= 1e-12 * norm:
                return values[real], vectors[:, real]
            last = worst if real.sum() == count else np.inf
        space = vectors
        if step % 4 == 3 or inside.sum() < count:  # eigenvalues just outside hold it up: search in a larger space
            width = min(d, 2 * width)
        if space.shape[1] < width:
            space = np.hstack([space, rng.standard_normal((d, width - space.shape[1]))])
    raise ArithmeticError(f"{count} eigenvalues expected between {low} and {high}")


FOUND = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType()))])


def principal(spark, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of the leading components; one task an interval."""
    parts = intervals(v, wanted)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))

    def make():
        def solve(batch: pa.RecordBatch) -> list:
            found = [feast(v, *row)[1].T for row in zip(*(c.to_pylist() for c in batch.columns))]
            return [[list(map(float, row)) for row in np.vstack(found)]]
        return solve

    jobs = spark.createDataFrame(parts, "low double, high double, n int").repartition(len(parts))
    vectors = np.array([r[0] for r in map_batches(jobs, FOUND, make).collect()]).T
    basis, _ = np.linalg.qr(vectors)
    values, mix = np.linalg.eigh(basis.T @ v @ basis)
    if int((values > parts[-1][0]).sum()) != len(v) - below(v, parts[-1][0]):
        raise ArithmeticError("components are missing")
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = basis @ mix[:, order]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values[order], vectors * np.sign(lead)


# -- passes over the vectors -------------------------------------------------

def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _moments(rows: DataFrame, d: int, centre: list[int], products: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, sums of products) of entries less ``centre``, exact."""
    middle = np.array(centre, np.int64)
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.ArrayType(WHOLE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, square = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            y = _matrix(batch.column(0), d) - middle
            n += len(y)
            sums += y.sum(axis=0).astype(object) if np.abs(y).max(initial=0) < 1 << 40 else y.astype(object).sum(axis=0)
            if products and len(y):
                most = int(np.abs(y).max())
                step = (EXACT - 1) // max(1, most * most)
                if step:  # products of so many rows at a time are exact as doubles
                    for at in range(0, len(y), step):
                        part = y[at:at + step].astype(np.float64)
                        square += (part.T @ part).astype(np.int64).astype(object)
                else:
                    for row in y.astype(object):
                        square += np.outer(row, row)
        if n:
            lines = [(-2, [n]), (-1, list(sums)), *((i, list(square[i, :i + 1])) for i in range(d if products else 0))]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _ in lines], pa.int32()),
                pa.array([[Decimal(int(x)) for x in line] for _, line in lines], pa.list_(pa.decimal128(38, 0)))], ["i", "v"])

    parts = map_arrow(rows.select("x"), run, schema).select("i", F.posexplode("v").alias("j", "x"))
    n, sums, square = 0, np.zeros(d, object), np.zeros((d, d), object)
    for i, j, x in parts.groupBy("i", "j").agg(F.sum("x")).collect():  # d x d numbers at most
        if i == -2:
            n = int(x)
        elif i == -1:
            sums[j] = int(x)
        else:
            square[i, j] = square[j, i] = int(x)
    return n, sums, square


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, x) of the vectors taken, written to the shared folder, and their length."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.coalesce(F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= LIMIT), F.lit(False))), F.lit(False))
    rows = stage(vectors.where(sound).select(F.col(id_col).alias("id"), F.transform(
        v, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long")).alias("x")), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    return rows.where(F.size("x") == d), d


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per vector and component."""
    spark = vectors.sparkSession
    rows, d = _rows(vectors, id_col, vec_col)
    n, sums, _ = _moments(rows, d, [0] * d, False) if d else (0, None, None)
    values, q, centre, off, total = np.zeros(0), np.zeros((d, 0)), np.zeros(d, np.int64), np.zeros(d, object), 0
    if n:
        centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
        off = np.array([s - n * int(m) for s, m in zip(sums, centre)], object)
        _, _, square = _moments(rows, d, list(map(int, centre)), True)
        exact = n * square - np.outer(off, off)
        v = np.array([[int(x) / (n * n) for x in line] for line in exact])
        total = sum(int(exact[i, i]) for i in range(d)) / (n * n)
        values, q = principal(spark, v, components) if total > 0 else (values, q)
    scaled = q / np.sqrt(values)

    def centred(x: np.ndarray) -> np.ndarray:
        """n x - S: as long if it surely fits, else as Python numbers."""
        y = x - centre
        if int(np.abs(y).max(initial=0)) * n + max(map(abs, off), default=0) < 1 << 62:
            return y * n - off.astype(np.int64)
        return y.astype(object) * n - off

    def whitened(x: np.ndarray) -> np.ndarray:
        return (centred(x).astype(np.float64) / n) @ scaled

    def deviation(x: np.ndarray) -> list:
        m = centred(x)
        if m.dtype == object or int(np.abs(m).max(initial=0)) ** 2 * d >= 1 << 63:
            m = m.astype(object)
        found = (m * m).sum(axis=1)
        return [int(s) if s < 1 << 63 else None for s in found]

    k = len(values)
    error = None
    if k:
        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            square = np.zeros((k, k))
            for batch in batches:
                w = whitened(_matrix(batch.column(0), d))
                square += w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(square), pa.list_(pa.float64()))], ["i", "v"])

        schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
        parts = map_arrow(rows.select("x"), second, schema).select("i", F.posexplode("v").alias("j", "x"))
        found = parts.groupBy("i", "j").agg((F.sum("x") / F.lit(float(n))).alias("c"))
        error = found.agg(F.max(F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]

    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("deviation", T.LongType()),
                        T.StructField("w", T.ArrayType(T.DoubleType()))])

    def make():
        def run(batch: pa.RecordBatch) -> list:
            x = _matrix(batch.column(1), d)
            return [batch.column(0), deviation(x), list(whitened(x))]
        return run

    # without components no vector has a row
    done = map_batches(rows.select("id", "x") if k else rows.select("id", "x").limit(0), out, make)
    share = F.array(*[F.lit(float(e / total)) for e in values]) if k else F.array(F.lit(0.0))
    return (done.select("id", "deviation", F.posexplode("w").alias("place", "whitened"))
            .select(F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    "whitened", F.element_at(share, F.col("place") + 1).alias("explained"),
                    F.lit(error).cast("double").alias("identity_error")))
