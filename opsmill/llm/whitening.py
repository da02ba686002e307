"""Whitening of embeddings on their leading principal components, found by slicing the spectrum.

The covariance of the fit list (every distinct vector once) is summed by Spark: tasks add up the
products of the centred rows they see, and the sums of tasks are added by matrix row. What is
left is a matrix of the dimension squared, whatever the number of rows.

Its leading eigenvalues are isolated by counting: a factorisation L D Lt of the covariance less
a shift (with pivots of one and two rows) has as many negative pivots as there are eigenvalues
below the shift. Halving intervals by these counts gives every leading eigenvalue an interval of
its own. Rayleigh quotient iteration, begun in the interval, converges cubically; a result
outside of it is thrown away and the interval halved further. In the end counts on both sides of
every eigenvalue certify its number. Eigenvalues that agree to rounding share an interval; what
is found is moved below all others, so that the next vector is another one.

Centring is exact: an entry is centred as n * x - S in whole numbers before it is divided by n.

Defined cases: rows whose vector is null or holds null or entries that are not finite are left
out; rows with a null identifier, and repeated rows, stay; vectors that are shorter than others have zeros at their
end; directions without variance are no components, so that there are fewer than asked where
the fit list has fewer dimensions (none for one distinct vector, or an empty table); a
deviation that doesn't fit a long is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmill.llm.common import batch_of, small_batches, table, written
from opsmill.llm.negatives import finite, padded, scaled

COMPONENTS = 4
BATCH = 2048
#: Part of the sum of all eigenvalues up to which one counts as nothing.
NOTHING = 1e-12
_ALPHA = (1 + np.sqrt(17)) / 8


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues of a symmetric matrix are negative, zero and positive, from its factors L D Lt."""
    a = np.array(matrix, float)
    n = len(a)
    below = zero = 0
    k = 0
    while k < n:
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        most = column.max() if len(column) else 0.0
        two = False
        if max(abs(a[k, k]), most) == 0:
            zero += 1
            k += 1
            continue
        if abs(a[k, k]) < _ALPHA * most:
            off = np.abs(a[r, k:])
            off[r - k] = 0
            if abs(a[k, k]) * off.max() >= _ALPHA * most**2:
                pass
            elif abs(a[r, r]) >= _ALPHA * off.max():
                a[[k, r]] = a[[r, k]]
                a[:, [k, r]] = a[:, [r, k]]
            else:
                two = True
                a[[k + 1, r]] = a[[r, k + 1]]
                a[:, [k + 1, r]] = a[:, [r, k + 1]]
        if two:
            # A pivot of two rows with this choice has one eigenvalue of either sign.
            block, rest = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            below += 1
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            below += a[k, k] < 0
            rest = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(rest / a[k, k], rest)
            k += 1
    return below, zero, n - below - zero


def _above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are at least ``shift``."""
    return len(matrix) - inertia(matrix - shift * np.eye(len(matrix)))[0]


def _rayleigh(matrix: np.ndarray, shift: float, nth: int) -> tuple[float, np.ndarray]:
    """An eigenvalue near ``shift`` and its vector; begun with another vector for every ``nth``."""
    n = len(matrix)
    scale = np.abs(matrix).max()
    v = np.cos(1 + np.arange(n) * (1.0 + nth))
    v /= np.linalg.norm(v)
    value = shift
    for step in range(60):
        # The first steps keep the shift, so that the vector turns to the interval's eigenvalue.
        if step >= 3:
            value = float(v @ matrix @ v)
            if np.linalg.norm(matrix @ v - value * v) <= 4e-16 * n * scale:
                break
        try:
            v = np.linalg.solve(matrix - value * np.eye(n), v)
        except np.linalg.LinAlgError:
            v = np.linalg.solve(matrix - (value + 1e-15 * scale) * np.eye(n), v)
        v /= np.linalg.norm(v)
    return float(v @ matrix @ v), v


def leading(covariance: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a symmetric matrix, falling, and their vectors as columns."""
    n = len(covariance)
    trace = float(np.trace(covariance))
    if not n or trace <= 0:
        return np.empty(0), np.empty((n, 0))
    radius = np.abs(covariance).sum(axis=1).max()
    top, least = radius * (1 + 1e-12), trace * NOTHING
    count = min(count, _above(covariance, least))
    # Below each bound there are so many eigenvalues at or above it.
    counted = {top: 0, least: _above(covariance, least)}
    values: list[float] = []
    vectors: list[np.ndarray] = []

    def interval(number: int, narrow: float = np.inf) -> tuple[float, float]:
        """Bounds with only the given eigenvalue between, if they can be parted, and not farther apart than asked."""
        while True:
            high = min(b for b, c in counted.items() if c < number)
            low = max(b for b, c in counted.items() if c >= number)
            if high - low <= 4e-16 * n * radius:
                return low, high
            if counted[low] == counted[high] + 1 and high - low <= narrow:
                return low, high
            middle = (low + high) / 2
            counted[middle] = _above(covariance, middle)

    # What is found is moved out of the way, below all others; this parts equal eigenvalues.
    rest, near = np.array(covariance, float), 1e-11 * radius
    for number in range(1, count + 1):
        low, high = interval(number)
        while True:
            value, vector = _rayleigh(rest, (low + high) / 2, number)
            # The certificate: the counts on both sides of the value are those of its number.
            if _above(covariance, value + near) < number <= _above(covariance, value - near):
                break
            if high - low <= near:
                raise ArithmeticError(f"eigenvalue {number} could not be certified")
            low, high = interval(number, (high - low) / 2)
        for other in vectors:
            vector = vector - other * (other @ vector)
        vector /= np.linalg.norm(vector)
        values.append(value)
        vectors.append(vector)
        rest -= (value + radius) * np.outer(vector, vector)
    return np.array(values), np.array(vectors).reshape(len(vectors), n).T


@dataclass
class Whitening:
    """What every row needs: size and sums of the fit list, components and their eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; as Python's numbers where longs could overflow."""
        largest = max(int(np.abs(x.astype(float)).max(initial=0)), 1) * max(self.n, 1) + max(map(abs, self.sums), default=0)
        kind = np.int64 if largest < 2**62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.times_n(x).astype(float) / max(self.n, 1)) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        centred = self.times_n(x)
        if centred.dtype != object and float(np.abs(centred).max(initial=0)) ** 2 * max(x.shape[1], 1) < 2**63:
            return (centred**2).sum(axis=1).tolist()
        return [s if s < 2**63 else None for s in (sum(int(v) ** 2 for v in row) for row in centred)]


def _summed(width: int):
    """Number of rows and sum of every dimension, of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * width
        for batch in batches:
            x = padded(batch.column("x"), width)
            n += len(x)
            # In two halves, so that the sums of a batch fit longs.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low, strict=True)]
        schema = pa.schema([("place", pa.int32()), ("total", pa.decimal128(38, 0))])
        yield batch_of(schema, [list(range(-1, width)), pa.array([n, *sums], pa.decimal128(38, 0))])

    return run


def _products(model: Whitening, width: int):
    """Products of the centred rows of a task, one row for each row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            centred = model.times_n(padded(batch.column("x"), width)).astype(float) / model.n
            total += centred.T @ centred
        schema = pa.schema([("place", pa.int32()), ("row", pa.binary())])
        yield batch_of(schema, [list(range(width)), [r.tobytes() for r in total]])

    return run


def _added(rows: pa.Table) -> pa.Table:
    parts = [np.frombuffer(r, float) for r in rows.column("row").to_pylist()]
    return pa.table({"place": rows.column("place")[:1], "row": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})


def covariance(fit: DataFrame, model: Whitening, width: int) -> np.ndarray:
    """The covariance of the fit list (column x); it has ``width`` rows and columns."""
    parts = fit.mapInArrow(_products(model, width), "place int, row binary")
    rows = parts.groupBy("place").applyInArrow(_added, "place int, row binary").collect()
    out = np.zeros((width, width))
    for place, row in rows:
        out[place] = np.frombuffer(row, float)
    return (out + out.T) / (2 * model.n)


def _whitened_products(shared, width: int):
    """Sums and products of the whitened rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.project(padded(batch.column("x"), width))
            sums += w.sum(axis=0)
            products += w.T @ w
        schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("total", pa.float64())])
        pairs = [(a, b) for a in range(-1, k) for b in range(k)]
        yield batch_of(schema, [*map(list, zip(*pairs)), [sums[b] if a < 0 else products[a, b] for a, b in pairs]])

    return run


def _identity_error(fit: DataFrame, shared, width: int) -> float:
    """Largest entry of the whitened fit list's covariance less the identity."""
    model = shared.value
    k = len(model.values)
    totals = fit.mapInArrow(_whitened_products(shared, width), "a int, b int, total double")
    means, products = np.zeros(k), np.zeros((k, k))
    for a, b, total in totals.groupBy("a", "b").agg(F.sum("total")).collect():
        if a < 0:
            means[b] = total / model.n
        else:
            products[a, b] = total / model.n
    # Rows are centred already, the means are rounding.
    return float(np.abs(products - np.outer(means, means) - np.eye(k)).max())


def _out(shared, error: float, width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        explained = model.values / model.trace
        for batch in batches:
            x = padded(batch.column("x"), width)
            n = len(x)
            yield batch_of(
                schema,
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                    np.tile(np.arange(1, k + 1, dtype="i4"), n),
                    np.full(n * k, model.n),
                    pa.array([d for d in model.deviations(x) for _ in range(k)], pa.int64()),
                    model.project(x).reshape(-1),
                    np.tile(explained, n),
                    np.full(n * k, error),
                ],
            )

    return run


def fitted(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a table of distinct vectors (column x, arrays of longs)."""
    totals = dict(
        fit.mapInArrow(_summed(width), "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total")).collect()
    )
    n = int(totals.get(-1) or 0)
    model = Whitening(n, [int(totals.get(i) or 0) for i in range(width)], np.empty(0), np.empty((width, 0)), 0.0)
    if n:
        matrix = covariance(fit, model, width)
        model.values, model.vectors = leading(matrix, components)
        model.trace = float(np.trace(matrix))
    return model


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row that takes part."""
    spark = embeddings.sparkSession
    small_batches(spark, BATCH)
    rows = embeddings.filter(finite(F.col("embedding"))).select("vec_id", scaled(F.col("embedding")).alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
    fit = written(rows.select(F.concat("x", zeros).alias("x")).distinct(), "fit")
    model = fitted(fit, width, components)
    kind = rows.schema["vec_id"].dataType
    out = T.StructType([T.StructField("vec_id", kind)])
    out.add("component", T.IntegerType()).add("n", T.LongType()).add("deviation", T.LongType())
    for name in ("whitened", "explained", "identity_error"):
        out.add(name, T.DoubleType())
    if not len(model.values):
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(model)  # components times dimension
    from pyspark.sql.pandas.types import to_arrow_schema

    return rows.mapInArrow(_out(shared, _identity_error(fit, shared, width), width, to_arrow_schema(out)), out)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings``, whitened on four components."""
    return whiten(table(spark, sf_dir, "embeddings"))
