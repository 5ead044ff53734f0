"""Embedding whitening from exact, bit-sliced cross-products.

1. *Integers.*  An entry c becomes x = floor(64 c) + 1000000, a long (saturated
   at +-2**61).  The fit list holds each distinct x vector once; it is made by
   a grouping that is pre-aggregated in every task, so a vector that a third
   of all rows share costs one row a task.
2. *Bit planes.*  Every dimension is shifted by its least value, so its values
   are small and not negative, and cut into limbs of ``LIMB`` bits.  A task
   packs each bit plane of its rows into 64-bit words.  The cross-product of
   two limbs is the sum over their planes of 2**(a + b) times the population
   count of the ANDed words: exact, with no rounding at any number of rows.
3. *Centring.*  Limb products are summed across tasks as decimals.  With sums S
   and products C the integers n C - S S' are the covariance times n squared,
   free of cancellation; only then are they divided and given to ``eigh``.
4. *Projection.*  x - S/n, taken from the shifted integers, is projected on the
   unit eigenvectors and divided by the root of their eigenvalues.  A pass over
   the fit list measures how far the covariance of the result is from identity.

What reaches the driver is bounded by the dimensions alone (their products and
their bounds), never by the rows.

Defined results: rows whose vector is null, or holds null or non-finite
entries, are dropped, and so are vectors that have another length than most
(of equally frequent lengths the longest); an empty table, or vectors without
entries, give an empty result; repeated rows all stay; a null vec_id stays
null; a component without variance (beyond rounding) has a null whitened value
and explained 0, or null where nothing varies; a deviation beyond a long is
null; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import session, stage

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: bits of a limb: products of limbs over a block of rows stay within a long
LIMB = 20
#: entries of x are held within +-2**EDGE, so that differences are longs
EDGE = 61
#: rows packed at once, and bytes of ANDed words held at once
BLOCK_ROWS, BLOCK_BYTES = 1 << 15, 1 << 23


def _integer(c: Column) -> Column:
    edge = float(1 << EDGE)
    scaled = F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(int(edge))), F.lit(int(-edge)))
    # floor() of a double beyond a long would be cut to its ends; those saturate as well
    return F.when(c.cast("double") * SCALE >= edge, F.lit(int(edge))).when(
        c.cast("double") * SCALE <= -edge, F.lit(int(-edge))).otherwise(scaled) + F.lit(OFFSET)


def integer_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x array<long>) of the rows whose vector is whole and finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(vector).isNotNull()).where(F.coalesce(finite, F.lit(False))).select(
        key, F.transform(vector, _integer).alias("x"))


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    """The x vectors of an Arrow batch as rows."""
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(
        zero_copy_only=False).reshape(-1, dimensions)


def _bounds(dimensions: int):
    def run(batches):
        low = high = None
        rows = 0
        for batch in batches:
            x = _matrix(batch, dimensions)
            if len(x):
                rows += len(x)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if rows:
            yield pa.RecordBatch.from_pydict({
                "dimension": pa.array(range(dimensions), pa.int32()), "low": low, "high": high,
                "rows": pa.array([rows] * dimensions, pa.int64())})
    return run


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Planes (bits x words) of non-negative ``values``: bit r of word w of plane
    b is bit b of value 64 w + r."""
    words = -(-len(values) // 64)
    shifted = (values[None, :] >> np.arange(bits, dtype=np.int64)[:, None]) & 1
    padded = np.zeros((bits, words * 64), np.uint8)
    padded[:, :len(values)] = shifted
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def cross_products(limbs: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the columns of ``limbs`` (rows x limbs,
    values of column i below 2**bits[i]), by weighted AND-popcounts."""
    planes = np.concatenate([bit_planes(limbs[:, i], n) for i, n in enumerate(bits)])
    owner = np.repeat(np.arange(len(bits)), bits)
    weight = np.concatenate([np.left_shift(np.int64(1), np.arange(n)) for n in bits])
    begin = np.concatenate(([0], np.cumsum(bits)[:-1]))
    sums = np.add.reduceat(np.bitwise_count(planes).sum(axis=1, dtype=np.int64) * weight, begin)
    cross = np.zeros((len(bits), len(bits)), np.int64)
    step = max(1, BLOCK_BYTES // max(1, planes.shape[1] * 8))
    for p in range(len(planes)):
        for at in range(p, len(planes), step):
            some = slice(at, min(at + step, len(planes)))
            counts = np.bitwise_count(planes[p] & planes[some]).sum(axis=1, dtype=np.int64)
            # planes p < q of one limb meet twice in its square
            twice = np.where((owner[some] == owner[p]) & (np.arange(some.start, some.stop) > p), 2, 1)
            np.add.at(cross[owner[p]], owner[some], counts * twice * weight[some] * weight[p])
    return sums, np.triu(cross) + np.triu(cross, 1).T


def _limbs(x: np.ndarray, low: np.ndarray, spans: list[int]) -> np.ndarray:
    """Shifted values cut into limbs: columns (dimension, limb), limb 0 lowest."""
    shifted = x - low
    return np.stack([(shifted[:, d] >> (LIMB * i)) & ((1 << LIMB) - 1)
                     for d, span in enumerate(spans) for i in range(-(-span // LIMB))], axis=1)


def _limb_bits(spans: list[int]) -> list[int]:
    return [min(LIMB, span - LIMB * i) for span in spans for i in range(-(-span // LIMB))]


def _scatter(low: np.ndarray, spans: list[int]):
    """Rows -> this task's limb sums and cross-products, one row a pair (b = -1: a sum)."""
    bits = _limb_bits(spans)

    def run(batches):
        sums, cross = np.zeros(len(bits), np.int64), np.zeros((len(bits), len(bits)), np.int64)
        held, rows, summed = [], 0, 0

        def add():
            s, c = cross_products(_limbs(np.concatenate(held), low, spans), bits)
            sums[:] += s
            cross[:] += c

        def out():
            a, b = np.triu_indices(len(bits))
            return pa.RecordBatch.from_pydict({
                "a": np.concatenate((np.arange(len(bits)), a)).astype(np.int32),
                "b": np.concatenate((np.full(len(bits), -1), b)).astype(np.int32),
                "value": np.concatenate((sums, cross[a, b]))})

        for batch in batches:
            x = _matrix(batch, len(spans))
            for at in range(0, len(x), BLOCK_ROWS):
                held.append(x[at:at + BLOCK_ROWS])
                rows += len(held[-1])
                if rows >= BLOCK_ROWS:
                    add()
                    summed += rows
                    held, rows = [], 0
                    if summed >= 1 << 21:       # a long holds 2**22 products of 2**40
                        yield out()
                        sums[:], cross[:], summed = 0, 0, 0
        if rows:
            add()
        if rows or summed:
            yield out()
    return run


@dataclass
class Whitening:
    """A fitted whitening: shift, shifted sums, eigenvalues and unit eigenvectors."""

    n: int
    low: np.ndarray             # least x of each dimension (long)
    high: np.ndarray
    sums: list[int]             # sums of x - low over the fit list, exact
    values: np.ndarray          # eigenvalues of x's covariance, falling
    vectors: np.ndarray         # dimensions x components, unit columns
    explained: list[float | None]
    identity_error: float | None = None

    @property
    def scale(self) -> np.ndarray:
        """One over the root of each eigenvalue; nan where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of x."""
        # shifted by the mean's integer part, the difference of longs is small and exact
        whole = np.array([s // self.n for s in self.sums])
        part = np.array([s % self.n / self.n for s in self.sums])
        return (((x - self.low) - whole).astype(np.float64) - part) @ self.vectors * self.scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n x - S)**2; null beyond a long."""
        widest = max((int(h) - int(w) for h, w in zip(self.high, self.low)), default=0)
        if len(self.sums) * (self.n * widest) ** 2 < 1 << 62:
            apart = (x - self.low) * np.int64(self.n) - np.array(self.sums, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = (x - self.low).astype(object) * self.n - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (apart * apart).sum(axis=1).tolist()]


def _covariance(sums: list[int], products, n: int) -> np.ndarray:
    """Covariance from exact sums and products: centred as integers, then divided."""
    d = len(sums)
    return np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)]
                     for i in range(d)], np.float64)


def fit(points: DataFrame, dimensions: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a staged frame of distinct ``x`` vectors (None: no rows)."""
    found = points.select("x").mapInArrow(
        _bounds(dimensions), "dimension int, low long, high long, rows long").groupBy("dimension").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows")) \
        .orderBy("dimension").collect()                   # one row a dimension
    if not found:
        return None
    n = found[0]["rows"]
    low, high = (np.array([r[c] for r in found], np.int64) for c in ("low", "high"))
    spans = [max(1, (int(h) - int(w)).bit_length()) for h, w in zip(high, low)]
    owner = [(d, i) for d, span in enumerate(spans) for i in range(-(-span // LIMB))]
    total = points.select("x").mapInArrow(_scatter(low, spans), "a int, b int, value long") \
        .groupBy("a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums = [0] * dimensions
    products = [[0] * dimensions for _ in range(dimensions)]
    for a, b, value in total.collect():                   # one row a pair of limbs
        (d, i), value = owner[a], int(value)
        if b < 0:
            sums[d] += value << (LIMB * i)
            continue
        e, j = owner[b]
        value <<= LIMB * (i + j)
        if d == e:
            products[d][d] += value if a == b else 2 * value
        else:
            products[d][e] += value
            products[e][d] += value
    covariance = _covariance(sums, products, n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    floor = trace * dimensions * np.finfo(float).eps
    values = np.where(values[order] > floor, values[order], 0.0)
    return Whitening(n, low, high, sums, values, vectors[:, order],
                     [float(v / trace) if trace > 0 else None for v in values])


def _moments(model: Whitening):
    """Rows -> sums of whitened values and of their products in this task."""
    own = np.flatnonzero(model.values > 0)

    def run(batches):
        first, second = np.zeros(len(own)), np.zeros((len(own), len(own)))
        some = False
        for batch in batches:
            w = model.project(_matrix(batch, len(model.low)))[:, own]
            first += w.sum(axis=0)
            second += w.T @ w
            some = some or len(w) > 0
        if some:
            a, b = np.triu_indices(len(own))
            yield pa.RecordBatch.from_pydict({
                "a": np.concatenate((np.arange(len(own)), a)).astype(np.int32),
                "b": np.concatenate((np.full(len(own), -1), b)).astype(np.int32),
                "value": np.concatenate((first, second[a, b]))})
    return run


def identity_error(points: DataFrame, model: Whitening) -> float | None:
    """Largest entry of |covariance of the whitened fit list - identity|, over the
    components that have a variance; null without any."""
    if not (model.values > 0).any():
        return None
    total = {(r["a"], r["b"]): r["value"] for r in points.select("x").mapInArrow(
        _moments(model), "a int, b int, value double").groupBy("a", "b").agg(
        F.sum("value").alias("value")).collect()}         # one row a pair of components
    return max(abs(v / model.n - total[a, -1] * total[b, -1] / model.n ** 2 - (a == b))
               for (a, b), v in total.items() if b >= 0)


def _project(model: Whitening):
    def run(batches):
        for batch in batches:
            x = _matrix(batch, len(model.low))
            whitened = model.project(x).ravel()
            flat = pa.array(whitened, pa.float64(), mask=np.isnan(whitened))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(model.values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.deviations(x), pa.int64()),
                 pa.ListArray.from_arrays(offsets, flat)], ["key", "deviation", "whitened"])
    return run


def usual_length(points: DataFrame) -> int:
    """The most frequent length of ``x`` (of equally frequent ones the longest); 0: none."""
    top = points.groupBy(F.size("x").alias("size")).count().orderBy(
        F.desc("count"), F.desc("size")).limit(1).collect()
    return top[0]["size"] if top else 0


def fitted(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding",
           key: str = "vec_id") -> tuple[DataFrame, Whitening | None]:
    """(key, x) of the rows that stay, and their whitening."""
    session(df)
    points = integer_vectors(df, vector, key)
    dimensions = usual_length(points)
    points = points.where(F.size("x") == dimensions)
    if not dimensions:
        return points, None
    distinct = stage(points.select("x").distinct(), "fit-list")
    model = fit(distinct, dimensions, components)
    if model is not None:
        model.identity_error = identity_error(distinct, model)
    return points, model


def whiten(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding",
           key: str = "vec_id") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one
    row per remaining row and component."""
    points, model = fitted(df, components, vector, key)
    kind = df.schema[key].dataType.simpleString()
    if model is None:
        return df.sparkSession.createDataFrame(
            [], f"{key} {kind}, component int, n long, deviation long, whitened double, "
                "explained double, identity_error double")
    rows = points.select(F.col(key).alias("key"), "x").mapInArrow(
        _project(model), f"key {kind}, deviation long, whitened array<double>")
    explained = F.array(*[F.lit(v).cast("double") for v in model.explained])
    return rows.select(F.col("key").alias(key), "deviation", F.posexplode("whitened")
                       .alias("at", "whitened")).select(
        key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"))
