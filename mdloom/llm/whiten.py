"""Embedding whitening: exact cross-products from bit-sliced scatter, principal components, whitened projections.

Components are whole numbers x = floor(256 * c). The model is fitted on each distinct vector once.

1. A task takes its distinct vectors in blocks. Per dimension it subtracts the block's smallest value and packs the bit planes of the rest
   across the rows into 64-bit words. The cross-product of two dimensions is the sum over pairs of planes of 2^(a + b) times the population
   count of their AND: whole numbers throughout. What was subtracted is put back from the sums.
2. Tasks send one sum per pair of dimensions; Spark adds them up as decimals. The driver gets n, the sums S and the cross-products XX: as many
   numbers as the square of the dimensions, whatever the rows.
3. The scatter n * XX - S * S is centred in whole numbers and only then divided; ``eigh`` gives the components.
4. Each row is projected in the task that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import Stage
from mdloom.llm.vectors import LONG, largest, matrix, scaled

COMPONENTS = 4
BLOCK_ROWS = 4096  # rows whose bit planes are packed together
PLANES = 4096  # planes that one plane meets at a time
TOTAL, SUM = -2, -1  # in place of a second dimension


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per plane its 64-bit words over the rows, its dimension and its bit, of whole numbers from 0 on, dimension by dimension."""
    rows, dims = x.shape
    words = -(-rows // 64)
    bits = np.array([int(m).bit_length() for m in x.max(axis=0)], np.int64)
    owner, bit = np.repeat(np.arange(dims), bits), np.concatenate([np.arange(b) for b in bits] or [np.zeros(0, np.int64)]).astype(np.int64)
    planes = np.zeros((len(owner), words * 8), np.uint8)
    for plane, (d, b) in enumerate(zip(owner.tolist(), bit.tolist(), strict=True)):
        packed = np.packbits(((x[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8))
        planes[plane, : len(packed)] = packed
    return planes.view(np.uint64), owner, bit


def sliced_products(x: np.ndarray) -> np.ndarray:
    """Cross-products of the columns of whole numbers from 0 on (uint64), the upper triangle: weighted population counts of ANDed planes."""
    rows, dims = x.shape
    planes, owner, bit = bit_planes(x)
    first = np.searchsorted(owner, np.arange(dims + 1))
    width = int(bit.max(initial=0)) + 1
    kind = np.int64 if 2 * width + rows.bit_length() < 63 else object
    weight = np.array([1 << int(b) for b in bit], kind)
    out = np.zeros((dims, dims), kind)
    for d in range(dims):
        own = planes[first[d] : first[d + 1]]
        if not len(own):
            continue
        for low in range(int(first[d]), len(planes), PLANES):
            rest = planes[low : low + PLANES]
            both = np.bitwise_count(own[:, None, :] & rest[None, :, :]).sum(axis=2, dtype=np.int64).astype(kind)
            per_plane = (both * weight[first[d] : first[d + 1], None]).sum(axis=0) * weight[low : low + PLANES]
            np.add.at(out[d], owner[low : low + PLANES], per_plane)
    return out


def scatter(x: np.ndarray) -> np.ndarray:
    """Cross-products of the columns of any whole numbers, exact, the upper triangle as Python's integers or longs."""
    wide = largest(x)
    low = x.min(axis=0)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2^64, so right for any longs
    safe = wide * wide * 4 * len(x) < 2**62
    kind = np.int64 if safe else object
    low, rows = low.astype(kind), len(x)
    sums = shifted.astype(kind).sum(axis=0)
    products = sliced_products(shifted).astype(kind)
    return np.triu(products + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, their vector as bytes without zeros at its end: equal vectors, equal bytes."""
    for batch in batches:
        rows, whole, starts = scaled(batch)
        cut = [whole[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        data = [v[: (np.flatnonzero(v)[-1] + 1) if v.any() else 0].astype("<i8").tobytes() for v in cut]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(data, pa.binary())], names=["vec_id", "x"])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    data = column.to_pylist()
    return matrix(np.frombuffer(b"".join(data), np.int64), np.concatenate(([0], np.cumsum([len(d) // 8 for d in data]))).astype(np.int64), dims)


def _sums(dims: int):
    """Per task: the number of rows, the sums and the cross-products, one row each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                x = _matrix(batch.column("x").slice(low, BLOCK_ROWS), dims)
                n += len(x)
                sums += (x if largest(x) * len(x) < 2**62 else x.astype(object)).sum(axis=0)
                products += scatter(x)
        if n:
            i, j = np.triu_indices(dims)
            values = [n, *sums.tolist(), *products[i, j].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0, *range(dims), *i.tolist()], pa.int32()),
                    pa.array([TOTAL, *[SUM] * dims, *j.tolist()], pa.int32()),
                    pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0)),
                ],
                names=["i", "j", "value"],
            )

    return add


@dataclass
class Whitening:
    """``n`` vectors with sums ``sums``; per component its direction over the square root of its eigenvalue, and its share of the variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    explained: list[float]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        most = self.n * largest(x) + max((abs(s) for s in self.sums), default=0)
        kind = np.int64 if most < 2**62 else object
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ self.directions if self.n else np.zeros((len(deviations), 0))


def solve(n: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS) -> Whitening:
    """From exact sums: centred in whole numbers, then divided (rounded once), then decomposed."""
    dims = len(sums)
    centred = [[n * products[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    trace = sum(centred[d][d] for d in range(dims))
    if not trace:
        return Whitening(n, sums, np.zeros((dims, 0)), [])
    values, vectors = np.linalg.eigh(np.array([[v / (n * n) for v in row] for row in centred]))
    values, vectors = values[::-1], vectors[:, ::-1]
    some = [c for c in range(min(components, dims)) if values[c] > values[0] * dims * np.finfo(float).eps]
    directions = vectors[:, some] / np.sqrt(values[some])
    return Whitening(n, sums, directions, [float(values[c] * n * n / trace) for c in some])


def _long(values: list[int]) -> pa.Array:
    return pa.array([min(max(int(v), LONG.min), LONG.max) for v in values], pa.int64())


def _projected(model: Whitening):
    dims, number = len(model.sums), len(model.explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                off = model.deviations(_matrix(part.column("x"), dims))
                squared = off if largest(off) ** 2 * max(1, dims) < 2**62 else off.astype(object)
                deviation = _long((squared * squared).sum(axis=1).tolist())
                z = model.project(off)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), deviation, pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * number), pa.array(z.ravel()))],
                    names=["vec_id", "deviation", "whitened"],
                )

    return project


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vectors(vec_id, embedding, ...)``, one row per component.

    Rows whose vector is null or holds a null or non-finite component are dropped; every other row comes back, repeated ones and those without
    vec_id as well, with up to ``components`` components. Components without variance are left out, so vectors that are all equal, a single
    vector and an empty table give no row. Vectors of unlike length meet as if filled up with 0. ``deviation`` beyond 64 bits becomes the
    largest long; other columns are not read. The driver holds the square of the dimensions in numbers.
    """
    spark = vectors.sparkSession
    stage = Stage(spark, "whiten")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = stage.write(vectors.select("vec_id", "embedding").mapInArrow(_whole, f"vec_id {kind}, x binary"), "rows")
    fit = stage.write(rows.select("x").distinct(), "fit")
    dims = (fit.agg(F.max(F.octet_length("x"))).first()[0] or 0) // 8
    sums, products, n = [0] * dims, [[0] * dims for _ in range(dims)], 0
    for i, j, value in fit.mapInArrow(_sums(dims), "i int, j int, value decimal(38,0)").groupBy("i", "j").agg(F.sum("value")).collect():
        if j == TOTAL:
            n = int(value)
        elif j == SUM:
            sums[i] = int(value)
        else:
            products[i][j] = int(value)
    model = solve(n, sums, products, components)

    fields = "deviation bigint, whitened array<double>"
    number = len(model.explained)
    pairs = [(a, b) for a in range(number) for b in range(a, number)]
    fitted = fit.select(F.lit(0).alias("vec_id"), "x").mapInArrow(_projected(model), f"vec_id int, {fields}")
    off = [F.abs(F.covar_pop(F.col("whitened")[a], F.col("whitened")[b]) - F.lit(float(a == b))) for a, b in pairs]
    error = max((float(e) for e in fitted.agg(*off).first()), default=None) if pairs else None

    each = F.posexplode(F.arrays_zip("whitened", F.array(*(F.lit(e) for e in model.explained)).cast("array<double>").alias("explained")))
    wide = rows.mapInArrow(_projected(model), f"vec_id {kind}, {fields}").select("vec_id", "deviation", each.alias("place", "value"))
    return wide.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.col("value.whitened").alias("whitened"),
        F.col("value.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
