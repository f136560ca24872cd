"""Embedding vectors as whole numbers: floor(256 * c) of every component, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCALE = 256
LONG = np.iinfo(np.int64)
EXACT = 1 << 53  # below it, float64 adds and multiplies whole numbers without rounding


def scaled(batch: pa.RecordBatch, column: str = "embedding") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the batch that take part, the whole numbers of all of them in a row, and where each vector starts.

    A vector takes part unless it is null or holds a null or non-finite component. Values beyond 64 bits become the largest or smallest long,
    as Spark's cast does.
    """
    vectors = batch.column(column)
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(vectors.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(size)))
    finite = np.isfinite(values)
    bad = np.concatenate(([0], np.cumsum(~finite)))
    keep = (bad[bounds[1:]] == bad[bounds[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    chosen = values[np.repeat(keep, size)]
    with np.errstate(over="ignore"):
        floors = np.floor(SCALE * chosen)
    high, low = floors >= 2.0**63, floors < -(2.0**63)
    whole = np.where(high | low, 0, floors).astype(np.int64)
    whole[high], whole[low] = LONG.max, LONG.min
    return np.flatnonzero(keep), whole, np.concatenate(([0], np.cumsum(size[keep])))


def matrix(whole: np.ndarray, starts: np.ndarray, dims: int | None = None) -> np.ndarray:
    """Vectors as rows; those that are shorter than the longest are filled up with 0."""
    size = np.diff(starts)
    dims = int(size.max(initial=0)) if dims is None else dims
    out = np.zeros((len(size), dims), np.int64)
    place = np.arange(len(whole)) - np.repeat(starts[:-1], size)
    out[np.repeat(np.arange(len(size)), size), place] = whole
    return out


def widened(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] >= dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def blocks(batches: Iterator[pa.RecordBatch], columns: list[str], cells: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The rows that take part, cut into blocks of about ``cells`` numbers: other ``columns`` (whole numbers) and the matrix of each block."""
    kept: list[tuple[list[np.ndarray], np.ndarray]] = []
    held = width = 0

    def joined() -> tuple[list[np.ndarray], np.ndarray]:
        return [np.concatenate([k[0][j] for k in kept]) for j in range(len(columns))], np.concatenate([widened(k[1], width) for k in kept])

    for batch in batches:
        rows, whole, starts = scaled(batch)
        others = [batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in columns]
        low = 0
        while low < len(rows):
            wide = max(width, int((starts[low + 1] - starts[low])), 1)
            high = min(len(rows), low + max(1, cells // wide - held))
            part = matrix(whole[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
            kept.append(([o[low:high] for o in others], part))
            held, width, low = held + high - low, max(width, part.shape[1]), high
            if held * max(width, 1) >= cells:
                yield joined()
                kept, held, width = [], 0, 0
    if kept:
        yield joined()


def packed(x: np.ndarray) -> tuple[bytes, str]:
    """A matrix in the smallest type that holds it."""
    for kind in ("<i2", "<i4"):
        if x.size == 0 or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
            return x.astype(kind).tobytes(), kind
    return x.astype("<i8").tobytes(), "<i8"


def unpacked(data: bytes, kind: str, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64).reshape(rows, -1)


def largest(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(x.max()), -int(x.min())) if x.size else 0
