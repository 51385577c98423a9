"""Outlines of entities as pixels, and who owns each pixel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise; fewer than three different points are returned as they are."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(rows):
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(pts), chain(pts[::-1])
    return np.array(lower[:-1] + upper[:-1])


def filled(points: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels (x, y) whose centres lie inside the hull or on its edge, row span by row span."""
    corners = hull(points)
    none = np.empty(0, np.int64)
    if len(corners) < 3:
        return none, none
    rows = np.arange(max(0, int(np.ceil(corners[:, 1].min() - 0.5))), min(height - 1, int(np.floor(corners[:, 1].max() - 0.5))) + 1)
    if not len(rows):
        return none, none
    y = rows + 0.5
    left, right = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
    for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):
        if a[1] == b[1]:
            continue
        at = (y >= min(a[1], b[1])) & (y <= max(a[1], b[1]))
        x = a[0] + (y[at] - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
        left[at], right[at] = np.minimum(left[at], x), np.maximum(right[at], x)
    first = np.maximum(0, np.ceil(left - 0.5)).astype(np.int64)
    last = np.minimum(width - 1, np.floor(right - 0.5)).astype(np.int64)
    n = np.maximum(0, last - first + 1)
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(rows, n)


def pixels(outlines: DataFrame, keys: list[str], points: str, width: int, height: int) -> DataFrame:
    """A row ``keys, x, y`` for each pixel of each outline; ``points`` is an array of ``x, y`` structs.

    Each outline is filled by itself in an Arrow batch, nothing is shuffled; a null or flat outline has no pixels.
    """
    names = [*keys, "x", "y"]

    def run(batches):
        for batch in batches:
            for row, outline in enumerate(batch.column(len(keys)).to_pylist()):
                x, y = filled(np.array([(p["x"], p["y"]) for p in outline or []], float).reshape(-1, 2), width, height)
                if len(x):
                    own = [pa.array([batch.column(k)[row].as_py()] * len(x), batch.column(k).type) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(x, pa.int64()), pa.array(y, pa.int64())], names)

    kinds = ", ".join(f"{k} {outlines.schema[k].dataType.simpleString()}" for k in keys)
    return outlines.select(*keys, points).mapInArrow(run, f"{kinds}, x long, y long")


def owners(cells: DataFrame, view: list[str], entity: str, depth: str) -> DataFrame:
    """Per entity and view the share of its pixels that no nearer entity takes; ties go to the smaller entity."""
    owner = cells.groupBy(*view, "x", "y").agg(F.min_by(entity, F.struct(depth, entity)).alias("owner"))
    both = cells.join(owner, [*view, "x", "y"])
    return both.groupBy(*view, entity).agg((F.count_if(F.col(entity) == F.col("owner")) / F.count("*")).alias("visible"), F.count("*").alias("n_pixels"))
