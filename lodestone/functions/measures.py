"""Numeric columns: bins, projective geometry, image error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_label(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the half-open bin; what no bin holds (negative, NaN, null) falls back to the last label."""
    out = F.lit(labels[-1])
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((value >= lo) & (value < hi), F.lit(label)).otherwise(out)
    return out


def coverage_ratio(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection of boxes (x0, y0, x1, y1) over the area of the first; not symmetric; 0 if apart."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = F.greatest((a[2] - a[0]) * (a[3] - a[1]), F.lit(1e-6))
    return F.when((w > 0) & (h > 0), w * h / area).otherwise(F.lit(0.0))


def psnr(mse: Column) -> Column:
    """Null for no pixels and for no error."""
    return F.when(mse > 1e-12, -10 * F.log10(mse))


def to_camera(point: Sequence[Column], rotation: Sequence[Column], centre: Sequence[Column]) -> list[Column]:
    """World to camera: the transpose of the camera's rotation (nine columns, by row) applied to point - centre."""
    d = [p - c for p, c in zip(point, centre, strict=True)]
    return [rotation[k] * d[0] + rotation[3 + k] * d[1] + rotation[6 + k] * d[2] for k in range(3)]


def pinhole(point: Sequence[Column], fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    depth = F.greatest(point[2], F.lit(1e-6))
    return fx * point[0] / depth + cx, fy * point[1] / depth + cy


def plane_side(point: Sequence[Column], plane: Sequence[float]) -> Column:
    """Whether the point lies on the positive side."""
    return point[0] * plane[0] + point[1] * plane[1] + point[2] * plane[2] + F.lit(plane[3]) > 0


_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def _minors(m: Column, row: int) -> dict[tuple[int, int], Column]:
    """The 2x2 minors of a row of a 4x4 matrix and the next one."""
    e = lambda r, c: F.get(m, F.lit(4 * r + c))
    return {(a, b): e(row, a) * e(row + 1, b) - e(row, b) * e(row + 1, a) for a, b in _PAIRS}


def determinant4(m: Column) -> Column:
    up, low = _minors(m, 0), _minors(m, 2)
    total = F.lit(0.0)
    for k, p in enumerate(_PAIRS):
        total = total + (1, -1, 1, 1, -1, 1)[k] * up[p] * low[_PAIRS[5 - k]]
    return total


def inverse4(m: Column) -> Column:
    """The inverse of a general 4x4 matrix, an array of 16 by row; null if it has none."""
    up, low = _minors(m, 0), _minors(m, 2)

    def cofactor(i: int, j: int) -> Column:
        """Of row j and column i: the numbers of the row beside j, each by a minor of the other two rows."""
        row, minors = j ^ 1, low if j < 2 else up
        rest, total = [c for c in range(4) if c != i], F.lit(0.0)
        for k, c in enumerate(rest):
            a, b = (x for x in rest if x != c)
            total = total + (1, -1, 1)[k] * F.get(m, F.lit(4 * row + c)) * minors[a, b]
        return (-1) ** (i + j) * total

    made = F.transform(F.array(determinant4(m)), lambda d: F.when(d != 0, F.array(*(cofactor(i, j) / d for i in range(4) for j in range(4)))))
    return F.get(made, F.lit(0))


def camera_centre(p: Column) -> list[Column]:
    """The point that a 3x4 projection (12 numbers by row) maps to nothing: the solution of its left part against its last column."""
    e = lambda r, c: F.get(p, F.lit(4 * r + c))

    def det(columns: Sequence[int]) -> Column:
        a, b, c = columns
        return e(0, a) * (e(1, b) * e(2, c) - e(1, c) * e(2, b)) - e(0, b) * (e(1, a) * e(2, c) - e(1, c) * e(2, a)) + e(0, c) * (e(1, a) * e(2, b) - e(1, b) * e(2, a))

    whole = det((0, 1, 2))
    return [F.when(whole != 0, -det(x) / whole) for x in ((3, 1, 2), (0, 3, 2), (0, 1, 3))]
