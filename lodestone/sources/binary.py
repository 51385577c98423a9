"""Point clouds and images of files as long rows, read in Arrow batches by ``binaryFile``; a file is decoded by one task."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8"}
_PLY |= {"int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def ply_points(content: bytes) -> np.ndarray:
    """x, y, z of the vertices of a PLY file, ASCII or binary; vertices must be its first element and hold no lists."""
    head, _, body = content.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    lines = [x.split() for x in head.decode("ascii").splitlines() if x.strip()]
    if lines[0] != ["ply"]:
        raise ValueError("no PLY file")
    form = next(x[1] for x in lines if x[0] == "format")
    first = next(k for k, x in enumerate(lines) if x[0] == "element")
    if lines[first][1] != "vertex":
        raise ValueError("vertices must come first")
    n, names, kinds = int(lines[first][2]), [], []
    for x in lines[first + 1 :]:
        if x[0] == "element":
            break
        if x[0] == "property":
            names.append(x[-1])
            kinds.append(_PLY[x[1]])
    at = [names.index(c) for c in "xyz"]
    if form == "ascii":
        rows = [x.split() for x in body.decode("ascii").splitlines()[:n]]
        return np.array([[float(r[k]) for k in at] for r in rows]).reshape(-1, 3)
    order = "<" if form == "binary_little_endian" else ">"
    rows = np.frombuffer(body, np.dtype([(a, order + k) for a, k in zip(names, kinds, strict=True)]), n)
    return np.stack([rows[c].astype(np.float64) for c in "xyz"], 1)


def npz_points(content: bytes, name: str) -> np.ndarray:
    """The rows of an n x 3 array of an NPZ archive."""
    with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
        return np.asarray(arrays[name], np.float64).reshape(-1, 3)


def png_pixels(content: bytes) -> np.ndarray:
    """Height x width x channels of a PNG file of 8 bits a channel, grey or colour, not interlaced, no palette."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, data = 8, []
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        part = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            data.append(part)
        at += 12 + size
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or channels is None:
        raise ValueError("a kind of PNG file that isn't read")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * channels)
    out, above = np.zeros((height, width * channels), np.uint8), np.zeros(width * channels, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            row = line
        elif kind == 1:  # each byte on the one a pixel before
            row = np.cumsum(line.reshape(width, channels), 0, np.uint8).reshape(-1)
        elif kind == 2:
            row = line + above
        else:
            row = _unfiltered(kind, line, above, channels)
        out[y] = above = row
    return out.reshape(height, width, channels)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, channels: int) -> np.ndarray:
    """A row whose bytes are told from the left and the upper neighbours."""
    row, up = line.astype(np.int64).tolist(), above.astype(np.int64).tolist()
    for k in range(len(row)):
        a, b, c = (row[k - channels], up[k], up[k - channels]) if k >= channels else (0, up[k], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        row[k] = (row[k] + guess) & 255
    return np.array(row, np.uint8)


def resizing(n: int, m: int) -> np.ndarray:
    """The m x n weights of a bicubic resizing (a = -0.5) of n pixels to m; where it shrinks, a kernel as much wider, so that every pixel counts."""
    scale = n / m
    reach = max(scale, 1.0)
    out = np.zeros((m, n))
    for k in range(m):
        centre = (k + 0.5) * scale
        first, last = max(0, int(centre - 2 * reach + 0.5)), min(n, int(centre + 2 * reach + 0.5))
        d = np.abs((np.arange(first, last) + 0.5 - centre) / reach)
        w = np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))
        out[k, first:last] = w / w.sum()
    return out


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """An 8-bit image of another size: rows first, then columns, rounded to 8 bits after each."""
    eight = lambda x: np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)
    if pixels.shape[1] != width:
        pixels = eight(np.einsum("mw,hwc->hmc", resizing(pixels.shape[1], width), pixels.astype(float)))
    if pixels.shape[0] != height:
        pixels = eight(np.einsum("mh,hwc->mwc", resizing(pixels.shape[0], height), pixels.astype(float)))
    return pixels


def _decoded(spark: SparkSession, glob: str, schema: str, decode) -> tuple[DataFrame, DataFrame]:
    """Rows of the files, and ``path, error`` of those that can't be read."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    columns = decode(path, content)
                except (ValueError, KeyError, StopIteration, OSError, struct.error, zlib.error) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), *(pa.nulls(1, k) for k in kinds), pa.array([f"{type(e).__name__}: {e}"])], names)
                    continue
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.nulls(n, pa.string())], names)

    fields = [x.split() for x in schema.split(",")]
    names = ["path", *(f[0] for f in fields), "error"]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[f[1]] for f in fields]
    rows = spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(run, f"path string, {schema}, error string")
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("path", "error")


def point_files(spark: SparkSession, glob: str, array: str = "points") -> tuple[DataFrame, DataFrame]:
    """``path, pid, x, y, z`` of PLY and NPZ files (of these the named array), and the files that can't be read."""

    def decode(path: str, content: bytes):
        points = npz_points(content, array) if path.endswith(".npz") else ply_points(content)
        return [np.arange(len(points)), *points.T]

    return _decoded(spark, glob, "pid long, x double, y double, z double", decode)


def array_files(spark: SparkSession, glob: str, arrays: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``path, array, shape, index, value``: a row for each number of the arrays, of any shape, of NPZ files, and the files that can't be read.

    ``index`` has a place for each dimension; a single number has none. Without ``arrays`` all are read, those that hold no numbers make the file an unreadable one.
    """

    def decode(path: str, content: bytes):
        columns: list[list] = [[], [], [], []]
        with np.load(io.BytesIO(content), allow_pickle=False) as held:
            for name in held.files if arrays is None else arrays:
                values = np.asarray(held[name])
                if values.dtype.kind not in "biuf":
                    raise ValueError(f"{name} holds no numbers")
                columns[0] += [name] * values.size
                columns[1] += [list(values.shape)] * values.size
                columns[2] += np.indices(values.shape).reshape(values.ndim, -1).T.tolist() if values.ndim else [[]] * values.size
                columns[3] += values.astype(np.float64).reshape(-1).tolist()
        return columns

    return _decoded(spark, glob, "array string, shape array<long>, index array<long>, value double", decode)


def pixel_files(spark: SparkSession, glob: str, size: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """``path, y, x, channel, value`` (0 to 1) of PNG files, resized to ``size`` (width, height) where it is given, and the files that can't be read."""

    def decode(path: str, content: bytes):
        pixels = png_pixels(content)
        if size:
            pixels = resized(pixels, *size)
        y, x, channel = (c.reshape(-1).astype(np.int32) for c in np.indices(pixels.shape))
        return [y, x, channel, pixels.reshape(-1) / 255.0]

    return _decoded(spark, glob, "y int, x int, channel int, value double", decode)
