"""Table functions for SQL: matches in context, and outlines as pixels."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.operators.raster import filled


@F.udtf(returnType="doc_id long, start long, end long, snippet string")
class Snippets:
    """``SELECT * FROM snippets(pattern, around, most, same, TABLE(t) PARTITION BY doc_id)`` over ``doc_id, t``.

    Up to ``most`` matches of a document, whatever their case, with ``around`` characters on both sides, whose snippets differ in their first ``same`` characters.
    """

    def __init__(self):
        self.seen: set[str] = set()

    def eval(self, pattern: str, around: int, most: int, same: int, row):
        text = row["t"]
        for m in re.finditer(pattern, text or "", re.I):
            if len(self.seen) >= most:
                return
            snippet = text[max(0, m.start() - around) : m.end() + around]
            if snippet[:same] not in self.seen:
                self.seen.add(snippet[:same])
                yield row["doc_id"], m.start(), m.end(), snippet


@F.udtf(returnType="entity long, cam long, depth double, x long, y long")
class HullPixels:
    """``SELECT * FROM hull_pixels(width, height, TABLE(p) PARTITION BY entity)`` over ``entity, cam, depth, px, py``.

    The pixels whose centres lie in the convex hull of an entity's points, with its least camera and depth.
    """

    def __init__(self):
        self.points: list[tuple[float, float]] = []
        self.entity = self.cam = self.depth = None
        self.size = 0, 0

    def eval(self, width: int, height: int, row):
        least = lambda a, b: b if a is None else a if b is None else min(a, b)
        self.entity, self.cam, self.depth = row["entity"], least(self.cam, row["cam"]), least(self.depth, row["depth"])
        self.size = width, height
        if row["px"] is not None and row["py"] is not None:
            self.points.append((row["px"], row["py"]))

    def terminate(self):
        x, y = filled(np.array(self.points, float).reshape(-1, 2), *self.size)
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            yield self.entity, self.cam, self.depth, a, b


def register(session: SparkSession) -> None:
    session.udtf.register("snippets", Snippets)
    session.udtf.register("hull_pixels", HullPixels)
