"""Matches in context."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame


def windows(docs: DataFrame, key: str, text: str, pattern: str, *, before: int, after: int, most: int, same: int) -> DataFrame:
    """``start, end, snippet`` of the first ``most`` matches in each text whose snippets differ in their first ``same`` characters.

    Windows may overlap, which one regular expression can't express; the text is read
    in Arrow batches and nothing is shuffled. A null text has none.
    """
    find = re.compile(pattern, re.I).finditer

    def run(batches):
        for batch in batches:
            keys, starts, ends, found = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: set[str] = set()
                for m in find(t or ""):
                    snippet = t[max(0, m.start() - before) : m.end() + after]
                    if snippet[:same] in seen:
                        continue
                    seen.add(snippet[:same])
                    keys.append(k)
                    starts.append(m.start())
                    ends.append(m.end())
                    found.append(snippet)
                    if len(seen) == most:
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.column(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(found, pa.string())], [key, "start", "end", "snippet"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, start long, end long, snippet string")
