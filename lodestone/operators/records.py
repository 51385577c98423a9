"""Records against their index."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drift(index: DataFrame, records: DataFrame, key: str, record: str, fields: Mapping[str, str]) -> DataFrame:
    """Rows of a full join of index and records in which either side lacks or a field differs, null-safe; columns of both sides stay."""
    both = index.join(records, F.col(key) == F.col(record), "full")
    differs = F.col(key).isNull() | F.col(record).isNull()
    for a, b in fields.items():
        differs = differs | ~F.col(a).eqNullSafe(F.col(b))
    return both.where(differs)


def named(records: DataFrame, digest: str, name: str, prefix: str = "REC-", shown: int = 12) -> DataFrame:
    """``records``, one for each whole ``digest``, with a ``name`` of its first characters; those that share these show all of it."""
    short = F.substring(digest, 1, shown)
    one = F.count("*").over(Window.partitionBy(short)) == 1
    return records.withColumn(name, F.concat(F.lit(prefix), F.when(one, short).otherwise(F.col(digest))))
