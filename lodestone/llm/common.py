"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Only where none is
    set and the master is local (tests, a laptop) a temporary folder is used; on a cluster its
    executors couldn't read one.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(session: SparkSession) -> str:
    """The folder of checkpoints and of files that live as long as a query."""
    sc = session.sparkContext
    if not sc.getCheckpointDir():
        folder = session.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def drop_folder(session: SparkSession, path: str) -> None:
    """Delete a folder that a query wrote and needs no more."""
    at = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_dealt(left: DataFrame, right: DataFrame, keys: dict[str, str], rows: str, spread: Column, how: str = "inner", salts: int = 32) -> DataFrame:
    """Equi-join of ``left`` with ``right``, where one key may be that of a third of ``left``'s rows.

    ``keys`` maps columns of ``left`` to those of ``right``, which are unique
    there and not null; ``right``'s column ``rows`` counts a key's rows in ``left``. A key of more than a 4,096th
    of all is dealt over salts: its rows by the hash ``spread``, its row of
    ``right`` repeated. Such keys are fewer than 4,096, so their list is broadcast.
    """
    floor = max(1000, (right.agg(F.sum(rows)).first()[0] or 0) // 4096)
    heavy = right.where(F.col(rows) > floor).select(*(F.col(r).alias(f"_heavy_{k}") for k, r in enumerate(keys.values())), F.lit(True).alias("_is_heavy"))
    marked = left.join(F.broadcast(heavy), [F.col(x) == F.col(f"_heavy_{k}") for k, x in enumerate(keys)], "left")
    marked = marked.withColumn("_left_salt", F.when(F.col("_is_heavy"), F.pmod(spread, F.lit(salts))).otherwise(0).cast("int"))
    last = F.when(F.col(rows) > floor, salts - 1).otherwise(0)
    dealt = right.withColumn("_right_salt", F.explode(F.sequence(F.lit(0), last)))
    same = [F.col(x) == F.col(r) for x, r in keys.items()] + [F.col("_left_salt") == F.col("_right_salt")]
    return marked.join(dealt, same, how).drop("_is_heavy", "_left_salt", "_right_salt", *(f"_heavy_{k}" for k in range(len(keys))))


def fresh(name: str, taken: Sequence[str]) -> str:
    """A column name that none of ``taken`` is, whatever its case."""
    out, used = f"_{name}", {x.lower() for x in taken}
    while out.lower() in used:
        out = f"_{out}"
    return out


def text_key(text: Column) -> Column:
    """64-bit key of a text, null apart from empty; with the doc_id it names a row."""
    return F.xxhash64(text, F.isnull(text))


#: Lower-cases A-Z and turns every ASCII character that is neither a letter nor a digit into a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def folded_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

    All separators are ASCII, so the UTF-8 bytes can be split as they are.
    """
    return text.translate(WORD_BYTES).split()
