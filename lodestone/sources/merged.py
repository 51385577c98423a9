"""Tables that grow by upserts: copy-on-write over hash buckets, published by renaming, safe to replay.

A table is a folder. ``data`` holds a Parquet folder for each bucket and version,
``manifest`` a small JSON file for each version that names the live folder of every bucket and the
batches that were applied. An upsert reads only the buckets that its rows fall into, rewrites only
those in which a row changes, and then renames the new manifest to its final name. Before that, nothing of it
is visible; a batch that is applied again changes nothing. Buckets that no row changes keep their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import settled

#: How two values of a column become one; each is an aggregate whose order doesn't matter.
Merge = Callable[[str], Column]


class Conflict(RuntimeError):
    """Another writer published the version first; the upsert may be tried again."""


class MergedTable:
    def __init__(self, session: SparkSession, path: str, key: Sequence[str], merges: Mapping[str, Merge], *, buckets: int = 64):
        """``key`` may hold nulls; ``merges`` are the other columns. ``buckets`` counts when the table is new, and then stays."""
        self.session, self.path, self.key, self.merges, self.buckets = session, path.rstrip("/"), list(key), dict(merges), buckets

    def _at(self, *parts: str):
        return self.session.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._at().getFileSystem(self.session.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The last version: its number, the buckets' folders, the batches applied, and the number of buckets."""
        files, folder = self._files(), self._at("manifest")
        names = sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return {"version": 0, "folders": {}, "applied": [], "buckets": self.buckets}
        stream = files.open(self._at("manifest", names[-1]))
        try:
            return json.loads(bytes(self.session.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        files, name = self._files(), f"{manifest['version']:010d}.json"
        hidden = self._at("manifest", f".{uuid.uuid4().hex}")
        out = files.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode("utf-8")))
        finally:
            out.close()
        final = self._at("manifest", name)
        if files.exists(final) or not files.rename(hidden, final):
            files.delete(hidden, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there")

    def _read(self, folders: Sequence[str], schema) -> DataFrame:
        if not folders:
            return self.session.createDataFrame([], schema)
        return self.session.read.schema(schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def read(self, schema) -> DataFrame:
        """The rows of the last version; ``schema`` is that of what was put in."""
        return self._read(sorted(self.manifest()["folders"].values()), schema)

    def upsert(self, rows: DataFrame, batch: str) -> int:
        """Merge ``rows`` (the key and the merged columns) into the table as the batch of that name; the version that holds it."""
        before = self.manifest()
        if batch in before["applied"]:
            return before["version"]
        columns = [*self.key, *self.merges]
        merged = [m(c).alias(c) for c, m in self.merges.items()]
        number = F.pmod(F.xxhash64(*self.key), F.lit(before["buckets"])).cast("int")
        new = settled(rows.select(*columns).groupBy(*self.key).agg(*merged).withColumn("_bucket", number))
        schema = new.drop("_bucket").schema
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # no more than there are buckets
        old = self._read([before["folders"][str(b)] for b in touched if str(b) in before["folders"]], schema).withColumn("_bucket", number)
        both = settled(old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).groupBy(*self.key, "_bucket").agg(*merged, F.min("_new").alias("_new")))
        # A bucket is rewritten where a row is new, or differs from the old one.
        known = old.select(*(F.col(c).alias(f"_old_{c}") for c in columns))
        same = [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns]
        changed = both.where("_new = 1").select("_bucket").union(both.where("_new = 0").join(known, same, "left_anti").select("_bucket")).distinct()
        changed = sorted(r[0] for r in changed.collect())  # no more than there are buckets
        after = {**before, "version": before["version"] + 1, "applied": [*before["applied"], batch], "folders": dict(before["folders"])}
        if changed:
            name = f"{after['version']:010d}-{uuid.uuid4().hex}"
            out = both.where(F.col("_bucket").isin(changed)).select(*columns, F.col("_bucket").alias("bucket"))
            out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
            after["folders"] |= {str(b): f"{name}/bucket={b}" for b in changed}
        self._publish(after)
        return after["version"]


def least(c: str) -> Column:
    return F.min(c)


def largest(c: str) -> Column:
    return F.max(c)


def total(c: str) -> Column:
    return F.sum(c)


def union(c: str) -> Column:
    """Arrays as one sorted set."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
