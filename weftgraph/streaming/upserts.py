"""Continuous upserts of nodes and edges.

A table's rows are dealt over buckets by a hash of their key. A batch reads and
writes only the buckets it touches. Its last step is a manifest, which names the
folder of every bucket and the last batch of every stream; readers see the newest
manifest, so a batch is there as a whole or not at all. A batch that is tried again
after its manifest was written is passed over. Folders that neither of the last two
manifests names are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import EDGE_SCHEMA, NODE_SCHEMA
from ..operators.store import EDGE_KEY, NODE_KEY, upsert_edges, upsert_nodes

#: Buckets of a table, a choice that its first version fixes.
BUCKETS = 64

#: Manifests whose folders are kept, for readers of the version before.
KEPT = 2


class VersionedTable:
    """A Parquet table under path. key: columns by whose hash rows have their buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Iterable[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, tuple(key), buckets
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[int]:
        if not self.fs.exists(self._at("manifests")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The newest version, -1 before the first."""
        return max(self._versions(), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            return {"buckets": self.buckets, "parts": {}, "batches": {}}
        stream = self.fs.open(self._at(f"manifests/{version}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        return self._parts(self.manifest(version)["parts"])

    def _parts(self, parts: dict[str, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{folder}/bucket={k}" for k, folder in sorted(parts.items())])

    def merge(self, batch: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], stream: str = "", number: int | None = None) -> None:
        """Makes the next version from merged(rows of the touched buckets, batch). number:
        of the batch in its stream."""
        version = self.version()
        now = self.manifest(version)
        if number is not None and number <= now["batches"].get(stream, -1):
            return
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(now["buckets"])).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # one number a bucket at most
        folder = f"v{version + 1}"
        old = self._parts({k: v for k, v in now["parts"].items() if int(k) in touched})
        out = merged(old, batch).withColumn("bucket", bucket).repartition("bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        now["parts"] |= {str(k): folder for k in touched}
        if number is not None:
            now["batches"][stream] = number
        self._publish(version + 1, now)

    def _publish(self, version: int, manifest: dict) -> None:
        draft = self._at(f"manifests/{version}.draft")
        out = self.fs.create(draft, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        self.fs.rename(draft, self._at(f"manifests/{version}.json"))
        versions = self._versions()
        used = {f for v in versions[-KEPT:] for f in self.manifest(v)["parts"].items()}
        for v in versions[:-KEPT]:
            for k, folder in self.manifest(v)["parts"].items():
                if (k, folder) not in used:
                    self.fs.delete(self._at(f"{folder}/bucket={k}"), True)
            self.fs.delete(self._at(f"manifests/{v}.json"), False)


def node_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, NODE_SCHEMA, NODE_KEY)


def edge_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, EDGE_SCHEMA, EDGE_KEY)


def _stream(changes: DataFrame, table: VersionedTable, merged: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """A stream is known by its checkpoint: with a new one batches count anew, and are
    merged with what the table has."""

    def each(batch: DataFrame, number: int) -> None:
        table.merge(batch, merged, checkpoint, number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_nodes(changes: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """changes: a stream with the columns of nodes. Handles what there is, and ends."""
    return _stream(changes, table, upsert_nodes, checkpoint)


def stream_edges(changes: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    return _stream(changes, table, upsert_edges, checkpoint)


def poll_interval_ms(files: int) -> int:
    """How often to look for changes: a second more for every 500 files, a minute at most."""
    return min(5000 + 1000 * (files // 500), 60_000)


def replace_files(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after some files (file_path) were read again: their old nodes go with the
    edges that begin in them; edges into them stay where the target exists again."""
    old = nodes.join(changed.select("file_path"), "file_path", "left_semi").select("id")
    kept = nodes.join(changed.select("file_path"), "file_path", "left_anti").select(*nodes.columns)
    after = upsert_nodes(kept, new_nodes)
    stay = edges.join(old.withColumnRenamed("id", "src"), "src", "left_anti").select(*edges.columns)
    ids = after.select(F.col("id").alias("dst"))
    return after, upsert_edges(stay.join(ids, "dst", "left_semi").select(*edges.columns), new_edges)
