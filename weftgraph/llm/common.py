"""Shared helpers: written intermediates, bounded Arrow batches, byte buffers."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at once.
BLOCK_BYTES = 2 << 20

#: Bytes of an Arrow batch after which no row is added to it.
BATCH_BYTES = 32 << 20

#: The white space that separates words: space and TAB to CR.
WHITE_SPACE = r"\x20\x09-\x0D"

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master, whose executors are this
    process, gets a folder of this machine where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage
    in a way that survives a lost executor. Its shuffles' files go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    _PATHS.append(path)
    return out


#: Folders of written() that are still there, in the order in which they were written.
_PATHS: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)
    if path in _PATHS:
        _PATHS.remove(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of frames from written() that nothing reads any more."""
    for df in frames:
        _delete(spark, df.written_at)


@contextlib.contextmanager
def scratch(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes what written() writes inside, but for the frames that are put into the list
    it gives: for a step whose result is itself written there."""
    before, out = set(_PATHS), list(keep)
    yield out
    kept = {df.written_at for df in out}
    for path in [p for p in _PATHS if p not in before and p not in kept]:
        _delete(spark, path)


#: At most so many keys can each have more than the same fraction of all rows.
HOT_KEYS = 1024


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """rows.join(table, key) for a table with one row a key, with the count of that key's
    rows among all n. Fewer than HOT_KEYS keys can have more than n / HOT_KEYS rows each;
    only these are broadcast, so that no task gets all rows of a frequent key."""
    hot = F.col(count) * HOT_KEYS > n
    frequent = table.where(hot)
    rest = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(table.where(~hot), key)
    return rest.unionByName(rows.join(F.broadcast(frequent), key))


def row_key(docs: DataFrame) -> list[Column]:
    """Two 64-bit hashes, _k1 and _k2, over all columns: rows with equal ones are taken to
    be equal, in every column. Nulls count by their place."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    values = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t.simpleString() or "variant" in t.simpleString() else F.col(f"`{c}`") for c, t in kinds.items()]
    empty = [F.col(f"`{c}`").isNull() for c in kinds]
    return [F.xxhash64(F.lit(i), *values, *empty).alias(f"_k{i}") for i in (1, 2)]


def keep_rows(docs: DataFrame, gone: DataFrame, twins: DataFrame) -> DataFrame:
    """docs without the rows whose keys (_k1, _k2 of row_key) are in gone, and with one of
    the equal rows for each key in twins; the tables have no key in common."""
    key = ["_k1", "_k2"]
    named = docs.select("*", *row_key(docs))
    if twins.isEmpty():
        return named.join(gone.select(*key).distinct(), key, "left_anti").select(*docs.columns)
    rest = named.join(gone.select(*key).union(twins.select(*key)).distinct(), key, "left_anti")
    once = named.join(twins.select(*key).distinct(), key, "left_semi").dropDuplicates(key)
    return rest.union(once.select(*rest.columns)).select(*docs.columns)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds the rows of an Arrow batch for this session, so that a batch of long
    texts fits in a Python worker."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < now <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (one more than rows); null
    counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most limit bytes each, or of one row."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(rows, max(b, a + 1))
        yield a, b
        a = b


def binary_array(parts: Iterable[bytes | None]) -> pa.Array:
    return pa.array(list(parts), type=pa.binary())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def odd_words(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit words."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)
