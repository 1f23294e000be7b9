"""Cutting lineage in iterative operators, and the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local master, whose executors are this
    process, gets a folder of this machine where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="weftgraph-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


#: Drops the files of an action's shuffles when the action ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder, dealt as df is. Its shuffles' files go at
    once."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def forget(*frames: DataFrame) -> None:
    """Deletes the files of frames from cut() that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if kept.isDefined():
            at = context._jvm.org.apache.hadoop.fs.Path(kept.get())
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of a table's files for each partition of a shuffle.
SHARE = 4 << 20


#: Most partitions by size, and the size from which on Spark only says that it is unknown.
MOST_SHARES, UNKNOWN = 2048, 1 << 50


def shares(df: DataFrame) -> int:
    """The session's number of shuffle partitions, or more where df's input is larger. A
    size that Spark doesn't know counts as none."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = 0 if size >= UNKNOWN else min(MOST_SHARES, -(-size // SHARE))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), known)


def many(*frames: DataFrame) -> int:
    """Partitions over which to deal() what is made of the frames, by the size of all files
    they read, whatever columns; 0 where the session's number will do."""
    spark, size = frames[0].sparkSession, 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        size += sum(x for x in sizes if x < UNKNOWN)
    n = min(MOST_SHARES, -(-size // SHARE))
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def deal(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """df over n partitions by the keys, so that a task of the join or aggregate by them that
    follows holds a share that doesn't grow with the input; as it is where n is 0."""
    return df.repartition(n, *keys) if n else df
