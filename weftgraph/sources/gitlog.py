"""Captured output of git as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import hunk

def commits(spark: SparkSession, path: str) -> DataFrame:
    """commit_id, ts, file from captured logs (git log --name-only --format='commit:%H %ct').
    Logs are cut at their commits as they are
    read, so that a log of any length is read in parallel."""
    lines = spark.read.option("lineSep", "\ncommit:").text(path).select(F.regexp_replace("value", "^commit:", "").alias("value"))
    rows = lines.select(F.split("value", "\n").alias("l"))
    named = rows.select(F.regexp_extract(F.try_element_at("l", F.lit(1)), r"^([0-9a-f]+) ", 1).alias("commit_id"), F.regexp_extract(F.try_element_at("l", F.lit(1)), r" ([0-9]+)$", 1).try_cast("bigint").alias("ts"), F.explode(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))).alias("file"))
    return named.where((F.col("commit_id") != "") & (F.trim("file") != "")).withColumn("file", F.trim("file"))


def name_status(lines: DataFrame) -> DataFrame:
    """status, file, old_file of the lines (value) of git diff --name-status."""
    parts = F.split("value", "\t")
    rows = lines.select(F.substring(parts[0], 1, 1).alias("status"), F.element_at(parts, -1).alias("file"), F.when(F.size(parts) > 2, parts[1]).alias("old_file"))
    return rows.where(F.col("status").isin("A", "M", "D", "R", "C", "T"))


def hunks(diffs: DataFrame) -> DataFrame:
    """file, old_start, old_count, new_start, new_count. diffs: one row per file's diff, as
    text from its `diff --git` on."""
    name = F.regexp_extract("value", r"(?m)^\+\+\+ b/(.*)$", 1)
    lines = diffs.select(name.alias("file"), F.explode(F.split("value", "\n")).alias("line")).where(F.col("line").startswith("@@ "))
    return lines.select("file", *[c.alias(n) for n, c in hunk(F.col("line")).items()])
