"""Vector arithmetic on arrays, within generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different or no length, or without direction."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 1e-10), dot(a, b) / norm).otherwise(F.lit(0.0))


def minimum_cosine(v: Column, queries: list[list[float]]) -> Column:
    """The least cosine with several fixed vectors."""
    each = [cosine(v, F.array(*[F.lit(float(x)) for x in q])) for q in queries]
    return each[0] if len(each) == 1 else F.least(*each)


def weighted(parts: dict[str, float]) -> Column:
    """Sum of columns by weight, null counting as 0."""
    return reduce(lambda a, b: a + b, [F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in parts.items()])


def register(spark) -> None:
    """regexp, iregexp, cosine and camel_split as SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION iregexp(p STRING, s STRING) RETURNS BOOLEAN RETURN s RLIKE concat('(?i)', p)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION regexp_found(p STRING, s STRING) RETURNS BOOLEAN RETURN s RLIKE p")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION camel_split(s STRING) RETURNS STRING RETURN "
        r"concat_ws(' ', s, regexp_replace(s, '(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])', ' '))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN "
        "CASE WHEN size(a) <> size(b) OR size(a) = 0 THEN 0D ELSE coalesce("
        "aggregate(zip_with(a, b, (x, y) -> cast(x AS DOUBLE) * y), 0D, (s, x) -> s + x) / "
        "nullif(sqrt(aggregate(a, 0D, (s, x) -> s + cast(x AS DOUBLE) * x) * aggregate(b, 0D, (s, x) -> s + cast(x AS DOUBLE) * x)), 0D), 0D) END"
    )
