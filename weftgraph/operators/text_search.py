"""Full-text and line search."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import literal_hints
from ..functions.text import camel_split, without_accents, word_tokens
from .store import tightest

#: Parameters of the ranking function. Fixed values.
K1, B = 1.2, 0.75

#: What a label adds to a score. Fixed values.
BOOSTS = {"Function": 10.0, "Method": 10.0, "Route": 8.0, "Class": 5.0, "Interface": 5.0, "Type": 5.0, "Enum": 5.0}

#: Labels that a search leaves out. Fixed values.
NOISE = ("File", "Folder", "Module", "Section", "Variable", "Project", "Package")


def index(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings (token, key, tf, dl), a row for each word of each row of docs, and one row of
    figures (n, avgdl). dl: words of the document. Words are counted within their row, where
    equal ones are neighbours once sorted, so that no row goes to another task."""
    rows = docs.select(F.col(key).alias("key"), F.sort_array(word_tokens(F.col(text))).alias("words")).withColumn("dl", F.coalesce(F.size("words"), F.lit(0)).cast("bigint"))
    rows = rows.withColumn("dl", F.greatest("dl", F.lit(0).cast("bigint")))
    first = F.transform("words", lambda w, i: F.when((i == 0) | (w != F.get("words", i - 1)), i))
    begun = rows.withColumn("starts", F.filter(first, lambda i: i.isNotNull())).select("*", F.posexplode_outer("starts").alias("nth", "start"))  # outer: else Spark finds all again for each word, to leave out empty rows early
    tf = F.coalesce(F.get("starts", F.col("nth") + 1), "dl") - F.col("start")
    postings = begun.where(F.col("nth").isNotNull()).select(F.get("words", "start").alias("token"), "key", tf.cast("bigint").alias("tf"), "dl")
    return postings.withColumnRenamed("key", key), rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))


#: Bytes of files for a segment of an index. A task sorts such a segment's postings in some
#: 500 MB; more it would spill.
SEGMENT = 32 << 20

_SPLIT = "spark.sql.files.maxPartitionBytes"


def write_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Writes the index below path: a segment for each partition of docs, in the order of
    words, so that a search reads the pages of its own words. Nothing is shuffled: postings
    are sorted in the task that made them, and written once. Files are read in parts of
    SEGMENT bytes or a row group."""
    postings, figures = index(docs, key, text)
    spark = docs.sparkSession
    before, split = spark.conf.get(_SPLIT, None), spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.conf.set(_SPLIT, str(min(SEGMENT, split)))
    try:
        postings.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    finally:
        if before is None:
            spark.conf.unset(_SPLIT)
        else:
            spark.conf.set(_SPLIT, before)
    figures.coalesce(1).write.mode("overwrite").parquet(f"{path}/figures")


#: Words that a condition on a segment names at most; of more, Spark's readers compare only
#: the least and the greatest with a page's.
_NAMED = 10


def search_index(spark: SparkSession, path: str, key: str, query: str, limit: int | None = None) -> DataFrame:
    """key, score of the documents with any word of the query, as bm25 gives them, from a
    written index. Of each segment only the pages of the query's words are read. Scores of
    rows that share a key are added up."""
    words = query_tokens(query)
    wanted = F.lit(False)
    for i in range(0, len(words), _NAMED):
        wanted = wanted | F.col("token").isin(words[i : i + _NAMED])
    postings = spark.read.parquet(f"{path}/postings").where(wanted)
    df = postings.groupBy("token").agg(F.count(F.lit(1)).cast("double").alias("df"))  # a row for a word
    rows = postings.join(F.broadcast(df), "token").crossJoin(F.broadcast(spark.read.parquet(f"{path}/figures")))  # one row
    tf = F.col("tf").cast("double")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = rows.groupBy(key).agg(F.sum(part).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def query_tokens(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


#: What words are made of.
_WORD = r"\p{L}\p{N}_"


def bm25(docs: DataFrame, key: str, text: str, query: str, limit: int | None = None) -> DataFrame:
    """key, score of the documents with any word of the query, without an index. Words are
    counted in the text by regular expressions, so that no list of words is ever made; a
    text that doesn't contain a word is not searched for it. For more searches than one
    write_index and search_index."""
    words = query_tokens(query)
    lowered = F.col("_low")
    counts = [F.when(lowered.contains(w), F.regexp_count(lowered, F.lit(rf"(?<![{_WORD}]){re.escape(w)}(?![{_WORD}])"))).otherwise(F.lit(0)) for w in words]
    once = docs.select(key, F.lower(text).alias("_low"))  # lower-cased once for all words
    rows = once.select(key, F.regexp_count("_low", F.lit(f"[{_WORD}]+")).cast("double").alias("dl"), *[c.alias(f"tf{i}") for i, c in enumerate(counts)])
    stats = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.coalesce("dl", F.lit(0.0))).alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(words))])
    joined = rows.where(" or ".join(f"tf{i} > 0" for i in range(len(words))) or "false").crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    out = joined.select(key, score.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def search_nodes(nodes: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """id, score: nodes by the words of their name (also split), qualified name, label
    and path, all without accents; labels that matter more ranked up."""
    inner = nodes.where(~F.col("label").isin(*NOISE))
    text = F.concat_ws(" ", camel_split(F.col("name")), F.col("qualified_name"), F.col("label"), F.col("file_path"))
    plain = "".join(c for c in unicodedata.normalize("NFD", query) if not unicodedata.combining(c))
    scored = bm25(inner.withColumn("_text", without_accents(text)), "id", "_text", plain)
    boost = F.create_map(*[F.lit(x) for pair in BOOSTS.items() for x in pair])
    ranked = scored.join(nodes.select("id", "name", "label"), "id").select("id", "name", "label", (F.col("score") + F.coalesce(F.try_element_at(boost, F.col("label")), F.lit(0.0))).alias("score"))
    return ranked.orderBy(F.desc("score"), "id").limit(limit)


def line_pattern(query: str) -> str:
    """Several words match in their order with anything between."""
    words = query.split()
    return ".*".join(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", w) for w in words) if len(words) > 1 else query


def grep(files: DataFrame, pattern: str, key: str = "file_path", text: str = "text") -> DataFrame:
    """key, line (from 1), content of the lines with the pattern."""
    some = files
    for hint in literal_hints(pattern):  # whole texts first: a cheap test
        some = some.where(F.col(text).contains(hint))
    lines = some.select(key, F.posexplode(F.split(text, "\n")).alias("i", "content"))
    return lines.where(F.col("content").rlike(pattern)).select(key, (F.col("i") + 1).alias("line"), "content")


def search_code(files: DataFrame, nodes: DataFrame, edges: DataFrame, query: str, path_filter: str | None = None, limit: int = 50) -> DataFrame:
    """id, name, label, file_path, hits, score of the nodes whose lines match."""
    hits = grep(files if path_filter is None else files.where(F.col("file_path").rlike(path_filter)), line_pattern(query))
    found = tightest(nodes, hits.select("file_path", "line"))
    per = found.groupBy("id", "name", "label", "file_path").agg(F.count(F.lit(1)).alias("hits"))
    fan_in = edges.where(F.col("type") == "CALLS").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    path, label = F.col("file_path"), F.col("label")
    score = (
        F.coalesce("d", F.lit(0))
        + F.when(label.isin("Function", "Method"), 10).when(label == "Route", 15).otherwise(0)
        - F.when(path.rlike("(^|/)(vendor|node_modules|third_party)/"), 50).otherwise(0)
        - F.when(path.rlike("test|spec"), 5).otherwise(0)
    )
    return per.join(fan_in, "id", "left").select("id", "name", "label", "file_path", "hits", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def directories(found: DataFrame) -> DataFrame:
    """Top folder and number of results."""
    return found.groupBy(F.regexp_extract("file_path", r"^([^/]*)", 1).alias("directory")).agg(F.count(F.lit(1)).alias("n"))


def snippet(nodes: DataFrame, files: DataFrame, qualified_name: str) -> DataFrame:
    """id, code of the node with this qualified name, else of the only one that ends in it."""
    suffix = nodes.where(F.col("qualified_name").ilike(f"%.{qualified_name}") | (F.col("qualified_name") == qualified_name))
    exact = F.col("qualified_name") == qualified_name
    stats = suffix.agg(F.max(exact).alias("hit"), F.count(F.lit(1)).alias("n"))
    one = suffix.crossJoin(F.broadcast(stats)).where(exact | (~F.col("hit") & (F.col("n") == 1)))  # one row
    code = F.array_join(F.slice(F.split("text", "\n"), F.greatest("start_line", F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))), "\n")
    return one.join(files.select("file_path", "text"), "file_path").select("id", "qualified_name", code.alias("code"))


def suggestions(nodes: DataFrame, qualified_name: str, limit: int = 10) -> DataFrame:
    tail = qualified_name.rpartition(".")[2]
    return nodes.where((F.col("name") == tail) | F.col("qualified_name").ilike(f"%{tail}%")).select("id", "name", "qualified_name").orderBy("qualified_name", "id").limit(limit)
