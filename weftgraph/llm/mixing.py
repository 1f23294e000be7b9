"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix belongs to the source whose interval of the cumulative target
shares holds the point frac(i / golden ratio). Slots are ranked within their
source, and slot r of a source takes the r-th equal-token block of the source's
shuffled words, from the first again after the last. So any stretch of the mix
has each source near its share, and a source's words are taken once over before
any is taken twice.

Nothing runs in one task for a whole source: documents are shuffled into
cells by a hash, running totals are taken within a cell and then over the
cells' sums, and slots are ranked within stretches and then over the
stretches' counts. A row is named by the hashes of all its columns and its
number among the rows that are equal to it, so that rows that share a doc_id, or
have none, are mixed one by one, and equal rows are dealt over all cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, row_key, written

#: Weights of the sources in code point order, repeating. Fixed values.
WEIGHTS = (5, 2, 1)

#: The mix has this share of all words; a source gives its words so often at most.
SHARE, MOST = 1.5, 2.0

#: Rows of a part of the table within which equal rows are numbered, and runs of equal
#: rows that get their text from one copy of it.
EQUAL_ROWS = 1 << 12

#: Cells of the unit interval by which points meet intervals.
GRID = 1024

GOLDEN = (math.sqrt(5) - 1) / 2


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE_SPACE}]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target. sizes: one row per source. Weighted shares of
    share times all words, where each stops at most times its source's size and the
    rest is shared again by weight: the t in min(cap, t * weight) that uses all of
    it. In order of cap / weight, sources stop as long as t reaches their cap."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    repeated = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", repeated).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumns({"total": share * F.sum("source_size").over(everything), "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("weight").over(onward)})
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    stops = F.col("level") * F.col("weight") >= F.col("cap")
    s = s.withColumn("t", F.max(F.when(~stops, F.col("level"))).over(everything))
    return s.select("source", "source_size", F.when(stops | F.col("t").isNull(), F.col("cap")).otherwise(F.least(F.col("t") * F.col("weight"), F.col("cap"))).alias("target"))


def _running(df: DataFrame, key: list[str], cell: str, order: list, amount: str, name: str) -> DataFrame:
    """Adds the running total of amount before each row, within key, cell by cell."""
    inside = Window.partitionBy(*key, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*key, cell).agg(F.sum(amount).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    df = df.withColumn("_in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    other = sums.select(*[F.col(k).alias(f"_k_{k}") for k in (*key, cell)], "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key] + [F.col(cell) == F.col(f"_k_{cell}")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(other, cond).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", *[f"_k_{k}" for k in (*key, cell)])


class Mix:
    """The mix of docs (doc_id, text, source).

    sizes, plan: written tables of the documents' places and of the sources' targets.
    block: words in a block; by default 1/256 of what the smallest open source is to
    give, 16 at least and 4096 at most.

    Null text has no words, null source is a source of its own and comes last, rows
    with a null doc_id are mixed like others. Rows that share a doc_id, or are equal in
    all columns, have places of their own, each with its own words. An empty table, or one
    without words, gives an empty schedule, and documents of which nothing is taken.
    """

    def __init__(self, docs: DataFrame, seed: int = 17, block: int | None = None):
        spark = docs.sparkSession
        named = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *row_key(docs))
        rows = written(named.withColumn("part", F.floor(F.monotonically_increasing_id() / EQUAL_ROWS)), "mix-sizes")
        per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
        self.plan = written(targets(per.select("source", "source_size")).withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1), "mix-plan")
        n, least, total = rows.agg(F.count(F.lit(1))).crossJoin(self.plan.where("target > 0").agg(F.min("target"), F.sum("target"))).first()
        self.block = block or int(min(4096, max(16, (least or 0) / 256)))
        self.slots = int(math.ceil((total or 0) / self.block))
        cells = max(1, math.isqrt(n))  # a cell has as many rows as there are cells
        # equal rows are numbered, by parts of the table first; which of them has which number doesn't matter
        rows = _running(rows.withColumn("one", F.lit(1)), ["_k1", "_k2"], "part", [F.col("doc_id")], "one", "twin").drop("part", "one")
        h = F.xxhash64(F.col("_k1"), F.col("_k2"), F.col("twin"), F.lit(seed))
        placed = rows.withColumns({"h": h, "cell": F.pmod(F.shiftright(h, 20), F.lit(cells)).cast("int")})
        placed = placed.join(self.plan.select(F.col("source").alias("_s"), "s", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        self.places = written(_running(placed, ["s"], "cell", [F.col("h"), F.col("_k1"), F.col("_k2"), F.col("twin")], "size", "at").drop("cell", "h", "source"), "mix-places")
        self.spark = spark

    def schedule(self) -> DataFrame:
        """slot, s, rank: the source of each slot and its rank within the source."""
        stretch = max(1, math.isqrt(self.slots))
        slots = self.spark.range(self.slots).select(F.col("id").alias("slot"), F.expr(f"(id + 0.5D) * {GOLDEN!r}D").alias("x"))
        slots = slots.withColumn("u", F.col("x") - F.floor("x")).withColumn("g", F.floor(F.col("u") * GRID)).drop("x")
        upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        shares = self.plan.where("target > 0").withColumn("hi", F.sum("target").over(upto) / F.sum("target").over(Window.partitionBy()))
        shares = shares.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("s")), F.lit(0.0)))
        last = F.row_number().over(Window.orderBy(F.desc("s"))) == 1
        shares = shares.withColumn("hi", F.when(last, F.lit(1.0)).otherwise(F.col("hi")))
        met = shares.select("s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)))).alias("g"))
        named = slots.join(met, "g").where("u >= lo and u < hi").select("slot", "s", F.expr(f"slot div {stretch}").alias("stretch"), F.lit(1).alias("one"))
        return _running(named, ["s"], "stretch", [F.col("slot")], "one", "rank").select("slot", "s", "rank")

    def blocks(self) -> DataFrame:
        """s, block, at, size, skip, words: block b of source s has words of a document
        from its word skip on, (s, at) names its row. It lies in as many blocks as it touches."""
        b = self.block
        held = self.places.where("size > 0")
        held = held.select("*", F.explode(F.sequence(F.expr(f"at div {b}"), F.expr(f"(at + size - 1) div {b}"))).alias("b"))
        start, end = F.greatest(F.col("at"), F.col("b") * b), F.least(F.col("at") + F.col("size"), (F.col("b") + 1) * b)
        return held.select("s", F.col("b").alias("block"), "at", "size", (start - F.col("at")).alias("skip"), (end - start).alias("words"))

    def taken_blocks(self) -> DataFrame:
        """s, block, times, first, rest: how often and from which slot on the mix takes each
        block; of rest, where it isn't null, only so many words the last time. A source
        gives just the words of its target: slots beyond them aren't taken, and those
        that the schedule leaves out follow behind it."""
        b, size = self.block, F.col("source_size")
        words = F.round("target").cast("bigint")
        counts = self.plan.where("target > 0").select("s", F.ceil(size / b).alias("n"), F.expr("cast(round(target) as bigint) div source_size").alias("passes"), F.pmod(words, size).alias("more"))
        counts = counts.withColumn("need", F.col("passes") * F.col("n") + F.ceil(F.col("more") / b))
        schedule = self.schedule()
        slots = schedule.join(counts, "s").where("rank < need").select("s", "slot", "rank", "n", "more")
        have = schedule.groupBy("s").agg(F.count(F.lit(1)).alias("have"))
        late = counts.join(have, "s", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
        late = late.select("s", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"), "n", "more").select("s", (F.col("rank") + self.slots).alias("slot"), "rank", "n", "more")
        taken = slots.union(late).groupBy("s", F.expr("rank % n").alias("block")).agg(F.count(F.lit(1)).alias("times"), F.min("slot").alias("first"), F.first("more").alias("more"))
        rest = F.col("more") - F.col("block") * b
        return taken.withColumn("rest", F.when((rest > 0) & (rest < b), rest)).drop("more")

    def pieces(self) -> DataFrame:
        """s, block, at, size, skip, words, times, first, last: the blocks' words with how
        often they are taken, and how many of them the last time. (s, at) names one row of
        docs."""
        p = self.blocks().join(self.taken_blocks(), ["s", "block"])
        ahead = F.col("at") + F.col("skip") - F.col("block") * self.block  # words of the block before these
        last = F.greatest(F.lit(0), F.least("words", F.coalesce("rest", F.lit(self.block)) - ahead))
        return p.withColumn("last", last).drop("rest")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken for every row of docs."""
        sums = self.pieces().groupBy("s", "at", "size").agg(F.sum(F.col("words") * (F.col("times") - 1) + F.col("last")).alias("taken"))
        return self.places.join(sums.where("size > 0"), ["s", "at", "size"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, block: int | None = None) -> DataFrame:
    """The mix as rows with the columns of docs, in the order of the schedule. A
    document comes as often as the schedule takes it, cut at the words where its
    turns begin and end: all of it where all its blocks are taken equally often. So does
    each of several rows that share a doc_id, have none, or are equal in all columns."""
    mix = Mix(docs, seed, block)
    p = mix.pieces().select("s", "at", "skip", "words", "first", "last", "times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn"))
    p = p.withColumn("words", F.when(F.col("turn") < F.col("times"), F.col("words")).otherwise(F.col("last"))).where("words > 0")
    runs = p.groupBy("s", "at", "turn").agg(F.min("skip").alias("_skip"), F.sum("words").alias("_words"), F.min("first").alias("_first"), F.max("turn").alias("_turn"))
    runs = runs.join(mix.places.where("size > 0").select("s", "at", "size", "_k1", "_k2", "twin"), ["s", "at"])
    runs = runs.select("_k1", "_k2", F.expr(f"cast(twin div {EQUAL_ROWS} as int)").alias("_salt"), "_skip", "_words", "_first", "_turn", F.col("size").alias("_size"))
    key = ["_k1", "_k2"]
    named = docs.select("*", *row_key(docs))
    most = mix.places.agg(F.max("twin")).first()[0] or 0
    if most:
        named = named.dropDuplicates(key)
    whole = named.join(runs.where("_salt = 0").drop("_salt"), key)
    if most >= EQUAL_ROWS:  # a text that very many rows have is copied for every so many of them
        salted = runs.where("_salt > 0")
        tops = salted.groupBy(*key).agg(F.max("_salt").alias("_top"))
        copies = named.join(tops, key).withColumn("_salt", F.explode(F.sequence(F.lit(1), F.col("_top")))).drop("_top")
        whole = whole.unionByName(copies.join(salted, [*key, "_salt"]).drop("_salt"))
    word = rf"[^{WHITE_SPACE}]+[{WHITE_SPACE}]*"
    part = F.expr(f"array_join(slice(regexp_extract_all(text, '{word}', 0), cast(_skip + 1 as int), cast(_words as int)), '')".replace("\\", "\\\\"))
    text = F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(part)
    ordered = whole.withColumn("text", text).repartitionByRange(F.col("_turn"), F.col("_first")).sortWithinPartitions("_turn", "_first", "doc_id")
    columns = [F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return ordered.select(*columns)
