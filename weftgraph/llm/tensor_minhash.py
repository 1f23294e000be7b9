"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct five-word shingles. Instead of one band of
minhashes for each of many tables, two small collections of M bands of T
minhashes are computed, and table (i, j) is keyed by the pair of band i of the
first and band j of the second: 2 M T minhashes serve M^2 tables of bands as
wide as 2 T. Two documents meet in a table if they agree in a band of either
collection.

From the tables to components, with links confirmed on full sets only:

1. Documents with equal sets are one node, named by its smallest doc_id, or by a hash
   of the set where the table has doc_ids that several texts share, or rows without one.
2. Keys of either collection that only one node has are dropped before pairs of
   keys are formed, so that most documents form none.
3. Each node is confirmed against the smallest node of a table, the one with
   which it shares the most tables.
   Nodes that such pairs join, confirmed or not, are a family.
4. In a family with several components, the nodes outside the largest are compared
   on full sets with all the family's nodes of about their size, in blocks of a bounded
   number of shingles. The sets go there as hashes, made once from the texts.
5. Nodes of different families that meet in a table are compared by the sketches of
   their minhashes, in blocks, and pairs that are alike enough are confirmed. Pairs
   within a component need no comparison.

No bucket is dropped and no pair is left out for its bucket's size, and no task
holds more than a block of a bucket.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, binary_array, blocks, forget, join_counted, keep_rows, mix64, odd_words, row_key, small_batches, text_bytes, written
from .components import components

WORDS = 5

#: Similarity as 100 * intersection >= PERCENT * union.
PERCENT = 85

#: Minhashes in a band.
T = 3

#: Chances with which a pair of just the percentage asked for may meet in no table, and
#: may have sketches that seem too unlike.
MISSED, UNLIKE = 1.5e-4, 1.1e-4

#: Nodes of a block of those that share a band.
BLOCK_NODES = 256

#: Documents confirmed against one node by one task, and nodes of a chunk of a family
#: of which pairs are given.
CONFIRMED_ROWS = 512

#: Shingles of a chunk of a family whose nodes are all compared; a family of fewer than
#: FEW_CHUNKS such chunks is cut finer, into as many at most, to be dealt over tasks.
CHUNK_SHINGLES, FEW_CHUNKS, LEAST_SHINGLES = 1 << 19, 8, 1 << 15

#: Shingles of a matrix.
MATRIX_COLUMNS = 4096

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = odd_words(101, 256)
_BYTE[_SPACE] = 0
_BYTE = _BYTE[_LOWER]
_PLACE = odd_words(202, 1 << 12)
_WORD = odd_words(303, WORDS)


@functools.cache
def search(percent: int) -> tuple[int, int]:
    """M, the bands in a collection, and the number of equal sketch bytes below which
    a pair can't be similar enough: as few bands and as many bytes as MISSED and UNLIKE
    allow."""
    p = percent / 100
    m = 1
    while 2 * (1 - p**T) ** m > MISSED:
        m += 1
    n, need, below = 2 * m * T, 0, 0.0
    while need < n and (below := below + math.comb(n, need) * p**need * (1 - p) ** (n - need)) <= UNLIKE:
        need += 1
    return m, need


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the rows, and their offsets by row."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = inside[starts]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    spans = np.diff(np.append(at, len(data)))
    place = np.arange(at[0], len(data)) - np.repeat(at, spans)
    table = _PLACE if (longest := int(place.max())) < len(_PLACE) else odd_words(202, longest + 1)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[data[at[0] :]] * table[place], at - at[0])
    return mix64(sums), np.searchsorted(at, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each row the sorted hashes of its distinct shingles."""
    words, by_row = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - WORDS + 1)
        sums = np.zeros(n, U64)
        for k in range(WORDS):
            sums += words[k : k + n] * _WORD[k]
        sums = mix64(sums)
        out = []
        for a, b in zip(by_row[:-1].tolist(), by_row[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(sums[a : b - WORDS + 1]))
            elif b > a:
                out.append(mix64((words[a:b] * _WORD[: b - a]).sum(keepdims=True) + U64(b - a)))
            else:
                out.append(np.zeros(0, U64))
    return out


def minhashes(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Rows x 2 M T; sets must not be empty."""
    flips, words = odd_words(505, 2 * m * T), odd_words(404, 2 * m * T)
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), len(words)), U64)
    with np.errstate(over="ignore"):
        for k in range(len(words)):
            out[:, k] = np.minimum.reduceat((flat ^ flips[k]) * words[k], at)
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """Rows x 2 M keys of the bands; the first M are the first collection."""
    keys = odd_words(606, values.shape[1] // T)
    out = np.empty((len(values), len(keys)), U64)
    with np.errstate(over="ignore"):
        for k in range(len(keys)):
            h = np.full(len(values), keys[k], U64)
            for t in range(T):
                h = mix64(h ^ values[:, k * T + t])
            out[:, k] = h
    return out


SIGNED = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary, text_hash bigint"


def _sign(m: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                lists: list = [None] * len(sets)
                sketches: list = [None] * len(sets)
                if full:
                    values = minhashes([sets[i] for i in full], m)
                    for i, row, v in zip(full, bands(values).view(np.int64), values.astype(np.uint8), strict=True):
                        keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        lists[i] = row
                        sketches[i] = v.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), binary_array(keys), pa.array(lists, pa.list_(pa.int64())), binary_array(sketches), batch.column(2).slice(a, b - a)],
                    names=["doc_id", "n_shingles", "set_key", "bands", "sketch", "text_hash"],
                )

    return run


def sign(docs: DataFrame, m: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets, null for empty ones), the
    keys of the bands, the sketch (a byte of each minhash) and a hash of the text."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_sign(m), SIGNED)


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns node, text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in blocks(offsets):
            sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), binary_array(x.tobytes() for x in sets)], names=["node", "n", "hashes"])


def hashed_sets(texts: DataFrame) -> DataFrame:
    """node, n and hashes: the sorted hashes of the distinct shingles of each text."""
    return texts.select("node", "text").mapInArrow(_hashed, "node bigint, n bigint, hashes binary")


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", U64) for x in column.to_pylist()]


def tables(nodes: DataFrame, m: int) -> DataFrame:
    """key, node: the tables' entries with at least two nodes. nodes: node, bands."""
    keys = nodes.select("node", F.posexplode("bands").alias("i", "h")).select("node", (F.col("i") >= m).alias("second"), "h")
    shared = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    sides = keys.join(shared, "h").groupBy("node").agg(F.collect_list(F.when(~F.col("second"), F.col("h"))).alias("a"), F.collect_list(F.when(F.col("second"), F.col("h"))).alias("b"))
    pairs = sides.select("node", "b", F.explode("a").alias("x")).select("node", "x", F.explode("b").alias("y"))
    entries = written(pairs.select(F.xxhash64("x", "y").alias("key"), "node"), "entries")
    many = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return entries.join(many, "key")


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union. s, t: sorted, distinct."""
    n, m = len(s), len(t)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate([s, t])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (n + m - common)


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns v, chunk, u, hashes; a row with u = v is v's own and comes before the
        rows that are to be confirmed with it."""
        held, mine = None, np.zeros(0, U64)
        for batch in batches:
            v, u = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: tuple[list, list] = ([], [])
            for i, s in enumerate(_sets(batch.column(3))):
                if u[i] == v[i]:
                    held, mine = v[i], s
                elif held == v[i] and similar(s, mine, percent):
                    out[0].append(u[i])
                    out[1].append(v[i])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["u", "v"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) that are similar enough on full sets. sets: node, hashes. The
    pairs of one v are dealt over as many chunks as they need."""
    n = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / CONFIRMED_ROWS).cast("int").alias("chunks"))
    asked = pairs.join(n, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int").alias("chunk"))
    own = n.select(F.col("v").alias("u"), "v", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows = asked.union(own).join(sets.withColumnRenamed("node", "u"), "u")
    laid = rows.select("v", "chunk", "u", "hashes").repartition("v", "chunk").sortWithinPartitions("v", "chunk", F.col("u") != F.col("v"), "u")
    return laid.mapInArrow(_confirm(percent), "u bigint, v bigint")


def _alike(m: int, need: int):
    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Rows with equal h, a and b together: asks, node, comp, bands, sketch."""
        held: list[tuple] = []
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows = (
                *(batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5)),
                batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(n, 2 * m),
                np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(n, 2 * m * T),
            )
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1
            for s, e in zip([0, *change], [*change, n], strict=True):
                name = tuple(k[s] for k in key)
                if held and name != last:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held = []
                held.append(tuple(x[s:e] for x in rows))
                last = name
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns h, a, b, asks, node, comp, bands, sketch; yields pairs u > v."""
        out: list[np.ndarray] = []
        size = 0
        for asks, node, comp, keys, raw in groups(batches):
            base = np.flatnonzero(~asks)
            for i in np.flatnonzero(asks):
                j = base[comp[base] != comp[i]]
                agree = keys[j] == keys[i]
                j = j[agree[:, :m].any(axis=1) & agree[:, m:].any(axis=1)]  # they meet in a table
                j = j[(raw[j] == raw[i]).sum(axis=1) >= need]
                if len(j):
                    out.append(np.stack([np.maximum(node[j], node[i]), np.minimum(node[j], node[i])]))
                    size += len(j)
            if size >= 8192:
                pairs = np.unique(np.concatenate(out, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])
                out, size = [], 0
        if out:
            pairs = np.unique(np.concatenate(out, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    return run


def alike_across(nodes: DataFrame, comps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v: the pairs of nodes of different components (or families, as given) that meet in
    a table and whose sketches are alike. nodes: node, bands, sketch.

    Nodes with an equal band of the first collection come together; that they have one
    of the second, too, is seen there, so that the tables' pairs of keys needn't be laid
    out again. Of each group the nodes outside its largest component ask all its nodes,
    in blocks against blocks."""
    m, need = search(percent)
    named = nodes.join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("comp"), "bands", "sketch")
    rows = named.select("node", "comp", F.explode(F.slice("bands", 1, m)).alias("h"))
    parts = rows.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("n"))
    per = parts.groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), F.max(F.struct("n", "comp")).alias("main")).where("c > 1")
    per = per.select("h", "n", (F.col("n") - F.col("main.n")).alias("k"), F.col("main.comp").alias("main"))
    opened = rows.join(per, "h").join(named.select("node", "bands", "sketch"), "node")
    at = F.xxhash64("node")
    opened = opened.withColumns({"na": F.ceil(F.col("k") / BLOCK_NODES).cast("int"), "nb": F.ceil(F.col("n") / BLOCK_NODES).cast("int")})
    mine, theirs = F.pmod(at, F.col("na")).cast("int"), F.pmod(at, F.col("nb")).cast("int")
    across = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asking = F.when(F.col("comp") != F.col("main"), F.transform(across("nb"), lambda b: F.struct(mine.alias("a"), b.alias("b"), F.lit(True).alias("asks")))).otherwise(F.array())
    asked = F.transform(across("na"), lambda a: F.struct(a.alias("a"), theirs.alias("b"), F.lit(False).alias("asks")))
    laid = opened.select("h", F.explode(F.concat(asking, asked)).alias("x"), "node", "comp", "bands", "sketch").select("h", "x.a", "x.b", "x.asks", "node", "comp", "bands", "sketch")
    laid = laid.repartition("h", "a", "b").sortWithinPartitions("h", "a", "b")
    return laid.mapInArrow(_alike(m, need), "u bigint, v bigint").distinct()


def _confirm_blocks(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns block, pair, u, v, hashes: a block's nodes u with their components v and
        sets, then its pairs. Pairs that others of the block have linked are passed by."""
        block, sets, root = None, {}, {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            key, pair, u, v = (batch.column(i).to_pylist() for i in range(4))
            own = _sets(batch.column(4))
            out: tuple[list, list] = ([], [])
            for i in range(batch.num_rows):
                if key[i] != block:
                    block, sets, root = key[i], {}, {}
                if not pair[i]:
                    sets[u[i]] = (own[i], v[i])
                    root.setdefault(v[i], v[i])
                    continue
                (s, c), (t, d) = sets[u[i]], sets[v[i]]
                c, d = find(c), find(d)
                if c != d and similar(s, t, percent):
                    root[c] = d
                    out[0].append(u[i])
                    out[1].append(v[i])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["u", "v"])

    return run


def _links(asks: list[int], base: list[int], comp: list, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of places that join the components which similar pairs join, at most one less
    than there are components. Intersections come from products of 0/1 matrices over
    the shingles that at least two sets have."""
    root = {c: c for c in comp}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []

    def link(i: int, j: int) -> None:
        x, y = find(comp[i]), find(comp[j])
        if x != y:
            root[x] = y
            out.append((i, j))

    if len(asks) * len(base) <= 64:
        for i in asks:
            for j in base:
                if find(comp[i]) != find(comp[j]) and similar(sets[i], sets[j], percent):
                    link(i, j)
        return out
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(first) - 1
    common = np.bincount(column)[column] > 1
    column, owner = np.unique(column[common], return_inverse=True)[1], owner[common]
    width = int(column[-1]) + 1 if len(column) else 0
    shared = np.zeros((len(asks), len(base)), np.float32)
    for low in range(0, width, MATRIX_COLUMNS):
        high = min(width, low + MATRIX_COLUMNS)
        lo, hi = np.searchsorted(column, [low, high])
        x = np.zeros((len(sets), high - low), np.float32)
        x[owner[lo:hi], column[lo:hi] - low] = 1.0
        shared += x[asks] @ x[base].T
    union = sizes[asks][:, None] + sizes[base][None, :] - shared
    for i, j in np.argwhere(100 * shared.astype(np.int64) >= percent * union.astype(np.int64)):
        link(asks[i], base[j])
    return out


def _family_blocks(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns block, asks, node, comp, hashes. Nodes that ask and that are asked are rows
        of their own, also where a node is both."""
        name: int | None = None
        held: tuple[list, list, list, list] = ([], [], [], [])

        def flush() -> pa.RecordBatch:
            asks, nodes, comps, sets = held
            found = _links([i for i, x in enumerate(asks) if x], [i for i, x in enumerate(asks) if not x], comps, sets, percent)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            keys, *columns = (batch.column(i).to_pylist() for i in range(4))
            for key, *row in zip(keys, *columns, _sets(batch.column(4)), strict=True):
                if key != name:
                    if held[0]:
                        yield flush()
                    name, held = key, ([], [], [], [])
                for k in range(4):
                    held[k].append(row[k])
        if held[0]:
            yield flush()

    return run


def within_families(families: DataFrame, comps: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links that join the components within each family (node, component): of a family
    with several, the nodes outside the largest are compared with all the family's, on
    full sets, in blocks against blocks. sets: node, n, hashes.

    Sets of a similar pair differ little in size, so a family is cut into steps of size, and
    a node asks those of its own step and of the neighbouring ones; steps are cut into
    chunks of some CHUNK_SHINGLES shingles. A set is shuffled as often as its step, or the
    step it asks, has chunks."""
    at = F.xxhash64("node")
    step = F.floor(F.log("n") / (-1.001 * math.log(percent / 100)))  # a little wider, for what rounding does
    named = sets.select("node", "n", step.alias("step")).join(families.withColumnRenamed("component", "family"), "node", "left").join(comps, "node", "left")
    named = named.select("node", "n", "step", F.coalesce("family", "node").alias("family"), F.coalesce("component", "node").alias("comp"))
    total = named.agg(F.count(F.lit(1))).first()[0]
    parts = named.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("c"))
    per = parts.groupBy("family").agg(F.sum("c").alias("size"), F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "comp")).alias("main")).where("k > 1")
    rows = written(join_counted(named, per.select("family", "size", F.col("main.comp").alias("main")), "family", "size", total).withColumn("asks", F.expr("comp <> main")), "family-nodes")
    rows = rows.withColumn("key", F.xxhash64("family", "step"))
    asking = rows.where("asks").select("node", "comp", "n", F.explode(F.array(*[F.xxhash64("family", F.col("step") + d) for d in (-1, 0, 1)])).alias("key"))
    fine = F.least(F.lit(FEW_CHUNKS), F.ceil(F.sum("n") / LEAST_SHINGLES))
    chunks = F.greatest(F.ceil(F.sum("n") / CHUNK_SHINGLES), fine).cast("int")
    both = rows.groupBy("key").agg(chunks.alias("nb"), F.count(F.lit(1)).alias("cb")).join(asking.groupBy("key").agg(chunks.alias("na"), F.count(F.lit(1)).alias("ca")), "key")
    both = written(both, "family-steps")
    places = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = lambda a, b: F.xxhash64("key", a, b)
    mine, theirs = F.pmod(at, F.col("na")).cast("int"), F.pmod(at, F.col("nb")).cast("int")
    ask = join_counted(asking, both, "key", "ca", 3 * total)
    ask = ask.select(F.explode(F.transform(places("nb"), lambda b: block(mine, b))).alias("block"), F.lit(True).alias("asks"), "node", "comp")
    asked = join_counted(rows.select("key", "node", "comp"), both, "key", "cb", total)
    asked = asked.select(F.explode(F.transform(places("na"), lambda a: block(a, theirs))).alias("block"), F.lit(False).alias("asks"), "node", "comp")
    laid = ask.union(asked).join(sets.select("node", "hashes"), "node").select("block", "asks", "node", "comp", "hashes").repartition("block")
    return laid.sortWithinPartitions("block", "asks", "node").mapInArrow(_family_blocks(percent), "u bigint, v bigint")


def confirm_in_blocks(pairs: DataFrame, comps: DataFrame, families: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links that join the components that confirmed pairs join. A block has the pairs
    between two chunks of families (node, component), so that a set goes to few blocks
    however many pairs it is in."""
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    named = ends.join(families, "node", "left").select("node", F.coalesce("component", "node").alias("family"))
    size = named.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / CONFIRMED_ROWS).alias("chunks"))
    homes = named.join(size, "family").select("node", F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("home"))
    homes = homes.join(comps, "node", "left").select("node", "home", F.coalesce("component", "node").alias("comp"))
    x = homes.select(F.col("node").alias("u"), F.col("home").alias("hu"), F.col("comp").alias("cu"))
    y = homes.select(F.col("node").alias("v"), F.col("home").alias("hv"), F.col("comp").alias("cv"))
    block = F.xxhash64(F.least("hu", "hv"), F.greatest("hu", "hv"))
    placed = written(pairs.join(x, "u").join(y, "v").select(block.alias("block"), "u", "v", "cu", "cv"), "placed")
    asked = placed.select("block", F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("cu").alias("v")), F.struct(F.col("v").alias("u"), F.col("cv").alias("v")))).alias("e")).select("block", "e.u", "e.v").distinct()
    nodes = asked.join(sets.withColumnRenamed("node", "u"), "u").select("block", F.lit(False).alias("pair"), "u", "v", "hashes")
    rows = nodes.union(placed.select("block", F.lit(True), "u", "v", F.lit(None).cast("binary")))
    return rows.repartition("block").sortWithinPartitions("block", "pair", "u", "v").mapInArrow(_confirm_blocks(percent), "u bigint, v bigint")


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, text_hash and, as keep_id, the smallest doc_id that links lead
    to (null where no row there has one), and group: equal for the rows of a component,
    null for rows without a shingle."""
    m, need = search(percent)
    signed = written(sign(docs, m), "signed")
    named = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    sets = written(signed.where("set_key is not null").groupBy("set_key").agg(F.min(named).alias("of"), F.count(F.lit(1)).alias("rows")).select("set_key", F.col("of.doc_id").alias("first"), F.col("of.text_hash").alias("text_hash"), "rows"), "sets")
    # a doc_id names a set where it is that of no other set
    odd = not sets.groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or first is null").isEmpty()
    node = F.xxhash64("set_key") if odd else F.col("first")
    sets = sets.select("set_key", "first", "text_hash", "rows", node.alias("node"))
    of = sets.select("node", F.col("set_key").alias("k"), F.col("first").alias("f"), F.col("text_hash").alias("t"))
    same = (F.col("set_key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("f")) & (F.col("text_hash") == F.col("t"))
    nodes = written(signed.join(of, same).select("node", "bands", "sketch"), "nodes")
    entries = written(tables(nodes.select("node", "bands").dropDuplicates(["node"]), m), "tables")

    leads = entries.groupBy("key").agg(F.min("node").alias("v"))
    first = entries.join(leads, "key").where("node <> v").groupBy(F.col("node").alias("u"), "v").agg(F.count(F.lit(1)).alias("n"))
    first = first.groupBy("u").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v"))
    met = written(nodes.join(entries.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "met")
    wanted = of.join(met.select("node"), "node").select("node", "f", "t")
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    texts = text.join(wanted.hint("merge"), (F.col("h") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("f"))).select("node", "text")
    full = written(hashed_sets(texts.dropDuplicates(["node"])), "full")
    forget(docs.sparkSession, nodes)

    tried = written(_alike_enough(first, met.select("node", "sketch"), m, need), "tried")
    forget(docs.sparkSession, entries)
    families = components(tried)
    links = written(confirm(tried, full, percent), "links")
    comps = components(links)
    more = written(within_families(families, comps, full, percent), "links")
    if not more.isEmpty():
        links = links.union(more)
        comps = components(links)
    across = written(alike_across(met, families, percent), "across")
    if not across.isEmpty():
        more = written(confirm_in_blocks(across, comps, families, full, percent), "links")
        if not more.isEmpty():
            comps = components(links.union(more))
    forget(docs.sparkSession, met, full, tried, across)

    classes = sets.join(comps, "node", "left").select("set_key", "first", "rows", F.coalesce("component", "node").alias("group"))
    if odd:  # a node's number says nothing about the smallest doc_id
        classes = classes.join(classes.groupBy("group").agg(F.min("first").alias("keep_id")), "group")
    else:
        classes = classes.withColumn("keep_id", F.col("group"))
    classes = written(classes.select("set_key", "rows", "keep_id", "group"), "classes")
    columns = ["doc_id", "n_shingles", "text_hash", "keep_id", "group"]
    out = join_counted(signed.where("set_key is not null"), classes, "set_key", "rows", signed.count()).select(*columns)
    none = F.lit(None).cast("bigint")
    return out.union(signed.where("set_key is null").select("doc_id", "n_shingles", "text_hash", none.alias("keep_id"), none.alias("group")))


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id
    that links lead to) and kept (doc_id = component_id).

    A-Z count as a-z, words are what stands between white space (space, TAB to CR).
    A text of fewer than five words is one shingle; null, empty and blank texts have
    none and are linked with nothing. Every row is judged by its own text: rows with one
    doc_id and several texts may be in several components. Rows with a null doc_id are
    linked like others; they are kept where no row of their component has a doc_id, and
    component_id is null there. Other columns don't matter; an empty table gives an empty
    result.
    """
    found = _linked(docs, percent)
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _alike_enough(pairs: DataFrame, sketches: DataFrame, m: int, need: int) -> DataFrame:
    """The pairs whose sketches have enough equal bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, 2 * m * T) for i in (2, 3))
            good = pa.array((x == y).sum(axis=1) >= need)
            yield batch.filter(good).select(["u", "v"])

    s = sketches.select(F.col("node").alias("u"), F.col("sketch").alias("x"))
    t = sketches.select(F.col("node").alias("v"), F.col("sketch").alias("y"))
    return pairs.join(s, "u").join(t, "v").select("u", "v", "x", "y").mapInArrow(run, "u bigint, v bigint")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, and all rows without a shingle; columns
    unchanged. The row that stays is one with the component's smallest doc_id; of several
    such rows, also where no row of a component has a doc_id, one stays, the same in
    every run."""
    found = written(_linked(docs, percent).where("group is not null").select("doc_id", "text_hash", "keep_id", "group"), "found")
    several = found.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = join_counted(found, written(several, "several"), "group", "n", found.count()).select("doc_id", "text_hash", "keep_id", "group").distinct()
    keys = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), *row_key(docs))
    rows = keys.join(found, (F.col("h") == F.col("text_hash")) & F.col("d").eqNullSafe(F.col("doc_id"))).select("d", "keep_id", "group", "_k1", "_k2")
    rows = written(rows, "rows")
    best = rows.where(F.col("d").eqNullSafe(F.col("keep_id"))).groupBy("group", "_k1", "_k2").agg(F.count(F.lit(1)).alias("n"))
    best = written(best.groupBy("group").agg(F.min(F.struct("_k1", "_k2", "n")).alias("x")).select("x.*"), "winners")
    return keep_rows(docs, rows.select("_k1", "_k2").distinct().join(best, ["_k1", "_k2"], "left_anti"), best.where("n > 1"))
