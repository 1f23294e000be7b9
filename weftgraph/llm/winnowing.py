"""Document fingerprints by winnowing.

Every k code points have a rolling hash. Of each window of w neighbouring
hashes the smallest is chosen, the rightmost among equals; the chosen hashes
with their positions are the fingerprint. Two texts that share a passage of
w + k - 1 code points share a chosen hash, which the positions locate; no match
shorter than k code points counts. A text shorter than k has the hash of the
whole, one with fewer than w hashes their smallest.

The likeness of two fingerprints is the Jaccard index of their sets of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, small_batches

K, WINDOW = 16, 16

_BASE = U64(0x9E3779B97F4A7C15)

_PAIR = np.dtype([("hash", ">u4"), ("at", ">u4")])

#: Rows of a range of doc_id that is one task's, and the most ranges.
RANGE_ROWS, RANGES = 2_000, 8192


def grams(points: np.ndarray, k: int = K) -> np.ndarray:
    """A 32-bit hash of every k code points. By doubling: the hash of 2n points is
    that of the first n, times base^n, plus that of the next n."""
    with np.errstate(over="ignore"):
        h, n, power = points.astype(U64) + U64(1), 1, _BASE
        out, done, left = None, 0, k
        while left:
            if left & 1:  # h holds n-grams; put behind those of the done points
                out = h if out is None else out[: len(h) - done] * power + h[done:][: len(out)]
                done += n
            left >>= 1
            if left:
                h = h[:-n] * power + h[n:]
                n, power = 2 * n, power * power
        return (mix64(out) >> U64(32)).astype(np.uint32)


def winnow(points: np.ndarray, starts: np.ndarray, k: int = K, w: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and positions chosen in each text. points: the texts' code points, one
    text after another; starts: their offsets (one more than texts)."""
    n, rows = len(points), len(starts) - 1
    out: list = [None] * rows
    sizes = np.diff(starts)
    if n >= k + w - 1:
        h = grams(points, k)
        # the smallest hash, and of equal ones the largest position, is the least of these
        key = (h.astype(U64) << U64(32)) | (U64(0xFFFFFFFF) - np.arange(len(h), dtype=U64))
        m, reach = key, 1
        while 2 * reach <= w:
            m, reach = np.minimum(m[:-reach], m[reach:]), 2 * reach
        if reach < w:
            m = np.minimum(m[: len(m) - (w - reach)], m[w - reach :])
        change = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    for i in range(rows):
        a, size = int(starts[i]), int(sizes[i])
        if size >= k + w - 1:
            lo, hi = np.searchsorted(change, [a, a + size - k - w + 2])
            got = m[np.concatenate([[a], change[lo:hi]])] if lo == hi or change[lo] != a else m[change[lo:hi]]
            out[i] = ((got >> U64(32)).astype(np.uint32), (U64(0xFFFFFFFF) - (got & U64(0xFFFFFFFF))).astype(np.int64) - a)
        elif size == 0:
            out[i] = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        else:
            h = grams(points[a : a + size], min(k, size))
            at = len(h) - 1 - int(np.argmin(h[::-1]))
            out[i] = (h[at : at + 1], np.array([at]))
    return out


def encode(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Eight hexadecimal digits of each hash and eight of its position."""
    pairs = np.empty(len(hashes), _PAIR)
    pairs["hash"], pairs["at"] = hashes, positions
    return pairs.tobytes().hex()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(bytes.fromhex(fingerprint), _PAIR)
    return pairs["hash"].astype(np.uint32), pairs["at"].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two empty texts 1, of an empty one and another 0."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return winnow(np.frombuffer(data, np.uint32), starts)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row; null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, texts in _parts(batch):
                prints = fingerprints(texts)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(*p) for p in prints], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


#: Code points handled at once.
PART_CHARS = 1 << 19


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    names, texts, total = [], [], 0
    for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        names.append(name)
        texts.append(text.as_py() or "")
        total += len(texts[-1])
        if total >= PART_CHARS:
            yield names, texts
            names, texts, total = [], [], 0
    if names:
        yield names, texts


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by as many, or all, of the first of
    the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, range, guest; each range's rows in order, and after them
    its guest, the first row of the following range."""
    held: tuple | None = None  # id, text, fingerprint and range of the row before
    for batch in batches:
        at = 0
        for names, texts in _parts(batch):
            ranges = batch.column(2).slice(at, len(names)).to_pylist()
            guests = batch.column(3).slice(at, len(names)).to_pylist()
            at += len(names)
            prints = fingerprints(texts)
            rows = ([held] if held else []) + list(zip(names, texts, prints, ranges, guests, strict=True))
            held = rows[-1]
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[3] == y[3] and not x[4]]
            if not pairs:
                continue
            edited = [edit(x[1], y[1]) for x, y in pairs]
            changed = fingerprints(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x, _ in pairs], pa.int64()),
                    pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array([encode(*x[2]) for x, _ in pairs], pa.string()),
                    pa.array([encode(*p) for p in changed], pa.string()),
                    pa.array([likeness(x[2][0], p[0]) for (x, _), p in zip(pairs, changed, strict=True)], pa.float64()),
                    pa.array([likeness(x[2][0], y[2][0]) for x, y in pairs], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """For every row the fingerprints of its text and of its text edited with that of
    the next document in descending doc_id (after the last the first), and how much
    its fingerprint is like that of the edited text and that of the next document.

    Ids are cut into ranges at quantiles; each range is one stream in order, and
    ends with a copy of the first row of the range after it. Null text counts as
    empty; a null doc_id comes last; rows with one doc_id are ordered by their
    text's hash. A single row is its own next. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    n = docs.count()
    ranges = min(RANGES, max(1, -(-n // RANGE_ROWS)))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("key", shares, 100 * ranges)).first()[0] if shares and n else []
    cuts = sorted(set(cuts or []))
    # range 0 has the largest ids
    step = F.lit(len(cuts)) - F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c < F.col("key"))) if cuts else F.lit(0)
    rows = rows.select("doc_id", "text", "key", step.cast("int").alias("range"))
    tops = rows.groupBy("range").agg(F.max("key").alias("top")).collect()  # at most RANGES rows
    tops = sorted((x["range"], x.top) for x in tops)
    if not tops:
        return spark.createDataFrame([], SCHEMA)
    serves = {top: tops[i - 1][0] for i, (_, top) in enumerate(tops)}  # the range before; of the first, the last
    lead = rows.where(F.col("key").isin(list(serves)))
    first = lead.groupBy("key").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"), F.col("doc_id").alias("d"))).alias("x"))
    to = F.create_map(*[F.lit(x) for pair in serves.items() for x in pair])
    guests = first.select(F.col("x.d").alias("doc_id"), F.col("x.t").alias("text"), "key", to[F.col("key")].cast("int").alias("range"), F.lit(True).alias("guest"))
    streams = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition(len(tops), "range")
    streams = streams.sortWithinPartitions("range", "guest", F.desc("key"), F.xxhash64("text"), "text")
    return streams.select("doc_id", "text", "range", "guest").mapInArrow(_compare, SCHEMA)
