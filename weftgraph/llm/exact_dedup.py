"""Exact deduplication against a minimal perfect hash of historical digests.

The history is the set of distinct digests of documents seen before. It is cut
by the leading bits of the digest into buckets of bounded size; each bucket has
a minimal perfect hash function, and slot i of its tables holds the full digest
that hashes to i and the locator of its winner. A new digest is looked up in
its bucket's function and compared byte for byte with the digest in the slot:
equal, it repeats the winner; unequal, it is no member, and the nonmembers are
grouped among themselves.

The function is a cascade of bit arrays. On each level every remaining digest
sets the bit of its level hash; digests alone on their bit stay, the others go
to the next level. A digest's slot is the number of set bits before its own.

Rows with one digest are aggregated before any shuffle, so that a text that a
third of all rows share is one row per task in the index, the lookup and the
grouping.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WHITE_SPACE, join_counted, keep_rows, mix64, row_key, written

#: Digests a bucket is meant to hold; with 56 bytes a digest, some 2 MB.
BUCKET_DIGESTS = 1 << 15

#: Bits a level has for each digest that reaches it.
GAMMA = 2

#: Stands for the locator of a group in which no row has one.
NO_DOC = (1 << 63) - 1

INDEX_SCHEMA = "bucket int, n int, levels array<int>, bits binary, digests binary, locators binary, sizes binary"
GROUP_SCHEMA = "digest binary, keep_id bigint, group_size bigint"


def _level_hash(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """words: n x 4 words of 64 bits, all of which count."""
    with np.errstate(over="ignore"):
        h = U64(level + 1) * U64(0x9E3779B97F4A7C15)
        out = np.full(len(words), h, dtype=U64)
        for k in range(words.shape[1]):
            out = mix64(out ^ words[:, k])
    return (out % U64(size)).astype(np.int64)


def _words(digests: list[bytes] | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 4).astype(U64)


def build_function(words: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels, and their bits one after another. words: distinct."""
    sizes, bits, left, level = [], [], np.arange(len(words)), 0
    while len(left):
        size = max(8, GAMMA * len(left))
        h = _level_hash(words[left], level, size)
        alone = np.bincount(h, minlength=size) == 1
        bits.append(alone)
        sizes.append(size)
        left = left[~alone[h]]
        level += 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(words: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest; of a digest outside the set, some slot or -1."""
    rank = np.cumsum(bits) - bits
    out, left, at = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        h = at + _level_hash(words[left], level, size)
        hit = bits[h]
        out[left[hit]] = rank[h[hit]]
        left = left[~hit]
        at += size
    return out


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("digest")
    words = _words(pdf.digest)
    sizes, bits = build_function(words)
    order = np.argsort(slots(words, sizes, bits))
    return pd.DataFrame(
        {
            "bucket": [int(pdf.bucket.iloc[0])],
            "n": [len(pdf)],
            "levels": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [b"".join(pdf.digest.to_numpy()[order])],
            "locators": [pdf.keep_id.to_numpy(np.int64)[order].tobytes()],
            "sizes": [pdf.group_size.to_numpy(np.int64)[order].tobytes()],
        }
    )


def _look_up(key: tuple, index: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """Groups of a bucket: of the history alone, of both, and nonmembers."""
    if len(index) == 0:
        return new[["digest", "keep_id", "group_size"]]
    row = index.iloc[0]
    sizes = [int(x) for x in row.levels]
    bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), count=sum(sizes)).astype(bool)
    held = np.frombuffer(row.digests, np.uint8).reshape(-1, 32)
    keep = np.frombuffer(row.locators, np.int64).copy()
    size = np.frombuffer(row["sizes"], np.int64).copy()
    rest = new.iloc[:0]
    if len(new):
        raw = np.frombuffer(b"".join(new.digest), np.uint8).reshape(-1, 32)
        at = slots(_words(new.digest), sizes, bits)
        member = at >= 0
        member[member] = (held[at[member]] == raw[member]).all(axis=1)  # byte for byte
        np.minimum.at(keep, at[member], new.keep_id.to_numpy(np.int64)[member])
        np.add.at(size, at[member], new.group_size.to_numpy(np.int64)[member])
        rest = new[~member]
    digests = [held[i].tobytes() for i in range(len(held))]
    out = pd.DataFrame({"digest": digests, "keep_id": keep, "group_size": size})
    return pd.concat([out, rest[["digest", "keep_id", "group_size"]]]) if len(rest) else out


def _bucket(buckets: int):
    """By the leading 31 bits of the digest."""
    return F.expr(f"cast((conv(substr(hex(digest), 1, 8), 16, 10) div 2) * {buckets} div 2147483648 as int)")


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """The index of a history: one row per bucket. groups: one row per distinct
    digest with keep_id (the winner's locator) and group_size; may be written as
    Parquet and used for every later delivery with the same number of buckets."""
    return groups.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(_build, INDEX_SCHEMA)


def look_up(index: DataFrame, groups: DataFrame, buckets: int) -> DataFrame:
    """One row per distinct digest of the history and of the new groups."""
    new = groups.withColumn("bucket", _bucket(buckets))
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInPandas(_look_up, GROUP_SCHEMA)


def normalised(text) -> F.Column:
    """Null as empty, every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WHITE_SPACE}]+", " ")


def digests(docs: DataFrame, *more: F.Column) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text, and more columns."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256)).alias("digest"), *more)


def _grouped(marked: DataFrame) -> DataFrame:
    return marked.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(NO_DOC)).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def find_groups(marked: DataFrame, history_share: float) -> tuple[DataFrame, int]:
    """digest, keep_id (null where no row has a doc_id) and group_size, and how many
    rows there are. marked: doc_id and digest of every row.

    The earlier documents (those up to the history_share quantile of doc_id) are
    the history whose distinct digests are indexed; the later ones are looked up.
    The quantile may be approximate: where the cut falls does not change the
    result."""
    cut, n = marked.agg(F.percentile_approx("doc_id", history_share), F.count(F.lit(1))).first()
    buckets = max(1, -(-n // BUCKET_DIGESTS))
    early = F.col("doc_id") <= F.lit(cut if cut is not None else 0)
    index = build_index(_grouped(marked.where(early)), buckets)
    late = _grouped(marked.where(F.coalesce(~early, F.lit(True))))
    groups = look_up(index, late, buckets)
    return groups.withColumn("keep_id", F.when(F.col("keep_id") != NO_DOC, F.col("keep_id"))), n


def exact_dedup(docs: DataFrame, history_share: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest. kept is false
    for a row whose doc_id isn't the group's smallest.

    Null text counts as empty. Rows with a null doc_id join their text's group
    and are kept only if all its rows have none. Repeated rows with one doc_id
    are all kept or all dropped. Other columns don't matter. An empty table
    gives an empty result.
    """
    marked = written(digests(docs), "digests")
    groups, n = find_groups(marked, history_share)
    groups = written(groups, "groups")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return join_counted(marked, groups, "digest", "group_size", n).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def drop_exact_repeats(docs: DataFrame, history_share: float = 0.5) -> DataFrame:
    """docs with one row for each text; columns unchanged.

    The row that stays is one with the group's smallest doc_id; of several such rows,
    also where no row of a group has a doc_id, one stays, the same in every run. Texts are
    judged one by one: a doc_id that has several texts keeps those that are new.
    """
    marked = written(digests(docs, *row_key(docs)), "digests")
    groups, n = find_groups(marked, history_share)
    repeated = written(groups.where("group_size > 1").select("digest", "keep_id", "group_size"), "groups")
    rows = join_counted(marked, repeated, "digest", "group_size", n)
    best = rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "_k1", "_k2").agg(F.count(F.lit(1)).alias("n"))
    best = written(best.groupBy("digest").agg(F.min(F.struct("_k1", "_k2", "n")).alias("x")).select("x.*"), "winners")
    return keep_rows(docs, rows.select("_k1", "_k2").distinct().join(best, ["_k1", "_k2"], "left_anti"), best.where("n > 1"))
