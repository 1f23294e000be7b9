"""Removal of repeated passages with suffix arrays.

A byte is removed if a passage of 50 bytes that covers it also starts in a
document with a smaller doc_id.

Bringing equal passages together. Each passage has an anchor: of the 16-byte
grams in it the one with the least hash, the leftmost among equals. Equal
passages have equal anchors at equal places, and neighbouring passages mostly
share one, so that a document has an anchor for every 18 bytes or so. Anchors
whose gram occurs once in the corpus are dropped: four bytes of each anchor's
hash are counted in buckets, and the answers come back as a bit per anchor.
For each anchor left, the segment of text that its passages cover goes to a
bucket by the gram's hash. Every passage is whole in exactly one segment. Anchors
whose gram is so frequent that one bucket can't hold their segments send their
passages one by one instead, which are grouped and joined as rows.

Finding equal passages. A bucket's distinct segments are one text, whose
suffixes are sorted by the two-stage method: suffixes smaller than their
successors are sorted directly; a scan over the buckets of first bytes induces
the others, since the suffix before one that is in place, if it is larger than
that one, is the next in its own bucket. Common prefixes of neighbours in the
array then delimit groups of equal passages, whose smallest doc_id decides.

Only suffixes at which a passage starts are wanted, and those behind them from
which they are induced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, binary_array, blocks, forget, join_counted, mix64, odd_words, small_batches, text_bytes, written

PASSAGE, GRAM = 50, 16

#: Passages that can share an anchor, and bytes of the longest segment.
SHARED = PASSAGE - GRAM + 1
SEGMENT = SHARED + PASSAGE - 1

#: Bytes of text for each bucket of anchors, and for each of segments.
ANCHOR_BUCKET, SEGMENT_BUCKET = 12 << 20, 3 << 20

#: Documents, and bytes, of a group to which the removals of its documents come back.
GROUP_DOCS, GROUP_BYTES = 256, 4 << 20

NO_DOC = (1 << 63) - 1

_WORD = odd_words(11, 2)
_KEY = odd_words(12, 32)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first passage, number of passages and hash of each anchor, in order."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < PASSAGE:
        return none, none, none, np.zeros(0, U64)
    raw = np.ascontiguousarray(data)
    words = np.ndarray((n - 7,), "<u8", raw.data, strides=(1,)).astype(U64)
    with np.errstate(over="ignore"):
        h = mix64(words[:-8] * _WORD[0] + words[8:] * _WORD[1])
    del words
    m = ((h >> U64(32)) << U64(32)) | np.arange(len(h), dtype=U64)
    reach = 1
    while 2 * reach <= SHARED:
        m, reach = np.minimum(m[:-reach], m[reach:]), 2 * reach
    if reach < SHARED:
        m = np.minimum(m[: len(m) - (SHARED - reach)], m[SHARED - reach :])
    # m[s] is the anchor of the passage at s; those that cross rows don't count
    valid = np.ones(len(m) + 1, bool)
    valid[-1] = False
    inner = offsets[1:-1]
    cross = np.zeros(len(m) + PASSAGE + 1, np.int32)
    lows = np.maximum(inner - PASSAGE + 1, 0)
    lows, highs = lows[lows < inner], inner[lows < inner]
    np.add.at(cross, np.minimum(lows, len(m)), 1)
    np.add.at(cross, np.minimum(highs, len(m)), -1)
    valid[:-1] = np.cumsum(cross[: len(m)]) == 0
    begin = valid[:-1].copy()
    begin[1:] &= (m[1:] != m[:-1]) | ~valid[:-2]
    start = np.flatnonzero(begin)
    end = valid[:-1].copy()
    end[:-1] &= (m[1:] != m[:-1]) | ~valid[1:-1]
    count = np.flatnonzero(end) - start + 1
    with np.errstate(over="ignore"):
        gram = mix64(h[(m[start] & U64(0xFFFFFFFF)).astype(np.int64)] ^ U64(0x5851F42D4C957F2D))
    row = np.searchsorted(offsets, start, side="right") - 1
    return row, start, count, gram


def _bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_DOC).to_numpy(zero_copy_only=False).astype(np.int64)


def _split(order_key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value, and where it is, in order."""
    order = np.argsort(order_key, kind="stable")
    values = order_key[order]
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else []
    for a, b in zip(edges, [*edges[1:], len(values)], strict=True) if len(values) else []:
        yield int(values[a]), order[a:b]


#: Anchors with one hash, above which their passages are grouped one by one.
HOT_ANCHORS = 1 << 17

ANCHORED = "bucket int, block bigint, hashes binary, times binary, ids binary, counts binary, buckets binary"


def _anchor_rows(buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            names = _ids(batch.column(0))
            data, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets):
                key += 1
                at = offsets[a : b + 1] - offsets[a]
                row, _, _, gram = anchors(data[offsets[a] : offsets[b]], at)
                if not len(row):
                    continue
                where = _bucket_of(gram, buckets)
                low = gram.astype(np.uint32)
                # a block sends each hash once, however often it has it
                once = ((k, *np.unique(low[i], return_counts=True)) for k, i in _split(where))
                parts = [(k, h.tobytes(), c.astype(np.uint32).tobytes()) for k, h, c in once]
                n = len(parts) + 1
                nothing = [None] * len(parts)
                counts = np.bincount(row, minlength=b - a).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([-1] + [k for k, _, _ in parts], pa.int32()),
                        pa.array([key] * n, pa.int64()),
                        binary_array([low.tobytes()] + [x for _, x, _ in parts]),
                        binary_array([None] + [x for _, _, x in parts]),
                        binary_array([names[a:b].tobytes(), *nothing]),
                        binary_array([counts.tobytes(), *nothing]),
                        binary_array([where.astype(np.uint32).tobytes(), *nothing]),
                    ],
                    names=["bucket", "block", "hashes", "times", "ids", "counts", "buckets"],
                )

    return run


def _repeated(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket, for each block: a bit for each of its hashes that occurs again, and
        one for each that occurs more than so often."""
        every = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf.hashes])
        times = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf.times]).astype(np.int64)
        _, back = np.unique(every, return_inverse=True)
        total = np.bincount(back, times)[back]
        again, hot, out, at = total > 1, total > most, ([], []), 0
        for x in pdf.hashes:
            n = len(x) // 4
            out[0].append(np.packbits(again[at : at + n]).tobytes())
            out[1].append(np.packbits(hot[at : at + n]).tobytes())
            at += n
        return pd.DataFrame({"bucket": pdf.bucket, "block": pdf.block, "bits": out[0], "hot": out[1]})

    return run


def _by_document(key: tuple, table: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
    """Of a block, for each document with a repeated anchor: a bit per anchor for repeated
    ones, and one for hot ones."""
    out: dict[str, list] = {k: [] for k in ("id", "n", "bits", "hot")}
    if len(table):
        row = table.iloc[0]
        where = np.frombuffer(row.buckets, np.uint32).astype(np.int64)
        hashes = np.frombuffer(row.hashes, np.uint32)
        bits = np.zeros((2, len(where)), bool)
        known = dict(zip(flags.bucket, zip(flags.bits, flags.hot, strict=True), strict=True))
        for k, i in _split(where):
            once, back = np.unique(hashes[i], return_inverse=True)
            for j in (0, 1):
                bits[j, i] = np.unpackbits(np.frombuffer(known[k][j], np.uint8), count=len(once))[back]
        at = np.concatenate([[0], np.cumsum(np.frombuffer(row.counts, np.uint32).astype(np.int64))])
        for name, a, b in zip(np.frombuffer(row.ids, np.int64).tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            if bits[0, a:b].any():
                out["id"].append(name)
                out["n"].append(b - a)
                out["bits"].append(np.packbits(bits[0, a:b]).tobytes())
                out["hot"].append(np.packbits(bits[1, a:b]).tobytes() if bits[1, a:b].any() else None)
    return pd.DataFrame(out).astype({"id": "int64", "n": "int64"})


SEGMENTS = "bucket int, ids binary, keys binary, starts binary, counts binary, text binary"


def _flagged(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns id, key, text, n, bits, hot; by block: ids, keys, text, offsets, and of the
    repeated anchors row, start, count, hash and whether they are hot."""
    names, keys = _ids(batch.column(0)), _ids(batch.column(1))
    data, offsets = text_bytes(batch.column(2))
    sizes, bits, hot = batch.column(3).to_pylist(), batch.column(4), batch.column(5)
    for a, b in blocks(offsets):
        at = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        row, start, count, gram = anchors(part, at)
        use = np.concatenate([np.unpackbits(np.frombuffer(bits[i].as_py(), np.uint8), count=sizes[i]) for i in range(a, b)]).astype(bool)
        much = np.concatenate([np.unpackbits(np.frombuffer(hot[i].as_py() or b"\0" * (sizes[i] // 8 + 1), np.uint8), count=sizes[i]) for i in range(a, b)]).astype(bool)
        yield names[a:b], keys[a:b], part, at, row[use], start[use], count[use], gram[use], much[use]


def _hot_passages():
    """The passages of hot anchors, one by one: text of the passage, id, key, start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, keys, part, at, row, start, count, _, hot in _flagged(batch):
                row, start, count = row[hot], start[hot], count[hot]
                if not len(row):
                    continue
                owner = np.repeat(row, count)
                first = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                raw = part.tobytes()
                yield pa.RecordBatch.from_arrays([binary_array(raw[i : i + PASSAGE] for i in first.tolist()), pa.array(names[owner]), pa.array(keys[owner]), pa.array(first - at[owner])], names=["passage", "id", "key", "start"])

    return run


def _hot_found(groups: int):
    """Columns key, start of removed passages, as rows of FOUND."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            group = (mix64(keys.view(U64)) % U64(groups)).astype(np.int64)
            out = [(k, keys[i].tobytes(), starts[i].astype(np.uint32).tobytes(), np.ones(len(i), U64).tobytes()) for k, i in _split(group)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), *[binary_array(x[j] for x in out) for j in (1, 2, 3)]], names=["grp", "keys", "starts", "masks"])

    return run


def _segment_rows(buckets: int, several: bool):
    """Columns id, key, text, n, bits, hot. Keys are sent where they aren't the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, keys, part, at, row, start, count, gram, hot in _flagged(batch):
                row, start, count, gram = row[~hot], start[~hot], count[~hot], gram[~hot]
                padded = np.concatenate([part, np.zeros(SEGMENT, np.uint8)])
                out = []
                for k, i in _split(_bucket_of(gram, buckets)):
                    matrix = padded[start[i, None] + np.arange(SEGMENT)]
                    inside = np.arange(SEGMENT) < count[i, None] + (PASSAGE - 1)
                    out.append((k, names[row[i]].tobytes(), keys[row[i]].tobytes() if several else None, (start[i] - at[row[i]]).astype(np.uint32).tobytes(), count[i].astype(np.uint8).tobytes(), matrix[inside].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *[binary_array(x[j] for x in out) for j in range(1, 6)]], names=["bucket", "ids", "keys", "starts", "counts", "text"])

    return run


#: Bytes of a row of the text of segments, with room for words read past its end.
STRIDE = SEGMENT + 64

_WORDS = -(-PASSAGE // 8)


def _distinct(matrix: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each distinct row (with its count), and which of them each row is."""
    wide = np.zeros((len(matrix), -(-SEGMENT // 8) * 8 + 8), np.uint8)
    wide[:, :SEGMENT] = matrix
    wide[:, -8] = counts
    words = wide.view("<u8")
    with np.errstate(over="ignore"):
        h = np.zeros(len(words), U64)
        for k in range(words.shape[1]):
            h = mix64(h ^ (words[:, k] * _KEY[k]))
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    if not (words == words[first[back]]).all():  # two texts with one hash
        _, first, back = np.unique(wide.view(np.dtype((np.void, wide.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, back


def _order(words: list[np.ndarray]) -> np.ndarray:
    """The order of rows by words, the first of which counts most. From the last bits to
    the first, stably, as many at a time as fit beside a row's place in one word: such
    words are sorted faster than places by keys."""
    n = len(words[0])
    low = max(1, n.bit_length())
    high, mask = 64 - low, U64((1 << low) - 1)
    order = np.arange(n)
    end = 64 * len(words)
    while end > 0:
        begin = max(0, end - high)
        k, r = divmod(begin, 64)
        part = words[k] << U64(r)
        if r and k + 1 < len(words):
            part = part | (words[k + 1] >> U64(64 - r))
        part = (part >> U64(64 - (end - begin))) << U64(low)
        order = order[(np.sort(part[order] | np.arange(n, dtype=U64)) & mask).astype(np.int64)]
        end = begin
    return order


def suffix_order(text: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Suffixes of the segments in the order of their first PASSAGE bytes, by two-stage
    sorting. text: rows of STRIDE bytes, those of a segment plus 1, then zeros. Wanted
    are the first counts suffixes of each, as places in the flat text; those from
    which they are induced come along."""
    rows = len(text)
    flat = text.ravel()
    # smaller than its successor: decided by the next byte that differs
    width = SEGMENT + 1
    across = np.ascontiguousarray(text[:, : width + 1].T)
    kind = np.zeros((width + 1, rows), bool)
    for j in range(width - 1, -1, -1):
        kind[j] = (across[j] < across[j + 1]) | ((across[j] == across[j + 1]) & kind[j + 1])
    rises = np.ones((rows, STRIDE), bool)
    rises[:, :width] = kind[:width].T
    columns = np.arange(STRIDE)
    rises[columns >= lengths[:, None]] = True  # the end counts as one that is sorted directly
    # up to the first rising suffix at or behind the last wanted one
    behind = (rises & (columns >= counts[:, None] - 1)).argmax(axis=1)
    needed = columns <= behind[:, None]
    wanted_b = np.flatnonzero((needed & rises).ravel())
    falls = (needed & ~rises).ravel()

    padded = np.concatenate([flat, np.zeros(64, np.uint8)])
    keys = [np.ndarray((len(flat),), ">u8", padded.data, offset=8 * k, strides=(1,))[wanted_b].astype(U64) for k in range(_WORDS)]
    direct = wanted_b[_order(keys)]
    edges = np.searchsorted(flat[direct], np.arange(257))

    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        first = np.concatenate(induced[c]) if induced[c] else direct[:0]
        grown = [first]
        while len(first):  # runs of the byte itself
            before = first[first > 0] - 1
            first = before[falls[before] & (flat[before] == c)]
            grown.append(first)
        bucket = np.concatenate([*grown, direct[edges[c] : edges[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[falls[before] & (flat[before] > c)]
        for byte, i in _split(flat[before]):
            induced[byte].append(before[i])
    return np.concatenate(out) if out else direct


def common_prefixes(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of each place after the first and the one before it, up to PASSAGE bytes."""
    padded = np.concatenate([text.ravel(), np.zeros(64, np.uint8)])
    out = np.full(max(0, len(places) - 1), PASSAGE)
    left = np.arange(len(out))  # pairs without a difference so far
    for k in range(_WORDS):
        w = np.ndarray((text.size,), ">u8", padded.data, offset=8 * k, strides=(1,))
        differ = w[places[left + 1]].astype(U64) ^ w[places[left]].astype(U64)
        ended = differ != 0
        at, bits = left[ended], differ[ended]
        same = np.zeros(len(at), np.int64)
        for byte in range(1, 8):
            same += bits >> U64(64 - 8 * byte) == 0
        out[at] = np.minimum(8 * k + same, PASSAGE)
        left = left[~ended]
    return out


def first_documents(matrix: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each segment and each of its passages the smallest document with that
    passage. matrix: distinct segments; docs: the smallest document of each."""
    text = np.zeros((len(matrix), STRIDE), np.uint8)
    lengths = counts + PASSAGE - 1
    text[:, :SEGMENT] = matrix + np.uint8(1)  # no byte of UTF-8 is above 244
    text[np.arange(STRIDE) >= lengths[:, None]] = 0
    places = suffix_order(text, lengths, counts)
    row, at = places // STRIDE, places % STRIDE
    wanted = at < counts[row]
    places, row, at = places[wanted], row[wanted], at[wanted]
    start = np.flatnonzero(np.concatenate([[True], common_prefixes(text, places) < PASSAGE]))
    least = np.minimum.reduceat(docs[row], start)
    out = np.full((len(matrix), SHARED), NO_DOC)
    out[row, at] = np.repeat(least, np.diff(np.append(start, len(places))))
    return out


def _passages(groups: int, several: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in pdf.ids])
        keys = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["keys"]]) if several else docs
        starts = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf.starts])
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf.counts]).astype(np.int64)
        matrix = np.zeros((len(docs), SEGMENT), np.uint8)
        matrix[np.arange(SEGMENT) < counts[:, None] + (PASSAGE - 1)] = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf.text])
        first, back = _distinct(matrix, counts)
        least = np.full(len(first), NO_DOC)
        np.minimum.at(least, back, docs)
        earliest = first_documents(matrix[first], counts[first], least)
        mask = np.zeros(len(docs), U64)
        for k in range(SHARED):
            mask |= ((earliest[back, k] < docs) & (counts > k)).astype(U64) << U64(k)
        hit = np.flatnonzero(mask)
        group = (mix64(keys[hit].view(U64)) % U64(groups)).astype(np.int64)
        out = [(k, keys[hit[i]].tobytes(), starts[hit[i]].tobytes(), mask[hit[i]].tobytes()) for k, i in _split(group)]
        return pd.DataFrame(out, columns=["grp", "keys", "starts", "masks"])

    return run


FOUND = "grp bigint, keys binary, starts binary, masks binary"
RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, spans array<bigint>"


def _spans(starts: np.ndarray, masks: np.ndarray) -> list[int]:
    """Starts and ends, in turn, of the runs of bytes that removed passages cover; bit k of
    a mask stands for the passage k bytes behind the segment's start."""
    if not len(starts):
        return []
    bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, k = np.nonzero(bits)
    at = np.sort(starts[row] + k)
    new = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + PASSAGE]))
    last = np.append(new[1:], len(at)) - 1
    return np.stack([at[new], at[last] + PASSAGE], axis=1).ravel().tolist()


def _apply(with_text: bool):
    def run(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        keys, starts, masks = (np.concatenate([np.frombuffer(x.as_py(), t) for x in found.column(c)]) if found.num_rows else np.zeros(0, t) for c, t in (("keys", np.int64), ("starts", np.uint32), ("masks", U64)))
        order = np.argsort(keys, kind="stable")
        keys, starts, masks = keys[order], starts[order].astype(np.int64), masks[order]
        out: dict[str, list] = {k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        for name, mine, text in zip(texts.column("id").to_pylist(), texts.column("key").to_pylist(), texts.column("text"), strict=True):
            raw = (text.as_py() or "").encode()
            a, b = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
            turn = _spans(starts[a:b], masks[a:b])
            kept = b"".join(raw[x:y] for x, y in zip([0, *turn[1::2]], [*turn[::2], len(raw)], strict=True))
            out["id"].append(name)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(turn) // 2)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if with_text else None)
            out["spans"].append(turn)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _group_of(groups: int):
    """Adds to each text the group to which _passages sends what is removed from it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _ids(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((mix64(keys.view(U64)) % U64(groups)).astype(np.int64)), batch.column(2)], names=["id", "key", "grp", "text"])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (runs of removed
    bytes), kept_sha256, and, as asked, kept (the bytes that stay, which may end
    within a character) and spans (starts and ends of the runs).

    Texts are taken as UTF-8; null counts as empty; passages don't cross documents.
    A null doc_id counts as larger than any other, and 2^63 - 1 as null. Rows that repeat one doc_id and
    text keep what each would keep. Of a doc_id that has several texts each is a document,
    compared with those of smaller doc_ids and not with one another. Other columns don't matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    every = docs.select(F.coalesce("doc_id", F.lit(NO_DOC)).alias("id"), "text")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    per = every.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("size"), F.min(h).alias("lo"), F.max(h).alias("hi"))
    n, size, doubtful = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("lo") != F.col("hi"))).first()
    several = bool(doubtful)
    # names a text; a hash is needed only where the doc_id doesn't
    pairs = every.select("id", (F.xxhash64("id", F.coalesce("text", F.lit(""))) if several else F.col("id")).alias("key"), "text")

    groups = max(1, -(-n // GROUP_DOCS), -(-size // GROUP_BYTES))
    marked = written(pairs.select("key", "text").mapInArrow(_anchor_rows(max(1, size // ANCHOR_BUCKET)), ANCHORED), "anchors")
    again = marked.where("bucket >= 0").select("bucket", "block", "hashes", "times").groupBy("bucket").applyInPandas(_repeated(HOT_ANCHORS), "bucket int, block bigint, bits binary, hot binary")
    again = written(again, "repeated")
    tables = marked.where("bucket < 0").select("block", "hashes", "ids", "counts", "buckets")
    flags = written(tables.groupBy("block").cogroup(again.groupBy("block")).applyInPandas(_by_document, "id bigint, n bigint, bits binary, hot binary"), "flags")
    forget(spark, marked, again)
    once = flags.withColumnRenamed("id", "key").dropDuplicates(["key"])
    flagged = pairs.join(once, "key").select("id", "key", "text", "n", "bits", "hot")
    segments = flagged.mapInArrow(_segment_rows(max(1, size // SEGMENT_BUCKET), several), SEGMENTS)
    found = written(segments.groupBy("bucket").applyInPandas(_passages(groups, several), FOUND), "passages")
    if not flags.where("hot is not null").isEmpty():
        # no group holds these: each passage is aggregated before it is shuffled
        hot = written(flagged.where("hot is not null").mapInArrow(_hot_passages(), "passage binary, id bigint, key bigint, start bigint"), "hot-passages")
        least = hot.groupBy("passage").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("times"))
        least = written(least.where("least < most").select("passage", "least", "times"), "least")
        removed = join_counted(hot, least, "passage", "times", hot.count()).where("least < id").select("key", "start")
        found = found.union(written(removed.mapInArrow(_hot_found(groups), FOUND), "hot"))
        forget(spark, hot, least)
    forget(spark, flags)
    placed = pairs.mapInArrow(_group_of(groups), "id bigint, key bigint, grp bigint, text string")
    out = placed.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(_apply(with_text), RESULT)
    return out.select(F.when(F.col("id") != NO_DOC, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")
