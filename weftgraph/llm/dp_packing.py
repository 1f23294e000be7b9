"""Packing documents into windows in their order, by dynamic programming.

The documents' ids, one after another, are cut into windows of at most a given
number of ids. A window may end where a document or a sentence ends, and, at a
higher penalty, at certain places inside a long sentence. The cuts minimise

    padding of all windows + WINDOW_COST for each of them
    + penalties of the cuts that divide a document,

where a window is padded to its full size, except at a power of two, at which it isn't
padded. So best(j) is penalty(j) + WINDOW_COST + the less of

    min over i, b(j) - b(i) <= window, of best(i) + window - (b(j) - b(i)),
    min over i, b(j) - b(i) a power of two, of best(i).

As best(i) + b(i) is all of the first that depends on i, a queue of candidates with
rising values holds the minimum of the sliding range, and every boundary enters and
leaves it once. The second has one candidate for each power at most. WINDOW_COST keeps
a text from falling into many small windows.

Each task packs its documents in the order it reads them, some millions of ids
at a time; no rows are shuffled, and a stretch leaves one short window at most.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches
from .tokens import byte_bpe, default_vocabulary

WINDOW = 1024

#: Ids of padding that a cut at the end of a sentence, or inside one, must save.
SENTENCE_PENALTY, INSIDE_PENALTY = 4.0, 12.0

#: Ids of padding that a window more must save.
WINDOW_COST = 8.0

#: A sentence of more than twice so many ids may be cut after every so many.
INSIDE_EVERY = 16

#: Ids packed at a time.
STRETCH_IDS = 1 << 22

#: Boundaries that are Python's numbers at a time.
CHUNK = 1 << 14

#: The id that ends each document.
END_ID = 0

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, 0 first, and the penalty of a cut there; no two
    neighbours are further apart than a window."""
    at = np.unique(np.concatenate([[0], sentence_ends, doc_ends])).astype(np.int64)
    gaps, step = np.diff(at), min(INSIDE_EVERY, window)
    long = np.flatnonzero(gaps > min(2 * INSIDE_EVERY, window))
    more = (gaps[long] - 1) // step  # places inside each of them
    inside = np.repeat(at[long], more) + step * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    at = np.sort(np.concatenate([at, inside]))
    penalty = np.full(len(at), SENTENCE_PENALTY)
    penalty[np.searchsorted(at, inside)] = INSIDE_PENALTY
    penalty[np.searchsorted(at, doc_ends)] = 0.0
    penalty[0] = 0.0
    return at, penalty


def padding(lengths: np.ndarray, window: int) -> np.ndarray:
    """Of windows of these lengths: up to the full size, except at a power of two."""
    return np.where(lengths & (lengths - 1) == 0, 0, window - lengths)


def unpadded(at: np.ndarray, window: int, begin: int = 0) -> tuple[list[int], list[int], list[int]]:
    """Pairs of boundaries a power of two apart, less than a window, of which the later one is
    begin or after it: for the later one, in order, the places of its pairs, the earlier one,
    and the power."""
    later, earlier, power = [], [], []
    size = 1
    while size < window:
        i = np.searchsorted(at, at[begin:] - size)
        j = np.flatnonzero(at[i] == at[begin:] - size)
        later.append(j + begin)
        earlier.append(i[j])
        power.append(np.full(len(j), size))
        size *= 2
    j = np.concatenate([*later, np.zeros(0, np.int64)])
    order = np.argsort(j, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(j, minlength=len(at)))])
    take = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)])[order].tolist()
    return first.tolist(), take(earlier), take(power)


def cut(at: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """The ends of the best windows, as indexes into at. Only a chunk of the boundaries and
    those a window before it are held as Python's numbers."""
    n = len(at)
    came = np.zeros(n, np.int32)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # best(i) + b(i), b(i), i
    push, pop, drop = queue.append, queue.pop, queue.popleft
    values, back = [0.0], 0  # best(i) + b(i), from i = back on
    for low_j in range(1, n, CHUNK):
        high_j = min(n, low_j + CHUNK)
        near = int(np.searchsorted(at, at[low_j] - window))
        del values[: near - back]
        back = near
        part = at[near:high_j]
        b, pen = part.tolist(), (penalty[near:high_j] + WINDOW_COST).tolist()
        first, earlier, power = unpadded(part, window, low_j - near)
        begin = 0
        for j in range(low_j - near, high_j - near):
            x = b[j]
            low = x - window
            while queue[0][1] < low:
                drop()
            value, _, i = queue[0]
            value += window
            end = first[j + 1]
            if begin != end:
                for k in range(begin, end):
                    other = values[earlier[k]] + power[k]
                    if other < value:
                        value, i = other, earlier[k] + near
                begin = end
            came[j + near] = i
            value += pen[j]  # best(j) + b(j)
            values.append(value)
            while queue and queue[-1][0] >= value:
                pop()
            push((value, x, j + near))
    ends, j = [], n - 1
    while j > 0:
        ends.append(j)
        j = int(came[j])
    return np.array(ends[::-1], dtype=np.int64)


def pack_stretch(doc_ids: list, ids: list[np.ndarray], ends_sentence: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Pieces of the documents, by column; ids: of each document, with the end's."""
    flat = np.concatenate(ids)
    doc_at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    at, penalty = boundaries(doc_at[1:], np.flatnonzero(ends_sentence[flat]) + 1, window)
    windows = np.concatenate([[0], at[cut(at, penalty, window)]])
    starts = np.union1d(windows[:-1], doc_at[:-1])
    ends = np.append(starts[1:], len(flat))
    doc = np.searchsorted(doc_at, starts, side="right") - 1
    seq = np.searchsorted(windows, starts, side="right") - 1
    return {"doc": doc, "start": starts - doc_at[doc], "length": ends - starts, "doc_tokens": np.diff(doc_at)[doc], "seq": seq, "offset": starts - windows[seq], "flat": flat, "at": starts}


def _packer(path: str, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        base = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], np.uint32)
        held_ids: list = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, total
            p = pack_stretch(held_ids, held, bpe.ends_sentence, window)
            names = np.empty(len(held_ids), dtype=object)
            names[:] = held_ids
            held_ids.clear()
            held.clear()
            raw = pa.py_buffer(p["flat"].astype("<u4", copy=False))
            for a in range(0, len(p["doc"]), 4096):
                s = slice(a, a + 4096)
                at = np.append(p["at"][s], p["at"][s][-1] + p["length"][s][-1])  # a piece begins where the last one ends
                offsets = pa.py_buffer((4 * (at - at[0])).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[p["doc"][s]], pa.int64()),
                        pa.array(p["start"][s]),
                        pa.array(p["length"][s]),
                        pa.array(p["doc_tokens"][s]),
                        pa.array(base + p["seq"][s]),
                        pa.array(p["offset"][s]),
                        pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets, raw.slice(4 * int(at[0]), 4 * int(at[-1] - at[0]))]),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )
            base += int(p["seq"][-1]) + 1
            total = 0

        for batch in batches:
            names = batch.column(0).to_pylist()
            for k, text in enumerate(batch.column(1)):
                ids = np.append(bpe.encode(text.as_py() or ""), end)
                held_ids.append(names[k])
                held.append(ids)
                total += len(ids)
                if total >= STRETCH_IDS:
                    yield from flush()
        if held:
            yield from flush()

    return run


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length,
    doc_tokens (ids of its document, the end's included), sequence_id, offset
    (where it lies in its sequence) and ids (little-endian unsigned 32-bit).

    Null or empty text is its end's id alone. Rows are packed as they come, also
    repeated ones and those with a null doc_id. A text of any length is cut into
    as many windows as it needs; it is held in memory as a whole. Other columns
    don't matter; an empty table gives no pieces.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_packer(vocabulary or default_vocabulary(), window), SCHEMA)
