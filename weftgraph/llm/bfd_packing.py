"""Packed id matrices by best-fit-decreasing.

Documents longer than a row are split without loss into whole rows and a rest.
Pieces are then placed from the longest to the shortest, each into the row with
the least room that suffices; a segment tree over the possible amounts of room
finds that row in a step per level. Each task packs some thousands of documents
at a time, shuffling nothing, so that a group of documents leaves few rows with
room and memory stays bounded.

A row of the result is a row of the matrix: its ids, padded, the cumulative
lengths of its segments, and position ids that begin anew at each segment.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches
from .tokens import byte_bpe, default_vocabulary

ROW_IDS = 2048

#: Ids packed at a time.
GROUP_IDS = 1 << 22

END_ID, PAD_ID = 50256, 50256

SCHEMA = "sequence_id bigint, used int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<bigint>, starts array<bigint>"


class RoomTree:
    """Rows by the room they have left, from 0 to most."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.size + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least room of at least need, removed; and its room."""
        count, i = self.count, self.size + need
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return self.rows[room].pop(), room


def place(lengths: np.ndarray, most: int) -> list[list[int]]:
    """The pieces in each row, by index. No piece is longer than most."""
    tree, rows = RoomTree(most), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        found = tree.take(n)
        if found is None:
            rows.append([k])
            tree.put(most - n, len(rows) - 1)
        else:
            row, room = found
            rows[row].append(k)
            tree.put(room - n, row)
    return rows


def _matrix(names: list, ids: list[np.ndarray], most: int, base: int) -> Iterator[pa.RecordBatch]:
    pieces = [(d, a, min(most, len(x) - a)) for d, x in enumerate(ids) for a in range(0, len(x), most)]
    rows = place(np.array([n for _, _, n in pieces], np.int64), most)
    steps = np.arange(most, dtype="<u2" if most <= 1 << 16 else "<u4")
    for first in range(0, len(rows), 512):
        out: dict[str, list] = {k: [] for k in ("sequence_id", "used", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts")}
        for r, row in enumerate(rows[first : first + 512], first):
            line, places, ends = np.full(most, PAD_ID, "<u4"), steps.copy(), [0]
            for k in row:
                d, a, n = pieces[k]
                at = ends[-1]
                line[at : at + n] = ids[d][a : a + n]
                places[at : at + n] = steps[:n]
                ends.append(at + n)
            places[ends[-1] :] = 0
            out["sequence_id"].append(base + r)
            out["used"].append(ends[-1])
            out["ids"].append(line.tobytes())
            out["cu_seqlens"].append(ends)
            out["position_ids"].append(places.tobytes())
            out["doc_ids"].append([names[pieces[k][0]] for k in row])
            out["starts"].append([pieces[k][1] for k in row])
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))
    return len(rows)


def _packer(path: str, most: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        base = TaskContext.get().partitionId() << 40
        end = np.array([END_ID], np.uint32)
        names: list = []
        held: list[np.ndarray] = []
        total = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for k, text in enumerate(batch.column(1)):
                ids = np.append(bpe.encode(text.as_py() or ""), end)
                names.append(keys[k])
                held.append(ids)
                total += len(ids)
                if total >= GROUP_IDS:
                    base += yield from _matrix(names, held, most, base)
                    names, held, total = [], [], 0
        if held:
            yield from _matrix(names, held, most, base)

    return run


def pack_rows(docs: DataFrame, row_ids: int = ROW_IDS, vocabulary: str | None = None) -> DataFrame:
    """One row per packed row: sequence_id, used (ids before the padding), ids
    (little-endian unsigned 32-bit, row_ids of them), cu_seqlens (from 0 to used),
    position_ids (little-endian unsigned, 16-bit up to 65,536 ids a row, 0 in the
    padding), and for each segment the doc_id and the place in its document.

    Every document is its text's ids and the end's id; null text is the end's id
    alone. Repeated rows and rows with a null doc_id are packed like others. A very
    long text is cut into as many rows as it needs. An empty table gives no rows.
    Other columns don't matter.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_packer(vocabulary or default_vocabulary(), row_ids), SCHEMA)


def write_rows(rows: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
