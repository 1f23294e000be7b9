import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from weftgraph.llm import bfd_packing, dp_packing, tokens

from .corpus import corpus, frame, with_clashes

BPE = tokens.ByteBpe(tokens.default_vocabulary())


def slow_ids(text):
    return BPE.slow.encode(text, add_special_tokens=False).ids


def test_both_libraries_agree_on_every_character_of_the_fast_way():
    for c in map(chr, range(0x10000)):
        if tokens.AGREED.fullmatch(c):
            for text in (c, f"a{c}b", f" {c} ", f"1{c}{c}.", f"\n{c}\n x", f"{c}  {c}'s"):
                assert BPE.fast.encode_ordinary(text) == slow_ids(text), hex(ord(c))


@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text(st.sampled_from(" \n\tabé'sdlre<|>.0\u00a0\u2028"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_library(text):
    assert BPE.encode(text).tolist() == slow_ids(text)


def test_special_token_in_a_text_is_what_the_library_makes_of_it():
    assert BPE.encode("a <|endoftext|> b").tolist() == slow_ids("a <|endoftext|> b")


@given(st.lists(st.integers(1, 30), min_size=1, max_size=14), st.lists(st.booleans(), min_size=14, max_size=14))
@settings(max_examples=200, deadline=None)
def test_cuts_are_the_best_of_all(sizes, documents):
    window = 24
    ends = np.cumsum(sizes)
    doc_ends = np.unique(np.append(ends[[d for d, x in zip(range(len(sizes)), documents, strict=False) if x]], ends[-1]))
    at, penalty = dp_packing.boundaries(doc_ends, ends, window)
    assert np.diff(at).max() <= window and set(ends) <= set(at)
    chosen = dp_packing.cut(at, penalty, window)

    pad = lambda n: 0 if bin(n).count("1") == 1 else window - n

    def cost(cuts):
        edges = [0, *at[cuts]]
        return sum(pad(int(b - a)) + dp_packing.WINDOW_COST for a, b in zip(edges, edges[1:], strict=False)) + sum(penalty[c] for c in cuts)

    best = [0.0] + [np.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = min(best[i] + pad(int(at[j] - at[i])) + dp_packing.WINDOW_COST + penalty[j] for i in range(j) if at[j] - at[i] <= window)
    edges = np.concatenate([[0], at[chosen]])
    assert edges[-1] == at[-1] and np.diff(edges).max() <= window
    assert cost(chosen.tolist()) == pytest.approx(best[-1])


def test_packed_windows_hold_every_id_once(spark):
    rows = corpus(60) + [(30_000, "word " * 5000, None, None, 0), (30_001, "x" * 9000, None, None, 0)]
    pieces = dp_packing.pack(with_clashes(frame(spark, rows))).collect()
    want = {r[0]: [*slow_ids(r[1] or ""), 0] for r in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0 and p.doc_tokens == len(want[p.doc_id])
        assert want[p.doc_id][p.start : p.start + p.length] == ids
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for name, ids in want.items():
        at = 0
        for start, length in sorted(by_doc[name]):
            assert start == at
            at += length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    used = sum(map(len, want.values()))
    lengths = np.array([sum(n for _, n in parts) for parts in by_sequence.values()])
    assert dp_packing.padding(lengths, 1024).sum() < 0.03 * used + 4 * 1024
    assert dp_packing.padding(np.array([1, 2, 3, 512, 513, 1000, 1024]), 1024).tolist() == [0, 0, 1021, 0, 511, 24, 0]


def test_packing_query_digests(spark, tmp_path):
    from weftgraph.llm import queries

    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7(spark, str(tmp_path)).collect()
    want = {r[0]: np.array([*slow_ids(r[1] or ""), 0], "<u4").tobytes() for r in corpus()}
    assert all(p.ids_crc32 == zlib.crc32(want[p.doc_id][4 * p.start : 4 * (p.start + p.length)]) for p in got)
    assert sum(p.length for p in got) == sum(len(x) // 4 for x in want.values())


def test_packing_of_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "a b", None, None, 0)]
    assert dp_packing.pack(frame(spark, [])).count() == 0 and bfd_packing.pack_rows(frame(spark, [])).count() == 0
    pieces = sorted(((p.doc_id, p.start, p.length, p.doc_tokens, np.frombuffer(p.ids, "<u4").tolist()) for p in dp_packing.pack(frame(spark, rows)).collect()), key=str)
    ids = [*slow_ids("a b"), 0]
    assert pieces == sorted([(None, 0, 1, 1, [0]), (1, 0, 1, 1, [0]), (1, 0, 1, 1, [0]), (2, 0, 3, 3, ids)], key=str)
    packed = bfd_packing.pack_rows(frame(spark, rows)).collect()
    segments = [(d, a, np.frombuffer(r.ids, "<u4")[x:y].tolist()) for r in packed for d, a, x, y in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False)]
    end = bfd_packing.END_ID
    assert sorted(segments, key=str) == sorted([(None, 0, [end]), (1, 0, [end]), (1, 0, [end]), (2, 0, [*ids[:-1], end])], key=str)


# best fit


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 20)), max_size=80))
@settings(max_examples=100, deadline=None)
def test_tree_finds_the_least_room(steps):
    tree, rooms = bfd_packing.RoomTree(20), []
    for put, n in steps:
        if put:
            tree.put(n, len(rooms))
            rooms.append(n)
        else:
            left = [r for r in rooms if r is not None and r >= n]
            got = tree.take(n)
            assert (got is None) == (not left)
            if got:
                row, room = got
                assert room == min(left) == rooms[row]
                rooms[row] = None


def test_rows_are_the_documents_again(spark):
    rows = corpus(60) + [(30_000, "word " * 5000, None, None, 0)]
    most = 256
    packed = bfd_packing.pack_rows(with_clashes(frame(spark, rows)), most).collect()
    found = defaultdict(dict)
    for r in packed:
        ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == most and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.used
        assert (ids[r.used :] == bfd_packing.PAD_ID).all()
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts, strict=False):
            assert places[a:b].tolist() == list(range(b - a))
            found[doc][start] = ids[a:b].tolist()
    for r in rows:
        whole = [x for _, part in sorted(found[r[0]].items()) for x in part]
        assert whole == [*slow_ids(r[1] or ""), bfd_packing.END_ID]
    used = sum(r.used for r in packed)
    assert used > 0.9 * most * len(packed)


def test_written_rows(spark, tmp_path):
    rows = bfd_packing.pack_rows(frame(spark), 512)
    bfd_packing.write_rows(rows, f"{tmp_path}/rows")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/rows").select("sequence_id", "ids").collect())) == sorted(map(tuple, rows.select("sequence_id", "ids").collect()))


def test_best_fit_decreasing_by_hand():
    assert bfd_packing.place(np.array([3, 7, 5, 2, 6]), 10) == [[1, 0], [4], [2, 3]] or bfd_packing.place(np.array([3, 7, 5, 2, 6]), 10) == [[1, 0], [4, 3], [2]]
    assert bfd_packing.place(np.array([], np.int64), 10) == []


def test_cut_holds_few_numbers_at_a_time():
    """Boundaries a few ids apart, so that a stretch has hundreds of thousands: the same cuts
    in chunks of any size, and memory for one chunk beside an index for each boundary."""
    import tracemalloc

    rng = np.random.default_rng(5)
    at = np.concatenate([[0], np.cumsum(rng.integers(1, 12, 200_000))]).astype(np.int64)
    penalty = rng.choice([0.0, 4.0, 12.0], len(at))
    tracemalloc.start()
    found = dp_packing.cut(at, penalty, 1024)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
    before, dp_packing.CHUNK = dp_packing.CHUNK, len(at)
    try:
        assert np.array_equal(found, dp_packing.cut(at, penalty, 1024))
    finally:
        dp_packing.CHUNK = before
