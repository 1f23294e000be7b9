import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from weftgraph.llm import common, exact_dedup, suffix_array, tensor_minhash
from weftgraph.llm.components import components

from .corpus import corpus, frame, with_clashes


def test_perfect_hash_is_minimal_and_perfect():
    words = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), ">u8").reshape(-1, 4).astype(np.uint64)
    sizes, bits = exact_dedup.build_function(words)
    assert sorted(exact_dedup.slots(words, sizes, bits)) == list(range(5000))
    assert exact_dedup.slots(words[:0], *exact_dedup.build_function(words[:0])).size == 0


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_exact_dedup_against_a_dictionary(spark, share):
    rows = corpus()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    want = {(r[0], min(groups[norm(r[1])]), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).digest()) for r in rows}
    got = exact_dedup.exact_dedup(with_clashes(frame(spark, rows)), share).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in got} == want
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_dedup_of_odd_tables(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    rows = [(None, "a b", None, None, None), (5, "a  b", None, None, None), (5, "a b", None, None, None), (None, "c", None, None, None)]
    got = sorted(map(str, exact_dedup.exact_dedup(frame(spark, rows)).drop("digest").collect()))
    assert got == sorted(["Row(doc_id=5, keep_id=5, group_size=3, kept=True)"] * 2 + ["Row(doc_id=None, keep_id=5, group_size=3, kept=False)", "Row(doc_id=None, keep_id=None, group_size=1, kept=True)"])


def test_index_serves_a_later_delivery(spark):
    from pyspark.sql import functions as F

    old = exact_dedup._grouped(exact_dedup.digests(frame(spark, [(1, "a", None, None, 1), (2, "b", None, None, 1)])))
    index = exact_dedup.build_index(old, 3)
    new = exact_dedup._grouped(exact_dedup.digests(frame(spark, [(9, "b", None, None, 1), (8, "c", None, None, 1)])))
    found = exact_dedup.look_up(index, new, 3)
    assert {(r.keep_id, r.group_size) for r in found.collect()} == {(1, 1), (2, 2), (8, 1)}
    assert index.agg(F.sum("n")).first()[0] == 2


# near duplicates


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(zip(*[words[i:] for i in range(5)], strict=False)) if len(words) >= 5 else frozenset([tuple(words)])


def near_by_force(rows, percent=85):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(k, len(sets[k]), find(k), find(k) == k) for k in ids}


@pytest.mark.parametrize("seed", [3, 8])
def test_near_dedup_against_all_pairs(spark, seed):
    rows = corpus(140, seed)
    got = tensor_minhash.near_dedup(with_clashes(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == near_by_force(rows)


def test_near_dedup_of_a_large_family(spark, monkeypatch):
    """More nodes than a block, at the threshold's both sides, in small blocks."""
    monkeypatch.setattr(tensor_minhash, "CONFIRMED_ROWS", 16)
    monkeypatch.setattr(tensor_minhash, "CHUNK_SHINGLES", 1000)
    monkeypatch.setattr(tensor_minhash, "BLOCK_NODES", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = base[:]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), None, None, None))
    want = near_by_force(rows)
    got = {tuple(r) for r in tensor_minhash.near_dedup(frame(spark, rows)).collect()}
    wrong = got ^ want
    assert not wrong


def test_near_dedup_of_odd_tables(spark):
    assert tensor_minhash.near_dedup(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f", None, None, None), (4, "a b c d e f", None, None, None), (4, "a b c d e f", None, None, None), (7, "A B c d e f", None, None, None), (9, None, None, None, None), (8, " ", None, None, None)]
    got = sorted(map(tuple, tensor_minhash.near_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (7, 2, 4, False), (9, 0, 9, True), (8, 0, 8, True)], key=str)


def test_families_of_many_sizes(spark, monkeypatch):
    """Links between steps of size, each in several chunks."""
    monkeypatch.setattr(tensor_minhash, "CHUNK_SHINGLES", 300)
    rng = random.Random(9)
    rows = []
    for i in range(120):
        words = [f"w{k}" for k in range(rng.randint(60, 110))]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), None, None, None))
    everything = frame(spark, rows)
    full = tensor_minhash.hashed_sets(everything.selectExpr("doc_id as node", "text"))
    families = spark.createDataFrame([(i, 0) for i in range(1, 120)], "node bigint, component bigint")
    comps = families.limit(0)
    links = [(r.u, r.v) for r in tensor_minhash.within_families(families, comps, full).collect()]
    sets = [shingle_set(r[1]) for r in rows]
    alike = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    assert all(alike(sets[u], sets[v]) for u, v in links)
    root = {i: i for i in range(120)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    assert {(i, find(i)) for i in range(120)} == {(k, c) for k, _, c, _ in near_by_force(rows)}


def odd_ids(rows, seed=2):
    """The rows with null, shared and own doc_ids; some of them twice."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, r[0] % 40, r[0]]), *r[1:]) for r in rows]
    return rows + [rng.choice(rows) for _ in range(len(rows) // 5)]


def classes_by_force(rows, percent):
    """The near-duplicate classes of the distinct texts, as lists of rows."""
    texts = sorted({r[1] for r in rows if shingle_set(r[1])})
    of = {k: c for k, _, c, _ in near_by_force([(i, t) for i, t in enumerate(texts)], percent)}
    out = defaultdict(list)
    for r in rows:
        if shingle_set(r[1]):
            out[of[texts.index(r[1])]].append(r)
    return list(out.values())


def test_near_dedup_of_null_and_shared_doc_ids(spark):
    rows = odd_ids(corpus(90, 4))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in tensor_minhash.near_dedup(frame(spark, rows)).collect()), key=str)
    want = [(r[0], 0, r[0], True) for r in rows if not shingle_set(r[1])]
    for members in classes_by_force(rows, 85):
        least = min((r[0] for r in members if r[0] is not None), default=None)
        want += [(r[0], len(shingle_set(r[1])), least, r[0] == least) for r in members]
    assert got == sorted(want, key=str)


def test_stages_lose_no_text_and_keep_one_row_each(spark):
    rows = odd_ids(corpus(90, 4))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    kept = [tuple(r) for r in exact_dedup.drop_exact_repeats(frame(spark, rows)).collect()]
    assert sorted(norm(r[1]) for r in kept) == sorted(groups)
    last = lambda r: (r[0] is None, r[0])
    for r in kept:
        assert r in groups[norm(r[1])] and last(r) == min(map(last, groups[norm(r[1])]))

    kept = [tuple(r) for r in tensor_minhash.drop_near_duplicates(frame(spark, rows), 80).collect()]
    classes = classes_by_force(rows, 80)
    none = [r for r in rows if not shingle_set(r[1])]
    assert len(kept) == len(classes) + len(none)
    for members in classes:
        (one,) = [r for r in kept if r in members]
        assert last(one) == min(map(last, members))
    assert all(r in kept for r in none)


def test_stages_of_few_odd_rows(spark):
    rows = [(1, "a"), (7, "a"), (7, "unique text"), (None, "b"), (None, "b"), (9, "c"), (9, "c")]
    docs = frame(spark, [(*r, None, None, None) for r in rows])
    for stage in (exact_dedup.drop_exact_repeats, tensor_minhash.drop_near_duplicates):
        assert sorted(((r.doc_id, r.text) for r in stage(docs).collect()), key=str) == [(1, "a"), (7, "unique text"), (9, "c"), (None, "b")]


def test_frequent_keys_are_joined_like_others(spark):
    rows = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(3000)], "k bigint, i bigint")
    table = rows.groupBy("k").count()
    for n in (3000, 3000 * common.HOT_KEYS):
        got = common.join_counted(rows, table, "k", "count", n).collect()
        assert sorted((r.k, r.i, r["count"]) for r in got) == sorted((r.k, r.i, r["count"]) for r in rows.join(table, "k").collect())


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_threshold_are_found(percent):
    """20,000 pairs of just the similarity: who meets in a table and has alike sketches."""
    m, need = tensor_minhash.search(percent)
    rng = np.random.default_rng(7)
    common, own = 2 * percent // 5, (100 - percent) // 5  # of 2 * 20 shingles of a union
    missed = 0
    for _ in range(20):
        words = rng.integers(0, 2**63, (1000, common + 2 * own), dtype=np.uint64)
        x = tensor_minhash.minhashes([np.unique(w[: common + own]) for w in words], m)
        y = tensor_minhash.minhashes([np.unique(np.concatenate([w[:common], w[common + own :]])) for w in words], m)
        agree = tensor_minhash.bands(x) == tensor_minhash.bands(y)
        met = agree[:, :m].any(axis=1) & agree[:, m:].any(axis=1)
        missed += int((~met | ((x.astype(np.uint8) == y.astype(np.uint8)).sum(axis=1) < need)).sum())
    assert missed <= 14  # 5 are expected


def test_links_by_matrix_are_those_by_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        k = rng.integers(0, 40)
        s[rng.choice(300, k, replace=False)] = rng.integers(0, 2**63, k, dtype=np.uint64)
        sets.append(np.unique(s))
    comp = list(range(60))
    found = tensor_minhash._links(list(range(60)), list(range(60)), comp, sets, 85)

    def classes(pairs):
        root = list(range(60))
        for a, b in pairs:
            a, b = root[a], root[b]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    every = [(i, j) for i in range(60) for j in range(i) if tensor_minhash.similar(sets[i], sets[j], 85)]
    assert classes(found) == classes(every) and len(found) < 60


@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
@settings(max_examples=4, deadline=None)
def test_components(spark, pairs):
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    root = {}
    for a, b in pairs:
        ra, rb = root.setdefault(a, {a}), root.setdefault(b, {b})
        ra |= rb
        for x in rb:
            root[x] = ra
    assert got == {x: min(s) for x, s in root.items() if x != min(s)}


# passages


def passages_by_force(rows, n=50):
    first = {}
    for name, text, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - n + 1):
            first.setdefault(raw[i : i + n], name)
    out = set()
    for name, text, *_ in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - n + 1):
            if first[raw[i : i + n]] < name:
                gone[i : i + n] = [True] * n
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.add((name, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(3, 1 << 17), (4, 1 << 17), (4, 3)])
def test_repeats_against_every_passage(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_array, "HOT_ANCHORS", hot)
    rows = corpus(60, seed) + [(20_000, "ab" * 200, None, None, 0), (20_001, "xab" + "ab" * 60, None, None, 0), (20_002, "a" * 300, None, None, 0), (20_003, "b" + "a" * 120, None, None, 0)]
    got = suffix_array.remove_repeats(with_clashes(frame(spark, rows))).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == passages_by_force(rows)
    for r in got:
        raw = (next(x[1] for x in rows if x[0] == r.doc_id) or "").encode()
        gone = [raw[a:b] for a, b in zip(r.spans[::2], r.spans[1::2], strict=True)]
        assert sum(map(len, gone)) == r.n_removed and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_repeats_of_odd_tables(spark):
    assert suffix_array.remove_repeats(frame(spark, [])).count() == 0
    t = "".join(chr(97 + i % 26) for i in range(60))
    got = {(r.doc_id, r.n_removed) for r in suffix_array.remove_repeats(frame(spark, [(None, t, None, None, 0), (2, t, None, None, 0), (1, None, None, None, 0)])).collect()}
    assert got == {(None, 60), (2, 0), (1, 0)}
    twice = [(1, t, None, None, 0), (2, t + "x", None, None, 0), (2, "other", None, None, 0), (2, None, None, None, 0), (3, t, None, None, 0), (3, t, None, None, 0)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_array.remove_repeats(frame(spark, twice)).collect())
    assert got == [(1, 60, 0), (2, 0, 0), (2, 5, 0), (2, 61, 60), (3, 60, 60), (3, 60, 60)]


@pytest.mark.parametrize("hot", [1 << 17, 3])
def test_every_text_of_a_doc_id_is_judged_and_searched(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_array, "HOT_ANCHORS", hot)
    rng = random.Random(2)
    rows = [(rng.choice([None, None, r[0] % 40, r[0]]), *r[1:]) for r in corpus(60, 5)]
    assert len({r[1] for r in rows if r[0] is None}) > 10
    got = suffix_array.remove_repeats(frame(spark, rows)).collect()
    want = passages_by_force([(2**63 if r[0] is None else r[0], *r[1:]) for r in rows])
    assert len(got) == len(rows)
    assert {(2**63 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


@given(st.lists(st.text("ab", min_size=50, max_size=84), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_two_stage_order(texts):
    texts = list(dict.fromkeys(t.encode() for t in texts))
    rows = np.zeros((len(texts), suffix_array.STRIDE), np.uint8)
    for i, t in enumerate(texts):
        rows[i, : len(t)] = np.frombuffer(t, np.uint8) + 1
    lengths = np.array([len(t) for t in texts])
    places = suffix_array.suffix_order(rows, lengths, lengths - suffix_array.PASSAGE + 1)
    cut = [texts[p // suffix_array.STRIDE][p % suffix_array.STRIDE :][:50] for p in places]
    whole = [c for c, p in zip(cut, places, strict=True) if p % suffix_array.STRIDE <= lengths[p // suffix_array.STRIDE] - 50]
    assert whole == sorted(whole)
    assert sorted(whole) == sorted(t[i : i + 50] for t in texts for i in range(len(t) - 49))
