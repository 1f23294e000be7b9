import binascii
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from weftgraph.llm import string_kernel, winnowing

from .corpus import corpus, frame, with_clashes


def test_language_is_told_on_held_out_texts(spark):
    rows = [r for r in corpus(400, 11)]
    got = {r.doc_id: r for r in string_kernel.identify(with_clashes(frame(spark, rows))).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if r[2] and r[1] and any(c.isalpha() for c in r[1]) and len(r[1]) > 60 and got[r[0]].held_out]
    assert all(got[r[0]].held_out == (binascii.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    # near copies carry the label of the draw, not of the text they copy
    right = sum(got[r[0]].lang_pred == r[2] for r in held if set(r[1].lower().split()) & set(_words(r[2])))
    assert len(held) > 40 and right / len(held) > 0.6
    for r in rows:
        lettered = bool(r[1]) and any(c.isalpha() for c in r[1])
        assert (got[r[0]].lang_pred == "und") == (not lettered) and 0 <= got[r[0]].score <= 1


def _words(lang):
    from .corpus import WORDS

    return WORDS[lang]


def test_language_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = string_kernel.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right, all_ = got.where("held_out").selectExpr("count_if(lang_pred = lang)", "count(*)").first()
    assert right >= 0.99 * all_


def test_kernel_products_are_the_kernel():
    texts = ["the thing and the river", "le été des leçons", "das mädchen und der fluß", "the house", "la forêt"]
    model = string_kernel.fit(texts, ["en", "fr", "de", "en", "fr"])
    grams = lambda t: {t.lower().encode()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    known = set().union(*map(grams, texts))
    data = [t.encode() for t in [*texts, "wholly new words"]]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    x, familiar = model.presence(np.frombuffer(b"".join(data), np.uint8), offsets)
    every = lambda t: [t.lower().encode()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)]
    assert familiar == pytest.approx([sum(g in known for g in every(d.decode())) / len(every(d.decode())) for d in data])
    assert [int(v) for v in x.sum(axis=1)] == [len(grams(d.decode()) & known) for d in data]
    assert int((x[0] * x[3]).sum()) == len(grams(texts[0]) & grams(texts[3]))


def test_scores_against_plain_loops():
    """Kernel, landmarks, K^(-1/2), ridge and scores, without a product over blocks."""
    import math
    import random

    rng = random.Random(6)
    texts = [" ".join(rng.choice(_words(lang)) for _ in range(rng.randint(3, 9))) for lang in ("en", "fr", "de") * 6]
    languages = ["en", "fr", "de"] * 6
    marks = [i for lang in ("de", "en", "fr") for i in [k for k, x in enumerate(languages) if x == lang][:3]]
    grams = lambda t: {bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    vocabulary = set().union(*[grams(texts[i]) for i in marks])
    spectrum = lambda t: grams(t) & vocabulary

    def kernel(s, t):
        a, b = spectrum(s), spectrum(t)
        return len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))

    k = np.array([[kernel(texts[i], texts[j]) for j in marks] for i in marks])
    value, vector = np.linalg.eigh(k)
    half = sum(np.outer(vector[:, i], vector[:, i]) / math.sqrt(value[i]) for i in range(len(marks)) if value[i] > 1e-9 * value.max())
    features = lambda t: half @ np.array([kernel(t, texts[j]) for j in marks])
    x = np.array([features(t) for t in texts])
    new = [*texts, "The RIVER and été", "x", "über ***", ""]
    model = string_kernel.fit(texts, languages, landmarks_per_language=3)
    data = [t.encode() for t in new]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    got, _ = model.scores(np.frombuffer(b"".join(data), np.uint8), offsets)
    for column, lang in enumerate(("de", "en", "fr")):
        y = np.array([1.0 if z == lang else -1.0 for z in languages])
        # ridge with an intercept that isn't penalised, as one linear system
        n = x.shape[1]
        a = np.zeros((n + 1, n + 1))
        a[:n, :n] = x.T @ x + string_kernel.RIDGE * np.eye(n)
        a[:n, n] = a[n, :n] = x.sum(axis=0)
        a[n, n] = len(x)
        solved = np.linalg.solve(a, np.append(x.T @ y, y.sum()))
        want = [features(t) @ solved[:n] + solved[n] for t in new]
        assert got[:, column] == pytest.approx(want, abs=1e-5)


def test_texts_of_another_script_are_rejected(spark):
    rows = [(i, " ".join(np.random.default_rng(i).choice(_words(x), 30)), x, None, None) for i, x in enumerate(["en", "fr", "de"] * 20)]
    strange = [(100, "Привет мир, как дела сегодня", "en", None, None), (101, "你好世界今天天气很好", None, None, None), (102, "De.", None, None, None), (103, "123 456", None, None, None)]
    held = lambda i: binascii.crc32(str(i).encode()) % 4 == 2
    kept = {r.doc_id for r in string_kernel.keep_identified(frame(spark, rows + [(next(i for i in range(200, 400) if held(i)), *strange[0][1:]), *strange[1:]])).collect()}
    assert kept == {r[0] for r in rows} | {102}


def test_training_is_bounded_and_counts_equal_texts_once(spark):
    rows = [(i % 3, "the house", "en", None, None) for i in range(50)] + [(None, "la maison", "fr", None, None)] * 9 + [(70 + i, f"wort{i}", f"l{i}", None, None) for i in range(12)]
    model = string_kernel.train(frame(spark, rows), train_per_language=4, languages=5)
    assert len(model.languages) == 5
    few = string_kernel.SCORED_PLACES
    try:
        string_kernel.SCORED_PLACES = 1  # one row at a time
        one = sorted(map(tuple, string_kernel.predict(frame(spark, rows), model).collect()), key=str)
    finally:
        string_kernel.SCORED_PLACES = few
    many = sorted(map(tuple, string_kernel.predict(frame(spark, rows), model).collect()), key=str)
    assert [x[:2] for x in one] == [x[:2] for x in many] and [x[2] for x in one] == pytest.approx([x[2] for x in many], abs=1e-6)


def test_language_of_odd_tables(spark):
    assert string_kernel.identify(frame(spark, [])).count() == 0
    got = string_kernel.identify(frame(spark, [(1, "abc", None, None, 3), (None, None, None, None, None)])).collect()
    assert {(r.doc_id, r.held_out, r.lang_pred, r.score) for r in got} == {(1, False, "und", 0.0), (None, False, "und", 0.0)}
    kept = string_kernel.keep_identified(with_clashes(frame(spark)))
    assert kept.columns == with_clashes(frame(spark)).columns


def test_languages_of_long_texts_are_learned(spark):
    words = _words("en"), _words("fr"), _words("de")
    rng = np.random.default_rng(4)
    rows = []
    for i in range(90):
        n, lang = (40, "en") if i % 3 == 0 else (900, ("fr", "de")[i % 3 - 1])
        rows.append((None if i % 7 == 0 else i, ("1" * 3000 + " " if n > 40 else "") + " ".join(rng.choice(words[i % 3], n)), lang, None, None))
    got = string_kernel.identify(frame(spark, rows), train_chars=2000).collect()
    want = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in got if r.doc_id is not None)


def test_lettered_documents_stay_where_nothing_is_learned(spark):
    rows = [(1, "abc", None, None, 3), (2, "123", None, None, 3), (3, None, None, None, None), (None, "été", None, None, 3)]
    assert {r.doc_id for r in string_kernel.keep_identified(frame(spark, rows)).collect()} == {1, None}
    long = [(i, "the house " * 3000, "en", None, None) for i in range(8)]
    assert string_kernel.keep_identified(frame(spark, long)).count() == 8


# winnowing


def hashes_by_force(text, k):
    """The polynomial of each k code points, term by term, mixed and cut to 32 bits."""
    word, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & word
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & word
        return x ^ x >> 31

    return [mixed(sum((ord(c) + 1) * base ** (k - 1 - j) for j, c in enumerate(text[i : i + k])) & word) >> 32 for i in range(len(text) - k + 1)]


def winnow_by_force(text, k=winnowing.K, w=winnowing.WINDOW):
    if not text:
        return [], []
    h = hashes_by_force(text, min(k, len(text)))
    chosen = []
    for i in range(max(1, len(h) - w + 1)):
        part = h[i : i + w]
        at = i + max(j for j, x in enumerate(part) if x == min(part))
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return [int(h[i]) for i in chosen], chosen


@given(st.lists(st.text(st.sampled_from("abé💡 "), max_size=90), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_winnowing_against_every_window(texts):
    for text, (hashes, places) in zip(texts, winnowing.fingerprints(texts), strict=True):
        assert (hashes.tolist(), places.tolist()) == winnow_by_force(text)
        assert [x.tolist() for x in winnowing.decode(winnowing.encode(hashes, places))] == [hashes.tolist(), places.tolist()]


def test_a_shared_passage_has_a_shared_hash():
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    passage = letters(winnowing.K + winnowing.WINDOW - 1)
    (a, at), (b, _) = winnowing.fingerprints([letters(200) + passage + letters(99), letters(31) + passage + letters(7)])
    common = set(a.tolist()) & set(b.tolist())
    assert any(200 <= p < 200 + winnowing.WINDOW for h, p in zip(a.tolist(), at.tolist(), strict=True) if h in common)


@pytest.mark.parametrize("range_rows", [7, 2000])
def test_neighbours_against_a_sorted_list(spark, monkeypatch, range_rows):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", range_rows)
    rows = corpus(50)
    got = {r.doc_id: r for r in winnowing.compare_neighbours(with_clashes(frame(spark, rows))).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        text, other = r[1] or "", after[1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + other[:m]
        x = got[r[0]]
        prints = [set(winnow_by_force(t)[0]) for t in (text, edited, other)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert x.fingerprint == winnowing.encode(*map(np.array, winnow_by_force(text))) and x.edited_fingerprint == winnowing.encode(*map(np.array, winnow_by_force(edited)))
        assert x.near_edited == pytest.approx(like(prints[0], prints[1])) and x.near_next == pytest.approx(like(prints[0], prints[2]))


def test_fingerprints_of_documents(spark):
    rows = corpus(20)
    got = {r.doc_id: r for r in winnowing.fingerprint_documents(with_clashes(frame(spark, rows))).collect()}
    assert {k: (r.n_chars, r.fingerprint) for k, r in got.items()} == {r[0]: (len(r[1] or ""), winnowing.encode(*map(np.array, winnow_by_force(r[1] or "")))) for r in rows}


def test_neighbours_of_odd_tables(spark):
    assert winnowing.compare_neighbours(frame(spark, [])).count() == 0
    one = winnowing.compare_neighbours(frame(spark, [(4, "abcdef", None, None, 6)])).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(4, hashlib.sha256(b"abcdab").hexdigest(), 1.0)]
    rows = [(None, "x" * 40, None, None, 0), (3, "y" * 40, None, None, 0), (3, "y" * 40, None, None, 0)]
    assert winnowing.compare_neighbours(frame(spark, rows)).count() == 3
