import re
from collections import Counter, defaultdict

import pytest
from weftgraph.llm import chat_rotation, mixing, url_reputation

from .corpus import corpus, frame, with_clashes


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_by_rounds(sizes, weights=(5, 2, 1)):
    """Shares the rest again and again until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    open_ = {s for s in sizes if sizes[s]}
    rest = total
    while open_ and rest > 1e-9:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / w
        rest = sum(max(0.0, target[s] - 2 * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_targets(spark):
    for sizes in ({"a": 100, "b": 5000, "c": 40, "d": 900, None: 77, "é": 0}, {"a": 10}, {"a": 10, "b": 10, "c": 10}, {"a": 0}):
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = targets_by_rounds(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s])


def test_mix_comes_near_its_targets(spark):
    rows = corpus(300)
    docs = with_clashes(frame(spark, rows))
    mix = mixing.Mix(docs)
    got = mix.taken().collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size, source = {r[0]: words(r[1]) for r in rows}, {r[0]: r[3] for r in rows}
    sums, taken = Counter(), Counter()
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        sums[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    want = targets_by_rounds(dict(sums))
    for r in got:
        assert r.source_size == sums[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6 * t, (s, taken[s], t)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.Mix(docs).taken().collect()))
    again = Counter()
    for r in mixing.mixed_documents(docs).collect():
        again[r.doc_id] += words(r.text)
    assert {k: v for k, v in again.items() if v} == {r.doc_id: r.taken for r in got if r.taken}


@pytest.mark.parametrize("equal", [4, 4096])
def test_mix_of_rows_that_share_a_doc_id(spark, monkeypatch, equal):
    """Each row is mixed by itself, also among equal ones; k rows don't make k * k."""
    monkeypatch.setattr(mixing, "EQUAL_ROWS", equal)
    text = " ".join(f"w{i}" for i in range(41))
    rows = [(5, text, None, "a", 0)] * 30 + [(None, text + f" {i}", None, "a", 0) for i in range(30)] + [(5, f"b{i} c", None, None, 0) for i in range(40)]
    docs = frame(spark, rows)
    size = Counter()
    for r in rows:
        size[r[3]] += words(r[1])
    want = targets_by_rounds(dict(size))
    taken = mixing.Mix(docs, block=16).taken().collect()
    mixed = mixing.mixed_documents(docs, block=16).collect()
    assert len(taken) == len(rows) and all(r.taken <= 2 * r.size for r in taken)
    for s in size:
        got = sum(words(r.text) for r in mixed if r.source == s)
        assert abs(got - want[s]) <= 1 and got == sum(r.taken for r in taken if (r.source_size == size[s]))
    assert max(Counter(r.text for r in mixed if r.doc_id is None).values()) <= 2
    assert sum(words(r.text) for r in mixed if r.doc_id == 5 and r.source == "a") <= 2 * 30 * 41
    assert all(any(r.text.strip() in (x[1] or "") and r.source == x[3] and r.doc_id == x[0] for x in rows) for r in mixed)


def test_small_sources_meet_their_targets(spark):
    rows = [(i, "x " * 900, None, s, 0) for i, s in enumerate("aabb" * 30)] + [(1000, "one two three", None, "c", 0), (1001, "four", None, "d", 0)]
    sums = Counter()
    for r in mixing.Mix(frame(spark, rows)).taken().collect():
        sums[r.source_size, r.target] += r.taken
    assert len(sums) == 4 or len(sums) == 3
    total = defaultdict(float)
    for r in mixing.Mix(frame(spark, rows)).plan.collect():
        total[r.source_size, r.target] += round(r.target)
    assert sums == total


def test_any_stretch_of_the_schedule_is_mixed(spark):
    mix = mixing.Mix(frame(spark, [(i, "w " * 200, None, s, 0) for i, s in enumerate("aaaabbbbbbcc" * 8)]), block=16)
    order = [r.s for r in mix.schedule().orderBy("slot").collect()]
    share = {k: v / len(order) for k, v in Counter(order).items()}
    for a in range(0, len(order) - 200, 97):
        for s, n in Counter(order[a : a + 200]).items():
            assert abs(n - 200 * share[s]) <= 6
    ranks = defaultdict(list)
    for r in mix.schedule().orderBy("slot").collect():
        ranks[r.s].append(r["rank"])
    assert all(v == list(range(len(v))) for v in ranks.values())


def test_mix_of_odd_tables(spark):
    assert mixing.Mix(frame(spark, [])).taken().count() == 0
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    rows = [(1, None, None, "a", 0), (2, "", None, None, 0), (None, "x y z", None, "a", 5), (3, "one", None, "b", 3), (3, "one", None, "b", 3)]
    got = mixing.Mix(frame(spark, rows)).taken().collect()
    assert len(got) == 5 and all(r.taken <= 2 * r.size for r in got)
    blank = mixing.Mix(frame(spark, rows[:2])).taken().collect()
    assert [r.taken for r in blank] == [0, 0]


# chat

TURNS = "conv_id bigint, turn bigint, role string, text string"


def rotate_by_hand(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, (r[2] or "").strip() or "unknown", r[3] or "") for r in rows if r[0] == conv))
        for who in {m[2] for m in mine} - {"system"}:
            at, text, spans = 0, "", []
            for _, _, speaker, said in mine:
                head = "<|assistant|>\n" if speaker == who else "<|system|>\n" if speaker == "system" else f"<|user name={speaker}|>\n"
                if speaker == who:
                    spans.append((at + len(head), len(said) + len("<|end|>\n")))
                text += head + said + "<|end|>\n"
                at = len(text)
            out[conv, who] = (text, spans)
    return out


@pytest.mark.parametrize("block", [2, 256])
def test_rotation_against_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(chat_rotation, "BLOCK_TURNS", block)
    rows = [(1, i, r, f"turn {i} é💡") for i, r in enumerate(["system", "user", "assistant", "tool", "user", "assistant"])]
    rows += [(2, 0, "ann", "hi"), (2, 1, "bob", None), (2, 1, "ann", "tie"), (2, None, " ann ", "first"), (2, 7, None, "who"), (3, 0, "system", "alone"), (4, -3, "user", ""), (None, 0, "user", "no number")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, TURNS).withColumns({k: F.lit("clash") for k in ("speaker", "block", "length", "i0", "conv", "participant", "n", "start")})
    got = defaultdict(list)
    for r in chat_rotation.rotate(df).collect():
        got[r.conv_id, r.participant].append(r)
    want = rotate_by_hand([r for r in rows])
    assert set(got) == set(want)
    for key, (text, spans) in want.items():
        parts = sorted(got[key], key=lambda r: r.seq)
        assert [p.seq for p in parts] == list(range(len(parts)))
        assert "".join(p.rendered for p in parts) == text
        assert [(p.loss_start, p.loss_length) for p in parts if p.loss] == spans
        assert all(text[p.start : p.start + p.length] == p.rendered for p in parts)


def test_rotation_of_odd_tables(spark):
    assert chat_rotation.rotate(spark.createDataFrame([], TURNS)).count() == 0
    twice = chat_rotation.rotate(spark.createDataFrame([(1, 0, "a", "x"), (1, 0, "a", "x")], TURNS)).collect()
    assert sorted((r.seq, r.start, r.rendered) for r in twice) == [(i, 23 * i, "<|assistant|>\nx<|end|>\n") for i in (0, 1)]


# urls

PAGES = "page_id bigint, url string, html string"
RULES = [url_reputation.Rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.ORG/es/5?x#y", "a.example.org", "/es/5", "example.org/es/"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
        ("https://example.org/en/2#/en/1", "example.org", "/en/2", "org/"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
        ("http://example.org", "example.org", "", None),
        ("http://x.com/de/a", "x.com", "/de/a", "com/de/"),
        ("http://x.com?u=http://y.org/", "x.com", "", None),
        ("//x.org/", "", "", None),
        ("://x.org/a://b", "x.org", "/a://b", "org/"),
        ("http://É.com/fr/", "É.com", "/fr/", "com/fr/"),
        ("http://com/fr/a", "com", "/fr/a", "com/fr/"),
        ("", "", "", None),
        (None, "", "", None),
    ],
)
def test_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url, "")], PAGES)
    none = spark.createDataFrame([], "page_id bigint, bad int")
    r = url_reputation.filter_urls(pages, none, RULES).collect()[0]
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == next((x.verdict for x in RULES if x.rule == rule), "allow")


def test_reputation_shrinks_and_blocks(spark):
    rows, bad = [], []
    for i in range(400):
        host = ["bad.spam.net", "good.fine.net", f"h{i}.spam.net", f"h{i}.fine.net"][i % 4]
        rows.append((i, f"http://{host}/p/{i}", ""))
        bad.append((i, int("spam" in host and i % 13 != 0)))
    rows += [(1000, "http://new.spam.net/x", ""), (1001, "http://new.fine.net/x", ""), (1002, "http://unseen.dev/x", ""), (1003, None, None), (None, "http://new.spam.net/x", "")]
    got = {r.page_id: r for r in url_reputation.filter_urls(spark.createDataFrame(rows, PAGES), spark.createDataFrame([*bad, (5, None), (7777, 1)], "page_id bigint, bad int"), []).collect()}
    assert len(got) == len(rows)
    assert got[0].verdict == got[1000].verdict == got[None].verdict == "block"
    assert got[1].verdict == got[1001].verdict == got[1002].verdict == got[1003].verdict == "allow"
    assert got[1].bad_mean < got[1001].bad_mean < got[1002].bad_mean < got[1000].bad_mean


def test_urls_of_odd_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, bad int")
    assert url_reputation.filter_urls(spark.createDataFrame([], PAGES), none, RULES).count() == 0
    from pyspark.sql import functions as F

    twice = spark.createDataFrame([(1, "http://a.net/x", ""), (1, "http://a.net/x", "")], PAGES).withColumns({k: F.lit("clash") for k in ("host", "path", "rule", "n", "bad", "domain", "suffix", "low")})
    assert url_reputation.filter_urls(twice, none, RULES).count() == 2


def test_suffixes(spark):
    names = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.com", "com", "", "10.0.0.1", "[::1]", "a.b.x.ck", "x.ck", "a.www.ck", "www.ck", "ck"]
    hosts = spark.createDataFrame([(x,) for x in names], "name string")
    rules = spark.createDataFrame([("co.uk",), ("uk",), ("*.ck",), ("!www.ck",), (None,), ("co.uk",)], "rule string")
    got = {r.name: (r.suffix, r.domain) for r in url_reputation.with_domains(hosts, rules).collect()}
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"),
        "b.co.uk": ("co.uk", "b.co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "x.y.com": ("com", "y.com"),
        "com": ("com", "com"),
        "": ("", ""),
        "10.0.0.1": ("10.0.0.1", "10.0.0.1"),
        "[::1]": ("[::1]", "[::1]"),
        "a.b.x.ck": ("x.ck", "b.x.ck"),
        "x.ck": ("x.ck", "x.ck"),
        "a.www.ck": ("ck", "www.ck"),
        "www.ck": ("ck", "www.ck"),
        "ck": ("ck", "ck"),
    }
    assert got == want
    assert {r.name: r.suffix for r in url_reputation.with_domains(hosts).collect()}["a.b.co.uk"] == "co.uk"


def test_ports_and_users_share_their_hosts_reputation(spark):
    hosts = ["bad.net", "u:p@bad.net", "bad.net:8080", "bad.net.", "good.net", "good.net:1"]
    rows = [(i, f"http://{hosts[i % 6]}/{i}", "") for i in range(120)]
    outcomes = [(i, int("bad" in hosts[i % 6])) for i in range(0, 120, 2)]
    got = url_reputation.filter_urls(spark.createDataFrame(rows, PAGES), spark.createDataFrame(outcomes, "page_id bigint, bad int"), []).collect()
    assert {r.host for r in got} == set(hosts)
    means = defaultdict(set)
    for r in got:
        means["bad" in r.host].add(r.bad_mean)
        assert r.verdict == ("block" if "bad" in r.host else "allow")
    assert len(means[True]) == len(means[False]) == 1
