import re
from collections import Counter

import corpus_pipeline
import numpy as np
from weftgraph.llm import common, queries, tokens

from .corpus import corpus, frame, with_clashes
from .test_dedup import classes_by_force, near_by_force, odd_ids


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus(150)
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    kept = stages["language_id"](spark, docs, str(tmp_path)).collect()
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert {r.doc_id for r in kept} == {r[0] for r in lettered}

    kept = stages["exact_dedup"](spark, frame(spark, [tuple(r) for r in kept]), str(tmp_path)).collect()
    first = {}
    for r in sorted(lettered):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    assert {tuple(r) for r in kept} == set(first.values())

    kept = stages["near_dedup"](spark, frame(spark, [tuple(r) for r in kept]), str(tmp_path)).collect()
    want = {x[0] for x in near_by_force(list(first.values()), corpus_pipeline.NEAR_PERCENT) if x[3]}
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)

    mixed = stages["mixing"](spark, frame(spark, [tuple(r) for r in kept]), str(tmp_path)).collect()
    size = {r.doc_id: len(r.text.split()) for r in kept}
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(taken[d] <= 2 * size[d] for d in taken)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())

    pieces = stages["packing"](spark, frame(spark, [tuple(r) for r in mixed]), str(tmp_path)).collect()
    bpe = tokens.ByteBpe(tokens.default_vocabulary())
    want_ids = Counter()
    for r in mixed:
        want_ids[r.doc_id] += len(bpe.encode(r.text)) + 1
    got_ids = Counter()
    for p in pieces:
        got_ids[p.doc_id] += len(np.frombuffer(p.ids, "<u4"))
    assert got_ids == want_ids


def test_run_and_columns(spark, tmp_path):
    docs = with_clashes(frame(spark))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name


def test_run_with_null_and_shared_doc_ids_and_no_labels(spark, tmp_path):
    rows = [(*r[:2], None, *r[3:]) for r in odd_ids(corpus(60, 4))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = corpus_pipeline.STAGES
    for _, stage in stages[:3]:
        docs = frame(spark, [tuple(r) for r in stage(spark, docs, str(tmp_path)).collect()])
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert docs.count() == len(classes_by_force(lettered, 80))
    size = sum(len(r.text.split()) for r in docs.collect())
    mixed = stages[3][1](spark, docs, str(tmp_path)).collect()
    assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * size) <= 4 + 0.001 * size
    bpe = tokens.ByteBpe(tokens.default_vocabulary())
    want = Counter()
    for r in mixed:
        want[r.doc_id] += len(bpe.encode(r.text)) + 1
    got = Counter()
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id] += p.length
    assert got == want


def test_run_leaves_one_table_behind(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(common._PATHS)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(set(common._PATHS) - before) == 1


def test_run_on_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_near_dedup_stage_takes_copies_from_80_percent(spark, tmp_path):
    rows = corpus(150)
    first = {}
    for r in sorted(r for r in rows if r[1] and any(c.isalpha() for c in r[1])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    want = {x[0] for x in near_by_force(list(first.values()), 80) if x[3]}
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame(spark, list(first.values())), str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == want and len(kept) == len(want)
