"""Many fixed patterns over many texts in one pass, by an automaton in each task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_patterns(texts: DataFrame, patterns: Sequence[str], key: str = "id", text: str = "text") -> DataFrame:
    """key, pattern, at (from 0, in characters) of every occurrence, overlapping ones too.
    patterns: a fixed list, sent to each task; an empty pattern occurs nowhere."""
    patterns = sorted({p for p in patterns if p})
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p, p)
        if patterns:
            automaton.make_automaton()
        for batch in batches:
            keys, found, at = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for end, p in automaton.iter(t.as_py() or "") if patterns else ():
                    keys.append(k)
                    found.append(p)
                    at.append(end - len(p) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(found, pa.string()), pa.array(at, pa.int32())], names=[key, "pattern", "at"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, pattern string, at int")


def contains_any(texts: DataFrame, patterns: Sequence[str], text: str = "text") -> DataFrame:
    """Rows whose text has any of the patterns: one regular expression, in the JVM."""
    escaped = "|".join(_quoted(p) for p in sorted(set(patterns)) if p)
    return texts.where(F.col(text).rlike(escaped)) if escaped else texts.where(F.lit(False))


def _quoted(p: str) -> str:
    return r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E"
