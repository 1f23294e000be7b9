"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum over presence: the number of
byte n-grams of 1 to 3 bytes (A-Z in lower case) that occur in both, divided by
the geometric mean of the numbers in each. It is restricted to the n-grams of
the landmarks, which makes it the inner product of two 0/1 vectors of a known
size, scaled to length 1.

Landmarks are a stratified part of the training texts. With K the kernel among
landmarks, Nyström features of a text are its kernels with the landmarks times
K^(-1/2), and one ridge regression per language (target 1 for its texts, -1 for
others) is fitted on them. A block of texts is scored as one product of its
presence matrix with [landmarks' vectors x K^(-1/2) x weights]: the products are
associated from the right, once, as the kernel is linear in presence.

Training uses a bounded sample: of the languages with the most texts, at most
LANGUAGES of them, at most train_per_language distinct texts each, those with the
smallest hash of doc_id, first of at most train_chars characters; of longer ones so
many characters from the first letter on are used. Every text is scored whole.

A text's score is (the largest of the regressions' values + 1) / 2, within 0 and 1.
Its familiarity is the share of its n-grams, each as often as it occurs, that any
landmark has. A text of a language that was not learned, in another script, has little
of it: its kernels are next to nothing, and what the regressions say of it is the
intercept's. keep_identified rejects such texts, and those without a letter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, small_batches, text_bytes

#: Bounds of the training sample and of the model.
LANGUAGES, TRAIN_PER_LANGUAGE, TRAIN_CHARS, LANDMARKS_PER_LANGUAGE = 200, 240, 20_000, 32

#: Parts of a language's texts that are ranked one by one.
LANGUAGE_PARTS = 16

RIDGE = 1e-2

#: Bytes of text, and places of a presence matrix, scored at once.
SCORED_BYTES, SCORED_PLACES = 1 << 19, 1 << 25

#: Familiarity below which the language of a text can't be told.
FAMILIAR = 0.25

UNDETERMINED = "und"

_LOWER = np.arange(256, dtype=np.int32)
_LOWER[65:91] += 32


@dataclass
class SpectrumModel:
    languages: list[str]
    rank: np.ndarray  # of each byte among the landmarks' bytes, 0 for others
    column: tuple[np.ndarray, np.ndarray, np.ndarray]  # of each 1-, 2- and 3-gram of ranks, -1 for none
    width: int
    weights: np.ndarray  # width x languages
    intercept: np.ndarray

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows x width, 1.0 where the n-gram occurs; and the rows' familiarity."""
        rows = len(offsets) - 1
        out = np.zeros((rows, self.width + 1), dtype=np.float32)  # the last column takes what is no n-gram of the landmarks
        known = np.zeros(rows)
        if not len(data):
            return out[:, :-1], known
        flat = out.reshape(-1)
        base = np.repeat(np.arange(rows, dtype=np.int64) * (self.width + 1), np.diff(offsets))
        r = self.rank[data]
        code, size = r.astype(np.int32), int(self.rank.max()) + 1
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes up to the row's end
        for n, column in enumerate(self.column, 1):
            if n > 1:
                code = code[:-1] * size + r[n - 1 :]
            keep = left[: len(code)] >= n
            at = column[code]
            flat[base[: len(code)][keep] + at[keep]] = 1.0
            upto = np.concatenate([[0], np.cumsum(keep & (at >= 0))])
            ends = np.minimum(offsets, len(code))
            known += upto[ends[1:]] - upto[ends[:-1]]
        sizes = np.diff(offsets)
        total = sum(np.maximum(sizes - n, 0) for n in range(len(self.column)))
        return out[:, :-1], known / np.maximum(total, 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows x languages, the regressions' values; and the rows' familiarity."""
        x, known = self.presence(data, offsets)
        norm = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float64), 1.0))
        return (x @ self.weights) / norm[:, None] + self.intercept, known


def fit(texts: list[str], languages: list[str], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> SpectrumModel:
    """texts: in a fixed order, which decides on the landmarks."""
    known = sorted(set(languages))
    lab = np.array([known.index(x) for x in languages])
    marks = np.concatenate([np.flatnonzero(lab == k)[:landmarks_per_language] for k in range(len(known))])
    raw = [t.encode() for t in texts]

    def laid(index: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
        part = [raw[i] for i in index]
        return np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64)

    data, offsets = laid(marks)
    used = np.unique(_LOWER[data])
    rank = np.zeros(256, np.int32)
    rank[used] = np.arange(1, len(used) + 1)
    rank = rank[_LOWER]
    size, width, columns = int(rank.max(initial=0)) + 1, 0, []
    r = rank[data].astype(np.int64)
    code, left = r, np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    for n in (1, 2, 3):
        if n > 1:
            code = code[:-1] * size + r[n - 1 :]
        seen = np.unique(code[left[: len(code)] >= n])
        column = np.full(size**n, -1, np.int32)
        column[seen] = np.arange(width, width + len(seen))
        width += len(seen)
        columns.append(column)
    model = SpectrumModel(known, rank, tuple(columns), width, np.zeros((width, len(known)), np.float32), np.zeros(len(known)))

    def vectors(index: np.ndarray) -> np.ndarray:
        x = model.presence(*laid(index))[0].astype(np.float64)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1.0))

    z = vectors(marks)
    value, vector = np.linalg.eigh(z @ z.T)
    good = value > max(value.max(initial=0.0), 1e-12) * 1e-9
    half = (vector[:, good] / np.sqrt(value[good])) @ vector[:, good].T  # K^(-1/2)
    features = np.concatenate([vectors(np.array(part)) @ z.T @ half for part in np.array_split(np.arange(len(raw)), max(1, len(raw) // 64))])
    target = np.where(lab[:, None] == np.arange(len(known)), 1.0, -1.0)
    mean_x, mean_y = features.mean(axis=0), target.mean(axis=0)
    centred = features - mean_x
    w = np.linalg.solve(centred.T @ centred + ridge * np.eye(features.shape[1]), centred.T @ (target - mean_y))
    model.weights = (z.T @ (half @ w)).astype(np.float32)
    model.intercept = mean_y - mean_x @ w
    return model


def train(labelled: DataFrame, train_per_language: int = TRAIN_PER_LANGUAGE, train_chars: int = TRAIN_CHARS, languages: int = LANGUAGES) -> SpectrumModel | None:
    """From doc_id, text and lang; None without a labelled text that has a letter. What
    comes to the driver is bounded by the parameters: equal texts of a language count
    once."""
    use = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text", F.xxhash64("text").alias("_t"))
    texts = use.groupBy("lang", "_t").agg(F.min("doc_id").alias("id"), F.min(F.length("text") > train_chars).alias("long"))
    most = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    # of each part of a language first, so that no task ranks more than the parts' best
    order = ("long", F.xxhash64("id"), "id", "_t")
    ranked = texts.join(F.broadcast(most), "lang").withColumn("part", F.pmod("_t", F.lit(LANGUAGE_PARTS)))
    for by in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= train_per_language)
    part = F.when(F.length("text") <= train_chars, F.col("text")).otherwise(F.substring(F.regexp_extract("text", r"(?s)\p{L}.*", 0), 1, train_chars))
    chosen = use.join(F.broadcast(ranked.select("lang", "_t", "r")), ["lang", "_t"]).select("lang", "r", part.alias("text")).dropDuplicates(["lang", "r"])
    rows = sorted((x.r, x.lang, x.text) for x in chosen.collect())  # languages * train_per_language texts at most
    return fit([x[2] for x in rows], [x[1] for x in rows]) if rows else None


def _scorer(model: SpectrumModel):
    """Column text first; adds the best language, its score and the familiarity before the
    other columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, dtype=object)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            best, score, known = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
            for a, b in _bounded(offsets, max(1, SCORED_PLACES // (model.width + 1))):
                s, known[a:b] = model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                best[a:b], score[a:b] = s.argmax(axis=1), np.clip((s.max(axis=1) + 1) / 2, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([pa.array(names[best], pa.string()), pa.array(score), pa.array(known), *batch.columns[1:]], names=["_lang_pred", "_score", "_known", *batch.schema.names[1:]])

    return run


def _bounded(offsets: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Row ranges of so many bytes and rows at most, or of one row."""
    for a, b in blocks(offsets, SCORED_BYTES):
        yield from ((i, min(b, i + rows)) for i in range(a, b, rows))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def score_rows(docs: DataFrame, model: SpectrumModel | None, kept: list[str]) -> DataFrame:
    """The kept columns of every row, and _lang_pred, _score and _known (the familiarity):
    und and 0.0 where the text is null or has no letter, or nothing was learned."""
    unknown = (F.lit(UNDETERMINED).alias("_lang_pred"), F.lit(0.0).alias("_score"), F.lit(0.0).alias("_known"))
    if model is None:
        return docs.select(*unknown, *kept)
    small_batches(docs.sparkSession)
    marked = docs.select(F.col("text").alias("_text"), has_letter(F.col("text")).alias("_lettered"), *kept)
    schema = T.StructType([T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType()), T.StructField("_known", T.DoubleType()), *marked.schema.fields[1:]])
    found = marked.mapInArrow(_scorer(model), schema)
    lettered = F.col("_lettered")
    names = ("_lang_pred", "_score", "_known")
    return found.select(*[F.when(lettered, F.col(c)).otherwise(u).alias(c) for c, u in zip(names, unknown, strict=True)], *kept)


def predict(docs: DataFrame, model: SpectrumModel | None) -> DataFrame:
    """doc_id, lang_pred and score for every row. Other columns don't matter."""
    return score_rows(docs, model, ["doc_id"]).select("doc_id", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from the rows with a lang that
    aren't held out. A null doc_id is not held out. Repeated rows are scored alike;
    an empty table gives an empty result."""
    return predict(docs, train(docs.where(~held_out(F.col("doc_id"))), **bounds)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, familiar: float = FAMILIAR, **bounds: int) -> DataFrame:
    """docs without the rows whose language can't be told: those without a letter, and
    those of less familiarity. Columns unchanged. Rows are scored where they are
    read, and none is shuffled. Where nothing was learned, those with a letter stay."""
    model = train(docs.where(~held_out(F.col("doc_id"))), **bounds)
    if model is None:
        return docs.where(has_letter(F.col("text")))
    told = (F.col("_lang_pred") != UNDETERMINED) & (F.col("_known") >= familiar)
    return score_rows(docs, model, docs.columns).where(told).select(*docs.columns)
