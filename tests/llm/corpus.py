"""Small corpora with everything that operators must bear."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = {
    "en": "the and of that thing with house river light from every other stone".split(),
    "fr": "le la des été leçon être forêt lumière maison rivière où déjà pierre".split(),
    "de": "der die das über straße licht mädchen fluß haus jeder andere größe stein".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def corpus(n: int = 120, seed: int = 3) -> list[tuple]:
    """Texts with exact copies, near copies, shared passages, nulls, blanks, ties and
    one long text."""
    rng = random.Random(seed)
    rows = []
    passage = sentence(rng, "en", 30)
    for i in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(sentence(rng, lang, rng.randint(3, 14)) for _ in range(rng.randint(1, 12)))
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1] or ""
        elif rows and kind < 0.4:
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(["novel", "Zebra", "édité"])
            text = (" " if rng.random() < 0.5 else "  ").join(words)
        elif kind < 0.5:
            text += "\n" + passage + " " + sentence(rng, lang, 5)
        rows.append((i * 3, text, lang, rng.choice(["a", "b", "c", None]), len(text)))
    extra = [None, "", "   \t\n", "one two", "One  TWO", "123 456 ...", "💡💡 émoji <|endoftext|> x", " ".join(sentence(rng, "en", 9) for _ in range(700))]
    rows += [(10_000 + i, t, None if i % 2 else "en", "z" if i % 3 else None, len(t or "")) for i, t in enumerate(extra)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCS)


def with_clashes(df):
    """The same documents with extra columns that operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("key", "node", "bucket", "size", "target", "id", "h", "cell", "digest", "keep_id", "kept", "range", "block", "at", "n", "taken", "start", "length")
    return df.select("*", *[F.lit("clash").alias(n) for n in names])
