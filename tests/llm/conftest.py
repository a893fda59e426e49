"""Tables with everything that may go wrong, shared by the tests of the corpus operators."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ("size", "target", "taken", "score", "at", "lines", "fingerprint", "component_id", "shard", "group_no",
            "n_lines", "n_dropped", "draw", "node", "canonical", "host", "rule", "id", "place", "whole", "batch",
            "__a", "__b", "__ra", "__rb", "__ka", "__kb", "__at", "__n", "__all", "__copy", "__decision")
WORDS = {
    "en": "the and of with there where thing tion house river walk under over light".split(),
    "de": "der die und nicht straße über grün schön weg haus fluss licht unter gehen".split(),
    "fr": "le la et été où très maison rivière lumière marcher sous élève garçon".split(),
}


def prose(rng, lang, n):
    words = [rng.choice(WORDS[lang]) + (rng.choice(WORDS[lang]) if rng.random() < 0.5 else "") for _ in range(n)]
    lines = [" ".join(words[i:i + 12]) for i in range(0, n, 12)]
    return "\n".join(lines)


@pytest.fixture(scope="session")
def corpus_rows():
    """Prose in three languages with copies, near copies, repeated lines and awkward rows."""
    rng = random.Random(7)
    shared = [f"This Line is shared by very many documents, number {i}, all of them" for i in range(4)]
    rows = []
    for i in range(150):
        lang = rng.choice(list(WORDS))
        text = prose(rng, lang, rng.choice([3, 20, 60, 200]))
        for line in shared:
            if rng.random() < 0.3:
                text += "\n" + rng.choice(["", "  ", "\t"]) + rng.choice([line, line.upper()]) + " "
        rows.append((i, text, lang if rng.random() < 0.9 else None, f"s{min(i % 7, 3)}" if i % 11 else None, len(text)))
    texts = [r[1] for r in rows]
    rows += [(200 + i, texts[3], "en", "s1", 1) for i in range(30)]
    rows += [(300, None, None, None, None), (301, "", "en", "s2", 0), (302, " \n\t\n ", None, "s2", 5),
             (303, "1234 5678 !!", "en", None, 12), (304, texts[5] + "\n" + texts[5], "de", "s0", None),
             (305, "ünï " * 30000, "de", "s3", 120000), (306, "x" * 200000, None, "s3", 200000),
             (None, texts[6], "fr", "s0", 3), (None, None, None, None, None),
             (307, "a\n\n\nb\n", "en", "s1", 7), (308, "\u00a0\u2003 \x1c", None, "s1", 4), (309, "𝒳 日本語 テキスト", None, "s1", 9)]
    rows += [rows[2], rows[2], (400, texts[2], "en", "s0", 1)]
    return rows


@pytest.fixture
def corpus(spark, corpus_rows):
    return spark.createDataFrame(corpus_rows, SCHEMA).repartition(5)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing():
    from pyspark.sql import functions as F

    def add(df):
        return df.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHING) if name not in df.columns])

    return add
