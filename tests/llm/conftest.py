import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use for columns of their own
CLASHING = ["key", "keys", "hash", "fp", "score", "lang_pred", "epoch", "_bucket", "next", "shard", "n", "u", "v", "root", "__id", "label", "n_tokens"]


def with_clashes(df):
    for name in CLASHING:
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="session")
def clashing():
    return with_clashes


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source) as a documents table with clashing extra columns."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
        return with_clashes(spark.createDataFrame(full, SCHEMA))

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, shared passages and copies."""
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    sentence = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, base = sentence(70), sentence(120)
    rows = [(None, passage, None, None), (1, None, "en", "src0"), (2, "", None, "src1"), (3, " \t\n", "en", None), (4, "12 34 !!", "en", "src0")]
    for k in range(5, 40):
        rows.append((k, sentence(30) + "\n" + (passage + " " if k % 4 == 0 else "") + sentence(40), ["en", "fr", None][k % 3], f"src{k % 3}"))
    rows += [(40, base, "en", "src0"), (41, base, "en", "src0"), (42, base + " tail", "en", "src0"), (42, base + " tail", "en", "src0")]
    rows += [(43, sentence(6000), "fr", "src2"), (44, passage, "en", "src1"), (45, "één café  Über x", "fr", "src1"), (46, "a " * 40, "en", "src1")]
    return rows
