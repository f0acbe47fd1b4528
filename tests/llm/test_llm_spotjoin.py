"""SpotSigs join against likeness of all pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import spotjoin
from fieldtally.llm.spotsigs import signatures

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    out = []
    for group in range(12):
        base = [w for _ in range(rng.choice([6, 12, 40])) for w in ("the", rng.choice(words), rng.choice(words))]
        for copy in range(6):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append((group * 10 + copy, " ".join(text), "x"))
    out += [(500, None, "x"), (501, "", None), (502, "the end", "x"), (503, "the end", "x"), (None, out[0][1], "x"), (504, out[0][1] * 400, "x")]
    rng.shuffle(out)
    return out


def brute(sets, least):
    found = {}
    for (i, a), (j, b) in combinations(sorted(sets.items()), 2):
        near = len(a & b) / len(a | b)
        if a != b and near >= least - 1e-9:
            found[(i, j)] = near
    return found


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_matches_all_pairs(spark, rows, least):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    of_doc = {r.doc_id: frozenset(r.f) for r in df.where("doc_id IS NOT NULL").select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("f")).collect()}
    first = {}
    for i in sorted(of_doc):
        first.setdefault(of_doc[i], i)
    wanted = brute({i: s for s, i in first.items()}, least)
    sets, _ = spotjoin.signature_sets(df)
    got = {tuple(sorted((r.set_a, r.set_b))): r.near for r in spotjoin.near_pairs(sets, least).collect()}
    assert len(wanted) > 5 and got == pytest.approx(wanted)
    if least == 0.8:  # pruning leaves few pairs that are not alike
        assert spotjoin.candidate_pairs(sets, least).count() < len(first) * (len(first) - 1) / 2 / 10

    root = {i: i for i in of_doc}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in [*wanted, *((d, first[s]) for d, s in of_doc.items())]:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    classes = {r.doc_id: r for r in spotjoin.near_classes(df, least).collect()}
    assert {i: r.class_id for i, r in classes.items()} == {i: top(i) for i in of_doc}
    assert {i: r.set_id for i, r in classes.items()} == {i: first[s] for i, s in of_doc.items()}
    assert all(r.n_links == sum(r.set_id in p for p in wanted) for r in classes.values())


def test_small_and_odd_tables(spark, rows):
    assert spotjoin.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = [(1, "the big dog ran", "x"), (1, "the big dog ran", "x"), (1, "the red cat sat", "x"), (2, "the red cat sat", "x")]
    got = {r.doc_id: (r.set_id, r.class_id, r.n_links) for r in spotjoin.near_classes(spark.createDataFrame(twice, SCHEMA)).collect()}
    assert got == {1: (1, 1, 0), 2: (1, 1, 0)}
    with pytest.raises(ValueError, match="least"):
        spotjoin.near_classes(spark.createDataFrame(twice, SCHEMA), 1.0)


def test_no_python_in_the_plan(spark, rows):
    sets, _ = spotjoin.signature_sets(spark.createDataFrame(rows, SCHEMA))
    text = spotjoin.near_pairs(sets)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
