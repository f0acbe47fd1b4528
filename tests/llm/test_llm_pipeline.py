"""Every stage against brute force on its own input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldtally.llm import mixing, simhash
from fieldtally.operators.lineage import cut


@pytest.fixture(scope="module")
def corpus(spark, documents):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for k in range(120):
        text = " ".join(word() for _ in range(rng.randint(20, 80)))
        rows.append((k, text + (" " + passage if k % 10 == 0 else ""), "en" if k % 3 else "fr", f"src{k % 22}"))
    rows += [(200, rows[5][1], "en", "src1"), (201, rows[5][1], "en", "src0"), (202, None, None, None), (203, "", "en", "src2"), (204, "?? 77", None, "src2")]
    rows += [(205, passage, "en", "src3"), (206, rows[7][1], None, None), (206, rows[7][1], None, None), (None, rows[9][1] + " x", "en", "src4"), (207, "word " * 9000, "en", "src5")]
    return documents(rows)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force(spark, corpus):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    stages, docs = dict(corpus_pipeline.STAGES), corpus

    kept = cut(stages["language_id"](spark, docs, ""))
    assert kept.columns == docs.columns
    assert rows_of(kept) == rows_of(docs.where("doc_id is null or doc_id not in (202, 203, 204)"))

    docs, kept = kept, cut(stages["simhash_dedup"](spark, kept, ""))
    assert kept.columns == docs.columns
    rows = docs.select("doc_id", "text").collect()
    prints = [simhash.fingerprint(r.text.encode()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for r, g in zip(rows, group):
        if r.doc_id is not None:
            least[g] = min(least.get(g, r.doc_id), r.doc_id)
    want = sorted({*least.values()})
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == want
    assert kept.where("doc_id is null").count() == 1 and 200 not in want and 206 not in want

    docs, kept = kept, cut(stages["substring_dedup"](spark, kept, ""))
    assert kept.columns == docs.columns
    before = {r.doc_id: r.text.split() for r in docs.collect()}
    after = {r.doc_id: r for r in kept.collect()}
    first = {}
    last = lambda d: (d is None, d or 0)  # noqa: E731  a row without doc_id comes after all others
    for d in sorted(before, key=last):
        for i in range(len(before[d]) - 12):
            first.setdefault(tuple(before[d][i : i + 13]), d)
    for d, words in before.items():
        gone = set()
        for i in range(len(words) - 12):
            if last(first[tuple(words[i : i + 13])]) < last(d):
                gone.update(range(i, i + 13))
        left = [w for i, w in enumerate(words) if i not in gone]
        assert (d not in after) == (not left)
        if left:
            assert after[d].text.split() == left and after[d].n_chars == len(after[d].text)

    docs, kept = kept, cut(stages["source_mixing"](spark, kept, ""))
    assert kept.columns == docs.columns
    chosen = {(r.doc_id, r.epoch) for r in mixing.mix(docs, mixing.PRODUCTION).collect()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in chosen)

    packed = stages["best_fit_packing"](spark, kept, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in kept.collect())
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096


def test_rows_without_doc_id_are_copies_too(spark, documents):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(n))
    same, other, passage = text(80), text(80), text(30)
    rows = [(None, same, "en", "src0")] * 5 + [(7, same, "en", "src1")] + [(None, other, "en", "src2")] * 3
    rows += [(9, passage + " " + text(40), "en", "src0"), (None, text(40) + " " + passage, "en", "src0")]
    docs, stages = documents(rows), dict(corpus_pipeline.STAGES)
    kept = cut(stages["simhash_dedup"](spark, docs, ""))
    assert Counter((r.doc_id, r.text) for r in kept.collect() if r.text in (same, other)) == {(7, same): 1, (None, other): 1}
    shorter = stages["substring_dedup"](spark, kept, "").collect()
    assert sum(passage in r.text for r in shorter) == 1 and len(shorter) == 4
    assert next(r.doc_id for r in shorter if passage in r.text) == 9


def test_run_on_an_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_registered_queries_read_whole_tables(spark, sf_dir):
    from fieldtally.llm import registry

    assert [name.split("_")[0] for name in registry.QUERIES] == [*(f"op{n}" for n in range(1, 14)), "pipeline"]
    assert set(registry.ORACLES) <= set(registry.QUERIES)
