import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import bitslices, mixing, packing, spotsigs
import public_tokenizers

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_packing_is_an_exact_round_trip(documents, odd_rows):
    from tokenizers import Tokenizer

    rows = odd_rows + [(50, "MIXED Case's l33t <|endoftext|> İx ΣΣ naïve…  'tis", "en", "src0")]
    got = packing.pack(documents(rows), VOCABULARY, capacity=256, shard_pieces=64).collect()
    tokenizer, want = Tokenizer.from_file(VOCABULARY), []
    import zlib

    for d, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for begin in range(0, len(ids), 256):
            part = np.array(ids[begin : begin + 256], "<u4").tobytes()
            want.append((d, begin // 256, begin, len(part) // 4, zlib.crc32(part)))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        level = 0
        for offset, length in sorted(places):
            assert offset == level
            level += length
        assert level <= 256


def test_packing_comes_near_the_bound():
    draw = np.random.default_rng(4)
    lengths = np.minimum(4096, draw.lognormal(6.5, 1, 6000).astype(np.int64) + 1)
    bins, offsets = packing.pack_lengths(lengths)
    assert np.bincount(bins, lengths).max() <= 4096
    assert bins.max() + 1 <= 1.01 * lengths.sum() / 4096 + 1
    assert packing.pack_lengths(np.zeros(0, np.int64))[0].size == 0
    assert packing.pack_lengths(np.array([4096, 4096, 1, 1]))[0].max() == 2


def test_linear_grouping_rounds_up_in_equal_groups():
    assert packing.group_sizes(np.array([9, 8, 7, 6, 5]), 2).tolist() == [9, 9, 9, 6, 6]


def rows_of(found, connection, sql):
    return sorted((tuple(r) for r in found.collect()), key=str), sorted(connection.sql(sql).fetchall(), key=str)


@pytest.mark.parametrize("share, epochs", [(1.0, 2), (0.3, 1), (2.5, 3), (0.0, 2)])
def test_mixing_equals_sql(documents, odd_rows, share, epochs):
    target = mixing.Target(mixing.PRODUCTION.domain_of, mixing.PRODUCTION.weights, share=share, epochs=epochs)
    docs = documents(odd_rows)
    connection = duckdb.connect()
    connection.register("arrow_docs", docs.select("doc_id", "text", "lang", "source").toArrow())
    connection.execute("CREATE TABLE documents AS SELECT * FROM arrow_docs")
    got, want = rows_of(mixing.mix(docs, target), connection, mixing.mix_sql(target))
    assert got == want


def test_mixing_gives_shortages_to_siblings_first(spark):
    """One short source: its share goes to the other source of its language, not to the other language."""
    rows = [("web", "en", "a", 10)] * 1 + [("web", "en", "b", 10)] * 100 + [("web", "fr", "c", 10)] * 100
    held = spark.createDataFrame(rows, "domain string, lang string, source string, n_tokens long")
    target = mixing.Target({}, {"lang": {"en": 1, "fr": 1}, "source": {"a": 1, "b": 1, "c": 1}}, share=0.4, epochs=1)
    budgets = {r.source: r.budget for r in mixing.leaf_budgets(held, target).collect()}
    assert budgets == {"a": 10, "b": 392, "c": 402}


def test_mixing_of_nothing(documents):
    assert mixing.mix(documents([]), mixing.PRODUCTION).count() == 0
    assert mixing.mix(documents([(1, None, None, None), (2, "", "en", "src0")]), mixing.PRODUCTION).count() == 0


def test_mixing_buckets_keep_the_order(documents, monkeypatch):
    docs = documents([(k, "w " * (k % 5 + 1), "en", "src0") for k in range(200)])
    target = mixing.Target({}, {}, share=0.5, epochs=1)
    whole = sorted(tuple(r) for r in mixing.mix(docs, target).collect())
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    assert sorted(tuple(r) for r in mixing.mix(docs, target).collect()) == whole


def test_top_k_equals_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(2)
    vectors = [(int(k), [float(x) for x in draw.normal(0, 0.2, 12).astype(np.float32)]) for k in range(400)]
    vectors += [(k, vectors[50][1]) for k in range(400, 480)]  # ties beyond any k
    vectors += [(480, None), (481, [None] * 12), (482, [float("nan")] * 12), (483, [float("inf")] * 12), (None, vectors[3][1]), (484, []), (485, [0.5, 0.25])]
    vectors += [(50, vectors[50][1]), (50, vectors[7][1]), (101, vectors[50][1])] + [(100, vectors[100][1])] * 30  # repeated ids
    frame = spark.createDataFrame([(k, v, 1, 2) for k, v in vectors], "vec_id long, embedding array<float>, v int, asked int")
    got = [tuple(r) for r in bitslices.top_k(frame, queries=F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    usable = [(k, np.floor(256 * np.array(v, float)).astype(int)) for k, v in vectors if k is not None and v and len(v) == 12 and None not in v and np.isfinite(v).all()]
    want = []
    for q in sorted({k for k, _ in usable if k % 50 == 0}):
        best = sorted((-int(mine @ v), k) for own, mine in usable if own == q for k, v in usable if k != q)[:5]
        want += [(q, place + 1, k, -s) for place, (s, k) in enumerate(best)]
    assert got == want
    # many groups of several blocks, several parts of queries
    for name, value in (("BLOCK_ROWS", 16), ("SMALL_BLOCK_ROWS", 16), ("GROUP_BLOCKS", 3), ("SPREAD_GROUPS", 5), ("QUERY_ROWS", 4)):
        monkeypatch.setattr(bitslices, name, value)
    parted = bitslices.top_k(frame, queries=F.col("vec_id") % 50 == 0).orderBy("query_id", "rank")
    assert [tuple(r) for r in parted.collect()] == want


def test_stored_block_reads_back():
    draw = np.random.default_rng(3)
    for top in (90, 40_000):
        block = bitslices.Block(draw.permutation(100), draw.integers(-top, top, (100, 7)))
        again = bitslices.Block.read({**block.stored(), "width": 7})
        assert (again.vectors == block.vectors).all() and again.vectors.itemsize == (2 if top == 90 else 4)
        for query in draw.integers(-top, top, (5, 7)):
            for one, two in zip(block.top(query, 5, 8), again.top(query, 5, 8)):
                assert (one == two).all()


@pytest.mark.parametrize("coarse", [0, 1, 3, 6])
def test_score_slices_add_up(coarse):
    draw = np.random.default_rng(coarse)
    block = bitslices.Block(np.arange(100), draw.integers(-90, 90, (100, 7)), coarse)
    for query in draw.integers(-90, 90, (20, 7)):
        ids, scores = block.top(query, 5, 8)
        exact = block.vectors.astype(np.int64) @ query
        want = sorted((-int(s), int(i)) for i, s in zip(block.ids, exact) if i != 5)[:8]
        assert [(-int(s), int(i)) for i, s in zip(ids, scores)] == want
    assert bitslices.signed_digits(7) == [(0, -1), (3, 1)]


def test_top_k_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in bitslices.top_k(few, queries=F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert bitslices.top_k(few.limit(0), queries=F.col("vec_id") == 0).count() == 0


def python_signatures(text):
    words, found = re.split(r"[\W_]+", text.lower()), set()
    for i, word in enumerate(words):
        if word in spotsigs.ANCHORS:
            chain = [w for w in words[i + 1 :] if w and w not in spotsigs.ANCHORS][:2]
            if len(chain) == 2:
                found.add((word, *chain))
    return found or {text}


def test_spotsigs_equal_plain_python(documents):
    rows = [(k, f"the {w} of a quick {w}{k % 3} fox and it was THE end{k}, den Hund der Katze", None, None) for k, w in enumerate("red blue blue green".split())]
    rows += [(10, None, None, None), (11, "", None, None), (12, "x", None, None), (13, "🙂the \x01 café of straße and naïve", None, None), (13, "🙂the \x01 café of straße and naïve", None, None), (None, "no id here the one two", None, None)]
    got = {(r.doc_id, r.text): r for r in spotsigs.edited_pairs(documents(rows)).collect()}
    full = {(r.doc_id): r for r in spotsigs.fingerprint_documents(documents(rows)).collect()}
    ordered = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (d, t) in enumerate(ordered):
        after, half = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (d, t) in got
        if d != 13:
            assert got[(d, t)].edited == edited
        assert len(got[(d, t)].found) == len(python_signatures(t))
        if d != 13:
            a, b = python_signatures(t), python_signatures(edited)
            assert full[d].near_edited == pytest.approx(len(a & b) / len(a | b))
            assert full[d].n_chars == len(t)
    assert full[11].fingerprint == full[10].fingerprint


def test_spotsigs_many_buckets(documents, monkeypatch):
    docs = documents([(7 * k % 101, f"text {k} the one two", None, None) for k in range(101)])
    one = {tuple(r) for r in spotsigs.fingerprint_documents(docs).collect()}
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 4)
    assert {tuple(r) for r in spotsigs.fingerprint_documents(docs).collect()} == one


def test_spotsigs_plan_is_native(documents, odd_rows):
    docs = documents(odd_rows)
    plan = spotsigs.fingerprint_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert spotsigs.fingerprint_documents(documents([])).count() == 0


def test_likeness_prunes_by_length(spark):
    sets = spark.createDataFrame([([1, 2, 3, 4], [1]), ([1, 2, 3, 4], [1, 2, 3, 9])], "a array<long>, b array<long>")
    pruned = sets.select(spotsigs.likeness(F.col("a"), F.col("b"), 0.5).alias("x"), spotsigs.likeness(F.col("a"), F.col("b")).alias("y")).collect()
    assert [tuple(r) for r in pruned] == [(0.0, 0.25), (0.6, 0.6)]


def test_ids_do_not_depend_on_the_word_cache(monkeypatch):
    from tokenizers import Tokenizer

    texts = ["Plain words, plain 42 words", "ÉTÉ été <|x|> don't", "", "a" * 90 + " " + "zq" * 200, "Plain words again here"]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for most in (1, 600_000):
        monkeypatch.setattr(packing, "CACHED_WORDS", most)
        ids_of = packing.WordIds(VOCABULARY)
        assert [ids_of(t.encode()) for t in texts + texts] == want + want
