import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from fieldtally.llm import phrases, simhash, suffixes
from fieldtally.llm.components import smallest_reachable


def brute_cover(rows, window):
    """Words of each row (by position) in a window that also starts under a smaller doc_id."""
    first, out = {}, []
    split = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in split:
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, w, gone))
    return out


def test_phrases_equal_brute_force_on_odd_rows(documents, odd_rows):
    got = sorted(
        ((r.doc_id is None, r.doc_id, r.n_words, r.n_removed, hashlib.sha256(b" ".join(r.kept_text.encode().split())).hexdigest())
         for r in phrases.dedupe_passages(documents(odd_rows)).collect()), key=str
    )
    want = sorted(
        ((d is None, d, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest())
         for d, w, g in brute_cover(odd_rows, 13)), key=str
    )
    assert got == want
    assert sum(w[3] for w in want) > 400


def test_phrases_keep_untouched_texts_as_they_are(documents, odd_rows):
    texts = {r.doc_id: r.kept_text for r in phrases.dedupe_passages(documents(odd_rows)).where("n_removed = 0").collect()}
    assert texts[45] == "één café  Über x" and texts[3] == " \t\n" and texts[1] == ""


def test_automaton_takes_the_smallest_holder():
    words = [b"w%d" % k for k in range(20)]
    automaton = phrases.PhraseAutomaton([b" ".join(words).decode(), b" ".join(words[2:]).decode()], [7, 3], 5, 2)
    assert automaton.removed(words, 5).tolist() == [False] * 2 + [True] * 18
    assert automaton.removed(words, 3).sum() == 0 and automaton.removed(words, 9).all()


def spans_found(docs, **options):
    got = defaultdict(set)
    for r in suffixes.repeated_passages(docs, **options).collect():
        got[r.doc_id].update(range(r.start, r.start + r.n_words))
        assert r.earlier_id < r.doc_id
    return got


def spans_by_hand(rows, window):
    want = defaultdict(set)
    for d, _, g in brute_cover(rows, window):
        if any(g):
            want[d].update(np.flatnonzero(g))
    return want


# runs sorted together, one at a time, and none at all: every window as a row
RUNS = [{}, {"rows": 1}, {"longest_run": 1}, {"longest_run": 3, "rows": 7}]


@pytest.mark.parametrize("options", RUNS)
def test_suffixes_equal_brute_force_on_odd_rows(documents, odd_rows, options):
    got, want = spans_found(documents(odd_rows), **options), spans_by_hand(odd_rows, 50)
    assert got == want and want


@pytest.mark.parametrize("options", RUNS)
def test_suffixes_find_every_holder_among_unlike_ones(documents, options):
    """A phrase of many documents with passages of few around it, and lower documents that hold the phrase alone."""
    draw = random.Random(9)
    text = lambda n: [f"w{draw.randrange(100_000)}" for _ in range(n)]
    phrase, rows = text(12), []
    passages = [(text(draw.randint(15, 45)), text(draw.randint(15, 45))) for _ in range(20)]
    for k in range(140):
        if k % 7 < 3:
            before, after = passages[k % 20]
            cut_left, cut_right = draw.choice([0, 0, 5, 12]), draw.choice([0, 0, 4, 9])
            body = before[cut_left:] + phrase + after[: len(after) - cut_right]
        else:
            body = text(20) + phrase + text(20)
        rows.append((k, " ".join(text(draw.randint(0, 30)) + body + text(draw.randint(0, 30))), None, None))
    got, want = spans_found(documents(rows), **options), spans_by_hand(rows, 50)
    assert got == want and len(want) > 25


def test_near_duplicates_equal_brute_force_on_odd_rows(documents, odd_rows):
    got = simhash.near_duplicates(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    prints = [simhash.fingerprint((t or "").encode()) for _, t, *_ in odd_rows]
    assert sorted(r.fp & (1 << 64) - 1 for r in got) == sorted(prints)
    part = list(range(len(prints)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 2:
                part[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, *_) in enumerate(odd_rows):
        least[find(i)].append(d)
    want = sorted(((d, min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, *_) in enumerate(odd_rows)), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_pairs_equal_popcounts(radius):
    draw = np.random.default_rng(1)
    prints = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    prints[100:200] = prints[:100] ^ (np.uint64(1) << draw.integers(0, 64, 100).astype(np.uint64))
    prints[200:250] = prints[:50] ^ np.uint64(0b101) ^ (np.uint64(1) << draw.integers(3, 64, 50).astype(np.uint64))
    i, j = simhash.close_pairs(prints, prints, radius, same=True, step=64)
    distance = np.bitwise_count(prints[:, None] ^ prints[None, :])
    want = {(a, b) for a, b in zip(*np.nonzero(distance <= radius)) if a < b}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_large_bucket_is_compared_in_blocks(spark):
    """Hundreds of fingerprints in one bucket, blocks of 16: no link is lost."""
    prints = sorted({(a << 5) | b for a in range(16) for b in range(20)})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = {(r.u, r.v) for r in simhash.links(frame, block=16).collect()}
    assert got == {(a, b) for a in prints for b in prints if a > b and (a ^ b).bit_count() <= 2}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (102, 101), (5, 5)], "u long, v long")
    roots = {r.u: r.root for r in smallest_reachable(edges).collect()}
    assert roots == {**{k: 0 for k in range(1, 61)}, 101: 100, 102: 100}


def test_empty_tables(documents):
    none = documents([])
    assert phrases.dedupe_passages(none).count() == 0
    assert suffixes.repeated_passages(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
