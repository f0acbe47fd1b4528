"""Conversation repair, prefix trie and language-model scores against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import lmscore, prefixtrie, registry, turnrepair

SOLID, WORD = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def conversations(spark, clashing):
    """Nulls in every column, ties, repeated rows, copies of conversations, long texts, gaps and odd roles."""
    draw = random.Random(5)
    rows = [(None, 0, "user", "Hello."), (None, None, None, None), (None, 2, "assistant", "Yes"), (-3, 0, "user", "Minus three.")]
    for c in range(0, 120):
        if c % 10 == 7:
            continue
        for t in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant", "system", "user", "assistant", "Bot", "", None])
            text = draw.choice(["Fine.", "What?", "no end", "", " \t", None, "é ü.", "x" * 40 + ".", f"Own {c} {t}!"])
            rows.append((c, None if draw.random() < 0.05 else t * draw.choice([1, 1, 2]), role, text))
    for c in range(200, 260):  # copies
        rows += [(c, 0, "user", "Common start."), (c, 1, "assistant", "Common answer.")]
    rows += [(300, 1, "user", "Same."), (300, 1, "user", "Same."), (300, 1, "assistant", "Tie."), (301, 0, "user", "word " * 50_000 + ".")]
    rows += [(302, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]
    return clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), rows


def cheapest(rows, goal=None, entry=0):
    """Least (cost, audit) by Dijkstra's algorithm over (place, state)."""
    heap, done = [(0, "", 0, entry)], {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done or cost > 5 * len(rows) + 20:
            continue
        done[i, state] = cost, audit
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if rows[i] != "-":
                kept = 5 if rows[i].isupper() else 0
                if rows[i].lower() == "uuau"[state]:
                    heapq.heappush(heap, (cost + kept, audit + "K", i + 1, (2, 2, 3, 2)[state]))
                if rows[i].lower() == "s" and state == 0:
                    heapq.heappush(heap, (cost + kept, audit + "K", i + 1, 1))
                heapq.heappush(heap, (cost + 1 + kept, audit + "R", i + 1, (2, 2, 3, 2)[state]))
        heapq.heappush(heap, (cost + 5, audit + "I", i, (2, 2, 3, 2)[state]))
    return min(done[len(rows), s] for s in (0, 3) if (len(rows), s) in done)


def test_search_finds_the_cheapest_and_ascii_least_audit():
    draw = random.Random(1)
    for size in (0, 1, 2, 3, 4, 5, 7, 30):
        for _ in range(80):
            rows = "".join(draw.choice("suaxSUAX-uaua") for _ in range(size))
            found = turnrepair.search(rows)
            assert found == cheapest(rows), rows
            if size > 2:
                cuts = sorted(draw.sample(range(1, size), min(3, size - 1)))
                parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, size])]
                assert turnrepair.add_tables([turnrepair.part_table(p, False) for p in parts]) == found, (rows, cuts)


def test_suffix_bounds_never_exceed_the_cost():
    draw = random.Random(2)
    for _ in range(100):
        rows = "".join(draw.choice("suaxSUA-ua") for _ in range(12))
        bounds = turnrepair.suffix_bounds(rows)
        assert all(bounds[i] <= turnrepair.search(rows[i:], s)[0] for i in range(13) for s in range(4))
        assert bounds[12] == 0 and bounds == sorted(bounds, reverse=True)


def spot(value):
    return " " if value is None else str(value)


def repaired_by_hand(rows, damaged=True):
    held, repaired = {}, {}
    for c, t, role, text in rows:
        held.setdefault(c, [])
        kind = zlib.crc32(f"{spot(c)}:{spot(t)}".encode()) % 20 if damaged else 9
        role, text = spot(role), spot(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for c, turns in held.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()[:16]))
        seen, letters, faults = set(), "", [0, 0, 0]
        for _, role, text in turns:
            solid, letter = SOLID.findall(text), role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not solid:
                faults[0], letter = faults[0] + 1, "-"
            elif (role, text) in seen:
                faults[1], letter = faults[1] + 1, "-"
            elif solid[-1] not in ".!?":
                faults[2], letter = faults[2] + 1, letter.upper()
            seen.add((role, text))
            letters += letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        dated = {t for t, _, _ in turns if t is not None}
        gaps = max(dated) - min(dated) + 1 - len(dated) if dated else 0
        cost, audit = cheapest(letters) if len(letters) < 60 else turnrepair.search(letters)
        out, rest, state = [], iter(turns), 0
        for edit in audit:
            written = "assistant" if state == 2 else "user"
            row = None if edit == "I" else next(rest)
            if edit == "D":
                continue
            out.append((written if edit in "IR" else row[1], "" if edit == "I" else row[2]))
            state = 1 if edit == "K" and state == 0 and row[1][:1] == "s" else (2, 2, 3, 2)[state]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
        repaired[c] = (gaps, *faults, illegal, cost, audit, digest), out
    return repaired


@pytest.mark.parametrize("damaged", [True, False])
def test_repair_equals_brute_force(conversations, damaged, monkeypatch):
    monkeypatch.setattr(turnrepair, "PART", 50)  # the long conversation is added up from parts
    df, rows = conversations
    got = turnrepair.repair(df, damaged=damaged).collect()
    want = repaired_by_hand(rows, damaged)
    assert len(got) == len(want) and {r["conv_id"]: tuple(r)[1:] for r in got} == {c: w[0] for c, w in want.items()}
    assert {r["audit"] for r in got} != {""} and any(r["duplicate"] for r in got)


def test_repaired_turns_are_the_hashed_ones(conversations):
    df, rows = conversations
    turns = {}
    for r in sorted(turnrepair.repaired_turns(df, damaged=True).collect(), key=lambda r: r["place"]):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {c: out for c, (_, out) in repaired_by_hand(rows).items() if out}


def test_conversations_without_rows_left(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in turnrepair.repair(df, damaged=True).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    for run in (turnrepair.repair, turnrepair.repaired_turns, prefixtrie.conversation_trie):
        assert run(df.limit(0)).collect() == []


def trie_by_hand(rows):
    turns, rebuilt, members, children = {}, {}, {}, {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            turns.setdefault(c, []).append((t is not None, t or 0, role.encode(), name, role, text))
    turns = {c: [r[4:] for r in sorted(held)] for c, held in turns.items()}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    for c, chain in rebuilt.items():
        for d in range(len(chain) + 1):
            members.setdefault(tuple(chain[:d]), []).append(c)
    for chain in members:
        if chain:
            children.setdefault(chain[:-1], []).append(chain)
    totals = {}
    for chain in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in children.get(chain, [])]
        own = (len(members[chain]) - 1) * (len(chain[-1][1].encode()) if chain else 0)
        totals[chain] = sum(b[0] for b in below) or 1, sum(b[1] for b in below) + own
    out = []
    for chain, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if len(rebuilt[c]) == len(chain))))
        parent = min(members[chain[:-1]]) if chain else None
        out.append((min(held), len(chain), parent, len(held), len(children.get(chain, [])), *totals[chain], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("container", "shard"), [(512, 10_000), (3, 40), (1, 150)])
def test_trie_equals_brute_force(conversations, container, shard, monkeypatch):
    """Whatever bursts and wherever shards begin, within a group of equal conversations too."""
    monkeypatch.setattr(prefixtrie, "SHARD", shard)
    monkeypatch.setattr(prefixtrie, "LETTERS", 20)
    monkeypatch.setattr(prefixtrie, "BATCH", 30)
    df, rows = conversations
    rows = [r for r in rows if r[0] != 302 or r[1] < 60]
    got = prefixtrie.conversation_trie(df.where("conv_id is null or conv_id <> 302 or turn < 60"), container=container).collect()
    assert sorted((tuple(r) for r in got), key=str) == trie_by_hand(rows)
    assert max(r["n_convs"] for r in got if r["depth"] == 1) >= 30


def test_containers_burst_by_next_turn():
    chains = [(bytes([k % 3]) * 16 + bytes([k]) * 16, k, [1, 1]) for k in range(30)]
    seen, heads = [], []
    prefixtrie.burst(chains, 0, 12, lambda held, at: seen.append((at, len(held))), lambda s, at: heads.append((at, s[0][: at * 16])), lambda: None)
    assert seen == [(1, 10)] * 3 and heads == [(1, bytes([k]) * 16) for k in range(3)]


def scores_by_hand(rows, weights_of):
    texts = []
    for i, text in rows:
        remainder = -1 if i is None else zlib.crc32(str(i).encode()) % 5
        texts.append((i, remainder, [*WORD.findall((text or "").translate(LOWER)), None]))

    def counts(remainders):
        c1, c2, c3 = Counter(), Counter(), Counter()
        for _, r, w in texts:
            if r in remainders:
                c1.update(w), c2.update(zip(["<"] + w, w)), c3.update(zip(["<"] + w, w, w[1:]))
        return c1, c2, c3, sum(r in remainders for _, r, _ in texts)

    def estimates(c, w):
        c1, c2, c3, starts = c
        out = []
        for k, x in enumerate(w):
            before = (["<", "<"] + w)[k : k + 2]
            n1 = c1[before[1]] if k else starts
            n2 = c2[tuple(before)] if k else starts
            three = c3[(*before, x)] if k else c2["<", x]
            bucket = 64 + int(math.log2(n2)) if n2 else int(math.log2(n1)) if n1 else -1
            base = (c1[x] + 0.5) / (sum(c1.values()) + 0.5 * (len(c1) + 1))
            out.append((bucket, three / n2 if n2 else 0.0, c2[before[1], x] / n1 if n1 else 0.0, base))
        return out

    rest, every = counts({0, 2, 3}), counts({0, 2, 3, 4})
    held = np.array([e for _, r, w in texts if r == 4 for e in estimates(rest, w) if e[0] >= 0]).reshape(-1, 4)
    weights = weights_of(held[:, 0].astype(int), np.ones(len(held)), held[:, 1] / held[:, 3], held[:, 2] / held[:, 3])
    out = []
    for i, r, w in texts:
        found = [np.array(c) for c in zip(*estimates(every, w))]
        score = np.log10(lmscore.mixed(found[0].astype(int), *found[1:], weights)).sum()
        out.append((i, r == 1, len(w), sum(every[0][x] > 0 for x in w), sum(every[0].values()), np.log10(found[3]).sum(), score))
    return out


def same_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=2e-3)


@pytest.mark.parametrize(("block", "shard"), [(8 << 20, 1 << 21), (3000, 700)])
def test_scores_equal_brute_force_on_odd_rows(documents, odd_rows, block, shard, monkeypatch):
    """One block and shard, and many of both."""
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", block)
    monkeypatch.setattr(lmscore, "SHARD_KEYS", shard)
    rows = odd_rows + [(100 + k, "Over the hills AND far away " * 3 + f"word{k % 4}", "en", "src9") for k in range(40)]
    got = lmscore.language_model_scores(documents(rows)).collect()
    same_scores(got, scores_by_hand([(i, t) for i, t, *_ in rows], lmscore.learn_weights))


def test_score_is_a_distribution_over_the_next_token():
    """Over every known token and one unknown, the mixture adds up to one."""
    totals, draw = lmscore.Totals(60, 5, 7), np.random.default_rng(0)
    one, three, two = np.array([20, 15, 12, 8, 5, 0]), np.array([2, 1, 0, 0, 1, 0]), np.array([4, 3, 0, 2, 1, 0])
    p3, p2, p1 = three / three.sum(), two / two.sum(), totals.base(one)
    weights = np.vstack([draw.dirichlet([1, 1, 1], 128)])
    for bucket in (64, 70):
        assert abs(lmscore.mixed(np.full(6, bucket), p3, p2, p1, weights).sum() - 1) < 1e-12


def test_weights_follow_expectation_maximisation():
    """One bucket against a plain loop; buckets without tokens have the pooled weights."""
    draw = np.random.default_rng(4)
    r3, r2 = draw.choice([0, 0, 50.0, 300.0], 400), draw.choice([0, 5.0, 40.0], 400)
    weights = lmscore.learn_weights(np.full(400, 66), np.ones(400), r3, r2)
    w = np.array([0.4, 0.3, 0.3])
    for _ in range(3000):
        parts = w * np.stack([r3, r2, np.ones(400)], axis=1)
        w = (parts / parts.sum(axis=1, keepdims=True)).mean(axis=0)
    assert np.allclose(weights[66], w, atol=5e-3) and np.allclose(weights[70], w, atol=5e-3)
    assert np.allclose(weights[3], [0, 0.5, 0.5]) and np.allclose(weights.sum(axis=1), 1)


def test_held_out_cells_keep_sums():
    bucket, p1 = np.array([3, 3, 66, -1, 66]), np.full(5, 0.01)
    p3, p2 = np.array([0, 0, 0.5, 0, 0.5]), np.array([0.1, 0.1, 0.2, 0, 0.0])
    cells = lmscore.held_out_cells(bucket, p3, p2, p1)
    assert sum(v[0] for v in cells.values()) == 4 and abs(sum(v[1] for v in cells.values()) - 100) < 1e-9
    assert {k[0] for k in cells} == {3, 66} and len(cells) == 3


def test_counts_survive_packing():
    for values in ([], [0, 1, 254, 255, 256, 10**12, 3]):
        assert lmscore.unpack(lmscore.pack(np.array(values, np.int64)), len(values)).tolist() == values
    for values in ([], [7, 65_534, 65_535, 65_536, 2**31 - 1, 0]):
        assert lmscore.unpack_numbers(lmscore.pack_numbers(np.array(values, np.int64)), len(values)).tolist() == values
    for values in ([], [5], [0, 3, 2**40, 2**63, 2**64 - 1]):
        assert lmscore.unpack_keys(lmscore.pack_keys(np.array(values, np.uint64))).tolist() == values


def test_empty_tables_and_one_long_text(spark, documents):
    empty = documents([(1, "x", None, None)]).limit(0)
    assert lmscore.language_model_scores(empty).collect() == []
    long = [(k, ("lorem ipsum dolor " * 30_000) if k == 3 else f"lorem {k}", None, None) for k in range(12)]
    same_scores(lmscore.language_model_scores(documents(long)).collect(), scores_by_hand([(i, t) for i, t, *_ in long], lmscore.learn_weights))


def test_settings_are_put_back(spark, documents):
    before = spark.conf.get(lmscore.BATCH_KEY)
    with lmscore.rows_per_batch(spark, 3):
        assert spark.conf.get(lmscore.BATCH_KEY) == "3"
    assert spark.conf.get(lmscore.BATCH_KEY) == before


def test_registered_queries_return_the_contracts_columns(spark, sf_dir):
    want = {
        "op11_structure_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
        "op12_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
        "op13_deleted_interpolation": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    }
    for name, columns in want.items():
        df = registry.QUERIES[name](spark, sf_dir)
        assert set(df.columns) == columns and all(t in ("bigint", "string", "double", "boolean") for _, t in df.dtypes)
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = registry.QUERIES["op11_structure_repair"](spark, sf_dir).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: w[0] for c, w in repaired_by_hand(rows).items()}
    got = registry.QUERIES["op12_prefix_trie"](spark, sf_dir).collect()
    assert sorted((tuple(r) for r in got), key=str) == trie_by_hand(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = registry.QUERIES["op13_deleted_interpolation"](spark, sf_dir).collect()
    same_scores(got, scores_by_hand([tuple(r) for r in docs.collect()], lmscore.learn_weights))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.85 * sum(r["base_score"] for r in held)
    assert docs.where(F.col("doc_id").isNull()).count() == 0
