import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import calibration, htmltext, langid, quality
from fieldtally.llm.batches import Words, pieces, sliding_min

import pyarrow as pa


def words_of(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(documents):
    """Two languages of different letters, and odd rows."""
    rng = random.Random(0)
    rows = [(k, words_of(rng, "abcde " if k % 2 else "xyzüv ", 40), "aa" if k % 2 else "xx", "s") for k in range(240)]
    rows += [(300, None, "aa", "s"), (301, "", "aa", "s"), (302, "123 !? \n", None, "s"), (303, "ABC bad cab", None, None), (303, "ABC bad cab", None, None)]
    rows += [(None, "xyzü vüz", "xx", "s"), (304, "züvyx " * 30_000, None, "s")]
    return rows


def held(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_languages_of_held_out_and_odd_rows(documents, tongues):
    got = langid.identify(documents(tongues)).collect()
    assert len(got) == len(tongues)
    by_id = {r.doc_id: r for r in got}
    for doc_id, _, lang, _ in tongues[:240]:
        assert by_id[doc_id].held_out == held(doc_id, 4, 2)
        assert by_id[doc_id].lang_pred == lang and 0.5 < by_id[doc_id].score <= 1
    for doc_id in (300, 301, 302):
        assert (by_id[doc_id].lang_pred, by_id[doc_id].score) == ("und", 0.0)
    assert by_id[303].lang_pred == "aa" and by_id[304].lang_pred == "xx"
    assert by_id[None].lang_pred == "xx" and by_id[None].held_out is False


def test_languages_do_not_see_held_out_labels(documents, tongues):
    """Swapped labels of held-out rows change nothing."""
    swapped = [(i, t, "xx" if lang == "aa" and held(i, 4, 2) else lang, s) for i, t, lang, s in tongues]
    a = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(documents(tongues)).collect()}
    assert a == {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(documents(swapped)).collect()}


def test_languages_without_anything_to_learn(documents):
    rows = langid.identify(documents([(1, "some text", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
    assert langid.identify(documents([])).count() == 0


def test_every_language_is_learned_and_copies_count_once(documents):
    """300 languages of two letters each; one text of the first is copied beyond the bound of the sample."""
    rng, rows = random.Random(2), []
    for k in range(300):
        letters = [chr(0x4E00 + 2 * k), chr(0x4E01 + 2 * k)]
        rows += [(6 * k + i, words_of(rng, letters, 12), f"l{k:03d}", "s") for i in range(6)]
    copies = [(5000 + i, rows[0][1], "l000", "s") for i in range(200)]
    docs = documents(rows + copies)
    model = langid.fit(docs, learnable=~langid.held_out(4, 2), per_class=50)
    assert model.classes == sorted({r[2] for r in rows})
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert sum(got[d] == lang for d, _, lang, _ in rows) >= 0.98 * len(rows)
    alone = langid.fit(documents(rows), learnable=~langid.held_out(4, 2), per_class=50)
    assert len(model.table) == len(alone.table)


def test_regression_steps_equal_plain_loops():
    """Follow-the-regularised-leader, one weight at a time, in the order of the library's permutations."""
    rng = np.random.default_rng(1)
    vectors = [(np.sort(rng.choice(20, 4, replace=False)), rng.random(4) * 3) for _ in range(30)]
    labels = np.array([int(ids[0] < 4) + int(ids[-1] > 16) for ids, _ in vectors])
    got, got_bias = langid.train(vectors, labels, 3, 20)
    z, n = np.zeros((21, 3)), np.zeros((21, 3))

    def weight(i, c):
        if abs(z[i, c]) <= langid.L1:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * langid.L1) / ((langid.BETA + np.sqrt(n[i, c])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for k in order.permutation(30):
            x = {**dict(zip(vectors[k][0].tolist(), vectors[k][1])), 20: 1.0}
            w = {(i, c): weight(i, c) for i in x for c in range(3)}
            logits = [sum(v * w[i, c] for i, v in x.items()) for c in range(3)]
            chances = np.exp(logits) / np.exp(logits).sum()
            for i, v in x.items():
                for c in range(3):
                    g = v * (chances[c] - (c == labels[k]))
                    sigma = (np.sqrt(n[i, c] + g * g) - np.sqrt(n[i, c])) / langid.ALPHA
                    z[i, c] += g - sigma * w[i, c]
                    n[i, c] += g * g
    want = np.array([[weight(i, c) for c in range(3)] for i in range(21)])
    assert np.allclose(np.vstack([got, got_bias]), want) and (want == 0).any() and (want != 0).any()


def test_vectors_are_shares_times_rarity():
    idf = 1 + np.random.default_rng(0).random(langid.FEATURES)
    texts = ["Abba ab", "x", None, "ab-ab"]
    for text, (ids, x) in zip(texts, langid._vectors(texts, idf)):
        framed = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ") if text else " "
        grams = [framed[i : i + n] for n in langid.ORDERS for i in range(len(framed) - n + 1)]
        counted = {g: grams.count(g) for g in grams}
        assert len(ids) == len(counted)
        assert sorted(x / idf[ids]) == pytest.approx(sorted(langid.SCALE * c / len(grams) for c in counted.values()))


def test_pool_equals_plain_means():
    vectors = np.random.default_rng(0).normal(size=(quality.VOCABULARY, quality.DIMENSIONS)).astype(np.float32)
    texts = ["a b a", "", "c", None]
    got = quality.pooled(Words.of(pa.array(texts)), vectors)
    for row, text in zip(got, texts):
        own = (text or "").split()
        each = np.array([vectors[quality.word_rows(Words.of(pa.array([w])))[0]] for w in own]).reshape(-1, quality.DIMENSIONS).astype(float)
        mean = each.mean(axis=0) if own else np.zeros(quality.DIMENSIONS)
        spread = np.sqrt(np.maximum(0, (each**2).mean(axis=0) - mean**2)) if own else np.zeros(quality.DIMENSIONS)
        assert row[: quality.DIMENSIONS] == pytest.approx(mean, abs=1e-5)
        assert row[quality.DIMENSIONS : 2 * quality.DIMENSIONS] == pytest.approx(spread, abs=1e-3)


def test_word_vectors_do_not_depend_on_flushes(documents, monkeypatch):
    docs = documents([(k, f"a b c d{k % 3} e f", "en", "s") for k in range(2500)]).coalesce(1)  # three batches
    whole = quality.word_vectors(docs)
    monkeypatch.setattr(quality, "FLUSH_WORDS", 20)
    assert np.array_equal(quality.word_vectors(docs), whole)


def test_ngrams_stay_inside_texts():
    one, _, letters = langid.ngram_features(["Ab1", None, "ab"])
    alone, _, _ = langid.ngram_features(["ab"])
    assert [f[-len(alone[0]) :].tolist() for f in one] == [f.tolist() for f in alone]
    assert letters.tolist() == [True, False, True]


def test_temperature_recovers_the_scale():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(20_000, 3))
    labels = np.array([rng.choice(3, p=p) for p in calibration.softmax(logits)])
    assert calibration.fit_temperature(3 * logits, labels) == pytest.approx(3, rel=0.1)
    assert calibration.fit_temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def test_quality_on_held_out_and_odd_rows(spark, documents):
    rng = random.Random(1)
    rows = [(k, words_of(rng, "abcdefgh", 50) if k % 2 else words_of(rng, "QRST!!$$", 50), "en", "s") for k in range(400)]
    odd = [(500, None, None, None), (501, "", None, None), (502, "abc " * 20_000, None, None), (None, "abc", None, None)]
    marks = [(k, k % 2, 5) for k in range(400)] + [(None, 1, 1), (7, None, 1), (500, 1, 1), (9, 1, 1), (9, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, score int")
    got = quality.assess(documents(rows + odd), labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    test = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(test) > 50 and np.mean([r.predicted == r.doc_id % 2 for r in test]) > 0.95
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got)
    assert quality.assess(documents([]), labels).count() == 0
    assert quality.assess(documents(odd), labels.limit(0)).count() == 4


def test_context_counts_equal_a_plain_count():
    texts = ["a b c a", "", "b a"]
    words = Words.of(pa.array(texts))
    rows = quality.word_rows(words)
    dims, signs = quality.index_places()
    want, at = np.zeros((quality.VOCABULARY, quality.DIMENSIONS)), 0
    for t in texts:
        n = len(t.split())
        for i in range(n):
            for j in range(max(0, i - quality.REACH), min(n, i + quality.REACH + 1)):
                if i != j:
                    for s in range(quality.SEEDS):
                        want[rows[at + i], dims[rows[at + j], s]] += signs[rows[at + j], s]
        at += n
    assert (quality.context_counts(words) == want).all()


def test_words_follow_ascii_white_space_only():
    texts = [" a\tbb\x0b\n c d ", None, "", "\x1c", "e" * 5000]
    words = Words.of(pa.array(texts))
    data = words.data.tobytes()
    got = [data[a:b] for a, b in zip(words.starts, words.ends)]
    assert got == [w for t in texts for w in (t or "").encode().split()]
    assert words.counts.tolist() == [3, 0, 0, 1, 1]
    same = Words.of(pa.array(["x bb y", "bb"])).hashes()
    assert same[1] == same[3] and len(set(same.tolist())) == 3
    assert sliding_min(np.array([5, 3, 4, 1, 2], np.uint64), 3)[:3].tolist() == [3, 1, 1]
    batch = pa.record_batch({"text": pa.array(texts)})
    assert sum(p.num_rows for p in pieces(batch, limit=3)) == len(texts)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><h1>Site name</h1><p>Some slogan, really, of the site</p></header><nav><ul><li><a href="/">Home</a><li><a href="/b">Other</a></ul></nav>
<div id="cookie-banner"><p>We use cookies, and more cookies, on this site of ours.</p></div><!-- <p>hidden</p> -->
<div class="layout"><aside><p>Aside, text, with, many, commas, in, it, here</p></aside>
%s
<div class="sponsored ad"><p>Buy, buy, buy, all the good things, today, now.</p></div>
<section id="comments"><article class="comment"><p>Great, great, great post, thanks a lot for sharing it.</p></article></section>
<form><p>Your, name, and, mail, please, here, now</p><button>Send</button></form></div>
<footer><p>&copy; 2020 Somebody, somewhere, all rights reserved, etc.</p></footer><script>var t="<p>x</p>";</script></body></html>"""
ARTICLE = "<h2>Head &amp; line</h2><p>First   para,\n with <b>bold</b> text&nbsp;and a <a href='x>y'>link</a>, long enough to count.<p>Second one&#33;<ul><li>item <i>one</i><li>item two</ul><blockquote>Quoted, words</blockquote>"
TEXT = "Head & line\nFirst para, with bold text and a link, long enough to count.\nSecond one!\nitem one\nitem two\nQuoted, words"


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<div class='post-body'>%s</div>", "<main><div>%s</div></main>"])
def test_main_text(frame):
    assert htmltext.extract(PAGE % (frame % ARTICLE)) == TEXT


def test_main_text_of_broken_pages():
    assert htmltext.extract(None) == htmltext.extract("") == htmltext.extract("<nav>menu</nav>") == ""
    assert htmltext.extract("just text &lt;b&gt; here") == "just text <b> here"
    assert htmltext.extract("<article><p>cut <b>off &am") == "cut off &am"
    assert htmltext.extract("<article><p>one<p>two</article><scr") == "one\ntwo"
    assert htmltext.extract("<p>a</p><!-- never closed <p>b</p>") == "a"
    assert htmltext.extract("<p>a<script>if (1 < 2) '</p>'") == "a"
    assert htmltext.extract("<div>" * 30_000 + "deep") == "deep"
    assert htmltext.extract('<p title="never closed>text</p><p>more</p>').endswith("more")


SENTENCE = "A sentence of some length, with commas, that goes on and on for a while in the article."
LONG = "".join(f"<p>{SENTENCE} {k}</p>" for k in range(15))
WRITTEN = [f"{SENTENCE} {k}" for k in range(15)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>T</h1><p>lead</p><div>{LONG}</div><section><h2>S</h2><p>more</p></section></article>", ["T", "lead", *WRITTEN, "S", "more"]),
        (f"<article><header class='entry-header'><h1>Title</h1></header>{LONG}</article>", ["Title", *WRITTEN]),
        (f"<article><h1>T</h1>{LONG}<ul><li><a href=x>Ref one</a><li><a href=y>Ref two</a></ul></article>", ["T", *WRITTEN, "Ref one", "Ref two"]),
        (f"<article><h1>T</h1><div class='legal form search'>{LONG}</div><div class=comments><p>No.</p></div></article>", ["T", *WRITTEN]),
        (f"<article>{LONG}<div class=share><a href=x>Tell a friend</a></div><aside>Side</aside></article><div class=legal>Small print</div>", WRITTEN),
        (f"<main><h1>T</h1><article>{LONG}</article></main><div>Elsewhere</div>", ["T", *WRITTEN]),
        (f"<main><article>{LONG}</article><article><p>Another teaser, not part of it.</p></article></main>", WRITTEN),
        (f"<h1>T</h1><div><div class='post-header'>Sub</div>{LONG}</div><ul><li><a href=x>Home</a><li><a href=y>News</a></ul>", ["T", "Sub", *WRITTEN]),
        ("<div>" * 2100 + "<nav><p>menu</p></nav><p>deep, text</p>" + "</div>" * 2100 + "<p>after</p>", ["deep, text", "after"]),
        (f"<article><p>{'word, ' * 200_000}</p></article>", [("word, " * 200_000).strip()]),
    ],
)
def test_whole_articles_are_kept(page, text):
    """Nested bodies, titles in headers, link lists, class names of other use, deep and very long pages."""
    assert htmltext.extract(f"<html><body><nav><a href=x>Menu</a></nav>{page}<footer>Foot</footer></body></html>") == "\n".join(text)


def test_pages_table(spark):
    rows = [(1, "u", "<p>x y</p>"), (1, "u", "<p>x y</p>"), (2, None, None), (None, "v", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted(((r.page_id, r.url, r.text) for r in htmltext.main_text(frame).collect()), key=str)
    assert got == sorted([(1, "u", "x y"), (1, "u", "x y"), (2, None, ""), (None, "v", "")], key=str)
    assert htmltext.main_text(frame.limit(0)).count() == 0
