import random
from math import isclose, log

import numpy as np
import public_tokenizers
import pytest

from trafficlens.llm import language_id as li

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, index, probs, x):
    """Sum over all segmentations by recursion."""
    s = li.MARK + word

    def rest(i):
        if i == len(s):
            return 1.0
        total = 0.0
        for j in range(i + 1, len(s) + 1):
            k = index.get(s[i:j])
            p = probs[k][x] if k is not None else (li.UNSEEN if j == i + 1 else 0.0)
            if p:
                total += p * rest(j)
        return total

    return rest(0)


def test_forward_sums_all_segmentations():
    r = np.random.default_rng(1)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab", "aa"]
    probs = r.random((len(pieces), 3))
    probs /= probs.sum(axis=0)
    known = li.Vocabulary(pieces)
    words = sorted({"".join(random.Random(i).choice("abc") for _ in range(1 + i % 7)) for i in range(60)})
    for word, got in zip(words, li.Lattice(known, words).log_probs(probs)):
        assert np.allclose(got, [log(brute(word, known.index, probs, x)) for x in range(3)])
    assert li.Lattice(known, []).log_probs(probs).shape == (0, 3)


def test_no_word_is_too_long():
    """Sums of 800 letters in exact fractions, and of unknown letters."""
    known = li.Vocabulary(["▁", "a", "b", "ab"])
    probs = np.array([[0.1, 0.2], [0.2, 0.3], [0.3, 0.2], [0.4, 0.3]])
    got = li.Lattice(known, ["ab" * 400, "a", "c" * 500]).log_probs(probs)
    want = [float(log(p[0])) + 400 * log(p[1] * p[2] + p[3]) for p in probs.T]
    assert np.allclose(got[0], want) and np.allclose(got[1], np.log(probs[0] * probs[1]))
    assert np.allclose(got[2], np.log(probs[0]) + 500 * log(li.UNSEEN))


def expected(word, index, probs, x):
    """Expected count of each piece by listing all segmentations."""
    s, out, total = li.MARK + word, np.zeros(len(probs)), 0.0

    def rest(i, p, used):
        nonlocal out, total
        if i == len(s):
            total += p
            for k in used:
                out[k] += p
            return
        for j in range(i + 1, len(s) + 1):
            k = index.get(s[i:j])
            if k is not None:
                rest(j, p * probs[k][x], [*used, k])
            elif j == i + 1:
                rest(j, p * li.UNSEEN, used)

    rest(0, 1.0, [])
    return out / total


def test_expectation_equals_listing_segmentations():
    r = np.random.default_rng(2)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"]
    probs = r.random((len(pieces), 2))
    probs /= probs.sum(axis=0)
    words = ["a", "abab", "cab", "bbbab", "babab", "c"]
    weights = r.integers(0, 5, (len(words), 2)).astype(float)
    known = li.Vocabulary(pieces)
    got = li.Lattice(known, words).expect(probs, weights)
    want = np.stack([sum(weights[w, x] * expected(word, known.index, probs, x) for w, word in enumerate(words)) for x in range(2)], axis=1)
    assert np.allclose(got, want)


def test_fit_and_text_scores_equal_brute_force(spark, monkeypatch):
    """Expectation-maximisation and posteriors over a small vocabulary, text by text, in plain Python."""
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    rows = [("ab ba b", "x"), ("aab ab ab", "x"), ("bb b ba", "y"), ("b b", "y"), ("ab", None), (None, "x"), ("zz", "y")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    langs, probs = li.fit(df, pieces)
    assert langs == ["x", "y"]
    index = {p: k for k, p in enumerate(pieces)}
    want = np.full((6, 2), 1 / 6)
    for _ in range(li.ROUNDS):
        seen = np.full((6, 2), li.PRIOR)
        for text, lang in rows:
            for word in (text or "").split() if lang else []:
                x = langs.index(lang)
                seen[:, x] += expected(word, index, want, x)
        want = seen / seen.sum(axis=0)
    assert np.allclose(probs, want, atol=1e-5)
    texts = ["ab ab", "b", "ba bb b", "zz a"]
    got = [(r["lang_pred"], r["score"]) for r in li.predict(spark.createDataFrame([(t,) for t in texts], "text string"), pieces, langs, probs).collect()]
    for t, (lang, score) in zip(texts, got):
        p = np.array([np.prod([brute(w, index, probs, x) for w in t.split()]) for x in range(2)])
        assert lang == langs[int(p.argmax())] and isclose(score, p.max() / p.sum(), rel_tol=1e-6)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = li.identify(docs, PIECES).select("doc_id", "lang", "held_out", "lang_pred", "score").toPandas()
    out = rows[rows.held_out & (rows.lang_pred != li.UND)]
    assert len(out) > 250 and (out.lang == out.lang_pred).mean() > 0.95
    assert rows.score.between(0, 1).all() and set(rows.lang_pred) <= {"de", "en", "es", "fr", li.UND}


def test_null_empty_and_letterless(spark):
    rows = [(i, t, l, "x") for i, (t, l) in enumerate([(None, "en"), ("", None), ("123 !?", "de"), ("the and of the the", "en"), ("der und die der", "de"), ("der und", None)] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in li.identify(df, PIECES).collect()}
    assert len(got) == 30
    assert all(got[i]["lang_pred"] == li.UND and got[i]["score"] == 0 for i in range(30) if i % 6 < 3)
    assert all(got[i]["lang_pred"] == "de" for i in range(30) if i % 6 > 3)


@pytest.mark.parametrize("rows", [[], [(1, "the", None)]])
def test_nothing_to_learn_from(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in li.identify(df, PIECES).collect()] == [li.UND] * len(rows)
