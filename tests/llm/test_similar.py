"""Near copies by Jaccard similarity against brute force, around the threshold of 0.8."""

import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline as cp
from trafficlens.llm import similar
from trafficlens.llm.similar import LEAST, simhash_similar


def grams(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike(a, b):
    p, q = LEAST
    return q * len(a & b) >= p * len(a | b)


def brute(rows):
    """{id: smallest id reachable} over all pairs that are similar enough, of rows with distinct ids."""
    label, sets = {i: i for i, _ in rows}, {i: grams(t) for i, t in rows}
    links = [(a, b) for a in label for b in label if a < b and alike(sets[a], sets[b])]
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def corpus():
    """Texts of 200 words, and copies with 1 to 14 words changed: similarities from 0.95 to 0.5."""
    r, rows = random.Random(3), []
    for base in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(200)]
        rows.append((len(rows) + 1, " ".join(words)))
        for _ in range(3):
            near = list(words)
            for k in r.sample(range(200), r.randrange(1, 15)):
                near[k] = "changed"
            rows.append((len(rows) + 1, " ".join(near)))
    return [*rows, (900, None), (901, ""), (902, "one two"), (903, "One two")]


def test_components_equal_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r["component_id"] for r in simhash_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and 60 < len(set(want.values())) < 140


def test_near_stage_links_at_four_fifths_and_not_below(spark):
    """Copies between 0.8 and 0.92 go; texts below 0.8 stay, even where few bits of a fingerprint differ."""
    rows = [(i, t, "en", "src0", 0) for i, t in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, least in brute([x[:2] for x in rows]).items() if i == least}
    assert {r["doc_id"] for r in cp.near(spark, docs, "").collect()} == want


def test_a_group_that_no_single_member_joins(spark):
    """A chain of texts, each similar to the next only, is one component."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k * 6 : k * 6 + 120])) for k in range(30)]
    got = {r["component_id"] for r in simhash_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0} and not alike(grams(rows[0][1]), grams(rows[3][1]))


@pytest.mark.parametrize("small,most", [(2, 8), (1, 4096)])
def test_large_buckets_are_dealt_out(spark, monkeypatch, small, most):
    """The same components where every bucket is beyond bucket_rows, and texts of 0.7 to 0.8 in one bucket stay apart."""
    monkeypatch.setattr(similar, "MEAN_BUCKET", 10_000)
    monkeypatch.setattr(similar, "SMALL", small)
    rows = corpus()
    df = spark.createDataFrame([(t, i, 1, 2, 3) for i, t in rows], "text string, doc_id long, c int, vertex int, sha int")
    got = {r["doc_id"]: r["component_id"] for r in similar.simhash_similar(df, bucket_rows=most).collect()}
    assert got == brute(rows)


def test_pairs_right_at_the_threshold_are_missed_as_seldom_as_stated():
    """Recall of the bucket keys and of both radiuses over pairs of exactly 0.8, as for a million texts."""
    r = np.random.default_rng(4)
    keys, bits = similar.samples(1_000_000, LEAST)
    whole, found = similar.radius(64 * similar.WORDS, LEAST, similar.WHOLE_WITHIN), 0
    for _ in range(400):
        both, a, b = np.split(r.integers(0, 1 << 63, 400 + 50 + 50, dtype=np.uint64), [400, 450])
        x, y = (similar.wide_fingerprint(np.concatenate([both, own])) for own in (a, b))
        found += int(np.bitwise_count(x ^ y).sum()) <= whole and any(
            not int(x[k] ^ y[k]) & mask and int(x[(k + 1) % similar.WORDS] ^ y[(k + 1) % similar.WORDS]).bit_count() <= bits for k, mask in keys
        )
    assert found >= 390


def test_hubs_are_nearest_to_the_majority_of_their_group():
    fps = np.array([0b0111, 0b0011, 0b1011, 0, 0b0011, 1 << 63, 1 << 63], np.uint64)
    label = np.array([0, 0, 0, 3, 0, 5, 5])
    vertex = np.array([1, 9, 2, 3, 4, 8, 7])
    assert similar._hubs(fps, vertex, label).tolist() == [4, 4, 4, 3, 4, 6, 6]


def test_a_large_group_of_copies_of_a_template(spark):
    """400 copies with 0 to 8 words changed: one hub takes most; those that it does not, link with others or with none."""
    r, words = random.Random(8), [f"w{k}" for k in range(150)]
    rows = []
    for k in range(400):
        near = list(words)
        for at in r.sample(range(150), r.randrange(9)):
            near[at] = f"x{r.randrange(3)}"
        rows.append((k, " ".join(near)))
    got = {r["doc_id"]: r["component_id"] for r in simhash_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert sum(got[i] != want[i] for i in got) <= 2 and 50 < sum(c == 0 for c in want.values()) < 390


@pytest.mark.parametrize("block", [1024, 70])
def test_a_large_group_of_texts_below_the_threshold_is_no_list_of_pairs(spark, monkeypatch, block):
    """300 copies of a template, nearly all pairs at 0.77: a hub takes few, yet no more pairs are listed than with hubs."""
    r, words, listed = random.Random(9), [f"w{k}" for k in range(1200)], []
    linked = similar._linked
    monkeypatch.setattr(similar, "GROUP_BLOCK", block, raising=False)
    monkeypatch.setattr(similar, "_linked", lambda pairs, *rest: listed.append(pairs.count()) or linked(pairs, *rest))
    rows = []
    for k in range(300):
        near = list(words)
        for at in r.sample(range(10, 1160, 5), 16):
            near[at] = f"x{k}at{at}"
        rows.append((k, " ".join(near)))
    got = {r["doc_id"]: r["component_id"] for r in simhash_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and len(set(want.values())) > 30
    assert 0 < sum(listed) <= 10 * len(rows)


def test_cells_join_what_links_and_return_a_forest():
    """Links of a cell against brute force: of blocks that meet, and of one with itself, some of it joined before."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.r_[base[r.random(60) < 0.89], r.integers(0, 1 << 63, 2, dtype=np.uint64)]) for _ in range(80)]
    p, q = LEAST
    for both in (False, True):
        side, c = np.where(np.arange(80) % 3 == 0, 1, 2) if both else np.full(80, 3), np.where(np.arange(80) < 20, 7, 100 + np.arange(80))
        cell = pd.DataFrame({"n": [len(s) for s in sets], "side": side, "c": c, "words": [similar.wide_fingerprint(s).view(np.int64) for s in sets], "shingles": [s.tobytes() for s in sets]})

        def label(links, c=c):
            return similar._forest(80, *np.array([*links, *((0, k) for k in range(80) if c[k] == 7)]).T).tolist()

        on = [(a, b) for a in range(80) for b in range(a) if side[a] | side[b] == 3 and q * len(np.intersect1d(sets[a], sets[b])) >= p * len(np.union1d(sets[a], sets[b]))]
        links = similar._joined(cell, 512, LEAST)
        assert label(links) == label(on) and 1 < len(set(label(on))) < 61 and len(links) == 61 - len(set(label(on)))


def test_of_nothing_and_of_null_ids(spark):
    assert simhash_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"w{k}" for k in range(300))
    df = spark.createDataFrame([(None, long), (4, long + " end"), (None, "alone here"), (5, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in simhash_similar(df).collect()}
    assert got == {(None, 4, False), (4, 4, True), (None, None, True), (5, 5, True)}
