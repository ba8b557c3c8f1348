"""Exact dedup, SimHash, embeddings, components: against brute force on small tables with edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trafficlens.llm import components, embedding_dedup, exact_dedup, simhash


def closure(n, links):
    """The smallest index reachable from each of n over links."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    for n, m in ((40, 30), (200, 150), (60, 59)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] if m != 59 else [(i, i + 1) for i in range(59)]
        edges = spark.createDataFrame(links, "u long, v long")
        got = {x["vertex"]: x["component"] for x in components.components(edges).collect()}
        want = closure(n, links)
        touched = {x for a, b in links if a != b for x in (a, b)}
        assert got == {v: want[v] for v in touched}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


EDGE_TEXTS = [None, "", "a", "a b", " \t\n", "x" * 20_000, "x" * 8192, "x" * 4096, "x" * 4097, "ab" * 4096, "é" * 2048, "e", "\0", "a\0"]


def test_exact_dedup_equals_grouping(spark):
    r = random.Random(1)
    texts = EDGE_TEXTS + [r.choice(EDGE_TEXTS) for _ in range(40)] + [str(r.randrange(20)) * r.randrange(1, 3000) for _ in range(60)]
    rows = [(r.randrange(10**6), t, "s", 1, "clash") for t in texts] + [(77, "same", "s", 1, "clash")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, group_size int, __name string")
    got = exact_dedup.exact_dedup(df, block_bytes=1024).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for g in got:
        ids = by_sha[g["text_sha256"]]
        assert g["doc_id"] in ids and g["keep_id"] == max(ids) and g["group_size"] == len(ids)
        assert not g["kept"] or g["doc_id"] == max(ids)
    assert sum(g["kept"] for g in got) == len(groups)
    names = {(g["class_name"], g["class_level"], len(g["text_sha256"])): set() for g in got}
    assert len(names) == len({g["text_sha256"] for g in got}) or len(names) <= len(groups)


def test_exact_dedup_with_names_that_the_operator_uses(spark):
    extra = ["__name", "__level", "__n_bytes", "__sha256", "__rid", "__bytes", "__row", "text", "id", "__top"]
    df = spark.createDataFrame([(1, "a", *extra), (2, "a", *extra), (None, None, *extra)], ["doc_id", "body", *extra])
    got = exact_dedup.exact_dedup(df, text_col="body").collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["kept"]) for r in got) == [(0, None, True), (1, 2, False), (2, 2, True)]
    assert all(r[c] == c for r in got for c in extra)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "_HASHED_AT_ONCE", 7)
    r = random.Random(2)
    texts = EDGE_TEXTS + [" ".join(r.choice(["A", "b", "Cé", "d\x0be", "f\x1cg"]) for _ in range(k)) for k in range(60)]
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


@pytest.mark.parametrize("bits,blocks,keep,rows", [(3, 4, 1, 4096), (3, 4, 1, 20), (6, 8, 2, 64), (3, None, None, 4096), (3, None, None, 50)])
def test_links_equal_all_pairs(spark, bits, blocks, keep, rows):
    """Spread fingerprints, and 300 that share 40 bits: their buckets pass LEAF, FAN_OUT and, with few rows, bucket_rows."""
    r = random.Random(bits + rows)
    fps = [r.getrandbits(64) for _ in range(150)]
    for f in fps[:40]:
        for _ in range(6):
            g = f
            for b in r.sample(range(64), r.randint(1, bits + 2)):
                g ^= 1 << b
            fps.append(g)
    fps += [(0xABCDE12345 << 24) ^ r.getrandbits(24) for _ in range(300)]
    fps = sorted({*fps, 0, 1, (1 << 64) - 1})
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= bits]
    want = closure(len(fps), links)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits, blocks, keep, rows)
    found = [(e["u"], e["v"]) for e in edges.collect()]
    at = {s: i for i, s in enumerate(signed)}
    assert closure(len(fps), [(at[a], at[b]) for a, b in found]) == want and len(set(want)) < len(fps)


@pytest.mark.parametrize("leaf,fan,walked", [(16, 8, 1 << 21), (2, 2, 50)])
def test_gray_index_finds_all_pairs(monkeypatch, leaf, fan, walked):
    """Buckets of one, a few and hundreds of rows in one forest."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "FAN_OUT", fan)
    monkeypatch.setattr(simhash, "_WALKED_AT_ONCE", walked)
    r = np.random.default_rng(5)
    fps, first = [], []
    for size in (1, 2, 700, 17, 1, 40):
        base = r.integers(0, 1 << 63, max(1, size // 5), dtype=np.uint64)
        own = np.unique(r.choice(base, 2 * size) ^ np.left_shift(np.uint64(1), r.integers(0, 63, 2 * size).astype(np.uint64)))[:size]
        first.append(sum(map(len, fps)))
        fps.append(own[np.argsort(simhash.gray_rank(own))])
    every = np.concatenate(fps)
    got = [(a, b) for q, x in simhash.GrayForest(every, np.array(first)).all_links(3) for a, b in zip(q.tolist(), x.tolist())]
    ends = [*first[1:], len(every)]
    want = {(i, j) for a, b in zip(first, ends) for i in range(a, b) for j in range(i + 1, b) if int(every[i] ^ every[j]).bit_count() <= 3}
    assert set(got) == want and len(got) == len(want) > 100


def test_gray_index_prunes_whole_groups():
    """Groups that lie far apart: a walk adds up the differences on shared bits and never reaches the others' rows."""
    r = np.random.default_rng(6)
    centres = r.integers(0, 1 << 63, 64, dtype=np.uint64) & np.uint64(0xFFFFFFFFFFFFFF00)
    fps = np.unique((centres[:, None] ^ r.integers(0, 256, (64, 32), dtype=np.uint64)).ravel())
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    reached = []

    class Rows(np.ndarray):
        def __getitem__(self, at):
            reached.append(np.size(at))
            return np.asarray(super().__getitem__(at))

    index = simhash.GrayForest(fps, np.array([0]))
    index.fps = fps.view(Rows)
    q, _ = index.links(np.arange(len(fps)), 3)
    assert len(q) and reached[-1] < len(fps) ** 2 / 20


def test_simhash_dedup_keeps_the_smallest_id(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(9, long, 1), (4, long + " end", 1), (7, long, 1), (5, None, 1), (3, "", 1), (8, "other words here now", 1), (8, "other words here now", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in simhash.simhash_dedup(df).collect())
    near = simhash.fingerprint(long) ^ simhash.fingerprint(long + " end")
    first = 4 if near.bit_count() <= 3 else 7
    assert got[0] == (3, 3, True) and got[2] == (5, 3, False) and got.count((8, 8, True)) == 2
    assert (9, first, False) in got and (7, first, first == 7) in got
    assert simhash.simhash_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_equal_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    r = np.random.default_rng(block)
    centres = r.normal(size=(12, 10))
    vecs = [(c + r.normal(scale=s, size=10)).astype(np.float32).tolist() for c in centres for s in (0.05, 0.2, 0.3, 0.5) for _ in range(4)]
    vecs += [vecs[0]] * 5 + [[2 * x for x in vecs[1]], [0.0] * 10, None, [float("nan")] * 10, [float("inf")] + [0.0] * 9, [None] + [1.0] * 9, [], [1.0, 2.0], [2.0, 4.0]]
    ids = list(range(100, 100 + len(vecs)))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vecs)], "vec_id long, embedding array<float>, uid int")
    got = {x["vec_id"]: x for x in embedding_dedup.embedding_dedup(df, block=block).collect()}
    assert len(got) == len(vecs)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vecs]
    unit = [np.array(v, np.float64) / np.linalg.norm(v) if o else None for v, o in zip(vecs, ok)]
    links = [(i, j) for i in range(len(vecs)) for j in range(i) if ok[i] and ok[j] and len(vecs[i]) == len(vecs[j]) and unit[i] @ unit[j] >= 0.9]
    part = closure(len(vecs), links)
    for i, v in enumerate(ids):
        members = [ids[j] for j in range(len(vecs)) if part[j] == part[i]]
        assert got[v]["n_links"] == sum(i in p for p in links)
        assert got[v]["component_id"] == min(members) and got[v]["kept"] == (v == min(members))


def test_embeddings_in_double_precision(spark):
    angle = np.arccos(0.9)
    near = lambda d: [float(np.cos(angle + d)), float(np.sin(angle + d))]
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, near(1e-10)), (3, near(-1e-10))], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(df).collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def linked(vecs, cosine=0.9):
    """By row number: links and the smallest row reachable, of all pairs."""
    unit = np.array(vecs, np.float64) / np.linalg.norm(np.array(vecs, np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    return near.sum(1).tolist(), closure(len(vecs), np.argwhere(np.triu(near)).tolist())


def rows_of(spark, vecs):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")


def found(df, **options):
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(df, **options).collect())
    return [r[1] for r in got], [r[2] for r in got]


def test_embeddings_are_shuffled_in_proportion_to_the_input(spark):
    """Random directions: no two blocks lie far apart, so every block meets all 20 others."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {x.stageId(): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    vecs = np.random.default_rng(4).normal(size=(4000, 64)).astype(np.float32)
    df = rows_of(spark, vecs.tolist())
    before = written()
    assert found(df, block=200)[0] == [0] * 4000
    assert sum(n for k, n in written().items() if k not in before) < 4 * vecs.nbytes


def test_embeddings_at_the_threshold_and_in_large_groups(spark):
    """64 dimensions, compared on the leading ones first: pairs a little above and below the threshold, differing in any of
    them, and a group whose links fill whole leaves."""
    r = np.random.default_rng(8)
    base = r.normal(size=(700, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    assert embedding_dedup.sifting(np.full(64, 1 / 64), 0.2**0.5) < 40 and embedding_dedup.sifting(np.full(4, 1 / 4), 0.2**0.5) == 4
    away = r.normal(size=base.shape) * (r.random(base.shape) < r.choice([0.03, 1], len(base))[:, None]) + 1e-9 * r.normal(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    angle = np.arccos(0.9) + r.choice([-1e-5, 1e-5, -0.02, 0.02], len(base))
    partners = base * np.cos(angle)[:, None] + away * np.sin(angle)[:, None]
    group = base[:1] + r.normal(size=(600, 64)) * 0.01
    vecs = np.concatenate([base, partners, group]).astype(np.float32)[r.permutation(2000)].tolist()
    assert found(rows_of(spark, vecs), block=500) == linked(vecs)
    assert found(rows_of(spark, vecs[:900]), cosine=0.3, block=100) == linked(vecs[:900], 0.3)


def test_spanning_links_connect_what_all_links_connect():
    r = np.random.default_rng(9)
    known = np.array([[1, 0, 0], [0, 1, 1], [1, 0, 1]], bool)  # the first links of its rows and columns leave two parts
    for near in (known, np.zeros((4, 3), bool), np.ones((5, 8), bool), *[r.random((12, 9)) < p for p in (0.05, 0.15, 0.3) for _ in range(20)]):
        n, m = near.shape
        few = list(zip(*embedding_dedup._spanning(near)))
        assert all(near[a, b] for a, b in few) and (len(few) == n + m or not near.all())
        assert closure(n + m, [(a, n + b) for a, b in few]) == closure(n + m, [(a, n + b) for a, b in np.argwhere(near)])


def test_embeddings_whose_hashes_are_the_same(spark, monkeypatch):
    """The first names stand for several vectors, of one size and of two; zeros of either sign are one value."""
    seeds = []
    name = embedding_dedup._name

    def clashing(seed):
        seeds.append(seed)
        return name(seed) if seed else F.size("vec").cast("long")

    monkeypatch.setattr(embedding_dedup, "_name", clashing)
    vecs = [[0.0, 1.0], [-0.0, 1.0], [1.0, 0.0], [1.0, 0.1], [-1.0, 0.0], [0.0, 1.0]]
    assert found(rows_of(spark, vecs)) == ([2, 2, 1, 1, 0, 2], [0, 0, 2, 2, 4, 0])
    assert set(seeds) == {0, 1}
    monkeypatch.setattr(embedding_dedup, "_name", lambda seed: name(seed) if seed else F.lit(7).cast("long"))
    assert found(rows_of(spark, [*vecs, [1.0], [3.0], [1.0, 0.0, 0.0]])) == ([2, 2, 1, 1, 0, 2, 1, 1, 0], [0, 0, 2, 2, 4, 0, 6, 6, 8])


def test_embeddings_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.embedding_dedup(empty).count() == 0
    zero = spark.createDataFrame([(1, [0.0]), (2, None)], "vec_id long, embedding array<float>")
    assert [r["n_links"] for r in embedding_dedup.embedding_dedup(zero).collect()] == [0, 0]
