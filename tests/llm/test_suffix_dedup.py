import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trafficlens.llm import suffix_dedup as sd

W = 64


def brute(texts, window):
    """Spans of bytes covered by a window that starts at two places or more."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + window] for d in data for p in range(len(d) - window + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - window + 1):
            if seen[d[p : p + window]] > 1:
                covered[p : p + window] = True
        edges = np.flatnonzero(np.diff(np.r_[False, covered[:-1], False].astype(int)))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist())))
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [prose(k) for k in (6, 12, 30, 60)]
    texts = []
    for _ in range(n):
        kind = r.random()
        t = prose(r.randint(1, 120))
        if kind < 0.4:
            at = r.randint(0, len(t))
            t = t[:at] + r.choice(passages) + t[at:]
        elif kind < 0.5 and texts:
            t = r.choice(texts)
        elif kind < 0.6 and texts:
            t = r.choice(texts)
            t = t[: len(t) // 2] + "~" + t[len(t) // 2 :]
        texts.append(t)
    texts += ["", None, "short", "a" * 300, "ab" * 200, "xa" * 100, "a" * 63, "\0" * 100, prose(3) + passages[3] + passages[3]]
    return texts


def run(spark, texts, **kw):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = {r["doc_id"]: r for r in sd.substring_dedup(df, window=W, **kw).collect()}
    assert len(out) == len(texts)
    return out


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, {"shard_bytes": 300}), (3, {"hot_runs": 2}), (4, {"shard_bytes": 200, "hot_runs": 8})])
def test_equals_brute_force(spark, seed, kw):
    texts = corpus(seed)
    out = run(spark, texts, **kw)
    for i, want in enumerate(brute(texts, W)):
        data = (texts[i] or "").encode()
        assert [(s["start"], s["stop"]) for s in out[i]["spans"]] == want, (i, texts[i])
        assert out[i]["n_bytes"] == len(data)
        edges = [0, *(e for s in want for e in s), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
        assert hashlib.sha256(bytes(out[i]["kept"])).digest() == hashlib.sha256(kept).digest()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sd.substring_dedup(empty).count() == 0


def test_suffix_array_is_sorted_and_prefixes_are_right():
    r = random.Random(5)
    segments = [bytes(r.choice(b"ab") for _ in range(r.randint(70, 200))) for _ in range(30)]
    shard = sd.Shard(segments, W)
    text = b"".join(segments) + bytes(2 * W)
    ordered = [text[s : s + W] for s in shard.sa]
    assert ordered == sorted(ordered)
    lcp = shard.common_prefixes()
    for a, b in zip(shard.sa[:-1], shard.sa[1:]):
        k = next((k for k in range(W) if text[a + k] != text[b + k]), W)
        assert lcp[b] == k


def test_windows_repeated_across_text_chunks(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 100)
    texts = corpus(7, 10)
    for t in texts:
        data = (t or "").encode()
        covered = [p for _, a, b, _ in zip(*sd.runs_of(data, W)) for p in range(a, b + 1)]
        assert covered == list(range(max(0, len(data) - W + 1)))
