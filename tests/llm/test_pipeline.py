"""Each stage of the pipeline against brute force, and the whole of it."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from tests.llm.test_similar import brute
from trafficlens.llm import byte_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The small documents, and nulls, empty and letterless texts, copies, near copies and repeated rows."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    r = random.Random(1)
    top = max(x[0] for x in rows)
    long = [x for x in rows if len(x[1].split()) > 150][:20]
    for x in long:
        words = x[1].split(" ")
        words[r.randrange(len(words))] = "changed"
        rows += [(top + 1, " ".join(words), x[2], x[3], x[4]), (top + 2, x[1], x[2], x[3], x[4])]
        top += 2
    rows += [(top + 1, None, None, None, None), (top + 2, "", "en", "src1", 0), (top + 3, "12 34 !!", "en", "src2", 8), rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(3)


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_language_stage_drops_only_texts_without_a_language(spark, docs):
    kept = cp.language(spark, docs, SF)
    assert kept.columns == docs.columns
    before, after = Counter(plain(docs)), Counter(plain(kept))
    assert not after - before
    assert all(not any(c.isalpha() for c in t or "") for _, t in before - after)
    assert all(any(c.isalpha() for c in t or "") for _, t in after)


def test_exact_stage_keeps_the_largest_id(spark, docs):
    kept = cp.exact(spark, docs, SF)
    assert kept.columns == docs.columns
    top = {}
    for i, t in plain(docs):
        top[t or ""] = max(top.get(t or "", -1), i)
    assert sorted((i, t or "") for i, t in plain(kept)) == sorted((i, t) for t, i in top.items())


def test_near_stage_keeps_one_of_each_group(spark, docs):
    rows = [(i, t) for i, t in dict(plain(docs)).items()]
    want = brute(rows)
    assert {i for i, _ in plain(cp.near(spark, docs, SF))} == {i for i in want if want[i] == i}
    assert len(set(want.values())) < len(want) - 10


def test_mixture_stage_takes_whole_documents(spark, docs):
    distinct = cp.exact(spark, docs, SF)
    taken = cp.mixture(spark, distinct, SF)
    assert taken.columns == docs.columns
    source = dict(plain(distinct))
    copies = Counter(plain(taken))
    assert all(source[i] == t and n <= cp.EPOCHS for (i, t), n in copies.items())
    total = sum(len((t or "").split()) for t in source.values())
    got = sum(len((t or "").split()) * n for (_, t), n in copies.items())
    assert 0.8 * total <= got <= 1.05 * total


def test_token_stage_round_trips(spark, docs):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path(cp.BYTE_RANKS)), special_tokens={})
    texts = dict(plain(docs))
    rows = cp.tokens(spark, docs, SF).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == enc.encode_ordinary(t) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_stages_on_an_empty_table(spark, docs):
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run_equals_the_stages_one_by_one(spark):
    step = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        step = stage(spark, step, SF)
    want = Counter(r["doc_id"] for r in step.collect())
    assert Counter(r["doc_id"] for r in cp.run(spark, SF).collect()) == want
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mixture", "byte_bpe"]
