"""Nulls, empty and long texts, repeated rows, clashing column names and empty tables, for every operator and stage."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from trafficlens.llm import byte_bpe, mixing
from trafficlens.llm import queries as q
from trafficlens.llm.embedding_dedup import embedding_dedup
from trafficlens.llm.exact_dedup import exact_dedup
from trafficlens.llm.language_id import identify
from trafficlens.llm.simhash import simhash_dedup
from trafficlens.llm.similar import simhash_similar
from trafficlens.llm.suffix_dedup import substring_dedup
from trafficlens.llm.token_count import count_tokens
from trafficlens.llm.url_filter import filter_urls

#: Names that operators use inside or return.
EXTRA = ["key", "row", "id", "fp", "n", "kept", "score", "held_out", "lang_pred", "component_id", "copies", "ids", "decoded", "sha",
         "__rid", "__name", "__id", "__bytes", "words", "vertex", "tx", "n_tokens", "n_bytes", "spans", "host", "path", "verdict", "vec"]
LONG = "long text of many words " * 3000
ROWS = [(1, "the cat and the dog", "en", "src0", 1), (2, None, None, None, None), (3, "", "en", "src1", 0), (None, "der hund und die katze", "de", "src2", 2),
        (4, LONG, "en", "src0", 9), (5, LONG, "en", "src0", 9), (1, "the cat and the dog", "en", "src0", 1), (1, "the house of the dog", "en", "src0", 1)]

DOCUMENT_OPERATORS = {
    "op1": simhash_dedup,
    "op1_similar": simhash_similar,
    "op2": substring_dedup,
    "op3": lambda d: count_tokens(d, public_tokenizers.path(q.TOKENIZER)),
    "op4": lambda d: mixing.mix(d, q.mix_levels(), q.MIX_WEIGHTS, q.word_count()),
    "op7": lambda d: identify(d, public_tokenizers.path(q.PIECES)),
    "op8": exact_dedup,
    "op10": lambda d: byte_bpe.digests(d, public_tokenizers.path(q.BYTE_RANKS), public_tokenizers.PATTERN),
}


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("extra").alias(c) for c in EXTRA])


@pytest.mark.parametrize("name", DOCUMENT_OPERATORS)
def test_document_operators(spark, name):
    got = [r["doc_id"] for r in DOCUMENT_OPERATORS[name](documents(spark)).collect()]
    assert Counter(got) == Counter(r[0] for r in ROWS)
    assert DOCUMENT_OPERATORS[name](documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages(spark, name):
    stage, docs = dict(cp.STAGES)[name], documents(spark)
    out = stage(spark, docs, "")
    got = Counter(r["doc_id"] for r in out.collect())
    if name != "byte_bpe":
        assert out.columns == docs.columns
    want = {
        "language_id": {1: 3, None: 1, 4: 1, 5: 1},
        "exact_dedup": {1: 2, 3: 1, None: 1, 5: 1},
        "simhash_near_dedup": {1: 3, 2: 1, None: 1, 4: 1},
        "byte_bpe": {1: 3, 2: 1, 3: 1, None: 1, 4: 1, 5: 1},
    }
    assert got == want[name] if name in want else 2 not in got and 3 not in got and max(got.values()) <= 3 * cp.EPOCHS
    assert stage(spark, documents(spark, []), "").count() == 0


def test_urls_and_vectors(spark):
    rows = [(1, "http://a.com/x", "<p>word"), (None, None, None), (1, "http://a.com/x", "<p>word"), (2, "no url", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("extra").alias(c) for c in EXTRA])
    for rules in ([], [q.parse_rule(r) for r in q.RULES]):
        got = filter_urls(pages, rules).collect()
        assert Counter(r["page_id"] for r in got) == {1: 2, 2: 1, None: 1} and {r["verdict"] for r in got} <= {"allow", "block"}
        assert filter_urls(pages.limit(0), rules).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = embedding_dedup(vectors.select("*", *[F.lit("extra").alias(c) for c in EXTRA])).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got) == [(1, 1), (1, 1), (2, 0)]


@pytest.mark.parametrize("weights,want", [({("a",): 0.7, ("b",): 0.3}, (70, 30)), ({("a",): 0, ("b",): 2.5}, (0, 100)), ({("a",): 1.5, ("b",): 1.9}, (44, 55))])
def test_fractional_and_zero_weights(spark, weights, want):
    df = spark.createDataFrame([(k, "w", "ab"[k % 2]) for k in range(1000)], "doc_id long, text string, source string")
    out = mixing.mix(df, {"source": F.col("source")}, weights, F.lit(1), total=F.lit(100))
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert (got["a"], got["b"]) == want


def test_weights_below_zero_are_refused(spark):
    with pytest.raises(ValueError):
        mixing.mix(documents(spark), q.mix_levels(), {("web",): -1}, q.word_count())
