"""No language's words are crowded out by those of others, and words seen once count."""

import public_tokenizers
from trafficlens.llm import language_id as li
from trafficlens.llm.util import most_frequent

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_most_frequent_breaks_ties_by_the_word(spark):
    rows = [(f"w{k:03}", 2) for k in range(200)] + [("top", 9)]
    got = most_frequent(spark.createDataFrame(rows, "word string, n long").repartition(5), "n", "word", 100).collect()
    assert {r["word"] for r in got} == {"top", *(f"w{k:03}" for k in range(99))}


def test_rare_language_and_words_seen_once_are_learned(spark):
    many = [("the cat and the dog of the house", "en")] * 60 + [("der hund und die katze der stadt", "de")] * 60
    rows = [*many, ("gato perro ciudad", "es"), ("les chats rouges", "fr")]
    pieces = li.load_pieces(PIECES)
    langs, probs = li.fit(spark.createDataFrame(rows, "text string, lang string"), pieces)
    assert langs == ["de", "en", "es", "fr"]
    texts = spark.createDataFrame([("perro ciudad",), ("chats rouges",), ("the house",)], "text string")
    assert [x["lang_pred"] for x in li.predict(texts, pieces, langs, probs).collect()] == ["es", "fr", "en"]


def test_more_labels_than_the_model_holds(spark, monkeypatch):
    monkeypatch.setattr(li, "MAX_LANGUAGES", 2)
    rows = [("aa bb", "x"), ("aa", "x"), ("cc dd", "y"), ("cc", "y"), ("ee", "z"), ("a" * 300, "x"), ("aa", "x")]
    langs, _ = li.fit(spark.createDataFrame(rows, "text string, lang string"), ["▁", "a", "b", "c", "d", "e"])
    assert langs == ["x", "y"]


def test_sample_has_its_rows_from_each_language(spark, monkeypatch):
    monkeypatch.setattr(li, "FIT_ROWS", 100)
    rows = [(f"big {k}", "big") for k in range(3000)] + [(f"few {k}", "few") for k in range(30)] + [("copy", "big")] * 1000 + [(None, "big"), ("x", None)]
    picks = []
    for parts in (1, 6):
        langs, got = li.sample(spark.createDataFrame(rows, "text string, lang string").repartition(parts), "text", "lang")
        picks.append(sorted((r["text"], r["lang"]) for r in got.collect()))
    assert langs == ["big", "few"] and picks[0] == picks[1]
    assert sum(lang == "few" for _, lang in picks[0]) == 30 and 50 < sum(lang == "big" for _, lang in picks[0]) < 150
