"""A training-data pipeline: five stages over `documents`, each with one operator of trafficlens.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents, and
only documents that the stage keeps; the last returns one row of token ids and digests for each document left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import byte_bpe, language_id
from trafficlens.llm.exact_dedup import exact_dedup
from trafficlens.llm.mixing import mix
from trafficlens.llm.queries import BYTE_RANKS, MIX_SEED, PIECES, mix_levels, word_count
from trafficlens.llm.similar import simhash_similar
from trafficlens.llm.util import checkpoint
from trafficlens.session import table

#: A text goes if it has no letter, or if no language reaches this posterior.
LEAST_SCORE = 0.5
#: Near copies: sets of five-word shingles with a Jaccard similarity of at least 4/5.
SHINGLE_WORDS, LEAST_SIMILARITY = 5, (4, 5)
#: Target weights: the budget is as many tokens as there are, in up to four epochs.
WEIGHTS = {("web",): 3, ("forum",): 2, ("reference",): 2, ("web", "en"): 3, ("web", "en", "src0"): 4}
EPOCHS = 4


def keyed(docs: DataFrame) -> DataFrame:
    """(key, row, doc_id, text): rows with equal ids and texts share a key; a null id or text has one too. The whole row is
    in a struct, so that no extra column clashes with those of an operator."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(text.cast("binary"), 256))
    return docs.select(key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text")


def rows_of(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is clear. Null, empty and letterless texts have none. Whole texts are judged,
    however long; repeated rows and ties are judged alike, so all of them stay or go."""
    judged = language_id.identify(keyed(docs).withColumn("lang", F.col("row.lang")), public_tokenizers.path(PIECES))
    return rows_of(judged.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts keep the one with the largest doc_id (null ids are the smallest; a null text equals
    an empty one); of rows with equal ids and texts, any one. Texts are compared whole, however long."""
    found = exact_dedup(docs.select("doc_id", "text")).where("kept")
    stay = found.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256").alias("key"))
    once = keyed(docs).groupBy("key").agg(F.first("row").alias("row"))  # repeats meet before the shuffle
    return rows_of(once.join(stay, "key", "left_semi"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document with the smallest doc_id; null ids only where there is no other.
    Null and wordless texts are one group. Rows with equal ids and texts stay or go together."""
    found = simhash_similar(docs.select("doc_id", "text"), width=SHINGLE_WORDS, least=LEAST_SIMILARITY).where("kept")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lower(F.hex("text_sha256")))
    return rows_of(keyed(docs).join(found.select(key.alias("key")).distinct(), "key", "left_semi"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents to the target weights; a document that is taken in several epochs comes as often. Null, empty and
    wordless texts have no token and are never taken. Rows with equal ids and texts come as often as the least of them."""
    rows = keyed(docs).withColumn("source", F.col("row.source")).withColumn("lang", F.col("row.lang"))
    taken = mix(rows, mix_levels(), WEIGHTS, word_count(), max_epochs=EPOCHS, seed=MIX_SEED, id_col="key")
    times = taken.groupBy("key").agg(F.min("copies").alias("copies")).where("copies > 0")
    spread = keyed(docs).join(times, "key").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows_of(spread, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's whole text, and digests that show that they decode to it. Null texts count as empty
    and have no token; repeated rows are encoded each; other columns are ignored."""
    rows = docs.select("doc_id", "text")
    both = byte_bpe.encode(rows, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixture", mixture),
    ("byte_bpe", tokens),
]

#: SQL can't express language ID or fingerprints; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after another, each from the files of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
