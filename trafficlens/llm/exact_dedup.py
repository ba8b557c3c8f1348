"""Exact dedup by deterministic block naming (after Karp, Miller and Rosenberg, 1972), native Spark only.

A text is cut into blocks of fixed size. Distinct blocks are sorted and numbered; then adjacent pairs of
numbers are sorted and numbered in turn, until each document has one number. Two documents of one length have
the same last number if and only if their texts are equal.

Blocks travel as SHA-256 digests, after one pass that groups them by digest and content and so proves that no
two different blocks of this corpus share a digest (if two did, it would stop with an error and not guess).
Copies meet in partial aggregates before each shuffle, so a text that holds a third of all rows is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.util import checkpoint, dealt_anew, number_distinct, text_bytes, with_row_id

BLOCK_BYTES = 4096


def _block_starts(n_bytes: Column, block: int) -> Column:
    """Offsets (from 1) of the blocks; an empty text has one empty block."""
    last = F.greatest(n_bytes - F.lit(1), F.lit(0).cast("long"))
    return F.sequence(F.lit(0).cast("long"), F.floor(last / F.lit(block)))


def _blocks(df: DataFrame, block: int) -> DataFrame:
    """(__rid, __i, __block) for each block of each row."""
    split = df.select("__rid", "__bytes", F.explode(_block_starts(F.octet_length("__bytes").cast("long"), block)).alias("__i"))
    start = (F.col("__i") * F.lit(block) + F.lit(1)).cast("int")
    return split.select("__rid", "__i", F.substring(F.col("__bytes"), start, F.lit(block)).alias("__block"))


def _name_pairs(nodes: DataFrame) -> DataFrame:
    """One level up: (__rid, __key, __i div 2, name of the pair). An odd last node pairs with -1."""
    even = F.col("__i") % 2 == 0
    pairs = nodes.groupBy("__rid", "__left", (F.col("__i").bitwiseAND(F.lit(-2)) / 2).cast("long").alias("__up")).agg(
        F.max(F.when(even, F.col("__name"))).alias("__a"),
        F.coalesce(F.max(F.when(~even, F.col("__name"))), F.lit(-1).cast("long")).alias("__c"),
    )
    names = number_distinct(pairs, ["__a", "__c"], "__name").drop("__n")
    up = pairs.join(names, ["__a", "__c"])
    return up.select("__rid", (F.floor((F.col("__left") + 1) / 2)).cast("long").alias("__left"), F.col("__up").alias("__i"), "__name")


def identities(docs: DataFrame, text: Column, keep: list[str], block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows with a row id, and (__rid, __level, __name): the identity of each row's text.

    Returns (base, identity). base has the columns of `keep` inside the struct __row, so that their names can't clash,
    __rid, __n_bytes and __sha256; it is checkpointed, since row ids must not change when a task runs again.
    """
    raw = with_row_id(docs.select(F.struct(*[docs[c] for c in keep]).alias("__row"), text_bytes(text).alias("__bytes")), "__rid")
    n = F.octet_length("__bytes").cast("long")
    piece = lambda i: F.unhex(F.sha2(F.substring(F.col("__bytes"), (i * F.lit(block_bytes) + F.lit(1)).cast("int"), F.lit(block_bytes)), 256))
    base = checkpoint(
        raw.select(
            "__row",
            "__rid",
            n.alias("__n_bytes"),
            F.sha2("__bytes", 256).alias("__sha256"),
            F.transform(_block_starts(n, block_bytes), piece).alias("__digests"),
        )
    )
    # Proof that digests tell all blocks of this corpus apart. Row ids play no part in it.
    contents = _blocks(raw.select("__rid", "__bytes"), block_bytes).select("__block", F.unhex(F.sha2("__block", 256)).alias("__d"))
    distinct = contents.groupBy("__d", "__block").agg(F.count(F.lit(1)).alias("__n")).select("__d")
    clash = distinct.groupBy("__d").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").limit(1).count()
    if clash:
        raise ArithmeticError("two different blocks share a SHA-256 digest; run again with another block size")

    leaves = base.select("__rid", F.size("__digests").cast("long").alias("__left"), F.posexplode("__digests").alias("__i", "__d"))
    names = number_distinct(leaves, ["__d"], "__name").drop("__n")
    nodes = checkpoint(leaves.join(names, "__d").select("__rid", "__left", F.col("__i").cast("long").alias("__i"), "__name"))
    level, done = 0, []
    while True:
        done.append(nodes.where("__left = 1").select("__rid", F.lit(level).alias("__level"), "__name"))
        rest = nodes.where("__left > 1")
        if rest.isEmpty():
            break
        nodes, level = checkpoint(_name_pairs(rest)), level + 1
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return base, identity


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Name the text of every row and choose which row of each group of equal texts stays.

    Returns one row per input row: all its columns but the text, and keep_id (the largest id of the group),
    group_size, kept, text_sha256, class_name and class_level (the text's name and the level it was given on).
    A null text counts as empty; empty texts equal each other. Null ids are the smallest. Of rows with the same id and
    text one is kept. A very long text is as many blocks. An empty table gives an empty result. Columns of the input
    that have the names of the new ones are replaced; other names, whatever they are, don't clash.
    """
    new = ["keep_id", "group_size", "kept", "text_sha256", "class_name", "class_level"]
    keep = [c for c in docs.columns if c not in new and c != text_col]
    base, identity = identities(docs, docs[text_col], keep, block_bytes)
    named = base.drop("__digests").join(identity, "__rid")
    own = F.col("__row").getField(id_col)
    groups = named.groupBy("__n_bytes", "__level", "__name").agg(
        F.max(F.struct(own.alias("id"), F.col("__rid").alias("rid"))).alias("__top"), F.count(F.lit(1)).alias("__size")
    )
    out = named.join(dealt_anew(groups, "__name"), ["__n_bytes", "__level", "__name"])
    return out.select(
        *[F.col("__row").getField(c).alias(c) for c in keep],
        F.col("__top.id").alias("keep_id"),
        F.col("__size").alias("group_size"),
        (F.col("__rid") == F.col("__top.rid")).alias("kept"),
        F.col("__sha256").alias("text_sha256"),
        F.col("__name").alias("class_name"),
        F.col("__level").alias("class_level"),
    )
