"""Byte-level BPE encoding and decoding with a public rank file.

Each pre-token (a match of the pattern) is encoded by itself: a fold merges, again and again, the leftmost of the
adjacent pairs whose concatenation has the lowest rank. Decoding concatenates the pieces of the ids.

Two forms of the fold give the same ids. `fold_column` is a Spark expression: nested higher-order functions over the
word's byte ranks, with the ranks of pairs in literal lookup tables. `Encoder` does the same in Arrow batches and
remembers the words of its task in a table of bounded size. See the README for why whole texts take the second.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.util import give_back, tables_of

KNOWN_WORDS = 150_000
KNOWN_LENGTH = 64
SHORT = 48
BATCH_BYTES = 2 << 20


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The rank of each piece, from a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _pieces(path: str) -> dict[int, bytes]:
    return {rank: piece for piece, rank in load_ranks(path).items()}


# ---- the fold as a Spark expression ---------------------------------------------------------------------------

_SLOTS = 1 << 18
_MIX = (0x9E3779B1, 0x85EBCA77)


def _slot(key: int, which: int) -> int:
    return (key * _MIX[which] >> 16) % _SLOTS


@lru_cache(maxsize=4)
def _pair_table(path: str) -> tuple[list[int], list[int]]:
    """(left rank, right rank) to the rank of both together, as a cuckoo table: a key is in one of two slots."""
    ranks = load_ranks(path)
    keys, values = [-1] * _SLOTS, [-1] * _SLOTS
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if a is None or b is None:
                continue
            key, value, which = a << 16 | b, rank, 0
            for _ in range(1000):
                at = _slot(key, which)
                keys[at], values[at], key, value = key, value, keys[at], values[at]
                if key < 0:
                    break
                which = 1 if at == _slot(key, 0) else 0
            else:
                raise ValueError("the pair table is too full")
    return keys, values


def _literal(values: list, kind: str) -> Column:
    """A constant array; the optimizer folds it to one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_column(word: Column, path: str) -> Column:
    """The ids of one pre-token (a string column) as array<int>."""
    ranks = load_ranks(path)
    table, ids = (_literal(x, k) for x, k in zip(_pair_table(path), ("bigint", "int")))
    of_byte = _literal([ranks[bytes([b])] for b in range(256)], "int")

    def slot(key: Column, which: int) -> Column:
        return (F.shiftright(key * F.lit(_MIX[which]), 16) % F.lit(_SLOTS)).cast("int")

    def pair(a: Column, b: Column) -> Column:
        key = F.shiftleft(a.cast("long"), 16) + b
        found = lambda k, which: F.get(table, slot(k, which)) == k
        value = lambda k, which: F.get(ids, slot(k, which))
        return _let(key, lambda k: F.when(found(k, 0), value(k, 0)).when(found(k, 1), value(k, 1)))

    def merge(acc: Column) -> Column:
        near = F.zip_with(F.slice(acc, F.lit(1), F.size(acc) - 1), F.slice(acc, F.lit(2), F.size(acc) - 1), pair)
        joined = lambda r, least: _let(
            F.array_position(r, least).cast("int"),
            lambda p: F.concat(F.slice(acc, F.lit(1), p - 1), F.array(least), F.slice(acc, p + 2, F.size(acc))),
        )
        step = _let(near, lambda r: _let(F.array_min(r), lambda least: F.when(least.isNull(), acc).otherwise(joined(r, least))))
        return F.when(F.size(acc) < 2, acc).otherwise(step)

    text = F.hex(word.cast("binary"))
    n = F.octet_length(word)
    byte = lambda i: F.get(of_byte, F.conv(F.substring(text, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int"))
    first = F.transform(F.sequence(F.lit(0), n - 1), byte)
    folded = F.aggregate(F.sequence(F.lit(1), n - 1), first, lambda acc, _: merge(acc))
    return F.when(n == 0, F.array().cast("array<int>")).when(n == 1, first).otherwise(folded)


# ---- the fold in Arrow batches --------------------------------------------------------------------------------


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > SHORT:
        return _fold_long(word, ranks)
    rank, none = ranks.get, len(ranks) + 1
    cuts = list(range(len(word) + 1))  # where parts begin, and the word's end
    near = [rank(word[i : i + 2], none) for i in range(len(word) - 1)]  # ranks of adjacent pairs
    while near:
        least = min(near)
        if least == none:
            break
        i = near.index(least)
        del near[i], cuts[i + 1]
        if i:
            near[i - 1] = rank(word[cuts[i - 1] : cuts[i + 1]], none)
        if i < len(near):
            near[i] = rank(word[cuts[i] : cuts[i + 2]], none)
    return [ranks[word[i:j]] for i, j in zip(cuts, cuts[1:])]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for words without end."""
    n = len(word)
    stop = list(range(1, n + 1))  # where the part that starts at i ends; 0 once it was merged into another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not stop[i] or stop[i] == n or stop[stop[i]] != end:
            continue  # one of the two has changed since
        gone = stop[i]
        stop[gone], stop[i] = 0, end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : stop[end]])) is not None:
                heapq.heappush(heap, (r, i, stop[end]))
        if i:
            left = before[i]
            if (r := ranks.get(word[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
    return [ranks[word[i : stop[i]]] for i in range(n) if stop[i]]


class Encoder(dict):
    """Pre-token to ids (as 32-bit numbers in bytes), as far as known; others are folded when they are asked for.

    Known words are kept in two generations: when the young one is full it becomes the old one, and words that are
    still in use come back from there. So the table is bounded, and frequent words stay in it."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.ranks, self.find = load_ranks(path), regex.compile(pattern).findall
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(fold(word.encode("utf-8"), self.ranks), np.int32).tobytes()
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text))) if text else b""


def _encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this worker process, which lives on from task to task, until another operator comes."""
    return tables_of("byte_bpe", (path, pattern), lambda: Encoder(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>): the token ids of each row's whole text. With `decoded` also the bytes that the ids stand
    for, decoded from them in the same pass, so that one set of Python workers does both.

    Null and empty texts have no ids. Repeated rows are encoded each; other columns are ignored; an empty table
    gives an empty result. `path` must be readable on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def made(batch: pa.RecordBatch, first: int, out: list[bytes]) -> pa.RecordBatch:
        ends = np.r_[0, np.cumsum([len(x) // 4 for x in out])].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out), np.int32)))
        columns = {"id": batch.column(0).slice(first, len(out)), "ids": ids}
        if decoded:
            columns["decoded"] = _decoded(ids, path)
        return pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            first, out, size = 0, [], 0
            for r, text in enumerate(batch.column(1)):
                out.append(encoder.ids(text.as_py()))
                size += len(out[-1])
                if size > BATCH_BYTES:
                    yield made(batch, first, out)
                    first, out, size = r + 1, [], 0
            yield made(batch, first, out)
            batch = out = text = None
            give_back()

    schema = f"id {kind}, ids array<int>" + ", decoded binary" * decoded
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _decoded(ids: pa.Array, path: str) -> pa.Array:
    """The bytes of each list of ids. Row by row: the ids of a whole batch as Python numbers take ten times their size."""
    piece = _pieces(path).__getitem__
    flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    known = ids.is_valid().to_pylist()
    return pa.array([b"".join(map(piece, flat[a:b].tolist())) if k else None for k, a, b in zip(known, ends[:-1], ends[1:])], pa.binary())


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; null ids give null."""

    @F.arrow_udf("binary")
    def pieces(ids: pa.Array) -> pa.Array:
        return _decoded(ids, path)

    return encoded.withColumn(out_col, pieces(F.col(ids_col)))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode whole texts: id, n_tokens, ids_sha256 (of the decimal ids, joined by spaces), decoded_sha256."""
    both = encode(docs, path, pattern, id_col, text_col, decoded=True)
    return both.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def digests_by_fold_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same as digests() by Spark expressions alone.

    Each distinct word of the corpus is folded once, by fold_column; the ids and the bytes they decode to are joined
    back to the words of each row, in order. Words must fit the shuffle, row by row.
    """
    table = sorted(load_ranks(path).items(), key=lambda x: x[1])
    pieces = _literal([piece.hex() for piece, _ in table], "string")
    rows = docs.select(F.struct(F.col(id_col), F.xxhash64(id_col, text_col)).alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = F.regexp_extract_all("__text", F.lit("(?U)" + pattern), F.lit(0))
    words = rows.select("__row", F.posexplode_outer(found).alias("__at", "__word"))
    known = words.where("__word IS NOT NULL").select("__word").distinct().select("__word", fold_column(F.col("__word"), path).alias("__ids"))
    known = known.select(
        "__word", F.array_join(F.col("__ids").cast("array<string>"), " ").alias("__text"), F.size("__ids").alias("__n"),
        F.array_join(F.transform("__ids", lambda i: F.get(pieces, i)), "").alias("__hex"),
    )
    joined = words.join(known, "__word", "left")
    whole = joined.groupBy("__row").agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_tokens"),
        F.sort_array(F.collect_list(F.when(F.col("__word").isNotNull(), F.struct("__at", "__text", "__hex")))).alias("__parts"),
    )
    return whole.select(
        F.col(f"__row.{id_col}").alias(id_col),
        "n_tokens",
        F.sha2(F.array_join("__parts.__text", " "), 256).alias("ids_sha256"),
        F.sha2(F.unhex(F.array_join("__parts.__hex", "")), 256).alias("decoded_sha256"),
    )
