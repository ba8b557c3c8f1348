"""SimHash near-dedup with a Gray-order hierarchical index over fingerprints.

Fingerprints: 64 bits, each set if it is set in over half of the XXH64 values of the text's word shingles.

Links: pairs of distinct fingerprints that differ in at most `max_bits` bits. The 64 bits are cut into blocks;
two fingerprints within `max_bits` agree on `keep` whole blocks for at least one choice of them, so each
fingerprint goes to one bucket per choice and every link meets in some bucket.

All buckets of a task form one index: fingerprints are sorted by bucket and, inside it, by Gray rank, and cut into nodes.
A node factors out the bits that all fingerprints below it share (mask and value), its parents factor out what their
children share, and a bucket is a root, whose mask holds the bucket's key at least. A search walks down from its own
root, adds up the differences on the bits that each node adds to its parent's mask, and prunes the node with all that
lies below it once the sum passes `max_bits`. Every link comes out of that walk, in buckets of two as of thousands.

A bucket beyond `bucket_rows` is dealt out as pairs of chunks, each a task of bounded size, so that no bucket is ever
held by one task and no pair is lost. Copies of a fingerprint are one row, so a group of equal texts makes no bucket
large. A bucket returns only a spanning forest of its links; components are joined up over buckets by
trafficlens.llm.components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.components import components
from trafficlens.llm.util import checkpoint, dealt_anew, partitions

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
BUCKET_ROWS = 1 << 14
#: Keys grow longer once evenly spread buckets would have more rows than this.
MEAN_BUCKET = 1024
LEAF = 16
FAN_OUT = 8
_HASHED_AT_ONCE = 1 << 16
#: Pairs of a query and a row of its bucket that a walk may have before it at once.
_WALKED_AT_ONCE = 1 << 21
#: Word k of a wide fingerprint hashes the XXH64 values again with the k-th of these; the first is the value itself.
_AGAIN = np.random.default_rng(SEED).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D, with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], width: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The XXH64 values of the shingles that begin in [start, stop); fewer than `width` words are one shingle."""
    part = words[start : None if stop is None else stop + width - 1]
    shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(part) >= width else [b" ".join(part)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64)


def hashed_again(h: np.ndarray, k: int) -> np.ndarray:
    if not k:
        return h
    h = (h ^ (h >> np.uint64(31))) * _AGAIN[k]
    return h ^ (h >> np.uint64(29))


def ones(h: np.ndarray) -> np.ndarray:
    """How many of the numbers have each of the 64 bits set. Sums of 255 rows fit a byte, so they are made in bytes."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(axis=0, dtype=np.int64)
    return out + bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def majorities(counts: np.ndarray, n: int) -> np.ndarray:
    """Bits that are set in over half of n numbers, as one unsigned number a row of counts."""
    return np.packbits((2 * counts > n).astype(np.uint8), axis=-1, bitorder="little").view(np.uint64)[..., 0]


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text as an unsigned integer; 0 if it has no word.

    Hashes are counted in pieces of bounded size, so a very long text needs little more memory than its words.
    """
    words = words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _HASHED_AT_ONCE):
        counts += ones(shingle_hashes(words, width, start, min(n, start + _HASHED_AT_ONCE)))
    return int(majorities(counts, n))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col), of(F.col(text_col)).alias("fp"))


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The position of each fingerprint in the Gray sequence (the inverse of i ^ i >> 1)."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayForest:
    """The hierarchical index over the buckets of a task: rows sorted by bucket, then by Gray rank; a root for each bucket."""

    def __init__(self, fps: np.ndarray, first: np.ndarray):
        """`first` has the position of each bucket's first row."""
        self.fps = fps
        self.bucket = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(fps)]))
        # From the leaves up: children from `start` to `stop` on the level below, rows up to `end`, shared mask and value.
        self.levels: list[tuple[np.ndarray, ...]] = []
        starts, counts = first, np.diff(np.r_[first, len(fps)])
        ends, on, off, size = np.arange(1, len(fps) + 1), fps, ~fps, LEAF
        while len(fps) and (not self.levels or counts.max() > 1):
            nodes = -(-counts // size)
            lead = np.cumsum(nodes) - nodes
            start = np.repeat(starts, nodes) + (np.arange(nodes.sum()) - np.repeat(lead, nodes)) * size
            stop = np.r_[start[1:], len(on)]
            on, off, ends = np.bitwise_and.reduceat(on, start), np.bitwise_and.reduceat(off, start), ends[stop - 1]
            self.levels.append((start, stop, ends, on | off, on))
            starts, counts, size = lead, nodes, FAN_OUT

    def links(self, q: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of q, later row of its bucket) that differ in at most `max_bits` bits."""
        node = self.bucket[q]
        acc, above = np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64)
        for start, stop, ends, mask, value in reversed(self.levels):
            fresh = mask[node] & ~above  # what this node factors out beyond its parents
            acc = acc + np.bitwise_count((self.fps[q] ^ value[node]) & fresh)
            on = (acc <= max_bits) & (ends[node] > q + 1)  # each pair is met once, from its first row
            q, node, acc, above = q[on], node[on], acc[on], mask[node[on]]
            width = stop[node] - start[node]
            kid = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            q, acc, above, node = np.repeat(q, width), np.repeat(acc, width), np.repeat(above, width), np.repeat(start[node], width) + kid
        on = node > q
        q, node, acc, above = q[on], node[on], acc[on], above[on]
        on = acc + np.bitwise_count((self.fps[q] ^ self.fps[node]) & ~above) <= max_bits
        return q[on], node[on]

    def all_links(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The links of all buckets, some rows at a time."""
        work = np.cumsum(np.bincount(self.bucket)[self.bucket])
        cuts = np.flatnonzero(np.diff(work // _WALKED_AT_ONCE, prepend=0))
        for q in np.split(np.arange(len(self.fps)), cuts):
            if len(q):
                yield self.links(q, max_bits)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of n positions over the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if np.array_equal(was, label):
            break
    return label


def whole_buckets(frames: Iterator[pd.DataFrame], keys: list[str], run) -> Iterator[pd.DataFrame]:
    """Call `run(rows, first)` with whole buckets of rows that come sorted by `keys`; first: where each bucket begins."""

    def starts(rows: pd.DataFrame) -> np.ndarray:
        k = rows[keys].to_numpy()
        return np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])

    held: pd.DataFrame | None = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        first = starts(frame)
        held, whole = frame.iloc[first[-1] :], frame.iloc[: first[-1]]
        if len(whole):
            yield run(whole, first[:-1])
    if held is not None and len(held):
        yield run(held, np.array([0]))


def sorted_forest(rows: pd.DataFrame, first: np.ndarray) -> tuple[pd.DataFrame, GrayForest]:
    """The rows of whole buckets in the index's order, without buckets of one row, and the index over them."""
    size = np.diff(np.r_[first, len(rows)])
    rows = rows[np.repeat(size > 1, size)]
    size = size[size > 1]
    first = np.cumsum(size) - size
    bucket = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((gray_rank(rows["fp"].to_numpy().view(np.uint64)), bucket))
    rows = rows.iloc[order]
    return rows, GrayForest(rows["fp"].to_numpy().view(np.uint64), first)


def _edges(max_bits: int):
    """The task of a partition: rows (mask, key, one, two, side, fp), sorted by bucket, to spanning edges of its links.

    one and two are the chunks of a dealt-out bucket that meet here (both 0 in other buckets); side is 1 and 2 for their
    rows, and 3 where all rows are compared."""

    def of(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        rows, index = sorted_forest(rows, first)
        fps, out = index.fps.view(np.int64), [np.empty((2, 0), np.int64)]
        if len(fps):
            a, b = (np.concatenate(x) for x in zip(*index.all_links(max_bits)))
            side = rows["side"].to_numpy()
            on = side[a] | side[b] == 3
            a, b = a[on], b[on]
            label = _forest(len(fps), a, b)
            moved = label != np.arange(len(fps))
            out.append(np.stack([fps[moved], fps[label[moved]]]))
        u, v = np.concatenate(out, axis=1)
        return pd.DataFrame({"u": u, "v": v})

    return lambda frames: whole_buckets(frames, ["mask", "key", "one", "two"], of)


def choices(max_bits: int, blocks: int, keep: int, among: int = (1 << 64) - 1) -> list[int]:
    """Masks of `keep` of `blocks` blocks of the bits set in `among`; enough that a pair within max_bits agrees on one."""
    if blocks - keep < max_bits:
        raise ValueError("with so few blocks a pair within max_bits may agree on none of the choices")
    bits = [b for b in range(64) if among >> b & 1]
    cuts = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in bits[cuts[i] : cuts[i + 1]]) for i in range(blocks)]
    return [sum(c) for c in combinations(masks, keep)]


def choose_blocks(n: int, max_bits: int) -> tuple[int, int]:
    """(blocks, keep) for n fingerprints: as few choices as keep a bucket of evenly spread ones at MEAN_BUCKET rows.

    Any choice finds the same links; more fingerprints need longer keys, and so more keys for each."""
    keep = 1
    while n >> (64 * keep // (keep + max_bits)) > MEAN_BUCKET and keep < 4:
        keep += 1
    return keep + max_bits, keep


def _as_long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _signed(mask: int) -> Column:
    return F.lit(_as_long(mask)).cast("long")


def fingerprint_links(
    fps: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None, keep: int | None = None, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp) that connect all that link within `max_bits`.

    `fps` is read more than once: checkpoint it before. Without `blocks` and `keep` they follow from its size."""
    if blocks is None or keep is None:
        blocks, keep = choose_blocks(fps.count(), max_bits)

    masks = F.array(*map(_signed, choices(max_bits, blocks, keep)))
    rows = fps.select("fp", F.explode(masks).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    large = checkpoint(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows))
    one, two, side = (F.lit(x).alias(c) for x, c in ((0, "one"), (0, "two"), (3, "side")))
    if large.isEmpty():
        dealt = rows.select("mask", "key", one, two, side, "fp")
    else:
        sized = rows.join(dealt_anew(large, "key"), ["mask", "key"], "left")
        chunks = F.coalesce(F.ceil(F.col("n") / F.lit(bucket_rows)), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        met = sized.withColumn("chunks", chunks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
        dealt = met.select("mask", "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), side.alias("side"), "fp")
    by = ["mask", "key", "one", "two"]
    spread = dealt.repartition(partitions(fps.sparkSession), *by).sortWithinPartitions(*by)
    return spread.mapInPandas(_edges(max_bits), "u long, v long")


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    blocks: int | None = None,
    keep: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id and kept.

    component_id is the smallest id reachable over links of at most `max_bits` bits; kept is true for the rows
    with that id. Null and empty texts have fingerprint zero and link like any other. Equal fingerprints form
    one vertex, so copies are never paired up. An empty table gives an empty result; other columns are ignored.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col, width).withColumnRenamed(id_col, "__id"))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("__id").alias("rep")))
    edges = fingerprint_links(distinct.select("fp"), max_bits, blocks, keep, bucket_rows)
    found = components(edges)
    # Components carry the smallest fingerprint; what is asked for is the smallest id.
    classes = distinct.join(found, distinct.fp == found.vertex, "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component")
    )
    least = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = classes.join(dealt_anew(least, "component"), "component").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("__id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        (F.col("__id") == F.col("component_id")).alias("kept"),
    )
