"""SimHash near-dedup at a given Jaccard similarity of word shingles: fingerprints propose, the shingles decide.

A text has a fingerprint of `WORDS` 64-bit numbers, each the majority bits of another hash of its shingles. A bit of two
texts of similarity s differs with probability arccos(2s / (1 + s)) / pi, 0.15 at s = 0.8: far more than `simhash_dedup`
allows, so blocks that must agree whole would be a few bits long. Instead each of several seeded samples of bits is a
bucket key. There are as many samples as keep a pair right at the least similarity from being missed more often than
`MISS`; pairs of greater similarity are missed less. Larger tables have longer samples, and so more of them.

In a bucket, the Gray-order index over the next number of the fingerprint finds the pairs within the number of bits that
such a pair stays below with probability `WITHIN`. A pair so proposed whose whole fingerprints differ in few enough bits
(`WHOLE_WITHIN`) links if its sets of shingles are similar enough, by counting. Where more than `SMALL` rows of a bucket
hang together, only their links with their hub are proposed, the row nearest to the majority of their bits, so most of a
large group of near copies becomes one component by as many pairs as it has rows. What such groups still have in several
components meets as texts, never as a list of pairs: groups around one largest component are one, its texts are dealt out
as cells of two blocks, and a cell has the whole fingerprints and the sets of its texts. It compares those in different
components, joins them as it goes, and returns links that connect what belongs together: fewer than it has texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import acos, ceil, comb, log, log2, pi

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm import simhash
from trafficlens.llm.components import components
from trafficlens.llm.simhash import BUCKET_ROWS, SEED, _forest, hashed_again, majorities, ones, shingle_hashes, words_of
from trafficlens.llm.util import checkpoint, dealt_anew, given_back, partitions, with_row_id

SHINGLE_WORDS = 5
#: The least similarity of a link, as a fraction, so that a pair right on it is judged without rounding.
LEAST = (4, 5)
WORDS = 8
MISS = 0.005
WITHIN = 0.97
#: The share of pairs right at the least similarity whose whole fingerprints are near enough; the rest is part of MISS.
WHOLE_WITHIN = 0.998
#: The samples are so long that a bucket of evenly spread fingerprints has about so many rows.
MEAN_BUCKET = 64
SMALL = 8
#: Texts in a block of those whose sets of shingles are compared.
BLOCK_TEXTS = 2048
#: Texts in a block of a large group, and shingles that are looked up at once.
GROUP_BLOCK = 1024
_COUNTED_AT_ONCE = 1 << 20
#: So many digests of texts, 40 bytes each, may go to all executors.
BROADCAST_ROWS = 1_000_000


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct XXH64 values of the text's shingles, sorted. Fewer than `width` words are one shingle, none an empty set."""
    words = words_of(text)
    return np.unique(shingle_hashes(words, width)) if words else np.empty(0, np.uint64)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WORDS numbers of 64 bits from a set of shingles; zero for an empty set."""
    counts = np.zeros((WORDS, 64), np.int64)
    for at in range(0, len(shingles), simhash._HASHED_AT_ONCE):
        part = shingles[at : at + simhash._HASHED_AT_ONCE]
        for k in range(WORDS):
            counts[k] += ones(hashed_again(part, k))
    return majorities(counts, len(shingles))


def differing(least: tuple[int, int]) -> float:
    """The chance that a bit of the fingerprints of two texts differs if their sets of shingles have this similarity."""
    s = least[0] / least[1]
    return acos(2 * s / (1 + s)) / pi


def radius(bits: int, least: tuple[int, int], within: float) -> int:
    """The number of differing bits, of so many, that a pair right at the least similarity stays at or below this often."""
    d = differing(least)
    chance = (comb(bits, k) * d**k * (1 - d) ** (bits - k) for k in range(bits + 1))
    return next(k for k, p in enumerate(accumulate(chance)) if p >= within)


def samples(n: int, least: tuple[int, int]) -> tuple[list[tuple[int, int]], int]:
    """([(number of the fingerprint, mask of its bits)], max_bits): the bucket keys for n texts, and the index's radius."""
    d = differing(least)
    max_bits = radius(64, least, WITHIN)
    size = min(32, max(4, ceil(log2(max(n, 1) / MEAN_BUCKET)) if n > MEAN_BUCKET else 4))
    times = ceil(log(MISS - (1 - WHOLE_WITHIN)) / log(1 - (1 - d) ** size * WITHIN))
    r = np.random.default_rng(SEED)
    return [(t % WORDS, sum(1 << int(b) for b in r.choice(64, size, replace=False))) for t in range(times)], max_bits


def text_sha(text_col: str = "text") -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def _described(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, sha, digest, n, words) of each row: SHA-256 of the text; digest, size and fingerprint of its shingle set."""

    @F.pandas_udf("digest binary, n long, words array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from given_back(map(described, batches))

    def described(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            s = shingle_set(t, width)
            out.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), wide_fingerprint(s).view(np.int64)))
        return pd.DataFrame(out, columns=["digest", "n", "words"])

    return docs.select(F.col(id_col).alias("id"), text_sha(text_col).alias("sha"), of(F.col(text_col)).alias("of")).select("id", "sha", "of.*")


def _pairs_within(rows: pd.DataFrame, index, max_bits: int, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that the index finds within `max_bits`, of sizes that can link."""
    p, q = least
    n = rows["n"].to_numpy()
    found = [np.empty((2, 0), np.int64)]
    for a, b in index.all_links(max_bits) if len(rows) else ():
        on = q * np.minimum(n[a], n[b]) >= p * np.maximum(n[a], n[b])
        found.append(np.stack([a[on], b[on]]))
    return tuple(np.concatenate(found, axis=1))


def _hubs(fps: np.ndarray, vertex: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each row, the position of the row nearest to the majority bits of its label's rows; of equal ones the smallest vertex."""
    order = np.lexsort((vertex, label))
    start = np.flatnonzero(np.diff(label[order], prepend=-1))
    many = np.diff(np.r_[start, len(order)])
    bits = np.unpackbits(fps[order].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = majorities(np.add.reduceat(bits, start, axis=0, dtype=np.int64), many[:, None])
    off = np.bitwise_count(fps[order] ^ np.repeat(most, many))
    near = np.lexsort((np.arange(len(order)), off, label[order]))  # within a label: by distance, then by vertex
    hub = np.empty(len(order), np.int64)
    hub[order] = np.repeat(order[near[start]], many)
    return hub


def _first(max_bits: int, least: tuple[int, int]):
    """The task of a partition: rows (key, one, whole, vertex, n, fp), sorted by bucket, to pairs (u, v) that may link.

    What up to SMALL rows of a bucket propose are all their pairs. More rows that hang together each propose their hub,
    and come out themselves as rows (key, u) of a group that is not settled; so do all rows of a large bucket."""

    def of(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        rows, index = simhash.sorted_forest(rows, first)
        a, b = _pairs_within(rows, index, max_bits, least)
        label = _forest(len(rows), a, b)
        size = np.bincount(label, minlength=len(rows))[label]
        few = size[a] <= SMALL
        vertex = rows["vertex"].to_numpy()
        many = np.flatnonzero(size > SMALL)
        hub = many[_hubs(index.fps[many], vertex[many], label[many])] if len(many) else many
        many, hub = many[many != hub], hub[many != hub]
        a, b = np.r_[a[few], many], np.r_[b[few], hub]
        pairs = pd.DataFrame({"key": 0, "u": np.maximum(vertex[a], vertex[b]), "v": np.minimum(vertex[a], vertex[b])})
        whole = rows["whole"].to_numpy()
        open_ = np.flatnonzero((size > SMALL) | ~whole)
        key = rows["key"].to_numpy()[open_] ^ np.where(whole, vertex[label], 0)[open_] * 0x9E3779B97F4A7C1  # any number that tells groups apart
        rest = pd.DataFrame({"key": key, "u": vertex[open_], "v": -1})
        return pd.concat([pairs.drop_duplicates(), rest])

    return lambda frames: given_back(simhash.whole_buckets(frames, ["key", "one"], of))


def _propose(buckets: DataFrame, max_bits: int, least: tuple[int, int], bucket_rows: int) -> DataFrame:
    """(key, u, v): the pairs (v >= 0) and the rows that are not settled (v = -1).

    Each bucket is one task or, if it is large, several of a chunk each, which differ from sample to sample."""
    large = checkpoint(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > bucket_rows))
    if large.isEmpty():
        dealt = buckets.select("key", F.lit(0).alias("one"), F.lit(True).alias("whole"), "vertex", "n", "fp")
    else:
        sized = buckets.join(dealt_anew(large, "key"), "key", "left")
        chunk = F.pmod(F.xxhash64("key", "vertex"), F.ceil(F.col("m") / F.lit(bucket_rows))).cast("int")
        dealt = sized.select("key", F.coalesce(chunk, F.lit(0)).alias("one"), F.col("m").isNull().alias("whole"), "vertex", "n", "fp")
    spread = dealt.repartition(partitions(buckets.sparkSession), "key", "one").sortWithinPartitions("key", "one")
    return checkpoint(spread.mapInPandas(_first(max_bits, least), "key long, u long, v long"))


def _joined(rows: pd.DataFrame, whole: int, least: tuple[int, int]) -> list[tuple[int, int]]:
    """Positions of links that connect all rows of a cell that links connect and that c does not.

    side is 1 and 2 for the two blocks that meet, and 3 for rows that are compared with all. Each row is compared with all
    later ones that are in another component by then and near enough by size and whole fingerprint."""
    p, q = least
    n, side = rows["n"].to_numpy(), rows["side"].to_numpy()
    label = np.unique(rows["c"].to_numpy(), return_inverse=True)[1]
    words = np.stack(rows["words"].to_numpy()).view(np.uint64)  # of negative numbers, numpy would count the bits of the magnitude
    known, codes = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in rows["shingles"]]), return_inverse=True)
    start, mine, links = np.cumsum(n) - n, np.zeros(len(known), bool), []
    for k in range(len(rows) - 1):
        can = (label[k + 1 :] != label[k]) & (side[k + 1 :] | side[k] == 3) & (q * np.minimum(n[k + 1 :], n[k]) >= p * np.maximum(n[k + 1 :], n[k]))
        on = np.flatnonzero(can) + k + 1
        on = on[np.bitwise_count(words[on] ^ words[k]).sum(axis=1, dtype=np.int64) <= whole]
        own = codes[start[k] : start[k] + n[k]]
        mine[own] = True
        for part in np.split(on, np.flatnonzero(np.diff(np.cumsum(n[on]) // _COUNTED_AT_ONCE, prepend=0))):
            part = part[label[part] != label[k]]
            if not len(part):
                continue
            many = n[part]
            lead = np.cumsum(many) - many
            at = np.repeat(start[part] - lead, many) + np.arange(many.sum())
            both = np.add.reduceat(mine[codes[at]], lead, dtype=np.int64)
            for j in part[(p + q) * both >= p * (many + n[k])]:
                if label[j] != label[k]:
                    links.append((k, j))
                    label[label == label[j]] = label[k]
        mine[own] = False
    return links


def _rest(rows: DataFrame, least: tuple[int, int]) -> DataFrame:
    """(u, v): of rows (key, one, two, side, vertex, n, c, words, shingles), links that connect what links connect in each cell."""
    whole = radius(64 * WORDS, least, WHOLE_WITHIN)

    def of(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        vertex, found = rows["vertex"].to_numpy(), [np.empty((0, 2), np.int64)]
        for start, stop in zip(first, np.r_[first[1:], len(rows)]):
            links = _joined(rows.iloc[start:stop], whole, least)
            found.append(vertex[start + np.array(links, np.int64).reshape(-1, 2)])
        u, v = np.concatenate(found).T
        return pd.DataFrame({"u": u, "v": v})

    by = ["key", "one", "two"]
    spread = rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    return spread.mapInPandas(lambda frames: given_back(simhash.whole_buckets(frames, by, of)), "u long, v long")


def _remaining(groups: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """(key, one, two, side, vertex, c): rows (key, vertex) of groups with several components, dealt out to cells so that any
    two rows of one group and of different components meet.

    Groups with the same largest component (of equal ones the one of the largest number) become one under its name, so the
    groups that the same texts form in many samples are dealt out once. Where that has more than `block` texts, those of the
    largest component are compared with the others only, not with each other."""
    now = groups.join(dealt_anew(found, "vertex"), "vertex", "left").select("key", "vertex", F.coalesce("component", "vertex").alias("c"))
    now = checkpoint(now)
    each = now.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    tops = each.groupBy("key").agg(F.max(F.struct("m", "c"))["c"].alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    rows = now.join(dealt_anew(tops, "key"), "key").select(F.col("top").alias("key"), "vertex", "c").distinct()
    rows = checkpoint(rows)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("c") == F.col("key")).alias("tops"))
    rows = rows.join(dealt_anew(sizes, "key"), "key")
    large = F.col("m") > block
    chunks = lambda m: F.greatest(F.lit(1), F.ceil(m / F.lit(block))).cast("int")
    rows = rows.select(
        "key", "vertex", "c", (large & (F.col("c") == F.col("key"))).alias("inside"),
        F.when(large, chunks(F.col("tops"))).otherwise(0).alias("inner"),
        F.when(large, chunks(F.col("m") - F.col("tops"))).otherwise(1).alias("outer"),
    )
    rows = rows.withColumn("own", F.pmod(F.xxhash64("vertex"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    # Tasks: two chunks of the others (or one and itself), and a chunk of the others with one of the largest component.
    task = lambda one, two, side: F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"), side.cast("int").alias("side"))
    own, outer, inner = F.col("own"), F.sequence(F.lit(1), F.col("outer")), F.filter(F.sequence(F.lit(0), F.col("inner")), lambda k: k > 0)
    others = F.transform(outer, lambda k: task(
        F.least(own, k - 1), F.greatest(own, k - 1), F.when(k - 1 == own, 3).when(own < k - 1, 1).otherwise(2)))
    with_inner = F.transform(inner, lambda k: task(own, -k, F.lit(1)))
    with_outer = F.transform(outer, lambda k: task(k - 1, -1 - own, F.lit(2)))
    tasks = F.when(F.col("inside"), with_outer).otherwise(F.concat(others, with_inner))
    return rows.select("key", F.explode(tasks).alias("t"), "vertex", "c").select("key", "t.*", "vertex", "c")


def _near(pairs: DataFrame, vertices: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose whole fingerprints differ in few enough bits."""
    left = vertices.select(F.col("vertex").alias("u"), F.col("words").alias("a"))
    right = vertices.select(F.col("vertex").alias("v"), F.col("words").alias("b"))
    off = sum((F.bit_count(F.col("a")[k].bitwiseXOR(F.col("b")[k])) for k in range(WORDS)), F.lit(0))
    return pairs.join(left, "u").join(right, "v").where(off <= radius(64 * WORDS, least, WHOLE_WITHIN)).select("u", "v")


def _linked(pairs: DataFrame, sets: DataFrame, blocks: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose sets (vertex, shingles: sorted numbers as bytes) are similar enough: i / (m + n - i) >= p / q.

    A pair is counted in the cell of its texts' blocks, a bounded number of texts each. So a text with very many pairs
    is dealt out over cells, and its set comes to each of them once."""
    p, q = least
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    cells = pairs.select(block("u").alias("one"), block("v").alias("two"), "u", "v")
    called = cells.select("one", "two", F.explode(F.array("u", "v")).alias("vertex")).distinct()
    brought = called.join(sets, "vertex").select("one", "two", F.col("vertex").alias("u"), F.lit(-1).cast("long").alias("v"), "shingles")

    def of(rows: pd.DataFrame, first: np.ndarray) -> pd.DataFrame:
        cell = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(rows)]))
        u, v, shingles = (rows[x].to_numpy() for x in ("u", "v", "shingles"))
        have = {(cell[k], u[k]): np.frombuffer(shingles[k], np.uint64) for k in np.flatnonzero(v < 0)}

        def links(k: int) -> bool:
            x, y = have[cell[k], u[k]], have[cell[k], v[k]]
            return (p + q) * len(np.intersect1d(x, y, assume_unique=True)) >= p * (len(x) + len(y))

        on = [k for k in np.flatnonzero(v >= 0) if links(k)]
        return pd.DataFrame({"u": u[on], "v": v[on]}, dtype=np.int64)

    rows = brought.unionByName(cells.withColumn("shingles", F.lit(None).cast("binary")))
    spread = rows.repartition(partitions(rows.sparkSession), "one", "two").sortWithinPartitions("one", "two")
    return spread.mapInPandas(lambda frames: given_back(simhash.whole_buckets(frames, ["one", "two"], of)), "u long, v long")


def simhash_similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE_WORDS,
    least: tuple[int, int] = LEAST,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per input row: id, text_sha256 (binary), component_id and kept.

    component_id is the smallest id reachable over links; kept is true for the rows with that id. Null and empty texts
    are one vertex, as are texts with equal shingle sets. Null ids stay null and are the smallest only where a component
    has no other; such rows are then kept. Repeated rows are all kept or all not. An empty table gives an empty result;
    other columns, whatever their names, are ignored. Very long texts cost memory for their own words. `docs` is read
    twice: only texts that are in a proposed pair have their shingles sent anywhere.
    """
    rows = checkpoint(_described(docs, id_col, text_col, width))
    one = rows.groupBy("digest").agg(F.min("id").alias("rep"), F.min("sha").alias("sha"), F.min("n").cast("int").alias("n"), F.min("words").alias("words"))
    vertices = checkpoint(with_row_id(one, "vertex"))
    keys, max_bits = samples(vertices.count(), least)
    sample = [
        F.struct(
            F.xxhash64(F.lit(t), F.col("words")[k].bitwiseAND(simhash._signed(mask))).alias("key"), F.col("words")[(k + 1) % WORDS].alias("fp")
        )
        for t, (k, mask) in enumerate(keys)
    ]
    buckets = vertices.where("n > 0").select("vertex", "n", F.explode(F.array(*sample)).alias("s")).select("s.key", "vertex", "n", "s.fp")

    @F.pandas_udf("binary")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from given_back(pd.Series([shingle_set(t, width).tobytes() for t in texts]) for texts in batches)

    def sets_of(met: DataFrame) -> tuple[DataFrame, int]:
        """(vertex, shingles) of the texts of some vertices, and how many there are."""
        texts = docs.select(text_sha(text_col).alias("sha"), F.col(text_col).alias("text"))
        met = checkpoint(met.distinct().join(vertices.select("vertex", "sha"), "vertex"))
        # Few texts: their digests go to the texts. Otherwise the texts are shuffled.
        n = met.count()
        own = texts.join(F.broadcast(met) if n <= BROADCAST_ROWS else met, "sha")
        return checkpoint(own.groupBy("vertex").agg(F.min("text").alias("text")).select("vertex", shingles("text").alias("shingles"))), n

    proposed = _propose(buckets, max_bits, least, bucket_rows)
    tried = checkpoint(_near(proposed.where("v >= 0").select("u", "v").distinct(), vertices, least))
    sets, n = sets_of(tried.select(F.col("u").alias("vertex")).unionByName(tried.select(F.col("v").alias("vertex"))))
    first = checkpoint(_linked(tried, sets, max(1, ceil(n / BLOCK_TEXTS)), least))
    found = components(first)
    groups = proposed.where("v < 0").select("key", F.col("u").alias("vertex"))
    cells = checkpoint(_remaining(groups, found, min(bucket_rows, GROUP_BLOCK)))
    if not cells.isEmpty():
        sets, _ = sets_of(cells.select("vertex"))
        described = cells.join(vertices.select("vertex", "n", "words"), "vertex").join(sets, "vertex")
        more = checkpoint(_rest(described, least))
        if not more.isEmpty():
            found = components(first.unionByName(more))

    classes = vertices.join(found, "vertex", "left").select("digest", "rep", F.coalesce("component", "vertex").alias("c"))
    smallest = classes.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = classes.join(dealt_anew(smallest, "c"), "c").select("digest", "component_id")
    return rows.join(named, "digest").select(
        F.col("id").alias(id_col), F.col("sha").alias("text_sha256"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
