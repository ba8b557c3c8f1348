"""Removal of repeated byte strings by suffix arrays over shards.

Every window of WINDOW bytes that starts at two places or more of the corpus is found, and each byte that such a
window covers is removed.

1. Sharding by content. A window's anchor is the least hash of the GRAM-byte strings in it. Equal windows have equal
   anchors, so windows are dealt to shards by anchor: neighbouring windows of a text with the same anchor form a run,
   and a run travels as one segment of text. Anchors that occur once in the corpus can't hold a repeat and are dropped
   before any text is moved.
2. In a shard, equal segments are one segment with a count. The distinct ones are concatenated; a suffix array is built
   by Larsson-Sadakane refinement (prefix doubling that re-sorts only groups still unsorted) up to the window's length,
   and Kasai's scan gives the common prefixes of neighbours. Windows with a common prefix of WINDOW bytes or more with
   a neighbour repeat.
3. An anchor with more text than one shard holds gets several; they are merged by binary search of each one's windows
   in the others' suffix arrays. An anchor beyond HOT_RUNS runs is no longer held by one task: its windows travel one
   by one, as BLAKE2b digests of 128 bits, spread by those digests. Like the SHA-256 of whole texts below, equal digests
   stand for equal bytes.

Texts that are copies of one another are found first: of each group one goes through the steps above, as occurring
twice, and the others are repeated as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trafficlens.llm.util import partitions, text_bytes

WINDOW = 200
GRAM = 16
SHARD_BYTES = 1 << 20
HOT_RUNS = 1 << 14
LANES = 4096
CHUNK = 1 << 20
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


# ---- anchors -------------------------------------------------------------------------------------------------


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each string of GRAM bytes."""
    h, step = b.astype(np.uint64), 1
    for c in _FACTORS:
        h = h[:-step] * c + h[step:]
        h ^= h >> np.uint64(29)
        step *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The least of the hashes in each window."""
    width = window - GRAM + 1
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :])


def runs_of(text: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, weight) of each run. Weight 2: the run may repeat inside itself.

    A text beyond CHUNK bytes is read in pieces; a run is cut where a piece ends."""
    out = []
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - window + 1), CHUNK):
        h = gram_hashes(data[at : at + CHUNK + window - 1])
        m = anchors(h, window)
        turn = np.flatnonzero(m[1:] != m[:-1]) + 1
        first, last = np.r_[0, turn], np.r_[turn, len(m)] - 1
        key = m[first]
        low = np.sort(h[h <= key.max()])
        twice = np.unique(low[1:][low[1:] == low[:-1]])
        out.append((key.view(np.int64), first + at, last + at, np.where(np.isin(key, twice), 2, 1)))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))


# ---- suffix arrays -------------------------------------------------------------------------------------------


class Shard:
    """The suffix array of concatenated segments, sorted as far as windows need."""

    def __init__(self, segments: list[bytes], window: int = WINDOW):
        self.window = window
        lengths = np.array([len(s) for s in segments], np.int64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.n = n = int(self.ends[-1])
        t = np.frombuffer(b"".join(segments) + bytes(window + 16), np.uint8)
        words = np.empty(n + window, np.uint64)
        for s in range(8):
            count = len(words[s::8])
            words[s::8] = t[s : s + 8 * count].view(">u8")
        self.words = words  # the eight bytes from each position on, as a big-endian number
        self.left = np.repeat(self.ends, lengths) - np.arange(n)  # bytes up to the segment's end
        self._refine()

    def _refine(self) -> None:
        """Larsson-Sadakane: sort by eight bytes, then double the depth and re-sort only unsorted groups."""
        n = self.n
        first = self.words[:n]
        sa = np.argsort(first, kind="stable")
        new = np.r_[True, first[sa[1:]] != first[sa[:-1]]]
        place = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group is named by its first place
        rank = np.empty(n + 2 * self.window, np.int64)
        rank[n:] = -1
        rank[sa] = place
        depth = 8
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
        while depth < self.window and len(open_):
            s = sa[open_]
            both = rank[s] * (n + 1) + rank[s + depth] + 1
            order = np.argsort(both, kind="stable")
            sa[open_], both = s[order], both[order]
            # Groups keep their places, so the sorted keys fall to the same slots.
            new = np.r_[True, both[1:] != both[:-1]]
            rank[sa[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
            open_ = open_[~(new & np.r_[new[1:], True])]
            depth *= 2
        self.sa = sa

    def common_prefixes(self) -> np.ndarray:
        """Kasai's scan: of each suffix and the one before it in the array, the common prefix, up to the window.

        The text is cut into lanes that are scanned side by side; in a lane, a suffix starts from its left
        neighbour's prefix less one. After a prefix that reached the window it starts from nothing: such neighbours may
        tie as far as the array is sorted, and then their right neighbours need not stand in the same order."""
        n, cap = self.n, self.window
        before = np.full(n, -1, np.int64)
        before[self.sa[1:]] = self.sa[:-1]
        little = self.words.byteswap()
        out = np.zeros(n, np.int64)
        lanes = min(LANES, n)
        length = -(-n // lanes)
        starts = np.arange(0, n, length)
        k = np.zeros(len(starts), np.int64)
        for step in range(length):
            i = starts + step
            if i[-1] >= n:
                i, k, starts = i[:-1], k[:-1], starts[:-1]
                if not len(i):
                    break
            j = before[i]
            k = np.where(k >= cap, 0, np.maximum(k - 1, 0))
            k[j < 0] = 0
            live = np.flatnonzero((j >= 0) & (k < cap))
            while len(live):
                x = little[i[live] + k[live]] ^ little[j[live] + k[live]]
                same = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
                k[live] += same  # eight where all bytes are equal
                live = live[(same == 8) & (k[live] < cap)]
            np.minimum(k, cap, out=k)
            out[i] = k
        return out

    def repeats(self) -> np.ndarray:
        """For each position: whether it starts a window that starts elsewhere in the shard too.

        Suffixes that share a window stand together; those that reach into the next segment don't count."""
        joined = self.common_prefixes()[self.sa] >= self.window
        group = np.cumsum(~joined)
        valid = self.left[self.sa] >= self.window
        several = np.bincount(group, weights=valid)[group] > 1
        out = np.zeros(self.n, bool)
        out[self.sa] = valid & several
        return out

    def holds(self, other: Shard, positions: np.ndarray) -> np.ndarray:
        """Whether the windows of `other` at `positions` occur in this shard, by binary search in its suffix array."""
        low, high = np.zeros(len(positions), np.int64), np.full(len(positions), self.n, np.int64)
        while (live := low < high).any():
            mid = (low + high) // 2
            less = np.zeros(len(positions), bool)
            at = np.flatnonzero(live)
            less[at] = self._compare(self.sa[mid[at]], other, positions[at]) < 0
            low = np.where(live & less, mid + 1, low)
            high = np.where(live & ~less, mid, high)
        found = np.zeros(len(positions), bool)
        at = np.flatnonzero(low < self.n)
        # Suffixes with one prefix stand together; those that end before the window does sort among them, so look on.
        here = low[at]
        while len(at):
            s = self.sa[here]
            equal = self._compare(s, other, positions[at]) == 0
            whole = equal & (self.left[s] >= self.window)
            found[at[whole]] = True
            on = equal & ~whole & (here + 1 < self.n)
            at, here = at[on], here[on] + 1
        return found

    def _compare(self, mine: np.ndarray, other: Shard, theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the order of this shard's suffixes and the other's, over one window."""
        out = np.zeros(len(mine), np.int8)
        live = np.arange(len(mine))
        for k in range(0, self.window, 8):
            a, b = self.words[mine[live] + k], other.words[theirs[live] + k]
            rest = self.window - k
            if rest < 8:
                shift = np.uint64(8 * (8 - rest))
                a, b = a >> shift, b >> shift
            out[live] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            live = live[a == b]
            if not len(live):
                break
        return out

    def windows(self) -> np.ndarray:
        """The positions that start a window."""
        return np.flatnonzero(self.left >= self.window)


def repeated_windows(groups: list[list[bytes]], window: int = WINDOW) -> list[np.ndarray]:
    """For each group of distinct segments: whether each byte of their concatenation starts a repeated window.

    Groups are the shards of one anchor: each has its own suffix array, and they are merged by binary search."""
    shards = [Shard(g, window) for g in groups]
    flags = [s.repeats() for s in shards]
    for x in range(len(shards)):
        for y in range(len(shards)):
            if x != y:
                at = shards[x].windows()
                at = at[~flags[x][at]]
                flags[x][at[shards[y].holds(shards[x], at)]] = True
    return flags


# ---- Spark ---------------------------------------------------------------------------------------------------


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in compressed form: they are moved once and read three times."""
    press = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([press(t.as_py()) for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["id", "tx", "text"])


def _texts(column: pa.Array) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return (expand(t.as_py()) for t in column)


def _find_runs(window: int):
    """Two arrays for each text: the anchors of its runs, and first window, length and weight packed in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [runs_of(t, window) for t in _texts(batch.column(2))]
            packed = [(key, first << 21 | (last - first) << 1 | (weight - 1)) for key, first, last, weight in found]
            cuts = np.r_[0, np.cumsum([len(k) for k, _ in packed])].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([p[k] for p in packed]))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *lists], ["id", "tx", "copied", "key", "at"])

    return run


def _cut_segments(window: int):
    """Segments of the runs that may repeat; runs of a hot anchor go window by window, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, txs, texts, copied, runs = (batch.column(k) for k in range(5))
            raw = _texts(texts)
            keys, rows, firsts, segments, times = [], [], [], [], []
            size = 0

            def out(keys=keys, rows=rows, firsts=firsts, segments=segments, times=times, ids=ids, txs=txs):
                take = pa.array(rows, pa.int64())
                made = pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), ids.take(take), txs.take(take), pa.array(firsts, pa.int64()), pa.array(segments, pa.binary()), pa.array(times, pa.int32())],
                    ["key", "id", "tx", "first", "segment", "times"],
                )
                for x in (keys, rows, firsts, segments, times):
                    x.clear()
                return made

            for r in range(batch.num_rows):
                text, n = next(raw), 2 if copied[r].as_py() else 1
                for one in runs[r].as_py() or []:
                    a = one["at"] >> 21
                    b = a + (one["at"] >> 1 & CHUNK - 1)
                    if one["hot"]:
                        for p in range(a, b + 1):
                            d = blake2b(text[p : p + window], digest_size=16).digest()
                            keys.append(int.from_bytes(d[:8], "little", signed=True))
                            rows.append(r)
                            firsts.append(p)
                            segments.append(d)
                            times.append(n)
                        size += 64 * (b - a + 1)
                    else:
                        keys.append(one["key"])
                        rows.append(r)
                        firsts.append(a)
                        segments.append(text[a : b + window])
                        times.append(n)
                        size += b - a + window
                    if size > CHUNK:
                        yield out()
                        size = 0
            if keys:
                yield out()

    return run


class _Repeats:
    """What a task knows while it reads segments sorted by (key, segment)."""

    def __init__(self, window: int, shard_bytes: int, id_type: pa.DataType):
        self.window, self.shard_bytes, self.id_type = window, shard_bytes, id_type
        self.found: tuple[list, ...] = ([], [], [], [])  # id, tx, start, stop
        self.key: int | None = None
        self.segment: bytes | None = None
        self.where: list[tuple] = []  # rows of the current segment that are not yet reported
        self.times = 0
        self.shards: list[list[tuple[bytes, list]]] = [[]]  # of the current anchor
        self.size = 0
        self.shared: list[tuple[bytes, list]] = []  # anchors that share the next shard
        self.shared_size = 0

    def report(self, where: list[tuple], a: int, b: int) -> None:
        for i, tx, first in where:
            for column, value in zip(self.found, (i, tx, first + a, first + b)):
                column.append(value)

    def add(self, key: int, segment: bytes, row: tuple, times: int) -> None:
        if key != self.key:
            self.end_segment()
            self.end_anchor()
            self.key = key
        elif segment != self.segment:
            self.end_segment()
        self.segment = segment
        self.times += times
        self.where.append(row)
        if self.times > 1:  # repeated as a whole: its rows need not be held
            self.report(self.where, 0, max(len(segment), self.window))
            self.where = []

    def end_segment(self) -> None:
        if self.segment is not None and len(self.segment) >= self.window:  # else a digest: equal ones were all
            if self.size >= self.shard_bytes:
                self.shards.append([])
                self.size = 0
            self.shards[-1].append((self.segment, self.where))
            self.size += len(self.segment)
        self.segment, self.where, self.times = None, [], 0

    def end_anchor(self) -> None:
        if len(self.shards) > 1:
            self.settle(self.shards)
        elif len(self.shards[0]) > 1 or any(where for _, where in self.shards[0]):
            self.shared += self.shards[0]
            self.shared_size += self.size
            if self.shared_size >= self.shard_bytes:
                self.end_shard()
        self.shards, self.size = [[]], 0

    def end_shard(self) -> None:
        if self.shared:
            self.settle([self.shared])
        self.shared, self.shared_size = [], 0

    def settle(self, shards: list[list[tuple[bytes, list]]]) -> None:
        for shard, flags in zip(shards, repeated_windows([[s for s, _ in x] for x in shards], self.window)):
            at = 0
            for segment, where in shard:
                own = flags[at : at + len(segment) - self.window + 1]
                edges = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    self.report(where, a, b - 1 + self.window)
                at += len(segment)

    def batch(self) -> pa.RecordBatch:
        kinds = (self.id_type, pa.int64(), pa.int64(), pa.int64())
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.found, kinds)], ["id", "tx", "start", "stop"])
        for c in self.found:
            c.clear()
        return made


def _find_repeats(window: int, shard_bytes: int):
    """The task of a partition: segments sorted by (key, segment) to stretches (id, tx, start, stop) that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            state = state or _Repeats(window, shard_bytes, batch.schema.field(1).type)
            for key, i, tx, first, segment, times in zip(*(batch.column(k).to_pylist() for k in range(6))):
                state.add(key, segment, (i, tx, first), times)
            yield state.batch()
        if state:
            state.end_segment()
            state.end_anchor()
            state.end_shard()
            yield state.batch()

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, whole, stretches) to (id, n_bytes, spans, kept)."""
    for batch in batches:
        ids, texts, whole, stretches = (batch.column(k) for k in range(4))
        sizes, spans, kept = [], [], []
        for text, all_of_it, found in zip(_texts(texts), whole.to_pylist(), (x.as_py() for x in stretches)):
            merged: list[list[int]] = [[0, len(text)]] if all_of_it else []
            for x in sorted((f["start"], f["stop"]) for f in found or []) if not all_of_it else []:
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(list(x))
            edges = [0, *(e for m in merged for e in m), len(text)]
            sizes.append(len(text))
            spans.append([{"start": a, "stop": b} for a, b in merged])
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """One row per input row: id, n_bytes, spans (start and stop of each maximal removed run, in bytes) and kept
    (the remaining bytes, concatenated).

    A byte is removed if a string of `window` bytes that covers it also starts anywhere else in the table, the
    same text included; strings are judged on the input. Null texts count as empty; texts shorter than the window
    keep all. Repeated rows repeat each other, and so do rows with equal texts and null or different ids. An empty table
    gives an empty result; other columns, whatever their names, are ignored. Very long texts are read in pieces.
    """
    if window < 2 * GRAM:
        raise ValueError(f"windows of under {2 * GRAM} bytes have no anchor")
    n = partitions(docs.sparkSession)
    raw = text_bytes(text_col)
    # Rows go by their id as text, so that a null one can be joined on, and by a hash of the text.
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null"))
    rows = docs.select(name.alias("id"), F.xxhash64(raw).alias("tx"), raw.alias("text"))
    # Copies of whole texts: one row of each group goes on, as occurring twice. Groups are of equal SHA-256.
    digests = rows.where(F.octet_length("text") >= window).select("id", "tx", F.unhex(F.sha2("text", 256)).alias("sha"))
    groups = digests.groupBy("sha").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1")
    groups = groups.withColumn("sha", F.unhex(F.hex("sha")))  # dealt anew, so that Spark can split a large group of copies
    copies = digests.join(groups, "sha").groupBy("id", "tx").agg(F.max(F.col("id") == F.col("rep")).alias("is_rep"))
    # One exchange of texts serves the runs, the segments and the removal: no filter may come between.
    squeezed = rows.mapInArrow(_squeeze, "id string, tx long, text binary")
    spread = squeezed.repartition(n, "id", "tx").join(copies, ["id", "tx"], "left")
    own = spread.where(F.coalesce("is_rep", F.lit(True))).select("id", "tx", "text", F.col("is_rep").isNotNull().alias("copied"))

    listed = own.mapInArrow(_find_runs(window), "id string, tx long, copied boolean, key array<long>, at array<long>")
    runs = listed.select("id", "tx", "copied", F.explode(F.arrays_zip("key", "at")).alias("r"))
    weight = F.when(F.col("copied"), 2).otherwise(F.col("at").bitwiseAND(F.lit(1)) + 1)
    # A text has a run for each hundred bytes or so, so even an anchor that all texts share has few of all runs.
    counted = runs.select("id", "tx", "copied", "r.key", "r.at").withColumn("n", F.sum(weight).over(Window.partitionBy("key")))
    several = counted.where("n > 1").withColumn("hot", F.col("n") > hot_runs)
    wanted = several.groupBy("id", "tx").agg(F.collect_list(F.struct("key", "at", "hot")).alias("runs"))

    cut = own.join(wanted, ["id", "tx"], "left").select("id", "tx", "text", "copied", "runs")
    segments = cut.mapInArrow(_cut_segments(window), f"key long, id string, tx long, first long, segment binary, times int")
    dealt = segments.repartition(n, "key").sortWithinPartitions("key", "segment")
    found = dealt.mapInArrow(_find_repeats(window, shard_bytes), "id string, tx long, start long, stop long")
    stretches = found.groupBy("id", "tx").agg(F.collect_list(F.struct("start", "stop")).alias("found"))

    final = spread.join(stretches, ["id", "tx"], "left").select("id", "text", F.col("is_rep").isNotNull().alias("whole"), "found")
    out = final.mapInArrow(_remove, "id string, n_bytes long, spans array<struct<start: bigint, stop: bigint>>, kept binary")
    own_id = F.when(F.col("id") != "null", F.substring("id", 2, 1 << 30).cast(docs.schema[id_col].dataType))
    return out.select(own_id.alias(id_col), "n_bytes", "spans", "kept")
