"""Embedding near-dedup by an epsilon grid order join (after Böhm, Braunmüller, Krebs and Kriegel, 2001).

For unit vectors, cosine >= c means a distance of at most eps = sqrt(2 - 2c). Vectors are projected on their
leading principal directions, sorted by the grid cells (of side eps) of those coordinates, and packed into blocks,
intervals of that sequence, each with the bounding box of its projections and of the lengths of what they leave out.
These coordinates never lie further apart than the vectors, so two blocks whose boxes are more than eps apart hold no
link. Where nothing is far apart, as in high dimensions without clusters, all pairs of blocks are left, so blocks are
not dealt out to their pairs: a task reads one block and streams others past it, from the files they were packed
into. Disk grows with the input, only comparisons with its square.

Inside a pair of blocks, leaves whose boxes are more than eps apart are skipped. The others are compared on the
leading coordinates in single precision, and what may link after that by cosine in double precision over all
dimensions.

Equal vectors are one row with a count before anything is compared, so copies are never paired up. A pair of
blocks returns counts of links and a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.components import components
from trafficlens.llm.simhash import _forest
from trafficlens.llm.util import checkpoint, dealt_anew, given_back, partitions

LEADING = 8  # coordinates by whose cells vectors are sorted, 7 bits each
BLOCK = 32_768
BLOCK_BYTES = 16 << 20  # of a block in double precision, at most
LEAST = 2048  # vectors for which another block is worth its tasks
TASKS = 4  # of a join for each partition of a shuffle, about; there are as many as blocks at least
LEAF = 256
SIFTED = 1e-6  # of all pairs: less than one of a pair of leaves
SLACK = 1e-9
ROUNDING = 1e-5  # more than squared distances on the coordinates can be wrong by
SINGLE = 5e-7  # and more than that, for each coordinate, in single precision
EDGES = 1 << 20
MAX_SIZES = 16
SEEDS = 64


def _valid(column: str):
    """Not null, not zero, and every component a finite number."""
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(F.col(column), lambda x: x != 0), F.lit(False))


def _unit(stacked: np.ndarray) -> np.ndarray:
    return stacked / np.linalg.norm(stacked, axis=1, keepdims=True)


def principal(vectors: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean, principal directions (columns) and variances of the unit vectors, from sums over all rows
    (size x size numbers)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for frame in frames:
            for at in range(0, len(frame), 4096):
                x = _unit(np.stack(frame["vec"].iloc[at : at + 4096]).astype(np.float64))
                x = np.c_[x, np.ones(len(x))]
                total += x.T @ x
        yield pd.DataFrame({"k": np.arange(total.size), "v": total.ravel()})

    sums = vectors.select("vec").mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    total = np.zeros((size + 1) ** 2)
    for r in sums.collect():
        total[r["k"]] = r["v"]
    total = total.reshape(size + 1, size + 1)
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    variances, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return int(n), mean, axes[:, ::-1], np.maximum(variances[::-1], 0)


def sifting(variances: np.ndarray, eps: float) -> int:
    """On how many leading directions to compare first: as few as would leave SIFTED of all pairs, were the vectors
    normal (Chernoff's bound). It decides on time alone."""
    t = np.geomspace(1e-2, 1e6, 99)[:, None]
    left = (t * eps * eps - np.cumsum(np.log1p(4 * t * variances), axis=1) / 2).min(axis=0)
    return int(np.argmax(left <= np.log(SIFTED))) + 1 if left.min() <= np.log(SIFTED) else len(variances)


def _coordinates(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates that lie no further apart than the vectors (projections, and the length of what they leave out),
    and their squared length."""
    c = x - mean
    q = c @ axes
    n = np.einsum("ij,ij->i", c, c)
    return np.c_[q, np.sqrt(np.maximum(n - np.einsum("ij,ij->i", q, q), 0))], n


def pack_blocks(vectors: DataFrame, n: int, block: int, eps: float, mean: np.ndarray, axes: np.ndarray, kind: type) -> DataFrame:
    """The epsilon grid order of rows (name, count, vec), cut into rows (block, rows, lo, hi, names, counts, data): about `n`,
    of at most `block` vectors each."""
    first = axes[:, :LEADING]
    step = max(eps, 1 / 32)  # coordinates are between -2 and 2, so 7 bits hold a cell

    @F.pandas_udf("long")
    def cell(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=np.int64)
        at = np.floor((_unit(np.stack(column).astype(np.float64)) - mean) @ first / step).astype(np.int64)
        return pd.Series(np.clip(at + 64, 0, 127) @ (1 << 7 * np.arange(at.shape[1])[::-1]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(part: pd.DataFrame) -> pd.DataFrame:
            data = np.stack(part["vec"]).astype(kind)
            p, _ = _coordinates(_unit(data.astype(np.float64)), mean, axes)
            return pd.DataFrame([{
                "rows": len(part), "lo": p.min(axis=0).tolist(), "hi": p.max(axis=0).tolist(), "names": part["name"].to_numpy(np.int64).tobytes(),
                "counts": part["count"].to_numpy(np.int64).tobytes(), "data": data.tobytes(),
            }])

        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            whole = len(frame) // block * block
            for at in range(0, whole, block):
                yield row(frame.iloc[at : at + block])
            held = frame.iloc[whole:]
        if held is not None and len(held):
            yield row(held)

    dealt = vectors.withColumn("cell", cell("vec")).repartitionByRange(n, "cell", "name").sortWithinPartitions("cell", "name")
    # The join has as many tasks as pairs of partitions, so there are no more of them than asked for.
    packed = dealt.select("name", "count", "vec").coalesce(n).mapInPandas(
        run, "rows long, lo array<double>, hi array<double>, names binary, counts binary, data binary"
    )
    return checkpoint(packed.withColumn("block", F.monotonically_increasing_id()))


def block_pairs(blocks: DataFrame, n: int, eps: float) -> DataFrame:
    """Each pair of blocks (a, b), in either order, whose boxes are at most eps apart, and each block with itself, with their
    data. No block is shuffled: a task holds one partition of `blocks` (a block, mostly) and streams a group of others."""
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi", "names", "counts", "data")])
    gap = lambda x, y: F.greatest(F.lit(0.0), x - y)
    near = F.zip_with("lo_a", "hi_b", gap), F.zip_with("lo_b", "hi_a", gap)
    square = F.aggregate(F.zip_with(*near, lambda x, y: F.greatest(x, y)), F.lit(0.0), lambda acc, x: acc + x * x)
    a, b = F.col("block_a"), F.col("block_b")
    # Which of the two orders it is changes from pair to pair: all tasks get as much.
    once = F.when(F.xxhash64(F.least(a, b), F.greatest(a, b)) % 2 == 0, a <= b).otherwise(a >= b)
    groups = side("a").coalesce(min(n, -(-TASKS * partitions(blocks.sparkSession) // n)))
    return groups.hint("shuffle_replicate_nl").join(side("b"), once & (square <= F.lit(eps * eps + ROUNDING)))


def _leaves(p: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of each `leaf` rows."""
    at = np.arange(0, len(p), leaf)
    return np.minimum.reduceat(p, at), np.maximum.reduceat(p, at)


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links that a matrix holds, as many as connect what all of them connect: each row's first, each column's first,
    and those between what is still apart."""
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    r, c = np.r_[rows, near[:, columns].argmax(axis=0)], np.r_[near[rows].argmax(axis=1), columns]
    label = _forest(sum(near.shape), r, len(near) + c)
    more = np.nonzero(near & (label[: len(near), None] != label[len(near) :]))
    return np.r_[r, more[0]], np.r_[c, more[1]]


def _joined(a: tuple, b: tuple, itself: bool, cosine: float, limit: float, leaf: int):
    """Links between two blocks: weighted counts for both sides, and edges (positions) that connect what links.
    A side: unit vectors, counts, leaves, and the two factors of what is compared first."""
    (x, ca, boxes_a, left, _), (y, cb, boxes_b, _, right) = a, b
    na, nb = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    start = 0 if itself else len(x)  # a block with itself has one numbering
    edges, n_edges, may, n_may = [np.empty((2, 0), np.int64)], 0, [], 0
    at_once = max(1, BLOCK_BYTES // (8 * x.shape[1]))
    least = np.float32(cosine - 1 - ROUNDING - SINGLE * left.shape[1])

    def forest(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        label = _forest(start + len(y), r, c)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return np.stack([moved, label[moved]])

    def connect(r: np.ndarray, c: np.ndarray) -> None:
        nonlocal edges, n_edges
        edges.append(np.stack([r, start + c]))
        n_edges += len(r)
        if n_edges > EDGES:
            edges = [forest(*np.concatenate(edges, axis=1))]
            n_edges = 0

    def judge() -> None:
        nonlocal may, n_may
        if may:
            r, c = np.concatenate(may, axis=1)
            on = np.concatenate([np.einsum("ij,ij->i", x[r[i : i + at_once]], y[c[i : i + at_once]]) for i in range(0, len(r), at_once)] or [[]])
            r, c = r[on >= cosine], c[on >= cosine]
            np.add.at(na, r, cb[c])
            np.add.at(nb, c, ca[r])
            connect(r, c)
        may, n_may = [], 0

    gap = np.maximum(boxes_a[0][:, None] - boxes_b[1], boxes_b[0] - boxes_a[1][:, None])
    gap = np.maximum(gap, 0, out=gap)
    for i, j in np.argwhere(np.einsum("ijk,ijk->ij", gap, gap) <= limit).tolist():
        if itself and j < i:
            continue
        a0, a1, b0, b1 = i * leaf, (i + 1) * leaf, j * leaf, (j + 1) * leaf
        first = left[a0:a1] @ right[b0:b1].T >= least
        n = np.count_nonzero(first)
        if n * 32 > first.size:
            near = x[a0:a1] @ y[b0:b1].T >= cosine
            if itself and i == j:
                near = np.triu(near, 1)
            na[a0:a1] += near @ cb[b0:b1]
            nb[b0:b1] += ca[a0:a1] @ near
            r, c = _spanning(near)
            connect(a0 + r, b0 + c)
        elif n:
            rows = np.flatnonzero(first.any(axis=1))
            r, c = np.nonzero(first[rows])
            r = rows[r]
            if itself and i == j:
                r, c = r[r < c], c[r < c]
            may.append(np.stack([a0 + r, b0 + c]))
            n_may += len(r)
            if n_may > at_once:
                judge()
    judge()
    return na, nb, forest(*np.concatenate(edges, axis=1))


def _links(size: int, cosine: float, eps: float, mean: np.ndarray, axes: np.ndarray, kind: type, leaf: int):
    def prepared(names: bytes, counts: bytes, data: bytes) -> tuple:
        x = _unit(np.frombuffer(data, kind).reshape(-1, size).astype(np.float64))
        p, n = _coordinates(x, mean, axes)
        # The product of a left and a right row is minus half their squared distance on these coordinates.
        half, one = -np.einsum("ij,ij->i", p, p) / 2, np.ones(len(x))
        left, right = np.c_[p, half, one].astype(np.float32), np.c_[p, one, half].astype(np.float32)
        return np.frombuffer(names, np.int64), (x, np.frombuffer(counts, np.int64), _leaves(p, leaf), left, right)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides: dict[int, tuple] = {}
        for frame in frames:
            for r in frame.itertuples(index=False):
                new = {r.block_a: (r.names_a, r.counts_a, r.data_a), r.block_b: (r.names_b, r.counts_b, r.data_b)}
                sides = {k: sides[k] if k in sides else prepared(*v) for k, v in new.items()}
                (ua, a), (ub, b) = sides[r.block_a], sides[r.block_b]
                itself = r.block_a == r.block_b
                na, nb, (i, j) = _joined(a, b, itself, cosine, eps * eps + ROUNDING, leaf)
                names = ua if itself else np.r_[ua, ub]
                n = na + nb if itself else np.r_[na, nb]
                some = n > 0
                yield pd.DataFrame({"u": names[some], "v": names[some], "n": n[some]})
                yield pd.DataFrame({"u": names[i], "v": names[j], "n": np.zeros(len(i), np.int64)})

    return lambda frames: given_back(run(frames))


class _OneSize:
    """The distinct vectors of one size, packed; `links` compares them."""

    def __init__(self, good: DataFrame, distinct: DataFrame, size: int, cosine: float, block: int):
        self.size, self.cosine = size, cosine
        self.eps = float(np.sqrt(2 - 2 * cosine)) * (1 + SLACK)
        self.kind = np.float32 if good.schema["vec"].dataType.elementType.simpleString() == "float" else np.float64
        rows, self.mean, axes, variances = principal(good.where(F.size("vec") == size), size)
        self.axes = np.ascontiguousarray(axes[:, : sifting(variances, self.eps)])
        block = max(1, min(block, BLOCK_BYTES // (8 * size)))
        # Ranges are not cut evenly, so a fifth of a block is left free; small tables have three pairs for each task of a shuffle.
        several = min(rows // LEAST, int(np.ceil(np.sqrt(6 * partitions(good.sparkSession)))))
        self.n = max(1, several, -(-5 * rows // (4 * block)))
        packed = distinct.where(F.size("vec") == size)
        self.blocks = pack_blocks(packed, self.n, block, self.eps, self.mean, self.axes, self.kind)
        self.vectors = self.blocks.agg(F.sum("rows")).first()[0]

    def links(self) -> DataFrame:
        """(u, v, n): link counts (u = v) and edges (n = 0)."""
        spark = self.blocks.sparkSession
        run = _links(self.size, self.cosine, self.eps, self.mean, self.axes, self.kind, LEAF)
        was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row is two blocks
        try:
            found = block_pairs(self.blocks, self.n, self.eps).mapInPandas(run, "u long, v long, n long")
            return checkpoint(found.groupBy("u", "v").agg(F.sum("n").alias("n")))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def _name(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "vec")


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block: int = BLOCK
) -> DataFrame:
    """One row per input row: id, n_links, component_id and kept.

    n_links counts the other rows with a cosine of at least `cosine`, copies of the same vector included;
    component_id is the smallest id reachable over links. Vectors that are null or zero, or hold a null or
    non-finite component, link with nothing; so do vectors of different sizes with each other (at most
    MAX_SIZES sizes). Repeated rows count as other vectors. An empty table gives an empty result.

    Rows know their vector by a hash, so that vectors are shuffled twice only. If two vectors have the same hash,
    all are named anew with another seed.
    """
    flagged = vectors.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("vec"), _valid(vector_col).alias("__ok"))
    good = flagged.where("__ok")
    for seed in range(SEEDS):
        size = F.size("vec")
        named = good.groupBy(_name(seed).alias("name")).agg(
            F.min("__id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(size).alias("size"), F.max(size).alias("largest")
        )
        named = checkpoint(named)
        if not named.where("size < largest").isEmpty():
            continue
        sizes = [r[0] for r in named.select("size").distinct().limit(MAX_SIZES + 1).collect()]
        if len(sizes) > MAX_SIZES:
            raise ValueError(f"more than {MAX_SIZES} vector sizes")
        if not sizes:
            return flagged.select(
                F.col("__id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"), F.lit(True).alias("kept")
            )
        distinct = good.groupBy("vec").agg(F.count(F.lit(1)).alias("count")).withColumn("name", _name(seed))
        parts = [_OneSize(good, distinct, k, cosine, block) for k in sorted(sizes)]
        if sum(p.vectors for p in parts) == named.count():
            break
    else:
        raise RuntimeError("the table's vectors change from one reading to the next")
    found = parts[0].links()
    for p in parts[1:]:
        found = found.unionByName(p.links())
    counts = found.where("u = v").select("u", F.col("n").alias("others"))
    sets = named.join(components(found.where("u <> v").select("u", "v")), F.col("name") == F.col("vertex"), "left")
    sets = sets.join(counts, F.col("name") == F.col("u"), "left").select(
        "name", "rep", F.coalesce("component", "name").alias("part"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    sets = sets.where("links > 0")
    least = sets.groupBy("part").agg(F.min("rep").alias("least"))
    sets = sets.join(dealt_anew(least, "part"), "part").select("name", "links", "least")
    rows = flagged.select("__id", F.when(F.col("__ok"), _name(seed)).alias("name")).join(sets, "name", "left")
    return rows.select(
        F.col("__id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("least", F.col("__id")).alias("component_id"),
        (F.col("__id") == F.coalesce("least", F.col("__id"))).alias("kept"),
    )
