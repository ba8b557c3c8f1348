"""Control events and replay: folds whose next step depends on all before it, one key per fold."""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN_SECONDS = 300


def _answers(events: list[tuple], token: str | None, expires: int) -> tuple[list[tuple], str | None, int]:
    """(answer, token) of each of the events (at, req_id, token) in order, and the token and its end that are left."""
    out = []
    for at, req_id, asked in events:
        live = bool(token) and at < expires
        if asked is not None:
            out.append(("cleared" if live and asked == token else "refused", asked))
            token, expires = "", 0
            continue
        if not live:
            token, expires = None if req_id is None else f"t{req_id}", at + TOKEN_SECONDS
        out.append(("reused" if live else "issued", token))
    return out, token, expires


def _in_order(events: pa.Table) -> list[tuple]:
    rows = zip(*(events.column(c).to_pylist() for c in ("at", "req_id", "token")))
    return sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or ""))


def _exits(events: list[tuple], begin: int) -> list[tuple]:
    """What a slice that begins at `begin` makes of the token it is entered with: rows (since, token, expires).

    A token that ends at or before `since`, and after the since of the row before, leaves the slice as that row's token;
    one that outlasts all rows leaves as it came. A used token is gone, so a slice with a use has one row, since null.
    Without uses only the first second at or after the end of the entering token matters: TOKEN_SECONDS rows at most, and one."""
    used = [k for k, (_, _, asked) in enumerate(events) if asked is not None]
    if used:
        return [(None, *_answers(events[used[-1] + 1 :], "", 0)[1:])]
    first = [k for k, (at, _, _) in enumerate(events) if not k or events[k - 1][0] != at]
    seconds = [events[k][0] for k in first]
    after: list[tuple] = [()] * len(first)
    for i in range(len(first) - 1, -1, -1):  # a token issued here, and those that follow it
        at, req_id, _ = events[first[i]]
        then = bisect_left(seconds, at + TOKEN_SECONDS)
        after[i] = after[then] if then < len(first) else (None if req_id is None else f"t{req_id}", at + TOKEN_SECONDS)
    return [(at, *left) for at, left in zip(seconds, after)][: bisect_left(seconds, begin + TOKEN_SECONDS) + 1]


def clear_requests(events: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """The answer to each request to clear the storage. Columns: instance, req_id, at (unix seconds), token (null asks for one).

    A request without a token gets the one that is valid, or a new one for TOKEN_SECONDS. A request with the valid
    token clears; any request with a token, right or wrong, uses the token up. Answers: issued, reused, cleared,
    refused. A new token is named after the request that made it. Requests without a time come first and find no token.

    Made in two steps: each slice of an instance's time says what it makes of any token it may be entered with (see
    `_exits`), these are walked from slice to slice, and then each slice is answered by itself, in time that grows with
    its events. So a busy instance is dealt out over its slices.
    """
    kind = events.schema["instance"].dataType.simpleString()
    rows = events.select("instance", F.col("req_id").cast("bigint").alias("req_id"), F.col("at").cast("bigint").alias("at"), "token")
    slice_ = F.floor(F.col("at") / F.lit(slice_seconds)).cast("bigint")
    timed = rows.where("at IS NOT NULL").withColumn("slice", slice_)

    def exits(key: tuple, slice_events: pa.Table) -> pa.Table:
        made = _exits(_in_order(slice_events), key[1].as_py() * slice_seconds)
        columns = zip(*made)
        n = len(made)
        return pa.table([_repeat(key[0], n), _repeat(key[1], n), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64())))],
                        names=["instance", "slice", "since", "token", "expires"])

    def entries(key: tuple, made: pa.Table) -> pa.Table:
        by_slice = defaultdict(list)
        for at, *row in zip(*(made.column(c).to_pylist() for c in ("slice", "since", "token", "expires"))):
            by_slice[at].append(tuple(row))
        token, expires, out = "", 0, []
        for at in sorted(by_slice):
            out.append((at, token, expires))
            left = sorted(by_slice[at], key=lambda r: r[0] or 0)
            found = next((r for r in left if r[0] is None or not token or r[0] >= expires), None)
            token, expires = found[1:] if found else (token, expires)
        columns = zip(*out)
        return pa.table([_repeat(key[0], len(out)), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64())))],
                        names=["of", "slice_", "held", "until"])

    def answers(key: tuple, slice_events: pa.Table) -> pa.Table:
        ordered = _in_order(slice_events)
        held, until = (slice_events.column(c)[0].as_py() for c in ("held", "until"))
        answer, token = zip(*_answers(ordered, held, until)[0])
        return pa.table([_repeat(key[0], len(ordered)), pa.array([r[1] for r in ordered], pa.int64()), pa.array(answer, pa.string()), pa.array(token, pa.string())],
                        names=["instance", "req_id", "answer", "token"])

    summed = timed.groupBy("instance", "slice").applyInArrow(exits, f"instance {kind}, slice bigint, since bigint, token string, expires bigint")
    entered = summed.groupBy("instance").applyInArrow(entries, f"of {kind}, slice_ bigint, held string, until bigint")
    met = timed.join(entered, F.col("instance").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("slice_"))).drop("of", "slice_")
    found = met.groupBy("instance", "slice").applyInArrow(answers, f"instance {kind}, req_id bigint, answer string, token string")
    made = F.when(F.col("token").isNull(), F.concat(F.lit("t"), F.col("req_id").cast("string"))).otherwise(F.col("token"))
    answer = F.when(F.col("token").isNull(), "issued").otherwise("refused")
    return found.unionByName(rows.where("at IS NULL").select("instance", "req_id", answer.alias("answer"), made.alias("token")))


def _repeat(value: pa.Scalar, n: int) -> pa.Array:
    return pa.array([value.as_py()] * n, value.type)


class _Frequencies:
    """Write counts of this window and the one before; the estimate is half their sum."""

    def __init__(self, seconds: int):
        self.seconds, self.window, self.now, self.before = seconds, None, defaultdict(int), {}

    def add(self, key: str, at: float) -> None:
        window = int(at // self.seconds)
        if window != self.window:
            self.before = dict(self.now) if self.window is not None and window == self.window + 1 else {}
            self.now, self.window = defaultdict(int), window
        self.now[key] += 1

    def estimate(self, key: str) -> int:
        return (self.now.get(key, 0) + self.before.get(key, 0)) // 2


def replay_shards(accesses: DataFrame, budget: int, window_seconds: int = 60) -> DataFrame:
    """Exact replay of storage, recency and admission, shard by shard, each with its own budget in bytes.

    Columns: shard, req_id, ts, key, weight, stored. Outcomes: hit (the key is there), miss (not to be stored), and for
    writes insert, update or rejected. A new key that doesn't fit competes with the least recently used entry: it is
    rejected if its estimated frequency is lower, else entries go from the back of the list until it fits. An entry
    larger than the budget is rejected.

    A shard is one fold, so it must fit one task; a budget over all shards at once would be one fold over the whole log
    and is not offered.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "req_id"])
        held: OrderedDict[str, int] = OrderedDict()  # key to weight, the least recently used first
        counts, mem, out = _Frequencies(window_seconds), 0, []
        seconds = frame["ts"].astype("int64") / (10**9 if str(frame["ts"].dtype).startswith("datetime64[ns") else 10**6)
        for key, weight, stored, at in zip(frame["key"], frame["weight"], frame["stored"], seconds):
            evicted = 0
            if key in held:
                held.move_to_end(key)
                if stored:
                    counts.add(key, at)
                    mem += weight - held[key]
                    held[key] = weight
                outcome = "hit"
            elif not stored:
                outcome = "miss"
            else:
                counts.add(key, at)
                outcome = "insert"
                if weight > budget:
                    outcome = "rejected"
                elif mem + weight > budget and counts.estimate(key) < counts.estimate(next(iter(held))):
                    outcome = "rejected"
            if outcome == "insert":
                held[key] = weight
                mem += weight
            while mem > budget and len(held) > 1:
                _, freed = held.popitem(last=False)
                mem -= freed
                evicted += 1
            out.append((outcome, evicted, mem))
        made = pd.DataFrame(out, columns=["outcome", "evicted", "mem"])
        made.insert(0, "req_id", frame["req_id"].to_numpy())
        made.insert(0, "shard", frame["shard"].to_numpy())
        return made

    rows = accesses.select(F.col("shard").cast("bigint").alias("shard"), "req_id", "ts", "key", F.col("weight").cast("bigint").alias("weight"), "stored")
    return rows.groupBy("shard").applyInPandas(run, "shard bigint, req_id bigint, outcome string, evicted bigint, mem bigint")


def compress(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add `out`: the bytes of a column compressed with gzip, for speed and without a time stamp."""
    import gzip

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else gzip.compress(bytes(v), compresslevel=1, mtime=0))

    return df.withColumn(out, packed(F.col(column).cast("binary")))


def decompress(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add `out`: the bytes that gzip had compressed."""
    import gzip

    @F.pandas_udf("binary")
    def unpacked(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else gzip.decompress(bytes(v)))

    return df.withColumn(out, unpacked(F.col(column)))


def refreshed(entries: DataFrame, fetches: DataFrame) -> DataFrame:
    """Entries after their refresh: the payload of the latest fetch with status 200, if there is one.

    Columns: entries key, payload; fetches key, ts, req_id, status, payload. Failed fetches leave an entry as it is."""
    good = fetches.where("status = 200").groupBy("key").agg(F.max(F.struct("ts", "req_id", "payload")).alias("f"))
    joined = entries.join(good, "key", "left")
    return joined.withColumn("refreshed", F.col("f").isNotNull()).withColumn("payload", F.coalesce("f.payload", "payload")).drop("f")


def loaded(dump: DataFrame | None, generated: DataFrame | None, enabled: bool, use_dump: bool, use_generated: bool) -> DataFrame | None:
    """What a cache starts with: its dump and generated entries, as its settings say; None for nothing."""
    parts: Iterator[DataFrame] = (df for df, on in ((dump, use_dump), (generated, use_generated)) if enabled and on and df is not None)
    out = None
    for df in parts:
        out = df if out is None else out.unionByName(df)
    return out
