"""Binary form of payloads and entries: fields with their lengths before them, all numbers little-endian.

Packing is a Column expression; unpacking reads each value in one pass, in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "payload is empty"
CUT = "payload is cut short"
_HEADERS = "array<struct<k: string, v: string>>"


def little(n: Column, size: int) -> Column:
    """A whole number as `size` bytes, the lowest first; negative ones as their two's complement."""
    digits = F.substring(F.lpad(F.hex(n.cast("bigint")), 16, "0"), 17 - 2 * size, 2 * size)
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def sized(value: Column) -> Column:
    """Bytes with their length before them; null counts as empty."""
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    return F.concat(little(F.octet_length(raw), 4), raw)


def pack_payload(path: Column, query: Column, request_headers: Column, status: Column, response_headers: Column, body: Column) -> Column:
    """Path, query, request headers, status, response headers (each with its number of values, one) and body."""

    def listed(headers: Column, between: Column) -> Column:
        known = F.coalesce(headers, F.array().cast(_HEADERS))
        joined = F.aggregate(known, F.lit(b""), lambda acc, h: F.concat(acc, sized(h["k"]), between, sized(h["v"])))
        return F.concat(little(F.size(known), 4), joined)

    return F.concat(
        sized(path), sized(query), listed(request_headers, F.lit(b"")), little(status, 4), listed(response_headers, little(F.lit(1), 4)), sized(body)
    )


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        (n,) = struct.unpack_from("<I", self.data, self.at)
        self.at += 4
        return n

    def text(self) -> str:
        n = self.number()
        if self.at + n > len(self.data):
            raise struct.error
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")


def read_payload(data: bytes | None) -> tuple:
    """(path, query, request headers, status, response headers, body, error) of one payload."""
    if not data:
        return None, None, None, None, None, None, EMPTY
    r = _Reader(bytes(data))
    try:
        path, query = r.text(), r.text()
        asked = [{"k": r.text(), "v": r.text()} for _ in range(r.number())]
        status, answered = r.number(), []
        for _ in range(r.number()):
            name = r.text()
            answered += [{"k": name, "v": r.text()} for _ in range(r.number())]
        r.number()  # the body is all that is left
        return path, query, asked, status, answered, r.data[r.at :], None
    except struct.error:
        return None, None, None, None, None, None, CUT


def unpack_payloads(rows: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """The columns of `keep`, and path, query, request_headers, status, response_headers, body and error."""
    names = ["path", "query", "request_headers", "status", "response_headers", "body", "error"]
    kinds = ["string", "string", _HEADERS, "int", _HEADERS, "binary", "string"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {k}" for n, k in zip(names, kinds)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            read = pd.DataFrame([read_payload(x) for x in f["__payload"]], columns=names, index=f.index, dtype=object)
            read["status"] = read["status"].astype("Int32")
            yield pd.concat([f[keep], read], axis=1)

    return rows.select(*keep, F.col(payload).alias("__payload")).mapInPandas(run, schema)


def pack_entry(rule_path: Column, key: Column, shard: Column, fingerprint: Column, refreshed_at: Column, payload: Column) -> Column:
    """Rule, key, shard, fingerprint (16 bytes), time of the last refresh (ns) and payload."""
    return F.concat(sized(rule_path), little(key, 8), little(shard, 8), fingerprint, little(refreshed_at, 8), sized(payload))


def unpack_entries(rows: DataFrame, record: str, rules: DataFrame) -> DataFrame:
    """(rule_path, key, shard, fingerprint, refreshed_at, payload, error); an entry whose rule isn't configured is an error,
    and so is a record that is cut short. Rules are configuration: they fit a broadcast by nature."""
    fixed = "<QQ16sq"

    def read(data: bytes) -> tuple:
        r = _Reader(bytes(data or b""))
        try:
            rule = r.text()
            key, shard, fingerprint, at = struct.unpack_from(fixed, r.data, r.at)
            r.at += struct.calcsize(fixed)
            n = r.number()
        except struct.error:
            return None, None, None, None, None, None, CUT
        whole = r.at + n <= len(r.data)
        return rule, key - (1 << 64) * (key >> 63), shard, fingerprint, at, r.data[r.at : r.at + n] if whole else None, None if whole else CUT

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([read(x) for x in f["r"]], columns=["rule_path", "key", "shard", "fingerprint", "refreshed_at", "payload", "error"], dtype=object)
            yield out.astype({"key": "Int64", "shard": "Int64", "refreshed_at": "Int64"})

    schema = "rule_path string, key bigint, shard bigint, fingerprint binary, refreshed_at bigint, payload binary, error string"
    read_ = rows.select(F.col(record).alias("r")).mapInPandas(run, schema)
    known = F.broadcast(rules.select(F.col("path").alias("rule_path"), F.lit(True).alias("__known")).distinct())
    missing = F.concat(F.lit("rule not found for path: '"), "rule_path", F.lit("'"))
    found = read_.join(known, "rule_path", "left")
    return found.withColumn("error", F.coalesce("error", F.when(F.col("__known").isNull(), missing))).drop("__known")
