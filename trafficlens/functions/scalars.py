"""Scalar functions of the cache: formats, times, payload comparison, weights and state names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
STATES = ("healthy", "sick", "dead", "buried")


def fmt_mem(n: Column) -> Column:
    """Bytes in two units of 1024, e.g. "3MB 17KB"; below 1 KB one, e.g. "17B"."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.format_string("%dB", n)
    for power in range(1, 5):
        big = F.shiftright(n, 10 * power)
        small = F.shiftright(n.bitwiseAND(F.lit((1 << 10 * power) - 1)), 10 * (power - 1))
        out = F.when(n >= (1 << 10 * power), F.format_string(f"%d{units[power]} %d{units[power - 1]}", big, small)).otherwise(out)
    return out


def fmt_bytes(n: Column) -> Column:
    """Bytes in units of 1000 with one decimal, e.g. "1.5 kB"; below 1000 whole, e.g. "17 B"."""
    out = F.format_string("%d B", n)
    for power, unit in enumerate("kMGTPE", 1):
        # format_number rounds the exact value of the double, halves to even
        number = F.call_function("format_number", n / F.lit(float(1000**power)), F.lit("0.0"))
        out = F.when(n >= 1000**power, F.concat(number, F.lit(f" {unit}B"))).otherwise(out)
    return out


def rfc1123(ts: Column) -> Column:
    """A header time, e.g. "Mon, 02 Jan 2006 15:04:05 UTC"; null for null."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'UTC'")


def rfc1123_ns(ns: Column) -> Column:
    """The same from unix nanoseconds; zero stands for never and gives null."""
    return F.when(ns != 0, rfc1123(F.timestamp_seconds(F.floor(ns / F.lit(NS)).cast("bigint"))))


def dump_stamp(ts: Column) -> Column:
    """The time in a dump file's name, e.g. "20060102T150405"."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def version_number(name: Column) -> Column:
    """The number of a version folder ("v12"); the largest integer for any other name."""
    return F.coalesce(F.regexp_extract(name, r"^v([0-9]{1,18})$", 1).try_cast("bigint"), F.lit((1 << 63) - 1))


def duration_ns(text: str) -> int:
    """Nanoseconds of a duration such as "24h", "1h30m" or "500ms"."""
    import re

    unit = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": NS, "m": 60 * NS, "h": 3600 * NS}
    parts = re.findall(r"([0-9.]+)(ns|us|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text}")
    return round(sum(float(a) * unit[b] for a, b in parts))


def error_body(status: Column, message: Column) -> Column:
    """An error response as JSON."""
    return F.to_json(F.struct(F.struct(status.alias("status"), message.alias("message")).alias("error")))


def backend_name(backend: Column, scheme: Column, host: Column) -> Column:
    return F.format_string("%s (%s://%s)", backend, scheme, host)


def exact_equal(a: Column, b: Column) -> Column:
    """Whether two payloads are the same; two missing ones are."""
    return a.eqNullSafe(b)


def signature(x: Column) -> Column:
    """What comparing a payload needs of it: length, SHA-256, and the XOR of the hashes of its first eight bytes, eight
    from the middle and the last eight. A hundred bytes or so, however long the payload."""
    n = F.octet_length(x)
    middle = F.substring(x, (F.floor(n / 2) + 1).cast("int"), F.lit(8))
    ends = F.xxhash64(F.substring(x, F.lit(1), F.lit(8))).bitwiseXOR(F.xxhash64(F.substring(x, (n - 7).cast("int"), F.lit(8))))
    return F.struct(n.alias("n"), F.sha2(x, 256).alias("sha"), ends.bitwiseXOR(F.xxhash64(middle)).alias("probes"))


def same_by_probes(a: Column, b: Column) -> Column:
    """The heuristic comparison of two signatures: equal length and, from 32 bytes on, equal probes. It can take different
    payloads for equal."""
    same = F.when(a["n"] < 32, a["sha"] == b["sha"]).otherwise(a["probes"] == b["probes"])
    return F.coalesce(F.when(a["n"] == b["n"], same).otherwise(F.lit(False)), F.lit(False))


def probe_equal(a: Column, b: Column) -> Column:
    """The heuristic comparison of two binary payloads."""
    return same_by_probes(signature(a), signature(b))


def pairs_weight(pairs: Column, each: int) -> Column:
    return F.aggregate(F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>")), F.lit(0).cast("bigint"), lambda n, p: n + F.lit(each) + F.octet_length(p["k"]) + F.octet_length(p["v"]))


def entry_weight(path: Column, query: Column, body_bytes: Column, request: Column | None = None, response: Column | None = None) -> Column:
    """The bytes an entry takes: 88 and its parts, with 8 for each request header and 12 for each response header."""
    size = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    total = F.lit(88).cast("bigint") + size(path) + size(query) + F.coalesce(body_bytes, F.lit(0))
    for pairs, each in ((request, 8), (response, 12)):
        if pairs is not None:
            total = total + pairs_weight(pairs, each)
    return total


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def hex_token(seed: str, of: Column) -> Column:
    """A token of 16 bytes in hex for each row; the seed takes the place of chance, so that a run can be repeated."""
    return F.md5(F.concat(F.lit(f"{seed}:"), of.cast("string")))
