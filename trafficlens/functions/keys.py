"""Canonical cache keys: parse, filter by prefix, sort, concatenate, hash and shard, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 2048


def query_of(url: Column) -> Column:
    """The query string of a url: between the first ? and #; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def path_of(url: Column) -> Column:
    """The path of a url; empty for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1)


def parse_pairs(query: Column, decode: bool = False) -> Column:
    """Pairs (k, v, at) of a query string, in order.

    A pair's key ends at its first "="; without one its value is empty. Leading question marks are dropped. With
    `decode`, percent escapes and "+" are decoded, and what can't be decoded stays as it is.
    """
    parts = F.split(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?+", ""), "&")
    read = lambda x: F.coalesce(F.try_url_decode(x), x) if decode else x

    def pair(part: Column, at: Column) -> Column:
        key = F.regexp_extract(part, r"(?s)^([^=]*)", 1)
        value = F.regexp_extract(part, r"(?s)^[^=]*=(.*)$", 1)
        return F.struct(read(key).alias("k"), read(value).alias("v"), at.alias("at"))

    return F.transform(parts, pair)


def keep_prefixed(pairs: Column, allowed: Column | list[str]) -> Column:
    """The pairs whose key begins with one of the allowed prefixes. An empty key is never kept."""
    prefixes = F.array(*[F.lit(a) for a in allowed]).cast("array<string>") if isinstance(allowed, list) else allowed
    return F.filter(pairs, lambda p: (p["k"] != "") & F.exists(F.coalesce(prefixes, F.array().cast("array<string>")), lambda a: p["k"].startswith(a)))


def sort_pairs(pairs: Column) -> Column:
    """A stable sort by key, bytewise: equal keys keep their order whatever their values."""
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), p["at"].alias("at"), p["v"].alias("v"))))
    return F.transform(ordered, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))


def key_headers(headers: Column, names: list[str]) -> Column:
    """The first non-empty value of each listed header, sorted by name, as pairs (k, v).

    `headers` is an array of (k, v). A header whose first value is empty is left out, as if it were not sent.
    """
    indexed = F.transform(F.array(*[F.lit(n) for n in sorted(set(names))]).cast("array<string>"), lambda n: F.struct(n.alias("k"), F.element_at(F.concat(F.transform(F.filter(headers, lambda h: h["k"] == n), lambda h: h["v"]), F.array(F.lit(""))), 1).alias("v")))
    return F.filter(indexed, lambda p: F.length(p["v"]) > 0)


def response_headers(headers: Column, allowed: list[str]) -> Column:
    """The response headers to store: the allowed ones, or all if none is named."""
    if not allowed:
        return headers
    names = F.array(*[F.lit(a) for a in allowed])
    return F.filter(headers, lambda h: F.array_contains(names, h["k"]))


def canonical(query_pairs: Column, header_pairs: Column | None = None, path: Column | None = None) -> Column:
    """What is hashed: keys and values without delimiters, queries before headers.

    The path takes no part unless it is given, so rules with the same pairs share an entry.
    """
    flat = lambda pairs: F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], p["v"])), "")
    parts = [flat(query_pairs)] + ([flat(header_pairs)] if header_pairs is not None else [])
    return F.concat(*([path] if path is not None else []), *parts)


def fingerprint(key: Column) -> Column:
    """A portable 128-bit fingerprint of a canonical key."""
    return F.md5(key)


def shard_of(key: Column, shards: int = SHARDS) -> Column:
    """The shard of a canonical key, from the first 32 bits of its fingerprint."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def shard_of_hash(key64: Column, shards: int = SHARDS) -> Column:
    """The shard of a 64-bit key; shards divide 2^64, so the sign makes no difference."""
    return F.pmod(key64, F.lit(shards)).cast("int")


def xxh3(key: Column | str) -> Column:
    """XXH3 of a canonical key as (key64, fingerprint): 64 bits, and 128 bits with the low half first, little-endian."""

    @F.pandas_udf("key64 long, fingerprint binary")
    def hashed(keys: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = []
        for k in keys:
            data = k.encode("utf-8") if isinstance(k, str) else bytes(k or b"")
            low = xxhash.xxh3_64_intdigest(data)
            rows.append((low - (1 << 64) if low >> 63 else low, xxhash.xxh3_128_intdigest(data).to_bytes(16, "little")))
        return pd.DataFrame(rows, columns=["key64", "fingerprint"])

    return hashed(key)
