"""Snapshots of the storage: versions of entries partitioned by shard, and a framed binary format with checksums."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = struct.Struct("<II")
MAX_RECORD = 1 << 30
FILE_ROWS = 5_000_000


class Versions:
    """The version folders v1, v2, ... below a base path, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def listed(self) -> list[tuple[int, str, int]]:
        """(time of change in ms, name, number) of each version folder."""
        if not self._fs.exists(self._path(self.base)):
            return []
        found = [(s.getModificationTime(), s.getPath().getName()) for s in self._fs.listStatus(self._path(self.base)) if s.isDirectory()]
        return [(t, n, int(n[1:])) for t, n in found if re.fullmatch(r"v[0-9]+", n)]

    def next(self) -> str:
        """The folder of the next version: one more than the largest number."""
        return f"{self.base}/v{max((n for _, _, n in self.listed()), default=0) + 1}"

    def latest(self) -> str | None:
        """The folder that changed last, whatever its number; of two that changed at once the larger number."""
        return f"{self.base}/{max((t, n, name) for t, name, n in self.listed())[2]}" if self.listed() else None

    def rotate(self, keep: int) -> list[str]:
        """Delete all but the `keep` folders that changed last."""
        old = sorted(((t, n, name) for t, name, n in self.listed()), reverse=True)[keep:]
        for _, _, name in old:
            self._fs.delete(self._path(f"{self.base}/{name}"), True)
        return [name for _, _, name in old]

    def size(self) -> int:
        """Bytes below the base path."""
        return self._fs.getContentSummary(self._path(self.base)).getLength() if self._fs.exists(self._path(self.base)) else 0


def dump(entries: DataFrame, base: str, keep: int = 3, compression: str = "snappy") -> str:
    """Write a version, one folder for each shard that has entries, then drop versions beyond `keep`.

    Rows are dealt out by shard first. A shard with more rows than FILE_ROWS is dealt to several tasks and files, by its
    own count, so none is as large as the heaviest shard. Spark's commit makes the files visible only when all are there.
    """
    sizes = F.broadcast(entries.groupBy("shard").agg(F.count(F.lit(1)).alias("__n")))  # one row a shard
    part = F.floor(F.rand(17) * F.ceil(F.col("__n") / F.lit(FILE_ROWS)))
    entries = entries.join(sizes, entries["shard"].eqNullSafe(sizes["shard"])).drop(sizes["shard"]).withColumn("__part", part).drop("__n")
    versions = Versions(entries.sparkSession, base)
    target = versions.next()
    entries.repartition("shard", "__part").drop("__part").write.partitionBy("shard").option("compression", compression).parquet(target)
    versions.rotate(keep)
    return target


def load(spark: SparkSession, base: str, version: str | None = None) -> DataFrame:
    """The entries of a version ("v3"), or of the one that changed last."""
    path = f"{base.rstrip('/')}/{version}" if version else Versions(spark, base).latest()
    if path is None:
        raise FileNotFoundError(f"no version below {base}")
    return spark.read.parquet(path)


def known_rules(entries: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loaded entries whose rule is configured, and those that must be dropped because theirs is not."""
    paths = F.broadcast(rules.select("path"))
    return entries.join(paths, "path", "left_semi"), entries.join(paths, "path", "left_anti")


# ---- frames --------------------------------------------------------------------------------------------------


def frame(record: Column, checksum: bool = True) -> Column:
    """A record with its length and CRC-32 before it, both 32 bits little-endian; without a checksum 0."""
    little = lambda n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n), 8, "0"), k, 2) for k in (7, 5, 3, 1)]))
    crc = F.crc32(record) if checksum else F.lit(0).cast("bigint")
    return F.concat(little(F.octet_length(record).cast("bigint")), little(crc), record)


def read_frames(data: bytes, check: bool = True) -> Iterator[tuple[int, bytes | None, str]]:
    """(offset, record, status) of each frame: "ok", "bad checksum", or "truncated", after which nothing more is read."""
    at = 0
    while at < len(data):
        if at + HEADER.size > len(data):
            yield at, None, "truncated"
            return
        size, crc = HEADER.unpack_from(data, at)
        body = data[at + HEADER.size : at + HEADER.size + size]
        if size > MAX_RECORD or len(body) < size:
            yield at, None, "truncated"
            return
        good = not check or zlib.crc32(body) == crc
        yield at, body if good else None, "ok" if good else "bad checksum"
        at += HEADER.size + size


def read_framed(files: DataFrame, check: bool = True) -> DataFrame:
    """(path, offset, record, status) from rows (path, content), as spark.read.format("binaryFile") gives them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                rows = [(path, *r) for r in read_frames(bytes(content), check)]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "offset", "record", "status"])

    return files.select("path", "content").mapInPandas(run, "path string, offset bigint, record binary, status string")


def latest_files(names: DataFrame, leftovers: bool = True) -> DataFrame:
    """Of dump files <name>-shard-<k>-<stamp>.dump, those of the greatest stamp.

    The stamp is all that follows the last dash but a final ".dump", so that "x.dump.gz" and a leftover "x.dump.tmp" have
    stamps of their own, which sort after "x". With `leftovers` false, files being written (.tmp) are left out, and a
    compressed file has the stamp of a plain one."""
    if leftovers:
        parts = F.split("name", "-")
        last = F.element_at(parts, -1)
        stamped = names.withColumn("stamp", F.when(F.size(parts) >= 4, F.regexp_replace(last, r"\.dump$", "")))
    else:
        stamped = names.withColumn("stamp", F.regexp_extract("name", r"-([0-9]{8}T[0-9]{6})\.dump(?:\.gz)?$", 1))
    stamped = stamped.where("stamp <> ''")
    greatest = stamped.agg(F.max("stamp").alias("stamp"))
    return stamped.join(F.broadcast(greatest), "stamp", "left_semi")
