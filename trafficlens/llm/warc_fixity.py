"""Merkle fixity audit of WARC replicas.

Records are hashed where they are read; from then on only (file, offset, length, digest) travels. Each file's
records are hashed by ordered offset ranges: a leaf of the tree covers RANGE bytes of the file and hashes the
records that begin there, in order of offset; FAN_OUT neighbouring nodes make the node above, up to the file's
root. Two replicas are compared from the roots down, and only below nodes that differ are children, and in the
end records, compared. So an audit of sound replicas moves one row per file, and a damaged record costs one path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trafficlens.llm.util import checkpoint

RANGE = 1 << 16
FAN_OUT = 16
RECORDS_PER_FILE = 1000
MAX_HEADER = 1 << 16


def warc_record(uri: Column, record_id: Column, body: Column) -> Column:
    """The bytes of one WARC response record, as a string column (null uri and body count as empty)."""
    body, uri = F.coalesce(body, F.lit("")), F.coalesce(uri, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def lay_out(records: DataFrame, file_col: str, order: list[str], length_col: str) -> DataFrame:
    """Add warc_offset: where each record begins if each file's records are written in the given order.

    A file's records must fit one task's sort, as a file fits one writer."""
    before = Window.partitionBy(file_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("warc_offset", F.coalesce(F.sum(length_col).over(before), F.lit(0)).cast("long"))


def parse_warc(content: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """(offset, length, target uri, record bytes) of each record of an uncompressed WARC file.

    Bytes that can't be read as a record, up to the next "WARC/", come out as one record without uri, so that a
    damaged stretch still has its place in the tree. An empty file has no records."""
    at, end = 0, len(content)
    while at < end:
        stop, uri = end, ""
        head = content.find(b"\r\n\r\n", at, at + MAX_HEADER)
        lines = content[at:head].split(b"\r\n") if head >= 0 else []
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
        size = fields.get(b"content-length", b"")
        if lines and lines[0].startswith(b"WARC/") and size.isdigit() and head + 4 + int(size) <= end:
            stop = head + 4 + int(size)
            stop += 4 if content[stop : stop + 4] == b"\r\n\r\n" else 0
            uri = fields.get(b"warc-target-uri", b"").decode("utf-8", "replace")
        else:
            following = content.find(b"WARC/", at + 1)
            stop = following if following > 0 else end
        yield at, stop - at, uri, content[at:stop]
        at = stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(warc_file, warc_offset, warc_length, uri, record) of all WARC files below `path`, through Spark's reader."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                rows = [(file, *r) for r in parse_warc(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=["warc_file", "warc_offset", "warc_length", "uri", "record"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "warc_file string, warc_offset long, warc_length long, uri string, record binary")


def hash_records(records: DataFrame, record: Column, keep: list[str]) -> DataFrame:
    """Replace the record's bytes by their digest."""
    return records.select("warc_file", "warc_offset", "warc_length", F.sha2(record.cast("binary"), 256).alias("digest"), *keep)


def tree(hashed: DataFrame) -> DataFrame:
    """The leaves: (warc_file, node, hash), a node for each offset range in which records begin."""
    entry = F.struct("warc_offset", "warc_length", "digest")
    ranges = hashed.groupBy("warc_file", F.floor(F.col("warc_offset") / F.lit(RANGE)).cast("long").alias("node"))
    listed = ranges.agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    line = lambda e: F.concat_ws(":", e["warc_offset"].cast("string"), e["warc_length"].cast("string"), e["digest"])
    return listed.select("warc_file", "node", F.sha2(F.array_join(F.transform("entries", line), "\n"), 256).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    """One level up: a node's hash is over the numbers and hashes of its children, in order."""
    entry = F.struct("node", "hash")
    up = nodes.groupBy("warc_file", F.floor(F.col("node") / F.lit(FAN_OUT)).cast("long").alias("up"))
    listed = up.agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    line = lambda e: F.concat_ws(":", e["node"].cast("string"), e["hash"])
    return listed.select("warc_file", F.col("up").alias("node"), F.sha2(F.array_join(F.transform("entries", line), "\n"), 256).alias("hash"))


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(warc_file, node) of nodes whose hashes differ or that one replica lacks."""
    both = a.alias("a").join(b.alias("b"), ["warc_file", "node"], "full_outer")
    return both.where(~F.col("a.hash").eqNullSafe(F.col("b.hash"))).select("warc_file", "node")


def _below(nodes: DataFrame, damaged: DataFrame, step: int, column: str = "node") -> DataFrame:
    """The rows of `nodes` under a damaged node."""
    of = damaged.withColumnRenamed("node", "__up")
    return nodes.withColumn("__up", F.floor(F.col(column) / F.lit(step)).cast("long")).join(of, ["warc_file", "__up"], "left_semi").drop("__up")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Locate what differs between two replicas, given as hashed records (hash_records).

    Returns (warc_file, warc_offset, warc_length, digest, found_digest, status) for each record that differs:
    "corrupt" (bytes or length differ), "missing" (not in the replica) or "extra" (only there). Equal replicas,
    empty ones included, give no rows. Records that begin at one offset of a file are compared in order of
    length and digest, so repeated rows match each other one to one. Null files are one file.
    """
    same = ["warc_file", "warc_offset", "warc_length", "digest"]
    turn = Window.partitionBy("warc_file", "warc_offset").orderBy("warc_length", "digest")
    sides = [
        checkpoint(x.select(F.coalesce(F.col("warc_file").cast("string"), F.lit("")).alias("warc_file"), *same[1:]))
        for x in (primary, replica)
    ]
    levels = [tuple(checkpoint(tree(x)) for x in sides)]
    highest = max((x.agg(F.max("node")).first()[0] or 0) for x in levels[0])
    while highest:
        levels.append(tuple(checkpoint(parents(x)) for x in levels[-1]))
        highest //= FAN_OUT
    damaged = checkpoint(_differing(*levels.pop()))
    while levels:
        damaged = checkpoint(_differing(*(_below(x, damaged, FAN_OUT) for x in levels.pop())))
    left, right = (
        _below(x, damaged, RANGE, "warc_offset").withColumn("__turn", F.row_number().over(turn)) for x in sides
    )
    both = left.alias("a").join(right.alias("b"), ["warc_file", "warc_offset", "__turn"], "full_outer")
    a, b = F.col("a.digest"), F.col("b.digest")
    status = F.when(b.isNull(), "missing").when(a.isNull(), "extra").otherwise("corrupt")
    found = both.where(~a.eqNullSafe(b) | ~F.col("a.warc_length").eqNullSafe(F.col("b.warc_length")))
    return found.select(
        "warc_file", "warc_offset", F.coalesce("a.warc_length", "b.warc_length").alias("warc_length"),
        a.alias("digest"), b.alias("found_digest"), status.alias("status"),
    )
