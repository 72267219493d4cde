"""Appending to a hash-chained log of Parquet files.

A log folder holds ``entries/<commit folder>`` and ``heads/<number>.json``. A commit
writes its entries to a folder of its own, then claims the next number by renaming a
finished head file to it; the head names the folder, the batch, the last entry's number and
its hash. Readers follow heads only, so what a writer left behind when it died, or
when another one was faster, is never read. A batch id that has a head is not
appended again, which makes a retry safe.

The claim needs a file system whose rename does not replace an existing file (HDFS, and
object stores with conditional writes); elsewhere one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.operators import chain, ledger

HEAD_SCHEMA = "number bigint, batch_id string, folder string, first bigint, last bigint, hash string, block_entries bigint"
TRIES = 8


class Conflict(RuntimeError):
    """Other writers claimed every number this one tried."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def heads(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit."""
    fs, name = _fs(spark, path)
    if not fs.exists(name(f"{path}/heads")):
        return spark.createDataFrame([], HEAD_SCHEMA)
    return spark.read.schema(HEAD_SCHEMA).json(f"{path}/heads")


def _claim(spark: SparkSession, path: str, head: dict) -> bool:
    """Publish a head under its number, unless another one is there."""
    fs, name = _fs(spark, path)
    draft, goal = name(f"{path}/heads/_draft-{uuid.uuid4().hex}"), name(f"{path}/heads/{head['number']:012d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(head).encode()))
    out.close()
    if not fs.exists(goal) and fs.rename(draft, goal):
        return True
    fs.delete(draft, False)
    return False


def append(entries: DataFrame, path: str, batch_id: str, order: Sequence[str], block_entries: int = chain.BLOCK_ENTRIES, partition_by: str | None = None) -> dict:
    """Append ``entries`` to the log at ``path`` and return the head of their commit.

    Entries are numbered in ``order`` behind the last one, and chained to it. The same
    ``batch_id`` is appended once, however often it is sent. ``partition_by`` names a
    timestamp by whose day the files of the commit are laid out.
    """
    spark = entries.sparkSession
    for _ in range(TRIES):
        known = heads(spark, path)
        done = known.where(F.col("batch_id") == batch_id).first()
        if done:
            return done.asDict()
        last = known.orderBy(F.col("number").desc()).first()
        if last and last["block_entries"] != block_entries:
            raise ValueError(f"this log has blocks of {last['block_entries']} entries")
        after = (last["last"], last["hash"]) if last and last["last"] >= 0 else None
        numbered = ledger.numbered(entries, order, F.lit(after[0] if after else -1))
        payload = numbered.columns
        made = chain.build(numbered, "seq", payload, block_entries, after)
        folder = f"commit={uuid.uuid4().hex}"
        writer = (made.withColumn("day", F.to_date(partition_by)) if partition_by else made).write
        (writer.partitionBy("day") if partition_by else writer).parquet(f"{path}/entries/{folder}")
        written = spark.read.schema(made.schema).parquet(f"{path}/entries/{folder}")
        end = written.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.max_by("entry_hash", "seq").alias("hash")).first().asDict()
        if end["first"] is None:  # nothing new: the chain stays where it is
            folder, end = "", {"first": after[0] + 1 if after else 0, "last": after[0] if after else -1, "hash": after[1] if after else ""}
        head = {"number": last["number"] + 1 if last else 0, "batch_id": batch_id, "folder": folder, **end, "block_entries": block_entries}
        if _claim(spark, path, head):
            return head
    raise Conflict(path)


def read(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """The committed entries; with ``after`` only commits with entries behind that number."""
    commits = heads(spark, path).where((F.col("last") > after) & (F.col("folder") != "")).select("folder").collect()
    if not commits:
        raise FileNotFoundError(f"no entries at {path}")
    found = spark.read.option("basePath", f"{path}/entries").parquet(*[f"{path}/entries/{r['folder']}" for r in commits])
    return found.drop("commit").where(F.col("seq") > after)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(seq, issue, expected, found) over the whole log; a number that is missing
    breaks the chain behind it."""
    log = read(spark, path)
    payload = [c for c in log.columns if c not in ("block", "previous_hash", "entry_hash", "day")]
    return chain.verify(log, "seq", payload)
