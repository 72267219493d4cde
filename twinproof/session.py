"""Session settings and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the library is tuned for. Cluster sizing (shuffle partitions, split
# size, memory) is left to the cluster's own defaults unless a caller sets it.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

MAX_BUILDERS = 8
TASK_ROWS = 250_000  # rows of many small groups that one task holds
_LOCAL_DIRS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def build_session(app_name: str = "twinproof", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the recommended settings; keyword settings win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables, as named by ``spark.checkpoint.dir``.

    Only a local-mode session, which has a single machine, may fall back to a
    temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_DIRS:
        _LOCAL_DIRS[key] = tempfile.mkdtemp(prefix="twinproof-")
    return _LOCAL_DIRS[key]


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage durably (a lost executor costs nothing that was already
    written) and gives the planner the true size of the table, so it
    broadcasts the table only when it is below the broadcast threshold.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; ``release`` deletes what is written there."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote; results still
    built on them must have been written or collected before. Returns how many."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in paths:
        target = hadoop.Path(p)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def build_together(spark: SparkSession, jobs: Sequence[Callable[[], DataFrame]]) -> list[DataFrame]:
    """Results of several plan builders, run side by side.

    Building a plan may run small jobs (sizes, dictionaries, written tables);
    independent ones then share the cluster instead of queueing.
    """
    jobs = list(jobs)
    if len(jobs) < 2:
        return [job() for job in jobs]
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=min(MAX_BUILDERS, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]


def bucket_count(spark: SparkSession) -> int:
    """Range buckets for distributed running totals: follows shuffle width."""
    return max(8, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def deal_count(df: DataFrame, keys: Sequence[str]) -> int | None:
    """Into how many tasks ``df`` can be dealt by ``keys`` at about ``TASK_ROWS`` rows each.

    A fixed number of shuffle partitions lets the memory of a task grow with the table;
    this one follows the rows. None: the table is one task's share as it is, or a key is so
    large that its task would hold many times that.
    """
    rows = df.count()
    if rows <= TASK_ROWS:
        return None
    tasks = max(-(-rows // TASK_ROWS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.pmod(F.hash(*keys), F.lit(tasks))  # the task that ``repartition`` sends a row to
    largest = df.groupBy(place.alias("place")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return tasks if largest <= 4 * TASK_ROWS else None


def dealt(df: DataFrame, keys: Sequence[str], tasks: int | None) -> DataFrame:
    """``df`` dealt by ``keys`` over ``tasks`` (of ``deal_count``), or as it is.

    Groupings, windows and joins by these keys then need no further shuffle.
    """
    return df if tasks is None else df.repartition(tasks, *keys)
