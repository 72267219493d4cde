"""Streams that carry state of their own: quorums with deadlines, sealed blocks, matched requests.

State lives in RocksDB, small pages of requests or one row per epoch, and is found again when
a run goes on from its checkpoint. Every result row is written under the number of
its micro-batch, so a batch that is repeated replaces what it wrote before.
"""

from __future__ import annotations

import json
import pickle
import threading
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from math import fsum
from statistics import median
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from twinproof.operators import chain, ledger
from twinproof.operators.consensus import MAX_VARIANCE, QUORUM, THRESHOLD

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

EVENT_SCHEMA = """
    verification_id bigint, event_time timestamp, kind string, place bigint,
    verifier_id bigint, privacy double, utility double, fairness double
"""
EVENT_COLUMNS = ("verification_id", "event_time", "kind", "place", "verifier_id", "privacy", "utility", "fairness")
JUDGED_SCHEMA = """
    output string, verification_id bigint, verifier_id bigint, place bigint, reason string, num_verifiers bigint,
    privacy double, utility double, fairness double, overall double, variance double, status string
"""
JUDGED_COLUMNS = [c.split()[0] for c in JUDGED_SCHEMA.replace("\n", " ").split(",")]
REQUEST_BUCKETS = 4096  # requests of a bucket are judged by one call
PAGES = 16  # parts of a bucket's state, each written only when one of its requests changes
READ_TOGETHER = 8
NO_TIME = float("nan")  # neither before nor after any other time
NO_TIME_MS = -9223372036855


def as_milliseconds(micros) -> int:
    return NO_TIME_MS if micros != micros else micros // 1000


def _wholes(values: pd.Series) -> list:
    """Whole numbers or None; a column with nulls comes as floats."""
    return [None if pd.isna(x) else int(x) for x in values.tolist()] if values.hasnans else [int(x) for x in values.tolist()]


def _micros(times: pd.Series) -> list:
    out = times.to_numpy("datetime64[us]").astype("int64").tolist()
    return [NO_TIME if gone else t for t, gone in zip(out, times.isna().tolist())] if times.hasnans else out


class QuorumProcessor(StatefulProcessor):
    """The verification requests of a bucket: their seats, their deadlines, and what they refuse.

    A request event opens it. Submissions count until ``quorum`` verifiers
    have a seat or the deadline passes; every other one leaves as a reject with its reason:
    ``unknown`` (no such request), ``closed`` (verdict reached), ``expired`` (after the
    deadline), ``duplicate`` (the verifier has a seat), ``invalid`` (no verifier, or a score is
    missing). An event-time timer at the deadline gives the verdict ``expired``. A closed request stays closed; ``keep`` after its
    deadline it is forgotten, and its submissions are of an unknown request then.

    State is read and written a page of requests at a time: a call per request took most of a run.
    """

    def __init__(self, quorum: int, threshold: float, deadline_ms: int, keep_ms: int):
        self.quorum, self.threshold, self.deadline_ms, self.keep_ms = quorum, threshold, deadline_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        # a page: (deadline, due, closed, seats) by request
        self.state = handle.getMapState("pages", "page int", "requests binary")
        self.next = handle.getValueState("next", "due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pages = defaultdict(lambda: defaultdict(list))
        for pdf in rows:
            scores = [pdf[c].tolist() for c in ("privacy", "utility", "fairness")]
            events = zip(_micros(pdf["event_time"]), pdf["kind"].tolist(), _wholes(pdf["place"]), _wholes(pdf["verifier_id"]), *scores)
            for request, (time, kind, place, *submission) in zip(pdf["request"].tolist(), events):
                name = request or ""
                pages[crc32(name.encode()) % PAGES][name].append((time, kind, place or 0, *submission))
        # many pages are read at once, few one by one, none where the bucket is new
        held = {} if not self.state.exists() else {k[0]: v for k, v in self.state.iterator()} if len(pages) >= READ_TOGETHER else None
        out, dues = [], []
        for page, requests in pages.items():
            known = self.state.getValue((page,)) if held is None else held.get(page)
            kept = pickle.loads(known[0]) if known else {}
            changed = False
            for request, events in requests.items():
                before = kept.get(request)
                now = self.judge(request, before, events, dues, out)
                if now != before:
                    kept[request], changed = now, True
            if changed:
                self.state.updateValue((page,), (pickle.dumps(kept, 5),))
        if dues:
            self.wake(min(dues), self.next.get()[0] if self.next.exists() else None)
        yield self.frame(out)

    def judge(self, request: str, known: tuple | None, events: list, dues: list, out: list) -> tuple | None:
        """The request's state after its events; what they give goes to ``out``, the deadline to ``dues`` if they open it."""
        name = int(request) if request else None
        deadline, due, closed, seats = known or (None, None, None, ())
        seats, opened = list(seats), known is not None
        events.sort(key=lambda r: (r[0], r[1] != "request", r[2], r[3] or 0))
        for time, kind, place, *submission in events:
            if kind == "request":
                if not opened:
                    deadline = due = as_milliseconds(time) + self.deadline_ms
                    opened = True
                    dues.append(due)
                continue
            reason = self.refusal(opened, closed, deadline, time, submission, seats)
            if reason:
                out.append(("reject", name, submission[0], place, reason, None, None, None, None, None, None, None))
                continue
            seats.append(tuple(submission))
            if len(seats) == self.quorum:
                out.append(self.verdict(name, seats))
                closed, seats = "closed", []
        return (deadline, due, closed, tuple(seats)) if opened else None

    def wake(self, due: int, before: int | None) -> None:
        """A bucket waits for the earliest time at which one of its requests changes."""
        if before is None or due < before:
            self.next.update((due,))
            self.handle.registerTimer(due)

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=JUDGED_COLUMNS).astype({"verification_id": "Int64", "num_verifiers": "Int64", "verifier_id": "Int64", "place": "Int64"})

    def refusal(self, opened, closed, deadline, time, submission, seats) -> str | None:
        if not opened:
            return "unknown"
        if closed:
            return closed
        if as_milliseconds(time) > deadline:
            return "expired"
        if any(s[0] == submission[0] for s in seats):
            return "duplicate"
        return "invalid" if any(x is None or x != x for x in submission) else None

    def verdict(self, request, seats, status=None) -> tuple:
        _, privacy, utility, fairness = zip(*seats) if seats else ((), (), (), ())
        overall = [0.4 * p + 0.35 * u + 0.25 * f for p, u, f in zip(privacy, utility, fairness)]
        if status or not seats:
            return ("verdict", request, None, None, None, len(seats), None, None, None, None, None, status)
        middle, mean = median(overall), fsum(overall) / len(overall)
        variance = fsum((x - mean) ** 2 for x in overall) / len(overall)
        status = "consensus_failed" if round(variance, 9) > MAX_VARIANCE else "approved" if middle >= self.threshold else "rejected"
        return ("verdict", request, None, None, None, len(seats), median(privacy), median(utility), median(fairness), middle, variance, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.next.exists() and self.next.get()[0] == expiredTimerInfo.getExpiryTimeInMs():  # else an earlier one did its work
            now, rest = timerValues.getCurrentWatermarkInMs(), []
            for (page,), (data,) in list(self.state.iterator()):
                kept, changed = pickle.loads(data), False
                for request, (deadline, due, closed, seats) in list(kept.items()):
                    if due > now:
                        rest.append(due)
                        continue
                    changed = True
                    if due > deadline:
                        del kept[request]
                        continue
                    if not closed:
                        out.append(self.verdict(int(request) if request else None, seats, "expired"))
                    kept[request] = (deadline, deadline + self.keep_ms, closed or "expired", ())
                    rest.append(deadline + self.keep_ms)
                if changed and kept:
                    self.state.updateValue((page,), (pickle.dumps(kept, 5),))
                elif changed:
                    self.state.removeKey((page,))
            self.next.clear()
            if rest:
                self.wake(min(rest), None)
        yield self.frame(out)

    def close(self) -> None:
        pass


def judged_stream(events: DataFrame, deadline: timedelta, late: str = "0 seconds", quorum: int = QUORUM, threshold: float = THRESHOLD, keep: timedelta = timedelta(days=365)) -> DataFrame:
    """Verdicts and rejects (``output``) of requests and submissions, as one stream of ``EVENT_SCHEMA``.

    ``late`` is how far behind the newest event one may come; later ones are dropped and
    counted in the query's progress. Inside a micro-batch events count by time, then ``place``.
    """
    milliseconds = [int(d.total_seconds() * 1000) for d in (deadline, keep)]
    bucket = F.pmod(F.xxhash64("verification_id"), F.lit(REQUEST_BUCKETS)).alias("bucket")
    # the name as text: a number beside nulls would come as a float
    return (
        events.select(bucket, F.col("verification_id").cast("string").alias("request"), *EVENT_COLUMNS[1:])
        .withWatermark("event_time", late)
        .groupBy("bucket")
        .transformWithStateInPandas(QuorumProcessor(quorum, threshold, *milliseconds), JUDGED_SCHEMA, "append", "EventTime")
    )


SEALED_SCHEMA = "index bigint, n_entries bigint, first_timestamp string, last_timestamp string, digest string, previous_hash string, hash string"
SEALED_COLUMNS = [c.strip().split()[0] for c in SEALED_SCHEMA.split(",")]


class SealProcessor(StatefulProcessor):
    """One epoch of the ledger: the last hash, and the digests of entries not sealed yet.

    A block leaves when all its entries are here and the block before has left.
    Entries may come in any order; those of sealed blocks that come again are ignored.
    """

    def __init__(self, block_entries: int, epoch_blocks: int):
        self.block_entries, self.epoch_blocks = block_entries, epoch_blocks

    def init(self, handle) -> None:
        self.state = handle.getValueState("open", "next_block bigint, last_hash string, seqs array<bigint>, digests array<string>, times array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        epoch, size = int(key[0]), self.block_entries
        if self.state.exists():
            block, last, *held = self.state.get()
        else:
            block, last, held = epoch * self.epoch_blocks, sha256(f"genesis:1:{epoch}".encode()).hexdigest(), ([], [], [])
        waiting = {int(s): (d, t) for s, d, t in zip(*[list(x or []) for x in held])}
        for pdf in rows:
            waiting.update((int(s), (d, t)) for s, d, t in zip(pdf["seq"], pdf["digest"], pdf["timestamp"]) if s >= block * size)
        out, end = [], (epoch + 1) * self.epoch_blocks
        while block < end and all(s in waiting for s in range(block * size, (block + 1) * size)):
            entries = [waiting.pop(s) for s in range(block * size, (block + 1) * size)]
            digest = sha256(",".join(d for d, _ in entries).encode()).hexdigest()
            own = sha256(f"{last}:{digest}".encode()).hexdigest()
            times = [t for _, t in entries]
            out.append((block, size, min(times), max(times), digest, last, own))
            block, last = block + 1, own
        seqs = sorted(waiting)
        self.state.update((block, last, seqs, [waiting[s][0] for s in seqs], [waiting[s][1] for s in seqs]))
        yield pd.DataFrame(out, columns=SEALED_COLUMNS)

    def close(self) -> None:
        pass


def sealed_stream(entries: DataFrame, block_entries: int = 100, epoch_blocks: int = chain.EPOCH_BLOCKS) -> DataFrame:
    """Full blocks of a stream of ledger entries, each chained to the one before it in its epoch.

    Digests, the costly part, are computed in parallel before the state; epochs
    are chains of their own, so they are sealed side by side, and ``chain.seal`` joins
    their last hashes above. The hashes are those of the batch chain.
    """
    epoch = F.floor(F.col("seq") / (block_entries * epoch_blocks))
    return ledger.digests(entries).withColumn("epoch", epoch).groupBy("epoch").transformWithStateInPandas(
        SealProcessor(block_entries, epoch_blocks), SEALED_SCHEMA, "append", "None"
    )


def first_matches(requests: DataFrame, pending: DataFrame, within: str, late: str = "0 seconds", window: str = "1 day") -> DataFrame:
    """(request_id, data_hash, verification_id): each request joined to the earliest pending
    verification of its data hash that was created up to ``within`` after it.

    A stream-stream join: both sides have watermarks and the time range bounds what is kept of
    either. The first match per request is known, and leaves, once the watermark
    has passed the requests of its ``window``.
    """
    left = requests.select("request_id", F.col("data_hash").alias("wanted"), "requested_at").withWatermark("requested_at", late)
    right = pending.select("verification_id", "data_hash", "created_at").withWatermark("created_at", late)
    met = left.join(right, F.expr(f"wanted = data_hash AND created_at >= requested_at AND created_at <= requested_at + INTERVAL {within}"))
    first = F.min_by("verification_id", F.struct("created_at", "verification_id")).alias("verification_id")
    return met.groupBy(F.window("requested_at", window).alias("asked"), "request_id", "data_hash").agg(first).select("request_id", "data_hash", "verification_id")


# ------------------------------------------------------------------ running them


@contextmanager
def rocksdb(spark: SparkSession):
    """State of the queries started inside is kept in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def advance(stream: DataFrame, folder: str, partition_by: str | None = None) -> None:
    """Process all input there is now and stop; the next call goes on from there.

    Each micro-batch is written once, in a folder of its own number.
    """

    def write(batch: DataFrame, number: int) -> None:
        writer = batch.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{folder}/out/batch={number}")

    with rocksdb(stream.sparkSession):
        query = stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()


def results(spark: SparkSession, folder: str, schema: str, after: int = -1) -> DataFrame:
    """What the run wrote, with its ``batch``; only batches after ``after`` are read."""
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/out").where(F.col("batch") > after)


def closing_rows(like: DataFrame, time: str, at: datetime, **values) -> DataFrame:
    """One row far in the future: it moves the watermark past everything before it, so that
    windows, sessions and joins still open leave. Readers drop it by its time."""
    row = [F.lit(at).cast("timestamp").alias(c) if c == time else F.lit(values.get(c)).cast(dict(like.dtypes)[c]).alias(c) for c in like.columns]
    return like.sparkSession.range(1).select(*row)


PROGRESS_SCHEMA = "run_id string, batch bigint, operator int, name string, rows_in bigint, rows_dropped bigint, rows_updated bigint, rows_total bigint, watermark string"


class ProgressLog(StreamingQueryListener):
    """Writes one row per stateful operator and micro-batch of the queries it watches: rows
    that came after the watermark and were dropped, and rows of state.

    ``rows_dropped`` counts what reaches the operator: single events for quorums,
    sessions' and windows' partial counts for aggregations.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.running: set[str] = set()
        self.change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        # called before start() returns
        with self.change:
            self.running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        rows = [
            (p["runId"], p["batchId"], i, o["operatorName"], p["numInputRows"], o.get("numRowsDroppedByWatermark", 0), o.get("numRowsUpdated", 0), o.get("numRowsTotal", 0), (p.get("eventTime") or {}).get("watermark"))
            for i, o in enumerate(p["stateOperators"])
        ]
        if rows:
            self.spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.parquet(f"{self.folder}/progress-{uuid.uuid4().hex}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.running.discard(str(event.runId))
            self.change.notify_all()

    def wait(self, seconds: float) -> None:
        """Until the queries seen so far have ended; their progress was written before."""
        with self.change:
            if not self.change.wait_for(lambda: not self.running, seconds):
                raise TimeoutError(f"queries still run after {seconds} seconds: {sorted(self.running)}")


@contextmanager
def watched(spark: SparkSession, folder: str, wait_seconds: float = 60.0):
    """Progress of the queries run inside goes to ``folder``; all of it is there at the end."""
    log = ProgressLog(spark, folder)
    spark.streams.addListener(log)
    try:
        yield log
        log.wait(wait_seconds)
    finally:
        spark.streams.removeListener(log)


def progress(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PROGRESS_SCHEMA).parquet(f"{folder}/progress-*")
