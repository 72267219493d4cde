"""Streaming queries and their batch twins.

Inputs are cut by time and arrive slice by slice: each slice is one run that goes on from
the state and the checkpoint of the run before.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from twinproof.catalog.pairs import AUDIT_SQL, audit_shape, table
from twinproof.catalog.record_queries import BLOCK_SQL, CONSENSUS_SQL, ledger_log, ledger_shape
from twinproof.catalog.registry import query
from twinproof.functions.scalar import round6
from twinproof.operators import consensus, ledger
from twinproof.session import shared_dir
from twinproof.streaming import live, stateful

FINALS = ("privacy", "utility", "fairness", "overall")
END = datetime(2200, 1, 1)


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _arrive(df, path: str, keep=None) -> None:
    (df if keep is None else df.where(keep)).write.mode("append").parquet(path)


def _slices(column: str, cuts) -> list:
    """Conditions that cut rows by the column, in order, with nothing left over."""
    edges = [None, *cuts, None]
    c = F.col(column)
    return [(c >= a if a is not None else F.lit(True)) & (c < b if b is not None else F.lit(True)) for a, b in zip(edges, edges[1:])]


def _scores():
    return ((F.col("l_quantity") * 2).alias("privacy"), (F.col("l_discount") * 1000).alias("utility"), (100 - F.col("l_tax") * 500).alias("fairness"))


def _event(df, kind: str, time: str):
    have = set(df.columns)
    kinds = {"place": "bigint", "verifier_id": "bigint", "privacy": "double", "utility": "double", "fairness": "double"}
    rest = [F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    return df.select("verification_id", F.col(time).cast("timestamp").alias("event_time"), F.lit(kind).alias("kind"), *rest)


# ---------------------------------------------------------------------- quorums


@query("stream_consensus", CONSENSUS_SQL)
def stream_consensus(spark, sf):
    """Verdicts of all requests; submissions come in three runs, by line number."""
    folder = _folder(spark, "stream-consensus")
    items = table(spark, sf, "lineitem")
    start = datetime(2000, 1, 1)
    opened = items.select(F.col("l_orderkey").alias("verification_id"), F.lit(start).alias("t")).distinct()
    place = F.col("l_partkey") * 1_000_000 + F.col("l_quantity").cast("bigint") * 1000 + F.col("l_suppkey") % 1000
    sent = items.select(
        F.col("l_orderkey").alias("verification_id"), F.col("l_suppkey").alias("verifier_id"), place.alias("place"), *_scores(), F.expr("TIMESTAMP'2000-01-01' + make_dt_interval(l_linenumber)").alias("t")
    )
    events = _event(opened, "request", "t").unionByName(_event(sent, "submission", "t"))
    for keep in _slices("event_time", [start + timedelta(days=3), start + timedelta(days=5)]):
        _arrive(events, f"{folder}/in", keep)
        stateful.advance(stateful.judged_stream(live.read_stream(spark, f"{folder}/in"), timedelta(days=3650)), folder, "output")
    out = stateful.results(spark, folder, stateful.JUDGED_SCHEMA).where("output = 'verdict' and status <> 'expired'")
    finals = {c: round6(F.col(c)) for c in FINALS}
    return out.withColumns({**finals, "variance": F.round("variance", 4)}).select("verification_id", "num_verifiers", *FINALS, "variance", "status")


DEADLINE_DAYS = 700
# Orders ask for verification (not every tenth of them), line items are submissions.
JUDGED_SQL = f"""
  rq AS (SELECT o_orderkey AS id, o_orderdate AS created, o_orderdate + INTERVAL {DEADLINE_DAYS} DAY + INTERVAL 12 HOUR AS due FROM orders WHERE o_orderkey % 10 <> 0),
  sb AS (SELECT l_orderkey AS id, l_suppkey AS verifier, l_shipdate AS t, l_linenumber * 10000000 + l_partkey AS place,
                l_quantity * 2 AS privacy, l_discount * 1000 AS utility, 100 - l_tax * 500 AS fairness FROM lineitem),
  kn AS (SELECT sb.*, due, coalesce(created <= t, false) AS asked FROM sb LEFT JOIN rq USING (id)),
  fs AS (SELECT *, CAST(0.4 AS DOUBLE) * privacy + CAST(0.35 AS DOUBLE) * utility + CAST(0.25 AS DOUBLE) * fairness AS overall FROM kn WHERE asked AND t <= due
         QUALIFY row_number() OVER (PARTITION BY id, verifier ORDER BY t, place) = 1),
  st AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, place, verifier) AS turn FROM fs QUALIFY turn <= 3),
  pn AS (SELECT id, count(*) AS n, max((t, place)) AS closed_at, median(privacy) AS privacy, median(utility) AS utility, median(fairness) AS fairness, median(overall) AS overall, var_pop(overall) AS variance FROM st GROUP BY 1),
  rj AS (SELECT kn.id, kn.verifier, kn.place, CASE WHEN NOT kn.asked THEN 'unknown' WHEN (kn.t, kn.place) > f.closed_at THEN 'closed' WHEN kn.t > kn.due THEN 'expired'
                WHEN (kn.t, kn.place) > (s.t, s.place) THEN 'duplicate' END AS reason
         FROM kn LEFT JOIN (SELECT * FROM pn WHERE n = 3) f ON f.id = kn.id LEFT JOIN st s ON s.id = kn.id AND s.verifier = kn.verifier)"""
REJECTS_SQL = f"""WITH {JUDGED_SQL}
  SELECT id AS verification_id, verifier AS verifier_id, place, reason FROM rj WHERE reason IS NOT NULL"""
VERDICTS_SQL = f"""WITH {JUDGED_SQL}, mx AS (SELECT max(t) AS t FROM (SELECT max(l_shipdate) AS t FROM lineitem UNION ALL SELECT max(created) FROM rq))
  SELECT id AS verification_id, n AS num_verifiers, round(privacy, 6) AS privacy, round(utility, 6) AS utility, round(fairness, 6) AS fairness, round(overall, 6) AS overall, round(variance, 4) AS variance,
         CASE WHEN variance > 400 THEN 'consensus_failed' WHEN overall >= 70 THEN 'approved' ELSE 'rejected' END AS status FROM pn WHERE n = 3
  UNION ALL SELECT rq.id, coalesce(n, 0), NULL, NULL, NULL, NULL, NULL, 'expired' FROM rq LEFT JOIN pn USING (id), mx WHERE coalesce(n, 0) < 3 AND due <= mx.t"""


def _requests(spark, sf):
    return table(spark, sf, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("verification_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def _timed_submissions(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("verification_id"),
        F.col("l_suppkey").alias("verifier_id"),
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
        (F.col("l_linenumber").cast("bigint") * 10000000 + F.col("l_partkey")).alias("place"),
        *_scores(),
    )


def _judged_events(spark, sf):
    return _event(_requests(spark, sf), "request", "created_at").unionByName(_event(_timed_submissions(spark, sf), "submission", "event_time"))


def _judged_by_stream(spark, sf, label: str):
    folder = _folder(spark, label)
    events = _judged_events(spark, sf)
    for keep in _slices("event_time", [datetime(1997, 1, 1), datetime(1999, 1, 1)]):
        _arrive(events, f"{folder}/in", keep)
        stream = stateful.judged_stream(live.read_stream(spark, f"{folder}/in"), timedelta(days=DEADLINE_DAYS, hours=12), keep=timedelta(days=5000))
        stateful.advance(stream, folder, "output")
    return stateful.results(spark, folder, stateful.JUDGED_SCHEMA)


def _judged_by_batch(spark, sf):
    newest = _judged_events(spark, sf).agg(F.max("event_time")).scalar()
    return consensus.judged(_requests(spark, sf), _timed_submissions(spark, sf), f"'{DEADLINE_DAYS} 12' DAY TO HOUR", newest)


def _rejects(judged):
    return judged.where("output = 'reject'").select("verification_id", "verifier_id", "place", "reason")


def _verdicts(judged):
    finals = {**{c: round6(F.col(c)) for c in FINALS}, "variance": F.round("variance", 4)}
    return judged.where("output = 'verdict'").withColumns(finals).select("verification_id", "num_verifiers", *FINALS, "variance", "status")


@query("submission_rejects", REJECTS_SQL)
def submission_rejects(spark, sf):
    """Every refused submission with its reason."""
    return _rejects(_judged_by_batch(spark, sf))


@query("submission_verdicts", VERDICTS_SQL)
def submission_verdicts(spark, sf):
    """Verdicts under a deadline, expired requests among them."""
    return _verdicts(_judged_by_batch(spark, sf))


@query("stream_rejects", REJECTS_SQL)
def stream_rejects(spark, sf):
    """The same rejects by a stream of three runs."""
    return _rejects(_judged_by_stream(spark, sf, "stream-rejects"))


@query("stream_verdicts", VERDICTS_SQL)
def stream_verdicts(spark, sf):
    """The same verdicts by a stream; expired ones leave by event-time timers."""
    return _verdicts(_judged_by_stream(spark, sf, "stream-verdicts"))


@query(
    "stream_progress",
    f"""WITH {JUDGED_SQL}, al AS (SELECT created AS t, id FROM rq UNION ALL SELECT t, id FROM sb),
    cut AS (SELECT max(t) AS mark FROM al WHERE id % 3 > 0 AND t < TIMESTAMP '1998-01-01')
    SELECT (SELECT count(*) FROM al) AS rows_in, count(*) AS rows_dropped FROM al, cut WHERE NOT (id % 3 > 0 AND t < TIMESTAMP '1998-01-01') AND t <= mark""",
)
def stream_progress(spark, sf):
    """Rows that came after the watermark: the second run brings old events with the new ones."""
    folder = _folder(spark, "stream-progress")
    events = _judged_events(spark, sf)
    early = (F.col("verification_id") % 3 > 0) & (F.col("event_time") < F.lit(datetime(1998, 1, 1)))
    with stateful.watched(spark, f"{folder}/progress"):
        for keep in (early, ~early):
            _arrive(events, f"{folder}/in", keep)
            stateful.advance(stateful.judged_stream(live.read_stream(spark, f"{folder}/in"), timedelta(days=DEADLINE_DAYS)), folder)
    return stateful.progress(spark, f"{folder}/progress").agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_dropped").alias("rows_dropped"))


# ----------------------------------------------------------------------- blocks


@query("stream_blocks", f'{BLOCK_SQL} SELECT idx AS "index", n_entries, previous_hash, hash FROM sl WHERE n_entries = 100')
def stream_blocks(spark, sf):
    """Full blocks; entries come in runs that end inside a block, the open block waits in the state."""
    folder = _folder(spark, "stream-blocks")
    events = table(spark, sf, "events")
    for keep in _slices("event_id", [373, 377, 1950]):
        _arrive(events, f"{folder}/in", keep)
        stateful.advance(stateful.sealed_stream(ledger_shape(live.read_stream(spark, f"{folder}/in"))), folder)
    return stateful.results(spark, folder, stateful.SEALED_SCHEMA).select("index", "n_entries", "previous_hash", "hash")


@query("full_blocks", f'{BLOCK_SQL} SELECT idx AS "index", n_entries, previous_hash, hash FROM sl WHERE n_entries = 100')
def full_blocks(spark, sf):
    """The batch twin of the stream of blocks."""
    return ledger.seal(ledger_log(spark, sf)).where("level = 1 and n_entries = 100").select("index", "n_entries", "previous_hash", "hash")


# --------------------------------------------------------------------- matching

MATCH_SQL = """
  SELECT o.o_orderkey AS request_id, 'c' || o.o_custkey AS data_hash, arg_min('v' || p.o_orderkey, (p.o_orderdate, 'v' || p.o_orderkey)) AS verification_id
  FROM orders o JOIN orders p ON p.o_custkey = o.o_custkey AND p.o_orderkey % 3 = 0 AND p.o_orderdate >= o.o_orderdate AND p.o_orderdate <= o.o_orderdate + INTERVAL 180 DAY GROUP BY 1, 2"""


def _asked(spark, sf):
    orders = table(spark, sf, "orders")
    data_hash = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("data_hash")
    requests = orders.select(F.col("o_orderkey").alias("request_id"), data_hash, F.col("o_orderdate").cast("timestamp").alias("requested_at"))
    name = F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("verification_id")
    pending = orders.where("o_orderkey % 3 = 0").select(name, data_hash, F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return requests, pending


@query("request_match", MATCH_SQL)
def request_match(spark, sf):
    """Each request and the earliest pending verification of its data."""
    return consensus.first_match(*_asked(spark, sf), "'180' DAY")


@query("stream_requests", MATCH_SQL)
def stream_requests(spark, sf):
    """The same matches by a stream-stream join over three runs."""
    folder = _folder(spark, "stream-requests")
    sides = {"requests": (_asked(spark, sf)[0], "requested_at"), "pending": (_asked(spark, sf)[1], "created_at")}
    cuts = [datetime(1997, 6, 1), datetime(1999, 6, 1)]
    for turn in range(3):
        for name, (frame, time) in sides.items():
            _arrive(frame, f"{folder}/{name}", _slices(time, cuts)[turn])
            if turn == 2:  # nothing comes after it
                _arrive(stateful.closing_rows(frame, time, END, data_hash=f"end of {name}"), f"{folder}/{name}")
        met = stateful.first_matches(*[live.read_stream(spark, f"{folder}/{name}") for name in sides], "'180' DAY")
        stateful.advance(met, folder)
    return stateful.results(spark, folder, "request_id bigint, data_hash string, verification_id string").drop("batch")


# --------------------------------------------------------------------- counters


def _audit_stream(spark, sf):
    events = audit_shape(live.read_stream(spark, f"{sf}/events.parquet"))
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


_WINDOWED = f"""WITH {AUDIT_SQL} SELECT strftime(time_bucket(INTERVAL '1 day', "timestamp"), '%Y-%m-%d %H:%M') AS start, event_type, level, count(*) AS n FROM audit GROUP BY 1, 2, 3"""


@query("stream_counters", _WINDOWED)
def stream_counters(spark, sf):
    keys = ["event_type", "level"]
    counts = live.counters(_audit_stream(spark, sf), F.window("timestamp", "1 day"), keys)
    out = live.run_counters(counts, _folder(spark, "stream-counters"), keys)
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), *keys, "n")


@query(
    "stream_sliding",
    f"""WITH {AUDIT_SQL}, w AS (SELECT time_bucket(INTERVAL '12 hours', "timestamp") - o * INTERVAL '12 hours' AS st, event_type FROM audit, range(0, 2) t(o))
    SELECT strftime(st, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""",
)
def stream_sliding(spark, sf):
    counts = live.counters(_audit_stream(spark, sf), F.window("timestamp", "24 hours", "12 hours"), ["event_type"])
    out = live.run_counters(counts, _folder(spark, "stream-sliding"), ["event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query(
    "stream_sessions",
    f"""WITH {AUDIT_SQL}, g AS (SELECT actor, "timestamp" AS t, CASE WHEN "timestamp" - lag("timestamp") OVER (PARTITION BY actor ORDER BY "timestamp") <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM audit),
    k AS (SELECT *, sum(fresh) OVER (PARTITION BY actor ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g),
    s AS (SELECT actor, sid, min(t) AS a, max(t) + INTERVAL '6 hours' AS b, count(*) AS n FROM k GROUP BY 1, 2)
    SELECT actor, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, n FROM s""",
)
def stream_sessions(spark, sf):
    """Sessions; a closing row moves the watermark past the last of them, so none stays open."""
    folder = _folder(spark, "stream-sessions")
    events = table(spark, sf, "events")
    for turn, keep in enumerate(_slices("event_id", [4001])):
        _arrive(events, f"{folder}/in", keep)
        if turn:
            _arrive(stateful.closing_rows(events, "ts", END), f"{folder}/in")
        stream = audit_shape(live.read_stream(spark, f"{folder}/in")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        stateful.advance(live.counters(stream, F.session_window("timestamp", "6 hours"), ["actor"]), folder)
    out = stateful.results(spark, folder, "start timestamp, end timestamp, actor string, n bigint")
    return out.select("actor", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
