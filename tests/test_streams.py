"""Streams give what their batch twins give, over several runs from one checkpoint."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from twinproof.operators import consensus, ledger
from twinproof.streaming import live, stateful


def write_batches(spark, path, *batches, schema):
    for rows in batches:
        # One file per folder write; file times order the micro-batches.
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def at(minute):
    return datetime(2024, 1, 1, minute // 60, minute % 60)


def request(rid, minute):
    return (rid, at(minute), "request", None, None, None, None, None)


def sent(rid, minute, verifier, score, place=0):
    return (rid, at(minute), "submission", place, verifier, score, score, score)


def run(spark, tmp_path, *batches, progress=False, **options):
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")
    options = {"deadline": timedelta(minutes=30), **options}
    with stateful.watched(spark, f"{folder}/progress"):
        for rows in batches:
            write_batches(spark, path, rows, schema=stateful.EVENT_SCHEMA)
            stateful.advance(stateful.judged_stream(live.read_stream(spark, path), **options), folder, "output")
    return stateful.results(spark, folder, stateful.JUDGED_SCHEMA).collect(), stateful.progress(spark, f"{folder}/progress")


def test_quorum_over_runs_refuses_with_reasons(spark, tmp_path):
    rows, _ = run(
        spark,
        tmp_path,
        [request(1, 0), request(2, 0), sent(1, 1, 1, 90.0), sent(1, 2, 1, 0.0), sent(2, 1, 1, 100.0), sent(9, 2, 1, 5.0)],
        [sent(1, 3, 2, 80.0), sent(1, 4, 1, 0.0), sent(2, 5, 2, 0.0), sent(2, 6, 3, 50.0), sent(1, 6, 7, None)],
        [sent(1, 7, 3, 60.0), request(3, 8), sent(3, 9, 9, 10.0)],
        [sent(1, 10, 4, 0.0), sent(3, 60, 8, 10.0)],
        [sent(3, 70, 7, 1.0), request(3, 70), sent(3, 71, 7, 1.0)],
    )
    verdicts = {r["verification_id"]: r for r in rows if r["output"] == "verdict"}
    assert set(verdicts) == {1, 2, 3}
    assert abs(verdicts[1]["overall"] - 80) < 1e-9 and verdicts[1]["status"] == "approved" and verdicts[1]["num_verifiers"] == 3
    assert verdicts[2]["status"] == "consensus_failed"
    assert (verdicts[3]["status"], verdicts[3]["num_verifiers"]) == ("expired", 1)  # and a later request event does not reopen it
    reasons = sorted((r["verification_id"], r["verifier_id"], r["reason"]) for r in rows if r["output"] == "reject")
    assert reasons == [(1, 1, "duplicate"), (1, 1, "duplicate"), (1, 4, "closed"), (1, 7, "invalid"), (3, 7, "expired"), (3, 7, "expired"), (3, 8, "expired"), (9, 1, "unknown")]


def test_closed_requests_are_forgotten_and_then_unknown(spark, tmp_path):
    rows, _ = run(spark, tmp_path, [request(1, 0), sent(1, 1, 1, 50.0)], [sent(5, 200, 1, 1.0)], [sent(5, 201, 1, 1.0)], [sent(1, 400, 2, 1.0)], keep=timedelta(minutes=60))
    assert [r["status"] for r in rows if r["verification_id"] == 1 and r["output"] == "verdict"] == ["expired"]
    assert [r["reason"] for r in rows if r["verification_id"] == 1 and r["output"] == "reject"] == ["unknown"]


def test_rows_behind_the_watermark_are_reported(spark, tmp_path):
    _, progress = run(spark, tmp_path, [request(1, 0), sent(1, 50, 1, 1.0)], [sent(1, 20, 2, 1.0), sent(1, 30, 3, 1.0), sent(1, 51, 4, 1.0)], late="10 minutes")
    assert tuple(progress.agg(F.sum("rows_in"), F.sum("rows_dropped")).first()) == (5, 2)


def test_batch_judgement_of_odd_rows(spark):
    requests = spark.createDataFrame([(1, at(5)), (1, at(9)), (2, at(0))], "verification_id long, created_at timestamp")
    schema = "verification_id long, verifier_id long, event_time timestamp, place long, privacy double, utility double, fairness double"
    rows = [(1, 1, at(4), 0, 1.0, 1.0, 1.0), (1, 1, at(6), 0, 90.0, 90.0, 90.0), (1, 2, at(6), 1, float("nan"), 1.0, 1.0), (1, 2, at(6), 2, 80.0, 80.0, 80.0), (1, None, at(6), 3, 1.0, 1.0, 1.0)]
    out = consensus.judged(requests, spark.createDataFrame(rows, schema), "'30' MINUTE", F.lit(at(35)), quorum=2).collect()
    assert sorted((r["verification_id"], r["status"], r["num_verifiers"]) for r in out if r["output"] == "verdict") == [(1, "approved", 2), (2, "expired", 0)]
    assert sorted((r["place"], r["reason"]) for r in out if r["output"] == "reject") == [(0, "unknown"), (1, "invalid"), (3, "closed")]
    none = spark.createDataFrame([], schema)
    assert consensus.judged(requests.limit(0), none, "'30' MINUTE", F.lit(at(35))).count() == 0


ENTRIES = "seq long, entry_id string, data_hash string, entry_type string, payload string, timestamp string"


def test_blocks_do_not_depend_on_where_runs_end(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "run")
    rows = [(i, f"e{i}", "h", "generation", "{}", f"t{i:02}") for i in range(17)]
    seen = []
    # out of order, and an entry that comes twice
    for part in ([rows[3], *rows[:3], *rows[4:7]], rows[8:14], [rows[7], rows[2], *rows[14:]]):
        write_batches(spark, path, part, schema=ENTRIES)
        stateful.advance(stateful.sealed_stream(live.read_stream(spark, path), block_entries=5, epoch_blocks=2), folder)
        seen.append(stateful.results(spark, folder, stateful.SEALED_SCHEMA).count())
    assert seen == [1, 1, 3]
    batch = ledger.seal(spark.createDataFrame(rows, ENTRIES), 5, 2).where("level = 1 and n_entries = 5").select("index", "previous_hash", "hash", "digest")
    out = stateful.results(spark, folder, stateful.SEALED_SCHEMA)
    assert sorted(map(tuple, out.select("index", "previous_hash", "hash", "digest").collect())) == sorted(map(tuple, batch.collect()))
    last = out.agg(F.max("batch")).first()[0]
    assert stateful.results(spark, folder, stateful.SEALED_SCHEMA, after=last - 1).count() == 2


def test_stream_join_is_the_batch_match(spark, tmp_path):
    asked, pending = "request_id long, data_hash string, requested_at timestamp", "verification_id string, data_hash string, created_at timestamp"
    a = [[(1, "x", at(0)), (2, "y", at(1))], [(3, "x", at(30))], [(4, "z", at(70))]]
    p = [[("v1", "x", at(5)), ("v0", "x", at(5))], [("v2", "y", at(40)), ("v3", "x", at(31))], [("v4", "z", at(200))]]
    folder = str(tmp_path)
    for i, (x, y) in enumerate(zip(a, p)):
        write_batches(spark, f"{folder}/a", x, schema=asked)
        write_batches(spark, f"{folder}/p", y, schema=pending)
        if i == 2:
            for name, time in (("a", "requested_at"), ("p", "created_at")):
                stateful.closing_rows(spark.read.parquet(f"{folder}/{name}"), time, datetime(2100, 1, 1), data_hash=f"end {name}").write.mode("append").parquet(f"{folder}/{name}")
        stateful.advance(stateful.first_matches(live.read_stream(spark, f"{folder}/a"), live.read_stream(spark, f"{folder}/p"), "'60' MINUTE", window="1 hour"), f"{folder}/run")
    got = stateful.results(spark, f"{folder}/run", "request_id bigint, data_hash string, verification_id string").drop("batch")
    want = consensus.first_match(spark.createDataFrame(sum(a, []), asked), spark.createDataFrame(sum(p, []), pending), "'60' MINUTE")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, "x", "v0"), (2, "y", "v2"), (3, "x", "v3")]


def test_counters_add_up_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    write_batches(
        spark,
        path,
        [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a")],
        [("2024-01-01 00:30:00", "a"), ("2024-01-01 01:10:00", "b")],
        schema="ts string, kind string",
    )
    stream = live.read_stream(spark, path, 1).select(F.col("ts").cast("timestamp").alias("timestamp"), "kind")
    counts = live.counters(stream, F.window("timestamp", "1 hour"), ["kind"], late="2 hours")
    out = {(str(r["start"])[11:13], r["kind"]): r["n"] for r in live.run_counters(counts, str(tmp_path / "run"), ["kind"]).collect()}
    assert out == {("00", "a"): 3, ("01", "b"): 1}


def test_requests_of_one_bucket_are_judged_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "REQUEST_BUCKETS", 2)
    ids = range(1, 31)
    rows, _ = run(
        spark,
        tmp_path,
        [x for i in ids for x in (request(i, 0), sent(i, 1, 1, 90.0), sent(i, 2, 2, 80.0))] + [sent(None, 2, 1, 5.0)],
        [x for i in ids if i % 3 for x in (sent(i, 3, 2, 0.0), sent(i, 4, 3, 70.0), sent(i, 5, 4, 70.0))],
        [request(99, 60)],
    )
    verdicts = {r["verification_id"]: (r["status"], r["num_verifiers"]) for r in rows if r["output"] == "verdict"}
    assert verdicts == {i: ("approved", 3) if i % 3 else ("expired", 2) for i in ids}
    reasons = sorted((r["verification_id"] or 0, r["verifier_id"], r["reason"]) for r in rows if r["output"] == "reject")
    assert reasons == [(0, 1, "unknown")] + [x for i in ids if i % 3 for x in ((i, 2, "duplicate"), (i, 4, "closed"))]


def test_state_is_written_a_page_of_requests_at_a_time():
    """A call per request took most of a run; pages that do not change are not written."""
    from types import SimpleNamespace

    import pandas as pd

    calls = []

    class Kept(dict):
        exists = lambda self: bool(self)
        iterator = lambda self: iter(self.items())
        getValue = dict.get  # noqa: N815
        clear = dict.clear

        def get(self, key=None):
            return dict.get(self, key)

        def updateValue(self, key, value):  # noqa: N802
            calls.append(key)
            self[key] = value

        def update(self, value):
            self[None] = value

    handle = SimpleNamespace(getMapState=lambda *a: Kept(), getValueState=lambda *a: Kept(), registerTimer=lambda t: None)
    judge = stateful.QuorumProcessor(2, 70.0, 60_000, 60_000)
    judge.init(handle)

    def given(rows):
        calls.clear()
        pdf = pd.DataFrame(rows, columns=stateful.EVENT_COLUMNS).rename(columns={"verification_id": "request"}).astype({"request": str})
        return next(judge.handleInputRows((0,), iter([pdf]), None))

    assert not len(given([request(i, 0) for i in range(900)])) and len(calls) == stateful.PAGES
    done = given([sent(i, 0, v, 80.0) for i in range(0, 900, 2) for v in (1, 2)])
    assert sorted(done["verification_id"]) == list(range(0, 900, 2)) and set(done["status"]) == {"approved"} and len(calls) <= stateful.PAGES
    refused = given([sent(0, 0, 3, 1.0), sent(2000, 0, 3, 1.0)])
    assert refused["reason"].tolist() == ["closed", "unknown"] and not calls
