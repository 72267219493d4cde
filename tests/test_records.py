"""Consensus, chains, ledger, compliance, files and reports."""

import datetime
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from twinproof.functions.canonical_json import sorted_text
from twinproof.functions.scalar import row_sha
from twinproof.operators import audit, chain, compliance, consensus, generation, ledger, prepare, tamper
from twinproof.plans import api, scorecard
from twinproof.roles import ColumnRoles
from twinproof.sources import chained, files

SUBMISSION = "verification_id long, verifier_id long, privacy double, utility double, fairness double, arrival struct<t:int>"


def submissions(spark, *rows):
    return spark.createDataFrame([(v, w, float(p), float(u), float(b), (t,)) for t, (v, w, p, u, b) in enumerate(rows)], SUBMISSION)


def test_agreeing_verifiers_approve(spark):
    s = submissions(spark, (1, 1, 85, 80, 75), (1, 2, 82, 78, 73), (1, 3, 88, 82, 77))
    r = consensus.consensus(s).first()
    assert (r["status"], r["privacy"], r["utility"], r["fairness"]) == ("approved", 85, 80, 75)


def test_disagreement_beyond_the_variance_fails(spark):
    s = submissions(spark, (1, 1, 100, 100, 100), (1, 2, 10, 10, 10), (1, 3, 60, 65, 70))
    assert consensus.consensus(s).first()["status"] == "consensus_failed"


def test_below_quorum_stays_open(spark):
    s = submissions(spark, (1, 1, 85, 80, 75), (1, 1, 10, 10, 10))
    assert consensus.consensus(s).count() == 0
    p = consensus.progress(s).first()
    assert (p["status"], p["results_received"], p["consensus_reached"]) == ("in_progress", 1, False)


def test_first_submission_wins_and_late_ones_do_not_count(spark):
    s = submissions(spark, (1, 1, 90, 90, 90), (1, 1, 0, 0, 0), (1, 2, 90, 90, 90), (1, 3, 80, 80, 80), (1, 4, 0, 0, 0))
    r = consensus.consensus(s).first()
    assert r["overall"] == pytest.approx(90) and r["num_verifiers"] == 3
    assert consensus.first_submissions(s).where("verifier_id = 1").first()["n_refused"] == 1


def test_large_quorum_uses_the_same_rule(spark, monkeypatch):
    s = submissions(spark, *[(1, w, 60 + w, 70, 70) for w in range(6)])
    a = consensus.consensus(s, quorum=4).first()
    monkeypatch.setattr(consensus, "PIVOT_QUORUM", 0)
    b = consensus.consensus(s, quorum=4).first()
    assert a == b and a["privacy"] == 61.5


def test_contract_takes_every_submission(spark):
    s = submissions(spark, (1, 1, 85, 80, 75), (1, 1, 80, 75, 70), (1, 3, 90, 85, 80))
    r = consensus.contract_consensus(s).first()
    assert (r["verifier_count"], r["final_status"]) == (3, "APPROVED")


def test_collusion_needs_a_majority(spark):
    s = submissions(spark, *[(1, w, 75, 75, 75) for w in range(5)])
    grid = {(r["n"], r["f"]): r for r in consensus.collusion(s, panels=(3, 4, 5, 7)).collect()}
    assert {n for n, _ in grid} == {3, 4, 5} and len(grid) == 15  # no request has seven verifiers
    for (n, f), r in grid.items():
        # a split panel fails on its variance, a whole one moves
        assert (r["moved"], r["disputed"]) == ((1, 0) if f == n else (0, int(f > 0))), (n, f)
        assert r["within_tolerance"] == (f <= (n - 1) // 2)


def log_rows(spark, n=1000):
    return spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("x"), F.col("id")).alias("text"))


def test_chain_levels_and_tampering(spark):
    log = chain.build(log_rows(spark), "seq", ["seq", "text"], block_entries=10)
    assert chain.verify(log, "seq", ["seq", "text"]).count() == 0
    sealed = chain.seal(chain.block_heads(log, "seq"), epoch_blocks=5)
    assert {r["level"]: r["count"] for r in sealed.groupBy("level").count().collect()} == {1: 100, 2: 20, 3: 4}
    top = chain.root(sealed).first()["root"]
    edited = log_rows(spark).withColumn("text", F.when(F.col("seq") == 555, "y").otherwise(F.col("text")))
    other = chain.root(chain.seal(chain.block_heads(chain.build(edited, "seq", ["seq", "text"], 10), "seq"), 5)).first()["root"]
    assert other != top
    assert chain.verify_blocks(sealed, chain.block_heads(log, "seq")).count() == 0
    gone = log.where("seq <> 555")
    issues = chain.verify(gone, "seq", ["seq", "text"]).collect()
    assert [(r["seq"], r["issue"]) for r in issues] == [(556, "chain_break")]


def test_ledger_finds_a_forged_block(spark):
    entries = ledger.entries(
        log_rows(spark, 300), F.col("seq"), F.lit("h1"), "generation", F.lit("2024-01-01"), {"t": F.col("text")}
    )
    sealed = ledger.seal(entries, 50)
    assert ledger.verify(entries, sealed, 50).count() == 0
    forged = sealed.withColumn("hash", F.when((F.col("level") == 1) & (F.col("index") == 2), F.lit("0" * 64)).otherwise(F.col("hash")))
    found = {(r["index"], r["issue"]) for r in ledger.verify(entries, forged, 50).collect()}
    assert (2, "hash_mismatch") in found and (3, "chain_break") in found
    stats = ledger.statistics(entries, sealed, ledger.verify(entries, sealed, 50)).first()
    assert stats["chain_length"] == 6 and stats["pending_entries"] == 0 and stats["chain_valid"]


def test_ledger_append_numbers_new_entries(spark):
    old = ledger.entries(log_rows(spark, 5), F.col("seq"), F.lit("h"), "generation", F.lit("t0"), {"t": F.col("text")})
    new = ledger.entries(log_rows(spark, 4), F.lit(None).cast("long"), F.concat(F.lit("n"), F.col("seq")), "consensus", F.lit("t1"), {"t": F.col("text")})
    out = ledger.append(old, new, ["timestamp", "data_hash"]).orderBy("seq").collect()
    assert [r["seq"] for r in out] == list(range(9)) and [r["data_hash"] for r in out[5:]] == ["n0", "n1", "n2", "n3"]


def test_ledger_append_numbers_equal_entries_one_by_one(spark):
    schema = "seq long, entry_id string, data_hash string, entry_type string, payload string, timestamp string"
    old = spark.createDataFrame([(0, "a", "h", "generation", "{}", "t")], schema)
    new = spark.createDataFrame([(None, "x", "h", "consensus", p, "t") for p in ("1", "2", "2", "2", "3")], schema)
    out = ledger.append(old, new, ["timestamp"]).orderBy("seq").collect()
    assert [r["seq"] for r in out] == list(range(6)) and sorted(r["payload"] for r in out[1:]) == ["1", "2", "2", "2", "3"]


def test_chained_log_goes_on_and_repeats_are_safe(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "entry_id string, at timestamp, text string"
    rows = [(f"e{i}", datetime.datetime(2024, 1, 1 + i // 10, 0, i % 60), "x") for i in range(37)]
    make = lambda a, b: spark.createDataFrame(rows[a:b], schema)
    empty = chained.append(make(0, 0), path, "none", ["at"], 5)
    assert (empty["last"], empty["folder"]) == (-1, "")
    heads = [chained.append(make(*part), path, name, ["at"], 5, "at") for name, part in (("a", (0, 12)), ("b", (12, 20)), ("b", (12, 20)), ("none", (0, 0)), ("c", (20, 37)))]
    assert heads[1] == heads[2] and [h["number"] for h in heads] == [1, 2, 2, 0, 3] and heads[-1]["last"] == 36
    whole = chain.build(ledger.numbered(make(0, 37), ["at"], F.lit(-1)), "seq", ["seq", "entry_id", "at", "text"], 5)
    pick = lambda df: sorted(map(tuple, df.select("seq", "entry_id", "previous_hash", "entry_hash").collect()))
    assert pick(chained.read(spark, path)) == pick(whole) and chained.verify(spark, path).count() == 0
    assert chained.read(spark, path, after=19).count() == 17
    # entries of a writer that died before its claim are not read
    whole.withColumn("day", F.to_date("at")).write.partitionBy("day").parquet(f"{path}/entries/commit=left")
    assert chained.read(spark, path).count() == 37
    with pytest.raises(ValueError):
        chained.append(make(0, 1), path, "d", ["at"], 7)


def test_chained_log_with_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    make = lambda *ids: spark.createDataFrame([(i,) for i in ids], "entry_id string")
    claim, lost = chained._claim, []

    def slower(spark_, path_, head):
        if not lost:  # another writer takes the number first
            lost.append(head)
            monkeypatch.setattr(chained, "_claim", claim)
            chained.append(make("other"), path, "other", ["entry_id"])
            return claim(spark_, path_, head)
        return claim(spark_, path_, head)

    monkeypatch.setattr(chained, "_claim", slower)
    assert chained.append(make("mine"), path, "mine", ["entry_id"])["number"] == 1
    assert sorted((r["seq"], r["entry_id"]) for r in chained.read(spark, path).collect()) == [(0, "other"), (1, "mine")]
    assert chained.verify(spark, path).count() == 0


def test_row_digests_see_every_bit_and_every_border(spark):
    numbers = spark.createDataFrame([(1, 1e-7), (2, 2e-9), (3, -1e-300), (4, 1e300), (5, None), (6, 0.1)], "k int, x double")
    edited = numbers.withColumn("x", F.when(F.col("k") < 5, F.col("x") * (1 + 2.0**-50)).otherwise(F.col("x")))
    assert sorted(r["k"] for r in tamper.changed_rows(numbers, edited, "k").collect()) == [1, 2, 3, 4]
    texts = spark.createDataFrame([("a\x1fb", "c"), ("a", "b\x1fc"), ("\\N", "c"), (None, "c"), ("", "c")], "a string, b string")
    assert texts.select(row_sha(texts).alias("d")).distinct().count() == 5


def test_missing_scores_and_named_columns_in_the_advice(spark):
    rows = compliance_rows(spark, privacy=None, utility=None, fairness=None, n_identifiers=2).withColumn("identifiers", F.array(F.lit("ssn"), F.lit("email")))
    advice = {(r["standard"], r["article"]): r["recommendation"] for r in compliance.evaluate(rows).collect()}
    assert advice["GDPR", "Article 25"] == "Run privacy verification first" and advice["EU AI Act", "Article 9"] == "Run bias detection"
    assert advice["HIPAA", "164.514(b)(2)"] == "Remove or generalize: ssn, email" and advice["EU AI Act", "Article 14"] is None


def test_changed_rows_sees_edits_losses_and_additions(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (4, "d")], "k int, v string")
    b = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d"), (5, "e")], "k int, v string")
    assert sorted(r["k"] for r in tamper.changed_rows(a, b, "k").collect()) == [2, 3, 4, 5]


def compliance_rows(spark, **change):
    row = {"dataset": "d", "privacy": 85.0, "utility": 78.0, "fairness": 90.0, "has_audit": True, "n_extra_columns": 0, "n_identifiers": 0, **change}
    return spark.createDataFrame([tuple(row.values())], "dataset string, privacy double, utility double, fairness double, has_audit boolean, n_extra_columns int, n_identifiers int")


def test_all_rules_pass_and_fail(spark):
    good = {r["standard"]: r for r in compliance.roll_up(compliance.evaluate(compliance_rows(spark))).collect()}
    assert good[None]["total"] == 15 and good[None]["compliant"] and good["GDPR"]["compliance_score"] == 100
    bare = compliance.evaluate(compliance_rows(spark, privacy=None, utility=None, fairness=None, has_audit=None))
    assert bare.where("passed").count() == 3  # minimisation, safe harbor, human oversight
    one = compliance.evaluate(compliance_rows(spark, n_extra_columns=1)).where("article = 'Article 5(1)(c)'").first()
    assert (one["passed"], one["score"]) == (False, 50.0)
    assert compliance.rule_frame(spark).count() == 15


def test_identifier_columns(spark):
    cols = spark.createDataFrame(
        [("a", 0, "age"), ("a", 1, "Email"), ("a", 2, "Phone Number"), ("a", 3, "ssn"), ("b", 0, "relationship"), ("c", 0, "income")],
        "dataset string, position int, column string",
    )
    r = {x["dataset"]: x for x in compliance.safe_harbor(cols).collect()}
    assert not r["a"]["passed"] and r["a"]["n_identifiers"] == 4  # email, phone, phone_number, ssn
    assert r["b"]["n_identifiers"] == 1 and r["c"]["passed"] and r["c"]["score"] == 100


@pytest.fixture(scope="module")
def audit_log(spark):
    src = spark.createDataFrame(
        [("2024-01-01 10:00:00", "privacy", "h1", 80.0, True), ("2024-01-02 11:30:00", "bias", "h2", 55.5, False)],
        "ts string, verification_type string, data_hash string, score double, passed boolean",
    ).withColumn("timestamp", F.col("ts").cast("timestamp"))
    return audit.verification_entries(src)


def test_typed_entries(spark, audit_log):
    rows = {r["resource_hash"]: r for r in audit_log.collect()}
    assert rows["h1"]["event_type"] == "privacy_verification" and rows["h2"]["event_type"] == "bias_detection"
    assert json.loads(rows["h2"]["details"]) == {"passed": False, "score": 55.5, "verification_type": "bias"}
    errors = audit.error_entries(spark.createDataFrame([("x", "boom")], "error_type string, error_message string").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp")))
    assert errors.first()["level"] == "error"


def test_audit_append_prunes_days_and_exports(spark, audit_log, tmp_path):
    path = str(tmp_path / "log")
    files.append_audit(audit_log, path)
    files.append_audit(audit_log.withColumn("actor", F.lit("me")), path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and sorted(os.listdir(path))[-2:] == ["day=2024-01-01", "day=2024-01-02"]
    for kind in ("json", "csv", "txt"):
        files.export_audit(audit_log, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == list(audit.EXPORT_COLUMNS)
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "txt")).collect())
    assert "verify_privacy" in text and "  Resource: verification_result" in text and "  Details: {" in text
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ValueError):
        files.export_audit(audit_log, path, "pdf")


def test_audit_documents_load_and_damage_is_skipped(spark, tmp_path):
    entry = {"entry_id": "e1", "timestamp": "2024-01-01T00:00:00", "event_type": "error", "level": "error", "actor": "a", "action": "b", "resource": "r", "entry_hash": "h"}
    (tmp_path / "good.json").write_text(json.dumps({"entries": [entry, {**entry, "entry_id": "e2"}]}, indent=2))
    (tmp_path / "bad.json").write_text('{"entries": [')
    assert [r["entry_id"] for r in files.load_audit(spark, str(tmp_path)).orderBy("entry_id").collect()] == ["e1", "e2"]


def test_imported_chain_is_verified(spark, tmp_path):
    def entry(i, previous):
        body = {"entry_id": f"e{i}", "timestamp": f"2024-01-01T00:00:0{i}", "event_type": "error", "level": "error", "actor": "a", "action": "b",
                "resource": "r", "resource_hash": None, "details": {"z": i, "a": [1.5, "é"]}, "metadata": {}, "previous_entry_hash": previous}
        return {**body, "entry_hash": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}

    chain_, previous = [], None
    for i in range(6):
        chain_.append(entry(i, previous))
        previous = chain_[-1]["entry_hash"]
    (tmp_path / "a.json").write_text(json.dumps({"entries": chain_}, indent=2))
    assert audit.verify_imported(files.load_audit_text(spark, str(tmp_path / "a.json"))).count() == 0
    chain_[2]["actor"] = "someone else"
    chain_[4]["previous_entry_hash"] = "0"
    (tmp_path / "b.json").write_text(json.dumps({"entries": chain_}))
    found = sorted(map(tuple, audit.verify_imported(files.load_audit_text(spark, str(tmp_path / "b.json"))).collect()))
    assert found == [(2, "hash_mismatch"), (4, "chain_break"), (4, "hash_mismatch")]


def test_sorted_json_text_is_that_of_the_exporter(spark):
    values = [
        None, {}, [], {"b": 1, "a": {"z": [1, 2.5, -3e-07, 1e+22, {"y": None, "x": True}], "": "e"}}, [[], [{}], [[1], "a,b:{}[]"]], "plain", 7, {"é": 1, "z": 2, "Z": 3, "日": 4, "😀": 5, "a\"b\\": 6},
        {"t": "tab\t nl\n cr\r bs\b ff\f \x00\x1f\x7f / ü 日本 😀 \u2028", "k,:": "}{]["}, {"deep": [{"a": [{"b": [{"d": 1, "c": 2}]}]}]},
    ]
    rows = [(i, json.dumps(v, ensure_ascii=a, indent=d, separators=s)) for i, v in enumerate(values) for a, d, s in ((True, None, None), (False, 2, None), (False, None, (",", ":")))]
    got = spark.createDataFrame(rows, "i int, doc string").select("i", "doc", sorted_text(F.col("doc")).alias("t")).collect()
    assert [r["t"] for r in got] == [json.dumps(values[r["i"]], sort_keys=True) for r in got]
    bad = spark.createDataFrame([(None,), ("{",), ("[1}",), ("]",)], "doc string").select(sorted_text(F.col("doc")).alias("t")).collect()
    assert all(r["t"] is None for r in bad)


def test_text_log_lines(spark, tmp_path):
    (tmp_path / "audit.log").write_text(
        "2025-12-17 02:58:47,760 | INFO | audit | [system_event] runner - session_started on session\nnot a log line\n"
    )
    rows = files.read_text_log(spark, str(tmp_path / "audit.log")).collect()
    assert rows[0]["event_type"] == "system_event" and rows[0]["action"] == "session_started" and rows[0]["resource"] == "session"
    assert rows[1]["event_type"] is None and rows[1]["raw"] == "not a log line"


def test_consensus_records_round_trip_with_bad_line(spark, tmp_path):
    good = {"verification_id": "v1", "data_hash": "h", "status": "approved", "final_privacy_score": 80.0, "individual_results": [{"verifier_id": "a", "privacy_score": 80.0}], "num_verifiers": 1}
    (tmp_path / "r.json").write_text(json.dumps(good) + "\n{broken\n")
    ok, bad = files.import_records(spark, str(tmp_path / "r.json"))
    assert ok.first()["individual_results"][0]["verifier_id"] == "a" and bad.count() == 1
    files.export_records(ok, str(tmp_path / "out"))
    assert files.import_records(spark, str(tmp_path / "out"))[0].count() == 1


def test_tables_reports_and_trails_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "i int, s string, x double")
    files.write_csv(df, str(tmp_path / "t.csv"))
    assert files.read_table(spark, str(tmp_path / "t.csv"), df.schema).orderBy("i").collect() == df.collect()
    assert dict(files.read_table(spark, str(tmp_path / "t.csv")).dtypes)["x"] == "double"
    files.write_results(df, str(tmp_path / "res"))
    assert files.read_table(spark, str(tmp_path / "res/json"), kind="json").count() == 2
    log = ledger.entries(log_rows(spark, 6), F.col("seq"), F.concat(F.lit("h"), F.col("seq") % 2), "generation", F.lit("t"), {"t": F.col("text")})
    files.export_trail(log, "h1", str(tmp_path / "trail"), log.agg(F.count("*").alias("total_entries")))
    rows = spark.read.json(str(tmp_path / "trail")).collect()
    assert len(rows) == 3 and rows[0]["chain_info"]["total_entries"] == 6


def test_history_json(spark):
    text = json.dumps({"generation": {"timestamp": "t0"}, "verifications": [{"verification_id": "abcdefghij", "timestamp": "t1"}]})
    df = spark.createDataFrame([("d" * 12, text), ("empty", "{}")], "data_hash string, history string")
    rows = {r["entry_id"]: r["entry_type"] for r in files.flatten_history(df).collect()}
    assert rows == {"gen_dddddddd": "generation", "ver_abcdefgh": "verification"}


def test_generation_log(spark):
    real = spark.createDataFrame([(1, "a"), (2, "b")], "x int, c string")
    rec = generation.generation_record(real, real, "bootstrap", "2024-01-01 00:00:00", ["c"], epochs=3)
    row = rec.first()
    assert row["input_hash"] == row["output_hash"] and row["num_rows"] == 2 and json.loads(row["hyperparameters"]) == {"epochs": "3"}
    assert len(row["generation_id"]) == 16
    ok = generation.generator_is_reusable(rec, real, ["c"]).first()["cache_valid"]
    assert ok and not generation.generator_is_reusable(rec, real.select("c", "x"), ["c"]).first()["cache_valid"]


def test_preparation_plan_applies_to_another_table(spark):
    rows = [(i, float(i % 5), "x" if i % 3 else None, f"2024-01-{i % 28 + 1:02d}", None if i % 4 else "z") for i in range(200)]
    df = spark.createDataFrame(rows + rows[:10], "`row id` int, score double, label string, `day ` string, sparse string")
    out, plan = prepare.prepare(df)
    assert "sparse" in plan.dropped and plan.fills["label"] == "x" and plan.dates == ["day"] and plan.whole == ["score"]
    assert out.count() == 200 and "day_dayofweek" in out.columns and dict(out.dtypes)["score"] == "bigint"
    actions = {(r["step"], r["action"]) for r in plan.report(spark).collect()}
    assert ("duplicates", "duplicates_removed") in actions and ("outliers", "clipped") in actions
    other = plan.apply(df.limit(20))
    assert set(other.columns) == set(out.columns)


ROLES = ColumnRoles(
    categorical=("g", "y"), numeric=("x", "z"), quasi_identifiers=("g",), protected=("g",), target="y", favorable="yes", sensitive=("g",)
)


@pytest.fixture(scope="module")
def pair(spark):
    real = spark.range(400).select(
        (F.rand(1) * 10).alias("x"), F.randn(2).alias("z"), F.when(F.rand(3) < 0.5, "m").otherwise("f").alias("g"), F.when(F.rand(4) < 0.6, "yes").otherwise("no").alias("y")
    )
    synth = spark.range(400).select(
        (F.rand(5) * 10).alias("x"), F.randn(6).alias("z"), F.when(F.rand(7) < 0.5, "m").otherwise("f").alias("g"), F.when(F.rand(8) < 0.6, "yes").otherwise("no").alias("y")
    )
    return real, synth


def test_one_call_functions(spark, pair):
    real, synth = pair
    full = {(r["axis"], r["metric"]): r["score"] for r in api.verify_synthetic_data(real, synth, ROLES, with_models=True).collect()}
    assert len(full) == 11 + 4 and all(0 <= v <= 100 for v in full.values())
    ev = {(r["axis"], r["metric"]): r["score"] for r in api.evaluate_synthetic_data(real, synth, ROLES).collect()}
    assert ("composite", "overall") in ev and ("utility", "ml_efficacy") in ev
    rules = api.check_compliance(real, synth, ROLES, full[("privacy", "overall")], full[("utility", "overall")], full[("fairness", "overall")], has_audit=True)
    assert rules.count() == 15
    fixed = api.post_process_for_fairness(real, synth, ROLES)
    assert fixed.columns == synth.columns
    made, record = api.generate_auditable_data(real, 300, ROLES, "2024-01-01 00:00:00")
    assert made.count() == 300 and record.first()["num_rows"] == 300


def test_single_axis_functions_and_report(spark, pair, tmp_path):
    real, synth = pair
    p = api.verify_privacy(real, synth, ROLES, with_models=False)
    assert {r["metric"] for r in p.collect()} == {"dcr", "k_anonymity", "attribute_disclosure", "overall"}
    f = {r["metric"]: r["score"] for r in api.detect_bias(real, synth, ROLES, with_models=False).collect()}
    assert set(f) == {"demographic_parity", "disparate_impact", "statistical_parity", "overall"}
    files.write_report(api.report(real, synth, p, "2024-01-01 00:00:00"), str(tmp_path / "report"))
    row = json.loads(spark.read.text(str(tmp_path / "report")).first()["value"])
    assert row["synthetic_rows"] == 400 and len(row["metrics"]) == 4


def test_model_metrics_repeat_with_the_seed(pair):
    from twinproof.operators import models

    real, synth = pair
    a = models.equal_opportunity(real, synth, ["x", "z"], ["g", "y"], ["g"], "y").first()
    b = models.equal_opportunity(real, synth, ["x", "z"], ["g", "y"], ["g"], "y").first()
    assert a == b and 0 <= a["score"] <= 100
    t = models.train_on_synthetic(real, synth, ["x", "z"], ["g", "y"], "z", classification=False).first()
    assert 0 <= t["score"] <= 100


def test_verdict_row(spark):
    totals = spark.createDataFrame([("privacy", 80.0), ("utility", 75.0), ("fairness", 60.0)], "axis string, score double")
    r = scorecard.verdict(totals).first()
    assert r["overall_status"] == "REJECTED" and r["overall_score"] == pytest.approx(215 / 3) and r["privacy_passed"] and not r["fairness_passed"]
