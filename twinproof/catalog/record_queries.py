"""Consensus, audit, ledger and compliance queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinproof.catalog.pairs import AUDIT_SQL, SUBMISSION_SQL, audit_events, submissions, table
from twinproof.catalog.registry import canon_sql, query
from twinproof.functions.scalar import round6
from twinproof.operators import audit, chain, compliance, consensus, ledger, tamper
from twinproof.session import deal_count, dealt, shared_dir
from twinproof.sources import chained
from twinproof.sources import files as sources

FINAL_COLUMNS = ("privacy", "utility", "fairness", "overall")


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


@query(
    "trust_score",
    f"WITH {SUBMISSION_SQL} SELECT verification_id, verifier_id, round(overall, 6) AS overall, CASE WHEN overall >= 70 THEN 'Passed' ELSE 'Failed' END AS status FROM scored",
)
def trust_score(spark, sf):
    out = consensus.record_status(submissions(spark, sf))
    return out.select("verification_id", "verifier_id", round6(F.col("overall")).alias("overall"), "status")


@query(
    "score_validation",
    """WITH x AS (SELECT l_quantity * 2.2 - 3 AS privacy, l_discount * 1000 AS utility, 100 - l_tax * 500 AS fairness FROM lineitem),
    p AS (SELECT CASE WHEN NOT privacy BETWEEN 0 AND 100 THEN 'privacy' WHEN NOT utility BETWEEN 0 AND 100 THEN 'utility' WHEN NOT fairness BETWEEN 0 AND 100 THEN 'fairness' END AS problem FROM x)
    SELECT problem, count(*) AS n FROM p GROUP BY 1""",
)
def score_validation(spark, sf):
    bad = submissions(spark, sf).withColumn("privacy", F.col("privacy") * 1.1 - 3)
    return consensus.validate_scores(bad).groupBy("problem").agg(F.count("*").alias("n"))


@query(
    "required_fields",
    """WITH x AS (SELECT CASE WHEN event_id % 13 = 0 THEN '' ELSE 'h' || event_id END AS data_hash, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS generator_type FROM events)
    SELECT CASE WHEN coalesce(data_hash, '') = '' THEN 'data_hash' WHEN coalesce(generator_type, '') = '' THEN 'generator_type' END AS problem, count(*) AS n FROM x GROUP BY 1""",
)
def required_fields(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("h"), F.col("event_id").cast("string"))).otherwise("").alias("data_hash"),
        F.when(F.col("event_id") % 17 != 0, F.col("event_type")).alias("generator_type"),
    )
    return consensus.validate_required(rows, ["data_hash", "generator_type"]).groupBy("problem").agg(F.count("*").alias("n"))


@query(
    "verification_requests",
    """SELECT substr(sha256('d' || o_orderkey || ':' || strftime(o_orderdate, '%Y-%m-%d')), 1, 16) AS verification_id, 'd' || o_orderkey AS data_hash,
       strftime(o_orderdate, '%Y-%m-%d') AS created_at, 'pending' AS status FROM orders""",
)
def verification_requests(spark, sf):
    data = table(spark, sf, "orders").select(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("h"), "o_orderdate")
    return consensus.requests(data, "h", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "first_pending",
    """SELECT 'c' || o_custkey AS data_hash, substr(sha256('c' || o_custkey || ':' || d), 1, 16) AS verification_id
       FROM (SELECT o_custkey, min(strftime(o_orderdate, '%Y-%m-%d')) AS d FROM orders GROUP BY 1)""",
)
def first_pending(spark, sf):
    data = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("h"), "o_orderdate")
    return consensus.first_pending_request(consensus.requests(data, "h", F.date_format("o_orderdate", "yyyy-MM-dd")))


@query(
    "submissions_dedupe",
    f"""WITH {SUBMISSION_SQL}, c AS (SELECT verification_id, verifier_id, count(*) - 1 AS n_refused FROM sub GROUP BY 1, 2)
    SELECT verification_id, verifier_id, round(privacy, 6) AS privacy, round(utility, 6) AS utility, round(fairness, 6) AS fairness, round(overall, 6) AS overall, n_refused
    FROM firsts JOIN c USING (verification_id, verifier_id)""",
)
def submissions_dedupe(spark, sf):
    return _rounded(consensus.first_submissions(submissions(spark, sf)).drop("arrival"), *FINAL_COLUMNS)


CONSENSUS_SQL = f"""WITH {SUBMISSION_SQL} SELECT verification_id, num_verifiers, round(privacy, 6) AS privacy, round(utility, 6) AS utility,
    round(fairness, 6) AS fairness, round(overall, 6) AS overall, round(variance, 4) AS variance, status FROM verdict"""


@query("consensus_median", CONSENSUS_SQL)
def consensus_median(spark, sf):
    out = consensus.consensus(submissions(spark, sf))
    return _rounded(_rounded(out, *FINAL_COLUMNS), "variance", digits=4)


@query(
    "consensus_contract",
    f"""WITH {SUBMISSION_SQL} SELECT verification_id, count(*) AS verifier_count, round(median(overall), 6) AS consensus_score,
    CASE WHEN median(overall) >= 70 THEN 'APPROVED' ELSE 'REJECTED' END AS final_status FROM scored GROUP BY 1""",
)
def consensus_contract(spark, sf):
    return _rounded(consensus.contract_consensus(submissions(spark, sf)), "consensus_score")


@query(
    "consensus_progress",
    f"""WITH {SUBMISSION_SQL}, n AS (SELECT verification_id, count(*) AS c FROM firsts GROUP BY 1)
    SELECT verification_id, coalesce(status, 'in_progress') AS status, least(c, 3) AS results_received, 3 AS results_needed, status IS NOT NULL AS consensus_reached
    FROM n LEFT JOIN verdict USING (verification_id)""",
)
def consensus_progress(spark, sf):
    return consensus.progress(submissions(spark, sf))


@query(
    "consensus_integrity",
    f"""WITH {SUBMISSION_SQL} SELECT verification_id, verification_id % 101 <> 0 AS scores_match, verification_id % 211 <> 0 AS signatures_valid,
    verification_id % 101 <> 0 AND verification_id % 211 <> 0 AS valid FROM verdict""",
)
def consensus_integrity(spark, sf):
    sub = submissions(spark, sf)
    records = consensus.consensus(sub)
    vid = F.col("verification_id")
    expected = records.withColumn("privacy", F.when(vid % 101 == 0, F.col("privacy") + 1).otherwise(F.col("privacy")))
    signed = consensus.signed(consensus.first_submissions(sub))
    forged = signed.withColumn("signature", F.when(vid % 211 == 0, F.lit("short!")).otherwise(F.col("signature")))
    return consensus.verify_integrity(records, expected, consensus.signatures_valid(forged))


@query(
    "consensus_integrity_strict",
    f"""WITH {SUBMISSION_SQL}, sg AS (SELECT verification_id, bool_and(verification_id % 211 <> 0 AND NOT (verification_id % 307 = 5 AND verifier_id % 2 = 0)) AS ok FROM firsts GROUP BY 1)
    SELECT verification_id, verification_id % 101 <> 0 AS scores_match, ok AS signatures_valid, verification_id % 101 <> 0 AND ok AS valid FROM verdict JOIN sg USING (verification_id)""",
)
def consensus_integrity_strict(spark, sf):
    """Signatures are computed again: one of the right form over another score is found, too; scores may differ by the tolerance itself."""
    sub = submissions(spark, sf)
    records = consensus.consensus(sub)
    vid = F.col("verification_id")
    shifted = F.col("privacy") + F.when(vid % 101 == 0, 1.0).otherwise(0.25)
    expected = records.withColumn("privacy", shifted)
    signed = consensus.signed(consensus.first_submissions(sub))
    other = F.substring(F.sha2(F.col("signature"), 256), 1, 32)
    forged = signed.withColumn(
        "signature", F.when(vid % 211 == 0, F.lit("short!")).when((vid % 307 == 5) & (F.col("verifier_id") % 2 == 0), other).otherwise(F.col("signature"))
    )
    return consensus.verify_integrity(records, expected, consensus.signatures_valid(forged, recompute=True), tolerance=0.25, inclusive=True)


@query(
    "consensus_stats",
    f"""WITH {SUBMISSION_SQL} SELECT count(*) AS total_completed, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected,
    count(*) FILTER (status = 'consensus_failed') AS consensus_failed, round(count(*) FILTER (status = 'approved') / count(*), 6) AS approval_rate,
    round(avg(privacy), 6) AS avg_privacy, round(avg(utility), 6) AS avg_utility, round(avg(fairness), 6) AS avg_fairness,
    (SELECT count(*) FROM (SELECT 1 FROM firsts GROUP BY verification_id HAVING count(*) < 3)) AS total_pending FROM verdict""",
)
def consensus_stats(spark, sf):
    return _rounded(consensus.statistics(submissions(spark, sf)), "approval_rate", "avg_privacy", "avg_utility", "avg_fairness")


@query(
    "agreement_rate",
    f"""WITH {SUBMISSION_SQL}, m AS (SELECT verification_id, median(overall) AS mid FROM firsts GROUP BY 1)
    SELECT verification_id, count(*) AS n, round(avg(CAST(abs(overall - mid) <= 5 AS INTEGER)), 6) AS agreement FROM firsts JOIN m USING (verification_id) GROUP BY 1""",
)
def agreement_rate(spark, sf):
    return _rounded(consensus.agreement_rate(submissions(spark, sf)), "agreement")


@query(
    "collusion_grid",
    f"""WITH {SUBMISSION_SQL}, p AS (SELECT n, verification_id, turn, overall FROM quorum, (SELECT unnest([3, 5, 7]) AS n) WHERE turn <= n AND received >= n),
    h AS (SELECT n, verification_id, CASE WHEN round(var_pop(overall), 9) > 400 THEN 'consensus_failed' WHEN median(overall) >= 70 THEN 'approved' ELSE 'rejected' END AS honest FROM p GROUP BY 1, 2),
    a AS (SELECT n, CAST(f AS INTEGER) AS f, verification_id, honest, CASE WHEN turn <= n - f THEN overall WHEN honest = 'approved' THEN 0.0 ELSE 100.0 END AS o
          FROM p JOIN h USING (n, verification_id), range(0, 8) t(f) WHERE f <= n),
    v AS (SELECT n, f, verification_id, honest, CASE WHEN round(var_pop(o), 9) > 400 THEN 'consensus_failed' WHEN median(o) >= 70 THEN 'approved' ELSE 'rejected' END AS status FROM a GROUP BY 1, 2, 3, 4)
    SELECT n, f, count(*) AS verifications, count(*) FILTER (status = CASE WHEN honest = 'approved' THEN 'rejected' ELSE 'approved' END) AS moved,
           count(*) FILTER (status = 'consensus_failed' AND honest <> 'consensus_failed') AS disputed, f <= (n - 1) // 2 AS within_tolerance FROM v GROUP BY n, f""",
)
def collusion_grid(spark, sf):
    """Verdicts of altered panels, each found by the consensus operator."""
    return consensus.collusion(submissions(spark, sf))


# ------------------------------------------------------------------ audit log

PAYLOAD = ("seq", "entry_id", "timestamp", "event_type", "level", "actor", "action", "resource", "details", "score")
PAYLOAD_CANON = canon_sql("seq", "entry_id", 't:"timestamp"', "event_type", "level", "actor", "action", "resource", "details", "d:score")
# The chain of each block of 250 entries, all blocks stepping together.
CHAIN_SQL = f"""WITH RECURSIVE {AUDIT_SQL},
  dg AS (SELECT seq, seq // 250 AS block, seq % 250 AS i, sha256({PAYLOAD_CANON}) AS d FROM audit),
  ch AS (SELECT seq, block, i, sha256('genesis:0:' || block) AS previous_hash, sha256(sha256('genesis:0:' || block) || ':' || d) AS entry_hash FROM dg WHERE i = 0
         UNION ALL SELECT dg.seq, dg.block, dg.i, ch.entry_hash, sha256(ch.entry_hash || ':' || dg.d) FROM ch JOIN dg ON dg.block = ch.block AND dg.i = ch.i + 1)"""


def _chained(spark, sf):
    return chain.build(audit_events(spark, sf), "seq", PAYLOAD)


def _appended(spark, sf, name: str) -> str:
    """Path of a log that grew by three commits, one of them sent twice."""
    events = audit_events(spark, sf)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for batch, keep in (("a", "seq < 333"), ("b", "seq between 333 and 611"), ("b", "seq between 333 and 611"), ("c", "seq > 611")):
        chained.append(events.where(keep).drop("seq"), path, batch, ["timestamp"], partition_by="timestamp")
    return path


@query("append_chain", f"{CHAIN_SQL} SELECT seq, block, previous_hash, entry_hash FROM ch")
def append_chain(spark, sf):
    """Entries appended in commits, with the numbers and hashes of the whole log built at once."""
    return chained.read(spark, _appended(spark, sf, "append-chain")).select("seq", "block", "previous_hash", "entry_hash")


@query("append_verify", "SELECT count(*) AS total_entries, 3 AS commits, CAST(0 AS BIGINT) AS issues FROM events")
def append_verify(spark, sf):
    path = _appended(spark, sf, "append-verify")
    issues = chained.verify(spark, path).agg(F.count("*")).scalar()
    commits = chained.heads(spark, path).agg(F.count("*").cast("int")).scalar()
    return chained.read(spark, path).agg(F.count("*").alias("total_entries")).select("total_entries", commits.alias("commits"), issues.alias("issues"))


@query("audit_chain", f"{CHAIN_SQL} SELECT seq, block, previous_hash, entry_hash FROM ch")
def audit_chain(spark, sf):
    return _chained(spark, sf).select("seq", "block", "previous_hash", "entry_hash")


@query(
    "audit_root",
    f"""{CHAIN_SQL}, hd AS (SELECT block AS idx, block // 250 AS epoch, row_number() OVER (PARTITION BY block // 250 ORDER BY block) AS k, arg_max(entry_hash, seq) AS d FROM ch GROUP BY block),
    fl AS (SELECT idx, epoch, k, sha256(sha256('genesis:1:' || epoch) || ':' || d) AS h FROM hd WHERE k = 1
           UNION ALL SELECT hd.idx, hd.epoch, hd.k, sha256(fl.h || ':' || hd.d) FROM fl JOIN hd ON hd.epoch = fl.epoch AND hd.k = fl.k + 1), e2 AS (SELECT epoch AS idx, epoch // 250 AS up, row_number() OVER (PARTITION BY epoch // 250 ORDER BY epoch) AS k, arg_max(h, idx) AS d FROM fl GROUP BY epoch),
    f2 AS (SELECT idx, up, k, sha256(sha256('genesis:2:' || up) || ':' || d) AS h FROM e2 WHERE k = 1
           UNION ALL SELECT e2.idx, e2.up, e2.k, sha256(f2.h || ':' || e2.d) FROM f2 JOIN e2 ON e2.up = f2.up AND e2.k = f2.k + 1)
    SELECT CASE WHEN (SELECT count(*) FROM e2) = 1 THEN (SELECT arg_max(h, idx) FROM fl) ELSE (SELECT arg_max(h, idx) FROM f2) END AS root""",
)
def audit_root(spark, sf):
    return chain.root(chain.seal(chain.block_heads(_chained(spark, sf), "seq")))


@query(
    "audit_verify",
    f"{AUDIT_SQL.replace('audit AS', 'WITH audit AS', 1)} SELECT seq, 'hash_mismatch' AS issue FROM audit WHERE seq % 997 = 0 UNION ALL SELECT seq, 'chain_break' FROM audit WHERE seq % 1499 = 7 UNION ALL SELECT seq, 'hash_mismatch' FROM audit WHERE seq % 1499 = 7",
)
def audit_verify(spark, sf):
    """Edited scores break their own hash; a replaced link breaks hash and link."""
    log = _chained(spark, sf)
    edited = log.withColumn("score", F.when(F.col("seq") % 997 == 0, F.col("score") + 1).otherwise(F.col("score"))).withColumn(
        "previous_hash", F.when(F.col("seq") % 1499 == 7, F.sha2(F.lit("forged"), 256)).otherwise(F.col("previous_hash"))
    )
    return chain.verify(edited, "seq", PAYLOAD).select("seq", "issue")


@query("audit_verify_clean", "SELECT true AS integrity_valid, count(*) AS total_entries, CAST(0 AS BIGINT) AS issues_found FROM events")
def audit_verify_clean(spark, sf):
    log = _chained(spark, sf)
    return chain.verification_summary(log, chain.verify(log, "seq", PAYLOAD))


@query(
    "audit_search",
    f"""WITH {AUDIT_SQL} SELECT seq, actor, action, level FROM audit WHERE event_type = 'error' AND level = 'error' AND "timestamp" >= TIMESTAMP '2024-01-05'
    AND "timestamp" <= TIMESTAMP '2024-01-25' ORDER BY seq DESC LIMIT 100""",
)
def audit_search(spark, sf):
    found = audit.search(audit_events(spark, sf), "error", "error", start="2024-01-05", end="2024-01-25", limit=100)
    return found.select("seq", "actor", "action", "level")


@query("audit_by_hash", f"WITH {AUDIT_SQL} SELECT seq, entry_id, event_type FROM audit WHERE resource = 'data_7'")
def audit_by_hash(spark, sf):
    return audit_events(spark, sf).where(F.col("resource") == "data_7").select("seq", "entry_id", "event_type")


@query(
    "audit_session",
    f"""WITH {AUDIT_SQL}, t AS (SELECT actor || '@' || strftime("timestamp", '%Y-%m-%d') AS session, event_type, count(*) AS n, min(epoch_us("timestamp")) AS a, max(epoch_us("timestamp")) AS b FROM audit GROUP BY 1, 2)
    SELECT session, CAST(sum(n) AS BIGINT) AS total_entries, round((max(b) - min(a)) / 1e6, 6) AS duration_seconds, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS event_counts FROM t GROUP BY 1""",
)
def audit_session(spark, sf):
    log = audit_events(spark, sf).withColumn("session", F.concat_ws("@", "actor", F.date_format("timestamp", "yyyy-MM-dd")))
    out = audit.session_summary(log, "session")
    pairs = F.transform(F.map_entries("event_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("session", "total_entries", round6(F.col("duration_seconds")).alias("duration_seconds"), F.array_join(pairs, ",").alias("event_counts"))


@query(
    "audit_grouping_sets",
    f"""WITH {AUDIT_SQL} SELECT CASE WHEN grouping(event_type) = 0 THEN 'event_type' WHEN grouping(level) = 0 THEN 'level' WHEN grouping(actor) = 0 THEN 'actor' ELSE 'total' END AS kind,
    coalesce(event_type, level, actor) AS value, count(*) AS n, strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S') AS first_entry, strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') AS last_entry
    FROM audit GROUP BY GROUPING SETS ((event_type), (level), (actor), ())""",
)
def audit_grouping_sets(spark, sf):
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_entry", "last_entry")}
    return audit.breakdown(audit_events(spark, sf)).withColumns(shown)


@query(
    "text_log_parse",
    f"""WITH {AUDIT_SQL} SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS logged_at, upper(level) AS level, event_type, actor, action, resource FROM audit""",
)
def text_log_parse(spark, sf):
    """Entries written as text lines and parsed back into columns."""
    lines = audit_events(spark, sf).select(audit.text_line().alias("value"))
    out = audit.parse_lines(lines)
    return out.select(F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "level", "event_type", "actor", "action", "resource")


# --------------------------------------------------------------------- ledger

LEDGER_SQL = """
  led AS (SELECT event_id AS seq, substr(sha256(('h' || (user_id % 40)) || ':' || CASE event_type WHEN 'signup' THEN 'generation' WHEN 'view' THEN 'verification'
              WHEN 'purchase' THEN 'consensus' WHEN 'click' THEN 'compliance' ELSE 'error' END || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f')), 1, 16) AS entry_id,
            'h' || (user_id % 40) AS data_hash, CASE event_type WHEN 'signup' THEN 'generation' WHEN 'view' THEN 'verification'
              WHEN 'purchase' THEN 'consensus' WHEN 'click' THEN 'compliance' ELSE 'error' END AS entry_type,
            '{"event":"' || event_id || '","user":"' || user_id || '"}' AS payload, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp" FROM events)"""

# Which ledger entry type stands for which test event.
LEDGER_KINDS = {"signup": "generation", "view": "verification", "purchase": "consensus", "click": "compliance", "error": "error"}


def ledger_log(spark, sf):
    return ledger_shape(table(spark, sf, "events"))


def ledger_shape(e):
    kinds = F.create_map(*[F.lit(x) for pair in LEDGER_KINDS.items() for x in pair])
    return ledger.entries(
        e,
        F.col("event_id"),
        F.concat(F.lit("h"), (F.col("user_id") % 40).cast("string")),
        F.try_element_at(kinds, F.col("event_type")),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        {"event": F.col("event_id").cast("string"), "user": F.col("user_id").cast("string")},
    )


_ENTRY_CANON = canon_sql("seq", "entry_id", "data_hash", "entry_type", "payload", '"timestamp"')
BLOCK_SQL = f"""WITH RECURSIVE {LEDGER_SQL},
  bk AS (SELECT seq // 100 AS idx, count(*) AS n_entries, sha256(string_agg(sha256({_ENTRY_CANON}), ',' ORDER BY seq)) AS d FROM led GROUP BY 1),
  kb AS (SELECT *, idx // 250 AS epoch, row_number() OVER (PARTITION BY idx // 250 ORDER BY idx) AS k FROM bk),
  sl AS (SELECT idx, epoch, k, n_entries, sha256('genesis:1:' || epoch) AS previous_hash, sha256(sha256('genesis:1:' || epoch) || ':' || d) AS hash FROM kb WHERE k = 1
         UNION ALL SELECT kb.idx, kb.epoch, kb.k, kb.n_entries, sl.hash, sha256(sl.hash || ':' || kb.d) FROM sl JOIN kb ON kb.epoch = sl.epoch AND kb.k = sl.k + 1)"""


@query("ledger_entries", f"WITH {LEDGER_SQL} SELECT seq, entry_id, data_hash, entry_type, payload FROM led")
def ledger_entries(spark, sf):
    return ledger_log(spark, sf).drop("timestamp")


@query("ledger_blocks", f'{BLOCK_SQL} SELECT idx AS "index", n_entries, previous_hash, hash FROM sl')
def ledger_blocks(spark, sf):
    return ledger.seal(ledger_log(spark, sf)).where("level = 1").select("index", "n_entries", "previous_hash", "hash")


@query(
    "ledger_verify",
    f"""WITH {LEDGER_SQL} SELECT DISTINCT seq // 100 AS "index", 'content_mismatch' AS issue FROM led WHERE seq % 1499 = 11""",
)
def ledger_verify(spark, sf):
    log = ledger_log(spark, sf)
    sealed = ledger.seal(log)
    edited = log.withColumn("payload", F.when(F.col("seq") % 1499 == 11, F.lit("{}")).otherwise(F.col("payload")))
    return ledger.verify(edited, sealed).select("index", "issue")


@query("ledger_trail", f"""WITH {LEDGER_SQL} SELECT seq, entry_id, entry_type, "timestamp" FROM led WHERE data_hash = 'h7' ORDER BY "timestamp", seq""")
def ledger_trail(spark, sf):
    return ledger.trail(ledger_log(spark, sf), "h7").select("seq", "entry_id", "entry_type", "timestamp")


@query("verification_history", f"WITH {LEDGER_SQL} SELECT seq, entry_type FROM led WHERE data_hash = 'h7' AND entry_type IN ('verification', 'consensus')")
def verification_history(spark, sf):
    return ledger.verification_history(ledger_log(spark, sf), "h7").select("seq", "entry_type")


@query(
    "ledger_stats",
    f"""{BLOCK_SQL} SELECT count(*) AS chain_length, (SELECT count(*) FROM led) AS total_entries, CAST(0 AS BIGINT) AS pending_entries, true AS chain_valid, arg_max(hash, idx) AS latest_block_hash FROM sl""",
)
def ledger_stats(spark, sf):
    log = ledger_log(spark, sf)
    sealed = ledger.seal(log)
    return ledger.statistics(log, sealed, ledger.verify(log, sealed))


@query("latest_blocks", f'{BLOCK_SQL} SELECT idx AS "index", n_entries, hash FROM sl ORDER BY idx DESC LIMIT 5')
def latest_blocks(spark, sf):
    return ledger.latest_blocks(ledger.seal(ledger_log(spark, sf))).select("index", "n_entries", "hash")


@query(
    "data_integrity",
    f"""WITH {LEDGER_SQL}, d AS (SELECT DISTINCT user_id FROM events), c AS (SELECT 'h' || (user_id % 60) AS data_hash, user_id FROM d),
    n AS (SELECT data_hash, count(*) AS k FROM led GROUP BY 1)
    SELECT user_id AS dataset, user_id % 9 <> 0 AS data_matches, k IS NOT NULL AS hash_recorded, coalesce(k, 0) AS num_audit_entries, true AS chain_valid FROM c LEFT JOIN n USING (data_hash)""",
)
def data_integrity(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("dataset")).distinct()
    expected = users.withColumn("data_hash", F.concat(F.lit("h"), (F.col("dataset") % 60).cast("string")))
    changed = expected.withColumn("data_hash", F.when(F.col("dataset") % 9 == 0, F.lit("changed")).otherwise(F.col("data_hash")))
    log = ledger_log(spark, sf)
    return ledger.data_integrity(changed, expected, log, ledger.verify(log, ledger.seal(log)))


@query(
    "data_integrity_tampered",
    f"""WITH {LEDGER_SQL} SELECT data_hash AS dataset, true AS data_matches, true AS hash_recorded, count(*) AS num_audit_entries, false AS chain_valid FROM led GROUP BY 1""",
)
def data_integrity_tampered(spark, sf):
    """One edited entry anywhere makes the chain of every dataset invalid."""
    log = ledger_log(spark, sf)
    sealed = ledger.seal(log)
    edited = log.withColumn("payload", F.when(F.col("seq") == 311, F.lit("{}")).otherwise(F.col("payload")))
    known = log.select(F.col("data_hash").alias("dataset"), "data_hash").distinct()
    return ledger.data_integrity(known, known, edited, ledger.verify(edited, sealed))


@query(
    "audit_history",
    f"""WITH {LEDGER_SQL} SELECT data_hash, arg_min(entry_id, ("timestamp", seq)) FILTER (entry_type = 'generation') AS generation,
    count(*) FILTER (entry_type = 'verification') AS n_verification, count(*) FILTER (entry_type = 'consensus') AS n_consensus,
    count(*) FILTER (entry_type = 'compliance') AS n_compliance, arg_max(entry_id, ("timestamp", seq)) FILTER (entry_type = 'consensus') AS last_consensus,
    min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM led GROUP BY 1""",
)
def audit_history(spark, sf):
    return ledger.history(ledger_log(spark, sf))


@query(
    "audit_history_entries",
    f"""WITH {LEDGER_SQL} SELECT data_hash, entry_type, seq, entry_id, payload, "timestamp" FROM led
    WHERE entry_type IN ('generation', 'verification', 'consensus', 'compliance')""",
)
def audit_history_entries(spark, sf):
    return ledger.full_history(ledger_log(spark, sf))


@query(
    "history_flatten",
    """WITH g AS (SELECT o_orderkey, 'd' || o_orderkey AS data_hash, strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders),
    v AS (SELECT l_orderkey, 'v' || l_linenumber AS vid, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT 'gen_' || left(data_hash, 8) AS entry_id, data_hash, 'generation' AS entry_type, count(*) AS n FROM g GROUP BY 1, 2
    UNION ALL SELECT 'ver_' || left(vid, 8), 'd' || l_orderkey, 'verification', v.n FROM v JOIN orders ON l_orderkey = o_orderkey""",
)
def history_flatten(spark, sf):
    """Nested history JSON per dataset, parsed back into flat entries."""
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    # as many tasks as flat entries ask for
    tasks = deal_count(orders.select(F.col("o_orderkey").alias("dataset")).union(items.select("l_orderkey")), ["dataset"])
    items = dealt(items.select("l_orderkey", "l_linenumber"), ["l_orderkey"], tasks).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    # At most one element per distinct line number (seven values).
    verifications = items.groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("verification_id"), F.lit("").alias("timestamp"), "n")).alias("verifications")
    )
    nested = dealt(orders.select("o_orderkey", "o_orderdate"), ["o_orderkey"], tasks).join(verifications, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("data_hash"),
        F.to_json(
            F.struct(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp")).alias("generation"), "verifications")
        ).alias("history"),
    )
    flat = dealt(sources.flatten_history(nested, extra_fields={"n": "bigint"}), ["data_hash"], tasks)
    return flat.groupBy("entry_id", "data_hash", "entry_type").agg(F.coalesce(F.sum("n"), F.count("*")).alias("n"))


@query(
    "first_attestation",
    """SELECT 'h' || (user_id % 40) AS data_hash, event_type AS framework, min(event_id) AS seq, round(arg_min(value, event_id), 6) AS compliance_score FROM events GROUP BY 1, 2""",
)
def first_attestation(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat(F.lit("h"), (F.col("user_id") % 40).cast("string")).alias("data_hash"),
        F.col("event_type").alias("framework"),
        F.col("event_id").alias("seq"),
        round6(F.col("value")).alias("compliance_score"),
    )
    return ledger.first_attestation(e)


@query(
    "tamper_detect",
    f"""WITH {SUBMISSION_SQL}
    SELECT 'row' AS scenario, o_orderkey AS key FROM orders WHERE o_orderkey % 997 = 0
    UNION ALL SELECT 'score', verification_id FROM verdict WHERE verification_id % 101 = 0
    UNION ALL SELECT 'log', event_id FROM events WHERE event_id % 997 = 0""",
)
def tamper_detect(spark, sf):
    """Row, score and log tampering: exactly the changed keys are reported."""
    orders = table(spark, sf, "orders")
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 997 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    rows = tamper.changed_rows(orders, changed, "o_orderkey")
    records = consensus.consensus(submissions(spark, sf))
    vid = F.col("verification_id")
    claimed = records.withColumn("privacy", F.when(vid % 101 == 0, F.col("privacy") + 1).otherwise(F.col("privacy")))
    scores = tamper.changed_scores(records, claimed)
    log = _chained(spark, sf)
    edited = log.withColumn("score", F.when(F.col("seq") % 997 == 0, F.col("score") + 1).otherwise(F.col("score")))
    logs = chain.verify(edited, "seq", PAYLOAD)
    return (
        rows.select(F.lit("row").alias("scenario"), F.col("o_orderkey").alias("key"))
        .unionByName(scores.select(F.lit("score").alias("scenario"), vid.alias("key")))
        .unionByName(logs.select(F.lit("log").alias("scenario"), F.col("seq").alias("key")))
    )


# ----------------------------------------------------------------- compliance

DATASET_SQL = f"""{SUBMISSION_SQL}, ds AS (SELECT verification_id AS dataset, CASE WHEN verification_id % 13 <> 0 THEN privacy END AS privacy,
  CASE WHEN verification_id % 7 <> 0 THEN utility END AS utility, fairness, overall, verification_id % 5 <> 0 AS has_audit,
  verification_id % 3 AS n_extra_columns, verification_id % 12 AS n_identifiers FROM verdict)"""


def datasets(spark, sf):
    vid = F.col("verification_id")
    return consensus.consensus(submissions(spark, sf)).select(
        vid.alias("dataset"),
        F.when(vid % 13 != 0, F.col("privacy")).alias("privacy"),
        F.when(vid % 7 != 0, F.col("utility")).alias("utility"),
        "fairness",
        "overall",
        (vid % 5 != 0).alias("has_audit"),
        (vid % 3).alias("n_extra_columns"),
        (vid % 12).alias("n_identifiers"),
        F.transform(F.filter(F.sequence(F.lit(0), vid % 12), lambda i: i > 0), lambda i: F.concat(F.lit("column_"), i.cast("string"))).alias("identifiers"),
    )


# The expected rule book, written out on its own: standard, article, what is
# judged, least score, advice on failure, advice where the score is missing.
RULE_SQL = """rb(standard, article, kind, least, advice, missing) AS (VALUES
    ('GDPR', 'Article 5(1)(c)', 'columns', 0, 'Remove unnecessary columns from synthetic data', NULL),
    ('GDPR', 'Article 5(1)(d)', 'utility', 70, 'Improve synthetic data quality', 'Run utility verification first'),
    ('GDPR', 'Article 25', 'privacy', 70, 'Improve privacy protection measures', 'Run privacy verification first'),
    ('GDPR', 'Article 35', 'assessed', 0, 'Complete privacy and utility assessments', NULL),
    ('GDPR', 'Article 5(2)', 'logged', 0, 'Enable audit logging', NULL),
    ('HIPAA', '164.514(a)', 'privacy', 70, 'Improve de-identification measures', 'Run privacy verification'),
    ('HIPAA', '164.514(b)(1)', 'privacy', 0, NULL, 'Apply statistical methods for de-identification'),
    ('HIPAA', '164.514(b)(2)', 'names', 0, 'Remove or generalize: ', NULL),
    ('HIPAA', '164.312(b)', 'logged', 0, 'Implement audit logging', NULL),
    ('HIPAA', '164.530(j)', 'logged', 0, 'Create documentation for data handling procedures', NULL),
    ('EU AI Act', 'Article 10', 'utility', 70, 'Improve data quality', 'Run utility verification'),
    ('EU AI Act', 'Article 13', 'logged', 0, 'Document the generation process', NULL),
    ('EU AI Act', 'Article 9', 'fairness', 80, 'Address bias in synthetic data', 'Run bias detection'),
    ('EU AI Act', 'Article 11', 'logged', 0, 'Create technical documentation', NULL),
    ('EU AI Act', 'Article 14', 'always', 0, NULL, NULL)
), rv AS (
    SELECT *, CASE kind WHEN 'privacy' THEN privacy WHEN 'utility' THEN utility WHEN 'fairness' THEN fairness END AS v FROM ds, rb
), rr AS (
    SELECT dataset, standard, article,
      CASE kind WHEN 'columns' THEN n_extra_columns = 0 WHEN 'assessed' THEN has_audit AND privacy IS NOT NULL AND utility IS NOT NULL
           WHEN 'logged' THEN has_audit WHEN 'names' THEN n_identifiers = 0 WHEN 'always' THEN true ELSE v IS NOT NULL AND v >= least END AS passed,
      CAST(CASE kind WHEN 'columns' THEN CASE WHEN n_extra_columns = 0 THEN 100 ELSE 50 END
           WHEN 'assessed' THEN CASE WHEN has_audit AND privacy IS NOT NULL AND utility IS NOT NULL THEN 100 ELSE 0 END
           WHEN 'logged' THEN CASE WHEN has_audit THEN 100 ELSE 0 END WHEN 'names' THEN greatest(0, 100 - n_identifiers * 10) WHEN 'always' THEN 100 ELSE coalesce(v, 0) END AS DOUBLE) AS score,
      CASE WHEN passed THEN NULL WHEN kind IN ('privacy', 'utility', 'fairness') AND v IS NULL THEN missing
           WHEN kind = 'names' THEN advice || array_to_string(list_transform(range(1, n_identifiers + 1), lambda i: 'column_' || i), ', ') ELSE advice END AS recommendation
    FROM rv
)"""


@query("compliance_rules", f"WITH {DATASET_SQL}, {RULE_SQL} SELECT dataset, standard, article, passed, round(score, 6) AS score, recommendation FROM rr")
def compliance_rules(spark, sf):
    return _rounded(compliance.evaluate(datasets(spark, sf)).drop("requirement"), "score")


@query(
    "compliance_rollup",
    f"""WITH {DATASET_SQL}, {RULE_SQL} SELECT dataset, standard, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
    round(count(*) FILTER (passed) * 100.0::DOUBLE / count(*), 4) AS compliance_score, bool_and(passed) AS compliant FROM rr GROUP BY GROUPING SETS ((dataset, standard), (dataset))""",
)
def compliance_rollup(spark, sf):
    return _rounded(compliance.roll_up(compliance.evaluate(datasets(spark, sf))), "compliance_score", digits=4)


@query(
    "compliance_report",
    f"""WITH {DATASET_SQL}, {RULE_SQL} SELECT dataset, round(count(*) FILTER (passed) * 100.0::DOUBLE / count(*), 4) AS overall_compliance_score, bool_and(passed) AS overall_compliant,
    coalesce(string_agg(DISTINCT recommendation, '; ' ORDER BY recommendation), '') AS recommendations,
    sha256(string_agg(standard || '|' || article || '|' || passed, ',' ORDER BY standard || '|' || article || '|' || passed)) AS signature FROM rr GROUP BY 1""",
)
def compliance_report(spark, sf):
    return _rounded(compliance.report(compliance.evaluate(datasets(spark, sf))), "overall_compliance_score", digits=4)


def _profile_sql(profile: str) -> str:
    return " UNION ALL ".join(
        f"SELECT dataset, '{profile}' AS profile, '{s}' AS standard, '{c}' AS \"check\", "
        + " AND ".join(f"coalesce({col} >= {least}, false)" for col, least in conditions)
        + " AS passed FROM ds"
        for s, c, conditions in compliance.PROFILES[profile]
    )


@query("compliance_profiles", f"WITH {DATASET_SQL} " + " UNION ALL ".join(_profile_sql(p) for p in compliance.PROFILES))
def compliance_profiles(spark, sf):
    rows = datasets(spark, sf)
    out = None
    for p in compliance.PROFILES:
        part = compliance.evaluate_profile(rows, p).withColumn("profile", F.lit(p))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "latest_consensus",
    f"""WITH {SUBMISSION_SQL} SELECT verification_id % 100 AS data_hash, arg_max(status, verification_id) AS status, max(verification_id) AS verification_id, round(arg_max(privacy, verification_id), 6) AS privacy FROM verdict GROUP BY 1""",
)
def latest_consensus(spark, sf):
    records = consensus.consensus(submissions(spark, sf)).select((F.col("verification_id") % 100).alias("data_hash"), "verification_id", "status", "privacy")
    return _rounded(compliance.latest_records(records, "data_hash", "verification_id"), "privacy")


TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Columns of the test tables, for the reference query only.
TABLE_COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}
_COLUMNS_SQL = "cl AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, {i} AS position, '{c}' AS col, (SELECT count({c}) FROM {t}) AS n_values" for t, cs in TABLE_COLUMNS.items() for i, c in enumerate(cs)
) + "), tk AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in compliance.IDENTIFIER_TOKENS) + "]) AS token), ht AS (SELECT dataset, token, arg_min(col, position) AS col FROM cl JOIN tk ON contains(col, token) GROUP BY 1, 2)"


# The names found, in the order of the tokens.
_NAMES_SQL = "SELECT dataset, string_agg(col, ', ' ORDER BY list_position([" + ", ".join(f"'{t}'" for t in compliance.IDENTIFIER_TOKENS) + "], token)) AS names FROM ht GROUP BY 1"


def _columns(spark, sf):
    return compliance.column_frame({t: table(spark, sf, t) for t in TABLE_NAMES})


@query(
    "safe_harbor",
    f"""WITH {_COLUMNS_SQL}, h AS (SELECT dataset, count(*) AS n FROM ht GROUP BY 1), v AS (SELECT dataset, CAST(sum(n_values) AS BIGINT) AS e FROM cl WHERE (dataset, col) IN (SELECT (dataset, col) FROM ht) GROUP BY 1)
    SELECT dataset, count(*) AS columns_checked, coalesce(max(n), 0) AS n_identifiers, CAST(greatest(0, 100 - coalesce(max(n), 0) * 10) AS DOUBLE) AS score, coalesce(max(n), 0) = 0 AS passed, coalesce(max(e), 0) AS exposed_values,
           coalesce(max(names), '') AS identifiers FROM cl LEFT JOIN h USING (dataset) LEFT JOIN v USING (dataset) LEFT JOIN ({_NAMES_SQL}) nm USING (dataset) GROUP BY 1""",
)
def safe_harbor(spark, sf):
    columns = _columns(spark, sf)
    hit = compliance.identifier_hits(columns).select("dataset", "column").distinct()
    exposed = columns.join(hit, ["dataset", "column"], "left_semi").groupBy("dataset").agg(F.sum("n_values").alias("e"))
    out = compliance.safe_harbor(columns).join(exposed, "dataset", "left")
    return out.withColumns({"exposed_values": F.coalesce("e", F.lit(0)), "identifiers": F.array_join("identifiers", ", ")}).drop("e")


@query(
    "compliance_scan",
    f"""WITH {_COLUMNS_SQL}, nm AS ({_NAMES_SQL}), n AS (SELECT dataset, count(*) AS k FROM ht GROUP BY 1), d AS (SELECT DISTINCT dataset FROM cl)
    SELECT dataset, '164.514(b)(2)' AS article, k IS NULL AS passed, CAST(greatest(0, 100 - coalesce(k, 0) * 10) AS DOUBLE) AS score, 'Remove or generalize: ' || names AS recommendation FROM d LEFT JOIN n USING (dataset) LEFT JOIN nm USING (dataset)
    UNION ALL SELECT dataset, 'Article 5(1)(c)', dataset <> 'orders', CASE WHEN dataset = 'orders' THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END, CASE WHEN dataset = 'orders' THEN 'Remove unnecessary columns from synthetic data' END FROM d""",
)
def compliance_scan(spark, sf):
    """The columns found by the scan of the tables go to the rules and into their advice."""
    real = {t: table(spark, sf, t) for t in TABLE_NAMES}
    synth = {t: df.withColumn("extra_column", F.lit(1)) if t == "orders" else df for t, df in real.items()}
    columns = [compliance.column_frame(x) for x in (real, synth)]
    scores = columns[0].select("dataset").distinct().select("dataset", *[F.lit(90.0).alias(c) for c in ("privacy", "utility", "fairness")], F.lit(True).alias("has_audit"))
    out = compliance.evaluate(compliance.dataset_rows(*columns, scores))
    return out.where(F.col("article").isin("164.514(b)(2)", "Article 5(1)(c)")).select("dataset", "article", "passed", "score", "recommendation")


@query(
    "minimisation",
    f"""WITH {_COLUMNS_SQL} SELECT dataset, count(*) FILTER (n_values > 0) AS n_real, count(*) FILTER (n_values > 0) + CAST(dataset IN ('orders', 'events') AS INTEGER) AS n_synth,
    CAST(dataset IN ('orders', 'events') AS BIGINT) AS n_extra, CASE WHEN dataset IN ('orders', 'events') THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END AS score, dataset NOT IN ('orders', 'events') AS passed FROM cl GROUP BY dataset""",
)
def minimisation(spark, sf):
    """Two of the tables get one column more on the synthetic side."""
    real = {t: table(spark, sf, t) for t in TABLE_NAMES}
    synth = {t: df.withColumn("extra_column", F.lit(1)) if t in ("orders", "events") else df for t, df in real.items()}
    return compliance.minimization(compliance.column_frame(real), compliance.column_frame(synth))
