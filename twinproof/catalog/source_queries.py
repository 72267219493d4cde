"""Tables, reports, logs and records written to files and read back, next to the SQL of the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinproof.catalog.pairs import AUDIT_SQL, audit_events, table
from twinproof.catalog.record_queries import LEDGER_SQL, ledger_log
from twinproof.catalog.registry import query
from twinproof.functions.scalar import round6
from twinproof.operators import audit, generation
from twinproof.session import shared_dir
from twinproof.sources import files

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority"


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _shown(orders):
    return orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", round6(F.col("o_totalprice")).alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority"
    )


@query("csv_round_trip", f"SELECT {_ORDERS} FROM orders")
def csv_round_trip(spark, sf):
    """A table as CSV, read with its schema."""
    orders, path = table(spark, sf, "orders"), _folder(spark, "csv")
    files.write_csv(orders, path)
    return _shown(files.read_table(spark, path, orders.schema, "csv"))


@query("csv_inferred", "SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderkey % 2 = 0 AS even FROM orders WHERE o_orderkey % 2 = 0 OR o_totalprice > 1000")
def csv_inferred(spark, sf):
    """CSV whose types are found by reading it: numbers and booleans come back as such."""
    orders, path = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), _folder(spark, "csv")
    files.write_csv(orders.withColumn("even", F.col("o_orderkey") % 2 == 0), path)
    back = files.read_table(spark, path, kind="csv")
    return back.where(F.col("even") | (F.col("o_totalprice") > 1000)).select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), round6(F.col("o_totalprice")).alias("o_totalprice"), "even")


@query("json_round_trip", f"SELECT {_ORDERS}, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS gap FROM orders")
def json_round_trip(spark, sf):
    """A report as JSON lines, nulls kept."""
    orders, path = table(spark, sf, "orders").withColumn("gap", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey"))), _folder(spark, "json")
    files.write_report(orders, path)
    back = files.read_table(spark, path, orders.schema, "json")
    return _shown(back.select(*orders.columns)).join(back.select("o_orderkey", "gap"), "o_orderkey")


@query("parquet_scan", f"SELECT {_ORDERS} FROM orders WHERE o_totalprice > 200000")
def parquet_scan(spark, sf):
    return _shown(files.read_table(spark, f"{sf}/orders.parquet").where("o_totalprice > 200000"))


@query(
    "trial_results",
    """WITH t AS (SELECT event_type AS approach, count(*) AS trials, round(avg(value), 6) AS mean FROM events GROUP BY 1)
    SELECT 'csv' AS kind, * FROM t UNION ALL SELECT 'json', * FROM t""",
)
def trial_results(spark, sf):
    """Trial results, written as CSV and JSON side by side."""
    made = table(spark, sf, "events").groupBy(F.col("event_type").alias("approach")).agg(F.count("*").alias("trials"), round6(F.avg("value")).alias("mean"))
    path = _folder(spark, "trials")
    files.write_results(made, path)
    parts = [files.read_table(spark, f"{path}/{kind}", made.schema, kind).select(F.lit(kind).alias("kind"), *made.columns) for kind in ("csv", "json")]
    return parts[0].unionByName(parts[1])


def _exportable(spark, sf):
    return audit_events(spark, sf).withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "resource_hash": F.sha2("resource", 256)})


_SHOWN = "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS logged_at"


@query(
    "audit_export_csv",
    f"WITH {AUDIT_SQL} SELECT entry_id, {_SHOWN}, event_type, level, actor, action, resource, sha256(resource) AS resource_hash FROM audit",
)
def audit_export_csv(spark, sf):
    """The audit trail as CSV of eight columns."""
    path = _folder(spark, "audit-csv")
    files.export_audit(_exportable(spark, sf), path, "csv")
    back = files.read_table(spark, path, "entry_id string, timestamp timestamp, event_type string, level string, actor string, action string, resource string, resource_hash string", "csv")
    return back.select("entry_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), *back.columns[2:])


@query("audit_export_json", f"WITH {AUDIT_SQL} SELECT seq, entry_id, {_SHOWN}, event_type, details, round(score, 6) AS score FROM audit")
def audit_export_json(spark, sf):
    log, path = _exportable(spark, sf), _folder(spark, "audit-json")
    files.export_audit(log, path, "json")
    back = files.read_table(spark, path, log.schema, "json")
    return back.select("seq", "entry_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "event_type", "details", round6(F.col("score")).alias("score"))


@query(
    "audit_export_txt",
    f"""WITH {AUDIT_SQL} SELECT '[' || upper(level) || '] ' || event_type || ': ' || actor || ' - ' || action AS head, '  Resource: ' || resource AS resource, count(*) AS n,
    count(*) FILTER (length(coalesce(details, '')) > 2) AS n_details FROM audit GROUP BY 1, 2""",
)
def audit_export_txt(spark, sf):
    """The text export: each entry is two or three lines, written and read as text files."""
    path = _folder(spark, "audit-txt")
    files.export_audit(_exportable(spark, sf), path, "txt")
    whole = spark.read.text(path, lineSep="\n\n")
    lines = F.split("value", "\n")
    parts = whole.select(F.regexp_replace(lines[0], r"^\[[^\]]*\] ", "").alias("head"), lines[1].alias("resource"), F.col("value").contains("\n  Details: ").alias("more"))
    return parts.groupBy("head", "resource").agg(F.count("*").alias("n"), F.count(F.when(F.col("more"), 1)).alias("n_details"))


@query(
    "audit_documents",
    f"""WITH {AUDIT_SQL} SELECT entry_id, {_SHOWN}, event_type, actor FROM audit WHERE actor <> 'user_7'""",
)
def audit_documents(spark, sf):
    """Exported audit documents, one per actor; the damaged one (of user_7) gives no entries."""
    path = _folder(spark, "audit-documents")
    entry = F.struct("entry_id", "timestamp", "event_type", "level", "actor", "action", "resource")
    documents = _exportable(spark, sf).groupBy("actor").agg(F.to_json(F.struct(F.collect_list(entry).alias("entries"))).alias("value"))
    cut = F.when(F.col("actor") == "user_7", F.expr("substring(value, 1, length(value) - 3)")).otherwise(F.col("value"))
    documents.select(cut.alias("value")).write.text(path)
    back = files.load_audit(spark, path, lines=True)
    return back.select("entry_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "event_type", "actor")


@query(
    "audit_by_day",
    f"""WITH {AUDIT_SQL} SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM audit WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY 1, 2""",
)
def audit_by_day(spark, sf):
    """A log appended in two parts, laid out by day; the filter reads five days' files only."""
    path, log = _folder(spark, "audit-days"), _exportable(spark, sf)
    for part in (0, 1):
        files.append_audit(log.where(F.col("seq") % 2 == part), path)
    back = spark.read.parquet(path).where(F.col("day").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date")))
    return back.groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(
    "text_log_files",
    f"""WITH {AUDIT_SQL} SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS logged_at, upper(level) AS level, event_type, actor, action, resource FROM audit
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL FROM region""",
)
def text_log_files(spark, sf):
    """Entries as lines of text files among lines of another shape, parsed back into columns."""
    path = _folder(spark, "text-log")
    lines = audit_events(spark, sf).select(audit.text_line().alias("value"))
    lines.unionByName(table(spark, sf, "region").select(F.concat(F.lit("restarted in "), "r_name").alias("value"))).write.text(path)
    out = files.read_text_log(spark, path)
    return out.select(F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "level", "event_type", "actor", "action", "resource")


@query(
    "record_round_trip",
    """SELECT 'good' AS part, CAST(o_orderkey AS VARCHAR) AS verification_id, round(o_totalprice / 10000, 6) AS overall, CAST(o_custkey AS VARCHAR) AS verifier FROM orders
    UNION ALL SELECT 'bad', '{broken ' || r_regionkey, NULL, NULL FROM region""",
)
def record_round_trip(spark, sf):
    """Consensus records with their submissions as JSON lines; lines that are no records come back apart."""
    path, orders = _folder(spark, "records"), table(spark, sf, "orders")
    one = F.struct(F.col("o_custkey").cast("string").alias("verifier_id"), F.col("o_totalprice").alias("privacy_score"))
    records = orders.select(
        F.col("o_orderkey").cast("string").alias("verification_id"), F.lit("h").alias("data_hash"), (F.col("o_totalprice") / 10000).alias("final_overall_score"), F.array(one).alias("individual_results")
    )
    files.export_records(records, path)
    table(spark, sf, "region").select(F.concat(F.lit("{broken "), F.col("r_regionkey").cast("string")).alias("value")).write.mode("append").text(path)
    good, bad = files.import_records(spark, path)
    kept = good.select(F.lit("good").alias("part"), "verification_id", round6(F.col("final_overall_score")).alias("overall"), F.col("individual_results")[0]["verifier_id"].alias("verifier"))
    return kept.unionByName(bad.select(F.lit("bad").alias("part"), F.col(files.CORRUPT).alias("verification_id"), F.lit(None).cast("double").alias("overall"), F.lit(None).cast("string").alias("verifier")))


@query(
    "trail_export",
    f"""WITH {LEDGER_SQL} SELECT seq, entry_id, entry_type, payload, (SELECT count(*) FROM led) AS total_entries FROM led WHERE data_hash = 'h7'""",
)
def trail_export(spark, sf):
    """The ledger trail of one dataset as JSON lines, with the facts of the chain on each."""
    path, log = _folder(spark, "trail"), ledger_log(spark, sf)
    files.export_trail(log, "h7", path, log.agg(F.count("*").alias("total_entries")))
    schema = "seq bigint, entry_id string, data_hash string, entry_type string, payload string, timestamp string, chain_info struct<total_entries:bigint>"
    return files.read_table(spark, path, schema, "json").select("seq", "entry_id", "entry_type", "payload", "chain_info.total_entries")


_RUNS = (("P", "forest", 12), ("F", "bootstrap", 0), ("O", "bootstrap", 3))


@query(
    "generation_log",
    f"""WITH g(status, generator, epochs) AS (VALUES {', '.join(f"('{s}', '{g}', {e})" for s, g, e in _RUNS)})
    SELECT generator AS generator_type, CAST(count(*) AS BIGINT) AS num_rows, status, 'o_orderkey,o_totalprice,o_orderstatus' AS columns, 'o_orderstatus' AS categorical, '{{"epochs":"' || epochs || '"}}' AS hyperparameters,
           status <> 'O' AS cache_valid, true AS ids_are_short FROM orders JOIN g ON o_orderstatus = status GROUP BY generator, status, epochs""",
)
def generation_log(spark, sf):
    """Generation records of three runs, exported as JSON and read back; the third was made with another set of
    categories, so its generator cannot serve again."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = _folder(spark, "generations")
    for status, generator, epochs in _RUNS:
        made = orders.where(F.col("o_orderstatus") == status)
        categories = ["o_orderstatus"] if status != "O" else ["o_orderstatus", "o_orderkey"]
        record = generation.generation_record(orders, made, generator, "2024-05-01 12:00:00", categories, epochs=epochs).withColumn("status", F.lit(status))
        files.write_report(record, path, "append")
    log = files.read_table(spark, path, record.schema, "json")
    valid = generation.generator_is_reusable(log.withColumn("generation_id", F.col("status")), orders, ["o_orderstatus"]).withColumnRenamed("generation_id", "status")
    out = log.join(valid, "status")
    return out.select(
        "generator_type", "num_rows", "status", F.array_join("columns", ",").alias("columns"), F.col("categorical_columns")[0].alias("categorical"), "hyperparameters", "cache_valid",
        F.col("generation_id").rlike("^[0-9a-f]{16}$").alias("ids_are_short"),
    )


@query(
    "generation_list",
    """WITH l AS (SELECT user_id % 10 AS generator, ts, CAST(value * 100 AS BIGINT) AS rows, sha256(CAST(event_id AS VARCHAR)) AS h FROM events)
    SELECT generator, row_number() OVER (PARTITION BY generator ORDER BY ts DESC, substr(h, 1, 16)) AS place, substr(h, 1, 16) AS id, rows FROM l""",
)
def generation_list(spark, sf):
    """Every generation of every generator, newest first."""
    h = F.sha2(F.col("event_id").cast("string"), 256)
    log = table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("generator"), F.substring(h, 1, 16).alias("generation_id"), F.col("ts").alias("timestamp"), F.round(F.col("value") * 100).cast("bigint").alias("num_rows"), h.alias("output_hash")
    )
    return generation.generation_list(log, ["generator"]).select("generator", F.col("place").cast("bigint").alias("place"), "id", "rows")


@query(
    "typed_entries",
    """WITH e AS (SELECT event_type AS kind, event_id, value, ts FROM events)
    SELECT CASE kind WHEN 'click' THEN 'data_generation' WHEN 'view' THEN 'privacy_verification' WHEN 'signup' THEN 'consensus_result' WHEN 'purchase' THEN 'blockchain_transaction' ELSE 'error' END AS event_type,
           CASE WHEN kind = 'error' THEN 'error' ELSE 'info' END AS level,
           CASE kind WHEN 'click' THEN 'generate_synthetic_data' WHEN 'view' THEN 'verify_privacy' WHEN 'signup' THEN 'consensus_reached' WHEN 'purchase' THEN 'blockchain_log' ELSE 'error_occurred' END AS action,
           count(*) AS n, count(DISTINCT event_id) AS n_ids, CAST(sum(event_id) AS BIGINT) AS of_details FROM e GROUP BY 1, 2, 3""",
)
def typed_entries(spark, sf):
    """Audit entries by the five typed builders, one per event."""
    e = table(spark, sf, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    key = F.col("event_id").cast("string")
    of = lambda kind: e.where(F.col("event_type") == kind)
    h = F.sha2(key, 256)
    none = F.lit("x")
    parts = [
        audit.generation_entries(of("click").select("timestamp", F.lit("g").alias("generator_type"), h.alias("input_hash"), h.alias("output_hash"), F.col("event_id").alias("num_rows"), none.alias("hyperparameters"))),
        audit.verification_entries(of("view").select("timestamp", F.lit("privacy").alias("verification_type"), h.alias("data_hash"), F.col("event_id").alias("score"), F.lit(True).alias("passed"))),
        audit.consensus_entries(of("signup").select("timestamp", h.alias("data_hash"), none.alias("status"), F.col("event_id").alias("overall"), F.lit(3).alias("num_verifiers"))),
        audit.ledger_entries(of("purchase").select("timestamp", F.col("event_id").alias("transaction_id"), h.alias("data_hash"), F.lit("log").alias("transaction_type"), h.alias("block_hash"))),
        audit.error_entries(of("error").select("timestamp", none.alias("error_type"), F.col("event_id").alias("error_message"))),
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    number = F.regexp_extract("details", r'"(?:num_rows|score|overall|transaction_id|error_message)":"?(\d+)', 1).cast("bigint")
    return both.groupBy("event_type", "level", "action").agg(F.count("*").alias("n"), F.countDistinct("entry_id").alias("n_ids"), F.sum(number).alias("of_details"))
