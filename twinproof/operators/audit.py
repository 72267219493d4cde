"""Audit log: entries, search, sessions and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions.canonical_json import ascii_string, sorted_object, sorted_text
from twinproof.functions.scalar import short_id, sorted_json

ENTRY_COLUMNS = (
    "entry_id",
    "timestamp",
    "event_type",
    "level",
    "actor",
    "action",
    "resource",
    "resource_hash",
    "details",
)
EXPORT_COLUMNS = ENTRY_COLUMNS[:8]

# Event type of each verification kind.
VERIFICATION_EVENTS = {
    "privacy": "privacy_verification",
    "utility": "utility_verification",
    "bias": "bias_detection",
    "compliance": "compliance_check",
}


def entries(
    source: DataFrame,
    timestamp: Column,
    event_type: Column | str,
    action: Column | str,
    resource: Column | str,
    details: dict[str, Column],
    level: str = "info",
    actor: Column | str = "system",
    resource_hash: Column | None = None,
) -> DataFrame:
    """Audit entries, one per row of ``source``; details become sorted JSON."""

    def col(x):
        return F.lit(x) if isinstance(x, str) else x

    hashed = resource_hash if resource_hash is not None else F.lit(None).cast("string")
    body = source.select(
        timestamp.alias("timestamp"),
        col(event_type).alias("event_type"),
        F.lit(level).alias("level"),
        col(actor).alias("actor"),
        col(action).alias("action"),
        col(resource).alias("resource"),
        hashed.alias("resource_hash"),
        sorted_json(**details).alias("details"),
    )
    return body.select(short_id(*[F.col(c) for c in body.columns]).alias("entry_id"), "*")


def generation_entries(log: DataFrame) -> DataFrame:
    """Entries for rows of the generation log."""
    names = ("generator_type", "input_hash", "output_hash", "num_rows", "hyperparameters")
    return entries(
        log,
        F.col("timestamp"),
        "data_generation",
        "generate_synthetic_data",
        "synthetic_dataset",
        {n: F.col(n) for n in names},
        resource_hash=F.col("output_hash"),
    )


def verification_entries(results: DataFrame) -> DataFrame:
    """Entries for (timestamp, verification_type, data_hash, score, passed) rows."""
    kind = F.col("verification_type")
    known = F.create_map(*[F.lit(x) for pair in VERIFICATION_EVENTS.items() for x in pair])
    return entries(
        results,
        F.col("timestamp"),
        F.coalesce(F.try_element_at(known, kind), F.lit("system_event")),
        F.concat(F.lit("verify_"), kind),
        "verification_result",
        {"verification_type": kind, "score": F.col("score"), "passed": F.col("passed")},
        resource_hash=F.col("data_hash"),
    )


def consensus_entries(records: DataFrame) -> DataFrame:
    """Entries for consensus records with data_hash and timestamp."""
    return entries(
        records,
        F.col("timestamp"),
        "consensus_result",
        "consensus_reached",
        "consensus_record",
        {"status": F.col("status"), "overall": F.col("overall"), "num_verifiers": F.col("num_verifiers")},
        resource_hash=F.col("data_hash"),
    )


def ledger_entries(transactions: DataFrame) -> DataFrame:
    """Entries for ledger transactions with their block hash."""
    names = ("transaction_id", "data_hash", "transaction_type", "block_hash")
    return entries(
        transactions,
        F.col("timestamp"),
        "blockchain_transaction",
        F.concat(F.lit("blockchain_"), F.col("transaction_type")),
        "blockchain_entry",
        {n: F.col(n) for n in names},
        resource_hash=F.col("block_hash"),
    )


def error_entries(errors: DataFrame) -> DataFrame:
    """Entries for (timestamp, error_type, error_message) rows."""
    return entries(
        errors,
        F.col("timestamp"),
        "error",
        "error_occurred",
        "error",
        {"error_type": F.col("error_type"), "error_message": F.col("error_message")},
        level="error",
    )


def search(
    log: DataFrame,
    event_type: str | None = None,
    level: str | None = None,
    actor: str | None = None,
    start=None,
    end=None,
    limit: int | None = None,
    order: str = "seq",
) -> DataFrame:
    """Matching entries, newest first. Predicates reach the table scan."""
    out = log
    for column, value in (("event_type", event_type), ("level", level), ("actor", actor)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("timestamp") <= F.lit(end))
    out = out.orderBy(F.col(order).desc())
    return out.limit(limit) if limit else out


def session_summary(log: DataFrame, session: str, timestamp: str = "timestamp") -> DataFrame:
    """Per session: entries, duration in seconds and counts by event type.

    Events are counted by type first; the map then has one item per type.
    """
    seconds = F.unix_micros(F.col(timestamp).cast("timestamp"))
    by_type = log.groupBy(session, "event_type").agg(
        F.count("*").alias("n"), F.min(seconds).alias("first"), F.max(seconds).alias("last")
    )
    return by_type.groupBy(session).agg(
        F.sum("n").alias("total_entries"),
        ((F.max("last") - F.min("first")) / 1e6).alias("duration_seconds"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("event_counts"),
    )


def breakdown(log: DataFrame) -> DataFrame:
    """Counts by event type, level and actor, and the total, in one pass."""
    keys = ("event_type", "level", "actor")
    sets = log.groupingSets([[k] for k in keys] + [[]], *keys)
    counted = sets.agg(
        F.grouping_id().alias("_g"), F.count("*").alias("n"), F.min("timestamp").alias("first_entry"), F.max("timestamp").alias("last_entry")
    )
    kind = F.when(F.col("_g") == 3, keys[0]).when(F.col("_g") == 5, keys[1]).when(F.col("_g") == 6, keys[2]).otherwise("total")
    value = F.when(F.col("_g") == 3, F.col(keys[0])).when(F.col("_g") == 5, F.col(keys[1])).when(F.col("_g") == 6, F.col(keys[2]))
    return counted.select(kind.alias("kind"), value.alias("value"), "n", "first_entry", "last_entry")


def text_line(name: str = "audit") -> Column:
    """The one-line text form of an entry."""
    return F.format_string(
        f"%s | %s | {name} | [%s] %s - %s on %s",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss,SSS"),
        F.upper("level"),
        F.col("event_type"),
        F.col("actor"),
        F.col("action"),
        F.col("resource"),
    )


# Fixed value: layout of a text log line.
LINE_PATTERN = r"^(\S+ \S+) \| (\w+) \| (\w+) \| \[([^\]]*)\] (.*?) - (.*) on (.*)$"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Columns of text log lines; lines of another shape keep only ``raw``."""
    names = ("logged_at", "level", "logger", "event_type", "actor", "action", "resource")
    part = [F.nullif(F.regexp_extract(column, LINE_PATTERN, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)]
    out = lines.select(F.col(column).alias("raw"), *part)
    return out.withColumn("logged_at", F.try_to_timestamp("logged_at", F.lit("yyyy-MM-dd HH:mm:ss,SSS")))


# Fields of an entry in an exported audit document.
HASHED_COLUMNS = (
    "entry_id", "timestamp", "event_type", "level", "actor", "action", "resource", "resource_hash",
    "details", "metadata", "previous_entry_hash",
)
IMPORTED_COLUMNS = (*HASHED_COLUMNS, "entry_hash")
_NESTED = ("details", "metadata")


def stored_entry_hash() -> Column:
    """SHA-256 of an entry's JSON text with sorted keys, as exported logs store it.

    Only imported documents need this form of JSON; own chains hash canonical
    row text.
    """
    fields = {c: sorted_text(F.col(c)) if c in _NESTED else ascii_string(F.col(c)) for c in HASHED_COLUMNS}
    return F.sha2(sorted_object(fields), 256)


def verify_imported(log: DataFrame) -> DataFrame:
    """(seq, issue) of an imported log: wrong hashes and broken links.

    Each entry meets its predecessor by an equi join on the position.
    """
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("_before"))
    checked = log.withColumn("_now", stored_entry_hash()).join(before, "seq", "left")
    problems = F.array(
        F.when(~F.col("entry_hash").eqNullSafe(F.col("_now")), F.lit("hash_mismatch")),
        F.when((F.col("seq") > 0) & ~F.col("previous_entry_hash").eqNullSafe(F.col("_before")), F.lit("chain_break")),
    )
    return checked.select("seq", F.explode(F.array_compact(problems)).alias("issue"))


def report_text() -> Column:
    """Two or three text lines per entry, as in the text export."""
    head = F.format_string(
        "[%s] [%s] %s: %s - %s\n  Resource: %s\n",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.upper("level"),
        F.col("event_type"),
        F.col("actor"),
        F.col("action"),
        F.col("resource"),
    )
    more = F.when(F.length(F.coalesce("details", F.lit(""))) > 2, F.concat(F.lit("  Details: "), F.col("details"), F.lit("\n"))).otherwise("")
    return F.concat(head, more)
