"""Reading and writing tables, reports, logs and records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.operators import audit

RECORD_SCHEMA = """
    verification_id string, data_hash string, status string,
    final_privacy_score double, final_utility_score double, final_bias_score double, final_overall_score double,
    individual_results array<struct<verifier_id: string, privacy_score: double, utility_score: double,
        bias_score: double, overall_score: double, timestamp: string, signature: string>>,
    consensus_timestamp string, threshold_used double, num_verifiers int
"""
ENTRY_SCHEMA = """
    entry_id string, timestamp timestamp, event_type string, level string, actor string, action string,
    resource string, resource_hash string, details string, previous_entry_hash string, entry_hash string
"""
CORRUPT = "_corrupt_record"


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, kind: str | None = None
) -> DataFrame:
    """A table of the given kind, or by file ending: Parquet, JSON, ORC, or CSV with a header.

    CSV types are inferred only when no schema is given.
    """
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    return getattr(reader, kind if kind in ("json", "orc") else "parquet")(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report rows as JSON lines, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Trial results as CSV and JSON side by side."""
    write_csv(df, f"{path}/csv", mode)
    write_report(df, f"{path}/json", mode)


def append_audit(entries: DataFrame, path: str) -> None:
    """Append entries to the log, partitioned by day; nothing is rewritten."""
    entries.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def export_audit(log: DataFrame, path: str, kind: str = "json", mode: str = "overwrite") -> None:
    """The audit trail as JSON lines, 8-column CSV, or text."""
    if kind == "json":
        write_report(log, path, mode)
    elif kind == "csv":
        columns = [c for c in audit.EXPORT_COLUMNS if c in log.columns]
        write_csv(log.select(*columns), path, mode)
    elif kind == "txt":
        log.select(audit.report_text().alias("value")).write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown export format {kind!r}")


def load_audit(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of exported audit documents; a damaged document gives no rows.

    A document is a file, or with ``lines`` a line: files of many documents are split over tasks then.
    """
    doc = f"entries array<struct<{_fields(ENTRY_SCHEMA)}>>, {CORRUPT} string"
    raw = spark.read.schema(doc).option("multiLine", not lines).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT
    ).json(path)
    return raw.where(F.col(CORRUPT).isNull()).select(F.explode("entries").alias("e")).select("e.*")


def load_audit_text(spark: SparkSession, path: str) -> DataFrame:
    """Entries of one exported audit document as text, with their position.

    Nested details stay JSON text, as needed to recompute stored hashes.
    """
    fields = ", ".join(f"`{n}`: string" for n in audit.IMPORTED_COLUMNS)
    raw = spark.read.schema(f"entries array<struct<{fields}>>, {CORRUPT} string").option("multiLine", True).option(
        "columnNameOfCorruptRecord", CORRUPT
    ).json(path)
    return raw.where(F.col(CORRUPT).isNull()).select(F.posexplode("entries").alias("seq", "e")).select("seq", "e.*")


def _fields(schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema))


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    return audit.parse_lines(spark.read.text(path))


def export_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_report(records, path, mode)


def import_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) consensus records; bad keeps the text of what was skipped."""
    raw = spark.read.schema(f"{RECORD_SCHEMA}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    broken = F.col(CORRUPT).isNotNull() | F.col("verification_id").isNull()
    return raw.where(~broken).drop(CORRUPT), raw.where(broken).select(CORRUPT)


def export_trail(log: DataFrame, data_hash: str, path: str, info: DataFrame | None = None, mode: str = "overwrite") -> None:
    """The ledger trail of one dataset, one JSON line per entry in time order.

    ``info`` (one row of chain facts) is repeated on each line when given.
    """
    trail = log.where(F.col("data_hash") == data_hash)
    if info is not None:
        trail = trail.withColumn("chain_info", info.select(F.struct(*info.columns)).scalar())
    write_report(trail.orderBy("timestamp", "seq"), path, mode)


def flatten_history(histories: DataFrame, extra_fields: Mapping[str, str] | None = None) -> DataFrame:
    """Nested history JSON to one entry per generation and verification.

    ``histories`` has (data_hash, history); ``extra_fields`` are further
    fields of a verification to keep, with their types.
    """
    extra = dict(extra_fields or {})
    more = "".join(f", {n}: {t}" for n, t in extra.items())
    schema = (
        "generation struct<timestamp: string>, "
        f"verifications array<struct<verification_id: string, timestamp: string{more}>>"
    )
    parsed = histories.select("data_hash", F.from_json("history", schema).alias("h"))
    generations = parsed.where(F.col("h.generation").isNotNull()).select(
        F.concat(F.lit("gen_"), F.substring("data_hash", 1, 8)).alias("entry_id"),
        "data_hash",
        F.lit("generation").alias("entry_type"),
        F.coalesce("h.generation.timestamp", F.lit("")).alias("timestamp"),
        *[F.lit(None).cast(t).alias(n) for n, t in extra.items()],
    )
    verifications = parsed.select("data_hash", F.explode("h.verifications").alias("v")).select(
        F.concat(F.lit("ver_"), F.substring(F.coalesce("v.verification_id", F.lit("")), 1, 8)).alias("entry_id"),
        "data_hash",
        F.lit("verification").alias("entry_type"),
        F.coalesce("v.timestamp", F.lit("")).alias("timestamp"),
        *[F.col(f"v.{n}").alias(n) for n in extra],
    )
    return generations.unionByName(verifications)
