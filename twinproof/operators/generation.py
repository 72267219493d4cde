"""Bookkeeping of generation jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.functions.scalar import short_id
from twinproof.operators.fingerprint import fingerprint


def generation_record(
    real: DataFrame, synth: DataFrame, generator: str, run_ts, categorical: Sequence[str], seconds: float = 0.0, **params
) -> DataFrame:
    """One log row for a generation job; ``run_ts`` is a timestamp column or literal."""
    source = fingerprint(real).select("data_hash").scalar()
    ts = run_ts if not isinstance(run_ts, str) else F.lit(run_ts).cast("timestamp")
    made = fingerprint(synth)
    return made.select(
        short_id(source, ts.cast("string")).alias("generation_id"),
        ts.alias("timestamp"),
        F.lit(generator).alias("generator_type"),
        source.alias("input_hash"),
        F.col("data_hash").alias("output_hash"),
        F.col("n_rows").alias("num_rows"),
        F.array(*[F.lit(c) for c in synth.columns]).alias("columns"),
        F.array(*[F.lit(c) for c in categorical]).cast("array<string>").alias("categorical_columns"),
        F.to_json(F.create_map(*[F.lit(str(x)) for kv in sorted(params.items()) for x in kv]) if params else F.create_map().cast("map<string,string>")).alias(
            "hyperparameters"
        ),
        F.lit(float(seconds)).alias("generation_seconds"),
    )


def schema_fingerprint(columns: Sequence[str], categorical: Sequence[str]) -> str:
    """Key under which a trained generator may be reused."""
    return "|".join(columns) + "#" + "|".join(sorted(categorical))


def generator_is_reusable(log: DataFrame, real: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(generation_id, cache_valid): same column list and same categorical set."""
    same = (F.col("columns") == F.array(*[F.lit(c) for c in real.columns])) & (
        F.array_sort("categorical_columns") == F.array(*[F.lit(c) for c in sorted(categorical)]).cast(T.ArrayType(T.StringType()))
    )
    return log.select("generation_id", same.alias("cache_valid"))


def generation_list(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, place, id, timestamp, rows, hash): every generation as a row, 1 for the newest of its group."""
    order = Window.partitionBy(*by).orderBy(F.col("timestamp").desc(), "generation_id")
    return log.select(
        *by, F.row_number().over(order).alias("place"), F.col("generation_id").alias("id"), "timestamp", F.col("num_rows").alias("rows"), F.substring("output_hash", 1, 16).alias("hash")
    )


def generation_summary(log: DataFrame, by: Sequence[str] = (), latest: int = 100) -> DataFrame:
    """Generations and rows made, with the newest ``latest`` records in a list.

    Totals count all records; ``generation_list`` gives all of them as rows.
    One window keeps the records of the list per group before anything is collected.
    """
    totals = log.groupBy(*by).agg(F.count("*").alias("total_generations"), F.sum("num_rows").alias("total_rows_generated"))
    order = [F.col("timestamp").desc(), F.col("generation_id")]
    head = (
        log.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        .where(F.col("_rn") <= latest)
        .groupBy(*by)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("_rn", F.col("generation_id").alias("id"), "timestamp", F.col("num_rows").alias("rows"), F.substring("output_hash", 1, 16).alias("hash"))
                )
            ).alias("generations")
        )
    )
    return totals.join(head, list(by)) if by else totals.withColumn("generations", head.scalar())
