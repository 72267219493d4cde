"""Mixing sources to target weights: rates per source, repeated and drawn documents.

Tokens are counted per source, target weights turn into a repetition rate per
source, and every document is emitted floor(rate) times plus one more copy with
probability equal to the fraction, decided by a hash of the document's id.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; rows that repeat an id are drawn alike; an empty table gives an
empty mix; sources without any word have target 0 and are emitted 0 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinproof.llm.tables import free_name, table, word_count
from twinproof.session import settle

WEIGHTS = (1, 2, 3)
MOST = 3  # a source is repeated at most so often
SEED = "mix-1"


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0, null last, by code point): ranges are numbered on
    their own and shifted by the sizes of the ranges before them, so no task
    sorts all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = settle(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range here, never per source
    shift = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(shift, "part").withColumn("rank", F.col("inside") - 1 + F.col("shift")).drop("part", "inside", "shift")


def rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    The level of the fill rises until no uncapped source is above ``most`` times
    its size; each round is one aggregate over the table of sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = settle(ranked(sources).select("source", "source_size", weight.cast("long").alias("weight")), "mix-sources")
    total, weights_sum = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weights_sum = total or 0, weights_sum or 1
    level = total / weights_sum
    limit = most * F.col("source_size")
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        capped, rest = filled.agg(F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        raised = (total - (capped or 0)) / rest if rest else level
        if raised == level:
            break
        level = raised
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(float(level)))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return filled.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(doc_id: Column, rate: Column, seed: str = SEED) -> Column:
    """floor(rate) and one more with the fraction as its probability."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    draw = F.conv(digits, 16, 10).cast("long") / F.lit(float(16**13))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, sized: DataFrame | None = None, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, copy: str = "copy") -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is taken, plus ``copy`` (1, 2, ...)."""
    sized = docs.select("source", word_count("text").alias("size")) if sized is None else sized
    plan = rates(sized, weights, most)
    hit, rate, n = (free_name(docs, x) for x in ("mix_source", "mix_rate", "mix_copies"))
    plan = plan.select(F.col("source").alias(hit), F.col("rate").alias(rate))
    drawn = docs.join(plan, docs["source"].eqNullSafe(plan[hit])).withColumn(n, copies(F.col("doc_id"), F.col(rate), seed))
    each = F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))
    return drawn.where(F.col(n) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], each.alias(free_name(docs, copy)))


def mixed_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """What the mix takes of each document, without writing the texts out."""
    sized = settle(docs.select("doc_id", "source", word_count("text").alias("size")), "mix-sizes")
    plan = rates(sized)
    hit = plan.withColumnRenamed("source", "plan_source")
    joined = sized.join(hit, sized["source"].eqNullSafe(hit["plan_source"]))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("doc_id"), F.col("rate"), seed)).alias("taken"))


def op2_mix_sources(spark, sf_dir):
    return mixed_sizes(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         [1, 2, 3][(row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), o AS (
  -- sources by the level at which they are full; c and r: what is full before, what weighs from here on
  SELECT *, sum(3 * s) OVER (ORDER BY 3 * s / w, source NULLS LAST) - 3 * s AS c,
         sum(w) OVER (ORDER BY 3 * s / w DESC, source DESC NULLS FIRST) AS r, sum(s) OVER () AS t
  FROM s
), l AS (
  SELECT (t - c) / r AS level FROM o WHERE (t - c) / r <= 3 * s / w ORDER BY 3 * s / w, source NULLS LAST LIMIT 1
), p AS (
  SELECT source, s, least(CAST(3 * s AS DOUBLE), w * coalesce((SELECT level FROM l), 0)) AS target FROM s
), q AS (
  SELECT *, CASE WHEN s > 0 THEN least(target / s, 3.0::DOUBLE) ELSE 0 END AS rate FROM p
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, q.s AS source_size, q.target,
       CAST(d.size * (floor(q.rate) + CASE WHEN ('0x' || substr(md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT
            / 4503599627370496.0::DOUBLE < q.rate - floor(q.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
