"""Distributed running totals, ranks and exact quantiles.

A window over a whole column would put every row of it into one task. Here
the ordered values are cut into range buckets, each bucket is summed alone,
and small per-bucket offsets are added to windows that stay inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinproof.session import bucket_count, settle

SMALL_ROWS = 1_000_000
GROUP_ROWS = 1_000_000


def position_in(edges: Column, value: Column, max_edges: int) -> Column:
    """How many sorted ``edges`` are <= value, by binary search."""
    steps = [1 << b for b in range(max(1, max_edges.bit_length()) - 1, -1, -1)]

    def step(found: Column, width: Column) -> Column:
        probe = found + width
        fits = (probe <= F.size(edges)) & (F.try_element_at(edges, probe) <= value)
        return F.when(fits, probe).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _numeric_edges(values: DataFrame, keys: Sequence[str], order: str, buckets: int) -> DataFrame:
    cuts = [i / buckets for i in range(1, buckets)]
    return values.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(order, cuts, max(10000, 10 * buckets))).alias("edges")
    )


def _text_edges(values: DataFrame, keys: Sequence[str], order: str, buckets: int) -> DataFrame:
    """Edges for text: a uniform sample of the values, those with the smallest hashes.

    A threshold from the number of rows of a key lets through about ``buckets``
    values of each, whatever the number of partitions.
    """
    sizes = values.groupBy(*keys).agg(F.count("*").alias("size"))  # few key combinations
    spot = F.pmod(F.xxhash64(order), F.lit(1 << 40)) / float(1 << 40)
    near = values.join(F.broadcast(sizes), list(keys)).where(spot * F.col("size") < buckets)
    sample = F.slice(F.array_sort(F.collect_list(F.struct(spot.alias("spot"), F.col(order).alias("value")))), 1, max(1, buckets - 1))
    edges = near.groupBy(*keys).agg(F.array_sort(F.transform(sample, lambda x: x["value"])).alias("edges"))
    # a key whose sample came out empty has one bucket
    return sizes.select(*keys).join(edges, list(keys), "left").select(*keys, F.coalesce("edges", F.array().cast("array<string>")).alias("edges"))


def running_totals(
    values: DataFrame,
    keys: Sequence[str],
    order: str,
    amounts: Sequence[str],
    buckets: int | None = None,
    small_rows: int | None = None,
    written: bool = False,
) -> DataFrame:
    """Add ``cum_<amount>`` (inclusive) and ``next_value`` per row.

    ``values`` has one row per (keys, order) and few key combinations, such as
    one per table column. It is written out once, since several passes read
    it, unless it is ``written`` already. A table of proven small size uses one
    window per key; otherwise the edges and offsets, at most keys x buckets rows,
    are broadcast.
    """
    table = values if written else settle(values, "ordered")
    if table.count() <= (SMALL_ROWS if small_rows is None else small_rows):
        whole = Window.partitionBy(*keys).orderBy(order)
        upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return table.withColumns(
            {**{f"cum_{a}": F.sum(a).over(upto) for a in amounts}, "next_value": F.lead(order).over(whole)}
        )
    buckets = buckets or bucket_count(values.sparkSession)
    text = dict(table.dtypes)[order] == "string"
    edges = settle((_text_edges if text else _numeric_edges)(table, keys, order, buckets), "edges")
    placed = table.join(F.broadcast(edges), list(keys)).withColumn(
        "bucket", position_in(F.col("edges"), F.col(order), buckets)
    ).drop("edges")

    per_bucket = placed.groupBy(*keys, "bucket").agg(
        *[F.sum(a).alias(f"sum_{a}") for a in amounts], F.min(order).alias("first_value")
    )
    over_buckets = Window.partitionBy(*keys).orderBy("bucket")
    before = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        "bucket",
        *[F.coalesce(F.sum(f"sum_{a}").over(before), F.lit(0)).alias(f"off_{a}") for a in amounts],
        F.lead("first_value").over(over_buckets).alias("bucket_next"),
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.join(F.broadcast(offsets), [*keys, "bucket"])
        .withColumns(
            {
                **{f"cum_{a}": F.col(f"off_{a}") + F.sum(a).over(upto) for a in amounts},
                "next_value": F.coalesce(F.lead(order).over(inside), F.col("bucket_next")),
            }
        )
        .drop("bucket", "bucket_next", *[f"off_{a}" for a in amounts])
    )


def column_quantiles(
    counts: DataFrame, keys: Sequence[str], value: str, n: str, probabilities: Sequence[float], **options
) -> DataFrame:
    """(keys, p, total, quantile) of counted values; for few key combinations.

    Exact with linear interpolation. ``counts`` has one row per (keys, value).
    """
    run = running_totals(counts.select(*keys, value, n), keys, value, [n], **options)
    totals = run.groupBy(*keys).agg(F.sum(n).alias("total"))
    ranked = run.join(F.broadcast(totals), list(keys)).select(
        *keys, value, "total", (F.col(f"cum_{n}") - F.col(n)).alias("before"), F.col(f"cum_{n}").alias("upto")
    )
    out = []
    for p in probabilities:
        rank = (F.col("total") - 1) * F.lit(float(p))

        def holds(k: Column) -> Column:
            return (F.col("before") <= k) & (k < F.col("upto"))

        low = F.max(F.when(holds(F.floor(rank)), F.col(value)))
        high = F.max(F.when(holds(F.ceil(rank)), F.col(value)))
        fraction = F.max(rank - F.floor(rank))
        out += [(low + (high - low) * fraction).alias(f"q{len(out)}")]
    wide = ranked.groupBy(*keys, "total").agg(*out)
    items = [F.struct(F.lit(float(p)).alias("p"), F.col(f"q{i}").alias("quantile")) for i, p in enumerate(probabilities)]
    return wide.select(*keys, "total", F.explode(F.array(*items)).alias("item")).select(*keys, "item.p", "total", "item.quantile")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    accuracy: int = 10000,
    few_keys: bool = False,
) -> DataFrame:
    """(keys, p, n, quantile): exact, linearly interpolated quantiles.

    A sketch brackets each wanted rank; rows below and above the bracket fold
    into counters on the map side, and only the values inside it (about
    4 / accuracy of a group) are sorted. A group of any size therefore never
    sits in one task, and the result does not depend on the sketch.
    """
    keys = list(keys)
    slack = 2.0 / accuracy
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"))
    bracket_points = [b for p in probabilities for b in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile_approx("x", bracket_points, accuracy).alias("b")
    )
    brackets = sketch.select(
        *keys,
        "n",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(float(p)).alias("p"), F.col("b")[2 * i].alias("lo"), F.col("b")[2 * i + 1].alias("hi"))
                    for i, p in enumerate(probabilities)
                ]
            )
        ).alias("q"),
    ).select(*keys, "n", "q.*")
    if keys:
        joined = rows.join(F.broadcast(brackets) if few_keys else brackets, keys)
    else:
        one = brackets.agg(F.collect_list(F.struct("n", "p", "lo", "hi")).alias("all"))
        joined = rows.withColumn("q", F.explode(one.scalar())).select("x", "q.*")
    zone = F.when(F.col("x") < F.col("lo"), F.lit(-1)).when(F.col("x") > F.col("hi"), F.lit(1)).otherwise(F.lit(0))
    pieces = (
        joined.withColumn("zone", zone)
        .groupBy(*keys, "p", "n", "zone", F.when(F.col("zone") == 0, F.col("x")).alias("at"))
        .agg(F.count("*").alias("m"), F.min("x").alias("low"), F.max("x").alias("high"))
    )
    ordered = Window.partitionBy(*keys, "p").orderBy("zone", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = pieces.withColumn("upto", F.sum("m").over(ordered)).withColumn("before", F.col("upto") - F.col("m"))
    rank = (F.col("n") - 1) * F.col("p")
    k0, k1 = F.floor(rank), F.ceil(rank)

    def at_rank(k: Column) -> Column:
        inside = (F.col("before") <= k) & (k < F.col("upto"))
        edge_ok = (
            (F.col("zone") == 0)
            | ((F.col("zone") == -1) & (k == F.col("upto") - 1))
            | ((F.col("zone") == 1) & (k == F.col("before")))
        )
        picked = F.when(F.col("zone") == -1, F.col("high")).otherwise(F.col("low"))
        return F.max(F.when(inside & edge_ok, picked))

    found = ranked.groupBy(*keys, "p", "n").agg(at_rank(k0).alias("v0"), at_rank(k1).alias("v1"))
    fraction = (F.col("n") - 1) * F.col("p") - F.floor((F.col("n") - 1) * F.col("p"))
    result = F.col("v0") + (F.col("v1") - F.col("v0")) * fraction
    missed = F.col("v0").isNull() | F.col("v1").isNull()
    return found.select(
        *keys,
        "p",
        "n",
        F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank"))).otherwise(result).alias("quantile"),
    )


def group_medians(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], group_rows: int | None = None
) -> DataFrame:
    """Keys, ``n`` and the exact median of each column per key combination.

    The largest group is measured first. If it is small the built-in median
    is safe; otherwise the bracketed quantiles keep big groups distributed.
    """
    keys = list(keys)
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= (GROUP_ROWS if group_rows is None else group_rows):
        return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in columns])
    numbers = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    if len(columns) == 1:  # rows that are dealt by their keys stay where they are
        found = exact_quantiles(numbers.withColumnRenamed(columns[0], "value"), keys, "value", [0.5])
        return sizes.join(found.select(*keys, F.col("quantile").alias(columns[0])), keys)
    long = numbers.unpivot(keys, list(columns), "column", "value")
    found = exact_quantiles(long, [*keys, "column"], "value", [0.5])
    picks = [F.max(F.when(F.col("column") == c, F.col("quantile"))).alias(c) for c in columns]
    return sizes.join(found.groupBy(*keys).agg(*picks), keys)
