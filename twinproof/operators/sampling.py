"""Deterministic sampling, exact quotas per group, and row replication.

Order comes from a hash of the whole row, so results repeat across runs and
partition layouts. Rows that are copies of each other share a hash; they are
counted and split by their place, never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinproof.functions.scalar import row_md5, row_text
from twinproof.operators.distributions import unpivoted
from twinproof.operators.running import running_totals
from twinproof.session import bucket_count, settle

# Digits of (32 of the row's hash, 32 of its place) that are fixed step by step.
KEY_DIGITS = (4, 32, 36, 64)
REPLICATE_BLOCK = 10_000
BUCKET_ROWS = 100_000  # distinct rows of a stratum whose places are counted together, about


def bounded_sample(df: DataFrame, n: int, columns: Sequence[str] | None = None) -> DataFrame:
    """At most ``n`` rows in hash order.

    The hash is uniform, so a threshold for a little more than ``n`` rows is known
    from their number: only those are written and ordered, not ``n`` of every
    partition. The threshold is raised where copies leave too few below it.
    """
    name, share = "_hash", (n + 10 * math.sqrt(n) + 100) / max(1, df.count())
    hashed = df.withColumn(name, row_md5(df, columns))
    while share < 1:
        near = settle(hashed.where(F.col(name) < f"{int(share * 16**12):012x}"), "sample")
        if near.count() >= n:
            return near.orderBy(name).limit(n).drop(name)
        share *= 16
    return hashed.orderBy(name).limit(n).drop(name)


def replicate(df: DataFrame, times: str, number: str | None = None) -> DataFrame:
    """Each row repeated ``times`` times (column dropped), copies numbered on request.

    Small counts repeat in place. Large ones are first cut into blocks that
    are spread over the cluster, so one row can become billions.
    """
    keep = [c for c in df.columns if c != times]
    small = df.where((F.col(times) > 0) & (F.col(times) <= REPLICATE_BLOCK))
    large = df.where(F.col(times) > REPLICATE_BLOCK)
    blocks = large.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / REPLICATE_BLOCK)))
    )
    # by row and block: the same block of many rows does not meet in one task
    spread = blocks.repartition(F.xxhash64(*large.columns), "_block").withColumn(
        times, F.least(F.lit(REPLICATE_BLOCK), F.col(times) - F.col("_block") * REPLICATE_BLOCK)
    )
    copy = F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias("_copy")
    both = small.select(*keep, F.lit(0).cast("bigint").alias("_block"), copy).unionByName(
        spread.select(*keep, "_block", copy)
    )
    if number:
        keep = [*keep, (F.col("_block") * REPLICATE_BLOCK + F.col("_copy")).alias(number)]
    return both.select(*keep)


def hash_quota(df: DataFrame, groups: Sequence[str], quota: DataFrame, order: Column | None = None) -> DataFrame:
    """Add ``picked``: exactly ``quota`` rows per group, those first in hash order.

    ``quota`` has one row per group: the group columns, ``quota`` and any
    further columns, which are attached to the rows of that group. Rows of
    other groups are not picked and get nulls.

    Rows are written once with their hash; their place in the written table
    (file and row) goes on where hashes are equal, so copies are told apart and
    every row is decided by one comparison. The boundary of a group is found
    from counts, first by a few digits of the key, then by more of them inside
    the bucket that holds the boundary. Longer keys are looked at only where a
    bucket has to be split, so unlike rows of one hash are never exchanged.
    """
    groups = list(groups)
    columns = df.columns
    order = order if order is not None else row_md5(df)
    group_key = F.struct(*[F.col(g) for g in groups]) if groups else F.struct(F.lit(0).alias("all"))
    written = settle(df.withColumn("_h", order).withColumn("_g", group_key), "hashed")
    place = [F.lpad(F.hex(F.xxhash64(F.lit(i), "_metadata.file_path", "_metadata.row_index")), 16, "0") for i in (0, 1)]
    keyed = written.select("*", F.concat("_h", *place).alias("_k"))
    extra = [c for c in quota.columns if c not in groups and c != "quota"]
    # written, so that its size is known: few groups are broadcast and never gather the rows of a group in one task
    wanted = settle(quota.withColumn("_g", group_key).select("_g", F.col("quota").cast("bigint").alias("_want"), *extra), "quota")

    # Open groups: what is still wanted behind the key digits fixed so far.
    opened = wanted.select("_g", "_want", F.lit("").alias("_edge")).where("_want > 0")
    closed = []
    run = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for digits in KEY_DIGITS:
        inside = keyed.join(opened, "_g").where(F.substring("_k", 1, F.length("_edge")) == F.col("_edge"))
        counts = inside.groupBy("_g", "_want", F.substring("_k", 1, digits).alias("_s")).agg(F.count("*").alias("_n"))
        upto = counts.withColumn("_upto", F.sum("_n").over(run))
        last = F.max("_upto").over(Window.partitionBy("_g"))
        # the first bucket that reaches the quota; the last one where the group is too small
        hit = (F.col("_upto") - F.col("_n") < F.col("_want")) & ((F.col("_upto") >= F.col("_want")) | (F.col("_upto") == F.col("_last")))
        edges = settle(upto.withColumn("_last", last).where(hit).select("_g", F.col("_s").alias("_edge"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_want"), "_n"), "quota-edge")
        closed.append(edges.where("_n <= _want").select("_g", "_edge"))
        opened = edges.where("_n > _want").select("_g", "_want", "_edge")
        if not opened.head(1):
            break
    edge = closed[0]
    for more in closed[1:]:
        edge = edge.unionByName(more)
    table = settle(wanted.join(edge, "_g", "left").select("_g", "_edge", *extra), "quota-edges")
    picked = F.coalesce(F.substring("_k", 1, F.length("_edge")) <= F.col("_edge"), F.lit(False))
    return keyed.join(table, "_g", "left").select(*columns, *extra, picked.alias("picked"))


def labelled_union(real: DataFrame, synth: DataFrame, label: str = "is_real") -> DataFrame:
    """Real rows labelled 1 and synthetic rows labelled 0."""
    return real.withColumn(label, F.lit(1)).unionByName(synth.withColumn(label, F.lit(0)))


def balanced_union(real: DataFrame, synth: DataFrame, label: str = "is_real") -> DataFrame:
    """Equally many rows of each table: the smaller table's count from both."""
    both = labelled_union(real, synth, label)
    sizes = both.groupBy(label).agg(F.count("*").alias("n"))
    smallest = sizes.agg(F.min("n")).scalar()
    return hash_quota(both, [label], sizes.select(label, smallest.alias("quota"))).where("picked").drop("picked")


def split(df: DataFrame, test_share: float = 0.3, stratify: Sequence[str] = ()) -> DataFrame:
    """Add ``is_train``: all but ceil(test_share n) rows, per stratum if given."""
    sizes = df.groupBy(*stratify).agg(F.count("*").alias("n"))
    quota = sizes.select(*stratify, (F.col("n") - F.ceil(F.col("n") * test_share)).alias("quota"))
    return hash_quota(df, stratify, quota).withColumnRenamed("picked", "is_train")


def stratum_targets(df: DataFrame, strata: Sequence[str], n: int) -> DataFrame:
    """(strata, n_source, n_target): proportional sizes, at least one each.

    Halves round to even; a null stratum value is a stratum of its own.
    """
    sizes = df.groupBy(*strata).agg(F.count("*").alias("n_source"))
    total = sizes.agg(F.sum("n_source")).scalar()
    share = F.bround(F.col("n_source") * F.lit(n) / total)
    return sizes.select(*strata, "n_source", F.greatest(F.lit(1), share.cast("bigint")).alias("n_target"))


def md5_bits(text: Column, start: int = 1, digits: int = 15) -> Column:
    """A whole number from hex digits of the text's MD5 (15 digits: 60 bits)."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint")


def numbered(df: DataFrame, name: str = "_copy") -> DataFrame:
    """Every row with its number among its exact copies, from 1; no order of files or partitions matters."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_times"))
    return replicate(counted, "_times", number=name)


def placed(df: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows with ``_g`` (their stratum) and ``_place``, their number inside it from 0, in hash order.

    Copies are counted first, so a row that fills a third of the table is one
    row until the end. The uniform hash cuts a stratum into buckets by its first
    digits: places are counted inside a bucket, and bucket totals are added up.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    key = F.struct(*[F.col(c) for c in strata]) if strata else F.struct(F.lit(0).alias("all"))
    rows = settle(counted.withColumn("_h", row_md5(df)).withColumn("_g", key), "counted-rows")
    digits, buckets = 1, 16
    total = rows.count()
    while total > buckets * BUCKET_ROWS and digits < 6:
        digits, buckets = digits + 1, buckets * 16
    rows = rows.withColumn("_b", F.substring("_h", 1, digits))
    over = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_g", "_b").agg(F.sum("_n").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(over), F.lit(0)))
    inside = Window.partitionBy("_g", "_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_within", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets.drop("_m"), ["_g", "_b"])
    each = replicate(found, "_n", number="_copy")
    return each.select(*columns, "_g", (F.col("_before") + F.col("_within") + F.col("_copy") - 1).alias("_place"))


def bootstrap(df: DataFrame, targets: DataFrame, strata: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows drawn with replacement, ``n_target`` per stratum of ``targets``.

    Draw i of a stratum takes the row at place md5(seed, stratum, i) modulo the
    stratum's rows; draws and rows meet in an equi-join on (stratum, place), which is unique on
    the side of the rows. The result depends on rows and seed alone, not on
    files or partitions.
    """
    strata = list(strata)
    rows = settle(placed(df, strata), "placed-rows")
    key = F.struct(*[F.col(c) for c in strata]) if strata else F.struct(F.lit(0).alias("all"))
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_size"))
    text = row_text(targets, strata) if strata else F.lit("")
    wanted = targets.select(key.alias("_g"), text.alias("_text"), F.col("n_target").alias("_times")).join(sizes, "_g")
    draws = replicate(wanted, "_times", number="_draw")
    place = F.pmod(md5_bits(F.concat_ws(":", F.lit(str(seed)), "_text", F.col("_draw").cast("string"))), F.col("_size"))
    return draws.select("_g", place.alias("_place")).join(rows, ["_g", "_place"]).select(*df.columns)


def stratified_bootstrap(df: DataFrame, n: int, strata: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` generated rows: stratified bootstrap, then trimmed or topped up."""
    targets = settle(stratum_targets(df, strata, n), "targets")
    made = settle(bootstrap(df, targets, strata, seed), "drawn")
    total = targets.agg(F.sum("n_target")).first()[0]
    if total > n:
        spark = df.sparkSession
        quota = spark.range(1).select(F.lit(n).alias("quota"))
        return hash_quota(made, [], quota).where("picked").drop("picked")
    if total < n:
        more = df.sparkSession.range(1).select(F.lit(n - total).alias("n_target"))
        return made.unionByName(bootstrap(df, more, [], seed + 1))
    return made


def normal(text: Column) -> Column:
    """A standard normal number that is a function of the text: Box-Muller over 104 bits of its MD5."""
    scale = float(2**52)
    u = (md5_bits(text, 1, 13).cast("double") + 1) / scale
    v = md5_bits(text, 14, 13).cast("double") / scale
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def gaussian_noise(df: DataFrame, columns: Sequence[str], sigma: float = 0.1, seed: int = 42) -> DataFrame:
    """Normal noise added to number columns, drawn from (row, copy, column, seed).

    Copies of a row get noise of their own; the rows that come out do not depend
    on files or partitions.
    """
    keyed = numbered(df).withColumn("_h", row_md5(df))

    def noise(c: str) -> Column:
        return normal(F.concat_ws(":", F.lit(str(seed)), F.lit(c), "_h", F.col("_copy").cast("string"))) * sigma

    return keyed.withColumns({c: F.col(c) + noise(c) for c in columns}).select(*df.columns)


def marginal_rows(df: DataFrame, n: int, categorical: Sequence[str], numeric: Sequence[str], seed: int = 42, buckets: int | None = None) -> DataFrame:
    """``n`` rows whose columns follow the columns of ``df``, each drawn on its own.

    Inverse distribution functions: draw i of a column takes the value at place
    md5(seed, column, i) modulo its values, in value order. Values with their
    running totals and the draws are cut into the same ranges of places; inside
    a range a draw takes the last value that starts at or before it, and a value that reaches
    over a range is carried into the next. Missing values are not drawn; a
    column without values is null throughout.
    """
    ids = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "_i")
    parts = [_drawn(df, ids, list(c), kind, seed, buckets) for c, kind in ((categorical, "string"), (numeric, "double")) if c]
    out = ids
    for p in parts:
        out = out.join(p, "_i", "left")
    kinds = dict(df.dtypes)
    return out.select(*[F.col(c).cast(kinds[c]).alias(c) for c in (*categorical, *numeric)])


def _drawn(df: DataFrame, ids: DataFrame, columns: list[str], kind: str, seed: int, buckets: int | None) -> DataFrame:
    """(_i, one column per name): the values drawn for each row."""
    buckets = buckets or bucket_count(df.sparkSession)
    counts = unpivoted(df, columns, kind).groupBy("column", "value").agg(F.count("*").alias("n"))
    runs = running_totals(counts, ["column"], "value", ["n"]).select("column", "value", (F.col("cum_n") - F.col("n")).alias("place"), "cum_n")
    runs = settle(runs, "value-runs")
    sizes = runs.groupBy("column").agg(F.max("cum_n").alias("size"))  # one row per schema column
    names = ids.select("_i", F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")).join(sizes, "column")
    bits = md5_bits(F.concat_ws(":", F.lit(str(seed)), "column", F.col("_i").cast("string")))
    draws = names.select("column", F.pmod(bits, F.col("size")).alias("place"), F.col("_i"), F.lit(None).cast(kind).alias("value"))
    starts = runs.select("column", "place", F.lit(None).cast("bigint").alias("_i"), "value")
    wide = F.ceil(F.col("size") / buckets)
    both = starts.unionByName(draws).join(sizes, "column").withColumn("range", F.floor(F.col("place") / wide))
    before = Window.partitionBy("column", "range").orderBy("place", F.col("_i").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = both.withColumn("own", F.last("value", ignorenulls=True).over(before)).where(F.col("_i").isNotNull())
    tails = both.groupBy("column", "range").agg(F.max_by("value", F.when(F.col("_i").isNull(), F.col("place"))).alias("tail"))
    earlier = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("column", "range", F.last("tail", ignorenulls=True).over(earlier).alias("carried"))  # at most ``buckets`` rows per column
    found = hit.join(carried, ["column", "range"]).select("_i", "column", F.coalesce("own", "carried").alias("value"))
    return found.groupBy("_i").agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])


def mock_rows(spark: SparkSession, n: int, categorical: Sequence[str], numeric: Sequence[str], seed: int = 42) -> DataFrame:
    """Independent columns without a table: five labels drawn evenly, numbers from N(50, 10)."""
    text = lambda c: F.concat_ws(":", F.lit(str(seed)), F.lit(c), F.col("id").cast("string"))
    labels = [F.concat(F.lit(f"{c}_val_"), F.pmod(md5_bits(text(c)), F.lit(5)).cast("string")).alias(c) for c in categorical]
    return spark.range(1, n + 1).select(*labels, *[(normal(text(c)) * 10 + 50).alias(c) for c in numeric])


def conditional_rows(df: DataFrame, column: str, value, n: int, seed: int = 42) -> DataFrame:
    """Rows drawn with replacement among those where ``column`` has ``value``."""
    only = df.where(F.col(column) == F.lit(value))
    one = df.sparkSession.range(1).select(F.lit(n).alias("n_target"))
    return bootstrap(only, one, [], seed)
