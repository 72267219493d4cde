"""Preparation, encoding, quality, fingerprint and sampling queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinproof import profiles
from twinproof.catalog.pairs import (
    APPLICANT_COLUMNS,
    APPLICANT_LABELS,
    APPLICANT_NUMBERS,
    APPLICANT_SQL,
    DIRTY_SQL,
    SPLIT_COLUMNS,
    SPLIT_LABELS,
    SPLIT_NUMBERS,
    SPLIT_SQL,
    applicants,
    dirty_orders,
    lineitem_split,
    table,
)
from twinproof.catalog.registry import canon_sql, query
from twinproof.functions.scalar import clamp, row_sha, round6, short_id
from twinproof.operators import distributions, encoding, fingerprint, generation, prepare, quality, sampling
from twinproof.roles import common_columns, dataset_summary, distinct_profile, infer_roles, is_classification, is_number, number_columns, role_table, text_columns
from twinproof.session import shared_dir

_PLAIN = "order_key, total_price, priority, mostly_empty, order_date, price_band, status"
_EXPANDED = """order_key, total_price, priority, mostly_empty, price_band, status,
  CAST(year(CAST(order_date AS DATE)) AS INTEGER) AS order_date_year, CAST(month(CAST(order_date AS DATE)) AS INTEGER) AS order_date_month,
  CAST(day(CAST(order_date AS DATE)) AS INTEGER) AS order_date_day, CAST(isodow(CAST(order_date AS DATE)) - 1 AS INTEGER) AS order_date_dayofweek"""
_STEPS = f"{DIRTY_SQL}, ex AS (SELECT DISTINCT {_EXPANDED} FROM dirty)"


@query(
    "column_roles",
    "WITH "
    + ", ".join(
        f"c{i} AS (SELECT '{c}' AS \"column\", {i} AS position, count(DISTINCT {c}) AS n_distinct, {t} AS is_text FROM orders)"
        for i, (c, t) in enumerate(
            (("o_orderkey", "false"), ("o_custkey", "false"), ("o_orderstatus", "true"), ("o_totalprice", "false"), ("o_orderdate", "true"), ("o_orderpriority", "true"))
        )
    )
    + ", a AS ("
    + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(6))
    + """) SELECT "column", position, n_distinct, is_text OR n_distinct < 20 AS is_categorical,
    is_text OR n_distinct <= 50 AS quasi_candidate, n_distinct <= 10 AS target_candidate FROM a""",
)
def column_roles(spark, sf):
    return role_table(table(spark, sf, "orders")).select(
        "column", "position", "n_distinct", "is_categorical", "quasi_candidate", "target_candidate"
    )


def _role_rows(spark, df, found):
    """One row per column of the roles that were found."""
    rows = [
        (c, is_number(df.schema[c].dataType), c in found.categorical, c in found.numeric, c in found.quasi_identifiers, c in found.protected, c == found.target, is_classification(df, c, found.distinct))
        for c in df.columns
    ]
    names = ("is_number", "is_categorical", "is_numeric", "is_quasi", "is_protected", "is_target", "is_class")
    return spark.createDataFrame(rows, "column string, " + ", ".join(f"{n} boolean" for n in names))


# Customers under names that mark protected attributes.
_PEOPLE = (("c_custkey", "person"), ("c_mktsegment", "Gender"), ("c_acctbal", "average_balance"), ("c_nationkey", "race_code"), ("c_nationkey % 25 + 30", "zone"), ("c_custkey % 7", "rating"))
_PEOPLE_SQL = f"""people AS (SELECT {', '.join(f'{e} AS {n}' for e, n in _PEOPLE)} FROM customer),
  d AS ({' UNION ALL '.join(f"SELECT {i} AS i, '{n}' AS c, count(DISTINCT {n}) AS n, {str(n == 'Gender').lower()} AS t FROM people" for i, (_, n) in enumerate(_PEOPLE))}),
  f AS (SELECT c AS "column", NOT t AS is_number, t OR n < 20 AS is_categorical, NOT t AND n >= 20 AS is_numeric, t OR n <= 50 AS is_quasi,
        regexp_matches(lower(c), 'sex|gender|race|ethnicity|age|religion') AS is_protected, i = (SELECT max(i) FROM d WHERE n <= 10) AS is_target, t OR n <= 10 AS is_class FROM d)"""


def _people(spark, sf):
    return table(spark, sf, "customer").select(*[F.expr(e).alias(n) for e, n in _PEOPLE])


@query("role_inference", f"WITH {_PEOPLE_SQL} SELECT * FROM f")
def role_inference(spark, sf):
    """The roles of all columns, as a user without a schema gets them."""
    people = _people(spark, sf)
    return _role_rows(spark, people, infer_roles(people))


@query("profile_roles", f"WITH {_PEOPLE_SQL} SELECT * FROM f")
def profile_roles(spark, sf):
    """The same roles from a stored profile: two parts, and a third that came later."""
    people = _people(spark, sf)
    path = f"{shared_dir(spark).rstrip('/')}/profile-{uuid.uuid4().hex}"
    for part in (0, 1, 1, 2):  # one part is sent twice
        profiles.add(people.where(F.col("person") % 3 == part), path, str(part))
    return _role_rows(spark, people, profiles.roles(spark, path, people))


@query(
    "profile_facts",
    f"""WITH {_PEOPLE_SQL} {' UNION ALL '.join(f"SELECT '{n}' AS column, count(*) AS n_rows, count(*) - count({n}) AS n_null, {'NULL::DOUBLE' if n == 'Gender' else f'min({n})::DOUBLE'} AS low, {'NULL::DOUBLE' if n == 'Gender' else f'max({n})::DOUBLE'} AS high, true AS distinct_close FROM people" for _, n in _PEOPLE)}""",
)
def profile_facts(spark, sf):
    """Merged counts and ranges; estimates of distinct values within three hundredths."""
    people = _people(spark, sf)
    path = f"{shared_dir(spark).rstrip('/')}/profile-{uuid.uuid4().hex}"
    for part in range(3):
        profiles.add(people.where(F.col("person") % 3 == part), path, str(part))
    exact = distinct_profile(people).select("column", F.col("n_distinct").alias("exact"))
    out = profiles.merged(spark, path).join(exact, "column")
    return out.select("column", "n_rows", "n_null", "low", "high", (F.abs(F.col("n_distinct") - F.col("exact")) <= 0.03 * F.col("exact") + 0.5).alias("distinct_close"))


@query(
    "table_summary",
    """SELECT count(*) AS n_rows, 6 AS n_columns, 2 AS n_categorical, 4 AS n_numeric, 'c_acctbal,c_custkey,c_nationkey' AS common, 'c_mktsegment' AS text_columns FROM customer""",
)
def table_summary(spark, sf):
    """Sizes of a table, the columns it shares with another one, in its own order, and its text columns."""
    df = table(spark, sf, "customer").select("c_acctbal", "c_custkey", "c_mktsegment", "c_nationkey", (F.col("c_custkey") % 3).alias("a"), (F.col("c_custkey") % 4).alias("b"))
    other = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.lit(1).alias("z"))
    one = dataset_summary(df, ["a", "b"])
    numbers = F.lit(len(number_columns(df)) - 1).alias("n_numeric")
    return one.select("n_rows", "n_columns", "n_categorical", numbers, F.lit(",".join(common_columns(df, other))).alias("common"), F.lit(",".join(text_columns(df))).alias("text_columns"))


@query("prep_names", f"WITH {DIRTY_SQL} SELECT {_PLAIN} FROM dirty")
def prep_names(spark, sf):
    return prepare.rename_columns(dirty_orders(spark, sf))


@query("prep_dates", f"WITH {DIRTY_SQL} SELECT {_EXPANDED} FROM dirty")
def prep_dates(spark, sf):
    df = prepare.rename_columns(dirty_orders(spark, sf))
    return prepare.expand_dates(df, prepare.date_columns(df))


@query(
    "prep_dedupe",
    f"WITH {DIRTY_SQL} SELECT (SELECT count(*) FROM dirty) AS n_before, count(*) AS n_after, (SELECT count(*) FROM dirty) - count(*) AS removed FROM (SELECT DISTINCT * FROM dirty)",
)
def prep_dedupe(spark, sf):
    df = dirty_orders(spark, sf)
    counts = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("n_before"), F.count("*").alias("n_after")).withColumn("removed", F.col("n_before") - F.col("n_after"))


@query(
    "prep_null_drop",
    f"WITH {DIRTY_SQL}, d AS (SELECT DISTINCT * FROM dirty), n AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS pct FROM d"
        for c in _PLAIN.split(", ")
    )
    + ') SELECT "column", n_null, round(pct, 4) AS null_percent, pct > 50 AS dropped FROM n',
)
def prep_null_drop(spark, sf):
    out = prepare.null_shares(prepare.rename_columns(dirty_orders(spark, sf)).dropDuplicates())
    return out.withColumn("null_percent", F.round("null_percent", 4))


_FILLED = f"""{_STEPS}, fill AS (SELECT median(total_price) AS m, (SELECT priority FROM ex WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS p FROM ex),
  filled AS (SELECT * EXCLUDE (mostly_empty, total_price, priority), coalesce(total_price, m) AS total_price, coalesce(priority, p) AS priority FROM ex, fill)"""


@query("prep_impute", f"WITH {_FILLED} SELECT order_key, round(total_price, 4) AS total_price, priority FROM filled")
def prep_impute(spark, sf):
    df = prepare.rename_columns(dirty_orders(spark, sf)).dropDuplicates()
    fills = prepare.fill_values(df, ["total_price", "priority"]).collect()
    filled = df.fillna({r["column"]: r["number"] if r["number"] is not None else r["text"] for r in fills})
    return filled.select("order_key", F.round("total_price", 4).alias("total_price"), "priority")


@query(
    "prep_float_to_int",
    f"""WITH {DIRTY_SQL} SELECT 'total_price' AS "column", bool_and(coalesce(total_price = floor(total_price), false)) AS converted FROM dirty
    UNION ALL SELECT 'price_band', bool_and(coalesce(price_band = floor(price_band), false)) FROM dirty""",
)
def prep_float_to_int(spark, sf):
    return prepare.whole_number_columns(prepare.rename_columns(dirty_orders(spark, sf)))


@query(
    "prep_clip",
    "WITH a AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", quantile_cont({c}, 0.01) AS low, quantile_cont({c}, 0.99) AS high FROM lineitem""" for c in SPLIT_NUMBERS
    )
    + ") "
    + " UNION ALL ".join(
        f"""SELECT "column", round(low, 6) AS low, round(high, 6) AS high, (SELECT count(*) FROM lineitem WHERE {c} < low OR {c} > high) AS clipped FROM a WHERE "column" = '{c}'"""
        for c in SPLIT_NUMBERS
    ),
)
def prep_clip(spark, sf):
    out = prepare.clip_ranges(table(spark, sf, "lineitem"), SPLIT_NUMBERS)
    return out.withColumns({"low": round6(F.col("low")), "high": round6(F.col("high"))})


def _clip(c: str) -> str:
    return f"round(least(greatest({c}, quantile_cont({c}, 0.01) OVER ()), quantile_cont({c}, 0.99) OVER ()), 4) AS {c}"


_NUMERIC = ("order_key", "total_price", "price_band", "order_date_year", "order_date_month", "order_date_day", "order_date_dayofweek")


@query("prep_full", f"WITH {_FILLED} SELECT status, priority, {', '.join(_clip(c) for c in _NUMERIC)} FROM filled")
def prep_full(spark, sf):
    df = dirty_orders(spark, sf)
    out, _ = prepare.prepare(df)
    return out.select("status", "priority", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in _NUMERIC])


@query(
    "prep_report",
    f"""WITH {_STEPS}, n AS (SELECT count(*) AS n FROM ex), d AS (SELECT count(*) - (SELECT n FROM n) AS d FROM dirty)
    SELECT 'column_names' AS step, unnest(['order_key', 'total_price', 'mostly_empty', 'order_date', 'price_band']) AS "column", 'renamed' AS action, unnest([' order key ', 'total price', 'mostly empty', 'order date', 'price band']) AS detail
    UNION ALL SELECT 'dates', 'order_date', 'date_expanded', 'order_date_year,order_date_month,order_date_day,order_date_dayofweek'
    UNION ALL SELECT 'duplicates', '*', 'duplicates_removed', CAST(d AS VARCHAR) FROM d
    UNION ALL SELECT 'missing', 'mostly_empty', 'dropped', printf('%.1f%% missing values', (count(*) - count(mostly_empty)) * 100.0 / count(*)) FROM ex
    UNION ALL SELECT 'missing', 'total_price', 'imputed_median', NULL UNION ALL SELECT 'missing', 'priority', 'imputed_mode', (SELECT priority FROM ex WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    UNION ALL SELECT 'types', 'priority', 'converted_to_category', CAST(count(DISTINCT priority) AS VARCHAR) FROM ex UNION ALL SELECT 'types', 'status', 'converted_to_category', CAST(count(DISTINCT status) AS VARCHAR) FROM ex
    UNION ALL SELECT 'types', 'price_band', 'converted_float_to_int', '' UNION ALL SELECT 'outliers', unnest(['price_band', 'total_price', 'order_key']), 'clipped', NULL""",
)
def prep_report(spark, sf):
    """What the preparation did, step by step; the numbers of medians and clip ranges are in the queries of those steps."""
    _, plan = prepare.prepare(dirty_orders(spark, sf))
    numbers = F.col("action").isin("imputed_median", "clipped")
    return plan.report(spark).withColumn("detail", F.when(~numbers, F.col("detail")))


@query(
    "encode_unseen",
    f"""WITH {SPLIT_SQL}, d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT l_returnflag AS v FROM r WHERE l_returnflag <> 'N'))
    SELECT CAST(coalesce(code, 0) AS DOUBLE) AS code, count(*) AS n FROM s LEFT JOIN d ON v = l_returnflag GROUP BY 1""",
)
def encode_unseen(spark, sf):
    """Labels the dictionary has not seen get the code 0."""
    real, synth = lineitem_split(spark, sf)
    codes = encoding.dictionary([real.where("l_returnflag <> 'N'")], ["l_returnflag"])
    out = encoding.encode(synth.select("l_returnflag"), codes, ["l_returnflag"], unseen=0)
    return out.groupBy(F.col("l_returnflag").alias("code")).agg(F.count("*").alias("n"))


@query(
    "restore_types",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice, 6) END AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""",
)
def restore_types(spark, sf):
    """Generated rows of text columns get the real table's types back; what does not fit becomes null."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    texts = orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns])
    broken = texts.withColumn("o_totalprice", F.when(F.col("o_orderkey").cast("bigint") % 5 > 0, F.col("o_totalprice")).otherwise("n/a"))
    out = encoding.restore_types(broken, orders)
    return out.select("o_orderkey", round6(F.col("o_totalprice")).alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


@query(
    "number_coercion",
    """WITH x AS (SELECT o_orderkey % 2 AS side, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 11 = 0 THEN 'NaN' WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_custkey % 100 AS VARCHAR) END AS v FROM orders),
    c AS (SELECT side, CASE WHEN v NOT IN ('unknown', 'NaN', '') THEN CAST(v AS DOUBLE) END AS v FROM x)
    SELECT v AS value, count(*) FILTER (side = 0) AS n_real, count(*) FILTER (side = 1) AS n_synth FROM c WHERE v IS NOT NULL GROUP BY 1""",
)
def number_coercion(spark, sf):
    """Numbers out of a text column; what is no number is missing."""
    key = F.col("o_orderkey")
    text = F.when(key % 7 == 0, "unknown").when(key % 11 == 0, "NaN").when(key % 13 == 0, "").otherwise((F.col("o_custkey") % 100).cast("string")).alias("v")
    orders = table(spark, sf, "orders")
    out = distributions.value_counts(orders.where(key % 2 == 0).select(text), orders.where(key % 2 == 1).select(text), ["v"], "double")
    return out.select("value", "n_real", "n_synth")


@query(
    "favorable_value",
    """SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""",
)
def favorable_value(spark, sf):
    return distributions.modes(table(spark, sf, "orders"), ["o_orderpriority"]).select(F.col("mode").alias("value"), "n")


_CODES = f"""{SPLIT_SQL}, u AS (SELECT * FROM r UNION ALL SELECT * FROM s),
  c AS (SELECT 'l_returnflag' AS "column", l_returnflag AS value FROM u UNION SELECT 'l_linestatus', l_linestatus FROM u UNION SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM u)"""


@query("label_encode", f'WITH {_CODES} SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER) AS code FROM c')
def label_encode(spark, sf):
    return encoding.dictionary(lineitem_split(spark, sf), ["l_returnflag", "l_linestatus", "l_linenumber"]).drop("side")


@query(
    "label_decode",
    f"""WITH {SPLIT_SQL}, d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code, count(*) OVER () - 1 AS last FROM (SELECT DISTINCT l_returnflag AS v FROM r)),
    g AS (SELECT l_quantity, CAST(least(greatest(round_even(l_quantity / 8 - 1.2, 0), 0), (SELECT max(code) FROM d)) AS INTEGER) AS code FROM s)
    SELECT v AS l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total FROM g JOIN d USING (code) GROUP BY 1""",
)
def label_decode(spark, sf):
    real, synth = lineitem_split(spark, sf)
    codes = encoding.dictionary([real], ["l_returnflag"])
    made = synth.select("l_quantity", (F.col("l_quantity") / 8 - 1.2).alias("l_returnflag"))
    out = encoding.decode(made, codes, ["l_returnflag"])
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query(
    "scale",
    f"""WITH {SPLIT_SQL}, f AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_tax) AS c, stddev_pop(l_tax) AS d FROM r)
    SELECT round((l_quantity - a) / b, 6) AS l_quantity, round((l_tax - c) / d, 6) AS l_tax, count(*) AS n FROM s, f GROUP BY 1, 2""",
)
def scale(spark, sf):
    real, synth = lineitem_split(spark, sf)
    out = encoding.standardize(synth, encoding.scale_stats(real, ["l_quantity", "l_tax"]), ["l_quantity", "l_tax"])
    return out.groupBy(round6(F.col("l_quantity")).alias("l_quantity"), round6(F.col("l_tax")).alias("l_tax")).agg(F.count("*").alias("n"))


def fingerprint_sql(source: str, canon: str) -> str:
    """CTE chain ending in ``fp`` (n_rows, n_distinct_rows, data_hash).

    Two leaf depths, chosen by the row count as the operator does.
    """
    out = f"rh AS (SELECT sha256({canon}) AS h, count(*) AS n FROM {source} GROUP BY 1), sz AS (SELECT sum(n) AS t FROM rh)"
    for digits, low, high in ((2, 0, 65536), (4, 65536, 16777216)):
        mark = f"d{digits}"
        out += f""", {mark}k{digits} AS (SELECT left(h, {digits}) AS k, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS d, sum(n) AS m, count(*) AS q
        FROM rh WHERE (SELECT t > {low} AND t <= {high} FROM sz) GROUP BY 1)"""
        while digits:
            up = digits - 2
            out += f""", {mark}k{up} AS (SELECT left(k, {up}) AS k, sha256(string_agg(k || ':' || d, ',' ORDER BY k || ':' || d)) AS d, sum(m) AS m, sum(q) AS q FROM {mark}k{digits} GROUP BY 1)"""
            digits = up
    picks = " UNION ALL ".join(f"SELECT CAST(m AS BIGINT) AS n_rows, CAST(q AS BIGINT) AS n_distinct_rows, d AS data_hash FROM {m}k0" for m in ("d2", "d4"))
    return out + f", fp AS ({picks})"


_ITEM_CANON = canon_sql(
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "d:l_quantity", "d:l_extendedprice", "d:l_discount", "d:l_tax", "l_returnflag", "l_linestatus", "t:l_shipdate"
)
_SPLIT_CANON = canon_sql(*[f"d:{c}" for c in SPLIT_NUMBERS], *SPLIT_COLUMNS[4:])


@query("fingerprint", f"WITH {fingerprint_sql('lineitem', _ITEM_CANON)} SELECT * FROM fp")
def table_fingerprint(spark, sf):
    return fingerprint.fingerprint(table(spark, sf, "lineitem"))


@query(
    "generation_verify",
    f"""WITH {SPLIT_SQL}, {fingerprint_sql('s', _SPLIT_CANON)}
    SELECT 'g1' AS generation_id, true AS verified, data_hash AS expected_hash, data_hash AS actual_hash, n_rows AS num_rows FROM fp
    UNION ALL SELECT 'g2', false, 'tampered', data_hash, n_rows FROM fp""",
)
def generation_verify(spark, sf):
    synth = lineitem_split(spark, sf)[1]
    made = fingerprint.fingerprint(synth)
    log = made.select(F.lit("g1").alias("generation_id"), F.col("data_hash").alias("output_hash"), F.col("n_rows").alias("num_rows"))
    bad = made.select(F.lit("g2").alias("generation_id"), F.lit("tampered").alias("output_hash"), F.col("n_rows").alias("num_rows"))
    return fingerprint.verify_generation(synth, log, "g1").unionByName(fingerprint.verify_generation(synth, bad, "g2"))


@query(
    "generation_summary",
    """WITH l AS (SELECT event_id, user_id % 10 AS generator, ts, CAST(value * 100 AS BIGINT) AS rows, sha256(CAST(event_id AS VARCHAR)) AS h FROM events WHERE event_type = 'signup'),
    k AS (SELECT *, row_number() OVER (PARTITION BY generator ORDER BY ts DESC, substr(h, 1, 16)) AS rn FROM l)
    SELECT generator, count(*) AS total_generations, CAST(sum(rows) AS BIGINT) AS total_rows_generated,
           string_agg(CASE WHEN rn <= 5 THEN substr(h, 1, 16) END, ',' ORDER BY rn) AS latest FROM k GROUP BY 1""",
)
def generation_summary(spark, sf):
    e = table(spark, sf, "events").where(F.col("event_type") == "signup")
    h = F.sha2(F.col("event_id").cast("string"), 256)
    log = e.select(
        (F.col("user_id") % 10).alias("generator"),
        F.substring(h, 1, 16).alias("generation_id"),
        F.col("ts").alias("timestamp"),
        F.round(F.col("value") * 100).cast("bigint").alias("num_rows"),
        h.alias("output_hash"),
    )
    out = generation.generation_summary(log, ["generator"], latest=5)
    return out.select("generator", "total_generations", "total_rows_generated", F.array_join("generations.id", ",").alias("latest"))


@query(
    "short_ids",
    """SELECT event_id, substr(sha256(event_type || ':' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f')), 1, 16) AS short_id,
       round(least(greatest(value / 3, 0), 100), 6) AS clamped FROM events""",
)
def short_ids(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        short_id(F.col("event_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("short_id"),
        round6(clamp(F.col("value") / 3)).alias("clamped"),
    )


@query("row_digests", f"SELECT l_orderkey, l_linenumber, sha256({_ITEM_CANON}) AS digest FROM lineitem")
def row_digests(spark, sf):
    items = table(spark, sf, "lineitem")
    return items.select("l_orderkey", "l_linenumber", row_sha(items).alias("digest"))


@query("sample_bounded", f"WITH {SPLIT_SQL} SELECT {', '.join(SPLIT_COLUMNS)} FROM s ORDER BY md5({_SPLIT_CANON}) LIMIT 1000")
def sample_bounded(spark, sf):
    return sampling.bounded_sample(lineitem_split(spark, sf)[1], 1000)


@query(
    "sample_balanced",
    f"""WITH {SPLIT_SQL}, b AS (SELECT *, 1 AS is_real FROM r UNION ALL SELECT *, 0 FROM s WHERE l_quantity > 30),
    m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM b GROUP BY is_real)),
    k AS (SELECT *, row_number() OVER (PARTITION BY is_real ORDER BY md5({canon_sql(*[f'd:{c}' for c in SPLIT_NUMBERS], *SPLIT_COLUMNS[4:], 'is_real')})) AS rn FROM b)
    SELECT {', '.join(SPLIT_COLUMNS)}, is_real FROM k WHERE rn <= (SELECT n FROM m)""",
)
def sample_balanced(spark, sf):
    real, synth = lineitem_split(spark, sf)
    return sampling.balanced_union(real, synth.where("l_quantity > 30"))


@query(
    "split_stratified",
    f"""WITH {APPLICANT_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5({canon_sql('d:o_totalprice', 'd:c_acctbal', *APPLICANT_COLUMNS[2:])})) AS rn,
      count(*) OVER (PARTITION BY o_orderstatus) AS n FROM r)
    SELECT {', '.join(APPLICANT_COLUMNS)}, rn <= n - CAST(ceil(n * CAST(0.3 AS DOUBLE)) AS BIGINT) AS is_train FROM k""",
)
def split_stratified(spark, sf):
    return sampling.split(applicants(spark, sf)[0], 0.3, ["o_orderstatus"])


@query(
    "strat_bootstrap_counts",
    f"""WITH {APPLICANT_SQL}, g AS (SELECT c_mktsegment, r_name, o_orderstatus, count(*) AS n_source FROM r GROUP BY 1, 2, 3)
    SELECT c_mktsegment, r_name, o_orderstatus, n_source,
           greatest(1, CAST(round_even(n_source * 5000 / CAST((SELECT sum(n_source) FROM g) AS DOUBLE), 0) AS BIGINT)) AS n_target FROM g""",
)
def strat_bootstrap_counts(spark, sf):
    return sampling.stratum_targets(applicants(spark, sf)[0], ["c_mktsegment", "r_name", "o_orderstatus"], 5000)


@query(
    "strat_bootstrap",
    f"""WITH {APPLICANT_SQL}, g AS (SELECT o_orderstatus, count(*) AS n FROM r GROUP BY 1)
    SELECT o_orderstatus, greatest(1, CAST(round_even(n * 20000 / CAST((SELECT sum(n) FROM g) AS DOUBLE), 0) AS BIGINT)) AS n, true AS all_known FROM g""",
)
def strat_bootstrap(spark, sf):
    """Rows drawn per stratum: the counts are exact and every row is a real row."""
    real = applicants(spark, sf)[0]
    targets = sampling.stratum_targets(real, ["o_orderstatus"], 20000)
    made = sampling.bootstrap(real, targets, ["o_orderstatus"])
    both = made.withColumn("made", F.lit(1)).unionByName(real.withColumn("made", F.lit(0)))
    rows = both.groupBy(*APPLICANT_COLUMNS).agg(F.sum("made").alias("n"), F.sum(1 - F.col("made")).alias("known"))
    return rows.groupBy("o_orderstatus").agg(
        F.sum("n").alias("n"), F.bool_and((F.col("n") == 0) | (F.col("known") > 0)).alias("all_known")
    )


_ROW_CANON = canon_sql("d:o_totalprice", "d:c_acctbal", *APPLICANT_COLUMNS[2:])
_STRATA = ("c_mktsegment", "r_name")


def _draw_sql(text: str, size: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) % {size}"


BOOTSTRAP_SQL = f"""{APPLICANT_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, r_name ORDER BY md5({_ROW_CANON})) - 1 AS place, row_number() OVER (ORDER BY md5({_ROW_CANON})) - 1 AS anywhere FROM r),
  g AS (SELECT c_mktsegment, r_name, {canon_sql(*_STRATA)} AS text, count(*) AS n, greatest(1, CAST(round_even(count(*) * 7400 / CAST((SELECT count(*) FROM r) AS DOUBLE), 0) AS BIGINT)) AS target FROM r GROUP BY 1, 2),
  d AS (SELECT c_mktsegment, r_name, {_draw_sql("'42:' || text || ':' || i", 'n')} AS place FROM (SELECT *, unnest(range(1, target + 1)) AS i FROM g)),
  md AS (SELECT {', '.join(f'k.{c}' for c in APPLICANT_COLUMNS)} FROM d JOIN k USING (c_mktsegment, r_name, place)),
  x AS (SELECT {_draw_sql("'43::' || i", '(SELECT count(*) FROM r)')} AS anywhere FROM range(1, CAST(7401 - least(7400, (SELECT sum(target) FROM g)) AS BIGINT)) t(i)),
  al AS (SELECT * FROM md UNION ALL SELECT {', '.join(APPLICANT_COLUMNS)} FROM x JOIN k USING (anywhere))"""


@query("bootstrap_rows", f"WITH {BOOTSTRAP_SQL} SELECT * FROM al ORDER BY md5({_ROW_CANON}) LIMIT 7400")
def bootstrap_rows(spark, sf):
    """Generated rows, stratified by the protected columns, row by row those of the SQL."""
    return sampling.stratified_bootstrap(applicants(spark, sf)[0], 7400, list(_STRATA))


@query(
    "conditional_rows",
    f"""WITH {APPLICANT_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY md5({_ROW_CANON})) - 1 AS place, count(*) OVER () AS n FROM r WHERE o_orderstatus = 'F'),
    d AS (SELECT {_draw_sql("'42::' || i", "(SELECT max(n) FROM k)")} AS place FROM range(1, 3001) t(i))
    SELECT {', '.join(APPLICANT_COLUMNS)} FROM d JOIN k USING (place)""",
)
def conditional_rows(spark, sf):
    return sampling.conditional_rows(applicants(spark, sf)[0], "o_orderstatus", "F", 3000)


def _normal_sql(text: str) -> str:
    bits = "CAST('0x' || substr(md5({0}), {1}, 13) AS BIGINT)"
    return f"sqrt(-2 * ln(({bits.format(text, 1)} + 1) / {2.0**52!r})) * cos(2 * pi() * ({bits.format(text, 14)} / {2.0**52!r}))"


@query(
    "noise_rows",
    f"""WITH {SPLIT_SQL}, k AS (SELECT *, md5({_SPLIT_CANON}) AS h, row_number() OVER (PARTITION BY {', '.join(SPLIT_COLUMNS)}) AS copy FROM r)
    SELECT {', '.join(f"round({c} + {_normal_sql(f"'42:{c}:' || h || ':' || copy")} * 0.1, 6) AS {c}" for c in SPLIT_NUMBERS)}, {', '.join(SPLIT_LABELS)} FROM k""",
)
def noise_rows(spark, sf):
    """The real rows with normal noise on their numbers."""
    out = sampling.gaussian_noise(lineitem_split(spark, sf)[0], SPLIT_NUMBERS, 0.1)
    return out.withColumns({c: round6(F.col(c)) for c in SPLIT_NUMBERS})


@query(
    "marginal_rows",
    f"""WITH {APPLICANT_SQL}, {', '.join(f"""p_{c} AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS place FROM r WHERE {c} IS NOT NULL),
      d_{c} AS (SELECT i, {_draw_sql(f"'42:{c}:' || i", f"(SELECT count(*) FROM p_{c})")} AS place FROM range(1, 5001) t(i))""" for c in APPLICANT_COLUMNS)}
    SELECT {', '.join(APPLICANT_COLUMNS)} FROM range(1, 5001) t(i) {' '.join(f"JOIN (SELECT i, {c} FROM d_{c} JOIN p_{c} USING (place)) USING (i)" for c in APPLICANT_COLUMNS)}""",
)
def marginal_rows(spark, sf):
    """Rows whose columns are drawn one by one from the columns' own distributions."""
    return sampling.marginal_rows(applicants(spark, sf)[0], 5000, APPLICANT_LABELS, APPLICANT_NUMBERS).select(*APPLICANT_COLUMNS)


_QUALITY = f"{DIRTY_SQL}, tot AS (SELECT count(*) AS n FROM dirty)"
_Q_COLUMNS = _PLAIN.split(", ")
_Q_NUM = ("order_key", "total_price", "price_band")
_CQ_SQL = f"""{_QUALITY}, v AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM dirty WHERE {c} IS NOT NULL" for c in _Q_COLUMNS)}),
  vc AS (SELECT c, v, count(*) AS n FROM v GROUP BY 1, 2), vt AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY c) AS DOUBLE) AS p FROM vc),
  cq AS (SELECT c, CAST(sum(n) AS BIGINT) AS n_values, count(*) AS n_distinct,
     CASE WHEN c IN {_Q_NUM} THEN 100.0::DOUBLE WHEN count(*) / CAST(sum(n) AS DOUBLE) < 0.5 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END AS validity,
     CASE WHEN c IN {_Q_NUM} THEN CASE WHEN count(*) > 1 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END
          ELSE coalesce(sum(-p * log2(p)) / nullif(log2(count(*)), 0), 0) * 100 END AS distribution FROM vt GROUP BY 1)"""


@query("quality_columns", f'WITH {_CQ_SQL} SELECT c AS "column", n_values, n_distinct, validity, round(distribution, 4) AS distribution FROM cq')
def quality_columns(spark, sf):
    df = prepare.rename_columns(dirty_orders(spark, sf))
    return quality.column_quality(df, ["priority", "status", "mostly_empty"]).withColumn("distribution", F.round("distribution", 4))


@query(
    "quality_completeness",
    f"WITH {_QUALITY} SELECT round(({' + '.join(f'count({c})' for c in _Q_COLUMNS)}) * 100.0::DOUBLE / (count(*) * {len(_Q_COLUMNS)}), 6) AS completeness FROM dirty",
)
def quality_completeness(spark, sf):
    return quality.completeness(dirty_orders(spark, sf)).select(round6(F.col("completeness")).alias("completeness"))


@query("quality_uniqueness", f"WITH {_QUALITY} SELECT round(count(*) * 100.0::DOUBLE / (SELECT n FROM tot), 6) AS uniqueness FROM (SELECT DISTINCT * FROM dirty)")
def quality_uniqueness(spark, sf):
    return quality.uniqueness(dirty_orders(spark, sf)).select(round6(F.col("uniqueness")).alias("uniqueness"))


SYNTHETIC_ONLY_SQL = f"""WITH {_CQ_SQL}, f AS (SELECT ({' + '.join(f'count({c})' for c in _Q_COLUMNS)}) * 100.0::DOUBLE / (count(*) * {len(_Q_COLUMNS)}) AS c FROM dirty),
    u AS (SELECT count(*) * 100.0::DOUBLE / (SELECT n FROM tot) AS u FROM (SELECT DISTINCT * FROM dirty)),
    a AS (SELECT c, u, (SELECT avg(validity) FROM cq) AS v, (SELECT avg(distribution) FROM cq) AS d FROM f, u),
    s AS (SELECT *, least(100, c * 0.5 + u * 0.5) AS p, least(100, v * 0.5 + d * 0.5) AS t, least(100, d) AS b FROM a),
    o AS (SELECT *, CAST(0.4 AS DOUBLE) * p + CAST(0.35 AS DOUBLE) * t + CAST(0.25 AS DOUBLE) * b AS overall FROM s)
    SELECT round(c, 2) AS completeness, round(u, 2) AS uniqueness, round(v, 2) AS validity, round(d, 2) AS distribution, round(p, 2) AS privacy_score,
           round(t, 2) AS utility_score, round(b, 2) AS bias_score, round(overall, 2) AS overall_score, CASE WHEN overall >= 70 THEN 'approved' ELSE 'rejected' END AS status FROM o"""


@query("synthetic_only_score", SYNTHETIC_ONLY_SQL)
def synthetic_only_score(spark, sf):
    out = quality.synthetic_only(prepare.rename_columns(dirty_orders(spark, sf)), ["priority", "status", "mostly_empty"])
    return out.select(*[F.round(c, 2).alias(c) if c != "status" else c for c in out.columns])
