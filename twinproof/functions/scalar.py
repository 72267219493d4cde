"""Scalar column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\u001f"
NULL_TEXT = "\\N"
DIGITS = 6


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def ratio(numerator: Column, denominator: Column, otherwise: float | None = 0.0) -> Column:
    """Double division that gives ``otherwise`` for a zero or null denominator."""
    value = numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    return value if otherwise is None else F.coalesce(value, F.lit(float(otherwise)))


def round6(value: Column) -> Column:
    return F.round(value, DIGITS)


def weighted_score(privacy: Column, utility: Column, fairness: Column) -> Column:
    """Trust score: 40 % privacy, 35 % utility, 25 % fairness."""
    return 0.4 * privacy + 0.35 * utility + 0.25 * fairness


def exact_number(c: Column) -> Column:
    """A double's value as text, without rounding and the same in any engine.

    The magnitude is its whole part and two binary fractions of 52 bits each,
    all exact in double arithmetic. Magnitudes outside 2^-52 to 2^62 keep the
    engine's own round-trip notation.
    """
    step, size = float(2**52), F.abs(c)
    one = (size - F.floor(size)) * step
    limbs = [F.floor(size), F.floor(one), F.floor((one - F.floor(one)) * step)]
    text = F.concat(F.when(c < 0, "-").otherwise(""), F.concat_ws(":", *[x.cast("string") for x in limbs]))
    usual = (size < float(2**62)) & ((size == 0) | (size >= 2.0**-52))
    return F.when(usual, text).otherwise(c.cast("string"))


def canonical_text(field: T.StructField) -> Column:
    """Engine-independent text of one column, used under every hash.

    Nothing is rounded. Texts carry their length, so no separator or null
    mark inside a value can pass for the end of a field.
    """
    c = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = exact_number(c.cast("double"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.BinaryType):
        text = F.base64(c)
    elif isinstance(kind, (T.ArrayType, T.StructType)):
        text = measured(F.to_json(c))
    elif isinstance(kind, T.MapType):
        text = measured(F.to_json(F.array_sort(F.map_entries(c))))
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        text = measured(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(NULL_TEXT))


def measured(text: Column) -> Column:
    return F.concat(F.length(text).cast("string"), F.lit(":"), text)


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Canonical text of a whole row, columns in the given (or schema) order."""
    names = list(columns) if columns is not None else df.columns
    return F.concat_ws(SEPARATOR, *[canonical_text(df.schema[n]) for n in names])


def row_md5(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """Deterministic order key: a pseudo-random but repeatable row order."""
    return F.md5(row_text(df, columns))


def row_sha(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    return F.sha2(row_text(df, columns), 256)


def short_id(*parts: Column) -> Column:
    """16-hex identifier of the given parts (time, if wanted, is one of them)."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)


def sorted_json(**fields: Column) -> Column:
    """JSON text with keys in ascending order, for hashing and reports."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def efficacy_score(efficacy_ratio: Column) -> Column:
    """100 from the full baseline up, else share of the 70 % requirement."""
    return F.when(efficacy_ratio >= 1, F.lit(100.0)).otherwise(F.least(F.lit(100.0), efficacy_ratio * 100 / 0.7))


def attack_score(accuracy: Column) -> Column:
    """100 for a coin-flip attacker, 0 for a perfect (or perfectly wrong) one."""
    return F.greatest(F.lit(0.0), 100 - F.abs(accuracy - 0.5) * 200)


def disclosure_score(mean_tv: Column) -> Column:
    """70 when suspiciously close, 100 in the 0.05..0.3 band, falling beyond."""
    return (
        F.when(mean_tv < 0.05, F.lit(70.0))
        .when(mean_tv > 0.3, F.greatest(F.lit(0.0), 100 - (mean_tv - 0.3) * 200))
        .otherwise(F.lit(100.0))
    )


def steep_score(distance: Column) -> Column:
    """max(0, 100 - 500 d): the fairness and correlation distance scores."""
    return F.greatest(F.lit(0.0), 100 - distance * 500)


def abs_log(value: Column) -> Column:
    """Natural log of the magnitude, safe at zero."""
    return F.log(F.abs(value) + 1e-10)
