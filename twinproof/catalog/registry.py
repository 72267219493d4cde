"""Registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is checked by tests on small fixtures."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@contextmanager
def limits(module: ModuleType, **values: object) -> Iterator[None]:
    """Size limits of a module while plans are built, to take the paths of large tables."""
    before = {k: getattr(module, k) for k in values}
    for k, v in values.items():
        setattr(module, k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            setattr(module, k, v)


def large(name: str, *settings: tuple[ModuleType, dict[str, object]]) -> None:
    """Register ``<name>_large``: the same query by the paths of large tables, against the same SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with ExitStack() as stack:
            for module, values in settings:
                stack.enter_context(limits(module, **values))
            return QUERIES[name](spark, sf_dir)

    query(f"{name}_large", ORACLES[name])(run)


def exact_sql(name: str) -> str:
    """DuckDB text of a double's exact value, as ``scalar.exact_number`` gives it."""
    step, size = f"CAST({2**52} AS DOUBLE)", f"abs({name})"
    one = f"(({size} - floor({size})) * {step})"
    limbs = [f"CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)" for x in (size, one, f"({one} - floor({one})) * {step}")]
    text = f"CASE WHEN {name} < 0 THEN '-' ELSE '' END || {' || chr(58) || '.join(limbs)}"
    return f"CASE WHEN {size} < {2.0**62!r} AND ({name} = 0 OR {size} >= {2.0**-52!r}) THEN {text} ELSE CAST({name} AS VARCHAR) END"


def canon_sql(*columns: str) -> str:
    """DuckDB text of the canonical row; ``d:`` marks doubles, ``t:`` timestamps."""
    parts = []
    for c in columns:
        kind, _, name = c.rpartition(":")
        if kind == "d":
            text = exact_sql(f"CAST({name} AS DOUBLE)")
        elif kind == "t":
            text = f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')"
        else:
            text = f"CASE WHEN typeof({name}) = 'VARCHAR' THEN length(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR) ELSE CAST({name} AS VARCHAR) END"
        parts.append(f"coalesce({text}, '\\N')")
    return f"concat_ws(chr(31), {', '.join(parts)})"
