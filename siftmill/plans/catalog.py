"""The register of queries, and helpers for the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import WHITE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The day on which ages are taken.
AS_OF = "2026-09-01 00:00:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL if there is one."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def s(value: object) -> str:
    """A literal."""
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def s_has(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({c}, {s(pattern)}), false)"


def s_any(c: str, patterns) -> str:
    return "(" + " OR ".join(s_has(c, p) for p in patterns) + ")"


def s_contains(c: str, words) -> str:
    return "coalesce(" + " OR ".join(f"contains({c}, {s(w)})" for w in words) + ", false)"


def s_in(c: str, values) -> str:
    return f"coalesce({c} IN ({', '.join(map(s, values))}), false)"


def s_lookup(c: str, table: dict, otherwise: str = "NULL") -> str:
    return f"CASE {c} " + " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def s_first(c: str, rules, test: Callable[[str, str], str] = s_has) -> str:
    return "CASE " + " ".join(f"WHEN {test(c, p)} THEN {s(v)}" for p, v in rules) + " END"


def s_ladder(c: str, steps, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN {c} < {b} THEN {s(v)}" for b, v in steps) + f" ELSE {s(otherwise)} END"


ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"


def s_instant(c: str) -> str:
    """Microseconds of an instant's text, UTC unless an offset is given."""
    return rf"CASE WHEN regexp_matches({c}, {s(ISO)}) THEN epoch_us(TRY_CAST(CASE WHEN regexp_matches({c}, '(Z|[+-]\d{{2}}:?\d{{2}})$') THEN {c} ELSE {c} || '+00' END AS TIMESTAMPTZ)) END"


def s_days(c: str) -> str:
    age = f"floor((epoch_us(TIMESTAMP '{AS_OF}') - ({s_instant(c)})) / 86400000000.0)"
    return f"CAST(CASE WHEN {age} IS NULL THEN 9999 ELSE greatest(0, {age}) END AS INT)"


def s_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {s(WHITE)}), lambda x: length(x) > 0)"


def s_normal(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def s_matches(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({c}, {s(pattern)}, {group})"
