"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from answerloom.functions.text import ASCII_PUNCTUATION, WS, Steps
from answerloom.sources.scan import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Tables of texts, where a row makes much work, and the key each is spread by.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str, most: int | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, TEXT_KEYS[name], most) if name in TEXT_KEYS else rows


# Pieces of SQL that several queries share.


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def steps(expr: str, chain: Steps) -> str:
    for pattern, replacement in chain:
        expr = f"regexp_replace({expr}, {text(pattern)}, {text(replacement)}, 'g')"
    return expr


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {text(rf'\A{WS}+|{WS}+\z')}, '', 'g')"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {text(WS + '+')}), lambda w: w <> '')"


def normalized_answer(expr: str) -> str:
    """normalize_answer in SQL, whose word boundary is ASCII: boundaries are marked first."""
    bare = f"regexp_replace(lower({expr}), {text(ASCII_PUNCTUATION)}, '', 'g')"
    marked = f"regexp_replace({bare}, '([^\\p{{L}}\\p{{N}}_])', chr(1) || '\\1' || chr(1), 'g')"
    dropped = f"regexp_replace({marked}, '(^|\\x01)(a|an|the)(\\x01|$)', '\\1 \\3', 'g')"
    return strip(f"regexp_replace(replace({dropped}, chr(1), ''), {text(WS + '+')}, ' ', 'g')")


def contains_any(expr: str, phrases: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {text(p)})" for p in phrases) + ")"


def minmax(value: str, by: str) -> str:
    low, high = f"min({value}) OVER (PARTITION BY {by})", f"max({value}) OVER (PARTITION BY {by})"
    return f"coalesce(({value} - {low}) / nullif({high} - {low}, 0), 0.0)"


def zero_below(value: str) -> str:
    return f"CASE WHEN {value} < 0.1 THEN 0.0 ELSE {value} END"
