"""Readers and encoders are pluggable; deterministic lexical ones stand in for models."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.text import answer_cleanup, strip, words
from answerloom.operators.ranking import DIGITS
from answerloom.operators.vectors import bag_cosine, cosine


class Reader(Protocol):
    """Adds answer, reader_raw, start and end to rows with question and passage, all at once.

    start and end are the characters of the passage that the answer was taken from,
    end beyond the last; both null where there is no answer.
    """

    def predict(self, rows: DataFrame) -> DataFrame: ...


class Encoder(Protocol):
    """Adds column name: the similarity of two text columns."""

    def similarity(self, rows: DataFrame, a: str, b: str, name: str) -> DataFrame: ...


class VectorEncoder(Protocol):
    """Adds column name, array<double>: the vector of a text column."""

    def encode(self, rows: DataFrame, text: str, name: str) -> DataFrame: ...


#: What a loaded model does: questions and passages in, (answer, score, start, end) out.
Answers = Callable[[list[str], list[str]], list[tuple[str, float, int, int]]]
Vectors = Callable[[list[str]], list[list[float]]]


@functools.lru_cache(maxsize=4)
def _loaded(load: Callable[[], object]) -> object:
    """A model, loaded once in each worker process."""
    return load()


@dataclass(frozen=True)
class BatchedReader:
    """A model as a Reader: load gives its function, called with a batch at a time.

    load must be picklable and find its weights where every executor can read them.
    """

    load: Callable[[], Answers]
    batch: int = 64

    def predict(self, rows: DataFrame) -> DataFrame:
        load, size = self.load, self.batch

        @F.pandas_udf("struct<answer: string, score: double, start: long, end: long>")
        def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            model = _loaded(load)
            for questions, passages in batches:
                q, p, out = questions.fillna("").tolist(), passages.fillna("").tolist(), []
                for i in range(0, len(q), size):
                    out += model(q[i : i + size], p[i : i + size])
                yield pd.DataFrame(out, columns=["answer", "score", "start", "end"])

        got = rows.withColumn("__r", read(F.col("question"), F.col("passage")))
        return got.withColumns(
            {
                "answer": strip(answer_cleanup(F.col("__r.answer"))), "reader_raw": F.round("__r.score", DIGITS),
                "start": F.col("__r.start"), "end": F.col("__r.end"),
            }
        ).drop("__r")


@dataclass(frozen=True)
class BatchedEncoder:
    """A sentence model as a VectorEncoder, and as an Encoder by the cosine of its vectors."""

    load: Callable[[], Vectors]
    batch: int = 64

    def encode(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        load, size = self.load, self.batch

        @F.pandas_udf("array<double>")
        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = _loaded(load)
            for s in batches:
                t, out = s.fillna("").tolist(), []
                for i in range(0, len(t), size):
                    out += model(t[i : i + size])
                yield pd.Series(out, dtype=object)

        return rows.withColumn(name, encoded(F.col(text)))

    def similarity(self, rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
        met = self.encode(self.encode(rows, a, "__a"), b, "__b")
        return met.withColumn(name, cosine(F.col("__a"), F.col("__b"))).drop("__a", "__b")


@dataclass(frozen=True)
class HashingEncoder:
    """Counts of lower-cased words, hashed to `dimensions` places: a VectorEncoder without a model."""

    dimensions: int = 256

    def encode(self, rows: DataFrame, text: str, name: str) -> DataFrame:
        places = F.transform(words(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.pmod(F.xxhash64(w), F.lit(self.dimensions)))
        staged = rows.withColumn("__at", F.array_sort(places))
        count = lambda k: F.size(F.filter("__at", lambda p: p == k)).cast("double")
        return staged.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(self.dimensions - 1)), count)).drop("__at")


#: Readers and encoders by name; a model registers what it needs and is then found by its name.
READERS: dict[str, Callable[..., Reader]] = {}
ENCODERS: dict[str, Callable[..., Encoder]] = {}


def reader_of(name: str = "lexical", **settings: object) -> Reader:
    return _provided(READERS, name, settings)


def encoder_of(name: str = "bag", **settings: object) -> Encoder:
    return _provided(ENCODERS, name, settings)


def _provided(kinds: dict, name: str, settings: dict[str, object]):
    if name not in kinds:
        raise ValueError(f"no provider {name}; known: {', '.join(sorted(kinds))}")
    return kinds[name](**settings)


class LexicalReader:
    """Answers with the longest capitalised word that the question doesn't have.

    The earliest of equally long words is taken; the score is the share of the
    question's words found in the passage. It claims no answer quality: a model is
    plugged in with the same method, as a batched function per partition.
    """

    def predict(self, rows: DataFrame) -> DataFrame:
        # Columns of their own, so that functions over words read arrays ready made.
        staged = rows.withColumns(
            {
                "__asked": words(F.lower("question")),
                "__given": words(F.col("passage")),
                "__low": words(F.lower("passage")),
            }
        )
        # A negative place makes the earliest of equals the greatest.
        sized = F.transform(
            "__given", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at"), w.alias("word"))
        )
        named = F.filter(
            sized, lambda x: x["word"].rlike(r"^\p{Lu}") & ~F.array_contains("__asked", F.lower(x["word"]))
        )
        shared = F.size(F.array_intersect("__asked", "__low"))
        raw = F.coalesce(F.try_divide(shared, F.size(F.array_distinct("__asked"))), F.lit(0.0))
        staged = staged.withColumns(
            {
                "answer": strip(answer_cleanup(F.coalesce(F.array_max(named)["word"], F.lit("")))),
                "reader_raw": F.round(raw, DIGITS),
                "__word": F.array_max(named)["word"],
            }
        )
        start = F.position(F.col("__word"), F.col("passage")).cast("long") - 1  # its first place
        placed = staged.withColumn("start", F.when(F.col("__word").isNotNull(), start))
        return placed.withColumn("end", F.col("start") + F.length("__word")).drop("__asked", "__given", "__low", "__word")


class BagEncoder:
    """Cosine of lower-cased bags of words."""

    def similarity(self, rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
        staged = rows.withColumns({"__a": words(F.lower(a)), "__b": words(F.lower(b))})
        return staged.withColumn(name, bag_cosine(F.col("__a"), F.col("__b"))).drop("__a", "__b")


READERS |= {"lexical": LexicalReader, "batched": BatchedReader}
ENCODERS |= {"bag": BagEncoder, "batched": BatchedEncoder}
