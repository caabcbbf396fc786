"""Sources: every file format the engine reads, as DataFrames with explicit schemas."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.functions.text import WS, loader_clean, strip, strip_accents
from answerloom.operators.corpus import dedupe_last, keep_titles
from answerloom.operators.index import BM25Index, DenseIndex
from answerloom.operators.reader import VectorEncoder

DUMP = "id string, revid string, url string, title string, text string"
CORPUS = "id string, title string, text string"
SQUAD = (
    "data array<struct<paragraphs: array<struct<context: string, qas: array<struct<"
    "id: string, question: string, answers: array<struct<text: string, answer_start: int>>>>>>>>"
)
QUESTIONS = "_count_ long, data array<struct<id: string, question: string, answer: string>>"
#: Languages whose questions a SQuAD-like file may be in.
ACCENT_LANGUAGES = ("en", "zh", "vi", "de", "fr", "es")


@dataclass(frozen=True)
class Config:
    """Retriever settings, as the JSON configuration has them."""

    retriever: str = "bm25"
    k1: float = 0.9
    b: float = 0.4
    language: str = "vi"
    index_path: str = ""
    top_k: int = 10

    @classmethod
    def read(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        known = {x.name for x in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known})


def file_order() -> Column:
    """Place of a row in its files: by file name, block and place in the block.

    Spark packs the blocks of files into tasks by size, so numbers of rows alone follow
    neither the files' names nor, in a long file, its blocks.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned corpus from JSON lines; of equal ids the last line counts.

    Lines are ordered by the names of their files, then by place.
    """
    rows = spark.read.schema(CORPUS).json(path).select("*", file_order().alias("__at"))
    return dedupe_last(rows, "id", "__at").drop("__at").withColumn("text", loader_clean(F.col("text")))


def read_dump(spark: SparkSession, folder: str) -> DataFrame:
    """All wiki_* files below folder, five fields of each record."""
    return spark.read.schema(DUMP).option("recursiveFileLookup", True).option("pathGlobFilter", "wiki_*").json(folder)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): stripped lines, none empty; ord is their file_order."""
    rows = spark.read.text(path).select(file_order().alias("ord"), strip(F.col("value")).alias("value"))
    return rows.filter("value <> ''")


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Titles, one a line, without disambiguation pages."""
    return keep_titles(spark.read.text(path), "value")


def read_link_edges(spark: SparkSession, path: str) -> DataFrame:
    """(label, link, source_title, place) from tab-separated lines of three fields.

    A line is stripped before it is split, so one with an empty label has two fields
    and is dropped.
    """
    parts = F.split("value", "\t")
    return read_lines(spark, path).filter(F.size(parts) == 3).select(
        parts[0].alias("label"), parts[1].alias("link"), parts[2].alias("source_title"), F.col("ord").alias("place")
    )


#: What parts two entries of a dictionary that is written as one map, by default.
ENTRY_END = '}, "'


def read_link_dictionary(spark: SparkSession, path: str, lines: bool = False, entry_end: str | None = ENTRY_END) -> DataFrame:
    """(label, source_title, link) from one JSON map of maps, or from lines that hold one each.

    A whole map is cut at entry_end, what stands between its entries, wherever the file is
    split: several tasks read one file. A title that ends in the same characters breaks its
    entry, which then raises; with entry_end None the map is read by one task, whatever it
    holds. Lines, which write_link_dictionary gives, are split among tasks as they are.
    """
    if lines or entry_end is None:
        raw = spark.read.text(path, wholetext=not lines)
    else:
        cut = spark.read.option("lineSep", entry_end).text(path).filter(~F.col("value").rlike(rf"^{WS}*\{{?{WS}*\}}?{WS}*$"))
        inner = F.regexp_replace(F.regexp_replace("value", rf'\A{WS}*\{{{WS}*"', ""), rf"\}}{WS}*\}}{WS}*\z", "")
        raw = cut.select(F.concat(F.lit('{"'), inner, F.lit("}}")).alias("value"))
    fail = {"mode": "FAILFAST"}
    outer = raw.select(F.explode(F.from_json("value", "map<string, map<string, string>>", fail)).alias("label", "links"))
    return outer.select("label", F.explode("links").alias("source_title", "link"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, question, answer) of a question batch of one or more files.

    ord counts from 0 through the files in order of their names; only their sizes, one row
    a file, are summed up together.
    """
    rows = spark.read.schema(QUESTIONS).option("multiLine", True).json(path).select("data", F.col("_metadata.file_path").alias("file"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.select("file", F.greatest(F.size("data"), F.lit(0)).alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("before"))
    found = rows.select("file", F.posexplode("data").alias("at", "q")).join(sizes, "file")
    return found.select((F.col("before") + F.col("at")).alias("ord"), "q.id", "q.question", "q.answer")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def flatten_squad(raw: DataFrame) -> DataFrame:
    """(id, question, answers, context) of a nested file: two levels exploded."""
    paragraphs = raw.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    return paragraphs.select(F.col("p.context").alias("context"), F.explode("p.qas").alias("q")).select(
        "q.id", "q.question", F.transform("q.answers", lambda a: a["text"]).alias("answers"), "context"
    )


def read_squad(spark: SparkSession, path: str) -> DataFrame:
    return flatten_squad(spark.read.schema(SQUAD).option("multiLine", True).json(path))


def squad_questions(raw: DataFrame, do_strip_accents: bool = False, language: str = "en") -> DataFrame:
    """(id, question, language) of a nested file."""
    q = flatten_squad(raw).select("id", "question", F.lit(language).alias("language"))
    return q.withColumn("question", strip_accents("question")) if do_strip_accents else q


def read_json_list(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer, short_candidate) of a JSON list."""
    schema = "question string, answer string, short_candidate string"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_index(spark: SparkSession, path: str, kind: str = "bm25", encoder: VectorEncoder | None = None) -> BM25Index | DenseIndex:
    """A written index: bm25 tables, or dpr vectors with their document store and encoder."""
    if kind == "bm25":
        return BM25Index.read(spark, path)
    if kind == "dpr":
        return DenseIndex.read(spark, path, encoder)
    raise ValueError(f"unknown retriever: {kind}")


def read_prebuilt(spark: SparkSession, path: str, kind: str) -> BM25Index:
    """Prebuilt indexes are of the bm25 kind only."""
    if kind != "bm25":
        raise ValueError(f"no prebuilt index for {kind}")
    return BM25Index.read(spark, path)


def read_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)
