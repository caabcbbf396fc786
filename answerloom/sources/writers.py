"""Sinks. All write through the file commit protocol: whole or not at all."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.operators.evaluate import NBest
from answerloom.operators.index import BM25Index
from answerloom.operators.links import link_map
from answerloom.sources.shared import numbered


def write_jsonl(df: DataFrame, path: str, ascii: bool = False) -> None:
    """JSON lines; ascii writes other characters as code points."""
    df.write.option("writeNonAsciiCharacterAsCodePoint", ascii).json(path)


def json_document(items: DataFrame, head: str, tail: str) -> DataFrame:
    """(part, ord, value): the lines of one JSON document around items(ord, value).

    ord tells one item from another. Items are separated by commas; sorted by part and
    ord the lines are the document, and no task or row holds more of it than a line.
    """
    first = F.broadcast(items.agg(F.min("ord").alias("first")))  # one row
    lines = items.join(first).select(
        F.lit(1).alias("part"), "ord", F.when(F.col("ord") == F.col("first"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value")
    )
    none = F.lit(None).cast(items.schema["ord"].dataType)
    ends = items.sparkSession.createDataFrame([(0, head), (2, tail)], "part int, value string").select("part", none.alias("ord"), "value")
    return lines.union(ends)


def write_json_document(items: DataFrame, head: str, tail: str, path: str) -> None:
    """The document as text files; put together in the order of their names, they are it."""
    json_document(items, head, tail).orderBy("part", "ord").select("value").write.text(path)


def write_json_array(df: DataFrame, path: str, ord: str = "ord") -> None:
    """Rows, without ord, as one JSON array in order."""
    rest = [c for c in df.columns if c != ord]
    write_json_document(df.select(F.col(ord).alias("ord"), F.to_json(F.struct(*rest)).alias("value")), "[", "]", path)


def json_name(c: Column) -> Column:
    """A string as the name of a JSON member, with its colon."""
    quoted = F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("k"))), r'(?s)\A\{"k":(.*)\}\z', 1)
    return F.concat(quoted, F.lit(": "))


def write_json_map(rows: DataFrame, path: str) -> None:
    """One JSON object from rows(name, value), value being JSON, in order of names."""
    members = rows.select(F.col("name").alias("ord"), F.concat(json_name(F.col("name")), "value").alias("value"))
    write_json_document(members, "{", "}", path)


def write_predictions(got: NBest, path: str, scored: bool = True) -> None:
    """Below path the maps by question: predictions, nbest, and null_odds where there are any.

    A prediction is [text, score], or the text alone without scored. A question's n best
    are in order of rank; they are as few as the n asked for.
    """
    text = F.to_json(F.array("text"))
    pair = F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(", "), F.col("score").cast("string"), F.lit("]"))
    alone = F.substr(text, F.lit(2), F.length(text) - 2)
    write_json_map(got.predictions.select(F.col("qid").alias("name"), (pair if scored else alone).alias("value")), f"{path}/predictions")
    fields = F.struct("text", "probability", "start_logit", "end_logit").alias("x")
    ranked = got.nbest.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", fields))).alias("rows"))
    listed = F.to_json(F.transform("rows", lambda r: r["x"]))
    write_json_map(ranked.select(F.col("qid").alias("name"), listed.alias("value")), f"{path}/nbest")
    if got.null_odds is not None:
        odds = got.null_odds.filter("null_odds is not null")
        write_json_map(odds.select(F.col("qid").alias("name"), F.col("null_odds").cast("string").alias("value")), f"{path}/null_odds")


def write_titles(titles: DataFrame, path: str) -> None:
    titles.select("title").write.text(path)


def write_link_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws("\t", "label", "link", "source_title").alias("value")).write.text(path)


def write_link_dictionary(dictionary: DataFrame, path: str) -> None:
    """One JSON map a label; the flat table is the Parquet form."""
    link_map(dictionary).select(F.to_json(F.create_map("label", "links")).alias("value")).write.text(path)


def write_labels(dictionary: DataFrame, path: str) -> None:
    dictionary.select("label").distinct().write.text(path)


def write_chunks(docs: DataFrame, path: str, rows: int | None = None, parts: int = 20, by: Sequence[str] = ()) -> None:
    """JSON lines in the order of the columns by, or as partitions hold them, one file in a folder chunk=K for every `rows` rows, 0 first.

    Without rows, a parts-th of all rows, rounded down: parts files, and one or more of what
    is left over; of fewer rows than parts each has a file. A file is one task, so `rows`
    should be what a task can write.
    """
    listed = numbered(docs, by)
    n = rows or max(1, listed.count() // parts)
    chunk = F.floor((F.col("ord") - 1) / n).alias("chunk")
    dealt = listed.select(chunk, "ord", *docs.columns).repartition(F.col("chunk")).sortWithinPartitions("chunk", "ord")
    dealt.drop("ord").write.partitionBy("chunk").json(path)


def write_index(index: BM25Index, path: str, buckets: int = 200) -> None:
    index.write(path, buckets)


def write_results(results: DataFrame, path: str) -> None:
    results.select("question", "truth", "answer").write.json(path)


def submission(answers: DataFrame) -> DataFrame:
    """Lines, as of json_document, of {data: [{id, question, answer}]} in order of ord; null answers are null."""
    item = F.struct(F.col("id").cast("string").alias("id"), "question", F.col("answer").cast("string").alias("answer"))
    return json_document(answers.select("ord", F.to_json(item, {"ignoreNullFields": "false"}).alias("value")), '{"data": [', "]}")


def write_submission(answers: DataFrame, path: str) -> None:
    """One JSON document, as write_json_document writes it."""
    submission(answers).orderBy("part", "ord").select("value").write.text(path)


def write_latency(latencies: DataFrame, path: str) -> None:
    latencies.write.option("header", False).csv(path)


def write_categories(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_classifier(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def log_to(path: str, name: str = "answerloom") -> logging.Logger:
    """A driver-side logger to a file and the console."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    for h in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler()):
        h.setFormatter(form)
        log.addHandler(h)
    return log
