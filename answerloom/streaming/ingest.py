"""Arriving documents as a stream: cut into passages, indexed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from answerloom.functions.text import to_passages
from answerloom.operators.index import analyze


def stream_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, at, passage) of a streaming or static table; stateless."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(to_passages(F.col(text))).alias("at", "passage"))


def stream_term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl) of each arriving document; postings need no state."""
    terms = docs.select(F.col(doc_id).alias("doc_id"), analyze(F.col(text)).alias("terms"))
    counted = F.transform(
        F.array_distinct("terms"),
        lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).cast("long").alias("tf")),
    )
    return terms.select("doc_id", F.size("terms").cast("long").alias("dl"), F.inline(counted)).select("doc_id", "term", "tf", "dl")


def write_postings(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the postings of arriving documents to Parquet, exactly once."""
    return (
        stream_term_counts(docs).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
