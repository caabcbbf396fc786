"""From hits to contexts, whatever retriever the hits came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.functions.text import json_contents


def with_contents(hits: DataFrame, store: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits with the raw text of a document store; hits it doesn't have are dropped."""
    return hits.join(store.select(key, "raw"), key)


def hit_contexts(hits: DataFrame, blacklist: Sequence[str] = ()) -> DataFrame:
    """(qid, title, text, score) from hits with raw text or JSON contents.

    Contexts that hold a blacklisted string are left out.
    """
    out = hits.withColumn("text", json_contents(F.col("raw")))
    for word in blacklist:
        out = out.filter(~F.col("text").contains(word))
    return out.select("qid", F.col("doc_id").alias("title"), "text", "score")


def link_position_map(positions: DataFrame) -> DataFrame:
    """(title, lines): map from line to the map of its links' (start, end).

    positions(title, line, links) as links_and_positions finds them. The map of a
    title holds its own lines only. Of a link that occurs twice in a line the last place
    counts; of a line given twice for a title the larger list of links, compared in order.
    """
    place = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    pairs = F.transform("links", lambda x: F.struct(x["link"].alias("link"), place(x).alias("place")))
    rows = positions.select("title", F.col("line").cast("string").alias("line"), pairs.alias("pairs"))
    given = rows.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("line", "pairs"))).alias("given"))
    found = lambda x: F.struct(x["line"].alias("line"), F.map_from_entries(last_of(x["pairs"], "link")).alias("found"))
    return given.select("title", F.map_from_entries(F.transform(last_of(F.col("given"), "line"), found)).alias("lines"))


def last_of(entries: Column, key: str) -> Column:
    """Entries whose key, never null, no later entry has."""
    keys = F.reverse(F.transform(entries, lambda x: x[key]))
    return F.filter(entries, lambda x, i: F.array_position(keys, x[key]) == F.size(entries) - i)
