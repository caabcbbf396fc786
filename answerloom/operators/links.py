"""Link dictionary, its lookup, and fuzzy title matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from answerloom.functions.text import title_to_link
from answerloom.operators.ranking import broadcast_if_small, top_k
from answerloom.operators.title_pages import closest_by_token
from answerloom.operators.titles import TitleIndex, ranked
from answerloom.sources.shared import written

#: Characters of a token that a join looks titles up by.
KEY = 3
#: Queries that one title meets at a time.
BLOCK = 256


def link_dictionary(titles: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, source_title, link, ord) from titles(title, ord) and edges(label, link, source_title, place).

    Edges that point at a title are kept; of the same (label, source) the last link
    counts at the first place. A label that is itself a title has one entry, to
    itself under the source 'wiki'.
    """
    own = titles.select("title", F.col("ord").alias("title_ord"), title_to_link(F.col("title")).alias("link"))
    met = edges.join(own, "link")
    place = F.struct("title_ord", "place")
    pairs = met.groupBy("label", "source_title").agg(
        F.max_by("link", place).alias("link"), F.min(place).alias("first")
    )
    other = pairs.join(own.select(F.col("title").alias("label")).distinct(), "label", "left_anti").select(
        "label", "source_title", "link", F.col("first.title_ord").alias("ord"), F.col("first.place").alias("place")
    )
    selves = own.groupBy("title").agg(F.max("link").alias("link"), F.min("title_ord").alias("ord")).select(
        F.col("title").alias("label"), F.lit("wiki").alias("source_title"), "link", "ord", _no_place(edges).alias("place")
    )
    return other.union(selves)


def _no_place(edges: DataFrame) -> Column:
    """Place of an entry that comes from no edge: 0, or null where places are no numbers."""
    kind = edges.schema["place"].dataType
    return (F.lit(0) if isinstance(kind, NumericType) else F.lit(None)).cast(kind)


def resolve_links(asked: DataFrame, dictionary: DataFrame, last: bool = False) -> DataFrame:
    """(qid, label, page_title, link): entry of the page, else of 'wiki', else the first.

    last takes the last inserted entry instead of the first. A label meets two entries at
    most, its page's and the one that stands for all others, however many pages have it.
    """
    order = [F.col("ord").desc(), F.col("place").desc()] if last else [F.col("ord").asc(), F.col("place").asc()]
    own = top_k(dictionary.select("label", "source_title", "link", "ord", "place"), ["label", "source_title"], order, 1).drop("rank")
    wiki = F.when(F.col("source_title") == "wiki", 1).otherwise(2)
    other = top_k(own, ["label"], [wiki, *order, F.asc("source_title")], 1).drop("rank")
    entry = F.struct("source_title", "link", "ord", "place").alias("entry")
    mine = own.select("label", F.col("source_title").alias("page_title"), entry.alias("mine"))
    met = asked.join(mine, ["label", "page_title"], "left").join(other.select("label", entry), "label", "left")
    met = met.withColumn("entry", F.coalesce("mine", "entry")).select("qid", "label", "page_title", "entry.*")
    place = F.when(F.col("source_title") == F.col("page_title"), 0).otherwise(wiki)
    return top_k(met, ["qid"], [place, *order, F.asc("source_title")], 1).select("qid", "label", "page_title", "link")


def link_map(dictionary: DataFrame) -> DataFrame:
    """(label, links): each label's map from source title to link."""
    return dictionary.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("source_title", "link"))).alias("links"))


def matched_titles(queries: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, query, title) where a token of the query stands in the lower-cased title, and
    the queries(qid, query) that have all titles as candidates instead.

    Tokens are split at single spaces. A token and a title meet on the token's first
    KEY characters, which any title that holds it holds too, and are then compared: an
    equality join. A query that no title answers has all titles, as does one with an
    empty token, which every title holds.
    """
    token = F.explode(F.array_distinct(F.split(F.lower("query"), " "))).alias("token")
    tokens = queries.select("qid", "query", token).withColumn("key", F.left("token", F.lit(KEY)))
    low = F.lower("title")
    places = F.sequence(F.lit(1), F.length(low))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(KEY)), lambda n: F.transform(places, lambda i: F.substring(low, i, n))))
    keyed = titles.filter(low != "").select("title", low.alias("low"), F.explode(F.array_distinct(pieces)).alias("key"))
    met = (
        keyed.join(broadcast_if_small(tokens.filter("token <> ''")), "key")
        .filter(F.contains("low", F.col("token"))).select("qid", "query", "title").distinct()
    )
    blank = tokens.filter("token = ''").select("qid", "query")
    rest = queries.select("qid", "query").join(met.select("qid").distinct(), "qid", "left_anti")
    return met.join(blank.select("qid").distinct(), "qid", "left_anti"), blank.union(rest).distinct()


def candidate_titles(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """(qid, query, title): every candidate, for queries without a match every title.

    Such queries are packed into blocks and each title meets each block once.
    """
    met, every = matched_titles(queries, titles)
    return met.union(_with_every_title(every, titles))


def _with_every_title(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """(qid, query, title): each title meets each block of at most BLOCK queries."""
    blocks = max(1, -(-queries.count() // BLOCK))
    packed = (
        queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
        .groupBy("block").agg(F.collect_list(F.struct("qid", "query")).alias("asked"))
    )
    rows = titles.select("title", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))
    return rows.join(packed, "block").select("title", F.inline("asked")).select("qid", "query", "title")


def closest_titles(queries: DataFrame, titles: DataFrame, n: int = 1, index: TitleIndex | None = None) -> DataFrame:
    """(qid, title, ratio, rank): the n closest titles of each query, the largest string on ties.

    Titles that hold a token of a query are met in pages, where bounds leave few to be
    compared exactly. Queries that no title answers, or with an empty token, stand against
    all titles and search their index (built here, or one given over the same titles).
    Nothing that could win is left out.
    """
    once = written(titles.filter("title is not null").select("title").distinct())
    tokens = F.array_distinct(F.split(F.lower("query"), " "))
    asked = queries.filter("query is not null").select("qid", "query", tokens.alias("tokens"))
    found = written(closest_by_token(asked.filter(~F.array_contains("tokens", "")), once, n))
    every = asked.join(found.select("qid").distinct(), "qid", "left_anti").select("qid", "query")
    if every.isEmpty():
        return ranked(found, n)
    return ranked(found, n).union((index or TitleIndex.build(once)).closest(every, n))
