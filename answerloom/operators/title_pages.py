"""The closest of the titles that hold a token of a query: pages of titles against blocks of queries.

A query of prose shares some token with most titles of its language, so the pairs are not
rows: a row is a page of titles with a block of queries, however many of them meet. For
each query the bounds of a whole page are formed at once in arrays, and only titles whose
bound reaches the best ratio found so far are looked at one by one.

Two bounds hold for the characters M in matching blocks. M is no more than the longest
common subsequence. And where the matcher leaves out a long query's frequent characters,
as it does from 200 characters on, every block lies in a common run around one of the
others or in the common start of both, the one place that a run is tried without such a
character. M is then no more than the characters of the title that such runs cover.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.operators.ranking import broadcast_if_small, top_k
from answerloom.operators.titles import EPS
from answerloom.sources.scan import even_out

#: Titles of a page and queries of a block.
PAGE, BLOCK = 1024, 64
#: One page in so many is searched first, for the floor of each query.
SEED = 16
#: Floors that a task remembers.
FLOORS = 100_000
#: Stand for the end of a title and both ends of a query; no characters.
END_TITLE, END_QUERY = 0xFFFFFFFF, 0xFFFFFFFE


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class TitlePage:
    """Titles one after the other in one array, with the places of each character."""

    def __init__(self, titles: list[str]) -> None:
        self.titles = titles
        self.lengths = np.array([len(t) for t in titles])
        ends = np.cumsum(self.lengths + 1)
        self.starts = ends - self.lengths - 1
        self.flat = np.full(ends[-1], END_TITLE, dtype=np.uint32)
        used = np.ones(ends[-1], dtype=bool)
        used[ends - 1] = False
        self.flat[used] = _codes("".join(titles))
        # The bits of a title lie in words of 64, whose subsequences add up to a bound.
        words = np.maximum(1, -(-self.lengths // 64))
        self.first_word = np.cumsum(words) - words
        self.words = int(words.sum())
        owner = np.repeat(np.arange(len(titles)), self.lengths + 1)
        place = np.arange(ends[-1]) - self.starts[owner]
        word, bit = self.first_word[owner] + place // 64, np.uint64(1) << (place % 64).astype(np.uint64)
        self.places: dict[int, np.ndarray] = {}
        self.bits: dict[int, np.ndarray] = {}
        order = np.flatnonzero(used)
        order = order[np.argsort(self.flat[order], kind="stable")]
        found, begins = np.unique(self.flat[order], return_index=True)
        for code, at in zip(found.tolist(), np.split(order, begins[1:]), strict=True) if len(found) else ():
            self.places[code] = at
            self.bits[code] = bits = np.zeros(self.words, dtype=np.uint64)
            np.bitwise_or.at(bits, word[at], bit[at])
        self.full = np.zeros(self.words, dtype=np.uint64)
        np.bitwise_or.at(self.full, word[used], bit[used])

    def subsequences(self, query: str) -> np.ndarray:
        """Of each title an upper bound of its longest common subsequence with the query, exact up to 64 characters."""
        row, met, sums = self.full.copy(), np.empty_like(self.full), np.empty_like(self.full)
        for code in _codes(query).tolist():
            bits = self.bits.get(code)
            if bits is not None:
                np.bitwise_and(row, bits, out=met)
                np.add(row, met, out=sums)
                np.subtract(row, met, out=row)
                np.bitwise_or(row, sums, out=row)
        left = np.bitwise_count(row & self.full).astype(np.int64)
        return self.lengths - np.add.reduceat(left, self.first_word)

    def covered(self, query: str, rare: dict[str, list[int]]) -> np.ndarray:
        """Of each title the characters in its common start with the query and in its common
        runs around one of the rare characters.

        rare has each character's places in the query, which is not empty.
        """
        asked = np.concatenate([[END_QUERY], _codes(query), [END_QUERY]]).astype(np.uint32)
        at = [self.starts[self.flat[self.starts] == asked[1]]]
        to = [np.zeros(len(at[0]), dtype=np.int64)]
        for char, spots in rare.items():
            places = self.places.get(ord(char))
            if places is not None:
                at.append(np.tile(places, len(spots)))
                to.append(np.repeat(np.array(spots), len(places)))
        at, to = np.concatenate(at), np.concatenate(to) + 1
        size = len(self.flat) + 1
        after = np.bincount(at + self._run(at, to, asked, 1) + 1, minlength=size)
        runs = np.bincount(at - self._run(at, to, asked, -1), minlength=size) - after
        return np.add.reduceat((np.cumsum(runs)[:-1] > 0).astype(np.int64), self.starts)

    def _run(self, at: np.ndarray, to: np.ndarray, asked: np.ndarray, step: int) -> np.ndarray:
        """How many characters beyond each pair of places are equal, one way."""
        out, on, d = np.zeros(len(at), dtype=np.int64), np.arange(len(at)), step
        while len(on):
            # Before the first title stands the last one's end.
            on = on[self.flat[at[on] + d] == asked[to[on] + d]]
            out[on] += 1
            d += step
        return out

    def bounds(self, query: str) -> np.ndarray:
        """Of each title an upper bound of its matching ratio with the query."""
        m = matcher(query)
        shared = self.covered(query, m.b2j) if m.bpopular else self.subsequences(query)
        return 2.0 * shared / np.maximum(1, self.lengths + len(query))


@lru_cache(maxsize=1024)
def matcher(query: str) -> difflib.SequenceMatcher:
    """A matcher whose second sequence, the query, is analysed once for all titles."""
    return difflib.SequenceMatcher(None, "", query)


def closest_on_page(
    page: TitlePage, lows: list[str], query: str, tokens: list[str], floor: float, n: int
) -> list[tuple[float, str]]:
    """(ratio, title) of the n closest titles, by ratio and then title, of those whose
    lower-cased form holds a token and whose ratio reaches the floor."""
    bounds, best = page.bounds(query), []
    reach = np.flatnonzero(bounds >= floor - EPS)
    for i in reach[np.argsort(-bounds[reach], kind="stable")].tolist():
        if bounds[i] < floor - EPS:
            break
        if any(t in lows[i] for t in tokens):
            m = matcher(query)
            m.set_seq1(page.titles[i])
            best = sorted([*best, (m.ratio(), page.titles[i])], reverse=True)[:n]
            if len(best) == n:
                floor = max(floor, best[-1][0])
    return best


def _search(rows: DataFrame, n: int) -> DataFrame:
    """(qid, query, title, ratio) from rows(page, titles, lows, qids, queries, tokens, floors)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, page, floors = None, None, {}
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.page != held:
                    held, page, lows = row.page, TitlePage(list(row.titles)), list(row.lows)
                if len(floors) > FLOORS:
                    floors.clear()
                for qid, query, tokens, given in zip(row.qids, row.queries, row.tokens, row.floors, strict=True):
                    floor = max(given, floors.get(qid, -1.0))
                    best = closest_on_page(page, lows, query, list(tokens), floor, n)
                    if len(best) == n:
                        floors[qid] = max(floor, best[-1][0])
                    out += [(qid, query, title, ratio) for ratio, title in best]
            yield pd.DataFrame(out, columns=["qid", "query", "title", "ratio"])

    kind = rows.schema["qids"].dataType.elementType.simpleString()
    return rows.mapInPandas(run, f"qid {kind}, query string, title string, ratio double")


def closest_by_token(asked: DataFrame, titles: DataFrame, n: int = 1) -> DataFrame:
    """(qid, query, title, ratio): the n closest titles, and more, of the titles that hold a token of the query.

    asked(qid, query, tokens), titles(title) each once, in a table that is cheap to read.
    The ratios are exact, and a query without a row has no title that holds a token of it.
    """
    pages = max(1, -(-titles.count() // PAGE))
    page = F.pmod(F.xxhash64("title"), F.lit(pages)).alias("page")
    dealt = even_out(titles.select(page, "title", F.lower("title").alias("low")), "page")
    both = dealt.groupBy("page").agg(F.collect_list(F.struct("title", "low")).alias("rows"))
    paged = both.select("page", F.col("rows.title").alias("titles"), F.col("rows.low").alias("lows"))
    blocks = max(1, -(-asked.count() // BLOCK))

    def met(paged: DataFrame, floored: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block")
        one = F.struct("qid", "query", "tokens", F.coalesce("floor", F.lit(-1.0)).alias("floor"))
        packed = floored.groupBy(block).agg(F.collect_list(one).alias("asked")).select(
            F.col("asked.qid").alias("qids"), F.col("asked.query").alias("queries"),
            F.col("asked.tokens").alias("tokens"), F.col("asked.floor").alias("floors"),
        )
        return _search(paged.crossJoin(broadcast_if_small(packed, bound=asked)), n)

    if pages < SEED:
        return met(paged, asked.withColumn("floor", F.lit(-1.0)))
    seed = met(paged.filter(F.col("page") < pages // SEED), asked.withColumn("floor", F.lit(-1.0)))
    nth = top_k(seed, ["qid"], [F.desc("ratio"), F.desc("title")], n).filter(F.col("rank") == n)
    floored = asked.join(nth.select("qid", F.col("ratio").alias("floor")), "qid", "left")
    return met(paged, floored)
