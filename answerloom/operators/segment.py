"""Word segmentation: longest matches of a lexicon, corrected by a ripple-down rule tree.

A word is tagged B where it begins a unit and I where it continues one. The first tags
follow from the longest lexicon entries, found from left to right. A rule file then has a
rule a line, ``condition : object.conclusion = "tag"``, indented by one tab per level of
exception. A token's tag is the conclusion of the deepest rule reached by taking, at each
level, the first exception whose condition holds. Conditions read the lower-cased words
and the first tags of up to two neighbours (any distance in one digit); beyond either end
both are empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from answerloom.functions.ngrams import gram_list
from answerloom.sources.shared import written

ATOM = re.compile(r'object\.(\w+) == "([^"]*)"')
CONCLUSION = re.compile(r'object\.conclusion = "([^"]*)"')
FEATURE = re.compile(r"(prev|next)?(word|tag)([0-9]?)", re.IGNORECASE)
#: A word: letters, marks and digits, or one other character.
WORD = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]"
#: A lexicon travels to the tasks up to these entries and bytes; a larger one is joined.
MOST_ENTRIES, MOST_BYTES = 200_000, 16 << 20

#: Bytes of frequent words up to which sequences are counted by the words' numbers, and the words so counted at once.
MOST_VOCABULARY, COUNTED_WORDS = 64 << 20, 1 << 20
LETTERS = r"^[\p{L}\p{M}\p{N}]+$"

Atom = tuple[int, str, str]


@dataclass
class Rule:
    """atoms: (offset, 'word' or 'tag', value), all of which must hold."""

    atoms: list[Atom]
    tag: str
    exceptions: list[Rule] = field(default_factory=list)


@dataclass
class Node:
    """A rule whose exceptions are looked up by one atom each, a word's where there is one.

    tables: (offset, kind, value -> (order, other atoms, node) in order) for each feature
    that exceptions are looked up by; always: those without a condition.
    """

    tag: str
    tables: list[tuple[int, str, dict[str, list[tuple[int, list[Atom], Node]]]]]
    always: list[tuple[int, list[Atom], Node]]


def parse_rules(lines: Iterable[str]) -> Rule:
    """The tree of a rule file; its first line is the root, which always holds."""
    path: list[Rule] = []
    for line in filter(str.strip, lines):
        depth = len(line) - len(line.lstrip("\t"))
        condition, _, conclusion = line.strip().rpartition(" : ")
        atoms = []
        for name, value in ATOM.findall(condition):
            side, kind, distance = FEATURE.fullmatch(name).groups()
            offset = int(distance or 0) * (-1 if side == "prev" else 1)
            atoms.append((offset, kind.lower(), value))
        rule = Rule(atoms, CONCLUSION.search(conclusion).group(1))
        if depth > len(path):
            raise ValueError(f"a rule hangs under none: {line.strip()}")
        del path[depth:]
        if path:
            path[-1].exceptions.append(rule)
        path.append(rule)
    return path[0]


def read_rules(spark: SparkSession, path: str) -> Rule:
    """The tree of the rule file at path; a rule file is written by hand or fitted once, no data."""
    return parse_rules(spark.read.text(path, wholetext=True).first()["value"].splitlines())


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(phrase) of a file with an entry a line, its words parted by spaces or underscores."""
    return spark.read.text(path).select(F.trim(F.translate("value", "_", " ")).alias("phrase")).filter("phrase <> ''")


def indexed(rule: Rule) -> Node:
    tables: dict[tuple[int, str], dict[str, list]] = {}
    always = []
    for order, child in enumerate(rule.exceptions):
        first = next((a for a in child.atoms if a[1] == "word"), child.atoms[0] if child.atoms else None)
        entry = (order, [a for a in child.atoms if a is not first], indexed(child))
        if first is None:
            always.append(entry)
        else:
            tables.setdefault(first[:2], {}).setdefault(first[2], []).append(entry)
    return Node(rule.tag, [(*feature, table) for feature, table in tables.items()], always)


def tag(node: Node, words: list[str], tags: list[str]) -> list[str]:
    """Final tags of lower-cased words; conditions read the first tags."""
    end = [""] * 9
    padded = {"word": end + words + end, "tag": end + tags + end}
    out = []
    for i in range(len(end), len(end) + len(words)):
        at, found = node, True
        while found:
            found = None
            lists = [table.get(padded[kind][i + offset], ()) for offset, kind, table in at.tables]
            for order, rest, child in (entry for entries in (*lists, at.always) for entry in entries):
                if (found is None or order < found[0]) and all(padded[k][i + o] == v for o, k, v in rest):
                    found = (order, child)
            at = found[1] if found else at
        out.append(at.tag)
    return out


def trie_of(phrases: Iterable[str]) -> dict:
    """Nested maps from a word to what may follow; the empty word marks an entry's end."""
    trie: dict = {}
    for phrase in phrases:
        at = trie
        for word in phrase.split(" "):
            at = at.setdefault(word, {})
        at[""] = {}
    return trie


def first_tags(trie: dict, words: list[str]) -> list[str]:
    """B and I by the longest entries, from left to right."""
    tags: list[str] = []
    while len(tags) < len(words):
        start = len(tags)
        at, length = trie, 1
        for j in range(start, len(words)):
            at = at.get(words[j])
            if at is None:
                break
            if "" in at:
                length = j - start + 1
        tags += ["B", *["I"] * (length - 1)]
    return tags


def words_of(text: Column) -> Column:
    """array<string> of a text's words and marks, as written; of a null none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def with_words(rows: DataFrame, text: Column) -> DataFrame:
    """Adds words to rows, formed once: the explode keeps them from being inlined."""
    return rows.withColumn("words", F.explode(F.array(words_of(text))))


def join_words(words: Column, tags: Column) -> Column:
    """Words joined by spaces, those tagged I hung on the one before by _."""
    parts = F.zip_with(words, tags, lambda w, t: F.concat(F.when(t == "I", "_").otherwise(" "), w))
    return F.substring(F.array_join(parts, ""), 2, (1 << 31) - 1)


def frequent_phrases(docs: DataFrame, places: int) -> DataFrame:
    """(phrase): sequences of two and three words of letters that docs(text), lower-cased, hold in so many places.

    No word of such a sequence has fewer places, so the frequent words, up to
    MOST_VOCABULARY bytes of them, are numbered, and sequences are counted as numbers, first
    in each batch. Beyond that the sequences themselves are counted.
    """
    w = words_of(F.lower("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = pc.value_counts(batch.column(0).flatten()).flatten()
            yield pa.RecordBatch.from_arrays([words, n], ["word", "n"])

    each = docs.select(w.alias("w")).mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("count"))
    known = written(each.filter((F.col("count") >= places) & F.col("word").rlike(LETTERS)).select("word"))
    if (known.agg(F.sum(F.octet_length("word"))).first()[0] or 0) > MOST_VOCABULARY:
        return _counted_phrases(docs, places)
    vocabulary = pa.array([r["word"] for r in known.toLocalIterator()], pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends = lists.offsets.to_numpy()
            ids = pc.index_in(lists.flatten(), vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = ends - ends[0]
            # A document's end parts its words from the next one's, as an unknown word does.
            ids = np.insert(ids, ends[1:], -1)
            ends = ends + np.arange(len(ends))
            begin = 0
            while begin < len(ends) - 1:
                stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + COUNTED_WORDS, "right")) - 1)
                yield _sequence_counts(ids[ends[begin] : ends[stop]])
                begin = stop

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, last = (batch.column(k).to_numpy() for k in (0, 1))
            parts = [vocabulary.take(pa.array(x)) for x in (pair >> 31, pair & (2**31 - 1))]
            third = vocabulary.take(pa.array(last, mask=last < 0))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*parts, third, " ", null_handling="skip")], ["phrase"])

    numbers = docs.select(w.alias("w")).mapInArrow(count, "pair long, last long, n long")
    counted = numbers.groupBy("pair", "last").agg(F.sum("n").alias("n")).filter(F.col("n") >= places)
    return counted.select("pair", "last").mapInArrow(spelled, "phrase string")


def _sequence_counts(ids: np.ndarray) -> pa.RecordBatch:
    """(pair, last, n) of the sequences of two, whose last is -1, and of three numbers; none holds a -1."""
    pairs = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] << 31 | ids[1:], -1)
    known, at, n = np.unique(pairs, return_inverse=True, return_counts=True)
    whole = (pairs[:-1] >= 0) & (ids[2:] >= 0)
    # Fewer than COUNTED_WORDS pairs and 2^31 words (a longer document: no more than its words) fit one number.
    triples, m = np.unique(at[:-1][whole].astype(np.int64) << 31 | ids[2:][whole], return_counts=True)
    twos = known >= 0
    columns = (
        np.concatenate([known[twos], known[triples >> 31]]),
        np.concatenate([np.full(twos.sum(), -1), triples & (2**31 - 1)]),
        np.concatenate([n[twos], m]),
    )
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["pair", "last", "n"])


def _counted_phrases(docs: DataFrame, places: int) -> DataFrame:
    """frequent_phrases for any number of words."""
    w = with_words(docs.select("text"), F.lower("text")).select(F.col("words").alias("w"))
    # An inner explode would first form all sequences once more, to test documents for having any.
    runs = w.select(F.explode_outer(F.concat(*[gram_list(F.col("w"), n) for n in (2, 3)])).alias("phrase")).filter("phrase is not null")
    counted = runs.groupBy("phrase").count().filter(F.col("count") >= places)
    return counted.filter(F.forall(F.split("phrase", " "), lambda x: x.rlike(LETTERS))).select("phrase")


def entries(lexicon: DataFrame) -> DataFrame:
    """(phrase) lower-cased, of two or more words, each once."""
    phrase = F.array_join(words_of(F.lower("phrase")), " ")
    return lexicon.select(phrase.alias("phrase")).filter("instr(phrase, ' ') > 0").distinct()


def with_first_tags(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds first_tags to rows(words).

    A lexicon of at most MOST_ENTRIES entries and MOST_BYTES is a trie in every task, and
    no row moves. A larger one is joined with the word sequences as long as its entries.
    It is written once, since it may be counted from a whole corpus.
    """
    known = written(entries(lexicon))
    size = known.limit(MOST_ENTRIES + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length("phrase")).alias("bytes")).first()
    if size["n"] > MOST_ENTRIES or (size["bytes"] or 0) > MOST_BYTES:
        return joined_tags(rows, known)
    phrases = [r["phrase"] for r in known.collect()]

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = trie_of(phrases)
        for batch in batches:
            yield pd.Series([first_tags(trie, list(words)) for words in batch], dtype=object)

    return rows.withColumn("first_tags", run(F.transform("words", F.lower)))


def joined_tags(rows: DataFrame, known: DataFrame) -> DataFrame:
    """with_first_tags for a lexicon of any size, known as `entries` gives it.

    Equal word arrays are looked up once, under their digest; what is found at a word is
    the longest entry, and a walk goes from left to right.
    """
    lengths = [r["n"] for r in known.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect()]
    low = F.transform("words", F.lower)
    keyed = rows.withColumn("__key", F.sha2(F.array_join(low, "\x1f"), 256))
    texts = keyed.select("__key", low.alias("low")).dropDuplicates(["__key"])
    runs = [_placed(n) for n in lengths]
    none = F.array().cast("array<struct<at:int,n:int,phrase:string>>")
    places = texts.select("__key", F.explode(F.concat(none, *runs)).alias("x")).select("__key", "x.*")
    found = (
        places.join(known, "phrase", "left_semi").groupBy("__key", "at").agg(F.max("n").alias("n"))
        .groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("__found"))
    )
    longest = F.coalesce("__found", F.create_map().cast("map<int,int>"))
    walked = _walked(F.size("words"), F.map_keys(longest), F.map_values(longest))
    out = keyed.join(found, "__key", "left").withColumn("first_tags", walked)
    return out.drop("__key", "__found")


@F.pandas_udf(ArrayType(StringType()))
def _walked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """B and I for so many words, by the lengths of the longest entries at places from 1."""
    for sizes, places, lengths in batches:
        out = []
        for size, at, n in zip(sizes, places, lengths, strict=True):
            found = dict(zip(at, n, strict=True))
            tags: list[str] = []
            while len(tags) < size:
                tags += ["B", *["I"] * (found.get(len(tags) + 1, 1) - 1)]
            out.append(tags)
        yield pd.Series(out, dtype=object)


def _placed(n: int) -> Column:
    """(at, n, phrase) of the sequences of n words of low, places from 1."""
    return F.transform(gram_list(F.col("low"), n), lambda p, i: F.struct((i + 1).alias("at"), F.lit(n).alias("n"), p.alias("phrase")))


def with_tags(rows: DataFrame, root: Rule) -> DataFrame:
    """Adds tags to rows(words, first_tags), in batches; the rules travel with the function."""
    node = indexed(root)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for words, tags in batches:
            pairs = zip(words, tags, strict=True)
            yield pd.Series([tag(node, list(w), list(t)) for w, t in pairs], dtype=object)

    return rows.withColumn("tags", run(F.transform("words", F.lower), "first_tags"))


def segment(rows: DataFrame, lexicon: DataFrame, root: Rule, text: str = "text") -> DataFrame:
    """Adds words, first_tags, tags and segmented to rows with a text.

    lexicon: (phrase). A null or empty text has no words and the empty string. Repeated
    rows stay; columns of rows with one of the new names are replaced.
    """
    worded = with_words(rows.drop("words", "first_tags", "tags", "segmented"), F.col(text))
    return with_tags(with_first_tags(worded, lexicon), root).withColumn("segmented", join_words(F.col("words"), F.col("tags")))
