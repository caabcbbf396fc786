"""Inverted index as tables, and BM25 over whole batches of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.operators.contexts import hit_contexts, with_contents
from answerloom.operators.ranking import DIGITS, broadcast_if_small, top_k
from answerloom.operators.reader import HashingEncoder, VectorEncoder
from answerloom.operators.vectors import dense_top_k

#: Fixed values of the retrieval configuration.
K1, B = 0.9, 0.4
TERM = r"[\p{L}\p{N}]+"


def analyze(c: Column) -> Column:
    """Terms of a text: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), 0)


@dataclass(frozen=True)
class BM25Index:
    """postings(term, doc_id, tf, dl), terms(term, df) and one row of stats(n, avgdl).

    An index that is built and not written also has its occurrences(doc_id, dl, term),
    from which a search counts the terms it asks for and no others. With positions, every
    posting has the ascending places of its term in the document.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    occurrences: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", positions: bool = False) -> BM25Index:
        """Counts each text once; only (doc, term, tf) is grouped, never a posting list.

        The outer explode keeps the optimiser from testing each text's terms for being
        none, which would analyse the texts once more where they are scanned.
        """
        terms = docs.select(F.col(doc_id).alias("doc_id"), analyze(F.col(text)).alias("terms"))
        # Counting terms is cheaper than cutting them out once more.
        lengths = docs.select(F.regexp_count(F.lower(F.col(text)), F.lit(TERM)).alias("dl"))
        each = F.posexplode_outer("terms").alias("at", "term")
        occurrences = terms.select("doc_id", F.size("terms").cast("long").alias("dl"), each).filter("term is not null")
        postings = _count(occurrences, positions)
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        return cls(postings, df, stats, occurrences)

    def document_vectors(self) -> DataFrame:
        """(doc_id, terms): each document's terms with their counts, in order of terms."""
        pair = F.struct("term", "tf")
        return self.postings.groupBy("doc_id").agg(F.array_sort(F.collect_list(pair)).alias("terms"))

    def write(self, path: str, buckets: int = 200) -> None:
        """Postings in ranges of (term, doc_id), so that a reader prunes files by term.

        A term that half of the documents hold spans as many files as it needs.
        """
        ranges = self.postings.repartitionByRange(buckets, "term", "doc_id")
        ranges.sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
        self.terms.write.parquet(f"{path}/terms")
        self.stats.write.parquet(f"{path}/stats")

    def stored(self, path: str) -> BM25Index:
        """This index written to path and read back, for searches that follow each other."""
        self.write(path)
        return BM25Index.read(self.postings.sparkSession, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BM25Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats")))

    def search(self, questions: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
        """(qid, doc_id, score, rank) of the k best; a repeated question term counts again.

        Question terms get their document frequency and the corpus statistics before
        they meet the postings, so the large side is read once, hashed once by term
        at most, and pre-aggregated by (question, document).
        """
        counted = (
            questions.select("qid", F.explode(analyze(F.col("question"))).alias("term"))
            .groupBy("qid", "term").agg(F.count("*").alias("qtf"))
        )
        postings, terms = self.postings, self.terms
        if self.occurrences is not None:
            wanted = broadcast_if_small(counted.select("term").distinct(), bound=counted)
            postings = _count(self.occurrences.join(wanted, "term", "left_semi"))
            terms = postings.groupBy("term").agg(F.count("*").alias("df"))
        asked = counted.join(terms, "term").join(F.broadcast(self.stats))  # one row of stats
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf")
        gain = F.col("qtf") * idf * tf / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        scored = (
            postings.join(broadcast_if_small(asked, bound=counted), "term")
            .groupBy("qid", "doc_id").agg(F.round(F.sum(gain), DIGITS).alias("score"))
        )
        return top_k(scored, ["qid"], [F.desc("score"), F.asc("doc_id")], k)


def _count(occurrences: DataFrame, positions: bool = False) -> DataFrame:
    """(doc_id, term, tf, dl[, positions]); dl is the same in all occurrences of a document."""
    more = [F.array_sort(F.collect_list("at")).alias("positions")] if positions else []
    return occurrences.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), *more)


@dataclass(frozen=True)
class DenseIndex:
    """vectors(vec_id, embedding) under an encoder of questions, and a store(doc_id, raw) of their texts.

    The search is exact. An encoder that is no trained model finds what shares words.
    """

    vectors: DataFrame
    store: DataFrame
    encoder: VectorEncoder

    @classmethod
    def build(cls, docs: DataFrame, encoder: VectorEncoder, doc_id: str = "doc_id", text: str = "text") -> DenseIndex:
        named = docs.select(F.col(doc_id).alias("vec_id"), F.coalesce(text, F.lit("")).alias("raw"))
        vectors = encoder.encode(named, "raw", "embedding").select("vec_id", "embedding")
        return cls(vectors, named.withColumnRenamed("vec_id", "doc_id"), encoder)

    def write(self, path: str) -> None:
        self.vectors.write.parquet(f"{path}/vectors")
        self.store.write.parquet(f"{path}/store")

    @classmethod
    def read(cls, spark: SparkSession, path: str, encoder: VectorEncoder | None = None) -> DenseIndex:
        vectors, store = (spark.read.parquet(f"{path}/{t}") for t in ("vectors", "store"))
        return cls(vectors, store, encoder or HashingEncoder())

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """(qid, doc_id, score, rank) of the k nearest by cosine."""
        asked = self.encoder.encode(questions.select("qid", "question"), "question", "q").select("qid", "q")
        return dense_top_k(asked, self.vectors, k).withColumnRenamed("vec_id", "doc_id")

    def contexts(self, questions: DataFrame, k: int) -> DataFrame:
        """(qid, title, text, score): hits with their texts from the store."""
        return hit_contexts(with_contents(self.search(questions, k), self.store))


def build_searcher(kind: str, **given: DataFrame | VectorEncoder) -> BM25Index | DenseIndex:
    """A retriever by name: bm25 over index tables, dpr over vectors, a store and an encoder."""
    if kind == "bm25":
        return BM25Index(given["postings"], given["terms"], given["stats"])
    if kind == "dpr":
        return DenseIndex(given["vectors"], given["store"], given.get("encoder") or HashingEncoder())
    raise ValueError(f"unknown retriever: {kind}")
