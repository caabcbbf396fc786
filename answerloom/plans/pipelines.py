"""Question answering over whole batches: one plan keyed by qid, no loop over questions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.functions.entities import extract_datetime, extract_quantity, format_datetime
from answerloom.functions.ngrams import overlap, with_profile
from answerloom.functions.text import lines, normalizer, preprocess_text, query_normalize, question_fixup, to_passages
from answerloom.operators.classify import classify
from answerloom.operators.index import BM25Index
from answerloom.operators.links import closest_titles, resolve_links
from answerloom.operators.ranking import DIGITS, broadcast_if_small, fuse, minmax, top_k, zero_below
from answerloom.operators.reader import BagEncoder, Encoder, LexicalReader, Reader
from answerloom.operators.voting import acceptable, best_voted, merge_substrings, ordered_distinct, vote
from answerloom.sources import writers
from answerloom.sources.readers import read_questions
from answerloom.sources.scan import even_out
from answerloom.sources.shared import written

# Work budgets of the two models.
DOCUMENTS_1, PASSAGES_A_DOCUMENT, PASSAGES_1, DOCUMENTS_2 = 100, 5, 50, 10
ANSWERS = 10
#: Parts that the passages of one document are dealt into.
PARTS = 8


def ranked_passages(
    questions: DataFrame, docs: DataFrame, hits: DataFrame, per_doc: int = PASSAGES_A_DOCUMENT, compat: bool = False
) -> DataFrame:
    """(qid, doc_id, passage, score, rank): best passages of each hit by n-gram overlap.

    docs(doc_id, text), hits(qid, doc_id). Only hit documents are cut into passages, and
    each passage is profiled once, however many questions hit it; a document's passages
    are dealt into PARTS, which its hits meet where they stand, so that a document that
    all questions hit is not one task. Where docs has a title, the overlap of the question and the title of its document is added.
    """
    asked = broadcast_if_small(
        with_profile(questions.select("qid", "question"), "question", "q").drop("question"), bound=questions
    )
    found = hits.select("qid", "doc_id")
    texts = docs.select("doc_id", "text").join(found.select("doc_id").distinct(), "doc_id")
    # An inner explode would first test all documents for having passages, at their scan.
    passages = texts.select("doc_id", F.posexplode_outer(to_passages(F.col("text"))).alias("at", "passage")).filter("passage is not null")
    dealt = even_out(passages.select("doc_id", F.pmod("at", F.lit(PARTS)).alias("part"), "passage"), "doc_id", "part")
    each = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = with_profile(dealt, "passage", "p").join(even_out(each, "doc_id", "part").hint("shuffle_hash"), ["doc_id", "part"])
    profiled = met.join(asked, "qid")
    scored = profiled.select("qid", "doc_id", "passage", overlap(F.col("q"), F.col("p"), compat).alias("score"))
    if "title" in docs.columns:
        named = hits.select("qid", "doc_id").distinct().join(docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title")), "doc_id")
        named = with_profile(named, "title", "t").join(asked, "qid")
        named = named.groupBy("qid", "doc_id").agg(F.max(overlap(F.col("q"), F.col("t"), compat)).alias("titled"))
        scored = scored.join(named, ["qid", "doc_id"]).withColumn("score", F.col("score") + F.col("titled")).drop("titled")
    return top_k(scored, ["qid", "doc_id"], [F.desc("score"), F.desc("passage")], per_doc)


def best_passages(passages: DataFrame, k: int = PASSAGES_1) -> DataFrame:
    """k best passages of each question, over all its documents."""
    return top_k(passages.drop("rank"), ["qid"], [F.desc("score"), F.desc("passage"), F.asc("doc_id")], k)


def extract_answers(
    questions: DataFrame, docs: DataFrame, index: BM25Index, reader: Reader | None = None,
    k: int = DOCUMENTS_1, passages: int = PASSAGES_1,
) -> DataFrame:
    """(qid, answer, votes, score): retrieval, overlap ranking, reading, voting."""
    cleaned = questions.select("qid", preprocess_text(F.col("question")).alias("question"))
    hits = index.search(cleaned, k)
    best = best_passages(ranked_passages(questions, docs, hits), passages)
    read = (reader or LexicalReader()).predict(best.join(broadcast_if_small(questions.select("qid", "question"), bound=questions), "qid"))
    good = read.filter(acceptable(F.col("question"), F.col("answer"), F.col("reader_raw")))
    votes = vote(good.select("qid", "answer", F.col("reader_raw").alias("score"), F.col("rank").alias("ord")))
    return best_voted(merge_substrings(votes)).select("qid", "answer", "votes", "score")


def read_lines_of_hits(questions: DataFrame, docs: DataFrame, index: BM25Index, k: int = DOCUMENTS_2) -> DataFrame:
    """(qid, question, doc_id, ordinal, passage, rank_score) of every line of the k best documents."""
    fixed = questions.select("qid", question_fixup(F.col("question")).alias("question"))
    hits = index.search(fixed, k)
    hits = hits.withColumn("rank_score", F.round(minmax(F.col("score"), ["qid"]), DIGITS))
    more = [c for c in ("title",) if c in docs.columns]
    texts = even_out(hits, "qid", "doc_id").join(docs.select("doc_id", "text", *more), "doc_id").join(broadcast_if_small(fixed), "qid")
    cut = texts.select("qid", "question", "doc_id", *more, "rank", "rank_score", F.posexplode_outer(lines(F.col("text"))).alias("at", "passage")).filter("passage is not null")
    order = F.struct("rank", "at")
    return cut.select("qid", "question", "doc_id", *more, order.alias("ordinal"), "passage", "rank_score")


def with_context(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds context to read lines with a title: what similarity is taken to.

    Lines for a wiki question have the title of their page put before them.
    """
    kinds = broadcast_if_small(categories.select("qid", "category"))
    titled = F.concat(F.coalesce("title", F.lit("")), F.lit(" . "), F.col("passage"))
    met = rows.join(kinds, "qid", "left")
    return met.withColumn("context", F.when(F.col("category") == "wiki", titled).otherwise(F.col("passage"))).drop("category")


def fused_candidates(
    rows: DataFrame, reader: Reader | None = None, encoder: Encoder | None = None, k: int | None = ANSWERS
) -> DataFrame:
    """Adds answer, reader_raw, reader_score, similarity, score and rank to read lines, of which the k best stay.

    Without k all lines stay, ranked.

    The fusion takes the reader's raw score; the normalised one is reported. Similarity
    is that of the question and the column context, or passage where rows have none.
    """
    read = (reader or LexicalReader()).predict(rows)
    by = ["qid"]
    read = (encoder or BagEncoder()).similarity(read, "question", "context" if "context" in rows.columns else "passage", "sim_raw")
    read = read.withColumn("sim_raw", F.round("sim_raw", DIGITS))
    scored = read.withColumns(
        {
            "similarity": F.round(zero_below(minmax(F.col("sim_raw"), by)), DIGITS),
            "reader_score": F.round(zero_below(minmax(F.col("reader_raw"), by)), DIGITS),
            "rank_zeroed": F.round(zero_below(F.col("rank_score")), DIGITS),
        }
    )
    scored = scored.withColumn("fused", F.round(fuse(F.col("reader_raw"), F.col("rank_zeroed"), F.col("similarity")), DIGITS))
    scored = scored.withColumn("score", F.round(zero_below(minmax(F.col("fused"), by)), DIGITS))
    order = [F.desc("score"), F.asc("ordinal"), F.asc("doc_id")]
    if k is None:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
        return scored.withColumn("rank", place).drop("sim_raw", "rank_zeroed")
    return top_k(scored, by, order, k).drop("sim_raw", "rank_zeroed")


def format_answers(candidates: DataFrame, categories: DataFrame, links: DataFrame) -> DataFrame:
    """(qid, category, answer, answers, raw_answers) from ranked candidates(qid, rank, answer).

    answers are those of the first ANSWERS rows in order, repeats left out: of a datetime
    question the rows that hold a date, of a quantity question the digits of every row
    (null without any), of a wiki question the link of the first row and null for the
    others, else null. A row whose answer is 'null' puts a null before its own. answer is
    the first of answers, null without any. raw_answers are those of all candidates, in order.
    """
    rows = candidates.select("qid", "rank", "answer").join(broadcast_if_small(categories.select("qid", "category")), "qid")
    rows = rows.join(links.select("qid", "link"), "qid", "left")
    c = F.col("category")
    # Of the others, which are most rows, nothing is sought.
    answer = F.when(F.col("rank") <= ANSWERS, F.col("answer"))
    value = (
        F.when((c == "datetime") & answer.isNotNull(), format_datetime(extract_datetime(answer)))
        .when((c == "quantity") & answer.isNotNull(), F.nullif(extract_quantity(answer), F.lit("")))
        .when((c == "wiki") & (F.col("rank") == 1), F.col("link"))
    )
    # Formed once, behind an explode.
    rows = rows.withColumn("value", F.explode_outer(F.array(value)))
    item = F.struct(F.col("value").alias("v"))
    own = F.when((c == "datetime") & F.col("value").isNull(), F.array().cast("array<struct<v: string>>")).otherwise(F.array(item))
    none = F.when(answer == "null", F.array(F.struct(F.lit(None).cast("string").alias("v")))).otherwise(F.array().cast("array<struct<v: string>>"))
    rows = rows.select("qid", "rank", "answer", F.when(F.col("rank") <= ANSWERS, F.concat(none, own)).otherwise(F.array().cast("array<struct<v: string>>")).alias("found"))
    in_order = F.array_sort(F.collect_list(F.struct("rank", "answer", "found")))
    got = rows.groupBy("qid").agg(in_order.alias("rows")).select(
        "qid",
        F.array_distinct(F.transform(F.flatten(F.transform("rows", lambda r: r["found"])), lambda x: x["v"])).alias("answers"),
        F.transform("rows", lambda r: r["answer"]).alias("raw_answers"),
    )
    out = categories.select("qid", "category").join(got, "qid", "left")
    return out.select("qid", "category", F.get("answers", F.lit(0)).alias("answer"), "answers", "raw_answers")


def predict(
    questions: DataFrame, docs: DataFrame, index: BM25Index, titles: DataFrame, dictionary: DataFrame,
    model: PipelineModel | None = None, reader: Reader | None = None, encoder: Encoder | None = None,
) -> DataFrame:
    """(qid, category, answer, answers, raw_answers): classify, retrieve, read, fuse, link
    and format a batch.

    docs(doc_id, title, text); titles(title); dictionary as link_dictionary gives it. Only
    wiki questions are linked: their first answer, normalised, to the closest title.
    """
    kinds = classify(questions, model)
    lines_read = with_context(read_lines_of_hits(questions, docs, index), kinds)
    # Written once, narrow: the search for titles alone would read every line several times.
    candidates = written(fused_candidates(lines_read, reader, encoder, None).select("qid", "rank", "answer", "title"))
    firsts = candidates.filter("rank = 1").join(kinds.filter("category = 'wiki'").select("qid"), "qid", "left_semi")
    asked = firsts.select("qid", query_normalize(normalizer(F.col("answer"))).alias("query"))
    closest = closest_titles(asked, titles).select("qid", F.col("title").alias("label"))
    pages = firsts.select("qid", F.col("title").alias("page_title"))
    links = resolve_links(closest.join(pages, "qid"), dictionary)
    return format_answers(candidates, kinds, links)


def distinct_answers(answers: DataFrame) -> DataFrame:
    """Answers of each question in order, repeats left out."""
    return ordered_distinct(answers, ["qid"], "answer", "rank")


class Stopwatch:
    """Wall-clock milliseconds of named steps, on the driver."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    def run(self, name: str, step: Callable[[], object]) -> object:
        began = time.perf_counter()
        got = step()
        self.rows.append((name, (time.perf_counter() - began) * 1000))
        return got

    def measure(self, name: str, df: DataFrame) -> int:
        return self.run(name, df.count)


def answer_file(
    spark: SparkSession, path: str, out: str, answer: Callable[[DataFrame], DataFrame], name: str = "predict", each: int | None = None
) -> Stopwatch:
    """Answers the question batch at path and writes submission, results and latency below out.

    answer takes questions(qid, question) and gives (qid, answer). A batch of one or more
    files is one plan; its time is that of the whole batch, and its mean is each question's
    latency. To measure latencies, `each` cuts it into micro-batches of so many questions,
    one after the other; a question's latency is then its micro-batch's time, shared out.
    """
    batch = materialised(read_questions(spark, path).withColumn("qid", F.col("ord")), f"{out}/questions")
    watch, n = Stopwatch(), batch.count()
    each = each or max(n, 1)
    times = []
    for k in range(max(1, -(-n // each))):
        some = batch.filter(F.col("ord").between(k * each, (k + 1) * each - 1))
        got = answer(some.select("qid", "question")).select("qid", F.col("answer").alias("found"))
        watch.run(name, lambda got=got: got.write.mode("append").parquet(f"{out}/answers"))
        times.append((k, watch.rows[-1][1] / max(1, min(each, n - k * each))))
    done = batch.join(spark.read.parquet(f"{out}/answers"), "qid", "left")
    writers.write_submission(done.select("ord", "id", "question", F.col("found").alias("answer")), f"{out}/submission")
    writers.write_results(done.select("question", F.col("answer").alias("truth"), F.col("found").alias("answer")), f"{out}/results")
    shares = spark.createDataFrame(times, "k long, predicted_time_ms double")
    timed = batch.withColumn("k", F.floor(F.col("ord") / each)).join(F.broadcast(shares), "k")  # one row a micro-batch
    writers.write_latency(timed.select("id", "predicted_time_ms"), f"{out}/latency")
    return watch


def materialised(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A question that touches every part of the second model.
WARM_UP = "Bác Hồ sinh ngày tháng năm nào?"


def warm_up(spark: SparkSession, answer: Callable[[DataFrame], DataFrame], question: str = WARM_UP) -> str | None:
    """Answers one question, so that classes, models and workers are loaded before a batch."""
    asked = spark.createDataFrame([(0, question)], "qid long, question string")
    row = answer(asked).select("answer").first()
    return row["answer"] if row else None
