"""Answer metrics, thresholds and n-best spans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.functions.ngrams import multiset_overlap
from answerloom.functions.text import normalize_answer, words
from answerloom.operators.ranking import best_indexes, softmax, top_k
from answerloom.sources.shared import written

MAX_ANSWER_LENGTH = 30


def exact(gold: Column, pred: Column) -> Column:
    return (normalize_answer(gold) == normalize_answer(pred)).cast("long")


def token_f1(gold: Column, pred: Column) -> Column:
    """Multiset F1 of normalised words; an empty side scores 1 only against an empty one."""
    return words_f1(words(normalize_answer(gold)), words(normalize_answer(pred)))


def words_f1(g: Column, p: Column) -> Column:
    """token_f1 of arrays of words, which should be plain columns."""
    f1 = F.try_divide(2.0 * multiset_overlap(g, p), F.size(g) + F.size(p))
    return F.when((F.size(g) == 0) | (F.size(p) == 0), (F.size(g) == F.size(p)).cast("double")).otherwise(f1)


def raw_scores(golds: DataFrame, preds: DataFrame) -> DataFrame:
    """(qid, exact, f1): best over golds(qid, gold); no usable gold counts as ''.

    Questions without a prediction are left out. Every gold and every prediction is
    normalised once.
    """
    every = golds.select("qid", normalize_answer(F.coalesce("gold", F.lit(""))).alias("gold"))
    usable = F.max((F.col("gold") != "").cast("int")).over(Window.partitionBy("qid"))
    every = every.withColumn("usable", usable).filter("gold <> '' or usable = 0").drop("usable")
    told = preds.select("qid", normalize_answer(F.col("pred")).alias("pred"))
    met = every.join(told, "qid").withColumns({"g": words(F.col("gold")), "p": words(F.col("pred"))})
    return met.groupBy("qid").agg(
        F.max((F.col("gold") == F.col("pred")).cast("double")).alias("exact"), F.max(words_f1(F.col("g"), F.col("p"))).alias("f1")
    )


def apply_no_answer_threshold(score: Column, na_prob: Column, has_answer: Column, threshold: float = 1.0) -> Column:
    return F.when(na_prob > threshold, (~has_answer).cast("double")).otherwise(score)


def eval_summary(scores: DataFrame) -> DataFrame:
    """One row of exact, f1, total, and the same for HasAns and NoAns."""

    def block(prefix: str, rows: Column) -> list[Column]:
        mean = lambda c: (100.0 * F.avg(F.when(rows, F.col(c)))).alias(prefix + c)
        return [mean("exact"), mean("f1"), F.count(F.when(rows, 1)).alias(prefix + "total")]

    has = F.col("has_answer")
    return scores.agg(*block("", F.lit(True)), *block("HasAns_", has), *block("NoAns_", ~has))


def best_threshold(scores: DataFrame, score: str) -> DataFrame:
    """(best, threshold): na_prob up to which answering pays most; see best_thresholds."""
    return best_thresholds(scores, [score]).select(F.col(f"best_{score}").alias("best"), F.col(f"best_{score}_thresh").alias("threshold"))


def best_thresholds(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of best_c and best_c_thresh for every score c of scores(qid, na_prob, has_answer, answered, *columns).

    The running sum over all questions by na_prob is taken in two levels: buckets of
    na_prob first, then the rows inside a bucket, so no task sorts everything.
    """
    bucket = F.floor(F.col("na_prob") * 1000).cast("long").alias("bucket")
    gain = lambda c: F.when(F.col("has_answer"), F.col(c)).otherwise(F.when(F.col("answered"), -1.0).otherwise(0.0)).alias(f"gain_{c}")
    rows = scores.select("qid", "na_prob", "has_answer", bucket, *map(gain, columns))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("bucket").agg(*[F.sum(f"gain_{c}").alias(c) for c in columns]).select(
        "bucket", *[F.coalesce(F.sum(c).over(ahead), F.lit(0.0)).alias(f"ahead_{c}") for c in columns]
    )
    start = F.broadcast(rows.agg(F.sum((~F.col("has_answer")).cast("double")).alias("start"), F.count("*").alias("n")))
    inside = Window.partitionBy("bucket").orderBy("na_prob", "qid").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"own_{c}": F.sum(f"gain_{c}").over(inside) for c in columns}).join(sums, "bucket").join(start)
    total = lambda c: F.round(F.col("start") + F.col(f"ahead_{c}") + F.col(f"own_{c}"), 9)
    best = run.agg(
        F.max("n").alias("n"), F.max("start").alias("start"),
        *[F.max(F.struct(total(c).alias("total"), (-F.col("na_prob")).alias("p"))).alias(f"top_{c}") for c in columns],
    )

    def pair(c: str) -> list[Column]:
        top = F.col(f"top_{c}")
        better = top["total"] > F.col("start")
        return [
            F.round(100.0 * F.when(better, top["total"]).otherwise(F.col("start")) / F.col("n"), 6).alias(f"best_{c}"),
            F.when(better, -top["p"]).otherwise(0.0).alias(f"best_{c}_thresh"),
        ]

    return best.select(*[x for c in columns for x in pair(c)])


def squad_evaluate(golds: DataFrame, preds: DataFrame, threshold: float = 1.0) -> DataFrame:
    """One row: eval_summary of golds(qid, gold) against preds, and all_best_thresholds.

    preds(qid, pred) may have na_prob; without it, or where it is null, it is 0. A
    question has an answer if any of its golds is neither null nor ''. The thresholds
    are sought over the raw scores, the summary is of those cut at threshold.
    """
    golds = golds.withColumn("gold", F.coalesce("gold", F.lit("")))
    has = golds.groupBy("qid").agg((F.count(F.when(F.col("gold") != "", 1)) > 0).alias("has_answer"))
    na = F.coalesce("na_prob", F.lit(0.0)) if "na_prob" in preds.columns else F.lit(0.0)
    given = preds.select("qid", na.alias("na_prob"), (F.coalesce("pred", F.lit("")) != "").alias("answered"))
    rows = raw_scores(golds, preds).join(has, "qid").join(given, "qid")
    cut = lambda c: apply_no_answer_threshold(F.col(c), F.col("na_prob"), F.col("has_answer"), threshold)
    summary = eval_summary(rows.select("qid", cut("exact").alias("exact"), cut("f1").alias("f1"), "has_answer"))
    return summary.join(F.broadcast(all_best_thresholds(rows)))  # one row each


def candidate_spans(features: DataFrame, n: int, max_length: int = MAX_ANSWER_LENGTH) -> DataFrame:
    """(feature_id, start, end, score, rank): the n best spans of each feature.

    features(feature_id, start_logits, end_logits). The n best starts meet the n best
    ends inside the row.
    """
    spans = _spans(features.select("feature_id", "start_logits", "end_logits"), n, max_length).select(
        "feature_id", "start", "end", F.round(F.col("start_logit") + F.col("end_logit"), 6).alias("score")
    )
    return top_k(spans, ["feature_id"], [F.desc("score"), F.asc("start"), F.asc("end")], n)


def _spans(features: DataFrame, n: int, max_length: int) -> DataFrame:
    """features by (start, end) of their n best starts and ends, with both logits and places i, j."""
    rows = features.select("*", F.posexplode(best_indexes(F.col("start_logits"), n)).alias("i", "start"))
    rows = rows.select("*", F.posexplode(best_indexes(F.col("end_logits"), n)).alias("j", "end")).filter(
        (F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") + 1 <= max_length)
    )
    return rows.withColumns(
        {
            "start_logit": F.get("start_logits", F.col("start")), "end_logit": F.get("end_logits", F.col("end")),
            "start": F.col("start").cast("long"), "end": F.col("end").cast("long"),
        }
    ).drop("start_logits", "end_logits")


@dataclass(frozen=True)
class NBest:
    """nbest(qid, rank, text, probability, start_logit, end_logit), predictions(qid, text, score)
    and null_odds(qid, null_odds), the last None where the empty answer is no choice."""

    nbest: DataFrame
    predictions: DataFrame
    null_odds: DataFrame | None


Tokenise = Callable[[str], list[str]]


#: Basic tokens, which stand in for a reader's own: words, and single marks, of the lower-cased text.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]"


def piece_text(tokens: Column) -> Column:
    """Word pieces as text: ## joins a piece to the one before; spaces are single."""
    return F.regexp_replace(F.trim(F.replace(F.array_join(tokens, " "), F.lit(" ##"), F.lit(""))), r"\s+", " ")


def _with_text(spans: DataFrame, examples: DataFrame, tokenise: Tokenise | None) -> DataFrame:
    """Adds text to spans(qid, tokens, orig_map, start, end, ...): the words they came from."""
    length = lambda a, b: (F.col(b) - F.col(a) + 1).cast("int")
    met = spans.withColumns(
        {"__a": F.try_element_at("orig_map", F.col("start").cast("int")), "__b": F.try_element_at("orig_map", F.col("end").cast("int"))}
    ).join(examples.select("qid", "doc_tokens"), "qid")
    met = met.withColumns(
        {
            "pred": piece_text(F.slice("tokens", (F.col("start") + 1).cast("int"), length("start", "end"))),
            "original": F.array_join(F.slice("doc_tokens", (F.col("__a") + 1).cast("int"), F.greatest(length("__a", "__b"), F.lit(0))), " "),
        }
    ).drop("tokens", "orig_map", "doc_tokens", "__a", "__b")
    return with_final_text(met, tokenise).withColumnRenamed("final", "text").drop("pred", "original")


def _first_of_each(rows: DataFrame, order: Sequence[Column], n: int, always: Column | None = None) -> DataFrame:
    """First n rows of each question by order, of equal texts the first alone; always keeps others too."""
    seen = F.row_number().over(Window.partitionBy("qid", "text").orderBy(*order)) == 1
    return top_k(rows.withColumn("__new", seen).filter(F.col("__new") if always is None else F.col("__new") | always).drop("__new"), ["qid"], order, n)


def predictions_logits(
    features: DataFrame, examples: DataFrame, n: int = 20, max_length: int = MAX_ANSWER_LENGTH,
    null_threshold: float | None = None, tokenise: Tokenise | None = None,
) -> NBest:
    """n-best answers of each question from the logits of its features.

    features(qid, feature_id, tokens, orig_map, max_context, start_logits, end_logits):
    orig_map tells the word of each token that has one, max_context the tokens that see
    most context here. A span must start and end at tokens of the map, start at one of
    most context, and hold at most max_length tokens. examples(qid, doc_tokens).
    Texts are those of the document's words; equal texts count once, the best of them.
    Ties go to the earlier feature, then to the better start. probability is the raw sum.

    With null_threshold the empty answer joins with the lowest start[0] + end[0] of any
    feature, behind the others if it is not among the n best; a lone one stands behind
    'empty'. It is predicted, with score 0, where it beats the best other by more than
    the threshold. A question without any span has the answer 'empty' with sum 0.
    """
    at = lambda m, c: F.try_element_at(m, F.col(c).cast("int"))
    valid = (
        at("orig_map", "start").isNotNull() & at("orig_map", "end").isNotNull() & F.coalesce(at("max_context", "start"), F.lit(False))
        & (F.col("start") < F.size("tokens")) & (F.col("end") < F.size("tokens"))
    )
    spans = _spans(features, n, max_length).filter(valid)
    named = _with_text(spans, examples, tokenise).withColumn("text", F.when(F.col("start") > 0, F.col("text")).otherwise(""))
    fields = ["qid", "text", "start_logit", "end_logit", "start", "feature_id", "i", "j"]
    rows = named.select(*fields)
    first = lambda c: F.get(c, F.lit(0))
    if null_threshold is not None:
        null = F.min_by(
            F.struct(first("start_logits").alias("s"), first("end_logits").alias("e")),
            F.struct((first("start_logits") + first("end_logits")).alias("sum"), "feature_id"),
        )
        nulls = features.groupBy("qid").agg(null.alias("null")).select("qid", "null.*")
        last = F.lit(2**31 - 1)
        rows = rows.unionByName(
            nulls.select("qid", F.lit("").alias("text"), F.col("s").alias("start_logit"), F.col("e").alias("end_logit"),
                F.lit(0).cast("long").alias("start"), F.lit(None).cast(features.schema["feature_id"].dataType).alias("feature_id"), last.alias("i"), last.alias("j"))
        )
    total = F.col("start_logit") + F.col("end_logit")
    order = [F.desc(total), F.asc_nulls_last("feature_id"), F.asc("i"), F.asc("j")]
    # Written, as is the whole list below: both are read several times, and one task would else hold all the sorts of each reading.
    best = written(_first_of_each(rows, order, n, F.col("start") == 0).select("qid", "rank", "text", "start_logit", "end_logit"))
    nonce = lambda place: [F.lit(place).cast("long").alias("rank"), F.lit("empty").alias("text"), F.lit(0.0).alias("start_logit"), F.lit(0.0).alias("end_logit")]
    if null_threshold is None:
        asked = examples.select("qid").distinct()
        best = best.union(asked.join(best.select("qid").distinct(), "qid", "left_anti").select("qid", *nonce(1)))
    else:
        told = best.groupBy("qid").agg(F.max((F.col("text") == "").cast("int")).alias("empty"), F.max("rank").alias("m"))
        missing = nulls.join(told, "qid").filter("empty = 0")
        best = best.union(missing.select("qid", F.col("m") + 1, F.lit(""), "s", "e"))
        alone = best.groupBy("qid").agg(F.count("*").alias("m")).filter("m = 1")
        best = best.union(alone.select("qid", *nonce(0)))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("long"))
    best = written(best).withColumn("probability", total)
    firsts = best.groupBy("qid").agg(
        F.min_by(F.struct("text", F.col("probability").alias("score")), "rank").alias("first"),
        F.min_by(F.struct("text", F.col("probability").alias("score")), F.when(F.col("text") != "", F.col("rank"))).alias("other"),
    )
    if null_threshold is None:
        return NBest(best, firsts.select("qid", "first.*"), None)
    odds = firsts.join(nulls, "qid").withColumn("null_odds", F.col("s") + F.col("e") - F.col("other.score"))
    nothing = F.coalesce(F.col("null_odds") > null_threshold, F.lit(True))
    predicted = odds.select(
        "qid", F.when(nothing, "").otherwise(F.col("other.text")).alias("text"), F.when(nothing, 0.0).otherwise(F.col("other.score")).alias("score")
    )
    return NBest(best, predicted, odds.select("qid", "null_odds"))


def predictions_log_probs(
    features: DataFrame, examples: DataFrame, n: int = 5, max_length: int = MAX_ANSWER_LENGTH, tokenise: Tokenise | None = None
) -> NBest:
    """n-best answers from top starts and, for each of them, top ends.

    features(qid, feature_id, tokens, orig_map, max_context, paragraph_len, cls_logit,
    start_top_index, start_log_probs, end_top_index, end_log_probs): the ends of the
    i-th start are the i-th of equal slices of the two end arrays. Spans stay before the
    paragraph's last token. probability is a softmax over the n best; the first of them
    is predicted; null_odds is the least cls_logit. A question without any span has the
    answer '' with log-probabilities of -1e6.
    """
    ends = (F.size("end_top_index") / F.size("start_top_index")).cast("int")
    rows = features.withColumn("ends", ends).select("*", F.posexplode("start_top_index").alias("i", "start"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("ends") - 1)).alias("j"))
    place = F.col("i") * F.col("ends") + F.col("j")
    rows = rows.withColumns(
        {
            "end": F.get("end_top_index", place).cast("long"), "start": F.col("start").cast("long"),
            "start_logit": F.get("start_log_probs", F.col("i")), "end_logit": F.get("end_log_probs", place),
        }
    ).drop("start_top_index", "end_top_index", "start_log_probs", "end_log_probs")
    limit = F.col("paragraph_len") - 1
    spans = rows.filter(
        (F.col("start") < limit) & (F.col("end") < limit) & F.coalesce(F.try_element_at("max_context", F.col("start").cast("int")), F.lit(False))
        & (F.col("end") >= F.col("start")) & (F.col("end") - F.col("start") + 1 <= max_length)
    )
    total = F.col("start_logit") + F.col("end_logit")
    best = _first_of_each(_with_text(spans, examples, tokenise), [F.desc(total), F.asc("feature_id"), F.asc("i"), F.asc("j")], n)
    best = written(best.select("qid", "rank", "text", "start_logit", "end_logit"))
    rest = examples.select("qid").distinct().join(best.select("qid").distinct(), "qid", "left_anti")
    best = best.union(rest.select("qid", F.lit(1).cast("long"), F.lit(""), F.lit(-1e6), F.lit(-1e6)))
    best = best.withColumn("probability", softmax(total, ["qid"]))
    first = best.groupBy("qid").agg(F.min_by(F.struct("text", F.col("probability").alias("score")), "rank").alias("first"))
    return NBest(best, first.select("qid", "first.*"), features.groupBy("qid").agg(F.min("cls_logit").alias("null_odds")))


def _inked(text: Column) -> Column:
    """Places, from 0, of the characters that are no spaces."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(places, lambda i: F.substr(text, i, F.lit(1)) != " "), lambda i: i - 1)


def with_final_text(rows: DataFrame, tokenise: Tokenise | None = None) -> DataFrame:
    """Adds final to rows(pred, original): the stretch of original that pred, of its tokens, came from.

    The original is tokenised here, by basic tokens unless another tokeniser is given, which
    then runs in batches. Characters other than spaces are matched one to one by their
    number, whatever case they have; where the numbers differ, or pred is not found, the
    original is the answer. Nulls are empty.
    """
    pred, original = (F.coalesce(c, F.lit("")) for c in ("pred", "original"))
    tokens = F.array_join(F.regexp_extract_all(F.lower(original), F.lit(TOKEN), 0), " ")
    if tokenise:

        @F.pandas_udf("string")
        def tokenised(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: " ".join(tokenise(t)))

        tokens = tokenised(original)
    formed = F.struct(pred.alias("p"), original.alias("o"), tokens.alias("t"), _inked(original).alias("a"))
    # Behind an explode, so that each is formed once.
    staged = rows.withColumn("__x", F.explode_outer(F.array(formed))).withColumn("__b", F.explode_outer(F.array(_inked(F.col("__x.t")))))
    x = F.col("__x")
    at = F.position(x["p"], x["t"]) - 1
    place = lambda i: F.get(x["a"], (F.array_position("__b", i) - 1).cast("int"))
    first, last = place(at), place(at + F.length(x["p"]) - 1)
    met = (at >= 0) & (F.length(x["p"]) > 0) & (F.size(x["a"]) == F.size("__b")) & first.isNotNull() & last.isNotNull()
    return staged.withColumn("final", F.when(met, F.substr(x["o"], first + 1, last - first + 1)).otherwise(x["o"])).drop("__x", "__b")


def best_threshold_with_answered(scores: DataFrame, score: str) -> DataFrame:
    """best_threshold, and the mean score, of 1, of the answerable questions."""
    has = scores.agg(F.round(F.avg(F.when(F.col("has_answer"), F.col(score))), 6).alias("has_answer_score"))
    return best_threshold(scores, score).join(F.broadcast(has))


def all_best_thresholds(scores: DataFrame) -> DataFrame:
    """One row of best_exact, best_exact_thresh, best_f1, best_f1_thresh."""
    return best_thresholds(scores, ["exact", "f1"])


def all_best_thresholds_with_answered(scores: DataFrame) -> DataFrame:
    """all_best_thresholds, with has_ans_exact and has_ans_f1."""
    means = [F.round(F.avg(F.when(F.col("has_answer"), F.col(c))), 6).alias(f"has_ans_{c}") for c in ("exact", "f1")]
    return all_best_thresholds(scores).join(F.broadcast(scores.agg(*means)))
