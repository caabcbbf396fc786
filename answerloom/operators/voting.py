"""Answer filters, votes and merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.functions.text import vote_norm, words
from answerloom.operators.ranking import top_k

# What an answer must not be, and the phrase that asks for a number.
BLACKLIST = ("kiêm", "Quỳnh")
HOW_MANY = "bao nhiêu"
LEAST_SCORE = 0.1
VOTE_WEIGHTS = (4, 2, 2, 2, 2, 1, 1, 1, 1, 1)
VOTE_THRESHOLD = 0.5


def acceptable(question: Column, answer: Column, score: Column) -> Column:
    """Scored high enough, not blacklisted nor empty, a number where one is asked for."""
    return (
        (score >= LEAST_SCORE)
        & ~answer.isin(*BLACKLIST)
        & (answer != "")
        & (~question.contains(HOW_MANY) | answer.rlike(r"\p{Nd}"))
    )


def vote(answers: DataFrame) -> DataFrame:
    """(qid, answer, votes, score, ord) from (qid, answer, score, ord): one row an answer."""
    return answers.groupBy("qid", "answer").agg(
        F.count("*").alias("votes"), F.max("score").alias("score"), F.min("ord").alias("ord")
    )


def merge_substrings(votes: DataFrame) -> DataFrame:
    """Votes of contained answers go to the first-seen maximal answer that contains them.

    A maximal answer has no proper superstring among its question's answers. The
    self-join stays inside a question, whose answers are as few as its passages.
    """
    a = votes.select("qid", F.col("answer").alias("part"))
    b = votes.select(F.col("qid").alias("q2"), F.col("answer").alias("whole"), F.col("ord").alias("whole_ord"))
    inside = a.join(
        b, (F.col("qid") == F.col("q2")) & (F.col("part") != F.col("whole")) & F.col("whole").contains(F.col("part"))
    ).drop("q2")
    maximal = votes.join(inside.select("qid", F.col("part").alias("answer")).distinct(), ["qid", "answer"], "left_anti")
    targets = inside.join(
        maximal.select("qid", F.col("answer").alias("whole")), ["qid", "whole"], "left_semi"
    )
    first = top_k(targets, ["qid", "part"], [F.asc("whole_ord")], 1).select("qid", F.col("part").alias("answer"), "whole")
    return (
        votes.join(first, ["qid", "answer"], "left")
        .groupBy("qid", F.coalesce("whole", "answer").alias("answer"))
        .agg(
            F.sum("votes").alias("votes"), F.max("score").alias("score"),
            F.min(F.when(F.col("whole").isNull(), F.col("ord"))).alias("ord"),
        )
    )


def best_voted(votes: DataFrame) -> DataFrame:
    """Most votes, then highest score, then first seen."""
    return top_k(votes, ["qid"], [F.desc("votes"), F.desc("score"), F.asc("ord")], 1).drop("rank")


def voted_answers(answers: DataFrame, mode: str = "vote") -> DataFrame:
    """origin: as they are; ext_origin: those of the first list (list_no 0); else grouped."""
    if mode == "origin":
        return answers
    if mode == "ext_origin":
        return answers.filter("list_no = 0")
    sentences = F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence"))), lambda x: x["sentence"])
    return answers.groupBy("qid", "answer").agg(
        F.sum("score").alias("sum_score"), F.max("score").alias("max_score"),
        sentences.alias("sentences"), F.min_by("text", "ord").alias("text"),
    )


def ordered_distinct(df: DataFrame, by: Sequence[str], value: str, ord: str = "ord") -> DataFrame:
    """First row of each value within its group."""
    w = Window.partitionBy(*by, value).orderBy(ord)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


GROUPS = "array<struct<head: string, weight: double, members: array<struct<place: int, answer: string, size: int>>>>"


def _size(text: Column) -> Column:
    """Words as single spaces part them."""
    return F.size(F.split(text, " "))


def _grams(text: Column, n: Column) -> Column:
    last = F.length(text) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, n))).otherwise(F.array().cast("array<string>"))


def gram_match(a: Column, b: Column, n: Column) -> Column:
    """Share of a's n-grams that b has, of the mean number of both; 0 where neither has any."""
    pair = F.struct(_grams(a, n).alias("x"), _grams(b, n).alias("y"))
    both = lambda p: F.try_divide(
        2.0 * F.size(F.filter(p["x"], lambda g: F.array_contains(p["y"], g))), F.size(p["x"]) + F.size(p["y"])
    )
    return F.coalesce(F.get(F.transform(F.array(pair), both), 0), F.lit(0.0))


def _ceil_mean(xs: Column) -> Column:
    return F.ceil(F.aggregate(xs, F.lit(0), lambda s, x: s + x) / F.size(xs))


def _first_where(xs: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(xs, test), 0)


def _leaders(clean: Column, n: Column, threshold: float) -> Column:
    """Candidates folded, in order, into groups under the first leader that each matches."""

    def join(groups: Column, x: Column) -> Column:
        member = F.struct(x["place"].alias("place"), x["answer"].alias("answer"), x["size"].alias("size"))
        alone = F.struct(x["wording"].alias("head"), x["weight"].alias("weight"), F.array(member).alias("members"))
        places = F.transform(groups, lambda g, i: F.when(gram_match(x["wording"], g["head"], n) >= threshold, i))
        at = F.array_min(F.array_compact(places))
        grown = F.transform(
            groups,
            lambda g, i: F.when(
                i == at,
                F.struct(g["head"].alias("head"), (g["weight"] + x["weight"]).alias("weight"), F.array_append(g["members"], member).alias("members")),
            ).otherwise(g),
        )
        # A wording too short to match even itself starts its group anew.
        again = F.transform(groups, lambda g: F.when(g["head"] == x["wording"], alone).otherwise(g))
        known = F.exists(groups, lambda g: g["head"] == x["wording"])
        return F.when(at.isNotNull(), grown).when(known, again).otherwise(F.array_append(groups, alone)).cast(GROUPS)

    return F.aggregate(clean, F.array().cast(GROUPS), join)


def majority_vote(
    answers: DataFrame, weights: Sequence[float] = VOTE_WEIGHTS, threshold: float = VOTE_THRESHOLD, ngram: int | None = None
) -> DataFrame:
    """(qid, place, answer) that most of each question's first answers, by ord, agree on.

    As many answers as there are weights are asked; a question with fewer, or without any
    that holds a letter, digit or space, has no vote. Words are what single spaces part.
    If the first wording comes again, word for word, the place is that of the first of
    those holding it that is longer than their mean, else 0. Otherwise each answer joins
    the first leader that it shares enough n-grams with; of the heaviest group the first
    member of mean length, rounded up, is taken, with its place among all answers, else
    the leader with place 0. n is the median number of words, but 1 where their mean is
    below 2. Answers are cut to as many as weights before they are brought together, so a
    question's fold is of that size.
    """
    k = len(weights)
    first = top_k(answers.select("qid", "answer", "ord"), ["qid"], [F.asc("ord")], k).drop("rank")
    rows = first.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", "answer"))).alias("given")).filter(F.size("given") == k)
    rows = rows.select("qid", F.transform("given", lambda x: x["answer"]).alias("given"))
    sizes = F.array_sort(F.transform("given", _size))
    middle = (F.get(sizes, (k - 1) // 2) + F.get(sizes, k // 2)) / 2
    n = F.when(F.aggregate(sizes, F.lit(0), lambda s, x: s + x) < 2 * k, 1).otherwise(F.lit(ngram) if ngram else F.ceil(middle))
    one = lambda c, i: F.struct(
        i.alias("place"), c.alias("answer"), vote_norm(c).alias("wording"), _size(c).alias("size"),
        F.get(F.array(*[F.lit(float(w)) for w in weights]), i).alias("weight"),
    )
    clean = F.filter(F.transform("given", one), lambda x: x["wording"] != "")
    # Formed once, behind an explode, and not again for every use below.
    rows = rows.select("qid", F.explode_outer(F.array(F.struct(n.cast("int").alias("n"), clean.alias("clean")))).alias("x"))
    rows = rows.select("qid", "x.*").filter(F.size("clean") > 0).withColumn("first", F.get("clean", 0))
    wording = F.col("first.wording")
    holding = F.filter(
        F.transform("clean", lambda x, i: F.struct(i.alias("place"), x["wording"].alias("wording"), _size(x["wording"]).alias("size"))),
        lambda x: (x["place"] > 0) & x["wording"].contains(wording),
    )
    again = F.exists("clean", lambda x: (x["place"] != F.col("first.place")) & (x["wording"] == wording))
    longer = _first_where(holding, lambda x: x["size"] > _ceil_mean(F.transform(holding, lambda y: y["size"])))["place"]
    chosen_type = "struct<place: int, answer: string>"
    repeated = F.struct(F.coalesce(longer, F.lit(0)).alias("place"), F.col("first.answer").alias("answer")).cast(chosen_type)
    groups = F.when(~again, _leaders(F.col("clean"), F.col("n"), threshold))
    rows = rows.select("qid", F.when(again, repeated).alias("repeated"), F.explode_outer(F.array(groups)).alias("groups"))
    heaviest = F.array_max(F.transform("groups", lambda g: g["weight"]))
    rows = rows.withColumn("best", _first_where(F.col("groups"), lambda g: g["weight"] == heaviest)["members"])
    mean = _ceil_mean(F.transform("best", lambda m: m["size"]))
    leader = F.struct(F.lit(0).alias("place"), F.get("best", 0)["answer"].alias("answer")).cast(chosen_type)
    middle_one = _first_where(F.col("best"), lambda m: m["size"] == mean)
    member = F.struct(middle_one["place"].alias("place"), middle_one["answer"].alias("answer")).cast(chosen_type)
    chosen = F.coalesce("repeated", F.when(middle_one.isNotNull(), member), leader)
    return rows.select("qid", chosen.alias("c")).select("qid", F.col("c.place").cast("long").alias("place"), "c.answer")


def vote_key(answer: Column) -> Column:
    """Normalised words of an answer, for grouping by wording alone."""
    return F.array_join(words(vote_norm(answer)), " ")
