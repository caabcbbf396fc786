"""Retrieval, ranking, fusion, reading and voting over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions import text as tx
from answerloom.operators import ranking, vectors, voting
from answerloom.operators.block_index import BlockIndex
from answerloom.operators.cells import CellIndex
from answerloom.operators.contexts import hit_contexts, with_contents
from answerloom.operators.index import BM25Index
from answerloom.plans import pipelines
from answerloom.plans.registry import SQL, minmax, query, steps, strip, table, words, zero_below
from answerloom.plans.text_queries import GRAM_COLUMNS, LINES, PASSAGES, sql_cases, sql_overlap, sql_tokens
from answerloom.sources.shared import new_path

HITS, BEST = pipelines.DOCUMENTS_2, pipelines.PASSAGES_A_DOCUMENT
DEEP = pipelines.DOCUMENTS_1


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


#: Bytes of the documents' file whose terms one task counts; it holds some forty times as much in memory.
INDEX_TASK = 8 << 20


def index(spark: SparkSession, sf_dir: str) -> BM25Index:
    return BM25Index.build(table(spark, sf_dir, "documents", INDEX_TASK))


TERMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
INDEX = f"""lens AS (SELECT doc_id, len({TERMS.format('text')}) AS dl FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens)"""


def hits(question: str, k: int) -> str:
    """CTEs up to hits(qid, doc_id, score, rank) for a question expression."""
    return f"""{INDEX},
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({TERMS.format(question)}) AS term FROM benchmark) GROUP BY qid, term),
scored AS (SELECT qid, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 0.9::DOUBLE * (1 - 0.4::DOUBLE + 0.4::DOUBLE * dl / avgdl))), 6) AS score
  FROM asked JOIN dfs USING (term) JOIN postings USING (term) JOIN lens USING (doc_id) CROSS JOIN stats GROUP BY qid, doc_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k})"""


@query(f"WITH {INDEX} SELECT term, df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM postings JOIN dfs USING (term) GROUP BY term, df")
def bm25_postings(spark, sf_dir):
    i = index(spark, sf_dir)
    return i.postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")
    )


@query(f"WITH {INDEX} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM dfs) AS terms FROM stats")
def bm25_stats(spark, sf_dir):
    i = index(spark, sf_dir)
    return i.stats.join(F.broadcast(i.terms.agg(F.count("*").alias("terms")))).withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {hits('text', HITS)} SELECT qid, doc_id, score, rank FROM hits")
def bm25_top10(spark, sf_dir):
    return index(spark, sf_dir).search(questions(spark, sf_dir), HITS)


@query(SQL["bm25_top10"])
def bm25_blocks(spark, sf_dir):
    """The same search over bucketed tables of posting blocks, opening few of them."""
    name = f"postings_{uuid.uuid4().hex}"
    saved = BlockIndex.save(index(spark, sf_dir), name, new_path(spark))
    return saved.search(questions(spark, sf_dir), HITS)


QUESTION_CLEAN = steps("text", tx.PREPROCESS)
PASSAGES_OF_HITS = f"""
cut AS (SELECT qid, doc_id, unnest({PASSAGES}) AS passage FROM hits JOIN documents USING (doc_id)),
p AS (SELECT qid, doc_id, passage, {GRAM_COLUMNS} FROM (SELECT qid, doc_id, passage, {sql_cases('toks')} FROM (SELECT qid, doc_id, passage, {sql_tokens('passage')} AS toks FROM cut))),
q AS (SELECT qid, {GRAM_COLUMNS} FROM (SELECT qid, {sql_cases('toks')} FROM (SELECT item_id AS qid, {sql_tokens('text')} AS toks FROM benchmark))),
rated AS (SELECT p.qid, doc_id, passage, {sql_overlap('q', 'p')} AS score FROM p JOIN q ON p.qid = q.qid),
per_doc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, passage DESC) AS rank FROM rated) WHERE rank <= {BEST}),
best AS (SELECT * FROM (SELECT qid, doc_id, passage, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, passage DESC, doc_id) AS rank FROM per_doc) WHERE rank <= 50)"""
PASSAGE_CTES = f"{hits(QUESTION_CLEAN, DEEP)},{PASSAGES_OF_HITS}"
FEW_CTES = f"{hits(QUESTION_CLEAN, HITS)},{PASSAGES_OF_HITS}"


def passages(spark: SparkSession, sf_dir: str, k: int = DEEP) -> DataFrame:
    asked = questions(spark, sf_dir)
    cleaned = asked.select("qid", tx.preprocess_text(F.col("question")).alias("question"))
    found = index(spark, sf_dir).search(cleaned, k)
    return pipelines.ranked_passages(asked, table(spark, sf_dir, "documents"), found)


@query(f"WITH {PASSAGE_CTES} SELECT qid, doc_id, passage, score, rank FROM per_doc")
def passage_top5_per_doc(spark, sf_dir):
    return passages(spark, sf_dir)


@query(f"WITH {PASSAGE_CTES} SELECT qid, doc_id, passage, score, rank FROM best")
def passage_top50(spark, sf_dir):
    return pipelines.best_passages(passages(spark, sf_dir))


@query(f"WITH {FEW_CTES} SELECT qid, doc_id, passage, score, rank FROM best WHERE rank <= {BEST}")
def answer_passages(spark, sf_dir):
    """The entry slice: few documents, few passages."""
    return pipelines.best_passages(passages(spark, sf_dir, HITS), BEST)


# reading and voting


def reading(source: str, keys: str) -> str:
    """SELECT of keys, question, answer, reader_raw from rows of (keys, question, passage)."""
    capital = "regexp_matches(given[i + 1], '^\\p{Lu}') AND NOT list_contains(asked, lower(given[i + 1]))"
    named = f"list_transform(list_filter(range(len(given)), lambda i: {capital}), lambda i: {{'n': length(given[i + 1]), 'at': -i, 'word': given[i + 1]}})"
    word = f"coalesce(list_sort({named}, 'DESC')[1].word, '')"
    return f"""SELECT {keys}, question, {strip(steps(word, tx.ANSWER_CLEANUP))} AS answer,
  round(coalesce(len(list_intersect(list_distinct(asked), list_distinct(low)))::DOUBLE / nullif(len(list_distinct(asked)), 0), 0.0), 6) AS reader_raw
  FROM (SELECT *, {words('lower(question)')} AS asked, {words('passage')} AS given, {words('lower(passage)')} AS low FROM {source})"""


VOTE_CTES = f"""{PASSAGE_CTES},
reads AS ({reading('(SELECT best.*, benchmark.text AS question FROM best JOIN benchmark ON qid = item_id)', 'qid, rank')}),
good AS (SELECT qid, answer, reader_raw AS score, rank AS ord FROM reads WHERE reader_raw >= 0.1 AND answer NOT IN ('kiêm', 'Quỳnh') AND answer <> ''
  AND (NOT contains(question, 'bao nhiêu') OR regexp_matches(answer, '\\p{{Nd}}'))),
votes AS (SELECT qid, answer, count(*) AS votes, max(score) AS score, min(ord) AS ord FROM good GROUP BY qid, answer),
contained AS (SELECT a.qid, a.answer AS part, b.answer AS whole, b.ord AS whole_ord FROM votes a JOIN votes b ON a.qid = b.qid AND a.answer <> b.answer AND contains(b.answer, a.answer)),
maximal AS (SELECT v.* FROM votes v WHERE NOT EXISTS (SELECT 1 FROM contained i WHERE i.qid = v.qid AND i.part = v.answer)),
targets AS (SELECT qid, part, whole FROM (SELECT i.qid, i.part, i.whole, row_number() OVER (PARTITION BY i.qid, i.part ORDER BY i.whole_ord) AS r
  FROM contained i JOIN maximal m ON m.qid = i.qid AND m.answer = i.whole) WHERE r = 1),
merged AS (SELECT v.qid, coalesce(t.whole, v.answer) AS answer, sum(v.votes)::BIGINT AS votes, max(v.score) AS score, min(CASE WHEN t.whole IS NULL THEN v.ord END) AS ord
  FROM votes v LEFT JOIN targets t ON t.qid = v.qid AND t.part = v.answer GROUP BY v.qid, coalesce(t.whole, v.answer)),
top AS (SELECT qid, answer, votes, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, score DESC, ord) AS r FROM merged) WHERE r = 1)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, answer, score, ord) that pass the filters."""
    best = pipelines.best_passages(passages(spark, sf_dir))
    read = pipelines.LexicalReader().predict(best.join(questions(spark, sf_dir), "qid"))
    good = read.filter(voting.acceptable(F.col("question"), F.col("answer"), F.col("reader_raw")))
    return good.select("qid", "answer", F.col("reader_raw").alias("score"), F.col("rank").alias("ord"))


@query(f"WITH {VOTE_CTES} SELECT * FROM good")
def answer_filters(spark, sf_dir):
    return answers(spark, sf_dir)


@query(f"WITH {VOTE_CTES} SELECT * FROM votes")
def answer_vote(spark, sf_dir):
    return voting.vote(answers(spark, sf_dir))


@query(f"WITH {VOTE_CTES} SELECT * FROM merged")
def answer_substring_merge(spark, sf_dir):
    return voting.merge_substrings(voting.vote(answers(spark, sf_dir)))


@query(f"WITH {VOTE_CTES} SELECT qid, answer, votes, score FROM top")
def answer_pipeline_m1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pipelines.extract_answers(questions(spark, sf_dir), docs, index(spark, sf_dir))


@query(f"WITH {VOTE_CTES} SELECT qid, answer, sum(score) AS sum_score, max(score) AS max_score, list(answer ORDER BY ord) AS sentences, min(answer) AS text FROM good GROUP BY qid, answer")
def voted_answers(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumns({"sentence": F.col("answer"), "text": F.col("answer")})
    return voting.voted_answers(rows)


VOTE_KEY = steps("lower(answer)", tx.VOTE_NORM)


@query(f"WITH {VOTE_CTES} SELECT qid, ord, array_to_string({words(VOTE_KEY)}, ' ') AS wording FROM good")
def vote_wording(spark, sf_dir):
    return answers(spark, sf_dir).select("qid", "ord", voting.vote_key(F.col("answer")).alias("wording"))


def sql_majority() -> str:
    """CTEs from good(qid, answer, ord) to a query of (qid, place, answer): the fold as a recursion over candidates."""
    weights = list(voting.VOTE_WEIGHTS)
    k, size = len(weights), "len(string_split({}, ' '))".format
    grams = "list_transform(range(1, length({0}) - n + 2), lambda c: substr({0}, c, n))".format
    x, y = grams("x.wording"), grams("groups[g + 1].head")
    share = f"coalesce(2.0 * len(list_filter({x}, lambda p: list_contains({y}, p))) / nullif(len({x}) + len({y}), 0), 0)"
    alone = "{'head': x.wording, 'weight': x.weight, 'members': [member]}"
    grown = "{'head': groups[g + 1].head, 'weight': groups[g + 1].weight + x.weight, 'members': list_append(groups[g + 1].members, member)}"
    mean = "ceil(list_avg(list_transform({0}, lambda m: m.size)))".format
    return f"""firsts AS (SELECT qid, list(answer ORDER BY ord) AS given FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord) AS r FROM good) WHERE r <= {k} GROUP BY qid HAVING count(*) = {k}),
sized AS (SELECT qid, given, list_transform(given, lambda c: {size('c')}) AS sizes, list_transform(given, lambda answer: {VOTE_KEY}) AS wordings FROM firsts),
cases AS (SELECT qid, (CASE WHEN list_sum(sizes) < {2 * k} THEN 1 ELSE ceil(list_median(sizes)) END)::BIGINT AS n,
  list_filter(list_transform(range({k}), lambda i: {{'place': i, 'answer': given[i + 1], 'wording': wordings[i + 1], 'size': sizes[i + 1], 'weight': {weights}[i + 1]::DOUBLE}}), lambda x: x.wording <> '') AS clean FROM sized),
held AS (SELECT *, len(list_filter(clean[2:], lambda x: x.wording = clean[1].wording)) > 0 AS again,
  list_filter(list_transform(range(1, len(clean)), lambda i: {{'place': i, 'wording': clean[i + 1].wording, 'size': {size('clean[i + 1].wording')}}}), lambda x: contains(x.wording, clean[1].wording)) AS holding
  FROM cases WHERE len(clean) > 0),
folded AS (SELECT qid, 0 AS i, []::STRUCT(head VARCHAR, weight DOUBLE, members STRUCT(place BIGINT, answer VARCHAR, size BIGINT)[])[] AS groups FROM held
  UNION ALL SELECT qid, i + 1, CASE WHEN hit IS NOT NULL THEN list_transform(range(len(groups)), lambda g: CASE WHEN g = hit THEN {grown} ELSE groups[g + 1] END)
    WHEN len(list_filter(groups, lambda g: g.head = x.wording)) > 0 THEN list_transform(groups, lambda g: CASE WHEN g.head = x.wording THEN {alone} ELSE g END)
    ELSE list_append(groups, {alone}) END
  FROM (SELECT *, {{'place': x.place, 'answer': x.answer, 'size': x.size}} AS member, list_min(list_filter(range(len(groups)), lambda g: {share} >= {voting.VOTE_THRESHOLD})) AS hit
    FROM (SELECT folded.*, n, clean[i + 1] AS x FROM folded JOIN held USING (qid) WHERE i < len(clean)))),
led AS (SELECT qid, list_filter(groups, lambda g: g.weight = list_max(list_transform(groups, lambda h: h.weight)))[1].members AS best FROM folded JOIN held USING (qid) WHERE i = len(clean)),
middles AS (SELECT qid, best, list_filter(best, lambda m: m.size = {mean('best')})[1] AS middle FROM led)
SELECT qid, (CASE WHEN again THEN coalesce(list_filter(holding, lambda x: x.size > {mean('holding')})[1].place, 0) ELSE coalesce(middle.place, 0) END)::BIGINT AS place,
  CASE WHEN again THEN clean[1].answer ELSE coalesce(middle.answer, best[1].answer) END AS answer FROM held JOIN middles USING (qid)"""


@query(f"WITH RECURSIVE {VOTE_CTES}, {sql_majority()}")
def majority_vote(spark, sf_dir):
    return voting.majority_vote(answers(spark, sf_dir))


@query(f"WITH {VOTE_CTES} SELECT qid, answer, score, ord, round(0.3::DOUBLE * score + 0.7::DOUBLE * s, 9) AS total_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY 0.3::DOUBLE * score + 0.7::DOUBLE * s DESC, ord) AS r FROM (SELECT *, 1.0::DOUBLE / ord AS s FROM good)) WHERE r = 1")
def best_answer(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("ctx_score", F.lit(1.0) / F.col("ord"))
    return ranking.best_answer(rows, ["qid"], 0.3).drop("ctx_score").withColumn("total_score", F.round("total_score", 9))


@query(f"WITH {VOTE_CTES} SELECT qid, answer, round(s, 9) AS score, ord FROM (SELECT *, 0.5::DOUBLE / ord + 0.5::DOUBLE * score AS s, row_number() OVER (PARTITION BY qid ORDER BY 0.5::DOUBLE / ord + 0.5::DOUBLE * score DESC, ord) AS r FROM good) WHERE r = 1")
def chosen_answer(spark, sf_dir):
    """Best answer by a scorer brought along: half its passage's place, half its own score."""
    scorer = lambda rows: ranking.weighted_score(1.0 / rows["ord"], rows["score"])
    got = ranking.choose_best(answers(spark, sf_dir), ["qid"], scorer)
    return got.withColumn("score", F.round("score", 9))


# fusion

FUSED_CTES = f"""{hits("CASE WHEN ends_with(text, '?') OR text = '' THEN text ELSE text || ' ?' END", HITS)},
ranked AS (SELECT qid, doc_id, rank, round({minmax('score', 'qid')}, 6) AS rank_score FROM hits),
cut AS (SELECT qid, doc_id, rank, rank_score, unnest(range(len(x))) AS pos, unnest(x) AS passage FROM (SELECT qid, doc_id, rank, rank_score, {LINES} AS x FROM ranked JOIN documents USING (doc_id))),
with_q AS (SELECT cut.*, CASE WHEN ends_with(text, '?') OR text = '' THEN text ELSE text || ' ?' END AS question FROM cut JOIN benchmark ON qid = item_id),
reads AS ({reading('with_q', 'qid, doc_id, rank, pos, passage, rank_score')}),
bags AS (SELECT *, {words('lower(question)')} AS a, {words('lower(passage)')} AS b FROM reads),
sims AS (SELECT * EXCLUDE (a, b), round(coalesce(list_sum(list_transform(list_distinct(a || b), lambda w: (len(list_filter(a, lambda t: t = w)) * len(list_filter(b, lambda t: t = w)))::DOUBLE))
  / nullif(sqrt(list_sum(list_transform(list_distinct(a), lambda w: len(list_filter(a, lambda t: t = w))::DOUBLE ** 2))) * sqrt(list_sum(list_transform(list_distinct(b), lambda w: len(list_filter(b, lambda t: t = w))::DOUBLE ** 2))), 0), 0.0), 6) AS sim_raw FROM bags),
normed AS (SELECT *, {minmax('sim_raw', 'qid')} AS sim_n, {minmax('reader_raw', 'qid')} AS read_n FROM sims),
parts AS (SELECT *, round({zero_below('sim_n')}, 6) AS similarity, round({zero_below('read_n')}, 6) AS reader_score, round({zero_below('rank_score')}, 6) AS rank_zeroed FROM normed),
fused AS (SELECT *, round(0.6::DOUBLE * reader_raw + 0.2::DOUBLE * rank_zeroed + 0.2::DOUBLE * similarity, 6) AS fused FROM parts),
final AS (SELECT *, {minmax('fused', 'qid')} AS final_n FROM fused),
graded AS (SELECT *, round({zero_below('final_n')}, 6) AS score FROM final),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, pos, doc_id) AS place FROM graded) WHERE place <= 10)"""


@query(f"WITH {hits('text', HITS)} SELECT qid, doc_id, rank, score, round({minmax('score', 'qid')}, 6) AS rank_score FROM hits")
def minmax_rank(spark, sf_dir):
    found = bm25_top10(spark, sf_dir)
    return found.withColumn("rank_score", F.round(ranking.minmax(F.col("score"), ["qid"]), 6))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipelines.read_lines_of_hits(questions(spark, sf_dir), table(spark, sf_dir, "documents"), index(spark, sf_dir), HITS)
    return pipelines.fused_candidates(rows)


@query(f"WITH {FUSED_CTES} SELECT qid, doc_id, place AS rank, passage, answer, reader_raw, reader_score, rank_score, similarity, fused, score FROM top")
def score_fusion(spark, sf_dir):
    return fused(spark, sf_dir).select(
        "qid", "doc_id", "rank", "passage", "answer", "reader_raw", "reader_score", "rank_score", "similarity", "fused", "score"
    )


# vectors

CENTROIDS = (
    "(SELECT label AS qid, list(m ORDER BY pos) AS q FROM (SELECT label, pos, round(avg(x), 9) AS m FROM "
    "(SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, pos) GROUP BY label)"
)


@query(
    f"SELECT qid, vec_id, score, rank FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM "
    f"(SELECT qid, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM {CENTROIDS} CROSS JOIN embeddings)) WHERE rank <= 10"
)
def vector_topk(spark, sf_dir):
    """The ten vectors nearest to the mean of each label."""
    e = table(spark, sf_dir, "embeddings")
    return vectors.dense_top_k(label_means(e), e, 10)


@query(SQL["vector_topk"])
def vector_cells(spark, sf_dir):
    """The same search over cells, made exact by their bounds."""
    e = table(spark, sf_dir, "embeddings")
    return CellIndex.save(e, new_path(spark)).search(label_means(e), 10, exact=True)


@query(
    f"SELECT qid, vec_id AS title, text, score FROM ({SQL['vector_topk']}) JOIN documents ON doc_id = vec_id WHERE NOT contains(text, ' ein ')"
)
def dense_contexts(spark, sf_dir):
    """Texts of dense hits from a store of JSON documents; those that hold a blacklisted word are left out."""
    hits = vector_topk(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    store = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.col("text").alias("contents"))).alias("raw"))
    return hit_contexts(with_contents(hits, store), [" ein "])


def label_means(e: DataFrame) -> DataFrame:
    parts = e.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    return parts.groupBy(F.col("label").alias("qid")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("q")
    )


@query(
    "WITH m AS (SELECT event_id, user_id, exp(value - max(value) OVER (PARTITION BY user_id)) AS e FROM events) "
    "SELECT event_id, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS p FROM m"
)
def softmax(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(ranking.softmax(F.col("value"), ["user_id"]), 6).alias("p"))
