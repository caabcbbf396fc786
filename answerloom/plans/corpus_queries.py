"""Corpus construction, links, classification and evaluation over whole tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerloom.functions import text as tx
from answerloom.functions.text import LINE_END
from answerloom.operators import classify, corpus, evaluate, links, voting
from answerloom.operators.contexts import link_position_map
from answerloom.operators.ranking import best_indexes
from answerloom.plans import pipelines
from answerloom.plans.answer_queries import index, questions
from answerloom.plans.registry import contains_any, normalized_answer, query, steps, strip, table, text, words
from answerloom.sources.readers import flatten_squad
from answerloom.sources.shared import numbered
from answerloom.sources.writers import submission

ANCHOR = '<a href="/([^"]*)">([^<]*)</a>'
WIKI = f"""w AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_replace(html, '{ANCHOR}', '[[wiki/\\1|\\2 page]]', 'g') AS text FROM pages)"""
EDGES = f"""{WIKI},
inner_links AS (SELECT page_id, title, unnest(range(len(x))) AS place, unnest(x) AS body FROM (SELECT page_id, title, regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1) AS x FROM w)),
edges AS (SELECT {strip("substr(body, strpos(body, '|') + 1)")} AS label, rtrim(substr(body, 1, strpos(body, '|') - 1), ' ') AS link, title AS source_title, place::BIGINT AS place, page_id
  FROM inner_links WHERE strpos(body, '|') > 1 AND starts_with(body, 'wiki/'))"""
DICTIONARY = f"""{EDGES},
titles AS (SELECT title, row_number() OVER (ORDER BY title) AS ord FROM (SELECT DISTINCT substr(link, 6) AS title FROM edges)),
own AS (SELECT title, ord, 'wiki/' || replace(title, ' ', '_') AS link FROM titles),
met AS (SELECT label, source_title, edges.link, ord, place FROM edges JOIN own ON edges.link = own.link),
pairs AS (SELECT label, source_title, arg_max(link, ord * 100000 + place) AS link, min(ord * 100000 + place) AS f FROM met GROUP BY label, source_title),
dictionary AS (SELECT label, source_title, link, (f // 100000)::BIGINT AS ord, (f % 100000)::BIGINT AS place FROM pairs WHERE label NOT IN (SELECT title FROM own)
  UNION ALL SELECT title, 'wiki', link, ord, 0 FROM own)"""


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as (page_id, title, text) with their anchors in wiki syntax."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.regexp_replace("html", ANCHOR, "[[wiki/$1|$2 page]]").alias("text"),
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = link_edges(spark, sf_dir).select(F.substr("link", F.lit(6)).alias("title")).distinct()
    return numbered(t, ["title"])


@query(f"WITH {EDGES} SELECT label, link, source_title, place FROM edges")
def link_edges(spark, sf_dir):
    return corpus.link_edges(wiki(spark, sf_dir))


@query(f"WITH {DICTIONARY} SELECT label, source_title, link, ord, place FROM dictionary")
def link_dictionary(spark, sf_dir):
    return links.link_dictionary(titles(spark, sf_dir), link_edges(spark, sf_dir))


@query(
    f"WITH {DICTIONARY}, asked AS (SELECT page_id * 1000000000 + place AS qid, label, source_title AS page_title FROM edges) "
    "SELECT qid, label, page_title, link FROM (SELECT a.*, d.link, row_number() OVER (PARTITION BY qid ORDER BY "
    "CASE WHEN d.source_title = page_title THEN 0 WHEN d.source_title = 'wiki' THEN 1 ELSE 2 END, d.ord, d.place, d.source_title) AS r "
    "FROM asked a LEFT JOIN dictionary d ON d.label = a.label) WHERE r = 1"
)
def link_resolve(spark, sf_dir):
    w = wiki(spark, sf_dir).withColumn("title", F.concat_ws("\x01", "page_id", "title"))
    split = F.split("source_title", "\x01")
    key = F.struct(split[0].cast("long").alias("page_id"), "place").alias("qid")
    asked = corpus.link_edges(w).select(key, "label", split[1].alias("page_title"))
    found = links.resolve_links(asked, link_dictionary(spark, sf_dir))
    return found.withColumn("qid", F.col("qid.page_id") * 1000000000 + F.col("qid.place"))


@query(f"WITH {DICTIONARY} SELECT DISTINCT label FROM dictionary")
def label_list(spark, sf_dir):
    return link_dictionary(spark, sf_dir).select("label").distinct()


@query(
    f"WITH {WIKI} SELECT page_id, regexp_replace(regexp_replace(text, '\\[\\[([^\\]|]+)\\|([^\\]]*)\\]\\]', '\\2', 'g'), '\\[\\[([^\\]|]+)\\]\\]', '\\1', 'g') AS plain FROM w"
)
def plain_links(spark, sf_dir):
    return wiki(spark, sf_dir).select("page_id", corpus.plain_links(F.col("text")).alias("plain"))


POSITIONS = f"""WITH RECURSIVE {WIKI}, b AS (SELECT page_id, text, regexp_extract_all(text, '\\[\\[([^\\]]+)\\]\\]', 1) AS bodies FROM w),
r AS (SELECT page_id, 0 AS i, text AS plain, []::STRUCT(link VARCHAR, first BIGINT, label VARCHAR)[] AS links FROM b
  UNION ALL SELECT page_id, i + 1, replace(replace(plain, '[[' || body || ']]', label), body, label), list_append(links, {{'link': link,
    'first': CASE WHEN hit > 0 THEN length(substr(plain, 1, hit - 1)) - length(replace(substr(plain, 1, hit - 1), ' ', '')) ELSE -1 END, 'label': label}})
  FROM (SELECT *, strpos(plain, '[[' || body || ']]') AS hit, split_part(body, '|', 1) AS link,
    CASE WHEN contains(body, '|') THEN substr(body, strpos(body, '|') + 1) ELSE body END AS label
    FROM (SELECT r.*, bodies[i + 1] AS body FROM r JOIN b USING (page_id) WHERE i < len(bodies)))),
found AS (SELECT page_id, plain, unnest(links) AS x, unnest(range(len(links))) AS place FROM r JOIN b USING (page_id) WHERE i = len(bodies))"""
LAST_WORD = "CASE WHEN x.first < 0 THEN -1 ELSE x.first + length(x.label) - length(replace(x.label, ' ', '')) END"


@query(f"{POSITIONS} SELECT page_id AS id, plain, place, x.link AS link, x.first AS first_word, {LAST_WORD} AS last_word FROM found")
def link_positions(spark, sf_dir):
    found = corpus.link_positions(wiki(spark, sf_dir), "page_id").select("id", "plain", F.posexplode("links").alias("place", "x"))
    return found.select("id", "plain", F.col("place").cast("long").alias("place"), "x.link", F.col("x.start").alias("first_word"), F.col("x.end").alias("last_word"))


@query(
    f"{POSITIONS} SELECT title, page_id::VARCHAR AS line, x.link AS link, arg_max(x.first, place) AS first_word, arg_max({LAST_WORD}, place) AS last_word "
    "FROM found JOIN w USING (page_id) GROUP BY ALL"
)
def link_map(spark, sf_dir):
    """The map from title to line, link and place, read back; a page is a line of its title."""
    pages = wiki(spark, sf_dir)
    at = corpus.link_positions(pages, "page_id").join(pages.select(F.col("page_id").alias("id"), "title"), "id")
    lines = link_position_map(at.select("title", F.col("id").alias("line"), "links"))
    found = lines.select("title", F.explode("lines").alias("line", "found")).select("title", "line", F.explode("found").alias("link", "place"))
    return found.select("title", "line", "link", F.col("place.start").alias("first_word"), F.col("place.end").alias("last_word"))


@query(
    f"WITH {WIKI} SELECT page_id, '[[wiki/' || upper(substr(t, 1, 1)) || substr(t, 2) || '|x]]' AS link FROM "
    f"(SELECT page_id, replace({strip('replace(title, chr(58), chr(32))')}, ' ', '_') AS t FROM w)"
)
def internal_link(spark, sf_dir):
    return wiki(spark, sf_dir).select(
        "page_id", corpus.internal_link(F.replace("title", F.lit(":"), F.lit(" ")), F.lit("x"), tx.one_capital).alias("link")
    )


@query(
    "WITH t AS (SELECT regexp_extract(html, '<title>(.*?)</title>', 1) AS v FROM pages) "
    f"SELECT {strip('v')} AS title FROM t WHERE NOT contains(v, '(định hướng)') AND NOT contains(v, '(Định hướng)')"
)
def titles_filtered(spark, sf_dir):
    return corpus.keep_titles(wiki(spark, sf_dir))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def src_dedupe_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return corpus.dedupe_last(e, "user_id", "event_id")


SECTIONED = """conv AS (SELECT conv_id, 'c' || conv_id AS title, 'Lead of ' || conv_id || chr(10) || string_agg(CASE WHEN role = 'user' THEN '==' || role || turn || '==' ELSE '===' || role || '===' END || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


def sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages: user turns are sections, answers their subsections."""
    c = table(spark, sf_dir, "conversations")
    head = F.when(F.col("role") == "user", F.concat(F.lit("=="), "role", F.col("turn").cast("string"), F.lit("=="))).otherwise(
        F.concat(F.lit("==="), "role", F.lit("==="))
    )
    parts = c.select("conv_id", "turn", F.concat(head, F.lit("\n"), "text").alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n")
    name = F.col("conv_id").cast("string")
    return parts.groupBy("conv_id").agg(body.alias("body")).select(
        "conv_id", F.concat(F.lit("c"), name).alias("title"), F.concat(F.lit("Lead of "), name, F.lit("\n"), "body").alias("text")
    )


SQL_LINES = f"list_filter(list_transform(regexp_split_to_array(text, {text(LINE_END)}), lambda x: {strip('x')}), lambda x: x <> '')"
SECTION_LINES = f"""{SECTIONED},
ls AS (SELECT conv_id, title, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT conv_id, title, {SQL_LINES} AS x FROM conv)),
lv AS (SELECT *, CASE WHEN starts_with(line, '=') THEN (length(line) - length(replace(line, '=', ''))) // 2 END AS own FROM ls),
sec AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS level, sum(CASE WHEN own = 2 THEN 1 ELSE 0 END) OVER w AS section FROM lv WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
sub AS (SELECT *, sum(CASE WHEN own = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, section ORDER BY pos ROWS UNBOUNDED PRECEDING) AS subsection FROM sec)"""


@query(f"WITH {SECTION_LINES} SELECT conv_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level IS NULL), '') AS lead FROM sub GROUP BY conv_id")
def context_lead(spark, sf_dir):
    return sectioned(spark, sf_dir).select("conv_id", corpus.lead(F.col("text")).alias("lead"))


@query(
    f"""WITH {SECTION_LINES},
heads AS (SELECT conv_id, section, {strip("replace(line, '=', '')")} AS section_title FROM sub WHERE own = 2),
parts AS (SELECT conv_id, title, section, CASE WHEN level = 2 THEN 0 ELSE subsection END AS s, coalesce(string_agg(line || ' ', '' ORDER BY pos) FILTER (WHERE own IS NULL), '') AS content
  FROM sub WHERE level IN (2, 3) GROUP BY conv_id, title, section, CASE WHEN level = 2 THEN 0 ELSE subsection END),
named AS (SELECT p.*, coalesce(h.section_title, '') AS section_title FROM parts p LEFT JOIN heads h ON h.conv_id = p.conv_id AND h.section = p.section),
emitted AS (
  SELECT conv_id, 0 AS section, 0.0 AS s, replace(string_agg(line, ' ' ORDER BY pos) || ' ', chr(10), ' ') AS contents FROM sub WHERE level IS NULL GROUP BY conv_id
  UNION ALL SELECT DISTINCT conv_id, 0, 0.5, title || ' ' FROM named WHERE section = 0 AND s > 0
  UNION ALL SELECT conv_id, section, s, CASE WHEN s = 0 THEN title || ' ' || content ELSE title || ' ' || section_title || ' ' || content END FROM named WHERE section_title NOT IN ('Xem thêm.', 'Tham khảo.', 'Liên kết ngoài.', 'Ngoài lề.'))
SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY section, s) - 1 AS ordinal, 'c' || conv_id || '_' || (row_number() OVER (PARTITION BY conv_id ORDER BY section, s) - 1) AS section_id,
  {steps('contents', tx.DOC_CLEAN)} AS contents FROM emitted"""
)
def section_docs(spark, sf_dir):
    return corpus.section_docs(sectioned(spark, sf_dir), "conv_id")


# titles


@query(
    f"""WITH {WIKI}, q AS (SELECT item_id AS qid, text AS query FROM benchmark),
met AS (SELECT qid, query, title FROM q JOIN (SELECT DISTINCT title FROM w) ON len(list_filter(string_split(lower(query), ' '), lambda t: contains(lower(title), t))) > 0)
SELECT * FROM met UNION ALL SELECT qid, query, title FROM q CROSS JOIN (SELECT DISTINCT title FROM w) WHERE qid NOT IN (SELECT qid FROM met)"""
)
def candidate_filter(spark, sf_dir):
    return links.candidate_titles(title_queries(spark, sf_dir), wiki(spark, sf_dir).select("title").distinct())


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).withColumnRenamed("question", "query")


@query()
def closest_title(spark, sf_dir):
    return links.closest_titles(title_queries(spark, sf_dir), wiki(spark, sf_dir).select("title").distinct())


@query()
def answer_pipeline_m2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2)).alias("title"))
    named = wiki(spark, sf_dir).select("title").distinct()
    model = question_model(spark, sf_dir)
    return pipelines.predict(questions(spark, sf_dir), docs, index(spark, sf_dir), named, link_dictionary(spark, sf_dir), model)


def question_model(spark: SparkSession, sf_dir: str) -> PipelineModel:
    """The category model, fitted on the different questions about orders as the labeller has them."""
    asked = asked_orders(spark, sf_dir).select("question", "answer").distinct()
    category = classify.label_category(F.col("question"), F.col("answer")).alias("category")
    return classify.fit_categories(asked.select("question", category))


# dump records

@query(f"WITH {WIKI} SELECT page_id, title || ', ' || text AS text FROM w")
def highlight_unwrapped(spark, sf_dir):
    w = wiki(spark, sf_dir)
    marked = F.concat(
        F.lit('<syntaxhighlight lang="x">'), "title", F.lit("</syntaxhighlight>, &lt;syntaxhighlight x&gt;"), "text", F.lit("&lt;/syntaxhighlight&gt;")
    )
    return w.select("page_id", corpus.unwrap_highlight(marked).alias("text"))


@query(f"WITH {WIKI} SELECT page_id, title FROM w WHERE title IN (SELECT {strip('title')} FROM w WHERE contains(text, 'wiki/a'))")
def titled_records(spark, sf_dir):
    w = wiki(spark, sf_dir)
    return corpus.dump_records(w, w.filter(F.col("text").contains("wiki/a")).select("title")).select("page_id", "title")


REWRITTEN = "regexp_replace(text, '\\[\\[wiki/([^|\\]]*)\\|([^\\]]*)\\]\\]', '[[wiki/Wiki/\\1|\\2]]', 'g')"
PLAIN_TITLE = "translate(title, ':|', '  ')"
NAMED = f"(SELECT *, {PLAIN_TITLE} AS t, array_to_string({words(PLAIN_TITLE)}, '_') AS name FROM w)"


@query(
    f"WITH {WIKI} SELECT page_id, {REWRITTEN} || ' [[wiki/' || upper(substr(name, 1, 1)) || substr(name, 2) || '|' || t || ']]s "
    "[[wiki/T|c [[a|b]] d]]x' AS text FROM " + NAMED
)
def links_rewritten(spark, sf_dir):
    """Piped links of the pages, a bare link to the title with a word behind it, and a nested link."""
    title = F.translate("title", ":|", "  ")
    more = F.concat("text", F.lit(" [["), title, F.lit("]]s [[t|x|c [[a|b]] d]]x"))
    return corpus.dump_records(wiki(spark, sf_dir).withColumn("text", more), rewrite=True, capital=tx.one_capital).select("page_id", "text")


@query(
    f"WITH {WIKI}, cut AS (SELECT page_id, unnest(range(len(x) - 1)) AS i, x FROM (SELECT page_id, string_split(text, ']]') AS x FROM w)), "
    "placed AS (SELECT page_id, x[i + 1] AS piece, 2 * i + coalesce(list_sum(list_transform(x[1:i], lambda p: length(p))), 0) AS before FROM cut) "
    "SELECT page_id AS id, '[[' AS open, (before + strpos(piece, '[[') - 1)::BIGINT AS start, (before + length(piece) + 2)::BIGINT AS \"end\" FROM placed"
)
def balanced_spans(spark, sf_dir):
    return corpus.balanced_spans(wiki(spark, sf_dir), "page_id")


@query(
    "WITH t AS (SELECT text AS question, row_number() OVER (ORDER BY item_id) AS ord FROM benchmark), "
    "a AS (SELECT text AS answer, row_number() OVER (ORDER BY conv_id, turn, text) AS ord FROM conversations) SELECT ord, question, answer FROM t JOIN a USING (ord)"
)
def truth_zipped(spark, sf_dir):
    """Questions with answers by their places in two lists, each numbered in ranges of its order."""
    asked = numbered(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question")), ["item_id"])
    said = numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("answer")), ["conv_id", "turn", "answer"])
    return corpus.zip_by_place(asked, said).select("ord", "question", "answer")


# classification

ASK = {"1-URGENT": "sinh khi nào", "2-HIGH": "cao bao nhiêu mét", "3-MEDIUM": "ai thắng vào năm 1990", "4-NOT SPECIFIED": "đi bao giờ"}
ASK_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ASK.items()) + " ELSE 'ai là vua' END"
ANSWER_SQL = "CASE o_orderstatus WHEN 'F' THEN 'năm 1999' WHEN 'O' THEN (o_orderkey % 97)::VARCHAR WHEN 'P' THEN 'wiki/Order' END"
ORDERS = f"(SELECT o_orderkey, {ASK_SQL} AS question, {ANSWER_SQL} AS answer FROM orders)"
LABEL_SQL = f"""CASE WHEN {contains_any('answer', classify.LABEL_DATE_ANSWER)} OR {contains_any('question', classify.LABEL_DATE_QUESTION)} THEN 'datetime'
  WHEN regexp_matches(answer, '^[0-9]+$') OR {contains_any('question', classify.LABEL_QUANTITY_QUESTION)} THEN 'quantity' WHEN contains(answer, 'wiki') THEN 'wiki' ELSE 'other' END"""
RULE_SQL = f"""CASE WHEN {contains_any('question', classify.RULE_DATE)} THEN 'datetime' WHEN {contains_any('question', classify.RULE_QUANTITY)} THEN 'quantity'
  WHEN {contains_any('question', classify.RULE_WIKI)} THEN 'wiki' END"""


def asked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question and an answer for every order, by its priority and status."""
    q = F.lit("ai là vua")
    for k, v in ASK.items():
        q = F.when(F.col("o_orderpriority") == k, v).otherwise(q)
    s = F.col("o_orderstatus")
    a = F.when(s == "F", "năm 1999").when(s == "O", (F.col("o_orderkey") % 97).cast("string")).when(s == "P", "wiki/Order")
    return table(spark, sf_dir, "orders").select("o_orderkey", q.alias("question"), a.alias("answer"))


@query(f"SELECT o_orderkey, {LABEL_SQL} AS category, {RULE_SQL} AS ruled FROM {ORDERS}")
def category_label(spark, sf_dir):
    q, a = F.col("question"), F.col("answer")
    return asked_orders(spark, sf_dir).select(
        "o_orderkey", classify.label_category(q, a).alias("category"), classify.rule_category(q).alias("ruled")
    )


@query(f"SELECT category, count(*) AS n FROM (SELECT {LABEL_SQL} AS category FROM {ORDERS}) GROUP BY category")
def category_counts(spark, sf_dir):
    return classify.category_counts(category_label(spark, sf_dir))


@query(f"SELECT round(avg(CASE WHEN category IS NOT DISTINCT FROM ruled THEN 100.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM (SELECT {LABEL_SQL} AS category, {RULE_SQL} AS ruled FROM {ORDERS})")
def category_accuracy(spark, sf_dir):
    got = classify.accuracy(category_label(spark, sf_dir), "ruled", "category")
    return got.withColumn("accuracy", F.round("accuracy", 6))


@query()
def svm_classify(spark, sf_dir):
    """Languages of documents by the linear model, on held-out rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"), F.col("lang").alias("category"))
    train, test = classify.split(docs)
    model = classify.fit_categories(train)
    return classify.accuracy(model.transform(test), "model_category", "category")


# evaluation

PAIRS = "(SELECT conv_id * 1000000000 + turn AS qid, text AS gold, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS pred, (conv_id * 37 + turn * 11) % 100 / 100.0::DOUBLE AS na_prob, turn % 3 <> 0 AS has_answer FROM conversations)"
G, P = words(normalized_answer("gold")), words(normalized_answer("pred"))
SCORES = f"""pairs AS (SELECT *, {normalized_answer('gold')} AS ng, {normalized_answer('pred')} AS np, {G} AS g, {P} AS p FROM {PAIRS} WHERE pred IS NOT NULL),
common AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(g, p)), lambda w: least(len(list_filter(g, lambda t: t = w)), len(list_filter(p, lambda t: t = w))))), 0) AS c FROM pairs),
scores AS (SELECT qid, na_prob, has_answer, (ng = np)::BIGINT AS exact, CASE WHEN len(g) = 0 OR len(p) = 0 THEN (len(g) = len(p))::INT::DOUBLE ELSE 2.0::DOUBLE * c / (len(g) + len(p)) END AS f1 FROM common)"""


def prediction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as gold, the next one as its prediction; qid is a struct of both keys."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select(
        F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("gold"), F.lead("text").over(w).alias("pred"),
        ((F.col("conv_id") * 37 + F.col("turn") * 11) % 100 / 100.0).alias("na_prob"), (F.col("turn") % 3 != 0).alias("has_answer"),
    ).filter("pred is not null")


def number() -> Column:
    """What the SQL calls qid. Rows are joined by the struct, as these numbers can meet."""
    return (F.col("qid.conv_id") * 1000000000 + F.col("qid.turn")).alias("qid")


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prediction_pairs(spark, sf_dir)
    scored = evaluate.raw_scores(rows.select("qid", "gold"), rows.select("qid", "pred"))
    return rows.select("qid", "na_prob", "has_answer").join(scored, "qid")


@query(f"WITH {SCORES} SELECT qid, exact, round(f1, 6) AS f1 FROM scores")
def token_f1(spark, sf_dir):
    return pair_scores(spark, sf_dir).select(number(), F.col("exact").cast("long").alias("exact"), F.round("f1", 6).alias("f1"))


@query(f"WITH {SCORES}, cut AS (SELECT qid, has_answer, CASE WHEN na_prob > 0.5 THEN (NOT has_answer)::INT::DOUBLE ELSE f1 END AS f1 FROM scores) SELECT qid, round(f1, 6) AS f1 FROM cut")
def na_threshold(spark, sf_dir):
    rows = pair_scores(spark, sf_dir)
    cut = evaluate.apply_no_answer_threshold(F.col("f1"), F.col("na_prob"), F.col("has_answer"), 0.5)
    return rows.select(number(), F.round(cut, 6).alias("f1"))


@query(
    f"WITH {SCORES} SELECT round(100 * avg(exact), 6) AS exact, round(100 * avg(f1), 6) AS f1, count(*) AS total, "
    + ", ".join(
        f"round(100 * avg({c}) FILTER (WHERE {cond}), 6) AS {p}{c}" for p, cond in (("HasAns_", "has_answer"), ("NoAns_", "NOT has_answer")) for c in ("exact", "f1")
    )
    + ", count(*) FILTER (WHERE has_answer) AS HasAns_total, count(*) FILTER (WHERE NOT has_answer) AS NoAns_total FROM scores"
)
def eval_summary(spark, sf_dir):
    got = evaluate.eval_summary(pair_scores(spark, sf_dir))
    return got.select(*[c if c.endswith("total") else F.round(c, 6).alias(c) for c in got.columns])


@query(
    f"WITH {SCORES}, gains AS (SELECT na_prob, qid, CASE WHEN has_answer THEN f1 ELSE -1.0 END AS gain FROM scores), "
    "start AS (SELECT count(*) FILTER (WHERE NOT has_answer)::DOUBLE AS s, count(*) AS n FROM scores), "
    "run AS (SELECT na_prob, round(s + sum(gain) OVER (ORDER BY na_prob, qid ROWS UNBOUNDED PRECEDING), 9) AS total FROM gains CROSS JOIN start), "
    "top AS (SELECT max(total) AS total, arg_max(na_prob, total * 1000000 - na_prob) AS p FROM run) "
    "SELECT round(100 * CASE WHEN total > s THEN total ELSE s END / n, 6) AS best, CASE WHEN total > s THEN p ELSE 0.0 END AS threshold FROM top CROSS JOIN start"
)
def best_threshold(spark, sf_dir):
    return evaluate.best_threshold(pair_scores(spark, sf_dir).withColumn("answered", F.lit(True)), "f1")


LOGITS = "(SELECT vec_id, embedding::DOUBLE[] AS s, list_reverse(embedding::DOUBLE[]) AS e FROM embeddings)"


ANSWERED = SCORES.replace("SELECT qid, na_prob, has_answer,", "SELECT qid, na_prob, has_answer, pred <> '' AS answered,")


def sql_thresholds() -> str:
    """CTEs start and top_c, and columns best_c and best_c_thresh, over scores with answered."""
    ctes = "start AS (SELECT count(*) FILTER (WHERE NOT has_answer)::DOUBLE AS s, count(*) AS n FROM scores)"
    for c in ("exact", "f1"):
        gain = f"CASE WHEN has_answer THEN {c}::DOUBLE WHEN answered THEN -1.0 ELSE 0.0 END"
        run = f"SELECT na_prob, round(s + sum({gain}) OVER (ORDER BY na_prob, qid ROWS UNBOUNDED PRECEDING), 9) AS total FROM scores CROSS JOIN start"
        ctes += f", top_{c} AS (SELECT max(total) AS t_{c}, arg_max(na_prob, total * 1000000 - na_prob) AS p_{c} FROM ({run}))"
    return ctes


BEST = ", ".join(
    f"round(100 * CASE WHEN t_{c} > s THEN t_{c} ELSE s END / n, 6) AS best_{c}, CASE WHEN t_{c} > s THEN p_{c} ELSE 0.0 END AS best_{c}_thresh" for c in ("exact", "f1")
)


@query(
    f"WITH {ANSWERED}, {sql_thresholds()}, means AS (SELECT round(avg(exact) FILTER (WHERE has_answer), 6) AS has_ans_exact, round(avg(f1) FILTER (WHERE has_answer), 6) AS has_ans_f1 FROM scores) "
    f"SELECT {BEST}, has_ans_exact, has_ans_f1 FROM start, top_exact, top_f1, means"
)
def thresholds_with_answered(spark, sf_dir):
    rows = pair_scores(spark, sf_dir)
    answered = prediction_pairs(spark, sf_dir).select("qid", (F.col("pred") != "").alias("answered"))
    return evaluate.all_best_thresholds_with_answered(rows.join(answered, "qid"))


@query(
    f"WITH {ANSWERED.replace(PAIRS, PAIRS.replace('text AS gold', 'CASE WHEN turn % 3 <> 0 THEN text ELSE {} END AS gold'.format(text(''))))}, "
    f"{sql_thresholds()}, cut AS (SELECT has_answer, "
    + ", ".join(f"CASE WHEN na_prob > 0.5 THEN (NOT has_answer)::INT::DOUBLE ELSE {c} END AS {c}" for c in ("exact", "f1"))
    + " FROM scores), means AS (SELECT count(*) AS total, count(*) FILTER (WHERE has_answer) AS HasAns_total, count(*) FILTER (WHERE NOT has_answer) AS NoAns_total, "
    + ", ".join(
        f"round(100 * avg({c}) FILTER (WHERE {cond}), 6) AS {p}{c}"
        for p, cond in (("", "true"), ("HasAns_", "has_answer"), ("NoAns_", "NOT has_answer")) for c in ("exact", "f1")
    )
    + f" FROM cut) SELECT means.*, {BEST} FROM means, start, top_exact, top_f1"
)
def squad_report(spark, sf_dir):
    """The whole report: every third turn has no answer, and a prediction that it has one above 0.5."""
    rows = prediction_pairs(spark, sf_dir)
    golds = rows.select("qid", F.when(F.col("has_answer"), F.col("gold")).alias("gold"))
    got = evaluate.squad_evaluate(golds, rows.select("qid", "pred", "na_prob"), 0.5)
    return got.select(*[c if c.endswith(("total", "thresh")) else F.round(c, 6).alias(c) for c in got.columns])


@query(
    f"WITH l AS (SELECT * FROM {LOGITS}), st AS (SELECT vec_id, i, v FROM (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM (SELECT vec_id, unnest(range(len(s))) AS i, unnest(s) AS v FROM l)) WHERE r <= 5), "
    "en AS (SELECT vec_id, i, v FROM (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM (SELECT vec_id, unnest(range(len(e))) AS i, unnest(e) AS v FROM l)) WHERE r <= 5), "
    "sp AS (SELECT st.vec_id AS feature_id, st.i AS start, en.i AS stop, round(st.v + en.v, 6) AS score FROM st JOIN en ON st.vec_id = en.vec_id WHERE en.i >= st.i AND en.i - st.i + 1 <= 30) "
    "SELECT feature_id, start, stop, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY score DESC, start, stop) AS rank FROM sp) WHERE rank <= 5"
)
def nbest_spans(spark, sf_dir):
    return evaluate.candidate_spans(features(spark, sf_dir), 5).withColumnRenamed("end", "stop")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("feature_id"), v.alias("start_logits"), F.reverse(v).alias("end_logits"))


WIDTH, PARAGRAPH, EVERY = 64, 60, 7
TOP = (
    "t AS (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) - 1 AS r FROM (SELECT vec_id, unnest(range(len({c}))) AS i, unnest({c}) AS v FROM l)), "
)
SPANS = (
    f"l AS (SELECT * FROM {LOGITS}), "
    + "".join(f"{n}{TOP.format(c=n[0])}" for n in ("s", "e"))
    + f"spans AS (SELECT st.vec_id AS qid, st.i AS start, et.i AS stop, st.v AS start_logit, et.v AS end_logit, st.r AS i, et.r AS j FROM st JOIN et ON st.vec_id = et.vec_id "
    f"WHERE st.r < 5 AND et.r < 5 AND et.i >= st.i AND et.i - st.i + 1 <= 30 AND st.i > 0 AND st.i % {EVERY} <> 0), "
    "named AS (SELECT *, array_to_string(list_transform(range(start, stop + 1), lambda x: 't' || x), ' ') AS text FROM spans)"
)
NBEST = f"""{SPANS},
nulls AS (SELECT vec_id AS qid, s[1] AS s0, e[1] AS e0 FROM l),
every_ AS (SELECT qid, text, start_logit, end_logit, i, j FROM named UNION ALL SELECT qid, '', s0, e0, 2147483647, 2147483647 FROM nulls),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY start_logit + end_logit DESC, i, j) AS r FROM every_) WHERE r <= 5),
closed AS (SELECT qid, r, text, start_logit, end_logit FROM ranked
  UNION ALL SELECT qid, 6, '', s0, e0 FROM nulls WHERE qid NOT IN (SELECT qid FROM ranked WHERE text = '')
  UNION ALL SELECT qid, 0, 'empty', 0.0, 0.0 FROM ranked GROUP BY qid HAVING count(*) = 1 AND max(text) = ''),
nbest AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank, text, start_logit, end_logit, start_logit + end_logit AS total FROM closed)"""


def token_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Features of WIDTH tokens, the first of them no word, and each EVERY-th without most context."""
    places = F.sequence(F.lit(1), F.lit(WIDTH - 1))
    as_map = lambda value: F.map_from_arrays(places, F.transform(places, value))
    rows = features(spark, sf_dir).select(
        F.col("feature_id").alias("qid"), "*",
        F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("tokens"),
        as_map(lambda i: i).alias("orig_map"), as_map(lambda i: i % EVERY != 0).alias("max_context"),
    )
    return rows, rows.select("qid", F.col("tokens").alias("doc_tokens"))


def predicted(spark: SparkSession, sf_dir: str) -> evaluate.NBest:
    return evaluate.predictions_logits(*token_features(spark, sf_dir), 5, null_threshold=0.0)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in df.schema])


@query(f"WITH {NBEST} SELECT qid, rank, text, round(total, 6) AS probability, round(start_logit, 6) AS start_logit, round(end_logit, 6) AS end_logit FROM nbest")
def nbest_predictions(spark, sf_dir):
    return rounded(predicted(spark, sf_dir).nbest)


@query(
    f"WITH {NBEST}, other AS (SELECT qid, arg_min(text, rank) AS text, arg_min(total, rank) AS total FROM nbest WHERE text <> '' GROUP BY qid), "
    "odds AS (SELECT o.*, s0 + e0 - total AS null_odds FROM other o JOIN nulls USING (qid)) "
    "SELECT qid, CASE WHEN null_odds > 0 THEN '' ELSE text END AS text, CASE WHEN null_odds > 0 THEN 0.0 ELSE round(total, 6) END AS score, round(null_odds, 6) AS null_odds FROM odds"
)
def nbest_null_odds(spark, sf_dir):
    got = predicted(spark, sf_dir)
    return rounded(got.predictions.join(got.null_odds, "qid"))


@query(
    f"""WITH {SPANS},
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY start_logit + end_logit DESC, i, j) AS r FROM named WHERE start < {PARAGRAPH - 1} AND stop < {PARAGRAPH - 1}) WHERE r <= 5),
closed AS (SELECT qid, r, text, start_logit, end_logit FROM ranked UNION ALL SELECT vec_id, 1, '', -1e6::DOUBLE, -1e6::DOUBLE FROM l WHERE vec_id NOT IN (SELECT qid FROM ranked)),
grown AS (SELECT *, exp(start_logit + end_logit - max(start_logit + end_logit) OVER (PARTITION BY qid)) AS x FROM closed)
SELECT qid, r AS rank, text, round(start_logit, 6) AS start_logit, round(end_logit, 6) AS end_logit, round(x / sum(x) OVER (PARTITION BY qid), 6) AS probability FROM grown"""
)
def nbest_log_probs(spark, sf_dir):
    rows, examples = token_features(spark, sf_dir)
    starts, ends = (best_indexes(F.col(c), 5) for c in ("start_logits", "end_logits"))
    rows = rows.withColumns({"start_top_index": starts, "__ends": ends}).withColumns(
        {
            "start_log_probs": F.transform("start_top_index", lambda i: F.get("start_logits", i)),
            "end_top_index": F.flatten(F.array_repeat("__ends", 5)),
            "paragraph_len": F.lit(PARAGRAPH), "cls_logit": F.get("start_logits", F.lit(0)),
        }
    ).withColumn("end_log_probs", F.transform("end_top_index", lambda i: F.get("end_logits", i)))
    return rounded(evaluate.predictions_log_probs(rows, examples).nbest)


@query("SELECT conv_id || '-' || turn AS id, text AS question, [role] AS answers, 'c' || conv_id AS context FROM conversations")
def squad_flatten(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answer = F.array(F.struct(F.col("role").alias("text"), F.lit(0).alias("answer_start")))
    qa = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"), answer.alias("answers"))
    paragraphs = c.groupBy("conv_id").agg(F.collect_list(qa).alias("qas")).select(
        F.array(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("context"), "qas")).alias("paragraphs")
    )
    return flatten_squad(paragraphs.select(F.array(F.struct("paragraphs")).alias("data")))


@query("SELECT user_id, event_type, min(event_id) AS ord FROM events GROUP BY user_id, event_type")
def ordered_distinct(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("ord"))
    return voting.ordered_distinct(e, ["user_id"], "event_type")


@query(
    "SELECT part, ord, value FROM (SELECT 1 AS part, item_id AS ord, CASE WHEN item_id = (SELECT min(item_id) FROM benchmark) THEN '' ELSE ',' END || "
    "'{\"id\":\"' || item_id || '\",\"question\":' || to_json(text) || ',\"answer\":null}' AS value FROM benchmark "
    "UNION ALL SELECT 0, NULL, '{\"data\": [' UNION ALL SELECT 2, NULL, ']}')"
)
def submission_lines(spark, sf_dir):
    q = questions(spark, sf_dir)
    return submission(q.select(F.col("qid").alias("ord"), F.col("qid").alias("id"), "question", F.lit(None).alias("answer")))
