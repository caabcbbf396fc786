"""Text, n-gram and entity functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions import entities, ngrams
from answerloom.functions import text as tx
from answerloom.functions.text import ACCENTED, LINE_END, PLAIN, SENTENCE_END, WS
from answerloom.operators import segment
from answerloom.plans.registry import normalized_answer, query, steps, strip, table, text, words

PASSAGES = (
    f"list_transform(list_filter(list_transform(regexp_split_to_array({steps('text', tx.PASSAGE_CLEAN)}, {text(SENTENCE_END)}), "
    f"lambda p: {strip(f'regexp_replace(p, {text(chr(92) + "n" + WS + "*")}, {text(". ")}, {text("g")})')}), lambda p: p <> ''), lambda p: p || '.')"
)
LINES = f"list_filter(list_transform(regexp_split_to_array(text, {text(LINE_END)}), lambda x: {strip('x')}), lambda x: x <> '')"


def documents(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


def turns(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[c.alias(n) for n, c in columns.items()])




@query(f"SELECT doc_id, {steps('text', tx.PREPROCESS)} AS clean FROM documents")
def preprocess_text(spark, sf_dir):
    return documents(spark, sf_dir, clean=tx.preprocess_text(F.col("text")))


@query(f"SELECT doc_id, (unnest(range(len(p))))::BIGINT AS at, unnest(p) AS passage FROM (SELECT doc_id, {PASSAGES} AS p FROM documents)")
def to_passages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(tx.to_passages(F.col("text"))).alias("at", "passage")).filter("passage is not null")
    return rows.withColumn("at", F.col("at").cast("long"))


@query(f"SELECT page_id, {steps('html', tx.LOADER_CLEAN)} AS clean FROM pages")
def loader_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.loader_clean(F.col("html")).alias("clean"))


@query(f"SELECT doc_id, {steps('text', tx.DOC_CLEAN)} AS clean FROM documents")
def doc_clean(spark, sf_dir):
    return documents(spark, sf_dir, clean=tx.doc_clean(F.col("text")))


@query(f"SELECT doc_id, {steps('text', tx.NORM_TEXT)} AS norm, {steps('text', tx.NORM_TEXT_PLAIN)} AS plain FROM documents")
def norm_text(spark, sf_dir):
    return documents(spark, sf_dir, norm=tx.norm_text(F.col("text")), plain=tx.norm_text(F.col("text"), False))


@query(f"SELECT doc_id, {steps('text', tx.NORMALIZER)} AS norm FROM documents")
def normalizer(spark, sf_dir):
    return documents(spark, sf_dir, norm=tx.normalizer(F.col("text")))


@query(f"SELECT doc_id, translate(text, '{ACCENTED}', '{PLAIN}') AS plain FROM documents")
def remove_accents(spark, sf_dir):
    return documents(spark, sf_dir, plain=tx.remove_accents(F.col("text")))


def _sql_tones() -> str:
    """place_tones over text, in SQL."""
    toned, digits = "".join(tx.TONED), "".join(str(k + 1) * len(tx.VOWELS) for k in range(len(tx.TONES)))
    part = lambda k: f"CASE WHEN regexp_matches(w, '{tx.SYLLABLES[0]}') THEN regexp_extract(w, '{tx.SYLLABLES[0]}', {k}) ELSE regexp_extract(w, '{tx.SYLLABLES[1]}', {k}) END"
    bare = f"translate({part(2)}, '{toned}', '{tx.VOWELS * len(tx.TONES)}')"
    tone = f"regexp_replace(translate({part(2)}, '{toned}', '{digits}'), '[^1-5]', '', 'g')"
    mark = " ".join(f"WHEN '{k + 1}' THEN translate(substr(b, p, 1), '{tx.VOWELS}', '{t}')" for k, t in enumerate(tx.TONED))
    return f"""pieces AS (SELECT key, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT key, regexp_extract_all(text, '\\p{{L}}+|\\P{{L}}+') AS x FROM asked)),
cut AS (SELECT key, i, w, {part(1)} AS o, {bare} AS b, {part(3)} AS c, {tone} AS tone FROM pieces),
placed AS (SELECT *, CASE WHEN regexp_matches(b, '[{tx.MARKED}]') THEN length(b) - length(regexp_extract(b, '[{tx.MARKED}]([^{tx.MARKED}]*)$', 1))
  WHEN length(b) = 1 OR length(b) = 2 AND c = '' THEN 1 ELSE 2 END AS p FROM cut),
moved AS (SELECT key, string_agg(CASE WHEN length(tone) = 1 THEN o || substr(b, 1, p - 1) || (CASE tone {mark} END) || substr(b, p + 1) || c ELSE w END, '' ORDER BY i) AS text FROM placed GROUP BY key)"""


#: Both spellings of tone marks, and marks on the wrong vowel.
SPELLINGS = "hoá học, thuỷ điện, Hoà Bình khoẻ; hóa thủy hòa KHOẺ QUÝ giá gì quỳ, baỏ lựơng nghịêm hoàn ngoài toán "


@query(f"WITH asked AS (SELECT o_orderkey AS key, '{SPELLINGS}' || o_comment || ' ' || o_orderpriority AS text FROM (SELECT o_orderkey, o_orderpriority, 'hoạ ' || o_orderstatus AS o_comment FROM orders)), {_sql_tones()} SELECT key AS o_orderkey, text FROM moved")
def tone_marks(spark, sf_dir):
    asked = F.concat(F.lit(SPELLINGS + "hoạ "), "o_orderstatus", F.lit(" "), "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.place_tones(asked).alias("text"))


@query("SELECT doc_id, strip_accents(text) AS plain, nfc_normalize(text) AS composed FROM documents")
def strip_accents(spark, sf_dir):
    return documents(spark, sf_dir, plain=tx.strip_accents(F.col("text")), composed=tx.compose(F.col("text")))


@query(f"SELECT conv_id, turn, {normalized_answer('text')} AS norm FROM conversations")
def normalize_answer(spark, sf_dir):
    return turns(spark, sf_dir, norm=tx.normalize_answer(F.col("text")))


@query(
    f"SELECT conv_id, turn, {steps('lower(text)', ((tx.ASCII_PUNCTUATION, ''),))} AS norm, "
    f"{steps('text', tx.CJK_PUNCTUATION)} AS cjk FROM conversations"
)
def normalize_text(spark, sf_dir):
    return turns(spark, sf_dir, norm=tx.normalize_text(F.col("text")), cjk=tx.normalize_chinese_text(F.col("text")))


@query(
    "SELECT conv_id, turn, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(w[i + 1:], w[i])), lambda i: w[i]), ' ') AS tokens "
    "FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)"
)
def dedupe_tokens(spark, sf_dir):
    return turns(spark, sf_dir, tokens=tx.dedupe_tokens(F.col("text")))


@query(
    f"SELECT conv_id, turn, {steps('text', tx.ANSWER_CLEANUP)} AS answer, "
    f"CASE WHEN ends_with(text, '?') OR text = '' THEN text ELSE text || ' ?' END AS question, "
    f"{steps('lower(text)', tx.VOTE_NORM)} AS vote FROM conversations"
)
def answer_cleanup(spark, sf_dir):
    c = F.col("text")
    return turns(spark, sf_dir, answer=tx.answer_cleanup(c), question=tx.question_fixup(c), vote=tx.vote_norm(c))


@query(f"SELECT doc_id, (unnest(range(len(x))))::BIGINT AS at, unnest(x) AS line FROM (SELECT doc_id, {LINES} AS x FROM documents)")
def text_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(tx.lines(F.col("text"))).alias("at", "line")).filter("line is not null")
    return rows.withColumn("at", F.col("at").cast("long"))


@query(f"SELECT doc_id, split_part(text, '.', 1) AS head, {strip("substr(text, length(split_part(text, '.', 1)) + 2)")} AS rest FROM documents")
def split_title(spark, sf_dir):
    head, rest = tx.split_title(F.col("text"))
    return documents(spark, sf_dir, head=head, rest=rest)


@query(
    "WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages) "
    "SELECT page_id, title, 'wiki/' || replace(title, ' ', '_') AS link, title AS page, title || ' . ' || title AS context "
    "FROM t"
)
def title_links(spark, sf_dir):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    t = table(spark, sf_dir, "pages").select("page_id", title.alias("title"))
    section = F.concat("title", F.lit("_"), F.col("page_id").cast("string"))
    return t.select(
        "page_id", "title", tx.title_to_link(F.col("title")).alias("link"), tx.page_title(section).alias("page"),
        tx.augment_context(section, F.col("title"), F.lit("wiki")).alias("context"),
    )


@query(
    "SELECT conv_id, turn, coalesce(list_filter(flatten(list_transform(string_split(text, ' '), lambda t: list_filter(["
    + ", ".join(text(k) for k in tx.QUESTION_WORDS)
    + "], lambda k: starts_with(lower(t), lower(k))))), lambda x: true)[1], 'others') AS kind FROM conversations"
)
def question_type(spark, sf_dir):
    return turns(spark, sf_dir, kind=tx.question_type(F.col("text")))


@query("SELECT event_id, coalesce(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.contents'), props) AS contents FROM events")
def json_contents(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.json_contents(F.col("props")).alias("contents"))


# n-grams


def sql_tokens(expr: str) -> str:
    return words(f"replace({steps(expr, tx.PREPROCESS)}, '. ', ' ')")


def sql_cases(toks: str) -> str:
    """SQL columns lo and up of a token list."""
    match = "regexp_matches(w, '\\p{Lu}')"
    return f"list_filter({toks}, lambda w: NOT {match}) AS lo, list_filter({toks}, lambda w: {match}) AS up"


def sql_grams(toks: str, n: int, distinct: bool = True) -> str:
    grams = f"list_transform(range(1, len({toks}) - {n} + 2), lambda i: array_to_string({toks}[i:i + {n - 1}], ' '))"
    return f"list_distinct({grams})" if distinct else grams


GRAM_COLUMNS = ", ".join(
    f"{sql_grams(c, n)} AS {case}{n}" for case, c in (("lower", "lo"), ("upper", "up")) for n in ngrams.SIZES
)


def sql_profile(source: str, keys: str, expr: str) -> str:
    """SELECT of keys and the six n-gram sets of expr."""
    return (
        f"SELECT {keys}, {GRAM_COLUMNS} FROM (SELECT {keys}, {sql_cases('toks')} FROM "
        f"(SELECT {keys}, {sql_tokens(expr)} AS toks FROM {source}))"
    )


def sql_overlap(a: str, b: str) -> str:
    parts = [
        f"{2 if name.startswith('upper') else 1} * len(list_intersect({a}.{name}, {b}.{name}))" for name in ngrams.PROFILE_COLUMNS
    ]
    return f"({' + '.join(parts)})::BIGINT"


@query(
    "SELECT doc_id, " + ", ".join(f"len({n})::BIGINT AS {n}" for n in ngrams.PROFILE_COLUMNS)
    + ", md5(array_to_string(list_sort(lower3), '|')) AS hash3 FROM (" + sql_profile("documents", "doc_id", "text") + ")"
)
def ngram_sets(spark, sf_dir):
    p = ngrams.with_profile(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "p")
    return p.select(
        "doc_id", *[F.size(f"p.{n}").cast("long").alias(n) for n in ngrams.PROFILE_COLUMNS],
        F.md5(F.array_join(F.array_sort("p.lower3"), "|").cast("binary")).alias("hash3"),
    )


@query(
    f"SELECT p_partkey, {sql_grams('w', 2, False)} AS grams FROM (SELECT p_partkey, {words('p_name')} AS w FROM part)"
)
def ngram_list(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ngrams.gram_list(tx.words(F.col("p_name")), 2).alias("grams"))


@query(
    "WITH g AS (SELECT p_partkey, list_transform(range(1, length(p_name)), lambda i: substr(p_name, i, 2)) AS a, "
    "list_transform(range(1, length(p_brand)), lambda i: substr(p_brand, i, 2)) AS b FROM part) "
    "SELECT p_partkey, coalesce(round(len(list_filter(a, lambda x: list_contains(b, x))) * 2.0 / nullif(len(a) + len(b), 0), 6), 0.0) AS similarity FROM g"
)
def char_ngram_similarity(spark, sf_dir):
    s = F.round(ngrams.char_similarity(F.col("p_name"), F.col("p_brand"), 2), 6)
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("similarity"))


# entities

ORDER_TEXT = (
    "CASE o_orderstatus WHEN 'F' THEN 'ngày ' || d || ' tháng ' || m || ' năm ' || y "
    "WHEN 'O' THEN 'tháng ' || m || '/' || y ELSE d || '/' || m || '/' || y END"
)
ORDER_ROWS = (
    "(SELECT o_orderkey, o_orderstatus, day(o_orderdate)::INT AS d, month(o_orderdate)::INT AS m, year(o_orderdate)::INT AS y FROM orders)"
)


def order_texts(spark, sf_dir):
    """A date in words for every order, in three styles."""
    d, m, y = (f("o_orderdate").cast("string") for f in (F.day, F.month, F.year))
    spoken = F.concat(F.lit("ngày "), d, F.lit(" tháng "), m, F.lit(" năm "), y)
    monthly = F.concat(F.lit("tháng "), m, F.lit("/"), y)
    phrase = F.when(F.col("o_orderstatus") == "F", spoken).when(F.col("o_orderstatus") == "O", monthly).otherwise(F.concat_ws("/", d, m, y))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", phrase.alias("phrase"))


@query(
    f"SELECT o_orderkey, {ORDER_TEXT} AS phrase, y AS year, m AS month, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE d END AS date FROM {ORDER_ROWS}"
)
def extract_datetime(spark, sf_dir):
    found = entities.extract_datetime(F.col("phrase"))
    rows = order_texts(spark, sf_dir).withColumn("found", found)
    return rows.select("o_orderkey", "phrase", "found.year", "found.month", "found.date")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'tháng ' || m || ' năm ' || y "
    f"ELSE 'ngày ' || d || ' tháng ' || m || ' năm ' || y END AS answer FROM {ORDER_ROWS}"
)
def format_datetime(spark, sf_dir):
    rows = order_texts(spark, sf_dir).withColumn("found", entities.extract_datetime(F.col("phrase")))
    return rows.select("o_orderkey", entities.format_datetime(F.col("found")).alias("answer"))


SQL_UNIT = "[" + ", ".join(text(u) for u in entities.UNITS) + "]"
SQL_INNER = "CASE WHEN {k} = 4 THEN 'tư' ELSE " + SQL_UNIT + "[{k}] END"


def _sql_spelled() -> str:
    inner = lambda k: SQL_INNER.format(k=k)
    unit = lambda k: f"{SQL_UNIT}[{k}]"

    def hundred(k: str) -> str:
        return (
            f"CASE WHEN {k} <= 10 THEN {unit(k)} WHEN {k} < 20 THEN 'mười ' || {inner(f'({k} % 10)')} "
            f"WHEN {k} % 10 = 0 THEN {inner(f'({k} // 10)')} || ' mươi' "
            f"ELSE {inner(f'({k} // 10)')} || ' mươi ' || {inner(f'({k} % 10)')} END"
        )

    def thousand(k: str) -> str:
        return (
            f"CASE WHEN {k} < 100 THEN {hundred(k)} WHEN {k} % 100 = 0 THEN {inner(f'({k} // 100)')} || ' trăm' "
            f"ELSE {inner(f'({k} // 100)')} || ' trăm ' || {hundred(f'({k} % 100)')} END"
        )

    return (
        f"CASE WHEN n < 1000 THEN {thousand('n')} WHEN n % 1000 = 0 THEN {inner('(n // 1000)')} || ' nghìn' "
        f"ELSE {unit('(n // 1000)')} || ' nghìn ' || {thousand('(n % 1000)')} END"
    )


@query(f"SELECT o_orderkey, n, {_sql_spelled()} AS words FROM (SELECT o_orderkey, o_orderkey % {entities.LARGEST} + 1 AS n FROM orders)")
def number_lexicon(spark, sf_dir):
    n = F.col("o_orderkey") % entities.LARGEST + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"), entities.spelled(n).alias("words"))


@query("SELECT p_partkey, p_size::VARCHAR AS quantity, (p_size * 100)::VARCHAR AS hundreds FROM part")
def extract_quantity(spark, sf_dir):
    size = F.col("p_size").cast("int")
    phrase = lambda n: F.concat(F.lit("có "), entities.spelled(n), F.lit(" chiếc."))
    return table(spark, sf_dir, "part").select(
        "p_partkey", entities.extract_quantity(phrase(size)).alias("quantity"),
        entities.extract_quantity(phrase(size * 100)).alias("hundreds"),
    )


COMPAT_WORDS = "replace(replace(replace(replace(replace(lower(text), 'k', '000'), 'lẻ', ' '), 'ngàn', 'nghìn'), 'lăm', 'năm'), '/', ' ')"
COMPAT_TOKENS = words(f"regexp_replace({COMPAT_WORDS}, '{entities.QUANTITY_DROP}', '', 'g')")


@query(
    f"""WITH RECURSIVE spoken AS (SELECT n, {_sql_spelled()} AS words FROM (SELECT unnest(range(1, {entities.LARGEST + 1})) AS n)),
asked AS (SELECT p_partkey, (SELECT words FROM spoken WHERE n = p_size) || ' km, ' || (SELECT words FROM spoken WHERE n = p_size * 100) || ' ngàn' AS text FROM part),
t AS (SELECT text, {COMPAT_TOKENS} AS tokens FROM (SELECT DISTINCT text FROM asked)),
met AS (SELECT text, list(string_split(words, ' ') ORDER BY n DESC) AS parts, list(n ORDER BY n DESC) AS numbers
  FROM t JOIN spoken ON list_has_all(tokens, string_split(words, ' ')) GROUP BY text),
r AS (SELECT text, 0 AS i, tokens FROM t
  UNION ALL SELECT text, i + 1, CASE WHEN list_has_all(tokens, p) THEN tokens[:list_position(tokens, p[1]) - 1] || [numbers[i + 1]::VARCHAR] || tokens[list_position(tokens, p[1]) + len(p):] ELSE tokens END
  FROM (SELECT r.*, numbers, parts[i + 1] AS p FROM r JOIN met USING (text) WHERE i < len(numbers))),
done AS (SELECT text, regexp_replace(array_to_string(arg_max(tokens, i), ' '), '\\P{{Nd}}', '', 'g') AS quantity FROM r GROUP BY text)
SELECT p_partkey, quantity FROM asked JOIN done USING (text)"""
)
def extract_quantity_compat(spark, sf_dir):
    size = F.col("p_size").cast("int")
    phrase = F.concat(entities.spelled(size), F.lit(" km, "), entities.spelled(size * 100), F.lit(" ngàn"))
    asked = table(spark, sf_dir, "part").select("p_partkey", phrase.alias("text"))
    return entities.compat_quantity(asked).select("p_partkey", "quantity")


@query("SELECT o_orderkey, [d, m, y] AS nums FROM " + ORDER_ROWS)
def get_nums(spark, sf_dir):
    d, m, y = (f("o_orderdate").cast("string") for f in (F.day, F.month, F.year))
    return table(spark, sf_dir, "orders").select("o_orderkey", entities.get_nums(F.concat_ws("-", d, m, y)).alias("nums"))


# Rules of segmented_turns, in the format of a rule file.
SEGMENT_RULES = (
    'True : object.conclusion = "NN"',
    '\tobject.tag == "I" : object.conclusion = "I"',
    '\t\tobject.prevWord1 == "the" : object.conclusion = "B"',
    '\t\t\tobject.prevWord1 == "the" and object.nextTag1 == "I" : object.conclusion = "I"',
    '\t\tobject.prevTag1 == "I" and object.nextWord1 == "." : object.conclusion = "B"',
    '\t\tobject.prevWord2 == "" and object.prevWord1 == "la" : object.conclusion = "B"',
    '\tobject.tag == "B" : object.conclusion = "B"',
    '\t\tobject.prevWord1 == "de" and object.word == "la" : object.conclusion = "I"',
    '\t\t\tobject.nextTag1 == "I" : object.conclusion = "B"',
    '\t\tobject.prevTag1 == "I" and object.nextWord2 == "," : object.conclusion = "I"',
)
#: Sequences of two and three words are units from so many places in the documents on.
UNIT_LENGTHS, UNIT_PLACES = (2, 3), 20
LETTERS = segment.LETTERS


def _sql_rule(rule: segment.Rule) -> str:
    """A rule's tag over columns word_<offset>, tag_<offset>."""
    whens = []
    for r in rule.exceptions:
        holds = " AND ".join(f'"{kind}_{offset}" = {text(value)}' for offset, kind, value in r.atoms)
        whens.append(f"WHEN {holds} THEN {_sql_rule(r)}")
    return f"CASE {' '.join(whens)} ELSE {text(rule.tag)} END" if whens else text(rule.tag)


def _sql_segmented() -> str:
    cut = text(segment.WORD)
    window = "OVER (PARTITION BY k ORDER BY i)"
    near = ", ".join(
        f"coalesce({'lag' if o < 0 else 'lead'}({source}, {abs(o)}) {window}, '') AS \"{kind}_{o}\""
        for o in range(-2, 3) for kind, source in (("word", "w"), ("tag", "t"))
    )
    grams = " UNION ALL ".join(
        f"SELECT *, {n} AS n, concat_ws(' ', w{''.join(f', lead(w, {j}) {window}' for j in range(1, n))}) AS phrase, lead(w, {n - 1}) {window} AS closing FROM {{rows}}"
        for n in UNIT_LENGTHS
    )
    unknown = f"list_filter(string_split(phrase, ' '), lambda x: NOT regexp_matches(x, {text(LETTERS)}))"
    return f"""WITH RECURSIVE d AS (SELECT k, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM (SELECT row_number() OVER () AS k, regexp_extract_all(lower(text), {cut}) AS w FROM documents)),
lexicon AS (SELECT phrase, n FROM ({grams.format(rows="d")}) WHERE closing IS NOT NULL GROUP BY ALL HAVING count(*) >= {UNIT_PLACES} AND len({unknown}) = 0),
turns AS MATERIALIZED (SELECT conv_id, turn, row_number() OVER () AS k, text FROM conversations),
places AS MATERIALIZED (SELECT k, unnest(range(1, len(form) + 1)) AS i, unnest(form) AS form, lower(unnest(form)) AS w FROM (SELECT k, regexp_extract_all(text, {cut}) AS form FROM turns)),
longest AS (SELECT k, i, max(n) AS n FROM (SELECT k, i, n, phrase FROM ({grams.format(rows="places")}) WHERE closing IS NOT NULL) JOIN lexicon USING (phrase, n) GROUP BY k, i),
steps AS MATERIALIZED (SELECT k, i, coalesce(n, 1) AS n FROM places LEFT JOIN longest USING (k, i)),
walk AS (SELECT k, i FROM steps WHERE i = 1 UNION ALL SELECT walk.k, walk.i + n FROM walk JOIN steps ON walk.k = steps.k AND walk.i = steps.i),
tagged AS (SELECT k, p.i, w, form, CASE WHEN walk.i IS NULL THEN 'I' ELSE 'B' END AS t FROM places p LEFT JOIN walk USING (k, i)),
near AS (SELECT k, i, form, {near} FROM tagged),
ruled AS (SELECT k, string_agg(CASE WHEN {_sql_rule(segment.parse_rules(SEGMENT_RULES))} = 'I' THEN '_' ELSE ' ' END || form, '' ORDER BY i) AS s FROM near GROUP BY k)
SELECT conv_id, turn, coalesce(substr(s, 2), '') AS segmented FROM turns LEFT JOIN ruled USING (k)"""


@query(_sql_segmented())
def segmented_turns(spark, sf_dir):
    """Turns cut into units: frequent word sequences of the documents are the lexicon."""
    lexicon = segment.frequent_phrases(table(spark, sf_dir, "documents"), UNIT_PLACES)
    rules = segment.parse_rules(SEGMENT_RULES)
    return segment.segment(turns(spark, sf_dir, text=F.col("text")), lexicon, rules).select("conv_id", "turn", "segmented")
