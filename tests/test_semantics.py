"""Small expectations written from the operators' definitions."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answerloom.functions import entities, ngrams
from answerloom.functions import text as tx
from answerloom.operators import classify, corpus, evaluate, links, ranking, vectors, voting
from answerloom.operators.index import BM25Index, build_searcher
from answerloom.sources import readers, writers
from answerloom.streaming.ingest import write_postings


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


def test_passages_get_a_stop_each(spark):
    assert one(spark, "A b.  C 3.5 d", tx.to_passages) == ["A b.", "C 3.5 d."]
    assert one(spark, "", tx.to_passages) == []


def test_preprocess(spark):
    assert one(spark, "a<i>x</i> (c)", tx.preprocess_text) == "ax c "


def test_accents(spark):
    assert one(spark, "Đường phố", tx.remove_accents) == "Duong pho"
    assert spark.createDataFrame([("Đường",)], "c string").select(tx.strip_accents("c")).first()[0] == "Đuong"


def test_dedupe_keeps_the_last(spark):
    assert one(spark, "a b a c b", tx.dedupe_tokens) == "a c b"


def test_question_type(spark):
    assert one(spark, "so whatever when", tx.question_type) == "What"
    assert one(spark, "ai", tx.question_type) == "others"


def test_page_title(spark):
    assert one(spark, "a_b_3", tx.page_title) == "a_b"


def test_json_contents(spark):
    assert one(spark, '{"contents": "x"}', tx.json_contents) == "x"
    assert one(spark, "plain", tx.json_contents) == "plain"


def test_ngram_overlap_and_compat(spark):
    df = spark.createDataFrame([("Anh Hai Ba đi chợ", "Anh Hai Ba về")], "a string, b string")
    df = ngrams.with_profile(ngrams.with_profile(df, "a", "p"), "b", "q")
    plain, compat = df.select(ngrams.overlap(F.col("p"), F.col("q")), ngrams.overlap(F.col("p"), F.col("q"), True)).first()
    assert plain == 2 * (3 + 2 + 1) and compat == plain


def test_char_similarity_has_no_nan(spark):
    df = spark.createDataFrame([("a", "b"), ("abc", "abc")], "a string, b string")
    assert [r[0] for r in df.select(ngrams.char_similarity(F.col("a"), F.col("b"), 2)).collect()] == [0.0, 1.0]


def test_ranked_passages_count_the_title(spark):
    from answerloom.plans import pipelines

    asked = spark.createDataFrame([(1, "where is the old red bridge")], "qid int, question string")
    rows = [(1, "nothing here", "it is the old one. no."), (2, "old red bridge", "see the old map."), (3, None, "no match.")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, text string")
    hits = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "qid int, doc_id long")
    score = lambda d: {(r["doc_id"], r["passage"]): r["score"] for r in pipelines.ranked_passages(asked, d, hits).collect()}
    plain, titled = score(docs.drop("title")), score(docs)
    pair = spark.createDataFrame([("where is the old red bridge", "old red bridge")], "a string, b string")
    pair = ngrams.with_profile(ngrams.with_profile(pair, "a", "q"), "b", "t")
    extra = pair.select(ngrams.overlap(F.col("q"), F.col("t"))).first()[0]
    assert extra > 0 and titled == {k: v + (extra if k[0] == 2 else 0) for k, v in plain.items()}
    best = pipelines.best_passages(pipelines.ranked_passages(asked, docs, hits), 1).first()
    assert best["doc_id"] == 2 and max(plain, key=plain.get)[0] == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ngày 5 tháng 6 năm 1999", (1999, 6, 5)), ("tháng 3/2001", (2001, 3, 0)), ("ngày 9", (0, 0, 0)),
        ("ngày 2 tháng chạp", (0, 12, 2)), ("không có", (0, 0, 0)), ("10:30 utc ngày 1/2/2003", (2003, 2, 1)),
    ],
)
def test_dates(spark, text, want):
    got = one(spark, text, entities.extract_datetime)
    assert (got["year"], got["month"], got["date"]) == want


def test_numbers_round_trip(spark):
    rows = entities.number_lexicon(spark).withColumn("back", entities.number_value(F.col("words"))).collect()
    assert len(rows) == entities.LARGEST == len({r["words"] for r in rows}) and all(r["back"] == r["n"] for r in rows)


def test_section_docs(spark):
    page = "lead\n==One==\ntext\n===Sub===\nmore\n==Xem thêm.==\ngone\n"
    docs = spark.createDataFrame([(1, "T", page)], "doc_id long, title string, text string")
    got = [(r["section_id"], r["contents"]) for r in corpus.section_docs(docs).orderBy("ordinal").collect()]
    assert got == [("T_0", "lead "), ("T_1", "T text "), ("T_2", "T One more ")]


def test_f1_cases(spark):
    df = spark.createDataFrame([("the cat", "a cat"), ("", ""), ("x", ""), ("a b b", "b b c")], "g string, p string")
    got = [round(r[0], 6) for r in df.select(evaluate.token_f1(F.col("g"), F.col("p"))).collect()]
    assert got == [1.0, 1.0, 0.0, 0.8]


def test_best_threshold(spark):
    rows = [(1, 0.1, True, True, 1.0), (2, 0.2, False, True, 0.0), (3, 0.9, True, True, 1.0)]
    df = spark.createDataFrame(rows, "qid int, na_prob double, has_answer boolean, answered boolean, s double")
    best = evaluate.best_threshold(df, "s").first()
    assert best["best"] == pytest.approx(66.666667) and best["threshold"] == 0.1


def test_squad_evaluate(spark):
    golds = spark.createDataFrame([(1, "cat"), (2, "")], "qid int, gold string")
    preds = spark.createDataFrame([(1, "the cat", 0.0), (2, "x", 0.9)], "qid int, pred string, na_prob double")
    assert evaluate.squad_evaluate(golds, preds, 0.5).first()["exact"] == 100.0


def test_number_pattern(spark):
    for s, want in (("12", True), ("1_000", True), ("10d", False), ("-1.5e3", True), ("", False), ("nan", True)):
        assert one(spark, s, classify.is_number) is want


def test_rules(spark):
    assert one(spark, "bao giờ đi", classify.rule_category) == "datetime"
    assert one(spark, "bao giờ đi", lambda c: classify.label_category(c, F.lit("x"))) == "quantity"


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "hà nội đẹp"), (2, "huế đẹp đẹp"), (3, "")], "doc_id long, text string")
    index = BM25Index.build(docs)
    writers.write_index(index, str(tmp_path / "i"), 2)
    again = readers.read_index(spark, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "đẹp"), (2, "zz")], "qid int, question string")
    assert [r["doc_id"] for r in again.search(q, 5).orderBy("rank").collect()] == [2, 1]
    with pytest.raises(ValueError):
        build_searcher("other")
    with pytest.raises(ValueError):
        readers.read_prebuilt(spark, "x", "dpr")


def whole(folder):
    """The JSON document that a folder's text files are, in order of their names."""
    return json.loads("".join(f.read_text(encoding="utf-8") for f in sorted(folder.glob("part-*"))))


def test_files_round_trip(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "c.jsonl").write_text('{"id":"1","title":"a","text":"x"}\n{"id":"1","title":"b","text":"<i>y"}\n', encoding="utf-8")
    assert readers.read_corpus(spark, p("c.jsonl")).first()["title"] == "b"
    (tmp_path / "d" / "AA").mkdir(parents=True)
    (tmp_path / "d" / "AA" / "wiki_00").write_text('{"id":"1","title":"t"}\n')
    (tmp_path / "d" / "AA" / "other").write_text('{"id":"2"}\n')
    assert [r["id"] for r in readers.read_dump(spark, p("d")).collect()] == ["1"]
    (tmp_path / "t.txt").write_text(" A \nB (định hướng)\n", encoding="utf-8")
    assert [r["title"] for r in readers.read_titles(spark, p("t.txt")).collect()] == ["A"]
    (tmp_path / "e.tsv").write_text("l\twiki/A\tT\n\twiki/B\tT\n\n")
    assert [r["label"] for r in readers.read_link_edges(spark, p("e.tsv")).collect()] == ["l"]
    (tmp_path / "q.json").write_text(json.dumps({"_count_": 1, "data": [{"id": "1", "question": "q"}]}))
    q = readers.read_questions(spark, p("q.json"))
    assert q.first()["question"] == "q"
    writers.write_submission(q, p("s"))
    assert whole(tmp_path / "s")["data"] == [{"id": "1", "question": "q", "answer": None}]
    squad = {"data": [{"paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "é?", "answers": [{"text": "a", "answer_start": 0}]}]}]}]}
    (tmp_path / "s.json").write_text(json.dumps(squad))
    raw = spark.read.schema(readers.SQUAD).option("multiLine", True).json(p("s.json"))
    assert readers.squad_questions(raw, True).first()["question"] == "e?"
    (tmp_path / "cfg.json").write_text('{"k1": 1.2, "unknown": 3}')
    assert readers.Config.read(p("cfg.json")).k1 == 1.2
    writers.write_chunks(spark.range(10).coalesce(1), p("chunks"), 3)
    assert len(list((tmp_path / "chunks").glob("chunk=*/part-*"))) == 4


def test_stream_of_postings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "a b a")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    write_postings(docs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["term"]: r["tf"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 2, "b": 1}


RULES = (
    'True : object.conclusion = "B"',
    '\tobject.tag == "I" : object.conclusion = "I"',
    '\t\tobject.prevWord1 == "quần" : object.conclusion = "B"',
    '\t\t\tobject.prevWord1 == "quần" and object.word == "áo" : object.conclusion = "I"',
    '\tobject.nextWord1 == "x" : object.conclusion = "I"',
)


def test_rule_tree_segments(spark):
    from answerloom.operators import segment

    root = segment.parse_rules(RULES)
    node = segment.indexed(root)
    assert segment.tag(node, ["quần", "áo", "dài"], ["B", "I", "I"]) == ["B", "I", "I"]
    assert segment.tag(node, ["quần", "dài", "x"], ["B", "I", "B"]) == ["B", "B", "B"]
    rows = spark.createDataFrame([(1, "Quần áo đẹp."), (1, "Quần áo đẹp."), (2, None), (3, ""), (4, " ,x")], "tags int, text string")
    lexicon = spark.createDataFrame([("quần áo",), ("áo đẹp",), ("Đẹp",), (None,)], "phrase string")
    got = segment.segment(rows, lexicon, root).collect()
    assert sorted(r["segmented"] for r in got) == ["", "", ", x", "Quần_áo đẹp .", "Quần_áo đẹp ."]
    assert all(len(r["tags"]) == len(r["first_tags"]) == len(r["words"]) for r in got)
    with pytest.raises(ValueError, match="hangs under none"):
        segment.parse_rules([RULES[0], RULES[2]])


def random_rules(rng, n):
    """A rule file of n lines below the root, up to three levels deep."""
    names = [f"{side}{kind}{d}" for side in ("prev", "next") for kind in ("Word", "Tag") for d in "12"] + ["word", "tag"]
    lines, depth = ['True : object.conclusion = "NN"'], 0
    for _ in range(n):
        depth = rng.randint(1, min(depth + 1, 3))
        atoms = [
            f'object.{x} == "{rng.choice(["B", "I", ""]) if "ag" in x else rng.choice(SYLLABLES)}"'
            for x in rng.sample(names, rng.randint(1, 3))
        ]
        lines.append("\t" * depth + " and ".join(atoms) + f' : object.conclusion = "{rng.choice("BI")}"')
    return lines


SYLLABLES = ["a", "b", "c", "đ", "e", "ô", ",", ""]


def test_segmentation_equals_walks(spark, tmp_path, monkeypatch):
    """A file of 1,500 rules and a lexicon file, both ways of tagging, against plain walks."""
    import random

    from answerloom.operators import segment
    from tests.definitions import longest_matches, ripple_down

    rng = random.Random(5)
    lines = random_rules(rng, 1500)
    (tmp_path / "rules").write_text("\n".join(lines) + "\n", encoding="utf-8")
    root = segment.read_rules(spark, str(tmp_path / "rules"))
    count = lambda r: 1 + sum(map(count, r.exceptions))
    assert count(root) == 1501
    phrases = {" ".join(rng.choices("abcđeô", k=rng.randint(1, 4))) for _ in range(60)}
    (tmp_path / "lexicon").write_text("\n".join(p.replace(" ", "_") for p in sorted(phrases)) + "\n\n", encoding="utf-8")
    lexicon = segment.read_lexicon(spark, str(tmp_path / "lexicon"))
    texts = [" ".join(rng.choices("abcđeôAĐ,", k=rng.randint(0, 40))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "text string").repartition(3)
    got = segment.segment(rows, lexicon, root).collect()
    assert len(got) == 302
    for r in got:
        low = [w.lower() for w in r["words"]]
        assert r["first_tags"] == longest_matches(phrases, low)
        assert r["tags"] == ripple_down(lines, low, r["first_tags"])
    assert len({t for r in got for t in r["tags"]}) > 1
    monkeypatch.setattr(segment, "MOST_ENTRIES", 3)
    joined = segment.with_first_tags(rows.withColumn("words", segment.words_of(F.col("text"))), lexicon)
    key = lambda r: (r["text"] or "", r["first_tags"])
    assert sorted(map(key, joined.collect())) == sorted(map(key, got))
    none = spark.createDataFrame([], "phrase string")
    monkeypatch.setattr(segment, "MOST_ENTRIES", -1)
    bare = segment.with_first_tags(rows.withColumn("words", segment.words_of(F.col("text"))), none)
    assert {t for r in bare.collect() for t in r["first_tags"]} == {"B"}


def test_contexts(spark):
    from answerloom.operators.contexts import hit_contexts, link_position_map, with_contents

    hits = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "z", 0.5)], "qid int, doc_id string, score double")
    store = spark.createDataFrame([("a", '{"contents": "good"}'), ("b", "bad text")], "doc_id string, raw string")
    got = hit_contexts(with_contents(hits, store), ["bad"]).collect()
    assert [(r["title"], r["text"]) for r in got] == [("a", "good")]
    at = spark.createDataFrame([("T", 0, [("L", 1, 2)])], "title string, line int, links array<struct<link: string, start: long, end: long>>")
    assert link_position_map(at).first()["lines"]["0"]["L"]["end"] == 2
    twice = [("T", 0, [("L", 1, 2), ("M", 3, 3), ("L", 5, 6)]), ("T", 1, []), ("T", 0, [("L", 0, 9)]), ("U", 0, [])]
    got = {r["title"]: r["lines"] for r in link_position_map(spark.createDataFrame(twice, at.schema)).collect()}
    assert {k: tuple(v) for k, v in got["T"]["0"].items()} == {"M": (3, 3), "L": (5, 6)}
    assert got["T"]["1"] == {} and got["U"] == {"0": {}}


def test_thresholds_and_scorers(spark):
    rows = [(1, 0.1, True, True, 1.0, 0.5), (2, 0.2, False, True, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "qid int, na_prob double, has_answer boolean, answered boolean, exact double, f1 double")
    both = evaluate.all_best_thresholds(df).first()
    assert both["best_exact"] == 100.0 and both["best_f1"] == 75.0
    assert evaluate.best_threshold_with_answered(df, "f1").first()["has_answer_score"] == 0.5
    assert evaluate.all_best_thresholds_with_answered(df).first()["has_ans_exact"] == 1.0
    a = spark.createDataFrame([(1, "x", 1), (1, "yy", 2)], "qid int, answer string, ord int")
    assert ranking.choose_best(a, ["qid"], lambda d: F.length(d["answer"])).first()["answer"] == "yy"


def test_bag_cosine_counts_repeats(spark):
    a, b = ["x", "y", "x"], ["x", "x", "z", "y"]
    df = spark.createDataFrame([(a, b), ([], b), ([], [])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(vectors.bag_cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(5 / (5**0.5 * 6**0.5)), 0.0, 0.0]


def test_gram_list_of_short_and_null(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), (None,)], "t array<string>")
    rows = df.select(ngrams.gram_list(F.col("t"), 1), ngrams.gram_list(F.col("t"), 2)).collect()
    assert [tuple(r) for r in rows] == [(["a", "b", "c"], ["a b", "b c"]), (["a"], []), ([], [])]


def test_keys_of_long_pages_and_conversations_do_not_meet(spark, tmp_path):
    from answerloom.plans.catalog import QUERIES

    anchor = lambda i: f'<a href="/t{i}">label{i}</a>'
    html = lambda title, ids: f"<title>{title}</title>" + " ".join(map(anchor, ids))
    pages = [(1, html("One", range(1003))), (2, html("Two", [5000, 5001, 5002]))]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["link_resolve"](spark, str(tmp_path)).collect()
    assert len(got) == 1006 and {r["label"] for r in got} == {f"label{i} page" for i in [*range(1003), 5000, 5001, 5002]}
    turns = [(1, i, "user", f"word{i // 2}") for i in range(1003)] + [(2, i, "user", "x") for i in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    f1 = QUERIES["token_f1"](spark, str(tmp_path)).collect()
    assert len(f1) == 1002 + 3 and sum(r["exact"] for r in f1) == 501 + 3
    assert QUERIES["na_threshold"](spark, str(tmp_path)).count() == 1005
    assert QUERIES["eval_summary"](spark, str(tmp_path)).first()["total"] == 1005


def test_a_label_of_many_pages_is_resolved_without_all_their_entries(spark):
    """Equal to the definition; the rows that labels and entries join to grow with both, not with their product."""
    rng = random.Random(8)
    sources = ["wiki", None, "", *(f"p{i}" for i in range(8))]
    entries = {(rng.choice("ab"), rng.choice(sources)): (f"l{i}", rng.randrange(5), rng.randrange(3)) for i in range(40)}
    entries |= {("c", "p1"): (None, 1, 1), ("d", "p2"): ("l", 2, 1)}
    asked = [(i, rng.choice(["a", "b", "c", "d", "e", None]), rng.choice(sources)) for i in range(200)]
    d = spark.createDataFrame([(*k, *v) for k, v in entries.items()], "label string, source_title string, link string, ord long, place long")
    q = spark.createDataFrame(asked, "qid long, label string, page_title string")
    for last in (False, True):
        want = set()
        for qid, label, page in asked:
            sign = -1 if last else 1
            rank = lambda s, page=page: 0 if s is not None and s == page else 1 if s == "wiki" else 2
            found = sorted((rank(s), sign * o, sign * p, s is not None, s or "", link or "") for (n, s), (link, o, p) in entries.items() if n == label)
            want.add((qid, label, page, (found[0][-1] or None) if found else None))
        assert {tuple(r) for r in links.resolve_links(q, d, last).collect()} == want
    n = 3000
    d = spark.range(n).selectExpr("'a' label", "concat('p', id) source_title", "concat('l', id) link", "id ord", "0L place")
    q = spark.range(n).selectExpr("id qid", "'a' label", "concat('p', 2 * id) page_title")
    got = links.resolve_links(q, d)
    assert got.filter("link = concat('l', if(qid < 1500, 2 * qid, 0))").count() == n
    rows = []

    def walk(node):
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            rows.append(metric.get().value())
        more = [node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else [node.plan()] if "QueryStage" in node.nodeName() else []
        at = node.children()
        for child in [*more, *(at.apply(i) for i in range(at.size()))]:
            walk(child)

    got.collect()
    walk(got._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 2 * n
