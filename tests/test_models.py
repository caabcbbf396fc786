"""The two models end to end, their evaluation, and files in and out, on small fixtures."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from answerloom.functions.text import words
from answerloom.operators import classify, corpus, evaluate, links, ranking, reader, segment
from answerloom.operators.index import BM25Index, DenseIndex, build_searcher
from answerloom.plans import pipelines
from answerloom.sources import readers, writers
from tests.definitions import basic_tokens, final_text
from tests.test_semantics import whole

FEATURE = "qid string, feature_id long, tokens array<string>, orig_map map<int,int>, max_context map<int,boolean>, start_logits array<double>, end_logits array<double>"


def brute_nbest(features, examples, n, longest, null_threshold, tokenise=basic_tokens):
    """(nbest, prediction, odds) by question, walked entry by entry."""
    out = {}
    best = lambda x: sorted(range(len(x)), key=lambda i: -x[i])[:n]
    for qid, doc in examples:
        spans, null = [], None
        for _, f, tokens, own, context, s, e in sorted((x for x in features if x[0] == qid), key=lambda x: x[1]):
            if null is None or s[0] + e[0] < sum(null):
                null = (s[0], e[0])
            for i in best(s):
                for j in best(e):
                    if max(i, j) < len(tokens) and i in own and j in own and context.get(i) and 0 <= j - i < longest:
                        tok = " ".join(tokens[i : j + 1]).replace(" ##", "")
                        orig = " ".join(doc[own[i] : own[j] + 1])
                        spans.append((final_text(tok, orig, " ".join(tokenise(orig))) if i else "", s[i], e[j], i))
        if null_threshold is not None:
            spans.append(("", *null, 0))
        spans.sort(key=lambda x: -(x[1] + x[2]))
        rows, seen = [], set()
        for text, s, e, i in spans:
            if len(rows) == n:
                break
            if i and text in seen:
                continue
            seen.add(text)
            rows.append((text, s, e))
        if null_threshold is not None:
            if "" not in seen:
                rows.append(("", *null))
            if len(rows) == 1:
                rows.insert(0, ("empty", 0.0, 0.0))
        rows = rows or [("empty", 0.0, 0.0)]
        if null_threshold is None:
            out[qid] = (rows, (rows[0][0], sum(rows[0][1:])), None)
            continue
        other = next((r for r in rows if r[0]), None)
        odds = sum(null) - sum(other[1:])
        out[qid] = (rows, ("", 0.0) if odds > null_threshold else (other[0], sum(other[1:])), odds)
    return out


@pytest.fixture(scope="module")
def spans(spark):
    doc = ["Steve", "Smith's", "big", "house", "in", "Rome"]
    tokens = ["[CLS]", "who", "steve", "smith", "'", "s", "big", "house", "in", "ro", "##me", "[SEP]"]
    own = {2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 7: 3, 8: 4, 9: 5, 10: 5}
    context = {k: k != 6 for k in own}
    a = [0.5, 0.1, 3.0, 2.0, 0.0, 0.2, 5.0, 1.0, 0.1, 2.9, 0.0, 0.0]
    b = [0.2, 0.1, 0.3, 3.0, 0.0, 2.5, 0.1, 1.5, 0.1, 0.3, 2.8, 0.0]
    few = [-9.0] * 12
    rows = [
        ("q1", 1, tokens, own, context, a, b), ("q1", 2, tokens[:5], {2: 0, 3: 1}, {2: True, 3: True}, a, b),
        ("q2", 3, tokens, {}, {}, a, b), ("q3", 4, tokens, own, context, [9.0, *few[1:]], [9.0, *few[1:]]),
        ("q4", 5, tokens, own, {k: False for k in own}, few, few),
    ]
    examples = [(q, doc) for q in ("q1", "q2", "q3", "q4")]
    return rows, examples, spark.createDataFrame(rows, FEATURE), spark.createDataFrame(examples, "qid string, doc_tokens array<string>")


@pytest.mark.parametrize("null_threshold", [None, 0.0, -30.0])
@pytest.mark.parametrize("n", [3, 20])
def test_nbest_from_logits(spans, n, null_threshold):
    rows, examples, features, docs = spans
    want = brute_nbest(rows, examples, n, 4, null_threshold)
    got = evaluate.predictions_logits(features, docs, n, 4, null_threshold)
    listed = {}
    for r in got.nbest.orderBy("qid", "rank").collect():
        listed.setdefault(r["qid"], []).append((r["text"], r["start_logit"], r["end_logit"]))
        assert r["probability"] == r["start_logit"] + r["end_logit"]
    assert listed == {q: w[0] for q, w in want.items()}
    assert {r["qid"]: (r["text"], r["score"]) for r in got.predictions.collect()} == {q: w[1] for q, w in want.items()}
    if null_threshold is None:
        assert got.null_odds is None and "Steve Smith" in [t for t, _, _ in listed["q1"]]
    else:
        assert {r["qid"]: r["null_odds"] for r in got.null_odds.collect()} == {q: w[2] for q, w in want.items()}


def test_nbest_from_log_probs(spark, spans):
    rows, examples, features, docs = spans
    top = features.withColumns(
        {
            "paragraph_len": F.lit(12), "cls_logit": F.get("start_logits", F.lit(0)), "start_top_index": F.expr("array(2, 9)"),
            "start_log_probs": F.expr("array(-1D, -2D)"), "end_top_index": F.expr("array(3, 5, 10, 9)"), "end_log_probs": F.expr("array(-1D, -3D, -0.5D, -9D)"),
        }
    )
    got = evaluate.predictions_log_probs(top.filter("feature_id <> 2"), docs, 3, 4)
    q1 = [(r["text"], r["start_logit"] + r["end_logit"], r["probability"]) for r in got.nbest.filter("qid = 'q1'").orderBy("rank").collect()]
    assert [x[:2] for x in q1] == [("Steve Smith", -2.0), ("Rome", -2.5), ("Steve Smith's", -4.0)]
    total = sum(math.exp(x[1]) for x in q1)
    assert [x[2] for x in q1] == [pytest.approx(math.exp(x[1]) / total) for x in q1]
    assert got.nbest.filter("qid = 'q4'").first()["text"] == "" and {r["qid"]: r["null_odds"] for r in got.null_odds.collect()}["q3"] == 9.0
    assert got.predictions.filter("qid = 'q1'").first()["text"] == "Steve Smith"


def test_prediction_files(spans, tmp_path):
    _, _, features, docs = spans
    writers.write_predictions(evaluate.predictions_logits(features, docs, 3, 4, 0.0), str(tmp_path / "p"))
    assert set(whole(tmp_path / "p" / "predictions")) == set(whole(tmp_path / "p" / "null_odds")) == {"q1", "q2", "q3", "q4"}
    assert whole(tmp_path / "p" / "predictions")["q3"] == ["", 0.0]
    assert whole(tmp_path / "p" / "nbest")["q1"][0]["text"] == whole(tmp_path / "p" / "predictions")["q1"][0]


def test_squad_evaluate_with_and_without_probabilities(spark):
    golds = spark.createDataFrame([(1, "cat"), (2, ""), (3, "dog"), (4, None)], "qid int, gold string")
    preds = spark.createDataFrame([(1, "the cat", 0.1), (2, "x", 0.9), (3, "cow", 0.2), (4, "", None)], "qid int, pred string, na_prob double")
    got = evaluate.squad_evaluate(golds, preds, 0.5).first()
    assert (got["exact"], got["HasAns_exact"], got["NoAns_exact"], got["total"]) == (75.0, 50.0, 100.0, 4)
    assert (got["best_exact"], got["best_exact_thresh"]) == (75.0, 0.1)
    plain = evaluate.squad_evaluate(golds, preds.drop("na_prob")).first()
    assert plain["exact"] == 50.0 and plain["best_exact"] >= 50.0


CATEGORIES = [(1, "quantity"), (2, "datetime"), (3, "wiki"), (4, "other"), (5, "quantity"), (6, "datetime")]


def test_format_answers(spark):
    rows = [
        (1, 1, "năm mươi"), (1, 2, "khoảng 12"), (1, 3, "không rõ"), (1, 4, "50"), (2, 1, "không"), (2, 2, "ngày 5 tháng 6"),
        (2, 3, "ngày 5 tháng 6"), (2, 4, "năm 1999"), (3, 1, "Hà Nội"), (3, 2, "Huế"), (4, 1, "x"), (5, 1, "không ai"), (5, 2, "7"), (6, 1, "null"),
    ]
    candidates = spark.createDataFrame(rows, "qid int, rank long, answer string")
    kinds = spark.createDataFrame(CATEGORIES, "qid int, category string")
    linked = spark.createDataFrame([(3, "wiki/Hà_Nội")], "qid int, link string")
    got = {r["qid"]: r for r in pipelines.format_answers(candidates, kinds, linked).collect()}
    assert {q: r["answer"] for q, r in got.items()} == {1: "50", 2: "ngày 5 tháng 6", 3: "wiki/Hà_Nội", 4: None, 5: None, 6: None}
    assert got[1]["answers"] == ["50", "12", None] and got[2]["answers"] == ["ngày 5 tháng 6", "năm 1999"]
    assert got[3]["answers"] == ["wiki/Hà_Nội", None] and got[5]["answers"] == [None, "7"] and got[6]["answers"] == [None]
    assert got[1]["raw_answers"] == ["năm mươi", "khoảng 12", "không rõ", "50"]


@pytest.fixture(scope="module")
def world(spark):
    docs = spark.createDataFrame(
        [
            (1, "Hà Nội", "Hà Nội là thủ đô.\nThủ đô của Việt Nam là Thăng-Long."), (2, "Huế", "Huế cao bao nhiêu mét thì Năm-mươi mét."),
            (3, "Sài Gòn", "Sài Gòn sinh khi nào\nSài Gòn sinh ra Tháng-3/1698 đó."), (4, "Đà Nẵng", "Đà Nẵng không có gì."),
        ],
        "doc_id long, title string, text string",
    )
    labelled = [("thủ đô của nước là gì", "wiki"), ("thủ đô là đâu", "wiki"), ("vì sao trời xanh", "other"), ("tại sao thế", "other")]
    model = classify.fit_categories(spark.createDataFrame(labelled, "question string, category string").coalesce(1))
    titles = docs.select("title").union(spark.createDataFrame([("Thăng-Long",)], "title string"))
    edges = spark.createDataFrame([("x", "wiki/Huế", "P", 1)], "label string, link string, source_title string, place long")
    dictionary = links.link_dictionary(titles.select("title", F.monotonically_increasing_id().alias("ord")), edges)
    return docs, BM25Index.build(docs), titles, dictionary, model


def test_model_2_answers_every_category(spark, world):
    docs, index, titles, dictionary, model = world
    asked = spark.createDataFrame(
        [(1, "thủ đô của Việt Nam là gì"), (2, "Huế cao bao nhiêu mét"), (3, "Sài Gòn sinh khi nào"), (4, "vì sao Đà Nẵng xanh")], "qid long, question string"
    )
    got = {r["qid"]: r for r in pipelines.predict(asked, docs, index, titles, dictionary, model).collect()}
    assert {q: r["category"] for q, r in got.items()} == {1: "wiki", 2: "quantity", 3: "datetime", 4: "other"}
    assert got[1]["answer"].startswith("wiki/") and got[4]["answer"] is None
    assert got[3]["answer"] == "tháng 3 năm 1698"
    assert got[2]["raw_answers"]


def test_titles_stand_before_the_contexts_of_wiki_questions(spark):
    rows = spark.createDataFrame([(1, "who", "T", "p"), (2, "who", "T", "p"), (3, "who", None, "p")], "qid int, question string, title string, passage string")
    kinds = spark.createDataFrame([(1, "wiki"), (2, "other"), (3, "wiki")], "qid int, category string")
    assert {r["qid"]: r["context"] for r in pipelines.with_context(rows, kinds).collect()} == {1: "T . p", 2: "p", 3: " . p"}


def test_a_batch_from_file_to_submission(spark, world, tmp_path):
    docs, index, titles, dictionary, model = world
    batch = {"_count_": 2, "data": [{"id": "b", "question": "Sài Gòn sinh khi nào", "answer": "?"}, {"id": "a", "question": "vì sao Đà Nẵng xanh"}]}
    (tmp_path / "q.json").write_text(json.dumps(batch), encoding="utf-8")
    answer = lambda q: pipelines.predict(q, docs, index, titles, dictionary, model)
    watch = pipelines.answer_file(spark, str(tmp_path / "q.json"), str(tmp_path / "out"), answer)
    got = whole(tmp_path / "out" / "submission")["data"]
    assert [(x["id"], x["answer"]) for x in got] == [("b", "tháng 3 năm 1698"), ("a", None)]
    assert watch.rows[0][1] > 0 and spark.read.csv(str(tmp_path / "out" / "latency")).count() == 2
    assert spark.read.json(str(tmp_path / "out" / "results")).count() == 2
    assert pipelines.warm_up(spark, answer, "Sài Gòn sinh khi nào") == "tháng 3 năm 1698"


def test_two_question_files_and_their_latencies(spark, world, tmp_path):
    docs, index, titles, dictionary, model = world
    (tmp_path / "in").mkdir()
    for f, data in (("b.json", [{"id": "3", "question": "Huế?"}]), ("a.json", [{"id": "1", "question": "Sài Gòn sinh khi nào"}, {"id": "2", "question": "vì sao xanh"}]), ("c.json", [])):
        (tmp_path / "in" / f).write_text(json.dumps({"data": data}), encoding="utf-8")
    q = readers.read_questions(spark, str(tmp_path / "in"))
    assert sorted((r["ord"], r["id"]) for r in q.collect()) == [(0, "1"), (1, "2"), (2, "3")]
    answer = lambda q: pipelines.predict(q, docs, index, titles, dictionary, model).select("qid", "answer")
    pipelines.answer_file(spark, str(tmp_path / "in"), str(tmp_path / "out"), answer, each=1)
    assert [(x["id"], x["answer"]) for x in whole(tmp_path / "out" / "submission")["data"]] == [("1", "tháng 3 năm 1698"), ("2", None), ("3", None)]
    times = {r["_c0"]: float(r["_c1"]) for r in spark.read.csv(str(tmp_path / "out" / "latency")).collect()}
    assert len(times) == len(set(times.values())) == 3


def test_all_raw_answers(spark):
    """Thirty lines of a question: all its raw answers, the first ten's entities."""
    text = "\n".join(f"Sài Gòn có Nhà{i} số {i}" for i in range(30))
    docs = spark.createDataFrame([(1, "T", text)], "doc_id long, title string, text string")
    q = spark.createDataFrame([(0, "Sài Gòn cao bao nhiêu mét")], "qid long, question string")
    titles = spark.createDataFrame([("T", 1)], "title string, ord long")
    none = spark.createDataFrame([], "label string, source_title string, link string, ord long, place long")
    got = pipelines.predict(q, docs, BM25Index.build(docs), titles, none).first()
    assert len(got["raw_answers"]) == 30 and got["category"] == "quantity" and len(got["answers"]) <= 10


def test_lines_follow_file_names_and_blocks(spark, tmp_path):
    line = lambda i, t: json.dumps({"id": str(i), "title": t, "text": "x"}) + "\n"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text(line(1, "a") + line(2, "a"))
    (tmp_path / "c" / "b.json").write_text("".join(line(i, "b") for i in range(3, 4000)) + line(1, "b"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = {r["id"]: r["title"] for r in readers.read_corpus(spark, str(tmp_path / "c")).filter("id in ('1', '2')").collect()}
        assert got == {"1": "b", "2": "a"}
        (tmp_path / "t").mkdir()
        (tmp_path / "t" / "b.txt").write_text("".join(f"{i}\n" for i in range(9000)))
        (tmp_path / "t" / "c.txt").write_text("last\n\n")
        lines = readers.read_lines(spark, str(tmp_path / "t"))
        assert lines.rdd.getNumPartitions() > 1 and [r["value"] for r in lines.orderBy("ord").collect()] == [*map(str, range(9000)), "last"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_more_files(spark, tmp_path):
    p = lambda n: str(tmp_path / n)
    (tmp_path / "q.csv").write_text('question,answer\n"a ""b""\nc",2\n', encoding="utf-8")
    assert readers.read_csv(spark, p("q.csv"), "question string, answer string").first()["question"] == 'a "b"\nc'
    (tmp_path / "l.json").write_text(json.dumps([{"question": "q", "answer": "a", "short_candidate": "s"}]))
    assert readers.read_json_list(spark, p("l.json")).first()["short_candidate"] == "s"
    (tmp_path / "e.tsv").write_text("b\twiki/A\tP\nb\twiki/B\tP\nx\ty\n")
    edges = readers.read_link_edges(spark, p("e.tsv"))
    titles = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "title string, ord long")
    d = links.link_dictionary(titles, edges)
    assert {(r["label"], r["source_title"]): r["link"] for r in d.collect()} == {("b", "P"): "wiki/B", **{(t, "wiki"): f"wiki/{t}" for t in "ABC"}}
    writers.write_link_dictionary(d, p("d"))
    same = lambda x: sorted(tuple(r) for r in x.select("label", "source_title", "link").collect())
    assert same(readers.read_link_dictionary(spark, p("d"), lines=True)) == same(d)
    (tmp_path / "d.json").write_text(json.dumps({"b": {"P": "wiki/B"}}, indent=1))
    assert readers.read_link_dictionary(spark, p("d.json")).first()["link"] == "wiki/B"
    whole_map = {f'n{i} "x" }}, y': {f"s{k}": f"wiki/{i}_{k}\u00e9}}" for k in range(i % 3)} for i in range(500)} | {"last": {"": ""}}
    (tmp_path / "m.json").write_text(json.dumps(whole_map, ensure_ascii=False) + "\n", encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        cut = readers.read_link_dictionary(spark, p("m.json"))
        assert cut.rdd.getNumPartitions() > 3
        want = sorted((a, b, c) for a, links in whole_map.items() for b, c in links.items())
        assert sorted(map(tuple, cut.collect())) == want == sorted(map(tuple, readers.read_link_dictionary(spark, p("m.json"), entry_end=None).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for body, n in (("{}", 0), ('{"a": {"b": "c"}}', 1), ('{"a": {}, "b": {"c": "d"}}', 1)):
        (tmp_path / "one.json").write_text(body)
        assert readers.read_link_dictionary(spark, p("one.json")).count() == n
    (tmp_path / "odd.json").write_text(json.dumps({"x}, ": {"a": "b"}, "y": {"c": "d"}}))
    with pytest.raises(Exception):
        readers.read_link_dictionary(spark, p("odd.json")).collect()
    writers.write_jsonl(spark.createDataFrame([("é",)], "t string"), p("j"), ascii=True)
    assert "".join(f.read_text() for f in (tmp_path / "j").glob("part-*.json")).strip() == '{"t":"\\u00E9"}'
    rows = spark.range(7).select(F.col("id").alias("ord"), (F.col("id") * 2).alias("v")).repartition(3)
    writers.write_json_array(rows, p("a"))
    assert whole(tmp_path / "a") == [{"v": 2 * i} for i in range(7)]
    writers.write_json_array(rows.limit(0), p("n"))
    assert whole(tmp_path / "n") == []
    for k, (n, sizes) in enumerate(((45, [2] * 22 + [1]), (40, [2] * 20), (7, [1] * 7))):
        writers.write_chunks(spark.range(n).orderBy(F.desc("id")).repartition(3), p(f"c{k}"), by=["id"])
        files = {int(f.parent.name[6:]): [json.loads(x)["id"] for x in f.read_text().splitlines()] for f in (tmp_path / f"c{k}").glob("chunk=*/part-*")}
        assert [len(files[i]) for i in range(len(files))] == sizes and [x for i in range(len(files)) for x in files[i]] == list(range(n))


def test_index_positions_vectors_and_dense_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "doc_id long, text string")
    index = BM25Index.build(docs, positions=True)
    got = {(r["doc_id"], r["term"]): r["positions"] for r in index.stored(str(tmp_path / "i")).postings.collect()}
    assert got == {(1, "a"): [0, 2], (1, "b"): [1], (2, "b"): [0], (2, "c"): [1]}
    assert {r["doc_id"]: [tuple(t) for t in r["terms"]] for r in index.document_vectors().collect()} == {1: [("a", 2), ("b", 1)], 2: [("b", 1), ("c", 1)]}
    dense = DenseIndex.build(docs, reader.HashingEncoder(64))
    dense.write(str(tmp_path / "v"))
    asked = spark.createDataFrame([(7, "c b")], "qid int, question string")
    for d in (dense, readers.read_index(spark, str(tmp_path / "v"), "dpr", reader.HashingEncoder(64)), build_searcher("dpr", vectors=dense.vectors, store=dense.store, encoder=dense.encoder)):
        first = d.contexts(asked, 2).orderBy(F.desc("score")).first()
        assert (first["title"], first["text"]) == (2, "b c")


def shout():
    return lambda questions, passages: [(p.split()[0].upper() + ",", 0.5, 0, len(p.split()[0])) for p in passages]


def lengths():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def test_models_are_plugged_in_batches(spark):
    rows = spark.createDataFrame([("q", "ab c"), ("q", "d")], "question string, passage string")
    got = reader.reader_of("batched", load=shout, batch=1).predict(rows).collect()
    assert sorted((r["answer"], r["reader_raw"], r["start"], r["end"]) for r in got) == [("AB", 0.5, 0, 2), ("D", 0.5, 0, 1)]
    sim = reader.encoder_of("batched", load=lengths).similarity(rows, "question", "passage", "s").collect()
    assert sorted(round(r["s"], 6) for r in sim) == [0.857493, 1.0]
    own = reader.reader_of().predict(spark.createDataFrame([("where", "in big Rome there"), ("where", "no")], "question string, passage string")).collect()
    assert {(r["answer"], r["start"], r["end"]) for r in own} == {("Rome", 7, 11), ("", None, None)}
    with pytest.raises(ValueError):
        reader.reader_of("none")


def test_links_of_pages_as_tables(spark):
    pages = spark.createDataFrame([(1, "see [[hue|Hue]]s {{x {{y}}}}"), (2, None), (3, "<syntaxhighlight lang='x'>a [[b]]</syntaxhighlight>")], "doc_id long, text string")
    spans = {(r["id"], r["open"], r["start"], r["end"]) for r in corpus.balanced_spans(pages).collect()}
    assert spans == {(1, "[[", 4, 15), (1, "{{", 17, 28), (3, "[[", 28, 33)}
    got = {r["doc_id"]: r["text"] for r in corpus.dump_records(pages.withColumn("title", F.lit("T")), rewrite=True).collect()}
    assert got == {1: "see [[wiki/Hue|Hue]]s {{x {{y}}}}", 2: None, 3: "a [[wiki/B|b]]"}
    titled = corpus.dump_records(spark.createDataFrame([("A", "x"), ("B", "y")], "title string, text string"), spark.createDataFrame([(" A ",), ("A",)], "title string"))
    assert [tuple(r) for r in titled.collect()] == [("A", "x")]


def test_candidate_titles_by_definition(spark):
    titles = ["Hà Nội", "an", "Đà Nẵng", "", "x", "Nội thất", "xin chào bạn"]
    queries = [(1, "nội"), (2, "N"), (3, "a  b"), (4, "zzz"), (5, "bạn ơi thất"), (6, "à")]
    t = spark.createDataFrame([(x,) for x in titles], "title string")
    got = {(r["qid"], r["title"]) for r in links.candidate_titles(spark.createDataFrame(queries, "qid int, query string"), t).collect()}
    hit = {(q, x) for q, text in queries for x in titles if any(k in x.lower() for k in text.lower().split(" "))}
    assert got == hit | {(q, x) for q, _ in queries if q not in {a for a, _ in hit} for x in titles}


def test_weighted_score_and_profiles(spark):
    df = spark.createDataFrame([(0.2, 0.6, "a b")], "p double, a double, t string")
    assert df.select(ranking.weighted_score(F.col("p"), F.col("a"))).first()[0] == pytest.approx(0.4)
    assert df.select(words(F.col("t"))).first()[0] == ["a", "b"]


def test_small_fit_runs_few_tasks(spark):
    """Passes of the fit go over as many partitions as the text needs, not over those it came in."""
    asked = [(f"{'bao nhiêu' if i % 2 else 'ai'} {i}", "quantity" if i % 2 else "other") for i in range(80)]
    train = spark.createDataFrame(asked, "question string, category string").repartition(40)
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        model = classify.fit_categories(train)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("fit") for i in tracker.getJobInfo(j).stageIds]
    assert len([s for s in stages if s and s.numTasks >= 40]) <= 4
    got = classify.classify(train, model).select("question", "category").collect()
    assert {(r["question"], r["category"]) for r in got} == set(asked)


def test_a_lexicon_is_made_once(spark, monkeypatch):
    """Whether it travels or is joined: it may be counted from a whole corpus."""
    made = spark.sparkContext.accumulator(0)

    def noted(phrase):
        made.add(1)
        return phrase

    lexicon = spark.createDataFrame([("a b",), ("b c d",), ("e",)], "p string").select(F.udf(noted, "string").asNondeterministic()("p").alias("phrase"))
    rows = spark.createDataFrame([(1, "x A b c d"), (2, "b c d"), (3, "")], "id int, text string")
    for n, most in enumerate((segment.MOST_ENTRIES, 0), 1):
        monkeypatch.setattr(segment, "MOST_ENTRIES", most)
        got = segment.with_first_tags(segment.with_words(rows, F.col("text")), lexicon).collect()
        assert {r["id"]: "".join(r["first_tags"]) for r in got} == {1: "BBIBB", 2: "BII", 3: ""}
        assert made.value == 3 * n


def test_nbest_tasks_hold_the_sorts_of_one_reading(spark, sf_dir):
    """Lists that are read several times are written, so that no plan sorts them again in each reading."""
    from answerloom.plans import corpus_queries

    for name, most in (("nbest_predictions", 3), ("nbest_null_odds", 12)):
        plan = getattr(corpus_queries, name)(spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
        assert len(re.findall(r"\bWindow \[", plan)) == 0 and plan.count("Join") <= most, name
