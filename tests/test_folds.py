"""Folds over arrays against their definitions, on fixed and random texts."""

import random

import pytest
from pyspark.sql import functions as F

from answerloom.functions import entities, text
from answerloom.operators import corpus, evaluate, voting
from tests import definitions as d


def ask(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    return [r["x"] for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_majority_by_definition(spark):
    rng = random.Random(1)
    fixed = [
        (["hà nội", "hà nội", *["huế"] * 8], None), (["an", "bo", "an le pho", "an"], [1] * 4), (["an", "an - - - -", "an", "an b"], [1] * 4),
        (["an", "an----", "an", "an b"], [1] * 4), (["x", "!!", "huế", "huế", "huế"], [1, 9, 1, 1, 1]), (["!", "?"], [1, 1]),
        (["ab", "ba", "cd"], [1, 1, 3]), (["a"] * 3, None), (["a b c", "d", "d", "e f g", "d"], [1, 2, 2, 1, 3]), (["Bullet x", "", "y", "Y"], [1, 1, 1, 1]),
    ]
    pool = ["hà nội", "Hà Nội.", "thành phố hà nội", "huế", "Huế!", "h", "", "--", "cố đô huế", "nội", "a b c d e", "bullet", "a  b"]
    cases = [(x, w or list(voting.VOTE_WEIGHTS)) for x, w in fixed]
    for k in (3, 6, 10):
        weights = [rng.randint(1, 4) for _ in range(k)]
        cases += [([rng.choice(pool) for _ in range(k)], weights) for _ in range(25)]
    for weights in {tuple(w) for _, w in cases}:
        some = [c for c, w in cases if tuple(w) == weights]
        rows = [(q, a, i) for q, c in enumerate(some) for i, a in enumerate(c)]
        df = spark.createDataFrame(rows, "qid int, answer string, ord int").repartition(3)
        for ngram in (None, 2):
            got = {r["qid"]: (r["place"], r["answer"]) for r in voting.majority_vote(df, weights, ngram=ngram).collect()}
            want = {q: m for q, c in enumerate(some) if (m := d.majority(c[: len(weights)], weights, ngram=ngram))}
            assert got == want


def test_link_positions_by_definition(spark):
    rng = random.Random(2)
    pieces = ["[[", "]]", "|", "a", "b c", " ", "[[A|the a]]", "[[A]]", "[[b|b]]", "é ", "\n", "[", "]", "[[A|]]"]
    texts = ["go to [[A|the a]] now", "[[A]] and [[A]] A", "", *["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(150)]]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id int, text string").repartition(3)
    got = {r["id"]: (r["plain"], [tuple(x) for x in r["links"]]) for r in corpus.link_positions(df).collect()}
    assert got == {i: d.links_and_positions(t or "") for i, t in enumerate([*texts, None])}


NESTED = ["[[", "]]", "|", "{{", "}}", "{|", "|}", "a", "w:", "x:", ":", " ", "ab c", "\n", "é", "[", "]", "{", "}", "s_1", "𝒳"]


def nested_texts(rng, n):
    return ["".join(rng.choices(NESTED, k=rng.randint(0, 30))) for _ in range(n)]


def test_balanced_spans_by_definition(spark):
    texts = ["a [[b [[c]] d]] [[e]]", "[[a]", "]] [[x]]", None, *nested_texts(random.Random(3), 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = sorted(tuple(r) for r in corpus.balanced_spans(df).collect())
    want = sorted((i, a, *at) for i, t in enumerate(texts) for a, b in corpus.DELIMITERS for at in d.find_balanced(t or "", a, b))
    assert got == want
    with pytest.raises(ValueError):
        corpus.balanced_spans(df, pairs=[("ab", "ba")])


def test_links_rewritten_by_definition(spark):
    rng = random.Random(4)
    titles = ["ha noi", "a  b", ":Foo", ":x:Foo", "x:Foo", "w:Foo", "w:", ":", "", " lead", "Tab\there", "é a"]
    links = ["[[w:q]]s", "[[a|b]]", "[[a|b|c]]", "[[a |[[n|m]]| d ]]x", "[[a|[[n]]|[[o]]|z]]", "[[[[n|m]]|q]]", "[[a||b]] c"]
    texts = ["see [[hue|Hue]]s.", "[[x:y|z]]trail", None, "", *[f"[[{t}|l]]" for t in titles], *[f"[[{t}]]s" for t in titles]]
    texts += ["".join(rng.choices([*links, *NESTED], k=rng.randint(1, 14))) for _ in range(200)] + nested_texts(rng, 200)
    want = [t if t is None else d.replace_internal_links(t) for t in texts]
    assert ask(spark, texts, corpus.rewrite_links) == want
    made = ask(spark, titles, lambda t: corpus.internal_link(t, F.lit("x")))
    assert made == [d.make_internal_link(t, "x") for t in titles]
    assert made[:3] == ["[[wiki/Ha_noi|x]]", "[[wiki/A_b|x]]", "[[wiki/:Foo|x]]"]


def test_link_capitals_as_sql(spark, tmp_path):
    """Titles whose first letter has several letters in upper case, against the SQL of both queries."""
    import duckdb

    import __spark_entry__ as entry

    firsts = [chr(i) for i in range(0x20, 0x10000) if len(chr(i).upper()) > 1] + ["a", "é", "đ", "ǆ", "ı", "ÿ", "1", "ẞ"]
    rows = [(i, f"<title>{c}ieung beung</title><a href=\"/x\">y</a>") for i, c in enumerate(firsts)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("internal_link", "links_rewritten"):
        got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.sql(entry.oracle_sql()[name]).fetchall())
    assert {"ß", "ŉ", "ﬁ", "ᾳ"} <= set(firsts)


def test_final_text_by_definition(spark):
    rng = random.Random(5)
    rows = [
        ("x - y", "an x-y z"), ("q", "an x"), ("steve smith", "Steve Smith's"), ("", "A"), (None, None), ("a", None), ("é", "É À"),
        ("i̇", "İ x"), ("𝒳", "a 𝒳 b"), (" ", "a b"),
    ]
    for _ in range(200):
        original = "".join(rng.choices(["Ab", "c", " ", "  ", "-", "É", ".", "x1_", "\t", "𝒳"], k=rng.randint(1, 12)))
        tokens = d.basic_tokens(original)
        i, j = sorted(rng.choices(range(len(tokens) + 1), k=2))
        rows.append((" ".join(tokens[i:j]) if rng.random() < 0.9 else "zz", original))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, pred string, original string")
    want = [d.final_text(p or "", o or "", " ".join(d.basic_tokens(o or ""))) for p, o in rows]
    for tokenise in (None, d.basic_tokens):
        assert [r["final"] for r in evaluate.with_final_text(df, tokenise).orderBy("i").collect()] == want


def test_quantities_by_definition(spark):
    rng = random.Random(6)
    words = {r["n"]: r["words"] for r in entities.number_lexicon(spark).collect()}
    values = {tuple(w.split()): n for n, w in words.items()}
    pool = [*entities.WORD_VALUES, "lẻ", "ngàn", "lăm", "không", "5k", "12", "km", "kg", "con", "tư", "3k2", "4.5", "(mười)", "x/y"]
    texts = ["có hai mươi mốt", "5 km", "không ai", "", "bốn nghìn", "tư nghìn năm", "năm nghìn ngàn", None, "hai  mươi\tba"]
    texts += [words[n] for n in rng.sample(range(1, 10_000), 60)] + [f"có {words[rng.randint(1, 9999)]} và {words[rng.randint(1, 99)]}" for _ in range(40)]
    texts += [" ".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(120)]
    want = [None if t is None else d.quantity_of(t, values, False) for t in texts]
    assert ask(spark, texts, entities.extract_quantity) == want
    some = texts[::3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i int, text string").repartition(3)
    got = {r["i"]: r["quantity"] for r in entities.compat_quantity(df).collect()}
    assert got == {i: None if t is None else d.quantity_of(t, values, True) for i, t in enumerate(some)}


def test_tone_marks(spark):
    pairs = {
        "Đảm baỏ chất lựơng phòng thí nghịêm hoá học": "Đảm bảo chất lượng phòng thí nghiệm hóa học", "Hoà Bình": "Hòa Bình", "HOÀ": "HÒA",
        "thuý thúy Thuỷ": "thúy thúy Thủy", "quý quỳ giá gì giếng": "quý quỳ giá gì giếng", "hoàn toán ngoài khuỷu": "hoàn toán ngoài khuỷu",
        "già gìa": "già gìa", "người nguời": "người nguời", "": "", "abc 12 é": "abc 12 é", "tuyết tuýêt": "tuyết tuyết", "áá": "áá",
    }
    assert ask(spark, list(pairs), text.place_tones) == list(pairs.values())
    assert ask(spark, ["hoa\u0300", None], text.query_normalize) == ["hòa", None]
