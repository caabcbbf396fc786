"""Each operator against a brute-force version, and its edge cases."""

import functools
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerloom.llm import (
    ann_index,
    bpe_chunks,
    common,
    compaction,
    fertility,
    licenses,
    mixing,
    quality_bayes,
    simhash,
    token_counts,
    url_filter,
)
from answerloom.llm.common import table
from answerloom.llm.components import connected_components
from tests.compare import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "kōan wörter " * 20_000
TEXTS = [
    None, "", " \n\t", "a", "a  b", "trail ", " lead", "x▁ y", "tab\tand  two", "<s> </s> <|endoftext|>",
    "é́ combining", "𝒳 𝒴", "ABC abc ÀÉ", "same text here", "same text here", "w " * 50, LONG,
    "The MIT License and the GNU General Public License. Apache License", "\x01 mark \x01", "中文 字符",
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i if i % 7 else None, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[13], rows[1]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clash(edge):
    """Columns that operators would like to name themselves."""
    names = ("size", "source_size", "target", "taken", "kept", "labels", "score", "n_tokens", "fp", "shard", "key", "evidence", "n_words")
    return edge.withColumns({n: F.lit("x") for n in names})


def library():
    from tokenizers import Tokenizer

    from answerloom.llm.common import vocabulary

    return Tokenizer.from_file(vocabulary(bpe_chunks.VOCAB))


def expected_tokens(text):
    t = library()
    ids = t.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    decoded = t.decode(ids, skip_special_tokens=False)
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode())


def multiset(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_bpe_equals_library(edge, clash, empty):
    want = Counter((r["doc_id"], *expected_tokens(r["text"])) for r in edge.collect())
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert multiset(bpe_chunks.encode_documents(edge), *columns) == want
    assert multiset(bpe_chunks.encode_documents(clash), *columns) == want
    assert bpe_chunks.encode_documents(empty).count() == 0


def test_bpe_of_shared_passages(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdeéfgh<|>'1 \n"), rng.integers(1, 12)))
    passages = [" ".join(word() for _ in range(150)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [passages[k] for k in rng.integers(0, 6, 3)]
        rows.append((i, word().join([word(), *parts, word()])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_chunks.encode_documents(docs).collect()}
    assert got == {i: expected_tokens(t) for i, t in rows}


def test_chunks_are_content_defined():
    rng = np.random.default_rng(2)
    body = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))

    def chunks(t):
        ends = bpe_chunks.cuts([t])[0]
        return [t[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    a, b = chunks(body), chunks(b"something put before " + body)
    assert b"".join(a) == body and len(set(a) & set(b)) > 0.8 * len(a)
    assert all(len(c) >= bpe_chunks.LEAST_CHUNK for c in a)


def test_stitch_falls_back_to_the_whole_text():
    bpe = bpe_chunks.WordBpe()
    text = b" ".join(b"word%d" % i for i in range(400))
    ends = bpe_chunks.cuts([text])[0]
    wrong = {bpe_chunks.key_of(text[a:b]): b"\0\0\0\0" for a, b in zip([0, *ends], ends, strict=False)}
    assert bpe_chunks.stitch(bpe, text, ends, wrong) == bpe.direct(text)


def test_token_counts_equal_library(edge, clash, empty):
    import sentencepiece

    from answerloom.llm.common import vocabulary

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(token_counts.VOCAB))
    want = Counter(
        (r["doc_id"], len((r["text"] or "").encode()), n := len(sp.encode(r["text"] or "")), n > 4096) for r in edge.collect()
    )
    columns = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert multiset(token_counts.count_tokens(edge), *columns) == want
    assert multiset(token_counts.count_tokens(clash), *columns) == want
    assert token_counts.count_tokens(empty).count() == 0


def brute_components(prints):
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= simhash.RADIUS
    label = np.arange(len(a))
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return label
        label = new


def test_fingerprints_by_definition():
    import xxhash

    for text in filter(None, TEXTS[:-1]):
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint_text(text.encode()) == want


def test_near_edges_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(20):
            x = b
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(prints)
    for block in (simhash.BLOCK, 4):
        edges = simhash.near_edges(fps, block)
        got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
        mine = [got.get(x, x) for x in signed]
        assert len(set(zip(mine, want.tolist(), strict=True))) == len(set(mine)) == len(set(want.tolist()))


def test_near_duplicates_edge_cases(edge, clash, empty):
    got = simhash.near_duplicates(edge)
    assert got.count() == edge.count()
    blank = {r["component_id"] for r in got.collect() if r["fp"] == 0}
    assert len(blank) == 1
    assert multiset(simhash.near_duplicates(clash), "doc_id", "fingerprint") == multiset(got, "doc_id", "fingerprint")
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert kept.count() == len({r["component_id"] for r in got.collect()}) == kept.distinct().count()
    assert simhash.keep_one(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (10, 11), (None, 4), (5, 2), (2, 1)] + [(i, i + 1) for i in range(100, 140)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {k: got[k] for k in (1, 2, 3, 5, 10, 11)} == {1: 1, 2: 1, 3: 1, 5: 1, 10: 10, 11: 10}
    assert {got[i] for i in range(100, 141)} == {100} and 4 not in got


def test_nearest_recall_and_edges(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    got = ann_index.search(v, "vec_id % 100 = 0").collect()
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in v.collect() if r["embedding"]}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids.tolist()])
    found = total = 0
    for q in ids[ids % 100 == 0].tolist():
        d = np.sqrt(((x - rows[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        mine = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        assert q not in mine and all(abs(s - d[ids.tolist().index(i)]) < 1e-12 for i, s in mine.items())
        found, total = found + len(best & set(mine)), total + 10
    assert found / total >= 0.9
    e = "vec_id long, embedding array<float>, rank string"
    few = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, None, None), (4, [0.0, 0.0], None), (5, [float("nan"), 1.0], None), (6, [None, 1.0], None), (None, [1.0, 1.0], None), (7, [], None)]
    got = ann_index.search(spark.createDataFrame(few, e), "vec_id % 2 = 0")
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == [(0, 1, 1), (0, 2, 2), (2, 1, 0), (2, 2, 1)]
    assert ann_index.search(spark.createDataFrame([], e), "vec_id % 2 = 0").count() == 0


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    codes = ann_index.learn(x)
    for radius in (0, 5, 13, 28, 64):
        shard = ann_index.Shard(np.arange(400), x, codes)
        code = shard.bytes[7]
        want = np.flatnonzero(np.bitwise_count(shard.bytes ^ code).sum(1) <= radius)
        assert shard.within(code, radius).tolist() == want.tolist()


def brute_nearest(rows, k=10):
    """Per query id the k nearest different rows of other ids, as (vec_id, score)."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 100 == 0}):
        d = np.sqrt(np.array([((x - y) ** 2).sum(1) for y in x[ids == q]]).min(0))
        d[ids == q] = np.inf
        order = [j for j in np.lexsort((ids, d)).tolist() if d[j] < np.inf][:k]
        out[q] = [(int(ids[j]), round(float(d[j]), 9)) for j in order]
    return out


def searched(spark, rows):
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    out = {}
    for r in ann_index.search(df, "vec_id % 100 = 0").orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    return out


@pytest.mark.parametrize("percent", [1, 2])
def test_isolated_rows_find_their_neighbours(spark, percent):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 64))[rng.integers(0, 40, 4000)] + 1e-3 * rng.standard_normal((4000, 64))
    alone = rng.choice(4000, 40 * percent, replace=False)
    x[alone] = 3 * rng.standard_normal((len(alone), 64))
    ids = np.arange(1, 4001) * 100 + 1
    ids[alone[:20]] -= 1
    ids[np.setdiff1d(np.arange(4000), alone)[:10]] -= 1
    rows = list(zip(ids.tolist(), x.tolist(), strict=True))
    got, want = searched(spark, rows), brute_nearest(rows)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = {q: len(set(got[q]) & set(want[q])) for q in want}
    assert sum(hits.values()) >= 9.5 * len(want) and all(got[q][0][1] >= want[q][0][1] for q in want)
    alone_ids = set(ids[alone[:20]].tolist())
    assert sum(n for q, n in hits.items() if q in alone_ids) >= 9 * len(alone_ids)


def test_rows_beyond_the_codes_are_not_compared():
    """On clustered rows a query compares few rows, in true distances, and finds its neighbours."""
    rng = np.random.default_rng(11)
    x = 4 * rng.standard_normal((50, 64))[rng.integers(0, 50, 6000)] + rng.standard_normal((6000, 64))
    codes = ann_index.learn(x[::3])
    shard = ann_index.Shard(np.arange(6000), x, codes)
    hits = 0
    for i in range(0, 6000, 100):
        at, far = shard.nearest(i, x[i], codes.encode(x[i : i + 1])[0], 10)
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert np.allclose(d[at], far) and i not in at
        hits += len(set(at.tolist()) & set(np.argsort(d)[1:11].tolist()))
    assert hits >= 0.95 * 600 and shard.compared < 0.1 * 60 * 6000


def test_repeated_ids_leave_room_for_other_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, x[7].tolist())] * 30 + [(8, (x[0] + 1e-3).tolist())] * 30 + [(100, (x[100] + 1).tolist())] * 12
    got, want = searched(spark, rows), brute_nearest(rows)
    assert got[0][0][0] == 8 and all(len(v) == 10 for v in got.values()) and got == want
    copies = [(0, [0.0, 1.0])] + [(1, [1.0, 0.0])] * 20 + [(i, [1.0, float(i)]) for i in range(2, 30)]
    assert searched(spark, copies)[0] == brute_nearest(copies)[0]


PAGES = [
    (1, "http://a.com/en/1", '<LINK href="http://b.org/x" rel=canonical>'),
    (2, "http://b.org/x", ""),
    (3, "http://c.org/y", "<meta http-equiv='refresh' content='0; url=http://b.org/x'>"),
    (4, "http://example.com/en/77", '<link rel="canonical" href="//d.org/z">'),
    (5, "http://d.org/z#f", "<link rel='canonical' href='/en/q'>"),
    (6, None, "<link rel=canonical href=http://a.com/en/1>"), (7, "no host", None), (8, "HTTP://E.NET/de/x?y", None),
    (9, "http://notcom/en/", None), (10, "http://b.org/x", None), (11, "", None), (12, "http://d.org/en/q", "<link rel=canonical href=http://w.com/en/1>"),
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("rule", F.lit("x"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect()}
    assert got[1] == ("a.com", "/en/1", "com/en/", "block")
    assert got[2][2:] == got[3][2:] == got[10][2:] == (None, "block")
    assert got[4][2:] == ("example.com/en/7", "allow")
    assert got[5][2:] == got[12][2:] == (None, "allow")  # allow comes before block among aliases
    assert got[6] == got[7] == got[11] == ("", "", None, "allow")
    assert got[8] == ("e.net", "/de/x", "net/de/", "allow") and got[9][2:] == (None, "allow")
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(none).count() == 0


def test_url_rules_are_the_contracts(spark):
    """Each rule's word in the code and in the SQL, by a page that only this rule fits."""
    import duckdb

    told = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    want = [tuple(x.split(" ")) for x in told.split(", ")]
    assert [(r.action, r.text) for r in url_filter.RULES] == want
    pages = [(i, f"http://{rule}", None) for i, (_, rule) in enumerate(want)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert [tuple(r) for r in url_filter.judge_urls(df).orderBy("page_id").select("verdict", "rule").collect()] == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert con.sql(f"SELECT verdict, rule FROM ({url_filter.contract_sql()}) ORDER BY page_id").fetchall() == want


def test_url_sql_on_aliases(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    same(url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict"), con, url_filter.contract_sql())


def test_redirect_chains_and_hubs(spark):
    """Long chains, hubs, rings and shared targets under rules, against the SQL."""
    import duckdb

    rng = np.random.default_rng(12)
    link = lambda u: f'<link rel="canonical" href="{u}">'
    go = lambda u: f"<meta http-equiv=refresh content='0;url={u}'>"
    rows = []
    for k, end in enumerate(("http://a.com/en/x", "http://example.com/en/7", "http://c.net/de/1", "http://d.io/")):
        chain = [f"http://chain{k}.io/{i}" for i in range(120)] + [end]
        rows += [(a, go(b)) for a, b in zip(chain, chain[1:], strict=False)]
    rows += [(f"http://hub.io/{i}", link("http://z.org/es/hub")) for i in range(300)]
    rows += [(f"http://free.io/{i}", link("/home")) for i in range(200)]
    rows += [(f"http://ring.io/{i}", go(f"{(i + 1) % 50}")) for i in range(50)]
    urls = [f"http://{rng.choice(['a.com', 'b.net', 'c.org', 'd.io', 'example.com'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{i % 90}" for i in range(400)]
    rows += [(u, link(urls[int(rng.integers(0, 400))]) if i % 3 else None) for i, u in enumerate(urls)]
    pages = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    got = url_filter.judge_urls(df).select("page_id", "host", "path", "rule", "verdict")
    same(got, con, url_filter.contract_sql())
    verdicts = {r["page_id"]: r["verdict"] for r in got.collect()}
    assert [verdicts[k] for k in (0, 120, 240, 360)] == ["block", "allow", "allow", "allow"]
    assert {verdicts[i] for i, r in enumerate(rows) if r[0].startswith("http://hub.io")} == {"block"}


def test_hot_keys_join_apart(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(k, k) for k in range(2, 40)] + [(None, 0)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 40, 2)] + [(1, "hot")], "k int, w string")
    hot = common.hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), ["k"], left.count())
    assert [r["k"] for r in hot.collect()] == [1]
    plain = sorted(tuple(r) for r in left.join(right, "k").select("k", "v", "w").collect())
    for h in (hot, None):
        assert sorted(tuple(r) for r in common.skew_join(left, right, ["k"], h).select("k", "v", "w").collect()) == plain
    assert common.hot_keys(right.groupBy("k").agg(F.count("*").alias("n")), ["k"], 10**6) is None


def test_row_keys_tell_nulls_apart(spark):
    rows = spark.createDataFrame([(None, "x"), ("x", None), ("x", ""), (None, None), ("", "x")], "a string, b string")
    keys = rows.select(*[c.alias(n) for n, c in common.row_key(F.col("a"), F.col("b")).items()])
    assert keys.distinct().count() == 5
    docs = spark.createDataFrame([(None, "x", None, "s", 1), (None, "x", "s", None, 1)], SCHEMA)
    kept = simhash.keep_one(docs.withColumn("text", F.concat("text", F.coalesce("lang", F.lit("")))))
    assert kept.count() == 2


def test_mix_edge_cases(edge, clash, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == edge.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    columns = ("doc_id", "size", "source_size", "target", "taken")
    assert multiset(mixing.mix(clash), *columns) == multiset(mixing.mix(edge), *columns)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_is_near_its_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.first("source_size").alias("s")).collect()
    assert all(abs(r["t"] - r["w"]) <= 0.01 * r["w"] + 20 for r in rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = dict(out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect())
    assert sum(words.values()) == pytest.approx(sum(r["s"] for r in rows), rel=0.2)


def test_license_edge_cases(edge, clash, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(edge).collect()}
    hit = next(r for r in got.values() if r["n_base"])
    assert hit["base_labels"] == hit["labels"] == "apache,gpl,mit" and (hit["n_base"], hit["first_word"], hit["last_word"], hit["score"]) == (3, 1, 9, 1.0)
    columns = ("doc_id", "n_words", "n_base", "labels")
    assert multiset(licenses.scan(clash), *columns) == multiset(licenses.scan(edge), *columns)
    assert licenses.scan(empty).count() == 0


def test_license_templates_in_part(spark):
    bsd = "redistribution and use in source AND binary forms, with or without changes are permitted"
    rows = [(1, bsd), (2, "redistribution of use"), (3, "x " + "cc by cc by")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "bsd" and 0.8 <= got[1]["score"] < 1 and got[1]["n_base"] == 0
    assert got[2]["labels"] == "" and got[2]["score"] == 0
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (2, 1, 3)


def test_licenses_in_full(spark):
    said = {"mit": licenses.MIT, "isc": licenses.ISC, "zlib": licenses.ZLIB, "unlicense": licenses.UNLICENSE, "bsd": licenses.BSD_CONDITIONS + " x " + licenses.BSD_DISCLAIMER}
    rows = [(k, "Copyright 2020\n" + t.replace(" any ", " all ", 1)) for k, t in said.items()]
    rows += [("gpl", licenses.GPL_NOTICE), ("apache,apache-notice", licenses.APACHE_NOTICE), ("lgpl", licenses.LGPL_NOTICE), ("mpl", licenses.MPL_NOTICE)]
    rows.append(("", licenses.MIT.replace("Permission", "Allowance").replace("permission", "x")))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: r["labels"] for k, r in got.items()} == {k: k for k, _ in rows}
    assert got["mit"]["n_base"] == 0 and 0.9 <= got["mit"]["score"] <= 1


def test_the_plan_does_not_grow_with_the_templates(spark):
    docs = spark.createDataFrame([(1, "the gnu general public license")], "doc_id long, text string")
    many = [licenses.Template(f"l{i}", " ".join(f"w{i}x{j}" for j in range(30)), 0.9) for i in range(300)]
    nodes = lambda ts: licenses.scan(docs, templates=ts)._jdf.queryExecution().analyzed().treeString().count("lambdafunction")
    assert nodes(licenses.TEMPLATES) == nodes([*licenses.TEMPLATES, *many])
    assert licenses.scan(docs, templates=[*licenses.TEMPLATES, *many]).first()["labels"] == "gpl"


def test_classifier(spark, sf_dir, edge, empty):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality_bayes.classify(docs, labels)
    right = judged.join(labels, "doc_id").select(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95
    assert quality_bayes.classify(edge, labels).count() == edge.count()
    assert quality_bayes.classify(edge, labels.limit(0)).filter("kept").count() == edge.count()
    assert quality_bayes.classify(empty, labels).count() == 0
    assert quality_bayes.classify_narrow(empty, labels).count() == 0


def test_classifier_on_held_out_rows(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    side = F.xxhash64("doc_id") % 2 == 0
    judged = quality_bayes.classify(docs, labels.filter(side)).join(labels.filter(~side), "doc_id")
    assert judged.select(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("double"))).first()[0] > 0.9


def brute_shifts(rows):
    """Shifts by (host, path), straight from the definition."""
    e = np.array([r[2] for r in rows])
    mean = min(max(e.mean(), quality_bayes.LEAST), 1 - quality_bayes.LEAST)

    def groups(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r[2])
        return {k: np.array(v) for k, v in out.items()}

    hosts, paths = groups(lambda r: r[0]), groups(lambda r: r[:2])

    def moments(gs, centre, above, tops):
        n = sum(map(len, gs.values()))
        if n <= len(gs):
            return 1.0, 0.0
        noise = sum(((v - v.mean()) ** 2).sum() for v in gs.values()) / (n - len(gs))
        about = sum(len(v) * (v.mean() - centre(k)) ** 2 for k, v in gs.items())
        free = n - sum(len(v) ** 2 / above(k) for k, v in gs.items())
        return noise, max((about - (len(gs) - tops) * noise) / free, 0.0) if free > 1e-9 else 0.0

    host_s, host_t = moments(hosts, lambda k: mean, lambda k: len(e), 1)
    path_s, path_t = moments(paths, lambda k: hosts[k[0]].mean(), lambda k: len(hosts[k[0]]), len(hosts))

    def towards(v, prior, s, t):
        w = len(v) * t / (len(v) * t + s) if t else 0.0
        return w * v.mean() + (1 - w) * prior

    logit = lambda p: np.log(p / (1 - p))
    top = quality_bayes.MOST_SHIFT
    return {
        k: float(np.clip(logit(towards(v, towards(hosts[k[0]], mean, host_s, host_t), path_s, path_t)) - logit(mean), -top, top))
        for k, v in paths.items()
    }


def shifts_of(spark, rows):
    got = quality_bayes.group_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    return {(r["host"], r["path"]): r["shift"] for r in got.collect()}


def test_shifts_by_definition(spark):
    rng = np.random.default_rng(11)
    uneven = []
    for h in range(12):
        base = rng.uniform(0.2, 0.9)
        for p in range(int(rng.integers(1, 6))):
            own = np.clip(base + rng.normal(0, 0.1), 0.05, 0.95)
            uneven += [(f"h{h}", None if p == 2 else f"p{p}", float(np.clip(rng.normal(own, 0.15), 1e-3, 0.999))) for _ in range(int(rng.integers(1, 60)))]
    noise = [(f"h{i}", "p", float(x)) for i, x in enumerate(rng.uniform(0.2, 0.8, 40))]
    alike = [(f"h{i % 5}", "p", 0.25 + 0.5 * (i // 5 % 2)) for i in range(100)]
    hot = [(None, "p", 0.9)] * 200 + [("small", "p", 0.1)] + [("mid", "p", 0.5)] * 50
    for rows in (uneven, noise, alike, hot, uneven[:1]):
        got, want = shifts_of(spark, rows), brute_shifts(rows)
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert set(shifts_of(spark, noise).values()) == {0.0} == set(shifts_of(spark, alike).values())
    got = shifts_of(spark, hot)
    assert got[None, "p"] > 0 > got["mid", "p"]
    assert quality_bayes.group_posteriors(spark.createDataFrame([], "host string, path string, evidence double")).count() == 0


def test_posterior_adds_shift_to_evidence(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = quality_bayes.classify_narrow(docs, labels).collect()
    want = brute_shifts([(r["host"], r["path"], r["evidence"]) for r in rows])
    for r in rows:
        odds = r["evidence"] / (1 - r["evidence"]) * np.exp(want[r["host"], r["path"]])
        assert r["shift"] == pytest.approx(want[r["host"], r["path"]], abs=1e-9)
        assert r["posterior"] == pytest.approx(odds / (1 + odds), abs=1e-9) and r["kept"] == (r["posterior"] >= 0.5)
    wide = {r["doc_id"]: r["kept"] for r in quality_bayes.classify(docs, labels).collect()}
    assert wide == {r["doc_id"]: r["kept"] for r in rows}


def test_contradictory_labels_are_left_out(spark, sf_dir, clash):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    some = labels.filter("quality is not null").limit(5).select("doc_id", (1 - F.col("quality")).alias("quality"))
    told = labels.select("doc_id", "quality")
    left = told.join(some.select("doc_id"), "doc_id", "left_anti")
    assert quality_bayes.train(docs, told.union(some).union(told)) == quality_bayes.train(docs, left)
    assert quality_bayes.classify(clash, labels.drop("toxic")).count() == clash.count()


def test_group_tables_join_salted_too(spark, monkeypatch):
    monkeypatch.setattr(quality_bayes, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(i, "big" if i else None) for i in range(5)], "doc_id long, h string")
    table_ = spark.createDataFrame([("big", "p", 1.5)], "host string, path string, shift double")
    got = quality_bayes.with_shift(docs, table_, F.col("h"), F.lit("p")).collect()
    assert sorted(r["shift"] for r in got) == [0.0, 1.5, 1.5, 1.5, 1.5]


def test_sharding(edge, clash, empty, tmp_path):
    got = compaction.shard_table(edge, f"file://{tmp_path}/a", target=1 << 16)
    assert multiset(got, "doc_id", "text") == multiset(edge, "doc_id", "text")
    assert compaction.shard_table(clash, f"file://{tmp_path}/b").drop("shard").count() == edge.count()
    assert compaction.shard_table(empty, f"file://{tmp_path}/c").count() == 0


def test_compaction_merges_and_versions(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s")
    for i in range(5):
        store.append(spark.range(i * 100, i * 100 + 100).coalesce(1))
    assert store.version() == 5 and len(store.shards()) == 5
    before = store.shards(5)
    assert store.compact(fanout=4) == 6 and len(store.shards()) == 1
    assert store.read().count() == 500 and store.shards(5) == before
    assert [store.read(v).count() for v in (1, 5)] == [100, 500]
    with pytest.raises(compaction.Conflict):
        store.commit(5, [], store.schema())
    assert len(store.shards()) == 1
    assert store.vacuum() == 0 and store.read(1).count() == 100
    assert store.vacuum(keep_seconds=0) == 5 and store.versions() == [6] and store.read().count() == 500


def test_a_crashed_append_and_a_second_writer_disturb_nobody(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    store, other = compaction.ShardStore(spark, root), compaction.ShardStore(spark, root)
    store.append(spark.range(10).coalesce(1))
    store._write(spark.range(50).coalesce(1), None)  # a writer that died before its commit
    assert other.append(spark.range(10, 20).coalesce(1)) == 2
    # Another writer commits between the reading of the version and the commit.
    commit, raced = compaction.ShardStore.commit, []

    def late(self, base, parts, schema):
        if not raced:
            raced.append(other)
            commit(other, base, other.parts(base) + other._new_parts(other._write(spark.range(20, 30).coalesce(1), None)), schema)
        return commit(self, base, parts, schema)

    monkeypatch.setattr(compaction.ShardStore, "commit", late)
    assert store.append(spark.range(30, 40).coalesce(1)) == 4
    raced.clear()
    assert store.compact(fanout=2) == 6
    monkeypatch.undo()
    assert sorted(r["id"] for r in store.read().drop("shard").collect()) == sorted([*range(40), *range(20, 30)])
    assert store.vacuum() == 0  # nothing is old enough, the dead writer's file neither
    assert store.vacuum(keep_seconds=0) > 0 and store.read().count() == 50


def test_manifest_parts_are_named_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "PART_SHARDS", 2)
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(3, numPartitions=3))
    first = store.parts()
    assert [p.shards for p in first] == [2, 1]
    store.append(spark.range(3, 4, numPartitions=1))
    assert store.parts()[:2] == first and store.read().count() == 4
    shards = {r["shard"] for r in store.read().collect()}
    assert shards == {s.path for s in store.shards()}


def brute_rules(text):
    words = [w for w in (text or "").encode().split()]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(covered),
    )


def test_rules_by_definition(spark, sf_dir, edge, clash, empty):
    for docs in (edge, table(spark, sf_dir, "documents")):
        want = Counter((r["doc_id"], *(b := brute_rules(r["text"])), b[0] < 10 or 100 * b[4] > 20 * b[0]) for r in docs.collect())
        columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        got = fertility.judge(docs)
        assert multiset(got, *columns) == want
        assert got.filter("base_failed and kept").count() == 0
    assert fertility.judge(clash).count() == edge.count() and fertility.judge(empty).count() == 0


def test_fertility_measures():
    texts = [b"the same word", b"the the the the", "Ω≈ç√".encode()]
    m = fertility.TextMeasures().measure(texts)
    assert m["token_entropy"][1] == 0 and m["n_tokens"][0] == 3 and m["token_entropy"][0] == pytest.approx(np.log2(3))
    assert m["n_byte_tokens"][0] == 0


def test_fertility_keeps_clean_documents(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = fertility.judge(docs).join(labels.filter("quality = 1"), "doc_id")
    assert good.filter("not kept and not base_failed").count() == 0


def random_words(rng, letters, n, length=(2, 9)):
    return ["".join(rng.choice(list(letters), rng.integers(*length))) for _ in range(n)]


def test_fertility_rejects_junk_beyond_the_base_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    passed = fertility.judge(docs.join(labels, "doc_id")).filter("not base_failed").collect()
    junk = [r["kept"] for r in passed if r["quality"] == 0]
    assert junk and sum(junk) <= 0.2 * len(junk)
    rng = np.random.default_rng(8)
    by_lang = {}
    for r in passed:
        if r["quality"] == 1 and r["n_tokens"] >= 256:
            by_lang.setdefault(r["lang"], r["text"])
    assert set(by_lang) == {"en", "de", "fr", "es"}
    rows = []
    for lang, text in by_lang.items():
        rows += [(f"{lang} bars", lang, " | ".join(text.split())), (f"{lang} stars", lang, " ".join(w + "***" for w in text.split()))]
    rows += [(f"{k} letters", k, " ".join(random_words(rng, "abcdefghijklmnopqrstuvwxyz", 400))) for k in ("en", "de", "fr", "es")]
    rows.append(("cyrillic letters", "ru", " ".join(random_words(rng, "абвгдежзийклмнопрстуфхцчшщъыьэюя", 400))))
    rows.append(("han few", "zh", " ".join(random_words(rng, "的一是", 400))))
    rows.append(("thai bytes", "th", " ".join("กา" + chr(int(c)) for c in rng.integers(0x1E900, 0x1E943, 400))))
    got = fertility.judge(spark.createDataFrame(rows, "doc_id string, lang string, text string")).collect()
    assert [r["doc_id"] for r in got if r["base_failed"]] == [] and [r["doc_id"] for r in got if r["kept"]] == []


LETTERS = {
    "en": "abc", "de": "abc", "fr": "abc", "es": "abc", "latin": "abc", "cyrillic": "абв", "greek": "αβγ", "arabic": "ابت", "hebrew": "אבג",
    "devanagari": "कखग", "bengali": "কখগ", "tamil": "கஙச", "georgian": "აბგ", "thai": "กขค", "han": "的一是", "hangul": "가나다", "other": "ሀ",
}


@functools.cache
def pieces():
    import sentencepiece

    from answerloom.llm.common import vocabulary

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(fertility.VOCAB))


def brute_fertility(text, lang):
    """(n_tokens, n_byte_tokens, entropy, kept) of a whole text, from its words' own encodings."""
    model = pieces()
    words = [w.decode() for w in (text or "").encode().split()]
    ids = [i for w in words for i in model.encode(w)]
    n, n_bytes = len(ids), sum(map(model.is_byte, ids))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    n_words, chars, _, _, repeated = brute_rules(text)
    if not n or n_words < 10 or 100 * repeated > 20 * n_words:
        return n, n_bytes, entropy, False
    band = fertility.BANDS[lang]
    i = min(max(int(math.log2(n)) - fertility.LEAST_BITS, 0), fertility.LENGTHS - 1)
    factor, less = next(((f, bits) for tokens, f, bits in fertility.SHORT if n < tokens), (1.0, 0.0))
    inside = (
        band.min_chars[i] * factor <= chars / n <= band.max_chars
        and n_bytes <= fertility.FREE_BYTES + band.max_byte_share * n
        and band.min_entropy[i] - less <= entropy <= band.max_entropy
    )
    return n, n_bytes, entropy, inside


def test_fertility_by_definition(spark, sf_dir):
    rng = np.random.default_rng(3)
    docs = table(spark, sf_dir, "documents").filter("lang in ('en', 'de', 'fr', 'es')").select("doc_id", "lang", "text")
    junk = [(10_000 + i, "en", " ".join(random_words(rng, "abcxyz0189#@¬ß€", int(n)))) for i, n in enumerate(rng.integers(1, 400, 60))]
    bytes_only = [(20_000, "de", "\u0488\u1f02\ua9c1 " * 40), (20_001, "fr", ""), (20_002, "es", None), (20_003, "en", "a b " * 30)]
    more = spark.createDataFrame(junk + bytes_only, docs.schema)
    rows = fertility.judge(docs.unionByName(more)).collect()
    assert len(rows) == docs.count() + len(junk) + len(bytes_only)
    for r in rows:
        n, n_bytes, entropy, kept = brute_fertility(r["text"], r["lang"])
        assert (r["n_tokens"], r["n_byte_tokens"], r["kept"]) == (n, n_bytes, kept)
        assert r["token_entropy"] == pytest.approx(entropy, abs=1e-9)
        assert r["chars_per_token"] == (pytest.approx(r["word_chars"] / n) if n else None)
        assert r["byte_share"] == (pytest.approx(n_bytes / n) if n else None)
    assert 0 < sum(r["kept"] for r in rows) < len(rows)
    assert any(not r["kept"] and not r["base_failed"] for r in rows)


def test_every_band_rejects(spark):
    """Words of three letters alone, none repeated in runs of five, say too little in any band."""
    assert set(LETTERS) == set(fertility.BANDS)
    rng = np.random.default_rng(9)
    listed = ("en", "de", "fr", "es")
    rows = [(k, k if k in listed else "??", " ".join(random_words(rng, v, 500, (1, 14)))) for k, v in LETTERS.items()]
    got = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id string, lang string, text string")).collect()}
    assert {k: r["band"] for k, r in got.items()} == {k: k for k in LETTERS}
    assert [k for k, r in got.items() if r["kept"] and not r["base_failed"]] == []
    assert [k for k, r in got.items() if r["base_failed"]] in ([], ["other"])


def test_short_texts_are_judged_too(spark):
    rows = [(1, "en", "the cat sat on the mat and looked at the big dog"), (2, "en", "aa a aaa a aa aaa a aaaa aa a aaaa aaa aaaa a"), (3, "en", "The café 😀 opened its doors at nine and closed again by ten.")]
    got = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert all(r["n_tokens"] < 50 and not r["base_failed"] for r in got.values())
    assert {k: r["kept"] for k, r in got.items()} == {1: True, 2: False, 3: True}


CLEAN = {
    "en": "The committee met on Tuesday to discuss the new library, which will open next spring beside the old market hall. Several members asked how much the building would cost and who would pay for the books, while others wanted longer hours for students and families. In the end everybody agreed that a quiet room for reading matters more than a large car park.",
    "ru": "Во вторник комитет собрался, чтобы обсудить новую библиотеку, которая откроется следующей весной рядом со старым рынком. Некоторые участники спросили, сколько будет стоить здание и кто заплатит за книги, а другие хотели, чтобы она работала дольше для студентов и семей. В конце концов все согласились, что тихая комната для чтения важнее большой стоянки.",
    "el": "Την Τρίτη η επιτροπή συνεδρίασε για να συζητήσει τη νέα βιβλιοθήκη, η οποία θα ανοίξει την επόμενη άνοιξη δίπλα στην παλιά αγορά. Μερικά μέλη ρώτησαν πόσο θα κοστίσει το κτίριο και ποιος θα πληρώσει για τα βιβλία.",
    "zh": "委员会 星期二 开会 讨论 新的 图书馆 该馆 将于 明年 春天 在 老市场 旁边 开放 一些 成员 询问 这座 建筑 要花 多少钱 谁来 支付 书籍 费用 其他人 希望 为 学生 和 家庭 延长 开放 时间 最后 大家 都 同意 安静 的 阅览室 比 大停车场 更 重要",
    "vi": "Hôm thứ ba ủy ban họp để bàn về thư viện mới, sẽ mở cửa vào mùa xuân năm sau bên cạnh khu chợ cũ. Một số thành viên hỏi tòa nhà sẽ tốn bao nhiêu tiền và ai sẽ trả tiền mua sách, còn những người khác muốn mở cửa lâu hơn cho sinh viên và gia đình.",
}


def test_fertility_keeps_clean_prose_of_many_scripts(spark):
    got = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame([(k, k, t) for k, t in CLEAN.items()], "doc_id string, lang string, text string")).collect()}
    assert {k: r["band"] for k, r in got.items()} == {"en": "en", "ru": "cyrillic", "el": "greek", "zh": "han", "vi": "latin"}
    assert all(r["n_tokens"] >= 50 for r in got.values()) and [k for k, r in got.items() if not r["kept"]] == []
