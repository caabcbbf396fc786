"""Title index, posting blocks and vector cells: what they find, and how little they open."""

import difflib
import random
import string
import uuid

from answerloom.operators import links, title_pages
from answerloom.operators.block_index import BlockIndex
from answerloom.operators.index import BM25Index
from answerloom.operators.titles import TitleIndex, common_subsequence, exact_ratio, profiles

SYLLABLES = (
    "nguyen tran le pham hoa binh thanh pho ha noi sai gon song nui da nang quang nam dong tay bac trung hue can tho lam son "
    "vinh long an giang kien hai phong duong minh tuan kim ngoc lan huong mai xuan thu dao cuc truc tung bach"
).split()


def titles_of(rng, n):
    some = {" ".join(rng.choice(SYLLABLES).capitalize() for _ in range(rng.randint(1, 6))) for _ in range(2 * n)}
    return sorted(some)[:n]


def noisy(rng, title):
    letters = list(title.replace(" ", ""))
    for _ in range(max(1, len(letters) // 6)):
        letters[rng.randrange(len(letters))] = rng.choice(string.ascii_letters)
    return "".join(letters) + "x"


def closest_by_definition(query, titles):
    low = query.lower().split(" ")
    candidates = [t for t in titles if any(w in t.lower() for w in low)] or titles
    return max((difflib.SequenceMatcher(None, t, query).ratio(), t) for t in candidates)


def test_closest_titles_of_5000(spark):
    """Equal to brute force; of all pairs of a query and a title, under 5 % are compared exactly."""
    rng = random.Random(5)
    titles = titles_of(rng, 5000)
    asked = [noisy(rng, rng.choice(titles)) for _ in range(25)]
    asked += ["".join(rng.choice("zqwxk") for _ in range(rng.randint(3, 30))) for _ in range(6)]
    asked += ["", "  ", "a  b", "Ha Noi", "ngoc", "zzz", "ĐĐĐ", "x" * 300]
    t = spark.createDataFrame([(x,) for x in titles], "title string")
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    got = {r["qid"]: (r["ratio"], r["title"]) for r in links.closest_titles(q, t).collect()}
    for i, x in enumerate(asked):
        ratio, title = closest_by_definition(x, titles)
        assert got[i] == (round(ratio, 6), title), x
    _, every = links.matched_titles(q, t)
    index = TitleIndex.build(t)
    reached = index.reachable(index.floors(profiles(every)))
    assert exact_ratio(reached).count() < 0.05 * every.count() * len(titles)


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n // 6 + 1))[:n].rstrip()


def test_closest_titles_of_prose_move_no_pairs(spark):
    """Questions that share a token with most titles: equal to brute force, and no pair is a shuffled row."""
    rng = random.Random(12)
    letters = "eeeeeetttaaoinshrdlu" + "bcfgkmpvwxyzéß𝒳"
    titles = [("The " if k % 5 else "An ") + prose(rng, letters, rng.choice((5, 30, 60, 64, 65, 70, 140))) for k in range(1500)]
    asked = ["the an " + prose(rng, letters, rng.choice((20, 90, 180, 195, 220, 350))) for _ in range(30)]
    asked += [titles[7], titles[8] + " " + titles[9] * 3, "an", "the " + "x" * 300, "the " + "e" * 120 + "ß" * 120]
    t = spark.createDataFrame([(x,) for x in [*titles, *titles[:5], None]], "title string")
    q = spark.createDataFrame([*enumerate(asked), (99, None)], "qid int, query string")
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark._jvm.java.util.ArrayList
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: store.stageList(none(), False, False, quantiles, none())
    records = lambda: sum(x.shuffleWriteRecords() for x in (lambda s: [s.apply(i) for i in range(s.size())])(stages()))
    before = records()
    got = {r["qid"]: (r["ratio"], r["title"]) for r in links.closest_titles(q, t).collect()}
    assert records() - before < len(titles) * len(asked) // 4
    assert len(got) == len(asked)
    for i, x in enumerate(asked):
        ratio, title = closest_by_definition(x, titles)
        assert got[i] == (round(ratio, 6), title), x


def test_closest_titles_in_seeded_pages(spark, monkeypatch):
    """With floors of a seed of the pages, the n closest are those of brute force, ties by the larger string."""
    monkeypatch.setattr(title_pages, "PAGE", 16)
    monkeypatch.setattr(title_pages, "BLOCK", 4)
    rng = random.Random(13)
    titles = [*titles_of(rng, 500), "ha a", "a ha", "ha b"]
    asked = ["ha noi", "ha", "hoa binh " * 30, "nguyen tran le pham", "quang nam dong tay " + "nui da " * 40, "an"]
    t = spark.createDataFrame([(x,) for x in titles], "title string")
    q = spark.createDataFrame([(str(i), x) for i, x in enumerate(asked)], "qid string, query string")
    got = {}
    for r in sorted(links.closest_titles(q, t, 3).collect(), key=lambda r: r["rank"]):
        got.setdefault(int(r["qid"]), []).append((r["ratio"], r["title"]))
    for i, x in enumerate(asked):
        some = [y for y in titles if any(w in y.lower() for w in x.split(" ") if w or x.endswith(" "))]
        best = sorted(((difflib.SequenceMatcher(None, y, x).ratio(), y) for y in some), reverse=True)[:3]
        assert got[i] == [(round(r, 6), y) for r, y in best], x


def test_page_bounds_hold(spark):
    """No title's ratio is above its page's bound, nor is a bound of subsequences above the exact one up to 64 characters."""
    rng = random.Random(14)
    letters = "eeeeeeeettttaaoinshrdlu𝒳é"
    titles = [prose(rng, letters, rng.choice((0, 1, 5, 60, 64, 65, 130))) for _ in range(300)]
    page = title_pages.TitlePage(titles)
    for n in (0, 1, 60, 199, 200, 340):
        x = prose(rng, letters, n)
        bounds, common = page.bounds(x), page.subsequences(x)
        for k, y in enumerate(titles):
            assert difflib.SequenceMatcher(None, y, x).ratio() <= bounds[k] + 1e-9 or not x + y
            exact = common_subsequence(x, y)
            assert common[k] == exact if len(y) <= 64 else common[k] >= exact


def test_title_index_stored_and_edges(spark, tmp_path):
    rng = random.Random(6)
    titles = [*titles_of(rng, 60), "", "a", "𝒳𝒴", "x" * 250, "Hồ Chí Minh"]
    asked = ["Hồ Chí Minx", "", "𝒳", "y" * 250, None, "x" * 210, "Nguyen"]
    t = spark.createDataFrame([(x,) for x in [*titles, titles[0], None]], "title string")
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    index = TitleIndex.build(t).stored(str(tmp_path / "titles"))
    for n in (1, 3):
        got = {}
        for r in index.closest(q, n).collect():
            got.setdefault(r["qid"], {})[r["rank"]] = (r["ratio"], r["title"])
        for i, x in enumerate(asked):
            best = x is not None and sorted(((difflib.SequenceMatcher(None, y, x).ratio(), y) for y in titles), reverse=True)[:n]
            assert got.get(i, {}) == ({k + 1: (round(a, 6), b) for k, (a, b) in enumerate(best)} if best else {}), x
    none = TitleIndex.build(t.limit(0)).closest(q)
    assert none.count() == 0


def test_common_subsequence_bounds_the_ratio():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 20))) for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_subsequence(a, b) == table[-1][-1]
        assert difflib.SequenceMatcher(None, b, a).ratio() * (len(a) + len(b)) <= 2 * table[-1][-1] + 1e-9


def block_index(spark, docs, tmp_path, **more):
    index = BM25Index.build(docs)
    return index, BlockIndex.save(index, f"t{uuid.uuid4().hex}", str(tmp_path / "index"), buckets=4, **more)


def test_posting_blocks_find_the_same(spark, tmp_path):
    """The same ten as a full search, few slices opened, and no exchange of postings."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(1500)]
    rows += [(1500, None), (1501, ""), (1502, rows[3][1]), (1503, rows[3][1])]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(30)]
    asked += [(30, "w1 w1 w2"), (31, "unknown"), (32, ""), (33, None), (34, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame(asked, "qid long, question string")
    index, blocks = block_index(spark, docs, tmp_path)
    want = sorted(map(tuple, index.search(q, 10).collect()))
    found = blocks.search(q, 10)
    assert sorted(map(tuple, found.collect())) == want
    _, bounds, opened = blocks.reachable(q, 10)
    assert opened.count() < 0.7 * bounds.count()
    assert max(r["n"] for r in blocks.blocks.selectExpr("size(postings) AS n").collect()) < 200


def test_posting_blocks_are_joined_where_they_lie(spark, tmp_path, monkeypatch):
    from answerloom.operators import block_index as m

    docs = spark.createDataFrame([(i, f"a b c{i % 7}") for i in range(50)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "a c3"), (1, "c5")], "qid long, question string")
    index, blocks = block_index(spark, docs, tmp_path)
    monkeypatch.setattr(m, "broadcast_if_small", lambda df, **_: df.hint("merge"))
    found = blocks.search(q, 3)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [i for i, line in enumerate(plan) if "_blocks[" in line]
    assert scans
    for i in scans:
        # Up from the scan to its join there is no exchange.
        above = next(j for j in range(i, -1, -1) if "SortMergeJoin [term" in plan[j])
        assert not any("Exchange" in line for line in plan[above:i])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, index.search(q, 3).collect()))


def test_posting_blocks_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(0, "a")], "qid long, question string")
    _, blocks = block_index(spark, docs, tmp_path)
    assert blocks.search(q, 3).count() == 0


def cluster_vectors(rng, n, groups, dims=16):
    centres = rng.standard_normal((groups, dims))
    return [[float(c) for c in centres[rng.integers(groups)] + 0.25 * rng.standard_normal(dims)] for _ in range(n)]


def test_vector_cells_hold_most_neighbours(spark, tmp_path):
    """Recall of at least 0.9 by the cells read, on three sizes, reading a small share of clustered rows."""
    import numpy as np
    from pyspark.sql import functions as F

    from answerloom.operators.cells import CellIndex
    from answerloom.operators.vectors import dense_top_k

    for n in (300, 1500, 6000):
        rows = cluster_vectors(np.random.default_rng(n), n, 40)
        e = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
        index = CellIndex.save(e, str(tmp_path / f"c{n}"), files=4)
        q = e.filter("vec_id % 37 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
        found = {(r["qid"], r["vec_id"]) for r in index.search(q, 10).collect()}
        want = {(r["qid"], r["vec_id"]) for r in dense_top_k(q, e, 10).collect()}
        assert len(found & want) >= 0.9 * len(want)
        assert index.share_read(index.cells_of(q)) < (0.6 if n < 1000 else 0.25)


def test_vector_cells_are_exact_on_request(spark, tmp_path):
    import numpy as np

    from answerloom.operators.cells import CellIndex
    from answerloom.operators.vectors import dense_top_k

    rng = np.random.default_rng(9)
    rows = [(i, v) for i, v in enumerate(cluster_vectors(rng, 400, 8))]
    rows += [(400, None), (401, [0.0] * 16), (402, [1.0, None] * 8), (403, [1.0] * 4), rows[7], (404, rows[7][1])]
    asked = [(0, rows[0][1]), (1, rows[7][1]), (2, [-c for c in rows[0][1]]), (3, [0.0] * 16), (4, None), (5, [1e-3] * 16)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked, "qid long, q array<double>")
    CellIndex.save(e, str(tmp_path / "c"), files=3)
    index = CellIndex.open(spark, str(tmp_path / "c"))
    for k in (1, 10, 500):
        want = sorted(tuple(r)[:3] for r in dense_top_k(q, e, k).collect())
        assert sorted(tuple(r)[:3] for r in index.search(q, k, probes=1, exact=True).collect()) == want
    few = CellIndex.save(e.limit(1), str(tmp_path / "one"))
    assert few.search(q, 3, exact=True).count() == len(asked)
    assert CellIndex.save(e.limit(0), str(tmp_path / "none")).search(q, 3, exact=True).count() == 0


def test_index_tasks_hold_a_bounded_share(spark, sf_dir, monkeypatch):
    """Terms are counted in parts of a fixed size, however large the documents' file is; results stay."""
    import os

    from answerloom.plans import answer_queries

    found = lambda: sorted(tuple(r) for r in answer_queries.bm25_top10(spark, sf_dir).collect())
    want, size = found(), os.path.getsize(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(answer_queries, "INDEX_TASK", size // 24)
    assert answer_queries.index(spark, sf_dir).occurrences.rdd.getNumPartitions() >= 24
    assert found() == want


def test_buckets_of_blocks_hold_a_bounded_share(spark, sf_dir, tmp_path, monkeypatch):
    """Blocks are formed in buckets of at most so many postings, however many there are; results stay."""
    from answerloom.operators import block_index
    from answerloom.plans import answer_queries

    index, asked = answer_queries.index(spark, sf_dir), answer_queries.questions(spark, sf_dir)
    want = sorted(tuple(r) for r in index.search(asked, 10).collect())
    monkeypatch.setattr(block_index, "BUCKET_POSTINGS", -(-index.postings.count() // 9))
    name = f"t_{uuid.uuid4().hex}"
    saved = BlockIndex.save(index, name, str(tmp_path), buckets=4)
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}_blocks").collect()}
    assert told["Num Buckets"] == "9"
    assert sorted(tuple(r) for r in saved.search(asked, 10).collect()) == want
