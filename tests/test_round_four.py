import random
import time

import duckdb
from pyspark.sql import functions as F

from answerloom.functions import text
from answerloom.plans import text_queries


def test_tone_marks_against_sql(spark):
    """Random syllables, marks, digits and other letters, as the query's SQL places their tones."""
    rng = random.Random(4)
    vowels = [*text.VOWELS, *"".join(text.TONED)]
    pool = [*vowels, *vowels, "qu", "gi", "Qu", "GI", "qU", "h", "n", "ng", "ß", "đ", "я", "ǅ", "ʰ", "中", "²", "Ⅷ", "½", "٣", "7", "_", "-", " ", "\n", "|", "́", "𝒳"]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(3000)] + ["", None, "hoá", "qúy\n"]
    con = duckdb.connect()
    con.execute("CREATE TABLE given (key INT, text VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?, ?)", list(enumerate(texts)))
    want = dict(con.execute(f"WITH asked AS (FROM given), {text_queries._sql_tones()} SELECT key, text FROM moved").fetchall())
    got = spark.createDataFrame(list(enumerate(texts)), "key int, text string").select("key", text.place_tones(F.col("text")).alias("text"))
    assert {r["key"]: r["text"] for r in got.collect() if texts[r["key"]]} == want


def test_tone_marks_place_a_repeated_word_once(spark):
    """200,000 texts of the same thirty words took minutes when each word was placed anew."""
    asked = spark.range(200_000, numPartitions=4).select(F.concat(F.lit(text_queries.SPELLINGS), F.col("id").cast("string")).alias("text"))
    asked.limit(1).select(text.place_tones("text")).collect()
    began = time.perf_counter()
    asked.select(text.place_tones("text").alias("text")).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 20


def test_frequent_phrases_by_numbers_and_by_themselves(spark, monkeypatch):
    """The lexicon of segmented_turns, as counted in Python; sequences are counted as numbers while the words are few."""
    import re
    from collections import Counter

    from answerloom.operators import segment

    rng = random.Random(5)
    pool = ["a", "b", "c", "Đa", "é", "é", "x1", "²", ".", ",", "!", "中", "rare", "\n"]
    texts = [" ".join(rng.choices(pool, [9, 8, 7, 4, 3, 3, 3, 2, 2, 1, 1, 2, 0.1, 1], k=rng.choice([0, 1, 2, 3, 60]))) for _ in range(1500)] + [None, "", "a", "a b"]
    counts = Counter()
    for t in texts:
        w = re.findall(r"(?:[^\W_]|́)+|[^\w\s]", (t or "").lower())
        counts.update(" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1))
    want = sorted(p for p, n in counts.items() if n >= 20 and not set(p) & set(".,!"))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert len(want) > 100
    for most, at_once in ((64 << 20, 1 << 20), (64 << 20, 100), (64 << 20, 1), (0, 1)):
        monkeypatch.setattr(segment, "MOST_VOCABULARY", most)
        monkeypatch.setattr(segment, "COUNTED_WORDS", at_once)
        found = segment.frequent_phrases(docs, 20)
        assert ("pair" in found._jdf.queryExecution().toString()) == (most > 0)
        assert sorted(r["phrase"] for r in found.collect()) == want
    assert segment.frequent_phrases(docs.limit(0), 20).collect() == []


def test_a_search_of_blocks_scores_the_probes_once(spark, tmp_path):
    """The plan that is left reads blocks, terms asked, statistics and slices wanted; before, also all that these came from."""
    from answerloom.operators.block_index import BlockIndex
    from answerloom.operators.index import BM25Index

    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 9)))) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a b"), (1, "h")], "qid long, question string")
    index = BM25Index.build(docs)
    found = BlockIndex.save(index, "blocks_once", str(tmp_path / "index"), buckets=3, docs=8).search(asked, 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 4
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, index.search(asked, 3).collect()))
