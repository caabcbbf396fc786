"""The registered queries and the pipeline, over the smallest tables."""

import pytest
from pyspark.sql import functions as F

from answerloom.llm import mixing, queries, simhash, stages
from tests.compare import same


SCHEMA_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, sf_dir, duck):
    same(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


def test_pipeline(spark, sf_dir):
    """Stages keep columns, only drop or repeat what came in, and reject junk."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns, before = docs.columns, docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == columns, name
        assert after.join(before, columns[:1], "left_anti").count() == 0, name
        before = after
    left = before.select("doc_id").distinct().join(labels, "doc_id")
    assert left.filter("quality = 0").count() <= 0.05 * labels.filter("quality = 0").count()
    last = p.STAGES[-1][1](spark, before, sf_dir)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert last.count() == before.count()


def test_run_by_brute_force(spark, sf_dir, tmp_path):
    """run() against: survivors by comparing all pairs, copies by the SQL of the mix, tokens by the library."""
    from collections import Counter

    import duckdb

    import corpus_pipeline as p
    from tests.llm.test_operators import brute_components, expected_tokens

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = stages.quality_classifier(spark, stages.quality_rules(spark, docs, sf_dir), sf_dir).toPandas()
    kept = kept.sort_values("doc_id", ignore_index=True)
    label = brute_components([simhash.fingerprint_text((t or "").encode()) for t in kept["text"]])
    documents = kept[label == range(len(kept))]
    con = duckdb.connect()
    con.register("documents", documents)
    copies = {i: int(taken / size + 0.5) for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.contract_sql()}) WHERE size > 0").fetchall()}
    want = Counter()
    for i, text in zip(documents["doc_id"], documents["text"], strict=True):
        if copies.get(i):
            want[(i, *expected_tokens(text))] = copies[i]
    got = p.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_stages_on_edge_cases(spark, sf_dir):
    """Nulls in any column, no words, very long texts, ties, repeated rows, columns with clashing names."""
    import corpus_pipeline as p
    from tests.llm.test_operators import SCHEMA, TEXTS

    good = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0"), "doc_id")
    texts = [*TEXTS, *[r["text"] for r in good.orderBy("doc_id").limit(8).collect()]]
    rows = [(i if i % 7 else None, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[-1], rows[13], rows[0]]
    clashing = ("kept", "n_tokens", "band", "evidence", "shift", "posterior", "host", "path", "fp", "component_id", "size", "taken", "target", "key", "order", "__k1", "__times")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in clashing}).repartition(3)
    came, out = {tuple(r) for r in rows}, {}
    for name, stage in p.STAGES:
        out[name] = stage(spark, docs, sf_dir)
        want = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if name == p.STAGES[-1][0] else SCHEMA_NAMES
        assert out[name].columns == want
        if name != p.STAGES[-1][0]:
            assert {tuple(r) for r in out[name].collect()} <= came
    # Rules: texts under ten words go, repeated good rows stay as often as they came.
    ruled = [tuple(r) for r in out["quality rules"].collect()]
    assert all(len((r[1] or "").split()) >= 10 for r in ruled) and ruled.count(rows[-4 - 1]) in (0, 3)
    assert out["quality classifier"].count() <= len(rows)
    # Near-dedup: no row twice, one row for all texts without a word.
    deduped = [tuple(r) for r in out["SimHash near-dedup"].collect()]
    assert len(deduped) == len(set(deduped)) and sum(not (r[1] or "").split() for r in deduped) == 1
    # The mix takes no text without a word; the last stage gives a row for each it gets.
    assert out["mixing sources"].filter("text is null or trim(text) = ''").count() == 0
    assert out["BPE encoding"].count() == len(rows)


def test_stages_on_nothing(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
