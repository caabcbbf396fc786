"""Which filters remove what, in every order: a Walsh-Hadamard audit.

Every document fails a set of the filters, a mask. Over each part of the corpus and each
label, the signed parity sums of the masks (one for every set of filters: plus where a
mask meets the set evenly, minus where oddly) are plain sums, so they are formed by one
grouping that combines before its shuffle. Inverting the transform gives back the exact
number of documents with each mask, and from those few numbers every order, every step
and the Shapley value (a document that fails c filters credits each in 1/c of the orders)
follow without another look at the documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import materialise

LETTERS = "ABCDE"
#: Fixed values of the contract.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 2
SYMBOLS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
LABELS = ("all", "good", "toxic")
#: Salts over which documents without an id meet no label.
SALTS = 1024


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, fails) of every document; bit k of fails is filter k of LETTERS.

    A null text is empty, a null part the empty string. A document without an id is a copy
    of none, and none is a copy of it. Texts are identical if their SHA-256 are.
    """
    words = F.array_remove(F.split("text", SPACES), "")
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    tests = (
        F.size("words") < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * F.size("words"),
        100 * upper > MOST_UPPER * F.length("text"),
        F.col("text").rlike(SYMBOLS),
    )
    read = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(text, F.lit("")).alias("text"),
    ).withColumn("words", words)
    seen = materialise(
        read.select("doc_id", "part", _mask(tests).alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest"))
    )
    firsts = seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    both = seen.join(firsts, ["digest", "doc_id"], "left")
    return both.select("doc_id", "part", F.col("fails").bitwiseOR(_mask([copy], 4)).alias("fails"))


def _mask(tests: Sequence[Column], first: int = 0) -> Column:
    """Bits of the tests that hold."""
    out = F.lit(0)
    for k, test in enumerate(tests, first):
        out = out + F.when(test, 1 << k).otherwise(0)
    return out


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, label): a row of "all" for every document, and one for each label it has.

    labels are (doc_id, quality, toxic): good is quality 1, toxic is toxic 1; with several
    rows of one id, any. Documents without an id have none.
    """
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    # Rows without an id would all be one key.
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("part", "fails", F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(0)
    met = failed.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    has = F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")))
    return met.select("part", "fails", F.explode(has).alias("label"))


def parity_sums(labelled: DataFrame, n: int = len(LETTERS)) -> DataFrame:
    """(part, label, sums): the 2**n signed parity sums of the masks."""
    signs = [F.sum(1 - 2 * (F.bit_count(F.col("fails").bitwiseAND(w)) % 2)) for w in range(1 << n)]
    return labelled.groupBy("part", "label").agg(*[s.alias(f"s{w}") for w, s in enumerate(signs)]).select(
        "part", "label", F.array(*[f"s{w}" for w in range(1 << n)]).alias("sums")
    )


def cells(sums: DataFrame, n: int = len(LETTERS)) -> DataFrame:
    """(part, all, good, toxic): documents of each mask, by the inverse transform.

    The sums of signs are multiples of 2**n, so the division is exact.
    """
    inverse = f"""transform(sequence(0, {(1 << n) - 1}), m -> aggregate(sequence(0, {(1 << n) - 1}), 0L,
        (s, w) -> s + sums[w] * (1 - 2 * (bit_count(m & w) % 2))) div {1 << n})"""
    each = sums.select("part", "label", F.expr(inverse).alias("cells"))
    none = F.array_repeat(F.lit(0).cast("long"), 1 << n)
    return each.groupBy("part").agg(
        *[F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), none).alias(x) for x in LABELS]
    )


def steps(parts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step in it, from cells()."""
    orders = ["".join(p) for p in permutations(letters)]
    each = [(o, k + 1, 1 << letters.index(o[k]), sum(1 << letters.index(c) for c in o[:k])) for o in orders for k in range(len(o))]
    columns = [F.lit(list(c)) for c in zip(*each, strict=True)]
    rows = parts.withColumn("x", F.explode(F.arrays_zip(*columns))).select(
        "part", *LABELS, *[F.col("x")[str(k)].alias(c) for k, c in enumerate(("filter_order", "step", "own", "before"))]
    )

    def total(condition: str, of: str = "all", value: str = "`all`[m]") -> Column:
        value = value.replace("`all`", f"`{of}`")
        return F.expr(f"aggregate(sequence(0, {(1 << len(letters)) - 1}), 0L, (s, m) -> s + if({condition}, {value}, 0L))")

    here, met = "(m & own) <> 0 AND (m & before) = 0", factorial(len(letters))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("(m & (own | before)) = 0").alias("kept"),
        total(here).alias("removed"),
        total("(m & own) <> 0 AND (m & before) <> 0").alias("redundant"),
        total("m = own").alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total("(m & own) <> 0", value=f"`all`[m] * ({met} div bit_count(m))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over docs: a row for each part, order and step, zeros included.

    Nulls, empty texts, repeated rows and ids as in failures() and with_labels(); further
    columns of either table are not looked at. No documents give no parts and no rows.
    """
    return steps(cells(parity_sums(with_labels(failures(docs), labels))))


def contract_sql() -> str:
    """The same counts, by counting masks."""
    space = r"[\x20\x09-\x0D]+"
    letters = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(LETTERS))
    names = "pqrst"
    picks = ", ".join(f"f {n}" for n in names)
    differ = " AND ".join(f"{x}.ch <> {y}.ch" for i, x in enumerate(names) for y in names[i + 1 :])
    bits = ", ".join(f"{n}.bit AS {n}" for n in names)
    steps = " UNION ALL ".join(
        f"SELECT o, {k + 1} AS step, {n} AS own, {' + '.join(names[:k]) or 0} AS before FROM orders"
        for k, n in enumerate(names)
    )
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
  list_filter(string_split_regex(coalesce(text, ''), '{space}'), lambda x: x <> '') AS ws FROM documents),
m AS (SELECT doc_id, part, (len(ws) < {LEAST_WORDS})::INT + 2 * (100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_UPPER} * length(t))::INT + 8 * regexp_matches(t, '{SYMBOLS}')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
f(ch, bit) AS (VALUES {letters}),
orders AS (SELECT concat({", ".join(f"{n}.ch" for n in names)}) AS o, {bits} FROM {picks} WHERE {differ}),
steps AS ({steps})
SELECT part, o AS filter_order, step,
  coalesce(sum(n) FILTER (fails & (own | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails & own <> 0 AND fails & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (fails & own <> 0 AND fails & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * {factorial(len(LETTERS))} // greatest(bit_count(fails), 1)) FILTER (fails & own <> 0), 0)::BIGINT AS shapley
FROM cells, steps GROUP BY part, o, step"""
