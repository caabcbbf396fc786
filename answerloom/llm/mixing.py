"""Mixing sources to target weights by a low-discrepancy schedule, natively.

Every source's documents are put in a hashed order and read as one stream of words,
cut into equal blocks. Golden-ratio points, mapped through the cumulative weights of
the sources, say whose block comes next: any stretch of the schedule has the target
mix. The rank of a slot within its source names the block, so sources that repeat go
round their blocks in order. Document offsets come from two levels of prefix sums, so
that no source, however large, passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.common import materialise, row_key

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of a source, unless it has fewer words; the mix is true to about one block.
BLOCKS = 4096
#: No document is taken more often.
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
KEYS = ("__k1", "__k2")
#: Golden ratio as a fraction of 2^32 (fixed value), and bits of a point's cell.
GOLDEN, BITS, CELL_BITS = 2654435769, 32, 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Adds weight, target to (source, source_size): water-filling under the caps.

    A source's cap is MOST_REPEATS times its size. In order of cap per weight, a
    source is capped while the level that the rest would get exceeds it; the rest
    share what remains by weight. One row a source, never one a document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1))
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("capped", F.col("cap") <= left.cast("double") / share * F.col("weight"))
    kept = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0)).over(every)
    level = F.try_divide(
        (F.sum("source_size").over(every) - kept("cap")).cast("double"), F.sum("weight").over(every) - kept("weight")
    )
    return s.withColumn(
        "target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    ).drop("capped", "cap")


def schedule(sources: DataFrame) -> DataFrame:
    """(key, block, copies) from (key, source_size, blocks, target): the slots dealt out.

    A source needs target / (words a block) slots. Slot k's point is k times the
    golden ratio, modulo 1, in 32-bit integers; its source is the one whose
    stretch of cumulative slots it falls in, found by an equality join on cells of
    the unit interval. Slots beyond MOST_REPEATS rounds of a source are void.
    """
    need = F.ceil(F.col("target") * F.col("blocks") * 1024 / F.col("source_size")).cast("long")
    s = sources.filter("source_size > 0 and target > 0").withColumn("need", need)
    run = Window.orderBy("key")
    s = s.withColumn("total", F.sum("need").over(Window.partitionBy())).withColumn("upto", F.sum("need").over(run))
    point = lambda c: F.floor(c.cast("double") / F.col("total") * (1 << BITS)).cast("long")
    s = s.withColumns({"lo": point(F.col("upto") - F.col("need")), "hi": point(F.col("upto"))})
    cells = s.filter("hi > lo").withColumn(
        "cell", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS)))
    )
    total = s.agg(F.ceil(F.max("total") / 1024)).first()[0] or 0
    k = sources.sparkSession.range(int(total)).withColumn("x", (F.col("id") * GOLDEN) % (1 << BITS))
    slots = k.withColumn("cell", F.shiftright("x", CELL_BITS)).join(cells, "cell").filter("x >= lo and x < hi")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id")) - 1  # at most 3 * BLOCKS rows a source
    return (
        slots.select("key", "blocks", rank.alias("rank"))
        .filter(F.col("rank") < MOST_REPEATS * F.col("blocks"))
        .groupBy("key", (F.col("rank") % F.col("blocks")).cast("long").alias("block"))
        .agg(F.count("*").alias("copies"))
    )


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken.

    taken counts the words of the document that the schedule takes, repeats included,
    at most MOST_REPEATS times size. Null and empty texts have size 0 and take 0; a
    null source is a source of its own, the last by name; repeated rows are separate
    documents; an empty table gives an empty mix. Order and points are fixed by
    doc_id and size alone, so reruns agree. Other columns of docs are not carried but
    those named by carry, which should be narrow and unlike any other here.
    """
    name = F.col(source).cast("string")
    # Rows without an id, or with the same one, part by their sizes.
    mixed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size")).cast("binary"))
    sized = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            name.alias("source"),
            F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("key"),
            word_count(F.col(text)).alias("size"),
            *carry,
        ).withColumn("order", mixed)
    ).withColumn("bucket", F.substring("order", 1, 3))
    buckets = sized.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    sizes = buckets.groupBy("key").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    sources = materialise(
        source_targets(sizes).withColumn("blocks", F.least("source_size", F.lit(BLOCKS)).cast("long"))
    )
    copies = schedule(sources)
    start = F.expr("block * source_size div blocks")
    block = (
        sources.filter("blocks > 0")
        .select("key", "source_size", "blocks", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
        .join(copies, ["key", "block"], "left")
        .withColumn("copies", F.coalesce("copies", F.lit(0)))
        .withColumns({"start": start, "end": F.expr("(block + 1) * source_size div blocks")})
    )
    held = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.withColumn(
        "before", F.coalesce(F.sum(F.col("copies") * (F.col("end") - F.col("start"))).over(held), F.lit(0))
    ).select("key", "block", "copies", "start", "before")

    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = (
        buckets.drop("source")
        .withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
        .drop("words")
        .join(sources.select("key", "source_size", "blocks", "target"), "key")
    )
    within = Window.partitionBy("key", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.withColumn("upto", F.sum("size").over(within))
        .join(prefix, ["key", "bucket"])
        .withColumn("to", F.col("ahead") + F.col("upto"))
        .withColumn("at", F.col("to") - F.col("size"))
        .withColumns(
            {
                # The block of a word: the last one that starts at it or before.
                "b0": F.expr("CASE WHEN size > 0 THEN ((at + 1) * blocks - 1) div source_size END"),
                "b1": F.expr("CASE WHEN size > 0 THEN (to * blocks - 1) div source_size END"),
            }
        )
    )
    first = block.select("key", *[F.col(c).alias(c + "0") for c in ("block", "copies", "start", "before")])
    last = block.select("key", *[F.col(c).alias(c + "1") for c in ("block", "copies", "start", "before")])
    taken = F.col("before1") + F.col("copies1") * (F.col("to") - F.col("start1")) - (
        F.col("before0") + F.col("copies0") * (F.col("at") - F.col("start0"))
    )
    return (
        placed.withColumnsRenamed({"b0": "block0", "b1": "block1"})
        .join(first, ["key", "block0"], "left")
        .join(last, ["key", "block1"], "left")
        .select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"),
            *carry,
        )
    )


def contract_sql() -> str:
    """The same mix in SQL."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || size) AS ord FROM documents),
sizes AS (SELECT key, min(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight, {MOST_REPEATS} * source_size AS cap FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, (sum(weight) OVER ())::DOUBLE AS weights,
    coalesce(sum(cap) OVER o, 0)::DOUBLE AS cap_before, coalesce(sum(weight) OVER o, 0)::DOUBLE AS weight_before
  FROM weighed WINDOW o AS (ORDER BY cap::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capping AS (SELECT *, cap::DOUBLE <= (total - cap_before) / (weights - weight_before) * weight AS capped FROM levels),
leveled AS (
  SELECT *, sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS cap_kept, sum(CASE WHEN capped THEN weight ELSE 0 END) OVER () AS weight_kept FROM capping),
sources AS (
  SELECT key, source_size, least(source_size, {BLOCKS}) AS blocks,
    CASE WHEN capped THEN cap::DOUBLE ELSE (total - cap_kept::DOUBLE) / nullif(weights - weight_kept::DOUBLE, 0) * weight END AS target FROM leveled),
needs AS (SELECT *, ceil(target * blocks * 1024 / source_size)::BIGINT AS need FROM sources WHERE source_size > 0 AND target > 0),
runs AS (SELECT *, (sum(need) OVER ())::BIGINT AS total, (sum(need) OVER (ORDER BY key))::BIGINT AS upto FROM needs),
bounds AS (SELECT key, blocks, total, floor((upto - need)::DOUBLE / total * {1 << BITS})::BIGINT AS lo, floor(upto::DOUBLE / total * {1 << BITS})::BIGINT AS hi FROM runs),
points AS (SELECT k, (k * {GOLDEN}) % {1 << BITS} AS x FROM (SELECT unnest(range(ceil((SELECT max(total) FROM runs)::DOUBLE / 1024)::BIGINT)) AS k)),
slots AS (SELECT key, blocks, row_number() OVER (PARTITION BY key ORDER BY k) - 1 AS r FROM points JOIN bounds ON x >= lo AND x < hi),
copied AS (SELECT key, r % blocks AS block, count(*) AS copies FROM slots WHERE r < {MOST_REPEATS} * blocks GROUP BY key, r % blocks),
grid AS (SELECT key, source_size, blocks, unnest(range(blocks)) AS block FROM sources),
sized_blocks AS (
  SELECT key, block, coalesce(copies, 0) AS copies, block * source_size // blocks AS s, (block + 1) * source_size // blocks AS e
  FROM grid LEFT JOIN copied USING (key, block)),
block AS (
  SELECT key, block, copies, s, coalesce(sum(copies * (e - s)) OVER (PARTITION BY key ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized_blocks),
placed AS (
  SELECT doc_id, size, key, source_size, blocks, target, (sum(size) OVER (PARTITION BY key ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM sized JOIN sources USING (key)),
asked AS (
  SELECT *, upto - size AS at, CASE WHEN size > 0 THEN ((upto - size + 1) * blocks - 1) // source_size END AS b0, CASE WHEN size > 0 THEN (upto * blocks - 1) // source_size END AS b1 FROM placed)
SELECT a.doc_id, a.size, a.source_size, a.target,
  coalesce(l.before + l.copies * (a.upto - l.s) - (f.before + f.copies * (a.at - f.s)), 0)::BIGINT AS taken
FROM asked a LEFT JOIN block f ON f.key = a.key AND f.block = a.b0 LEFT JOIN block l ON l.key = a.key AND l.block = a.b1"""


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: each row as often as its words are taken, rounded.

    Only the document at which a source's last round ends is taken in part; whole
    documents therefore stay within half a document of the schedule, per source. All
    columns stay. Rows alike in every column are taken as often as they are together;
    documents without a word are not taken. The mix sees narrow rows; each text moves
    once, to meet its number of copies by 128-bit row hash.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns(row_key(*columns))
    times = (
        mix(keyed, carry=KEYS).filter("size > 0")
        .groupBy(*KEYS).agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("__times"))
        .filter("__times > 0")
    )
    chosen = keyed.join(times, list(KEYS)).dropDuplicates(list(KEYS))
    return chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*columns)
