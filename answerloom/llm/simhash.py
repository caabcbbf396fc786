"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints within RADIUS = 4 bits are cut into three segments, one of
which then differs by one bit at most. Each fingerprint is indexed under every
segment with one bit struck out; fingerprints that agree on such a variant meet in
an equality grouping and are verified bit by bit. Only links that join what is not
yet joined leave a group, so a group never emits its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import even_parts, hot_keys, materialise, row_key, skew_join, utf8
from answerloom.llm.components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: (lowest bit, bits) of the segments: RADIUS // 3 = 1.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one signature compared in one block; larger groups are dealt out
#: as pairs of blocks.
BLOCK = 2048
#: Parts that the fingerprints of one component are dealt into.
SALTS = 32


def fingerprint_text(text: bytes) -> int:
    """Contract fingerprint of one text, A-Z folded."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: 1 - SHINGLE].tolist()
        one = xxhash.xxh64_intdigest
        hashes = [one(joined[i:j], SEED) for i, j in zip(begins, ends[SHINGLE - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory however long the text
        h = np.array(hashes[at : at + (1 << 16)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprint(text: Column) -> Column:
    """Signed 64-bit column; texts without a word, null among them, get 0."""
    @F.arrow_udf("long")
    def printed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            prints = [fingerprint_text(t) for t in utf8(batch)]
            yield pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())

    return printed(text)


def signatures(fp: Column) -> Column:
    """Array of the one-wildcard variants of all segments, each unique to its place.

    A variant keeps the other bits of its segment; the struck-out bit is 0 and its
    number, which also tells the segment, goes above the 22 segment bits.
    """
    out = []
    for low, bits in SEGMENTS:
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))
        for b in range(bits):
            rest = part.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << b)))
            out.append(rest.bitwiseOR(F.lit((low + b) << 22)))
    return F.array(*out)


def near_edges(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (src, dst) that connect what pairs within RADIUS bits connect.

    fps: one column fp of different fingerprints. A signature group larger than
    block is cut into g blocks by a hash; block pairs are verified separately, each
    fingerprint going to g of them, so that no task holds more than two blocks.
    """
    sig = even_parts(fps.select("fp"), "fp").select("fp", F.explode(signatures(F.col("fp"))).alias("sig"))
    large = sig.groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    g = F.coalesce(F.ceil(F.col("n") / F.lit(block)), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = (
        sig.join(large, "sig", "left")
        .withColumn("g", g)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .select("fp", "sig", low.alias("i"), high.alias("j"))
    )
    met = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return met.mapInArrow(_linked, "src long, dst long").distinct()


def _linked(batches: Iterator) -> Iterator:
    """Verifies runs of equal (sig, i, j); rows come sorted by them."""
    held: list[np.ndarray] = []
    columns = ("sig", "i", "j", "fp")
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in columns]))
        rows = np.concatenate(held, axis=1)
        last = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0))
        whole = int(last[-1]) + 1 if len(last) else 0
        if whole:
            yield _spanning(rows[:, :whole])
        held = [rows[:, whole:]]
    if held and held[0].shape[1]:
        yield _spanning(held[0])


def _spanning(rows: np.ndarray) -> pa.RecordBatch:
    """Spanning links of each run: pairs at distance 1, 2, … inside it, until all are met."""
    fp = rows[3].view(np.uint64)
    run = np.concatenate([[0], np.cumsum((rows[:3, 1:] != rows[:3, :-1]).any(0))])
    parent = np.arange(len(fp))
    ends = np.append(np.flatnonzero(np.diff(run)), len(run) - 1)
    left = ends[run] - np.arange(len(run))  # rows of the run behind this one
    src, dst = [], []
    here, d = np.flatnonzero(left > 0), 1
    while len(here):
        near = here[np.bitwise_count(fp[here] ^ fp[here + d]) <= RADIUS]
        near = near[parent[near] != parent[near + d]]
        if len(near):
            for a in near.tolist():
                ra, rb = _root(parent, a), _root(parent, a + d)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    src.append(a)
                    dst.append(a + d)
            while (parent[parent] != parent).any():
                parent = parent[parent]
        d += 1
        here = here[left[here] >= d]
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[3][src], pa.int64()), pa.array(rows[3][dst], pa.int64())], names=["src", "dst"]
    )


def _root(parent: np.ndarray, a: int) -> int:
    while parent[a] != a:
        a = parent[a]
    return a


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds fp (long), fingerprint (hex) and component_id to one row per row of docs.

    component_id is the smallest doc_id that links reach, over equal fingerprints
    and pairs within RADIUS bits; null doc_ids never name a component unless it has
    no other. Null and empty texts share fingerprint 0 and are linked as any others.
    Repeated rows stay repeated. Other columns of docs are not carried.
    """
    prints = materialise(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = _linked_nodes(nodes)
    # Few nodes have links; the others stand for themselves and are joined to nothing.
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).alias("salt")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    )
    told = linked.select("fp", "component", salt).join(named, ["component", "salt"]).select("fp", "component_id")
    by_fp = nodes.join(told, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    hot = hot_keys(nodes, ["fp"], prints.count())
    return skew_join(prints, by_fp, ["fp"], hot).select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _linked_nodes(nodes: DataFrame) -> DataFrame:
    """nodes(fp, ...) that have a near one, with their component."""
    edges = materialise(near_edges(nodes.select("fp")))
    return nodes.join(connected_components(edges, "src", "dst").withColumnRenamed("node", "fp"), "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs that stand for their component, all columns as they were.

    The first row by (doc_id, whole row) of each component stays, so of repeated rows
    one stays. The choice needs narrow rows only; texts are joined back by their
    128-bit row hash in one shuffle.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns(row_key(*columns))
    narrow = keyed.select(F.col(doc_id).alias("id"), "__k1", "__k2", fingerprint(F.col(text)).alias("fp"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "__k1", "__k2")).alias("first")
    nodes = materialise(narrow.groupBy("fp").agg(first))
    linked = _linked_nodes(nodes)
    firsts = (
        nodes.join(linked.select("fp"), "fp", "left_anti").select("first")
        .union(linked.groupBy("component").agg(F.min("first").alias("first")).select("first"))
        .select("first.__k1", "first.__k2")
    )
    # Rows alike in every column share both hashes; one of them stays.
    chosen = keyed.join(firsts, ["__k1", "__k2"], "left_semi")
    return chosen.dropDuplicates(["__k1", "__k2"]).select(*columns)
