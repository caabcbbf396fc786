"""Packing documents into sequences by minimum bin slack.

A document's tokens, an end token behind them, are one piece, or several full ones if
they exceed the capacity. What remains is bin packing over lengths 1 to capacity, and
only how many pieces have each length matters: at most `capacity` counts, whatever the
corpus. For each bin a subset-sum over bitsets finds the fullest combination of the
lengths still available, which is removed; while the same combination is left, the next
bin takes it too, so equal bins are one entry of the plan. The plan has no more entries
for a billion documents than for a million.

Pieces are numbered within their length (salted, so that a common length is many tasks)
and find bin and offset by a range lookup in the plan. Full pieces are bins of their own
and are not moved at all.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerloom.llm.common import materialise, vocabulary

VOCAB, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
CAPACITY = 2048
#: Token behind every document.
END = 0
#: Rows of one length that are numbered in one group.
GROUP_ROWS = 4096
#: Bytes of ids that are handed on together.
BATCH_BYTES = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary"
OWN = ("length", "sequence_id", "offset")


class ByteEncoder:
    """Ids as the tokenizers library gives them for a byte-level vocabulary.

    Where a file of ranks holds the same tokens under the same ids, a faster library does
    the work: merging by rank and merging by the list agree then. Texts that its regular
    expressions give up on (runs of millions of spaces) go to the first library.
    """

    def __init__(self, vocab: str = VOCAB, ranks: str | None = RANKS):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary(vocab))
        self.exact.no_truncation()
        self.exact.no_padding()
        self.fast = self._fast(ranks) if ranks else None

    def _fast(self, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary(ranks), "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
        tokens = {t: i for t, i in self.exact.get_vocab().items() if t not in special}
        letters = byte_letters()
        if known != {bytes(map(letters.__getitem__, t)): i for t, i in tokens.items()}:
            return None
        return tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special
        )

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def byte_letters() -> dict[str, int]:
    """Byte of each letter that byte-level vocabularies are written in: printable Latin-1
    as it is, other bytes in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    vocab: str = VOCAB,
    ranks: str | None = RANKS,
    end: int = END,
) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document; ids are little-endian u32.

    A null text is empty, which leaves the end token alone. Repeated rows give repeated
    pieces, null ids stay null, further columns of docs are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, held = ByteEncoder(vocab, ranks), [], 0
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(t.as_py() or ""), np.uint32(end)).astype("<u4", copy=False)
                for k, (start, length) in enumerate(cut_pieces(len(ids), capacity)):
                    out.append((key, k, start, length, ids[start : start + length].tobytes()))
                held += ids.nbytes
                if held >= BATCH_BYTES:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids"])


class Bins(NamedTuple):
    """`times` bins that each hold `copies[length]` pieces of every length in it."""

    copies: dict[int, int]
    times: int


def fullest(left: Mapping[int, int], capacity: int) -> dict[int, int]:
    """Copies of available lengths whose sum comes nearest to capacity.

    Bit s of a set says that a sum of s can be formed. Lengths join from the longest on
    and the first set that reaches the capacity ends it, so long pieces go first.
    """
    full, sets, tried = (1 << capacity + 1) - 1, [1], []
    for length in sorted(left, reverse=True):
        bits, rest, some = sets[-1], min(left[length], capacity // length), 1
        while rest:
            some = min(some, rest)
            bits |= bits << some * length & full
            rest, some = rest - some, 2 * some
        sets.append(bits)
        tried.append(length)
        if bits >> capacity:
            break
    target, out = sets[-1].bit_length() - 1, {}
    for length, before in zip(reversed(tried), reversed(sets[:-1]), strict=True):
        n = 0
        while not before >> target & 1:
            target, n = target - length, n + 1
        if n:
            out[length] = n
    return out


def plan_bins(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Minimum bin slack over counts of lengths, equal bins in a row as one entry.

    It is planned twice, free and with the longest piece left in every bin, which must go
    somewhere and finds less to go with later; the plan of fewer bins counts.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must lie in 1 to {capacity}")
    plans = [fill_bins(counts, capacity, longest) for longest in (False, True)]
    return min(plans, key=lambda plan: sum(p.times for p in plan))


def fill_bins(counts: Mapping[int, int], capacity: int, longest: bool) -> list[Bins]:
    """Bin after bin the fullest combination that is left, with the longest piece or any.

    A combination that was the fullest stays so while enough copies are left, since less
    is available then. An entry leaves fewer copies of some length than it takes, so the
    entries number at most the sum of capacity / length over all lengths.
    """
    left, out = Counter({n: c for n, c in counts.items() if c}), []
    while left:
        first = Counter([max(left)] if longest else [])
        copies = first + Counter(fullest(left - first, capacity - sum(first)))
        times = min(left[n] // c for n, c in copies.items())
        left -= Counter({n: c * times for n, c in copies.items()})
        out.append(Bins(dict(copies), times))
    return out


def slots(plan: list[Bins]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, copies, bin, offset): the pieces numbered first to last - 1 of
    a length fill `copies` places a bin, from that bin and offset on."""
    out, given, at = [], {}, 0
    for copies, times in plan:
        offset = 0
        for length, n in copies.items():
            first = given.get(length, 0)
            given[length] = first + n * times
            out.append((length, first, given[length], n, at, offset))
            offset += n * length
        at += times
    return out


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id and offset; each row is a piece of `length` tokens.

    Rows are written once, with a number of their own, and read twice: for the counts, and
    to be placed. Every row comes back, repeated ones too; columns with the two names are
    replaced. Lengths that are null or not in 1 to capacity raise. No rows give none.
    """
    spark = items.sparkSession
    rows = materialise(items.drop("sequence_id", "offset").withColumn("__row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if None in counts or any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must lie in 1 to {capacity}")
    counts.pop(capacity, None)
    alone = rows.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("__row"), "offset": F.lit(0).cast("long")})
    if not counts:
        return alone.drop("__row")
    # Both tables have at most some rows a length, whatever the number of pieces.
    salts = spark.createDataFrame([(n, -(-c // GROUP_ROWS)) for n, c in counts.items()], "length long, __salts long")
    table = spark.createDataFrame(
        slots(plan_bins(counts, capacity)), "__length long, __first long, __last long, __copies long, __bin long, __offset long"
    )
    group = ["length", "__salt"]
    short = rows.filter(F.col("length") < capacity).join(F.broadcast(salts), "length")
    short = short.withColumn("__salt", F.pmod(F.xxhash64("__row"), "__salts")).drop("__salts")
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = short.groupBy(*group).agg(F.count("*").alias("__n")).select(*group, F.coalesce(before, F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy(*group).orderBy("__row")) - 1
    numbered = short.withColumn("__at", at).join(starts, group).withColumn("__at", F.col("__at") + F.col("__before"))
    met = numbered.join(
        F.broadcast(table), F.expr("length = __length AND __at >= __first AND __at < __last")
    ).withColumns(
        {
            "sequence_id": F.expr("__bin + (__at - __first) div __copies"),
            "offset": F.expr("__offset + (__at - __first) % __copies * length"),
        }
    )
    return met.select(alone.columns).unionByName(alone).drop("__row")


def sequences(placed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids): the packed sequences, capacity tokens at most each."""
    held = F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("ids"), "doc_id", "piece")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), held.alias("held")).select(
        "sequence_id",
        "n_tokens",
        F.aggregate("held", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"),
        F.transform("held", lambda x: x["doc_id"]).alias("doc_ids"),
    )


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every document."""
    return place(pieces(docs, doc_id, text, capacity), capacity)
