"""BPE encoding and decoding with content-defined chunks that documents share.

A rolling hash cuts every text into chunks at places that depend on nearby bytes only,
so that copied passages give equal chunks wherever they stand. Chunk hashes are
counted over the whole corpus; a chunk that occurs twice or more is encoded once, by
the text of least key that holds it, and its tokens are handed to the others. At the
joins the open words on both sides are encoded again, in a window that must reproduce
the tokens of the words beside it; where it doesn't, the window grows to the text.

Only texts that share a chunk are moved, each different one once. Which they are is
told to the readers by a bit table of bounded size; a false yes moves a text in vain
and changes nothing. All other texts are encoded where they are read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import by_bytes, hot_keys, materialise, skew_join, utf8, vocabulary

VOCAB = "word_bpe_49k.json"
#: Bytes of a chunk: at least, and on average between the cuts that the hash proposes.
LEAST_CHUNK, CHUNK_BITS = 64, 9
BATCH_BYTES = 1 << 20
#: Words that a Python worker remembers, from one batch and task to the next.
MEMO_WORDS = 300_000
#: Bytes given to the library in one call, and the mark that parts texts inside it.
CALL_BYTES, MARK = 1 << 16, b"\x01"
#: Bits of the table of texts to move: at most (4 MB), and per text.
MOST_BITS, BITS_PER_TEXT = 1 << 25, 16
_SPACE = re.compile(rb"[ \t-\r]")

CHUNKS = "k1 long, k2 long, h1 long, h2 long"
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.cache
def gear() -> np.ndarray:
    """256 hashed weights of the rolling hash."""
    import xxhash

    return np.array([xxhash.xxh32_intdigest(bytes([b]), 0) for b in range(256)], np.uint32)


def cuts(texts: list[bytes]) -> list[list[int]]:
    """Chunk ends of each text, its length the last; none in an empty text.

    The hash at a byte covers it and the 31 before. A cut never stands inside a
    character nor within LEAST_CHUNK bytes of the cut before.
    """
    flat = np.frombuffer(b"".join(texts), np.uint8)
    h = gear()[flat]
    for s in (1, 2, 4, 8, 16):
        h[s:] += h[:-s] << np.uint32(s)
    at = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    at = at[at < len(flat)]
    at = at[flat[at] & 0xC0 != 0x80]
    begins = np.cumsum([0, *map(len, texts)])
    bounds = np.searchsorted(at, begins)
    out = []
    for i, text in enumerate(texts):
        last, ends = 0, []
        for c in (at[bounds[i] : bounds[i + 1]] - begins[i]).tolist():
            if c - last >= LEAST_CHUNK and len(text) - c >= LEAST_CHUNK:
                ends.append(c)
                last = c
        out.append([*ends, len(text)] if text else [])
    return out


def key_of(data: bytes) -> tuple[int, int]:
    """128-bit key of a text or chunk as two signed longs."""
    import xxhash

    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


class WordBpe:
    """A vocabulary whose tokens never span white space, by words remembered."""

    def __init__(self, vocab: str = VOCAB):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        path = vocabulary(vocab)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if split.get("behavior") != "Removed" or not split.get("invert") or spec["post_processor"]:
            raise ValueError(f"{path}: tokens may span white space")
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        size = self.model.get_vocab_size()
        self.pieces = [(self.model.id_to_token(i) or "").encode() for i in range(size)]
        #: Without a decoder the library joins pieces by a space.
        self.joins = spec["decoder"] is None
        self.memo: dict[bytes, bytes] = {}
        mark = np.frombuffer(self.direct(MARK), "<u4").tolist()
        self.mark = mark[0] if len(mark) == 1 else None

    def direct(self, text: bytes) -> bytes:
        """Ids, as little-endian 32-bit bytes, straight from the library."""
        return np.array(self.model.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """direct() of many texts, in few calls.

        A call costs more than a word, so texts are put into one, parted by a marked
        word whose only token no other text can hold; texts with the mark go alone.
        """
        out = [b""] * len(texts)
        easy = [k for k, t in enumerate(texts) if MARK not in t]
        for k in range(len(texts)) if self.mark is None else sorted({*range(len(texts))} - {*easy}):
            out[k] = self.direct(texts[k])
        if self.mark is None:
            return out
        some = [texts[k] for k in easy]
        for i, j in by_bytes(some, CALL_BYTES):
            joined = (b" " + MARK + b" ").join(some[i:j]).decode()
            ids = np.array(self.model.encode(joined, add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(ids == self.mark) * 4).tolist()
            data, last = ids.tobytes(), 0
            for k, c in zip(easy[i:j], [*cuts, len(data)], strict=True):
                out[k], last = data[last:c], c + 4
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts, each word encoded once while it is remembered."""
        words = [t.split() for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = list({w for ws in words for w in ws if w not in self.memo})
        self.memo.update(zip(new, self.whole(new), strict=True))
        ids = [b"".join(map(self.memo.__getitem__, ws)) for ws in words]
        for w in new:
            if len(w) > 64:  # long words seldom return
                del self.memo[w]
        return ids

    def decode(self, ids: bytes) -> bytes:
        """What the library's decode gives, special tokens kept, as UTF-8."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.joins:
            return b" ".join(map(self.pieces.__getitem__, numbers))
        return self.model.decode(numbers, skip_special_tokens=False).encode()


@functools.lru_cache(maxsize=1)
def word_bpe(vocab: str) -> WordBpe:
    """The worker's own encoder, with what it remembers."""
    return WordBpe(vocab)


def open_ends(chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
    """Word that the chunk opens with, what stands between, word it ends with.

    The first and last may go on in the neighbours; None if the chunk is one word.
    """
    first = _SPACE.search(chunk)
    if not first:
        return None
    last = max(map(chunk.rfind, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    return chunk[: first.start()], chunk[first.end() : last], chunk[last + 1 :]


def stitch(bpe: WordBpe, text: bytes, ends: list[int], given: dict[tuple[int, int], bytes]) -> bytes:
    """Ids of text from given inner ids of shared chunks; the rest is encoded here.

    Neighbouring chunks that are not given are one piece. Each join is encoded anew
    as the word across it, in a window with the words beside it.
    """
    pieces: list[tuple[bytes, bytes | None]] = []
    last = 0
    for end in ends:
        chunk, last = text[last:end], end
        ids = given.get(key_of(chunk)) if given else None
        if ids is None and pieces and pieces[-1][1] is None:
            pieces[-1] = (pieces[-1][0] + chunk, None)
        else:
            pieces.append((chunk, ids))
    split = [open_ends(c) for c, _ in pieces]
    inner = iter(bpe.encode([s[1] for s, (_, ids) in zip(split, pieces, strict=True) if s and ids is None]))
    joins: list[bytes] = []
    bodies: list[tuple[bytes, bytes]] = []
    word = b""
    for s, (chunk, ids) in zip(split, pieces, strict=True):
        if s is None:
            word += chunk
            continue
        joins.append(word + s[0])
        bodies.append((s[1], next(inner) if ids is None else ids))
        word = s[2]
    joins.append(word)
    repaired = bpe.encode(joins)
    if not confirmed(bpe, joins, repaired, bodies):
        return bpe.direct(text)
    out = [repaired[0]]
    for (_, ids), r in zip(bodies, repaired[1:], strict=True):
        out += [ids, r]
    return b"".join(out)


def confirmed(bpe: WordBpe, joins: list[bytes], repaired: list[bytes], bodies: list[tuple[bytes, bytes]]) -> bool:
    """Whether every window gives the repaired word between its neighbours' own ids."""
    before = [b"", *(b.rsplit(None, 1)[-1] if b.strip() else b"" for b, _ in bodies)]
    behind = [*(b.split(None, 1)[0] if b.strip() else b"" for b, _ in bodies), b""]
    beside = bpe.encode(before + behind)
    left, right = beside[: len(before)], beside[len(before) :]
    own = [b"", *(ids for _, ids in bodies)]
    for i in range(len(joins)):
        if not own[i].endswith(left[i]) or not [*own[1:], b""][i].startswith(right[i]):
            return False
    windows = bpe.whole([b" ".join(x) for x in zip(before, joins, behind, strict=True)])
    return windows == [b"".join(x) for x in zip(left, repaired, right, strict=True)]


def digests(bpe: WordBpe, ids: Iterable[bytes]) -> list[tuple[int, str, str]]:
    """(n_tokens, sha-256 of ids, sha-256 of the decoded text)."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return [(len(x) // 4, sha(x), sha(bpe.decode(x))) for x in ids]


@dataclass(frozen=True)
class BitTable:
    """Which texts may share a chunk; never says no to one that does."""

    words: np.ndarray

    def __contains__(self, key: tuple[int, int]) -> bool:
        mask = len(self.words) * 64 - 1
        return all(int(self.words[(k & mask) >> 6]) >> (k & 63) & 1 for k in key)


def bit_table(keys: DataFrame) -> BitTable:
    """Table over (k1, k2) of at most MOST_BITS bits; its rows are words of 64 bits."""
    n = keys.count()
    bits = 1 << 12
    while bits < min(MOST_BITS, BITS_PER_TEXT * n):
        bits *= 2
    place = F.explode(F.array("k1", "k2")).alias("k")
    word = F.shiftright(F.col("k").bitwiseAND(F.lit(bits - 1)), 6)
    one = F.expr("shiftleft(1L, int(k & 63))")
    rows = keys.select(place).groupBy(word.alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.int64).view(np.uint64)
    return BitTable(table)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of docs.

    Null and empty texts have no tokens and the digests of nothing; repeated rows and
    repeated texts repeat their results; an empty table gives an empty result. Other
    columns of docs are not carried. Use WordBpe and stitch for the ids themselves.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for i, j in by_bytes(texts, BATCH_BYTES):
                out = []
                for t, ends in zip(texts[i:j], cuts(texts[i:j]), strict=True):
                    key = key_of(t)
                    out += [(*key, *key_of(t[a:b])) for a, b in zip([0, *ends], ends, strict=False)]
                yield _batch(out, ("k1", "k2", "h1", "h2"), [pa.int64()] * 4)

    chunks = materialise(rows.select("text").mapInArrow(chunk_rows, CHUNKS))
    shared = materialise(
        chunks.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2")).alias("owner"))
        .filter("n > 1")
        .select("h1", "h2", "n", "owner.*")
    )
    # Chunks of boilerplate stand in a large share of all texts, and copies share a text.
    often = hot_keys(shared, ["h1", "h2"], chunks.count())
    links = materialise(skew_join(chunks, shared.select("h1", "h2"), ["h1", "h2"], often).distinct())
    told = spark.sparkContext.broadcast(bit_table(links.select("k1", "k2").distinct()))

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that share nothing are encoded where they are read."""
        bpe = word_bpe(vocab)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), utf8(batch.column("text"))
            for i, j in by_bytes(texts, BATCH_BYTES):
                own = [k for k in range(i, j) if key_of(texts[k]) not in told.value]
                found = digests(bpe, bpe.encode([texts[k] for k in own]))
                yield _batch([(ids[k], *d) for k, d in zip(own, found, strict=True)], names, kinds)

    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    kind = docs.schema[doc_id].dataType
    kinds = [pa_type(kind), pa.int64(), pa.string(), pa.string()]
    alone = rows.mapInArrow(here, f"doc_id {kind.simpleString()}, {RESULT}")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            keys = map(key_of, utf8(batch.column("text")))
            yield _batch([(i, *k) for i, k in zip(ids, keys, strict=True) if k in told.value], ("doc_id", "k1", "k2"), [kinds[0], pa.int64(), pa.int64()])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that may share a chunk, each once a task."""
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for t in utf8(batch.column("text")):
                key = key_of(t)
                if key in told.value and key not in seen:
                    seen.add(key)
                    out.append((*key, t.decode()))
            yield _batch(out, ("k1", "k2", "text"), [pa.int64(), pa.int64(), pa.string()])

    texts = (
        rows.select("text").mapInArrow(moved, "k1 long, k2 long, text string")
        .groupBy("k1", "k2").agg(F.first("text").alias("text"))
    )
    owned = shared.groupBy("k1", "k2").agg(F.collect_list(F.struct("h1", "h2")).alias("wanted"))

    def encode_owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Inner ids of each shared chunk, from the one text that owns it."""
        bpe = word_bpe(vocab)
        for batch in batches:
            some = utf8(batch.column("text"))
            asked = batch.column("wanted").to_pylist()
            for i, j in by_bytes(some, BATCH_BYTES):
                found = {}
                for t, ends, w in zip(some[i:j], cuts(some[i:j]), asked[i:j], strict=True):
                    wanted = {(x["h1"], x["h2"]) for x in w}
                    for a, b in zip([0, *ends], ends, strict=False):
                        if (h := key_of(t[a:b])) in wanted:
                            found[h] = (open_ends(t[a:b]) or (b"",) * 3)[1]
                ids = bpe.encode(list(found.values()))
                yield _batch([(*h, x) for h, x in zip(found, ids, strict=True)], ("h1", "h2", "ids"), [pa.int64(), pa.int64(), pa.binary()])

    once = texts.join(owned, ["k1", "k2"]).select("text", "wanted").mapInArrow(
        encode_owned, "h1 long, h2 long, ids binary"
    )
    pieces = (
        skew_join(links, materialise(once), ["h1", "h2"], often)
        .groupBy("k1", "k2").agg(F.collect_list(F.struct("h1", "h2", "ids")).alias("given"))
    )

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocab)
        for batch in batches:
            some = utf8(batch.column("text"))
            k1, k2 = (batch.column(c).to_pylist() for c in ("k1", "k2"))
            given = batch.column("given")
            for i, j in by_bytes(some, BATCH_BYTES):
                out = []
                for k, ends in zip(range(i, j), cuts(some[i:j]), strict=True):
                    own = {(g["h1"], g["h2"]): g["ids"] for g in given[k].as_py() or ()}
                    out.append(stitch(bpe, some[k], ends, own) if some[k] else b"")
                found = digests(bpe, out)
                yield _batch([(k1[i + n], k2[i + n], *d) for n, d in enumerate(found)], ("k1", "k2", *names[1:]), [pa.int64(), pa.int64(), *kinds[1:]])

    results = materialise(texts.join(pieces, ["k1", "k2"], "left").mapInArrow(join_up, f"k1 long, k2 long, {RESULT}"))
    sharing = materialise(rows.mapInArrow(keyed, f"doc_id {kind.simpleString()}, k1 long, k2 long"))
    copied = hot_keys(sharing.groupBy("k1", "k2").agg(F.count("*").alias("n")), ["k1", "k2"], sharing.count())
    return alone.union(skew_join(sharing, results, ["k1", "k2"], copied).select(*names))


def pa_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))
