"""Quality rules from tokeniser fertility, beside plain word and line rules.

A public vocabulary that never saw a kind of text spells it out: few characters per
token, many byte-fallback tokens. Text that says one thing again and again, or strews
the same symbols between its words, uses few different tokens: low entropy for its
length. Each language (or script, where the language is not listed) has a band for the
three measures; a document outside its band is rejected.
All is computed in one narrow pass: no shuffle, no state beyond one Arrow batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import by_bytes, utf8, vocabulary

VOCAB = "piece_bpe_32k.model"
BATCH_BYTES = 2 << 20
#: Words kept with their tokens from one batch to the next, then forgotten together.
MEMO_WORDS = 200_000
#: (tokens, factor, bits): below so many tokens the lower ends are those of LEAST_BITS, for
#: characters times the factor, for entropy less the bits. Pieces of clean labelled
#: documents of 10 to 34 words, 38,000 of them, spread so much more.
SHORT = ((32, 0.8, 2.2), (50, 0.8, 0.8))
#: Byte tokens that any text may hold beside its band's share: two rare characters.
FREE_BYTES = 8
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, n_byte_tokens long, token_entropy double"
)


@dataclass(frozen=True)
class Band:
    """What a document may measure: characters per token, byte share, entropy in bits.

    Short texts spread more and have less entropy, so the lower ends go by length: the
    i-th holds from 2 ** (LEAST_BITS + i) tokens on.
    """

    min_chars: tuple[float, ...]
    max_chars: float
    max_byte_share: float
    min_entropy: tuple[float, ...]
    max_entropy: float


LEAST_BITS, LENGTHS = 5, 8
BAND = "min_chars: array<double>, max_chars: double, max_byte_share: double, min_entropy: array<double>, max_entropy: double"

#: By language, then by script for other languages. Lower ends lie just under the least
#: clean text of that length: labelled documents of the given tables (all of them for
#: en, de, fr and es, the least of the four for latin), and the lowest 0.5 % of texts
#: joined from the translated messages of installed programs, 15 more Latin and 20 other
#: languages (Chinese and Japanese also cut into words of two characters). Upper ends
#: stand over the greatest of both with room to spare, as messages are plainer than
#: prose. Scripts with no clean text at hand share the wide last band.
BANDS: dict[str, Band] = {
    "en": Band((1.37, 1.37, 1.75, 1.89, 1.97, 1.97, 2.06, 2.09), 5.9, 0.02, (4.71, 4.83, 5.43, 5.91, 6.25, 6.53, 6.71, 6.77), 10.2),
    "de": Band((1.23, 1.23, 1.83, 1.95, 2.03, 2.07, 2.08, 2.11), 4.2, 0.02, (4.24, 4.59, 5.66, 5.88, 6.16, 6.3, 6.3, 6.3), 10.5),
    "fr": Band((1.57, 1.57, 1.57, 1.63, 1.76, 1.8, 1.85, 1.85), 4.4, 0.02, (4.82, 4.82, 5.44, 5.87, 6.06, 6.21, 6.21, 6.21), 10.3),
    "es": Band((1.27, 1.68, 1.7, 1.71, 1.73, 1.79, 1.8, 1.81), 4.2, 0.02, (4.59, 5, 5.66, 5.81, 6.08, 6.35, 6.35, 6.35), 10.3),
    "latin": Band((0.92, 0.92, 1.01, 1.04, 1.08, 1.11, 1.14, 1.16), 4.3, 0.15, (4.24, 4.83, 5.44, 5.51, 6.06, 6.31, 6.44, 6.51), 10.3),
    "cyrillic": Band((1.29, 1.29, 1.41, 1.41, 1.54, 1.57, 1.59, 1.61), 3.3, 0.06, (4.88, 5.08, 5.63, 5.75, 6.89, 7.21, 7.44, 7.6), 10.1),
    "greek": Band((0.78, 0.78, 0.79, 0.8, 0.81, 0.82, 0.82, 0.84), 1.8, 0.02, (3.87, 3.87, 4.18, 4.29, 4.46, 4.54, 4.64, 4.69), 6.5),
    "arabic": Band((0.76, 0.76, 0.76, 0.76, 0.77, 0.8, 0.81, 0.82), 1.6, 0.08, (3.65, 3.69, 4.01, 4.16, 4.3, 4.42, 4.49, 4.57), 6.4),
    "hebrew": Band((0.75, 0.77, 0.78, 0.78, 0.8, 0.82, 0.83, 0.83), 1.9, 0.05, (3.59, 3.66, 4.01, 4.16, 4.34, 4.52, 4.59, 4.7), 6.3),
    "devanagari": Band((0.66, 0.66, 0.7, 0.72, 0.73, 0.74, 0.74, 0.75), 1.7, 0.33, (4.04, 4.04, 4.2, 4.47, 4.63, 4.73, 4.83, 4.84), 6.4),
    "bengali": Band((0.63, 0.63, 0.64, 0.67, 0.69, 0.7, 0.71, 0.72), 1.5, 0.44, (3.9, 3.9, 4.26, 4.47, 4.61, 4.62, 4.74, 4.8), 6.3),
    "tamil": Band((0.67, 0.67, 0.68, 0.68, 0.7, 0.73, 0.75, 0.75), 1.4, 0.4, (4, 4, 4.13, 4.34, 4.43, 4.51, 4.59, 4.65), 6.5),
    "georgian": Band((0.77, 0.77, 0.81, 0.82, 0.82, 0.83, 0.84, 0.85), 1.5, 0.13, (3.79, 3.79, 3.9, 4.12, 4.26, 4.33, 4.4, 4.5), 6),
    "thai": Band((0.89, 0.89, 0.9, 0.9, 0.91, 0.92, 0.93, 0.95), 1.9, 0.05, (4.46, 4.47, 4.77, 4.98, 5.11, 5.24, 5.35, 5.43), 6.9),
    "han": Band((0.49, 0.49, 0.53, 0.53, 0.58, 0.59, 0.6, 0.61), 2.3, 0.6, (3.96, 3.96, 4.55, 4.89, 5.4, 5.93, 6.19, 6.32), 9.7),
    "hangul": Band((0.56, 0.56, 0.62, 0.66, 0.68, 0.69, 0.71, 0.73), 1.8, 0.4, (4.33, 4.58, 5.09, 5.6, 6.21, 6.48, 6.71, 6.86), 8.4),
    "other": Band((0.3,) * LENGTHS, 8.0, 0.95, (3.0,) * LENGTHS, 16.0),
}

#: Regular expressions of the letters of each script in BANDS.
SCRIPTS = {k: rf"\p{{Is{k.title()}}}" for k in BANDS if k not in ("en", "de", "fr", "es", "other")}
SCRIPTS["han"] += r"\p{IsHiragana}\p{IsKatakana}"


class TextMeasures:
    """Measures batches of texts; one instance serves one task."""

    def __init__(self, vocab: str = VOCAB):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(vocab))
        size = self.model.get_piece_size()
        self.is_byte = np.fromiter(map(self.model.is_byte, range(size)), bool, size)
        self.memo: dict[bytes, np.ndarray] = {}

    def _tokens(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of different words, each encoded on its own."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = words
        ids = self.model.encode([w.decode() for w in new], num_threads=1)
        self.memo.update(zip(new, (np.array(x, np.int64) for x in ids), strict=True))
        return [self.memo[w] for w in words]

    def measure(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        n = len(texts)
        words = [t.split() for t in texts]
        counts = np.fromiter(map(len, words), np.int64, n)
        index: dict[bytes, int] = {}
        flat = np.fromiter(
            (index.setdefault(w, len(index)) for ws in words for w in ws), np.int64, int(counts.sum())
        )
        different = list(index)
        doc = np.repeat(np.arange(n), counts)
        chars = np.fromiter((len(w.decode()) for w in different), np.int64, len(different))
        out = {
            "n_words": counts,
            "word_chars": np.bincount(doc, chars[flat], n).astype(np.int64),
            "n_symbols": np.fromiter((len(t) - len(t.translate(None, SYMBOLS)) for t in texts), np.int64, n),
            "n_dup_lines": np.fromiter(map(duplicate_lines, texts), np.int64, n),
            "n_repeat_words": repeated_words(flat, doc, n),
        }
        tokens = self._tokens(different)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        pool = np.concatenate([*tokens, np.zeros(0, np.int64)])
        first = np.cumsum(lengths) - lengths
        each = lengths[flat]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[flat], each)
        ids, token_doc = pool[at], np.repeat(doc, each)
        total = np.bincount(token_doc, minlength=n)
        pair, times = np.unique(token_doc << 32 | ids, return_counts=True)
        share = times / np.maximum(total[pair >> 32], 1)
        out["n_tokens"] = total.astype(np.int64)
        out["n_byte_tokens"] = np.bincount(token_doc, self.is_byte[ids], n).astype(np.int64)
        out["token_entropy"] = np.bincount(pair >> 32, -share * np.log2(share), n) + 0.0
        return out


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeated_words(words: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document, words inside windows that its text holds twice or more.

    Windows get a 64-bit mix of their word numbers and document; equal mixes are
    compared word by word, so a collision cannot count.
    """
    w = WINDOW
    if len(words) < w:
        return np.zeros(n, np.int64)
    k = len(words) - w + 1
    mix = doc[:k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(w):
        mix = (mix ^ words[i : i + k].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        mix ^= mix >> np.uint64(29)
    starts = np.flatnonzero(doc[:k] == doc[w - 1 :])
    if not len(starts):
        return np.zeros(n, np.int64)
    order = starts[np.argsort(mix[starts], kind="stable")]
    same = mix[order[1:]] == mix[order[:-1]]
    for i in range(w):
        same &= words[order[1:] + i] == words[order[:-1] + i]
    same &= doc[order[1:]] == doc[order[:-1]]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    covered = np.zeros(len(words) + 1, np.int64)
    hit = order[twice]
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + w, -1)
    return np.bincount(doc, np.cumsum(covered)[:-1] > 0, n).astype(np.int64)


def measures(text: Column, vocab: str = VOCAB, batch_bytes: int = BATCH_BYTES) -> Column:
    """Struct column of METRICS; null and empty texts measure zero."""
    kinds = [(f.rsplit(" ", 1)[0].strip(), f.rsplit(" ", 1)[1]) for f in METRICS.split(",")]
    types = {"long": pa.int64(), "double": pa.float64()}

    @F.arrow_udf(f"struct<{', '.join(f'{a}: {b}' for a, b in kinds)}>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = TextMeasures(vocab)
        for batch in batches:
            texts = utf8(batch)
            parts = [own.measure(texts[i:j]) for i, j in by_bytes(texts, batch_bytes)]
            columns = [
                pa.array(np.concatenate([p[a] for p in parts]) if parts else [], types[b]) for a, b in kinds
            ]
            yield pa.StructArray.from_arrays(columns, [a for a, _ in kinds])

    return measured(text)


def band_of(lang: Column, text: Column) -> Column:
    """Key of BANDS: the language if listed, else the script of most letters."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    named = [k for k in BANDS if k not in SCRIPTS and k != "other"]
    out = F.when(lang.isin(named), lang)
    for k, pattern in SCRIPTS.items():
        out = out.when(2 * F.length(F.regexp_replace(letters, f"[^{pattern}]", "")) >= F.length(letters), k)
    return out.otherwise("other")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", vocab: str = VOCAB) -> DataFrame:
    """Adds METRICS, band, chars_per_token, byte_share, base_failed and kept to docs.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows.
    kept: not base_failed, and inside the band, whose lower ends are wider for short
    texts (SHORT). A null text counts as empty and fails the base; a null or unknown
    language takes the band of its script; repeated rows are judged alike; columns of
    docs with one of the new names are replaced.
    """
    text_col = F.coalesce(F.col(text), F.lit(""))
    names = [f.strip().rsplit(" ", 1)[0] for f in METRICS.split(",")]
    out = docs.withColumn("__m", measures(F.col(text), vocab)).withColumns(
        {n: F.col(f"__m.{n}") for n in names} | {"band": band_of(F.col(lang), text_col)}
    )
    out = out.drop("__m").withColumns(
        {
            "chars_per_token": F.try_divide("word_chars", "n_tokens"),
            "byte_share": F.try_divide("n_byte_tokens", "n_tokens"),
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        }
    )
    factor, less = F.lit(1.0), F.lit(0.0)
    for tokens, f, bits in reversed(SHORT):
        factor = F.when(F.col("n_tokens") < tokens, f).otherwise(factor)
        less = F.when(F.col("n_tokens") < tokens, bits).otherwise(less)
    place = F.least(F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))) - LEAST_BITS + 1, F.lit(LENGTHS))
    at = F.greatest(place, F.lit(1)).cast("int")
    # One constant table, so that the generated code does not grow with the bands.
    table = F.from_json(F.lit(json.dumps({k: asdict(b) for k, b in BANDS.items()})), f"map<string, struct<{BAND}>>")
    out = out.withColumn("__b", F.element_at(table, F.col("band")))
    inside = (
        F.col("chars_per_token").between(F.element_at("__b.min_chars", at) * factor, F.col("__b.max_chars"))
        & (F.col("n_byte_tokens") <= FREE_BYTES + F.col("__b.max_byte_share") * F.col("n_tokens"))
        & F.col("token_entropy").between(F.element_at("__b.min_entropy", at) - less, F.col("__b.max_entropy"))
    )
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("__b")
