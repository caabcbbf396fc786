"""Token counts: batches balanced by bytes, long texts split where no token can cross.

A piece vocabulary writes a space as ``▁``. If no piece holds ``▁`` after another
character, no token spans the gap between a character and the space behind it, so a
text may be cut there. The space that is cut away returns as the prefix that the
library puts before every input. Segments that a batch repeats are encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import by_bytes, utf8, vocabulary

VOCAB = "piece_bpe_32k.model"
#: Bytes of text whose segments are encoded together.
BATCH_BYTES = 2 << 20
#: Context length beyond which a document is flagged.
LIMIT = 4096
_CUT = re.compile("(?<=[^ ▁]) ")


class PieceCounter:
    """Exact token counts of one piece vocabulary."""

    def __init__(self, vocab: str = VOCAB):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(vocab))
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        #: Whether a cut before a space is safe with this vocabulary and normaliser.
        self.safe = (
            not any("▁" in p.lstrip("▁") for p in pieces)
            and self._pieces("a") == ["▁a"]
            and "".join(self._pieces("a  b ")) == "▁a▁▁b▁"
        )

    def _pieces(self, text: str) -> list[str]:
        return self.model.encode(text, out_type=str)

    def segments(self, text: str) -> list[str]:
        """Cuts at every safe space; a last empty segment stands for a closing space."""
        return _CUT.split(text) if self.safe else [text]

    def lengths(self, texts: list[str]) -> list[int]:
        """Tokens of each text; only lengths leave this function."""
        split = [self.segments(t) if t else [] for t in texts]
        known = dict.fromkeys(s for ss in split for s in ss)
        todo = [s for s in known if s]
        known.update(zip(todo, map(len, self.model.encode(todo, num_threads=1)), strict=True))
        if "" in known:
            known[""] = 1  # the closing space, one ``▁``
        return [sum(map(known.__getitem__, ss)) for ss in split]


def token_count(text: Column, vocab: str = VOCAB, batch_bytes: int = BATCH_BYTES) -> Column:
    """Column of token counts; null and empty texts have none."""
    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PieceCounter(vocab)
        for batch in batches:
            texts = utf8(batch)
            n: list[int] = []
            for i, j in by_bytes(texts, batch_bytes):
                n += counter.lengths([t.decode() for t in texts[i:j]])
            yield pa.array(n, pa.int64())

    return counted(text)


def count_tokens(
    docs: DataFrame, text: str = "text", vocab: str = VOCAB, limit: int = LIMIT
) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit (n_tokens > limit) to docs, row by row.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows repeat; an empty
    table stays empty; columns of docs with one of the three names are replaced.
    """
    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "n_tokens": token_count(F.col(text), vocab),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
