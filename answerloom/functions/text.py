"""Text cleaning and scalar string functions: JVM-side Column expressions, but for Unicode forms and tone marks.

A cleaning function is a chain of (pattern, replacement) steps. The patterns are
written so that Java and RE2 read them alike; DOT makes Java's dot stop at \\n only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Steps = Sequence[tuple[str, str]]

#: White space as Python's str.isspace has it.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
DOT = "(?d)"

# The accented alphabet and its plain letters, place by place.
ACCENTED = "ÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝàáâãèéêìíòóôõùúýĂăĐđĨĩŨũƠơƯưẠạẢảẤấẦầẨẩẪẫẬậẮắẰằẲẳẴẵẶặẸẹẺẻẼẽẾếỀềỂểỄễỆệỈỉỊịỌọỎỏỐốỒồỔổỖỗỘộỚớỜờỞởỠỡỢợỤụỦủỨứỪừỬửỮữỰựỲỳÝýỴỵỶỷỸỹ"
PLAIN = "AAAAEEEIIOOOOUUYaaaaeeeiioooouuyAaDdIiUuOoUuAaAaAaAaAaAaAaAaAaAaAaAaEeEeEeEeEeEeEeEeIiIiOoOoOoOoOoOoOoOoOoOoOoOoUuUuUuUuUuUuUuYyYyYyYyYy"
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
QUESTION_WORDS = ("Who", "Why", "What", "Which", "When", "How", "Where")

TAGS = ("<.+?>", "")
HEADINGS = ("==.+==", "")
PREPROCESS: Steps = (
    ("BULLET::::-", ""), TAGS, HEADINGS,
    (r"[,;:?()\[\]{}<>|'\x22=\-–—…/+!*－_]", " "),
    (r"\.+", "."), (rf"\.{WS}+", ". "), (rf"{WS}*\n", ". "), (rf"{WS}+", " "),
)
PASSAGE_CLEAN: Steps = ((r"BULLET::::[\-\d]+", ""), TAGS, HEADINGS)
LOADER_CLEAN: Steps = (("BULLET::::-", ""), TAGS, HEADINGS)
DOC_CLEAN: Steps = ((rf"BULLET{WS}*::::{WS}*", ""), (r"[\n\r]", " "))
NORM_TEXT: Steps = ((rf"[^a-zA-Z0-9().{ACCENTED} ]", ""),)
NORM_TEXT_PLAIN: Steps = ((rf"[^a-zA-Z0-9{ACCENTED} ]", ""),)
NORMALIZER: Steps = ((r"\([^)]*\)", ""), *NORM_TEXT, (rf"{WS}+", " "))
ANSWER_CLEANUP: Steps = ((r"[,.();:\x22]", ""),)
NORMALIZE_ANSWER: Steps = ((ASCII_PUNCTUATION, ""), (r"\b(a|an|the)\b", " "), (rf"{WS}+", " "))
VOTE_NORM: Steps = ((rf"[^a-z0-9{ACCENTED} ]", ""), ("bullet", ""))
CJK_PUNCTUATION: Steps = ((r"[\x{3000}-\x{303F}\x{FF00}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]", ""),)
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\x{2028}\x{2029}]"
SENTENCE_END = rf"\.{WS}+"


def apply_steps(c: Column, steps: Steps) -> Column:
    for pattern, replacement in steps:
        c = F.regexp_replace(c, F.lit(DOT + pattern), F.lit(replacement))
    return c


def strip(c: Column) -> Column:
    """White space off both ends, as Python's strip."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


#: Letters whose upper case is several letters, with the one letter that is theirs, if any.
_TITLED = [chr(i) for i in range(0x1F80, 0x2000) if len(chr(i).upper()) > len(chr(i).title()) == 1]
SEVERAL, SINGLE = "ß" + "".join(_TITLED), "ẞ" + "".join(x.title() for x in _TITLED)


def one_capital(c: Column) -> Column:
    """Upper case of one letter as one letter; one that has only several in upper case stays."""
    return F.when(F.length(F.upper(c)) > 1, F.translate(c, SEVERAL, SINGLE)).otherwise(F.upper(c))


def words(c: Column) -> Column:
    """White-space tokens, none empty."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def preprocess_text(c: Column) -> Column:
    return apply_steps(c, PREPROCESS)


def to_passages(c: Column) -> Column:
    """Array of sentences, each closed by a full stop of its own."""
    parts = F.split(apply_steps(c, PASSAGE_CLEAN), SENTENCE_END)
    clean = F.transform(parts, lambda p: strip(F.regexp_replace(p, rf"\n{WS}*", ". ")))
    return F.transform(F.filter(clean, lambda p: p != ""), lambda p: F.concat(p, F.lit(".")))


def lines(c: Column) -> Column:
    """Array of stripped lines, none empty."""
    return F.filter(F.transform(F.split(c, LINE_END), strip), lambda x: x != "")


def loader_clean(c: Column) -> Column:
    return apply_steps(c, LOADER_CLEAN)


def doc_clean(c: Column) -> Column:
    return apply_steps(c, DOC_CLEAN)


def norm_text(c: Column, keep_marks: bool = True) -> Column:
    return apply_steps(c, NORM_TEXT if keep_marks else NORM_TEXT_PLAIN)


def normalizer(c: Column) -> Column:
    return apply_steps(c, NORMALIZER)


def remove_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


@F.pandas_udf(StringType())
def strip_accents(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Decomposes and drops combining marks; Spark has no Unicode normalisation."""
    for s in batches:
        yield s.map(
            lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if unicodedata.category(x) != "Mn"),
            na_action="ignore",
        )


@F.pandas_udf(StringType())
def compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition, for queries typed with loose diacritics."""
    for s in batches:
        yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Toneless vowels, and the same with each tone, letter by letter.
VOWELS = "aăâeêioôơuưyAĂÂEÊIOÔƠUƯY"
TONES = "\u0300\u0301\u0303\u0309\u0323"
TONED = tuple("".join(unicodedata.normalize("NFC", v + t) for v in VOWELS) for t in TONES)
#: Vowels that carry the tone wherever they stand in a syllable.
MARKED = "ăâêôơưĂÂÊÔƠƯ"
_V = f"[{VOWELS}{''.join(TONED)}]"
_C = f"[^{VOWELS}{''.join(TONED)}]*"
#: Onset, vowels and coda of a syllable; the vowels of "qu" and "gi" belong to the onset.
SYLLABLES = (rf"(?i)^(qu|gi)({_V}+)({_C})$", rf"^({_C})({_V}+)({_C})$")


#: The same for Python, whose (?i) takes in more letters than the engine's.
_SYLLABLES = tuple(re.compile(p.replace("(?i)", "").replace("qu|gi", "[qQ][uU]|[gG][iI]")) for p in SYLLABLES)
_BARE = str.maketrans("".join(TONED), VOWELS * len(TONES))
_TONE = {ord(x): k for k, toned in enumerate(TONED) for x in toned}
_RUNS = re.compile(r"\w+|\W+")
#: Words that a task remembers with their tones placed.
MOST_WORDS = 100_000


def _placed(word: str) -> str:
    """A run of letters with its tone mark moved, if it is a syllable with one."""
    m = next(filter(None, (p.search(word) for p in _SYLLABLES)), None)
    tones = [_TONE[ord(x)] for x in m[2] if ord(x) in _TONE] if m else []
    if len(tones) != 1:
        return word
    onset, vowels, coda = m.groups()
    bare = vowels.translate(_BARE)
    marked = [i for i, x in enumerate(bare) if x in MARKED]
    at = marked[-1] if marked else 0 if len(bare) == 1 or (len(bare) == 2 and not coda) else 1
    return onset + bare[:at] + TONED[tones[0]][VOWELS.index(bare[at])] + bare[at + 1 :] + coda


class _Placed(dict):
    """Runs of word characters, or of others, with tones placed, each worked out once; \\w holds all letters and more."""

    def __missing__(self, run: str) -> str:
        if len(self) >= MOST_WORDS:
            self.clear()
        out = run if run.isascii() else "".join(_placed("".join(g)) if letters else "".join(g) for letters, g in groupby(run, str.isalpha))
        self[run] = out
        return out


@F.pandas_udf(StringType())
def place_tones(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Tone marks of Vietnamese syllables moved to the vowel that carries them: hoá becomes hóa.

    That is the last vowel with a hat, horn or breve; without one, of two vowels the first,
    or the second before a consonant, and of three the second. Words that are no syllable
    with one tone stay as they are. Composed letters are expected. A word that returns is
    looked up.
    """
    placed = _Placed()
    for s in batches:
        yield s.map(lambda t: t if t.isascii() else "".join(map(placed.__getitem__, _RUNS.findall(t))), na_action="ignore")


def query_normalize(c: Column) -> Column:
    """A query as titles are spelled: composed letters, tone marks in their places."""
    return place_tones(compose(c))


def normalize_answer(c: Column) -> Column:
    return strip(apply_steps(F.lower(c), NORMALIZE_ANSWER))


def normalize_text(c: Column) -> Column:
    return apply_steps(F.lower(c), ((ASCII_PUNCTUATION, ""),))


def normalize_chinese_text(c: Column) -> Column:
    return apply_steps(c, CJK_PUNCTUATION)


def dedupe_tokens(c: Column) -> Column:
    """Of equal tokens the last stays; tokens are split at single spaces."""
    tokens = F.split(c, " ")
    kept = F.filter(tokens, lambda w, i: ~F.array_contains(F.slice(tokens, i + 2, F.size(tokens)), w))
    return F.array_join(kept, " ")


def answer_cleanup(c: Column) -> Column:
    return apply_steps(c, ANSWER_CLEANUP)


def question_fixup(c: Column) -> Column:
    return F.when(c.endswith("?") | (c == ""), c).otherwise(F.concat(c, F.lit(" ?")))


def split_title(c: Column) -> tuple[Column, Column]:
    """(before the first full stop, the rest stripped)."""
    head = F.substring_index(c, ".", 1)
    return head, strip(F.substr(c, F.length(head) + 2))


def vote_norm(c: Column) -> Column:
    return apply_steps(F.lower(c), VOTE_NORM)


def title_to_link(title: Column) -> Column:
    return F.concat(F.lit("wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def page_title(doc: Column) -> Column:
    """A section's page: its id without the last _ part."""
    return F.regexp_replace(doc, r"(?s)\A(.*)_[^_]*\z", "$1")


def augment_context(title: Column, context: Column, category: Column) -> Column:
    return F.when(category == "wiki", F.concat(page_title(title), F.lit(" . "), context)).otherwise(context)


def question_type(c: Column) -> Column:
    """First token that starts with a question word, which it names; else others."""
    kinds = F.array(*[F.lit(k) for k in QUESTION_WORDS])
    found = F.flatten(
        F.transform(F.split(c, " "), lambda t: F.filter(kinds, lambda k: F.startswith(F.lower(t), F.lower(k))))
    )
    return F.coalesce(F.get(found, 0), F.lit("others"))


def json_contents(raw: Column) -> Column:
    """A hit's text: its JSON contents, or else the raw string."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.contents", "string"), raw)
