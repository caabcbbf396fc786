"""Dates, quantities and their wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.functions.text import words

# Date patterns and the parts they carry. \w in Java needs (?U).
DATE_PATTERNS: tuple[tuple[str, str], ...] = (
    (r"\d{1,2}/\d{1,2}", "dd/mm"),
    (r"\d{1,2}/\d{4}", "mm/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "dd/mm/yyyy"),
    (r"ngày \d{1,2}", "dd"),
    (r"ngày \d{1,2}/\d{1,2} âm lịch", "dd/mm"),
    (r"ngày \d{1,2}/\d{1,2}/\d{4}", "dd/mm/yyyy"),
    (r"ngày \d{1,2} tháng \d{1,2} năm \d{4}", "dd/mm/yyyy"),
    (r"ngày \d{1,2} tháng \d{1,2} âm lịch", "dd/mm"),
    (r"ngày \d{1,2} tháng \d{1,2} , \d{4}", "dd/mm/yyyy"),
    (r"ngày \d{1,2} tháng \d{1,2}", "dd/mm"),
    (r"ngày \d{1,2} tháng \w+", "dd/MM"),
    (r"ngày \d{1,2} tháng \w+ âm lịch", "dd/MM"),
    (r"ngày \d{1,2}/\d{1,2}", "dd/mm"),
    (r"ngày \d{1,2} tháng \d{1,2} năm \w+ \( tức \d{1,2} tháng \d{1,2} năm \d{4}", "dd/mm/yyyy"),
    (r"ngày \d{1,2}.\d{1,2}.\d{4}", "dd/mm/yyyy"),
    (r"ngày \d{1,2} tháng \d{1,2}, \d{4}", "dd/mm/yyyy"),
    (r"ngày mùng \d{1,2}/\d{1,2}", "dd/mm"),
    (r"tháng \d{1,2}-\d{4}", "mm/yyyy"),
    (r"tháng \d{1,2}", "mm"),
    (r"tháng \d{1,2}/\d{4}", "mm/yyyy"),
    (r"tháng \d{1,2} âm lịch", "mm"),
    (r"tháng \d{1,2} năm \d{4}", "mm/yyyy"),
    (r"tháng thứ \d{1,2} của âm lịch \w+", "mm"),
    (r"năm \d{4}", "yyyy"),
    (r"giữa năm \d{4}", "yyyy"),
    (r"\d{4}", "yyyy"),
    (r"\d{3}", "yyyy"),
    (r"\d{1,2} tháng \d{1,2} năm \d{4}", "dd/mm/yyyy"),
    (r"\d{2}/\d{4}", "mm/yyyy"),
    (r"\d{1,2}:\d{1,2} utc ngày \d{1,2}/\d{1,2}/\d{4}", "dd/mm/yyyy"),
)
# Spoken months, the first contained one counts.
MONTHS = (
    ("một", 1), ("chạp", 12), ("giêng hai", 2), ("ba", 3), ("tư", 4), ("năm", 5), ("sáu", 6),
    ("bảy", 7), ("tám", 8), ("chín", 9), ("mười", 10), ("tý", 11),
)
# Number words of 1 to 10, and 4 inside a number.
UNITS = ("một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín", "mười")
INNER_FOUR = "tư"
LARGEST = 9_999
#: Marks that quantities drop, and spellings brought to one.
QUANTITY_DROP = r"[,.()\[\];:]"
QUANTITY_WORDS = (("lẻ", " "), ("ngàn", "nghìn"), ("lăm", "năm"), ("/", " "))

DATE = "struct<year: int, month: int, date: int>"


def get_nums(c: Column) -> Column:
    """Whole-number tokens of a text."""
    parts = F.split(F.translate(c, "/,.:-()\"'", " " * 9), " +")
    return F.transform(F.filter(parts, lambda w: w.rlike(r"\A[0-9]{1,9}\z")), lambda w: w.cast("int"))


#: Numbers that each kind of date pattern needs, and the places of year, month and date among them.
PLACES: dict[str, tuple[int, int | None, int | None, int | None]] = {
    "dd/mm/yyyy": (3, 2, 1, 0), "dd/mm": (2, None, 1, 0), "mm/yyyy": (2, 1, 0, None), "mm": (1, None, 0, None),
    "yyyy": (1, 0, None, None), "dd/MM": (1, None, None, 0), "dd": (0, None, None, None),
}


def extract_datetime(c: Column, compat: bool = False) -> Column:
    """Latest (year, month, date) that any pattern finds; parts not found are 0.

    compat reads a pattern's numbers from its start, which the two patterns with
    leading numbers of their own get wrong; the default reads them from its end. A
    match with too few numbers is passed over. Every pattern is matched once; what its
    match holds is read in one function over all matches.
    """
    text = F.lower(c)
    found = []
    for pattern, kind in DATE_PATTERNS:
        need, *places = PLACES[kind]
        at = [F.lit(p).cast("int").alias(n) for n, p in zip("ymd", places, strict=True)]
        match = F.regexp_extract(text, f"(?Ud)({pattern})", 1).alias("match")
        found.append(F.struct(match, F.lit(need).alias("need"), F.lit(kind == "dd/MM").alias("spoken"), *at))
    matched = F.filter(F.array(*found), lambda x: x["match"] != "")
    counted = F.transform(matched, lambda x: F.struct(x.alias("x"), get_nums(x["match"]).alias("nums")))

    def parts(r: Column) -> Column:
        x, nums = r["x"], r["nums"]
        first = F.lit(0) if compat else F.size(nums) - x["need"]
        part = lambda n: F.coalesce(F.when(x[n].isNotNull(), F.get(nums, first + x[n])), F.lit(0))
        month = F.lit(0)
        for word, value in reversed(MONTHS):
            month = F.when(x["match"].contains(word), value).otherwise(month)
        m = F.when(x["spoken"], month).otherwise(part("m"))
        return F.struct(part("y").cast("int").alias("year"), m.cast("int").alias("month"), part("d").cast("int").alias("date"))

    enough = F.filter(counted, lambda r: F.size(r["nums"]) >= r["x"]["need"])
    none = F.struct(*[F.lit(0).alias(p) for p in ("year", "month", "date")])
    return F.coalesce(F.array_max(F.transform(enough, parts)), none)


def format_datetime(d: Column) -> Column:
    """ngày D tháng M năm Y without the parts that are 0; null if all are."""
    part = lambda word, n: F.when(n > 0, F.concat(F.lit(word + " "), n.cast("string")))
    text = F.concat_ws(" ", part("ngày", d["date"]), part("tháng", d["month"]), part("năm", d["year"]))
    return F.when(text != "", text)


def spelled(n: Column) -> Column:
    """Vietnamese words of 1 to LARGEST; null beyond."""
    unit = lambda k: F.element_at(F.array(*map(F.lit, UNITS)), k.cast("int"))
    inner = lambda k: F.when(k == 4, INNER_FOUR).otherwise(unit(F.greatest(k, F.lit(1))))

    def below_hundred(k: Column) -> Column:
        tens, ones = (k / 10).cast("int"), k % 10
        return (
            F.when(k <= 10, unit(F.greatest(k, F.lit(1))))
            .when(k < 20, F.concat(F.lit("mười "), inner(ones)))
            .when(ones == 0, F.concat(inner(tens), F.lit(" mươi")))
            .otherwise(F.concat(inner(tens), F.lit(" mươi "), inner(ones)))
        )

    def below_thousand(k: Column) -> Column:
        hundreds, rest = (k / 100).cast("int"), k % 100
        return (
            F.when(k < 100, below_hundred(k))
            .when(rest == 0, F.concat(inner(hundreds), F.lit(" trăm")))
            .otherwise(F.concat(inner(hundreds), F.lit(" trăm "), below_hundred(rest)))
        )

    thousands, rest = (n / 1000).cast("int"), n % 1000
    words = (
        F.when(n < 1000, below_thousand(n))
        .when(rest == 0, F.concat(inner(thousands), F.lit(" nghìn")))
        .otherwise(F.concat(unit(F.greatest(thousands, F.lit(1))), F.lit(" nghìn "), below_thousand(rest)))
    )
    return F.when(n.between(1, LARGEST), words)


def number_lexicon(spark: SparkSession) -> DataFrame:
    """(n, words) of every number the lexicon spells; LARGEST rows, safe to broadcast."""
    return spark.range(1, LARGEST + 1).select(F.col("id").alias("n"), spelled(F.col("id")).alias("words"))


def _number() -> str:
    """Regular expression of the words of 1 to LARGEST, longest first, from its grammar."""
    unit, inner = "(?:" + "|".join(UNITS[:9]) + ")", "(?:" + "|".join((*UNITS[:3], INNER_FOUR, *UNITS[4:9])) + ")"
    # Tens are two to nine, hundreds and thousands one to nine.
    tens = "(?:" + "|".join((*UNITS[1:3], INNER_FOUR, *UNITS[4:9])) + ")"
    hundred = f"(?:{tens} mươi(?: {inner})?|mười(?: {inner})?|{unit})"
    thousand = f"(?:{inner} trăm(?: {hundred})?|{hundred})"
    return f"(?:{unit} nghìn {thousand}|{inner} nghìn|{thousand})"


NUMBER = _number()
#: Value of each number word by itself.
WORD_VALUES = {w: k for k, w in enumerate(UNITS, 1)} | {INNER_FOUR: 4, "mươi": 10, "trăm": 100, "nghìn": 1000}


def number_value(c: Column) -> Column:
    """Value of the words of one number: a sum of units times what follows them."""
    word = F.create_map(*[x for w, v in WORD_VALUES.items() for x in (F.lit(w), F.lit(v))])

    def step(s: Column, w: Column) -> Column:
        v = word[w]
        scale = F.when(w.isin("mươi", "trăm", "nghìn"), v)
        added = F.when(scale.isNotNull(), s["unit"] * scale).when(w == UNITS[9], v).otherwise(0)
        unit = F.when(scale.isNotNull() | (w == UNITS[9]), 0).otherwise(v)
        return F.struct((s["total"] + added).alias("total"), unit.alias("unit"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("unit"))
    return F.aggregate(F.split(c, " "), start, step, lambda s: s["total"] + s["unit"])


def quantity_words(c: Column, compat: bool = False) -> Column:
    """Tokens of a text in which quantities are sought: thousands written out, spellings brought to one."""
    low = F.lower(c)
    out = F.replace(low, F.lit("k"), F.lit("000")) if compat else F.regexp_replace(low, r"(?U)(\d+)k\b", "$1000")
    for a, b in QUANTITY_WORDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return words(F.regexp_replace(out, QUANTITY_DROP, ""))


def _digits(tokens: Column) -> Column:
    return F.regexp_replace(F.array_join(tokens, " "), r"\P{Nd}", "")


def extract_quantity(c: Column) -> Column:
    """All digits of a text once its number words are digits; '' without any, null at null.

    From left to right the longest run of words that spells a number of 1 to LARGEST is
    one: a regular expression of the numbers' grammar cuts the text into such runs and
    single words.
    """
    pieces = F.regexp_extract_all(F.array_join(quantity_words(c), " "), F.lit(f"{NUMBER}(?= |$)|[^ ]+"), 0)
    spoken = lambda p: F.when(p.rlike(f"^{NUMBER}$"), number_value(p).cast("string")).otherwise(p)
    return F.when(c.isNotNull(), _digits(F.transform(pieces, spoken)))


def inverted_numbers(spark: SparkSession) -> DataFrame:
    """(word, n, size, words): each number of the lexicon under each of its different words."""
    split = number_lexicon(spark).select("n", F.split("words", " ").alias("words"))
    different = F.array_distinct("words")
    return split.select(F.explode(different).alias("word"), "n", F.size(different).alias("size"), "words")


def compat_quantity(rows: DataFrame, text: str = "text", out: str = "quantity") -> DataFrame:
    """rows with `out`: all digits once every number whose words occur, anywhere and in any
    order, is put in place of them, from the largest number down.

    As many words as the number has are replaced from the place of its first word on.
    Which numbers a text may hold hangs on its set of number words alone: sets are at most
    2 to the number of number words, each is looked up once in an inverted table, and the
    replacements are a fold over what it holds. Null at null.
    """
    spark = rows.sparkSession
    known = F.lit(sorted(WORD_VALUES))
    staged = rows.select("*", F.explode_outer(F.array(quantity_words(F.col(text), compat=True))).alias("__words"))
    staged = staged.withColumn("__set", F.array_sort(F.array_intersect("__words", known)))
    sets = staged.select("__set").distinct()
    held = sets.select("__set", F.explode("__set").alias("word")).join(F.broadcast(inverted_numbers(spark)), "word")
    held = held.groupBy("__set", "n").agg(F.count("*").alias("met"), F.first("size").alias("size"), F.first("words").alias("words"))
    # At most LARGEST numbers a set, largest first.
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("n", "words"))))
    held = held.filter("met = size").groupBy("__set").agg(ranked.alias("__numbers"))

    def put(tokens: Column, number: Column) -> Column:
        every = F.forall(number["words"], lambda w: F.array_contains(tokens, w))
        at = F.array_position(tokens, F.get(number["words"], 0)).cast("int")
        rest = F.slice(tokens, at + F.size(number["words"]), F.size(tokens))
        return F.when(every, F.concat(F.slice(tokens, F.lit(1), at - 1), F.array(number["n"].cast("string")), rest)).otherwise(tokens)

    met = staged.join(held, "__set", "left")
    done = F.aggregate(F.coalesce("__numbers", F.array().cast("array<struct<n: bigint, words: array<string>>>")), F.col("__words"), put)
    return met.withColumn(out, _digits(done)).drop("__words", "__set", "__numbers")
