"""Corpus construction: links, lead, section tree, section documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerloom.functions.text import WS, doc_clean, lines, strip, words

LINK = r"\[\[([^\]]+)\]\]"
PIPED = r"\[\[([^\]|]+)\|([^\]]*)\]\]"
BARE = r"\[\[([^\]|]+)\]\]"
# Sections that are left out (with their stop), and known namespaces.
IGNORED_SECTIONS = ("Xem thêm.", "Tham khảo.", "Liên kết ngoài.", "Ngoài lề.")
NAMESPACES = ("w", "wiktionary", "wikt")
DISAMBIGUATION = ("(định hướng)", "(Định hướng)")
LINK_PREFIX = "wiki/"
HIGHLIGHT = r"(?s)&lt;syntaxhighlight .*?&gt;(.*?)&lt;/syntaxhighlight&gt;|<syntaxhighlight[^>]*>(.*?)</syntaxhighlight>"


def link_edges(docs: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """(label, link, source_title, place) of piped links that point into the wiki."""
    found = F.regexp_extract_all(text, F.lit(LINK), 1)
    pair = F.col("inner")
    at = F.instr(pair, "|")
    return (
        docs.select(F.col(title).alias("source_title"), F.posexplode(found).alias("place", "inner"))
        .filter((at > 1) & pair.startswith(LINK_PREFIX))
        .select(
            strip(F.substr(pair, at + 1)).alias("label"),
            F.rtrim(F.substr(pair, F.lit(1), at - 1)).alias("link"),
            "source_title",
            F.col("place").cast("long").alias("place"),
        )
    )


def plain_links(text: Column) -> Column:
    """Text with links replaced by their labels, a bare link by itself."""
    return F.regexp_replace(F.regexp_replace(text, PIPED, "$2"), BARE, "$1")


POSITIONS = "array<struct<link: string, start: bigint, end: bigint>>"


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def link_positions(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, plain, links(link, start, end)): links as label, with their words' places, link by link.

    A fold whose state is the text as rewritten so far. Positions count single spaces
    before the label in it; every occurrence of a link's body is replaced at once, and a
    link that is no longer there when its turn comes has position -1. A null text is empty.
    """

    def rewrite(state: Column, body: Column) -> Column:
        link = F.when(body.contains("|"), F.substring_index(body, "|", 1)).otherwise(body)
        label = F.when(body.contains("|"), F.substr(body, F.length(link) + 2)).otherwise(body)
        whole = F.concat(F.lit("[["), body, F.lit("]]"))
        at = F.position(whole, state["plain"])
        start = F.when(at > 0, _spaces(F.substr(state["plain"], F.lit(1), at - 1))).otherwise(-1)
        end = F.when(at > 0, start + _spaces(label)).otherwise(-1)
        found = F.struct(link.alias("link"), start.alias("start"), end.alias("end"))
        plain = F.replace(F.replace(state["plain"], whole, label), body, label)
        return F.struct(plain.alias("plain"), F.array_append(state["links"], found).cast(POSITIONS).alias("links"))

    t = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(t.alias("plain"), F.array().cast(POSITIONS).alias("links"))
    done = F.aggregate(F.regexp_extract_all(t, F.lit(LINK), 1), start, rewrite)
    rows = docs.select(F.col(id).alias("id"), F.explode_outer(F.array(done)).alias("x"))
    return rows.select("id", "x.plain", "x.links")


#: Pairs of delimiters that nest in pages.
DELIMITERS = (("[[", "]]"), ("{{", "}}"), ("{|", "|}"))
SPANS = "array<struct<start: bigint, end: bigint, title: bigint, label: bigint>>"


def _spans(text: Column, open: str, close: str) -> Column:
    """Outermost balanced stretches between delimiters: their start and end, and the place of
    the first pipe inside and of the one that the label stands behind, -1 without any.

    Delimiters, pipes and what is between them are events in order, folded with a running
    depth. The label's pipe is the first one, or the last of those between it, or a nested
    stretch, and the next nested stretch.
    """
    if any(close[k:] and open.startswith(close[k:]) for k in range(1, len(close))):
        raise ValueError("an opening delimiter must not begin inside a closing one")
    a, b = ("".join(f"\\x{ord(c):02x}" for c in d) for d in (open, close))
    firsts = "".join(sorted({a[:4], b[:4], r"\x7c"}))
    events = F.regexp_extract_all(text, F.lit(f"(?s){a}|{b}|[^{firsts}]+|."), 0)

    def step(s: Column, event: Column) -> Column:
        opens, closes, pipe = event == open, (event == close) & (s["depth"] > 0), event == "|"
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        begins, ends = opens & (s["depth"] == 0), closes & (s["depth"] == 1)
        end = s["at"] + F.length(event)
        first = pipe & (s["depth"] > 0) & (s["title"] < 0)
        none = F.lit(-1).cast("long")
        label = F.when(begins, none).when(first, s["at"]).when(opens & (s["depth"] == 1) & (s["last"] >= 0), s["last"])
        last = F.when(opens | closes | first, none).when(pipe & (s["depth"] == 1) & (s["title"] >= 0), s["at"])
        span = F.struct(s["start"].alias("start"), end.alias("end"), s["title"].alias("title"), s["label"].alias("label"))
        return F.struct(
            end.alias("at"),
            depth.alias("depth"),
            F.when(begins, s["at"]).otherwise(s["start"]).alias("start"),
            F.when(begins, none).when(first, s["at"]).otherwise(s["title"]).alias("title"),
            label.otherwise(s["label"]).alias("label"),
            last.otherwise(s["last"]).alias("last"),
            F.when(ends, F.array_append(s["spans"], span)).otherwise(s["spans"]).cast(SPANS).alias("spans"),
        )

    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    start = F.struct(
        zero.alias("at"), F.lit(0).alias("depth"), zero.alias("start"), none.alias("title"), none.alias("label"),
        none.alias("last"), F.array().cast(SPANS).alias("spans"),
    )
    return F.aggregate(events, start, step, lambda s: s["spans"])


def balanced_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", pairs: Sequence[tuple[str, str]] = DELIMITERS) -> DataFrame:
    """(id, open, start, end): every outermost balanced stretch of each pair of delimiters.

    Null texts have none. A pair whose opening delimiter could begin inside its closing one raises.
    """
    def found(open: str, close: str) -> Column:
        named = F.transform(
            _spans(F.col(text), open, close), lambda s: F.struct(F.lit(open).alias("open"), s["start"].alias("start"), s["end"].alias("end"))
        )
        return F.coalesce(named, F.array().cast("array<struct<open: string, start: bigint, end: bigint>>"))

    return docs.select(F.col(id).alias("id"), F.inline(F.flatten(F.array(*[found(a, b) for a, b in pairs]))))


def rewrite_links(text: Column, capital: Callable[[Column], Column] = F.upper) -> Column:
    """Wiki links as [[wiki/Title|label]], the word that follows and nested links taken in; null stays null.

    The title is what stands before the first pipe, the label what stands behind the pipe
    that _spans finds; a link into an unknown namespace leaves the word behind it alone.
    """
    before = lambda i: F.greatest(F.lit(0).cast("long"), i)

    def rewritten(p: Column) -> Column:
        t = p["text"]
        part = lambda a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))
        trail = lambda s: F.regexp_extract(F.substr(t, (s["end"] + 1).cast("int")), r"^[\p{L}\p{N}_]*", 0)
        spans = F.transform(p["spans"], lambda s: F.struct(s.alias("s"), trail(s).alias("trail")))

        def piece(x: Column, done: Column) -> Column:
            s = x["s"]
            title = F.when(s["title"] < 0, part(s["start"] + 2, s["end"] - 2)).otherwise(
                F.regexp_replace(part(s["start"] + 2, before(s["title"])), rf"{WS}+\z", "")
            )
            label = F.when(s["title"] < 0, title).otherwise(strip(part(before(s["label"]) + 1, s["end"] - 2)))
            return F.concat(part(done, s["start"]), internal_link(title, label, capital), x["trail"])

        def step(state: Column, x: Column) -> Column:
            return F.struct(
                F.concat(state["out"], piece(x, state["done"])).alias("out"), (x["s"]["end"] + F.length(x["trail"])).alias("done")
            )

        start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))
        return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(t, (s["done"] + 1).cast("int"))))

    # Bound to names inside one-element arrays, so that text and spans are formed once.
    one = F.array(F.struct(text.alias("text"), _spans(text, "[[", "]]").alias("spans")))
    return F.when(text.isNotNull(), F.get(F.transform(one, rewritten), 0))


def dump_records(
    dump: DataFrame, titles: DataFrame | None = None, rewrite: bool = False, capital: Callable[[Column], Column] = F.upper
) -> DataFrame:
    """Records of a dump, of known titles alone if titles(title) are given.

    rewrite unwraps highlighted code and rewrites the links of each text.
    """
    out = dump
    if titles is not None:
        out = out.join(titles.select(strip(F.col("title")).alias("title")).distinct(), "title", "left_semi").select(*dump.columns)
    return out.withColumn("text", unwrap_highlight(rewrite_links(F.col("text"), capital))) if rewrite else out


def zip_by_place(left: DataFrame, right: DataFrame, ord: str = "ord") -> DataFrame:
    """Rows of both with equal places, as lists are zipped; those beyond the shorter are left out."""
    return left.join(right, ord)


def internal_link(title: Column, label: Column, capital: Callable[[Column], Column] = F.upper) -> Column:
    """[[wiki/Title|label]]: first letter upper-cased by capital, white space joined by single underscores.

    '' where the title is in an unknown namespace; a leading colon is no namespace, and stays.
    """
    space = F.substring_index(F.regexp_replace(title, "^:", ""), ":", 1)
    known = ~F.regexp_replace(title, "^:", "").rlike("^[^:]+:") | space.isin(*NAMESPACES)
    name = F.concat(capital(F.left(title, F.lit(1))), F.substr(title, F.lit(2)))
    name = F.array_join(words(name), "_")
    link = F.concat(F.lit("[[" + LINK_PREFIX), name, F.lit("|"), label, F.lit("]]"))
    return F.when(known, link).otherwise("")


def unwrap_highlight(text: Column) -> Column:
    return F.regexp_replace(text, HIGHLIGHT, "$1$2")


def lead(text: Column) -> Column:
    """Lines before the first heading, joined by \\n."""
    ls = lines(text)
    heads = F.filter(F.transform(ls, lambda x, i: F.when(x.startswith("="), i)), lambda i: i.isNotNull())
    first = F.coalesce(F.get(heads, 0), F.size(ls))
    return F.array_join(F.slice(ls, F.lit(1), first), "\n")


def section_lines(docs: DataFrame, id: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """Every line with the section and subsection it falls into.

    Levels and running numbers are windows over one document's lines, which are as
    many as the document has; documents are not brought together.
    """
    rows = docs.select(
        F.col(id).alias("id"), F.col(title).alias("title"), F.posexplode(lines(F.col(text))).alias("at", "line")
    )
    w = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    equals = F.length("line") - F.length(F.replace("line", F.lit("="), F.lit("")))
    head = F.col("line").startswith("=")
    rows = rows.withColumn("own_level", F.when(head, F.floor(equals / 2).cast("int")))
    rows = rows.withColumns(
        {
            "level": F.last("own_level", ignorenulls=True).over(w),
            "heading": F.when(head, strip(F.replace("line", F.lit("="), F.lit("")))),
            "section": F.sum(F.when(F.col("own_level") == 2, 1).otherwise(0)).over(w),
        }
    )
    return rows.withColumn(
        "subsection",
        F.sum(F.when(F.col("own_level") == 3, 1).otherwise(0)).over(
            Window.partitionBy("id", "section").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        ),
    )


def section_docs(docs: DataFrame, id: str = "doc_id", title: str = "title", text: str = "text") -> DataFrame:
    """(id, ordinal, section_id, contents): lead, sections, subsections of every page.

    A subsection before any section hangs under a section without a title. Lines at
    levels other than 2 and 3 are left out, as are the ignored sections with all
    below them. The lead is emitted even when it is empty.
    """
    ls = section_lines(docs, id, title, text)
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("at", "line")))), lambda x: F.concat(x["line"], F.lit(" "))),
        "",
    )
    leads = docs.select(
        F.col(id).alias("id"), F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("sub"),
        doc_clean(F.concat(lead(F.col(text)), F.lit("\n"))).alias("contents"),
    )
    leads = leads.withColumn("contents", F.when(F.col("contents") == " ", "").otherwise(F.col("contents")))
    heads = ls.filter("own_level = 2").select("id", "section", F.col("heading").alias("section_title"))
    body = ls.filter("level in (2, 3)").withColumn("sub", F.when(F.col("level") == 2, 0).otherwise(F.col("subsection")))
    parts = (
        body.groupBy("id", "title", "section", "sub").agg(joined.alias("content"))
        .join(heads, ["id", "section"], "left")
        .withColumn("section_title", F.coalesce("section_title", F.lit("")))
        .filter(~F.col("section_title").isin(*IGNORED_SECTIONS))
    )
    # A section whose text is empty still stands before its subsections.
    text_of = F.when(F.col("sub") == 0, F.concat_ws(" ", "title", "content")).otherwise(
        F.concat_ws(" ", "title", "section_title", "content")
    )
    orphans = parts.filter("section = 0 and sub > 0").select("id", "title").distinct().select(
        "id", F.lit(0).cast("long").alias("section"), F.lit(0.5).alias("sub"), F.concat("title", F.lit(" ")).alias("contents")
    )
    emitted = (
        leads.select("id", "section", F.col("sub").cast("double").alias("sub"), "contents")
        .union(orphans)
        .union(parts.select("id", "section", F.col("sub").cast("double").alias("sub"), doc_clean(text_of).alias("contents")))
    )
    w = Window.partitionBy("id").orderBy("section", "sub")
    numbered = emitted.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))
    titles = docs.select(F.col(id).alias("id"), F.col(title).alias("title"))
    return numbered.join(titles, "id").select(
        "id", "ordinal", F.concat("title", F.lit("_"), F.col("ordinal").cast("string")).alias("section_id"), "contents"
    )


def keep_titles(titles: DataFrame, title: str = "title") -> DataFrame:
    """Stripped titles that are no disambiguation pages."""
    t = strip(F.col(title))
    return titles.select(t.alias("title")).filter(~F.col("title").contains(DISAMBIGUATION[0]) & ~F.col("title").contains(DISAMBIGUATION[1]))


def dedupe_last(df: DataFrame, key: str, ord: str) -> DataFrame:
    """Of rows with equal keys the last by ord stays."""
    w = Window.partitionBy(key).orderBy(F.desc(ord))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


