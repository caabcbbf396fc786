"""Definitions of order-dependent text operators, letter by letter, for tests of their column forms."""

import math
import re
from statistics import mean, median

from answerloom.functions.text import ACCENTED
from answerloom.operators.corpus import LINK, NAMESPACES
from answerloom.operators.voting import VOTE_THRESHOLD, VOTE_WEIGHTS


def grams(text, n):
    return [text[i : i + n] for i in range(len(text) - n + 1)]


def gram_match(a, b, n):
    x, y = grams(a, n), grams(b, n)
    total = (len(x) + len(y)) / 2
    return sum(g in y for g in x) / total if total else 0.0


def normal(text):
    kept = set("abcdefghijklmnopqrstuvwxyz0123456789 " + ACCENTED)
    return "".join(c for c in text.lower() if c in kept).replace("bullet", "")


def majority(candidates, weights=VOTE_WEIGHTS, threshold=VOTE_THRESHOLD, ngram=None):
    if len(candidates) != len(weights) or not candidates:
        return None
    sizes = [len(c.split(" ")) for c in candidates]
    n = 1 if mean(sizes) < 2 else ngram or math.ceil(median(sizes))
    clean = [(place, c, normal(c), w) for place, (c, w) in enumerate(zip(candidates, weights, strict=True))]
    clean = [x for x in clean if x[2]]
    if not clean:
        return None
    wordings = [x[2] for x in clean]
    first = wordings[0]
    if first in wordings[1:]:
        holding = [(place, len(x.split(" "))) for place, x in enumerate(wordings) if place and first in x]
        bound = math.ceil(mean(size for _, size in holding))
        return next((place for place, size in holding if size > bound), 0), clean[0][1]
    heads = {}
    for x in clean:
        head = next((h for h in heads if gram_match(x[2], h, n) >= threshold), None)
        if head is None:
            heads[x[2]] = [x]
        else:
            heads[head].append(x)
    best = max(heads.values(), key=lambda g: sum(x[3] for x in g))
    size = math.ceil(mean(len(x[1].split(" ")) for x in best))
    return next(((x[0], x[1]) for x in best if len(x[1].split(" ")) == size), (0, best[0][1]))


def links_and_positions(text):
    out = []
    for body in re.findall(LINK, text):
        link, _, label = body.partition("|") if "|" in body else (body, "", body)
        whole = f"[[{body}]]"
        at = text.find(whole)
        start = text[:at].count(" ") if at >= 0 else -1
        out.append((link, start, start + label.count(" ") if at >= 0 else -1))
        text = text.replace(whole, label).replace(body, label)
    return text, out


def find_balanced(text, open="[[", close="]]"):
    depth = start = i = 0
    while i < len(text):
        if text.startswith(open, i):
            start = i if depth == 0 else start
            depth, i = depth + 1, i + len(open)
        elif depth and text.startswith(close, i):
            depth, i = depth - 1, i + len(close)
            if depth == 0:
                yield start, i
        else:
            i += 1


def make_internal_link(title, label):
    space = title[1:] if title.startswith(":") else title
    cut = space.find(":")
    if cut > 0 and space[:cut] not in NAMESPACES:
        return ""
    title = "_".join((title[:1].upper() + title[1:]).split())
    return f"[[wiki/{title}|{label}]]"


def replace_internal_links(text):
    out, last = [], 0
    for start, end in find_balanced(text):
        trail = re.match(r"\w*", text[end:]).group()
        inner = text[start + 2 : end - 2]
        pipe = inner.find("|")
        title = inner if pipe < 0 else inner[:pipe].rstrip()
        if pipe >= 0:
            since = pipe + 1
            for a, b in find_balanced(inner):
                pipe = max(pipe, inner.rfind("|", since, a)) if a >= since else pipe
                since = b
        label = title if pipe < 0 else inner[pipe + 1 :].strip()
        out += [text[last:start], make_internal_link(title, label), trail]
        last = end + len(trail)
    return "".join([*out, text[last:]])


def basic_tokens(text):
    return re.findall(r"\w+|[^\w\s]", text.lower())


def final_text(pred, original, tokenised):
    at = tokenised.find(pred)
    a, b = ([i for i, c in enumerate(s) if c != " "] for s in (original, tokenised))
    if at < 0 or len(a) != len(b):
        return original
    places = {i: a[k] for k, i in enumerate(b)}
    first, last = places.get(at), places.get(at + len(pred) - 1)
    return original if first is None or last is None else original[first : last + 1]


def quantity_tokens(text, compat):
    from answerloom.functions.entities import QUANTITY_DROP, QUANTITY_WORDS

    text = text.lower()
    text = text.replace("k", "000") if compat else re.sub(r"(\d+)k\b", r"\g<1>000", text)
    for a, b in QUANTITY_WORDS:
        text = text.replace(a, b)
    return re.sub(QUANTITY_DROP, "", text).split()


def quantity_of(text, values, compat):
    toks = quantity_tokens(text, compat)
    if compat:
        for words, n in sorted(values.items(), key=lambda x: -x[1]):
            if all(w in toks for w in words):
                at = toks.index(words[0])
                toks[at : at + len(words)] = [str(n)]
    else:
        longest, out, i = max(map(len, values)), [], 0
        while i < len(toks):
            size = next((k for k in range(longest, 0, -1) if tuple(toks[i : i + k]) in values and i + k <= len(toks)), 0)
            out.append(str(values[tuple(toks[i : i + size])]) if size else toks[i])
            i += size or 1
        toks = out
    return re.sub(r"\D", "", " ".join(toks))


def longest_matches(phrases, words):
    """First tags: at each place the longest phrase, from left to right."""
    tags = []
    while len(tags) < len(words):
        i = len(tags)
        n = max((k for k in range(2, len(words) - i + 1) if " ".join(words[i : i + k]) in phrases), default=1)
        tags += ["B"] + ["I"] * (n - 1)
    return tags


def ripple_down(lines, words, tags):
    """Final tags, by walking the lines of a rule file for every word."""

    def value(name, i):
        name = name.lower()
        distance = int(name[-1]) if name[-1].isdigit() else 0
        j = i - distance if name.startswith("prev") else i + distance
        source = words if "word" in name else tags
        return source[j] if 0 <= j < len(source) else ""

    out = []
    for i in range(len(words)):
        level, chosen = 0, None
        for line in lines:
            depth = len(line) - len(line.lstrip("\t"))
            if depth < level:
                break  # all below the chosen rule has been tried
            condition, conclusion = line.strip().split(" : ")
            holds = condition == "True" or all(
                value(a.split(" == ")[0].removeprefix("object."), i) == a.split(" == ")[1].strip('"') for a in condition.split(" and ")
            )
            if depth == level and holds:
                level, chosen = depth + 1, conclusion.split('"')[1]
        out.append(chosen)
    return out
