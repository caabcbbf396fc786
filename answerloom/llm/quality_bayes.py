"""Quality classifier: document evidence shrunk towards host and path posteriors.

A logistic model on surface measures of the whole text gives each document's own
evidence. Hosts and the paths below them get beta posteriors of their mean evidence:
a path is shrunk towards its host, a host towards the global mean, the more the fewer
documents it has. How much is estimated from the data (analysis of variance): groups
differ by chance already, and only what they differ beyond the noise of their means
counts as a difference between them. A document's verdict adds its path's log-odds,
less the global, to its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.common import by_bytes, materialise, utf8

FEATURES = (
    "upper_share", "digit_share", "symbol_share", "pipe_share", "punct_share", "mark_share", "space_share",
    "word_length", "different_words", "different_lines", "log_words",
)
#: Most labelled rows that the logistic model is fitted on, those of least hash.
SAMPLE_ROWS = 20_000
RIDGE, STEPS = 1e-2, 30
#: Evidence is kept off 0 and 1. A site moves a document by at most so many log-odds: clear
#: evidence of its own outweighs any site.
LEAST, MOST_SHIFT = 1e-4, 2.0
#: Posterior of being good from which a document is kept.
KEEP = 0.5
#: Rows up to which a table of group posteriors is broadcast; beyond, it is joined salted.
BROADCAST_ROWS = 20_000
SALTS = 32
BATCH_BYTES = 4 << 20

_CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=+_", b"|", b".,;:'\"()-", b"!?", b" \t\n\r\x0b\x0c")):
    _CLASSES[list(_chars)] = _k + 1


def text_features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES a text; texts without a character have zeros."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(n), sizes)
    counts = np.bincount(doc * 8 + _CLASSES[flat], minlength=8 * n).reshape(n, 8)
    per = np.maximum(sizes, 1)[:, None]
    words = [t.split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, n)
    different = np.fromiter((len(set(w)) for w in words), np.int64, n)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    share = lambda a, b: a / np.maximum(b, 1)
    more = [
        share(np.fromiter((sum(map(len, w)) for w in words), np.int64, n), n_words) / 10,
        share(different, n_words),
        np.fromiter((share(len(set(x)), len(x)) for x in lines), float, n),
        np.log1p(n_words) / 10,
    ]
    return np.column_stack([counts[:, 1:] / per, *more])


def features(text: Column) -> Column:
    """array<double> of FEATURES; null counts as empty."""

    @F.arrow_udf("array<double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = utf8(batch)
            parts = [text_features(texts[i:j]) for i, j in by_bytes(texts, BATCH_BYTES)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            yield pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(FEATURES), flat)

    return measured(text)


@dataclass(frozen=True)
class Model:
    """Standardised logistic weights; without labels it knows nothing and says 1/2."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def evidence(self, x: Column) -> Column:
        """Probability of being good, kept off 0 and 1."""
        z = F.lit(self.bias)
        for i, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights, strict=True)):
            z = z + (F.get(x, F.lit(i)) - m) * (w / s)
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        return F.greatest(F.lit(LEAST), F.least(F.lit(1 - LEAST), p))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge logistic regression by Newton steps."""
    k = len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        prior = 0.0 if len(y) == 0 else (3.0 if y[0] else -3.0)
        return Model((0.0,) * k, (1.0,) * k, (0.0,) * k, prior)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(k + 1), np.diag([*[RIDGE * len(x)] * k, 1e-9])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w[:-1].tolist()), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits the model on at most `rows` labelled documents, chosen by hash of doc_id.

    Labels with a null doc_id or quality are ignored, and so are doc_ids labelled both
    ways. The sample is bounded before
    the join, so its broadcast is too.
    """
    chosen = (
        labels.filter("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("other"))
        .filter("quality = other").drop("other")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    got = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", features(F.col("text")).alias("x"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "x")
        .limit(rows)
        .collect()
    )
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["quality"] for r in got], float))


def group_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, shift): log-odds by which each path differs from the global mean.

    Two groupings, pre-aggregated before they shuffle: a host with a third of all
    documents sends one row a task. With w = n T / (n T + S), S the variance of
    evidence within groups and T that between them beyond noise, a host's posterior is
    its own mean by w and the global mean by 1 - w; a path's is its own mean by w, with
    S and T of paths about their hosts, and its host's posterior by 1 - w.
    """
    e = F.col("evidence")
    paths = materialise(
        scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("q"))
    )
    sums = [F.sum(c).alias(f"h{c}") for c in ("n", "s", "q")]
    hosts = paths.groupBy("host").agg(*sums).withColumnRenamed("host", "__host")
    met = materialise(paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    if not total["n"]:
        return met.select("host", "path", F.lit(0.0).alias("shift"))
    mean = min(max(total["s"] / total["n"], LEAST), 1 - LEAST)
    noise, between = spread(hosts, F.col("hn"), F.col("hs"), F.col("hq"), F.lit(mean), F.lit(float(total["n"])), 1)
    path_noise, below = spread(met, F.col("n"), F.col("s"), F.col("q"), F.col("hs") / F.col("hn"), F.col("hn"), hosts.count())
    host_mean = shrunk(F.col("hn"), F.col("hs"), F.lit(mean), noise, between)
    posterior = shrunk(F.col("n"), F.col("s"), host_mean, path_noise, below)
    shift = F.log(posterior / (1 - posterior)) - float(np.log(mean / (1 - mean)))
    return met.select("host", "path", F.greatest(F.lit(-MOST_SHIFT), F.least(F.lit(MOST_SHIFT), shift)).alias("shift"))


def shrunk(n: Column, s: Column, prior: Column, noise: float, between: float) -> Column:
    """Posterior mean of a group of n documents whose evidence sums to s."""
    w = n * between / (n * between + noise) if between > 0 else F.lit(0.0)
    return w * s / n + (1 - w) * prior


def spread(
    groups: DataFrame, n: Column, s: Column, q: Column, centre: Column, above: Column, tops: int
) -> tuple[float, float]:
    """(S, T): variance within groups, and between them about centre beyond noise.

    Groups have n documents, sum s and sum of squares q; each hangs under one of tops
    larger groups, of mean centre and size above. Method of moments: the groups' squared
    distances from their centres hold (groups - tops) S for noise, and T for each of
    documents less their own share of their centre. T is 0 where noise explains all, or
    where no group has two documents.
    """
    r = groups.agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(q - s * s / n).alias("inside"),
        F.sum(n * (s / n - centre) ** 2).alias("about"), F.sum(n * n / above).alias("own"),
    ).first()
    if r["n"] <= r["k"]:  # no group has two documents: all may be noise
        return 1.0, 0.0
    noise = max(float(r["inside"]), 0.0) / (r["n"] - r["k"])
    free = float(r["n"]) - float(r["own"])
    between = (float(r["about"]) - (r["k"] - tops) * noise) / free if free > 1e-9 else 0.0
    return noise, max(between, 0.0)


def with_shift(rows: DataFrame, shifts: DataFrame, host: Column, path: Column) -> DataFrame:
    """Adds shift to every row of rows, 0 where a group is not known.

    A small table of groups is broadcast after its rows are counted; a larger one is
    copied SALTS times and met by rows dealt over the copies, which splits any group.
    """
    named = shifts.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "shift")
    match = host.eqNullSafe(F.col("__h")) & path.eqNullSafe(F.col("__p"))
    if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(named), match, "left")
    else:
        salted = named.withColumn("__t", F.explode(F.array(*map(F.lit, range(SALTS)))))
        dealt = rows.withColumn("__s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        out = dealt.join(salted, match & (F.col("__s") == F.col("__t")), "left").drop("__s", "__t")
    return out.withColumn("shift", F.coalesce("shift", F.lit(0.0))).drop("__h", "__p")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """Adds evidence, shift, posterior and kept to docs (with doc_id and text).

    host and path name the columns of the two levels; a null is a group of its own.
    Null and empty texts are judged by their zero features; repeated rows are judged
    alike; without labels every evidence is 1/2 and all is kept. kept: posterior of
    at least KEEP. Columns of docs with one of the new names are replaced.
    """
    docs = docs.drop("evidence", "shift", "posterior", "kept")
    model = train(docs, labels)
    evidence = model.evidence(features(F.col("text")))
    narrow = docs.select(F.col(host).alias("host"), F.col(path).alias("path"), evidence.alias("evidence"))
    shifts = materialise(group_posteriors(narrow))
    return _posterior(with_shift(docs.withColumn("evidence", evidence), shifts, F.col(host), F.col(path)))


def classify_narrow(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """classify without the texts: (doc_id, host, path, evidence, shift, posterior, kept)."""
    model = train(docs, labels)
    narrow = materialise(
        docs.select(
            "doc_id", F.col(host).alias("host"), F.col(path).alias("path"),
            model.evidence(features(F.col("text"))).alias("evidence"),
        )
    )
    return _posterior(with_shift(narrow, group_posteriors(narrow), F.col("host"), F.col("path")))


def _posterior(rows: DataFrame) -> DataFrame:
    p = F.col("evidence")
    z = F.log(p / (1 - p)) + F.col("shift")
    return rows.withColumn("posterior", 1 / (1 + F.exp(-z))).withColumn("kept", F.col("posterior") >= KEEP)
