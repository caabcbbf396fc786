"""Question categories: keyword rules first, then a linear model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import HashingTF, IndexToString, Normalizer, RegexTokenizer, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.sources.shared import written

# Phrases of the labeller.
LABEL_DATE_ANSWER = ("ngày", "tháng", "năm")
LABEL_DATE_QUESTION = (
    "năm nào", "tháng nào", "ngày nào", "năm bao nhiêu", "tháng bao nhiêu", "ngày bao nhiêu",
    "khi nào", "lúc nào", "thời gian nào", "ngày mấy",
)
LABEL_QUANTITY_QUESTION = ("bao nhiêu", "bao lâu", "bao giờ")
# Phrases of the runtime rules.
RULE_DATE = (
    "khi nào", "lúc nào", "bao giờ", "thời gian nào", "ngày mấy", "ngày nào", "ngày bao nhiêu",
    "ngày tháng năm nào", "tháng nào", "tháng bao nhiêu", "năm nào", "năm bao nhiêu",
)
RULE_QUANTITY = ("bao nhiêu", "bao lâu")
RULE_WIKI = ("vào năm",)
NUMBER = r"\A[\s]*[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+)?[\s]*\z|\A\s*[+-]?(?:(?i)inf|infinity|nan)\s*\z"

FEATURES, REGULARISATION, SEED = 1 << 16, 0.5, 42
#: Text of a task, and up to which training rows are dealt anew, in bytes.
TASK_TEXT, SMALL_TEXT = 1 << 20, 64 << 20


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | c.contains(p)
    return found


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER)


def label_category(question: Column, answer: Column) -> Column:
    """Category of a labelled question, from its answer and wording."""
    return (
        F.when(contains_any(answer, LABEL_DATE_ANSWER) | contains_any(question, LABEL_DATE_QUESTION), "datetime")
        .when(is_number(answer) | contains_any(question, LABEL_QUANTITY_QUESTION), "quantity")
        .when(answer.contains("wiki"), "wiki")
        .otherwise("other")
    )


def rule_category(question: Column) -> Column:
    """Category by the runtime rules, null where only a model can tell."""
    return (
        F.when(contains_any(question, RULE_DATE), "datetime")
        .when(contains_any(question, RULE_QUANTITY), "quantity")
        .when(contains_any(question, RULE_WIKI), "wiki")
    )


def split(df: DataFrame, key: str = "question", train: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A hashed split: the same rows fall the same way, however df is partitioned."""
    side = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(1000)) < int(train * 1000)
    return df.filter(side), df.filter(~side)


def fit_categories(train: DataFrame, question: str = "question", category: str = "category") -> PipelineModel:
    """Hashed words under linear SVMs, one a category; labels come from train only.

    Every step of every SVM is a pass over all partitions. Rows of little text are written
    once, in as few partitions as their text needs; others stay as they are dealt.
    """
    train = train.select(question, category)
    text = F.coalesce(F.octet_length(question), F.lit(0))
    size = train.agg(F.count("*").alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes")).first()
    if size["bytes"] <= SMALL_TEXT:
        train = written(train.repartition(1 + size["bytes"] // TASK_TEXT))
    labels = StringIndexer(inputCol=category, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    stages = [
        labels,
        RegexTokenizer(inputCol=question, outputCol="tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=FEATURES),
        Normalizer(inputCol="tf", outputCol="features", p=2.0),
        OneVsRest(classifier=LinearSVC(maxIter=20, regParam=REGULARISATION / max(size["n"], 1)), labelCol="label"),
        IndexToString(inputCol="prediction", outputCol="model_category", labels=labels.labels),
    ]
    return Pipeline(stages=stages).fit(train)


def classify(df: DataFrame, model: PipelineModel | None = None, question: str = "question") -> DataFrame:
    """Adds category: the rules', else the model's, else other."""
    own = model.transform(df) if model else df.withColumn("model_category", F.lit("other"))
    out = own.withColumn("category", F.coalesce(rule_category(F.col(question)), "model_category"))
    return out.select(*[c for c in df.columns if c != "category"], "category")


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def accuracy(df: DataFrame, prediction: str, label: str) -> DataFrame:
    same = F.when(F.col(prediction).eqNullSafe(F.col(label)), 100.0).otherwise(0.0)
    return df.agg(F.avg(same).alias("accuracy"), F.count("*").alias("n"))
