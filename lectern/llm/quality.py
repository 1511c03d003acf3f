"""A quality classifier from a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded sample of labelled documents. Every path from a root is a rule: a conjunction of
comparisons. A logistic regression with an absolute-value penalty weighs the rules and drops most of them; the rest
become one column expression, so scoring needs no model on the executors.
"""
from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import cut_lineage, remainder, words

#: Labelled documents that are learnt from at most: those with the least hashes.
SAMPLE = 10_000
TREES, DEPTH, PENALTY, SEED = 12, 3, 0.002, 7

STATISTICS = ("log_words", "word_length", "long_words", "symbols", "exclaims", "digits", "capitals", "distinct", "doubled",
              "dup_lines", "line_words", "stops")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the text statistics of each row; labels, language, source and id have no part in them."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"))
    # The count of a character class is one less than the parts it splits a text into.
    count = lambda pattern: (F.size(F.split("text", pattern)) - 1).cast("double")
    n = F.greatest(F.size("w"), F.lit(1)).cast("double")
    chars = F.greatest(F.length("text"), F.lit(1)).cast("double")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bound = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  binds a value once
    doubled = F.aggregate("w", F.struct(F.lit(0.0).alias("n"), F.lit("").alias("last")), lambda acc, x: F.struct(
        (acc["n"] + F.when(acc["last"] == x, 1.0).otherwise(0.0)).alias("n"), x.alias("last")), lambda acc: acc["n"])
    return split.select(
        "doc_id", F.log1p(F.size("w").cast("double")).alias("log_words"),
        (F.aggregate("w", F.lit(0.0), lambda s, x: s + F.length(x)) / n).alias("word_length"),
        (F.aggregate("w", F.lit(0.0), lambda s, x: s + F.when(F.length(x) > 12, 1.0).otherwise(0.0)) / n).alias("long_words"),
        (count(r"[#*$%&|<>@^~={}\[\]\\]") / chars).alias("symbols"), (count("[!?]") / chars).alias("exclaims"),
        (count("[0-9]") / chars).alias("digits"), (count("[A-Z]") / chars).alias("capitals"),
        (F.size(F.array_distinct("w")) / n).alias("distinct"), (doubled / n).alias("doubled"),
        bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))) / F.greatest(F.size(x), F.lit(1)).cast("double")).alias("dup_lines"),
        (n / bound(lines, lambda x: F.greatest(F.size(x), F.lit(1)).cast("double"))).alias("line_words"),
        (count(r"[.]") / n).alias("stops"))


class Test(NamedTuple):
    statistic: str
    above: bool
    limit: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > self.limit if self.above else value <= self.limit


Rule = tuple[Test, ...]


def tree_rules(text: str, names: tuple[str, ...] = STATISTICS) -> list[Rule]:
    """The distinct paths of trees in their printed form, inner ones included, simplest first."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, Test]] = []
    for line in text.splitlines():
        indent = len(line) - len(line.lstrip())
        test = re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if re.match(r"\s*Tree ", line):
            path = []
        if not test:
            continue
        while path and path[-1][0] >= indent:
            path.pop()
        path.append((indent, Test(names[int(test[1])], test[2] == ">", float(test[3]))))
        found.setdefault(tuple(sorted({t for _, t in path})))
    return sorted(found, key=lambda r: (len(r), r))


class RuleModel(NamedTuple):
    """Weights of rules, and the logarithm of the odds without any."""
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = rule[0].column()
            for test in rule[1:]:
                holds = holds & test.column()
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(rows: DataFrame) -> RuleModel:
    """A model of rows with the statistics and ``label`` (0 or 1), a bounded sample. One class alone gives its share."""
    counts = rows.groupBy("label").count().collect()  # two rows at most
    n = {int(r["label"]): r["count"] for r in counts}
    if len(n) < 2:
        return RuleModel((), 0.0 if not n else 3.0 if 1 in n else -3.0)
    data = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", maxBins=64).fit(
        data.select("features", "label"))
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleModel((), 0.0)
    marks = rows.select(F.col("label").cast("double").alias("label"), *[
        _all(rule).cast("double").alias(f"r{k}") for k, rule in enumerate(rules)])
    data = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features").transform(marks)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60).fit(data.select("features", "label"))
    weights = lasso.coefficients.toArray()
    return RuleModel(tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w), float(lasso.intercept))


def _all(rule: Rule) -> Column:
    holds = rule[0].column()
    for test in rule[1:]:
        holds = holds & test.column()
    return holds


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    Labels (doc_id, quality) of documents whose crc32 remainder modulo 3 is 1 are held out; of the others the ``sample``
    with the least hashes of their ids are learnt from, all other steps use every row. Labels that are null or name no
    document are left out, contradicting ones count as 0. Null and empty texts have statistics like any other and get a
    score; repeated rows are scored each; no labels give 0.5; no documents give no rows; other columns are ignored.
    """
    stats = cut_lineage(statistics(docs.select("doc_id", "text")))
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").where(remainder(F.col("doc_id"), 3) != 1)
    chosen = (known.groupBy("doc_id").agg(F.min(F.col("quality") > 0).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = cut_lineage(stats.join(chosen, "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id"))
    model = fit(rows)
    return stats.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), model.score().alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
