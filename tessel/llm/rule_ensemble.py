"""Quality classifier: a sparse ensemble of rules.

Text statistics are Spark columns. Trees are grown over them on a bounded labelled sample, every path from a root is one
conjunctive rule, a lasso logistic model weighs the rules, and the rules with a weight other than zero become one Spark
column expression: the score. Scoring is a map over the documents, without a shuffle.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, barrier, held_out, labelled_sample, quoted, table

#: Rows of labels that are learned from at most.
MAX_LABELLED = 20_000

_SYMBOLS = "#*$%&|<>{}[]\\^~=+_@"
STATISTICS = [
    "chars", "words", "word_length", "distinct_words", "symbol_share", "bang_share", "upper_share", "digit_share",
    "stop_share", "space_share", "line_length", "repeated_lines",
]


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(text: Column) -> Column:
    """A struct of the statistics of a text; null counts as empty, and shares of nothing are 0."""
    chars = F.length(text)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    share = lambda n, of: F.when(of > 0, n / of).otherwise(0.0)
    spaces = _count_of(text, ASCII_SPACE)
    n = F.size(words)
    return F.struct(
        F.log1p(chars.cast("double")).alias("chars"),
        F.log1p(n.cast("double")).alias("words"),
        share(chars - spaces, n).alias("word_length"),
        share(F.size(F.array_distinct(words)), n).alias("distinct_words"),
        share(_count_of(text, _SYMBOLS), chars).alias("symbol_share"),
        share(_count_of(text, "!"), chars).alias("bang_share"),
        share(_count_of(text, string.ascii_uppercase), chars).alias("upper_share"),
        share(_count_of(text, string.digits), chars).alias("digit_share"),
        share(_count_of(text, ".,;:?"), chars).alias("stop_share"),
        share(spaces, chars).alias("space_share"),
        F.log1p(chars / F.size(lines)).alias("line_length"),
        share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)).alias("repeated_lines"),
    )


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns that count, with the statistics worked out once in a struct, whatever a filter above asks of them."""
    return barrier(docs.select(*more, statistics(F.coalesce(F.col("text"), F.lit(""))).alias("_s")), "_s")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): above means >, else <=."""

    terms: frozenset[tuple[str, bool, float]]

    def column(self, of) -> Column:
        out = None
        for name, above, at in sorted(self.terms):
            one = of(name) > at if above else of(name) <= at
            out = one if out is None else out & one
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {t:.6g}" for n, a, t in sorted(self.terms))


def tree_rules(trees: list[str]) -> list[Rule]:
    """The rules of trees in the text form that Spark ML prints: one for each node below a root."""
    found: dict[Rule, None] = {}
    for text in trees:
        path: list[tuple[int, tuple[str, bool, float]]] = []
        for line in text.splitlines():
            m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
            if not m:
                continue
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(m[2])], m[3] == ">", float(m[4])))]
            tightest: dict[tuple[str, bool], float] = {}
            for _, (name, above, at) in path:
                old = tightest.get((name, above))
                tightest[name, above] = at if old is None else (max if above else min)(old, at)
            found[Rule(frozenset((n, a, t) for (n, a), t in tightest.items()))] = None
    return list(found)


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, of) -> Column:
        """The probability of label 1; of gives the column of a statistic."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(of), F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_LABELLED, trees: int = 16, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """A rule ensemble from at most max_rows labelled documents, none of them held out.

    Without labelled rows every score is 0.5; with labels of one kind only every score is their smoothed share.
    """
    sample = F.broadcast(labelled_sample(labels, label, max_rows))
    rows = _texts(docs.select("doc_id", "text").join(sample, "doc_id"), "doc_id", "label").select("doc_id", F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("label"), "_s.*")
    rows = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows).repartition(4).sortWithinPartitions("doc_id", "label").persist()
    try:
        ones, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count(F.lit(1))).first()
        if ones in (0, n):
            return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)), [])
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=seed, minInstancesPerNode=5).fit(rows)
        rules = tree_rules([t.toDebugString for t in forest.trees])
        if not rules:
            return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)), [])
        hits = rows.select("label", array_to_vector(F.array(*[F.when(r.column(F.col), 1.0).otherwise(0.0) for r in rules])).alias("features")).persist()
        try:
            model = LogisticRegression(maxIter=30, tol=1e-3, aggregationDepth=2, regParam=penalty, elasticNetParam=1.0).fit(hits)
        finally:
            hits.unpersist()
        return RuleEnsemble(float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w])
    finally:
        rows.unpersist()


def score_documents(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row. A null text scores as an empty one; a null doc_id is not held out."""
    scored = _texts(docs, "doc_id").select("doc_id", model.score(lambda n: F.col("_s")[n]).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that the classifier, fitted on their labelled part, accepts, with the columns of docs."""
    model = fit(docs, labels)
    scored = barrier(docs.withColumn("_op1_s", statistics(F.coalesce(F.col("text"), F.lit("")))), "_op1_s")
    return scored.where(model.score(lambda n: F.col("_op1_s")[n]) >= threshold).select(*quoted(docs.columns))


def op1_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
