"""Quality rules: a learned decision list over exact text statistics.

The statistics of every whole text come from one pass in Arrow batches. On a bounded labelled sample, sequential covering
grows conjunctions of thresholds that catch rejected texts, prunes each on rows that it wasn't grown on, and removes what a
rule covers before it looks for the next. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, barrier, labelled_sample, quoted, table

#: Rows of labels that are learned from at most.
MAX_LABELLED = 20_000

SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: list[bytes], n: int = WINDOW) -> int:
    """How many words lie in windows of n words that occur twice or more. Windows are told apart exactly."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))
    if len(known) == len(words):
        return 0
    bits = max(1, int(len(known) - 1).bit_length())
    if bits * n <= 63:
        key = ids[:m].copy()
        for i in range(1, n):
            key = (key << bits) | ids[i : m + i]
    else:  # numbers for pairs, then for what has been joined so far
        key = ids[:m]
        for i in range(1, n):
            _, key = np.unique(key * np.int64(len(known)) + ids[i : m + i], return_inverse=True)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + n, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of one text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    spaces = sum(map(text.count, ASCII_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), _repeat_words(words)


def _count_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS, dtype="int64")


def counts(text: str = "text") -> Column:
    """A struct of COUNTS of the texts in a column."""
    return F.pandas_udf(_count_batches, ", ".join(f"{c} long" for c in COUNTS), F.PandasUDFType.SCALAR_ITER)(text)


#: Statistics that rules may use, by name, as functions of the counts; shares of nothing are 0.
STATISTICS = {
    "words": lambda c: c("n_words") * 1.0,
    "word_length": lambda c: c("word_chars") / c("n_words"),
    "symbol_share": lambda c: c("n_symbols") / c("word_chars"),
    "repeat_share": lambda c: c("n_repeat_words") / c("n_words"),
    "dup_lines_share": lambda c: c("n_dup_lines") / c("n_words"),
}


def _statistic(name: str, of: Column) -> Column:
    return F.when(of["n_words"] > 0, STATISTICS[name](lambda k: of[k])).otherwise(0.0)


def base_failed(of: Column) -> Column:
    """Too short, or over a fifth of the words repeated in windows."""
    return (of["n_words"] < 10) | (of["n_repeat_words"] * 100 > of["n_words"] * 20)


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; each is a conjunction of (statistic, above, threshold) that rejects. What no rule covers is kept."""

    rules: list[list[tuple[str, bool, float]]]

    def keeps(self, of: Column) -> Column:
        verdict = None
        for rule in self.rules:
            cond = None
            for name, above, at in rule:
                one = _statistic(name, of) >= at if above else _statistic(name, of) <= at
                cond = one if cond is None else cond & one
            verdict = F.when(cond, F.lit(False)) if verdict is None else verdict.when(cond, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def _covers(x: dict[str, np.ndarray], rule, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, above, at in rule:
        out &= x[name] >= at if above else x[name] <= at
    return out


def _grow(x, bad, bins: int = 32, most: int = 3):
    """Adds the condition of the largest information gain until no good row is covered."""
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < most:
        p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for name, v in x.items():
            cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, bins)))
            cuts = np.unique(np.concatenate([cuts, np.quantile(v[inside & bad], [0, 0.02, 0.1, 0.9, 0.98, 1])]))
            for at in cuts.tolist():
                for above in (True, False):
                    c = inside & (v >= at if above else v <= at)
                    p, n = int((bad & c).sum()), int((~bad & c).sum())
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = (name, above, at), g
        if best is None:
            break
        rule.append(best)
        inside = _covers(x, rule, len(bad))
    return rule


def _pruned(x, bad, rule):
    """The prefix of the rule of the best worth (p - n) / (p + n) on rows that it wasn't grown on; the shortest of equals."""
    def worth(r):
        c = _covers(x, r, len(bad))
        p, n = int((bad & c).sum()), int((~bad & c).sum())
        return ((p - n) / (p + n) if p + n else -1.0), p, n
    best = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r)[0], -len(r)), default=[])
    return best, worth(best) if best else (-1.0, 0, 0)


def learn(sample: pd.DataFrame, max_rules: int = 12, least_worth: float = 0.8) -> DecisionList:
    """Sequential covering over rows of STATISTICS and bad (bool); every third row, by hash order, prunes."""
    x = {k: sample[k].to_numpy(float) for k in STATISTICS}
    bad = sample["bad"].to_numpy(bool)
    prunes = np.arange(len(bad)) % 3 == 2
    rules = []
    while len(rules) < max_rules and (bad & ~prunes).any() and (bad & prunes).any():
        part = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])  # noqa: E731, B023
        rule, (worth, p, _) = _pruned(*part(prunes), _grow(*part(~prunes)))
        if not rule or worth < least_worth or not p:
            break
        rules.append(rule)
        rest = ~_covers(x, rule, len(bad))
        x, bad, prunes = {k: v[rest] for k, v in x.items()}, bad[rest], prunes[rest]
    return DecisionList(rules)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_LABELLED) -> DecisionList:
    """A list from at most max_rows labelled documents, none held out, of those that pass the base rules. No labels, no rules."""
    sample = F.broadcast(labelled_sample(labels, label, max_rows))
    texts = barrier(docs.select("doc_id", "text").join(sample, "doc_id"), "text")  # else the filter has all documents counted before the join
    rows = texts.select("doc_id", "label", counts().alias("_c")).where(~base_failed(F.col("_c")))
    rows = rows.select("doc_id", (F.col("label") <= 0).alias("bad"), *[_statistic(k, F.col("_c")).alias(k) for k in STATISTICS])
    return learn(rows.toPandas().sort_values(["doc_id", "bad", *STATISTICS]).sample(frac=1, random_state=7))


def judge_documents(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept) for each row. A null text counts as empty and so fails the base rules."""
    counted = docs.select("doc_id", counts().alias("_c"))
    return counted.select("doc_id", "_c.*", base_failed(F.col("_c")).alias("base_failed"), (~base_failed(F.col("_c")) & rules.keeps(F.col("_c"))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the list, learned on their labelled part, keeps, with the columns of docs."""
    rules = fit(docs, labels)
    counted = docs.withColumn("_op2_c", counts())
    return counted.where(~base_failed(F.col("_op2_c")) & rules.keeps(F.col("_op2_c"))).select(*quoted(docs.columns))


def op2_decision_list(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
