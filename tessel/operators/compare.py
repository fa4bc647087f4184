"""Matching of clauses between two documents, and what the differences are.

Pairs of documents are independent: the cost of a job is the sum over its pairs, and clauses meet only within a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from . import cells
from .assign import assigned, assigned_by, best_matches, matching_characters, places  # noqa: F401

#: Distinct texts and clauses of a side of a cell of scored_pairs.
TEXTS, CLAUSES = 256, 2048
#: Pairs of texts whose matching characters a worker remembers (a power of two), and characters of these texts.
KNOWN, KNOWN_CHARS = 1 << 21, 1 << 24


def match_key(heading: Column, text: Column) -> Column:
    return T.normalized(F.concat(heading, F.lit("\n"), F.substring(text, 1, X.MATCH_CHARS)))


def domain_pairs(entries: DataFrame, *, within: str = "domain", order: str = "ord") -> DataFrame:
    """Unordered pairs of entries of one domain, the earlier on the left: columns l_* and r_*. They meet in cells, so a domain may be large."""
    left, right = cells.both_sides(cells.blocked(entries, within, order))
    named = lambda rows, s: cells.spread(rows.select(*[F.col(c).alias(f"{s}_{c}") for c in entries.columns], F.col("l_block").alias(f"_{s}_a"), F.col("r_block").alias(f"_{s}_b")), f"{s}_{within}", f"_{s}_a", f"_{s}_b")
    same = (F.col(f"l_{within}") == F.col(f"r_{within}")) & (F.col("_l_a") == F.col("_r_a")) & (F.col("_l_b") == F.col("_r_b"))
    return named(left, "l").join(named(right, "r"), same & (F.col(f"l_{order}") < F.col(f"r_{order}"))).drop("_l_a", "_l_b", "_r_a", "_r_b")


def pair_bounds(entries: DataFrame) -> DataFrame:
    """(l_ord, r_ord, by_length, by_characters): what the ratio of the names of two of entries(domain, ord, name) of one domain is at most.

    In a cell, equal names are compared once.
    """
    left, right = cells.both_sides(cells.blocked(entries.select("domain", F.col("ord").cast("long").alias("ord"), "name").where("domain is not null"), "domain", "ord"))

    def work(_: tuple, lefts: list[tuple], rights: list[tuple]) -> Iterator[list]:
        (l_ords, l_names), (r_ords, r_names) = zip(*lefts), zip(*rights)
        l_ords, r_ords = np.array(l_ords, np.int64), np.array(r_ords, np.int64)
        (l_texts, l_at), (r_texts, r_at) = cells.numbered(l_names), cells.numbered(r_names)
        lengths = [np.array([-1 if t is None else len(t) for t in texts], np.int32) for texts in (l_texts, r_texts)]  # -1: no name
        shared = cells.shared_characters([t or "" for t in l_texts], [t or "" for t in r_texts]).astype(np.int32)
        for part in cells.slices(len(l_ords), len(r_ords)):
            i, j = np.nonzero(l_ords[part, None] < r_ords[None, :])
            l_text, r_text = l_at[part][i], r_at[j]
            yield [l_ords[part][i], r_ords[j], lengths[0][l_text], lengths[1][r_text], shared[l_text, r_text]]

    rows = cells.in_cells(left, right, ["domain", "l_block", "r_block"], "l_ord long, r_ord long, l_length int, r_length int, shared int", work)
    total, known = F.col("l_length") + F.col("r_length"), (F.col("l_length") >= 0) & (F.col("r_length") >= 0)
    bound = lambda n: F.when(total == 0, 1.0).when(known, 2.0 * n / total)
    kind = entries.schema["ord"].dataType
    return rows.select(F.col("l_ord").cast(kind).alias("l_ord"), F.col("r_ord").cast(kind).alias("r_ord"), bound(F.least("l_length", "r_length")).alias("by_length"), bound(F.col("shared")).alias("by_characters"))


def with_both(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs(l_doc, r_doc) whose documents both have clauses."""
    docs = found.select("doc_id").distinct()
    return pairs.join(docs.withColumnRenamed("doc_id", "l_doc"), "l_doc", "left_semi").join(docs.withColumnRenamed("doc_id", "r_doc"), "r_doc", "left_semi")


def length_bound(a: Column, b: Column) -> Column:
    """The ratio is at most this, by the lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)


def character_counts(c: Column) -> Column:
    """A map of how often each character occurs."""
    letters = F.split(c, "")
    keys = F.array_distinct(letters)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.length(c) - F.length(F.replace(c, k, F.lit("")))))


def character_bound(a: Column, b: Column, counts_a: Column | None = None, counts_b: Column | None = None) -> Column:
    """The ratio is at most this, by the characters that both have; their counts may have been made before."""
    ca, cb = character_counts(a) if counts_a is None else counts_a, character_counts(b) if counts_b is None else counts_b
    shared = F.aggregate(F.map_values(F.map_zip_with(ca, cb, lambda _, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))), F.lit(0), lambda s, x: s + x)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)


def ratio(left: str, right: str, autojunk: bool = False) -> Column:
    """The matching-blocks ratio of two columns, right first as the order decides; rows of one left should follow each other."""

    def ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = SequenceMatcher(None, autojunk=autojunk)
        last = None
        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                if x != last:
                    m.set_seq2(x or "")
                    last = x
                m.set_seq1(y or "")
                out.append(m.ratio())
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(ratios, "double", F.PandasUDFType.SCALAR_ITER)(left, right)


def scored_pairs(pairs: DataFrame, found: DataFrame, floor: float = X.MATCH_FLOOR) -> DataFrame:
    """(l_doc, r_doc, l_ord, r_ord, score) of clause pairs that reach the floor, in pairs(l_doc, r_doc) of documents.

    Clauses meet in cells. Equal texts of a document are in one block as far as it holds them, and two texts are compared once in a cell however many
    clauses have them, and mostly once by a worker. The bounds by length and by characters lose nothing and go before the exact ratio.
    """
    keys = found.select("doc_id", F.col("clause_ord").cast("int").alias("ord"), match_key(F.col("heading"), F.col("text")).alias("key")).where("key is not null")
    sizes = keys.groupBy("doc_id").agg(F.ceil(F.approx_count_distinct("key") / TEXTS).cast("int").alias("_texts"), F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("doc_id", "_texts", F.ceil(F.col("_n") / (F.col("_texts") * CLAUSES)).cast("int").alias("_copies"))
    block = F.pmod(F.hash("key"), F.col("_texts")) * F.col("_copies") + F.pmod(F.hash("ord"), F.col("_copies"))
    placed = keys.join(sizes, "doc_id").select("doc_id", "ord", "key", block.alias("block"), (F.col("_texts") * F.col("_copies")).alias("blocks"))
    both, cell = pairs.select("l_doc", "r_doc").distinct(), ["l_doc", "r_doc", "l_block", "r_block"]
    blocks = placed.groupBy("doc_id").agg(F.max("blocks").alias("blocks"))
    others = lambda s: blocks.select(F.col("doc_id").alias(f"{s}_doc"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(f"{s}_block"))
    side = lambda s, o: both.join(others(o), f"{o}_doc").join(placed.select(F.col("doc_id").alias(f"{s}_doc"), F.col("block").alias(f"{s}_block"), "ord", "key"), f"{s}_doc").select(*cell, "ord", "key")

    def work(here: tuple, lefts: list[tuple], rights: list[tuple]) -> Iterator[list]:
        (l_ords, l_keys), (r_ords, r_keys) = zip(*lefts), zip(*rights)
        l_ords, r_ords = np.array(l_ords, np.int32), np.array(r_ords, np.int32)
        (l_texts, l_at), (r_texts, r_at) = cells.numbered(l_keys), cells.numbered(r_keys)
        score = ratios(l_texts, r_texts, floor)
        for part in cells.slices(len(l_ords), len(r_ords)):
            i, j = np.nonzero(score[l_at[part][:, None], r_at[None, :]] >= floor)
            yield [*(pa.repeat(pa.scalar(v), len(i)) for v in here[:2]), l_ords[part][i], r_ords[j], score[l_at[part][i], r_at[j]]]

    kind = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in ("l_doc", "r_doc"))
    return cells.in_cells(side("l", "r"), side("r", "l"), cell, f"{kind}, l_ord int, r_ord int, score double", work)


class Matching:
    """How many characters pairs of texts match in, as far as a worker remembers: documents of a kind have the same texts.

    A pair has one place in a table, which a later one may take. Texts are numbered; beyond so many characters of them all is forgotten.
    """

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.chars, self.worked_out = 0, 0
        self.table = np.zeros(KNOWN, [("pair", np.int64), ("count", np.int32)])

    def numbered(self, *sides: list[str]) -> list[np.ndarray]:
        """The numbers of the texts of each side, from 1 on; they hold until this is called again."""
        if self.chars > KNOWN_CHARS:
            self.__init__()
        for t in (t for texts in sides for t in texts if t not in self.place):
            self.place[t] = len(self.place) + 1
            self.chars += len(t)
        return [np.array([self.place[t] for t in texts], np.int64) for texts in sides]

    def counts(self, x: str, n: int, others: list[str], numbers: np.ndarray) -> np.ndarray:
        """For text x of number n and each of others."""
        pair = numbers | n << 32
        at = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & len(self.table) - 1
        held = self.table[at]
        new = np.flatnonzero(held["pair"] != pair)
        if len(new):
            masks = places(x)
            held["pair"] = pair
            held["count"][new] = [matching_characters(masks, x, others[j]) for j in new.tolist()]
            self.table[at[new]] = held[new]
            self.worked_out += len(new)
        return held["count"]


@lru_cache(1)
def _matching() -> Matching:
    return Matching()


def ratios(lefts: list[str], rights: list[str], floor: float) -> np.ndarray:
    """The matching-blocks ratio of each of lefts with each of rights; -1 where a bound is below the floor."""
    sizes = np.array([len(t) for t in rights], np.int64)
    shared = cells.shared_characters(lefts, rights)
    out, known = np.full(shared.shape, -1.0), _matching()
    l_numbers, r_numbers = known.numbered(lefts, rights)
    for row, x, n, common in zip(out, lefts, l_numbers, shared):
        total = sizes + len(x)
        bound = np.where(total == 0, 1.0, 2.0 * np.minimum(common, np.minimum(sizes, len(x))) / np.maximum(total, 1))
        at = np.flatnonzero(bound >= floor)
        if len(at):
            counts = known.counts(x, n, [rights[j] for j in at.tolist()], r_numbers[at])
            row[at] = np.where(total[at] == 0, 1.0, 2.0 * counts / np.maximum(total[at], 1))
    return out


def matched(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """All results of each pair: matches, left clauses without one (score 0) and right clauses without one, as structs."""
    links = best_matches(pairs, found.select("doc_id", "clause_ord", match_key(F.col("heading"), F.col("text")).alias("key")))
    clause = F.struct("clause_ord", "id", "heading", "text", "start_page", "end_page")
    left = pairs.select("l_doc", "r_doc").join(found.select(F.col("doc_id").alias("l_doc"), F.col("clause_ord").alias("l_ord"), clause.alias("left")), "l_doc")
    right = pairs.select("l_doc", "r_doc").join(found.select(F.col("doc_id").alias("r_doc"), F.col("clause_ord").alias("r_ord"), clause.alias("right")), "r_doc")
    mine = left.join(links, ["l_doc", "r_doc", "l_ord"], "left")
    both = mine.join(right, ["l_doc", "r_doc", "r_ord"], "full")
    return both.select("l_doc", "r_doc", "left", "right", F.coalesce("score", F.lit(0.0)).alias("score"))


def classified(results: DataFrame) -> DataFrame:
    """results(left, right, score) with change_type, risk, summary and evidence. The first rule that holds decides."""
    # one side alone decides by itself, and most results may be such: what texts say is looked for only where there are two
    two = F.col("left").isNotNull() & F.col("right").isNotNull()
    both = lambda c: F.when(two, c)
    lt, rt, score = both(F.col("left.text")), both(F.col("right.text")), F.col("score")
    rows = results.withColumns({"_ln": T.normalized(lt), "_rn": T.normalized(rt), "_lv": F.array_sort(T.requirement_numbers(lt)), "_rv": F.array_sort(T.requirement_numbers(rt))})
    rows = rows.withColumn("_all", F.concat_ws(" ", "_ln", "_rn"))
    refs = F.array_sort(T.references(lt)) != F.array_sort(T.references(rt))
    shown = lambda c: F.concat(F.lit("["), F.array_join(F.transform(F.slice(c, 1, 8), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    numbers = F.concat(F.lit("检测到数值或单位集合变化：左侧 "), shown("_lv"), F.lit("；右侧 "), shown("_rv"), F.lit("。"))
    words = lambda w: T.any_of(F.col("_all"), w)
    rules = [
        (F.col("left").isNull() & F.col("right").isNotNull(), "新增要求", "中", F.lit("右侧文档包含左侧未匹配到的条款。")),
        (F.col("right").isNull() & F.col("left").isNotNull(), "删除要求", "中", F.lit("左侧文档中的条款在右侧未匹配到。")),
        (F.col("left").isNull(), X.NO_VERDICT, "高", F.lit("缺少可比较文本。")),
        (F.col("_ln") == F.col("_rn"), "无实质变化", "低", F.lit("两个条款文本一致或高度一致。")),
        (score < 0.5, "疑似无对应条款", "中", F.lit("两个片段匹配度较低，暂不判定为实质数值变化。")),
        ((F.size("_lv") > 0) & (F.size("_rv") > 0) & (F.col("_lv") != F.col("_rv")), "阈值/数值变化", "高", numbers),
        ((score >= 0.82) & (F.least(F.length(lt), F.length(rt)) < 900), "相似条款/可能等效", "低", F.lit("两个片段高度相似，且未检测到明确技术阈值变化；更适合作为对应主题查看。")),
        (refs, "引用标准变化", "中", F.lit("检测到引用标准编号或标准清单变化。")),
        (words(X.TEST_WORDS), "测试方法变化", "高", F.lit("差异出现在测试、试验或方法相关条款中，需要工程确认。")),
        (words(X.SCOPE_WORDS), "适用范围变化", "高", F.lit("差异出现在适用范围相关条款中。")),
        (words(X.DEFINITION_WORDS), "定义变化", "中", F.lit("差异出现在定义或术语相关条款中。")),
        (score >= 0.9, "措辞变化", "低", F.lit("文本高度相似，初步判断更可能是措辞或格式变化。")),
        (F.lit(True), "内容修改", "中", F.lit("条款内容存在可见修改。")),
    ]
    verdict = F.lit(None)
    for cond, kind, risk, summary in reversed(rules):
        verdict = F.when(cond, F.struct(F.lit(kind).alias("change_type"), F.lit(risk).alias("risk"), summary.alias("summary"))).otherwise(verdict)
    evidence = F.filter(F.array(T.quote(F.col("left.text")), T.quote(F.col("right.text"))), lambda x: x.isNotNull())
    return rows.withColumn("_v", verdict).select(*results.columns, "_v.change_type", "_v.risk", "_v.summary", evidence.alias("evidence"))


def type_rank(c: Column) -> Column:
    return T.ranked(c, X.TYPE_RANK)


def risk_rank(c: Column) -> Column:
    return T.ranked(c, X.RISK_RANK)


def ordered(results: DataFrame, *by: str) -> DataFrame:
    """Classified results of each group with result_ord: by type, risk and score downwards, then in the order of the documents."""
    order = [type_rank(F.col("change_type")).desc(), risk_rank(F.col("risk")).desc(), F.col("score").desc(), F.col("left.clause_ord").asc_nulls_last(), F.col("right.clause_ord").asc_nulls_last()]
    return results.withColumn("result_ord", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def conclusion(results: DataFrame, *by: str, top: int = 0) -> DataFrame:
    """One row for each group of ordered results: counts of types and risks, headline, caveats and the first six findings of substance.

    top: how many of the first results come along as top_results. Types of substance rank before all others, so the first six of
    them are among the first six results, and no group is collected beyond these.
    """
    kind = F.col("change_type")
    score = F.round("score", 3).alias("score")
    finding = F.struct("result_ord", "change_type", "risk", score, F.coalesce("left.heading", "right.heading", F.lit("未命名条款")).alias("heading"), "summary")
    result = F.struct("result_ord", "change_type", "risk", score, F.coalesce("left.heading", F.lit("")).alias("left_heading"), F.coalesce("right.heading", F.lit("")).alias("right_heading"), "summary")

    def counted(c: str, values) -> Column:
        names = sorted(values)
        found = F.map_from_arrays(F.array(*[F.lit(v) for v in names]), F.array(*[F.count_if(F.col(c) == v) for v in names]))
        return F.map_filter(found, lambda _, n: n > 0).alias(c + "_counts")

    out = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kind.isin(*X.SUBSTANTIVE)).alias("substantive"), F.count_if(kind == "新增要求").alias("additions"), F.count_if(kind == "删除要求").alias("deletions"),
        F.count_if(kind == "疑似无对应条款").alias("low_confidence"), counted("change_type", [*X.TYPE_RANK, X.NO_VERDICT]), counted("risk", X.RISK_RANK),
        F.array_sort(F.collect_list(F.when(kind.isin(*X.SUBSTANTIVE) & (F.col("result_ord") <= 6), finding))).alias("key_findings"),
        *([F.array_sort(F.collect_list(F.when(F.col("result_ord") <= top, result))).alias("top_results")] if top else []),
    )
    n = lambda c: F.col(c).cast("string")
    headline = (
        F.when(F.col("substantive") > 0, F.concat(F.lit("初步结论：两份文档存在 "), n("substantive"), F.lit(" 条可能影响工程判断的实质差异。")))
        .when((F.col("additions") > 0) | (F.col("deletions") > 0), F.concat(F.lit("初步结论：未发现明确的同条款实质修改，但存在 "), n("additions"), F.lit(" 条新增和 "), n("deletions"), F.lit(" 条删除/未匹配条款。")))
        .otherwise("初步结论：未发现明显实质差异，主要差异可能来自格式、目录或低置信度匹配。")
    )
    caveats = F.filter(
        F.array(
            F.when(F.col("low_confidence") > 0, F.concat(F.lit("有 "), n("low_confidence"), F.lit(" 条低匹配度结果，建议人工确认后再用于合规结论。"))),
            F.when((F.col("additions") + F.col("deletions")) / F.col("total") > 0.35, F.lit("新增/删除占比较高，可能是文档结构、目录、样页或版本范围不一致导致。")),
            F.lit("本摘要基于本地文本解析和规则分类，最终法规解释仍需查看原文证据。"),
        ),
        lambda x: x.isNotNull(),
    )
    return out.withColumns({"headline": headline, "caveats": caveats, "low_confidence_ratio": F.round(F.col("low_confidence") / F.greatest(F.col("total"), F.lit(1)), 3)})


def _views() -> dict[str, Column]:
    """actionable: types of substance; high: of high risk; parameter: about values; all."""
    return {
        "actionable": F.col("change_type").isin(*X.SUBSTANTIVE), "high": F.col("risk") == "高",
        "parameter": (F.col("change_type") == "阈值/数值变化") | F.contains("summary", F.lit("数值")) | F.contains("summary", F.lit("单位")), "all": F.lit(True),
    }


def filtered(results: DataFrame, view: str) -> DataFrame:
    """The results that are in one of the views."""
    return results.where(_views()[view])


def in_views(results: DataFrame) -> DataFrame:
    """results once for each view that they are in, named by view; a result is worked out once, however many views have it."""
    views = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in _views().items()]))
    return results.select("*", F.explode(views).alias("view"))


_HITS = "array<struct<label:string,value:string,unit:string,context:string,low:string,start:string>>"


def parameter_hits(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, hit_ord, label, value, unit, context) of clauses(keys, text): the first eight distinct quantities of each.

    A clause is worked on in its own row, so nothing is shuffled.
    """
    return found.select(*keys, F.posexplode(hits(F.col("text"))).alias("n", "h")).select(*keys, (F.col("n") + 1).alias("hit_ord"), "h.label", "h.value", "h.unit", "h.context")


def hits(text: Column) -> Column:
    """The first eight distinct quantities of a clause, in order."""

    def hits_of(sentence: Column) -> Column:
        return T.by_script(sentence, hits_by)

    def hits_by(sentence: Column, of) -> Column:
        # what several expressions need is worked out once: the lower-cased sentence, then each match's unit, then its value
        def hit(m: Column, low: Column) -> Column:
            number = T.compact(F.regexp_extract(m, of(X.PARAMETER_VALUE), 1))
            made = lambda unit, value: F.struct(T.label_of(low, unit).alias("label"), value.alias("value"), unit.alias("unit"), T.excerpt(sentence, 260).alias("context"), F.lower(value).alias("low"), F.substring(low, 1, 80).alias("start"))
            return T.let(T.let(F.regexp_extract(m, of(X.PARAMETER_VALUE), 2), T.normalized_unit), lambda unit: T.let(F.concat_ws(" ", number, unit), lambda value: made(unit, value)))

        found = F.regexp_extract_all(sentence, F.lit(of(X.PARAMETER_VALUE)), 0)
        return F.filter(T.let(F.lower(sentence), lambda low: F.transform(found, lambda m: hit(m, low))), lambda h: h["unit"] != "")

    def first_of(kept: Column, hit: Column) -> Column:
        known = F.exists(kept, lambda k: (k["label"] == hit["label"]) & (k["low"] == hit["low"]) & (k["start"] == hit["start"]))
        return F.when((F.size(kept) >= X.HITS_PER_CLAUSE) | known, kept).otherwise(F.concat(kept, F.array(hit)))

    # sentences without a digit have no quantity
    telling = F.filter(T.sentences(text), lambda s: s.rlike("[0-9]"))
    return F.aggregate(F.flatten(F.transform(telling, hits_of)), F.array().cast(_HITS), first_of)


def parameter_matrix(results: DataFrame, *by: str, limit: int = X.MATRIX_ROWS) -> DataFrame:
    """Rows of labels side by side, of classified results(by, result_ord, left, right): where values differ, or one side has
    none, or the change is of values, tests or scope. The most telling limit rows of each group. A side's location is there where it
    has a value, its heading where it has a clause."""
    # a group's results may lie in one task, and the work is in their texts; a result finds its labels in its own row
    rows = cells.spread(results.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.lit(True))), *by, "result_ord")
    none = F.array().cast(_HITS)
    rows = T.once(rows, **{f"_{s}_hits": F.coalesce(hits(F.col(f"{s}.text")), none) for s in ("left", "right")})
    labels = F.array_distinct(F.transform(F.concat("_left_hits", "_right_hits"), lambda h: h["label"]))
    rows = rows.withColumn("label", F.explode(labels))
    rows = rows.withColumns({f"_{s}": F.filter(f"_{s}_hits", lambda h: h["label"] == F.col("label")) for s in ("left", "right")})
    distinct = lambda s: F.array_distinct(F.transform(f"_{s}", lambda h: h["value"]))
    place = lambda s: F.concat(F.lit("P"), F.col(f"{s}.start_page").cast("string"), F.lit("-"), F.col(f"{s}.end_page").cast("string"))
    located = [F.when(F.size(f"_{s}") > 0, place(s)).otherwise("").alias(f"{s}_location") for s in ("left", "right")]
    headings = [F.coalesce(f"{s}.heading", F.lit("")).alias(f"{s}_heading") for s in ("left", "right")]
    values = [F.array_join(F.slice(distinct(s), 1, 8), "；").alias(f"{s}_values") for s in ("left", "right")]
    contexts = [F.coalesce(F.get(f"_{s}", F.lit(0))["context"], F.lit("")).alias(f"{s}_context") for s in ("left", "right")]
    changed = (F.array_sort(distinct("left")) != F.array_sort(distinct("right"))).alias("changed")
    rows = rows.select(*by, "result_ord", "label", "change_type", "risk", F.round("score", 3).alias("score"), changed, *values, *contexts, *located, *headings)
    rows = rows.where(F.col("changed") | F.col("change_type").isin("阈值/数值变化", "测试方法变化", "适用范围变化"))
    order = [F.col("changed").desc(), risk_rank(F.col("risk")).desc(), T.ranked(F.col("label"), X.LABEL_RANK).desc(), F.col("score").desc(), F.col("result_ord"), F.col("label")]
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("row_ord", n).where(F.col("row_ord") <= limit).select(
        *by, "row_ord", F.col("label").alias("parameter"), "change_type", "risk", "score", "changed", "left_values", "right_values", "left_context", "right_context", "left_location", "right_location",
        "left_heading", "right_heading",
    )
