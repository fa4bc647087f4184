"""Source divergence audit: which terms a source uses more than its language does, and how far sources lie apart.

1. Every task counts in how many of its documents each (language, term) stands, and adds these counts to a count-min sketch whose
   counters stop at MIN_DOCS. Merged, a counter is never below the true number, so a term whose smallest counter is lower can't
   be kept. The sketch has a fixed size (DEPTH * 2^WIDTH_BITS bytes): with more distinct rare terms than counters it lets more
   of them through, and never loses one.
2. A second pass drops impossible terms before anything is shuffled; for the others occurrences and documents are counted exactly.
3. Sums over all kept terms of two sources come from sparse parts: a term that neither has adds the same amount every time,
   one that only one of them has depends on its count there alone, and only terms that both have take a join, on the term. Counts
   are put together before the arithmetic: (count here, count there, number of terms).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, settled, table

#: Documents of a language that must hold a term, and the whole to which probabilities are scaled.
MIN_DOCS, WHOLE = 3, 1_000_000_000
#: Terms that are listed for a group.
TOP_TERMS = 200
#: Rows of the sketch, counters in a row (a power of two), and parts in which it is added up. All fixed.
DEPTH, WIDTH_BITS, SLICES = 4, 22, 16
#: Bytes of a text that are split into terms together, and distinct entries after which counts are handed on.
CHUNK, ENTRIES = 1 << 20, 1 << 19
#: Upper case becomes lower case, all else of ASCII that is no letter a blank; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_parts(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of those of about CHUNK bytes."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        part = data[at:end].translate(_FOLD)
        if end < len(data):
            cut = part.rfind(b" ")
            while cut < 0 and end < len(data):  # a term that is longer than what is split together
                part += data[end : end + CHUNK].translate(_FOLD)
                end += CHUNK
                cut = part.rfind(b" ")
            if cut >= 0 and end < len(data):
                at, part = at + cut + 1, part[:cut]
            else:
                at = len(data)
        else:
            at = len(data)
        yield part.split()


def _counted(batches: Iterator[pa.RecordBatch], sources: bool, hand_on: Callable[[dict, dict], object]) -> Iterator[object]:
    """What hand_on gives for counts by language (and source): occurrences and documents, whenever there are many entries."""
    often: dict[object, Counter] = {}
    held: dict[object, Counter] = {}
    for b in batches:
        texts, langs = b.column(0).cast(pa.large_binary()), b.column(1).to_pylist()
        keys = list(zip(langs, b.column(2).to_pylist())) if sources else langs
        for text, key in zip(texts, keys):
            mine, docs = often.setdefault(key, Counter()), held.setdefault(key, Counter())
            seen: set[bytes] = set()
            for terms in term_parts(text.as_py()):
                if sources:
                    mine.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(map(len, held.values())) >= ENTRIES:
            yield hand_on(often, held)
            often, held = {}, {}
    yield hand_on(often, held)


def term_hashes(lang: str, terms: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))


def slots(h: np.ndarray, row: int) -> np.ndarray:
    """The counters of these hashes in a row of the sketch: double hashing with an odd step."""
    return ((h + np.uint64(row) * ((h >> np.uint64(32)) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - WIDTH_BITS)).view(np.int64)


class Sketch:
    """Counters that stop at MIN_DOCS, so that one byte holds them."""

    def __init__(self, counters: np.ndarray | None = None) -> None:
        self.counters = np.zeros((DEPTH, 1 << WIDTH_BITS), np.uint8) if counters is None else counters

    def add(self, h: np.ndarray, counts: np.ndarray) -> None:
        counts = np.minimum(counts, MIN_DOCS)
        for row, held in enumerate(self.counters):
            at, of = np.unique(slots(h, row), return_inverse=True)
            held[at] = np.minimum(held[at] + np.minimum(np.bincount(of, counts, len(at)), MIN_DOCS), MIN_DOCS)

    def possible(self, h: np.ndarray) -> np.ndarray:
        """False only for what was added fewer than MIN_DOCS times."""
        out = np.ones(len(h), bool)
        for row, held in enumerate(self.counters):
            out &= held[slots(h, row)] >= MIN_DOCS
        return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = Sketch()

    def add(_: dict, held: dict) -> None:
        for lang, docs in held.items():
            sketch.add(term_hashes(lang, list(docs)), np.fromiter(docs.values(), np.int64, len(docs)))

    for _ in _counted(batches, False, add):
        pass
    parts = [pa.compress(p.tobytes(), "zstd", asbytes=True) for p in np.split(sketch.counters.reshape(-1), SLICES)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counters"])


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, (DEPTH << WIDTH_BITS) // SLICES, "zstd", asbytes=True), np.uint8)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1)):
            part = _unpacked(data.as_py())
            found[k] = np.minimum(found[k] + part, MIN_DOCS).astype(np.uint8) if k in found else part
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([pa.compress(c.tobytes(), "zstd", asbytes=True) for c in found.values()], pa.binary())], ["slice", "counters"])


def document_sketch(docs: DataFrame) -> Sketch:
    """The count-min sketch of document frequencies by (lang, term) of docs(text, lang, ..) without nulls. Its size is fixed."""
    kind = "slice int, counters binary"
    rows = docs.select("text", "lang").mapInArrow(_sketched, kind).repartitionById(SLICES, "slice").mapInArrow(_merged, kind).collect()
    counters = np.zeros((SLICES, (DEPTH << WIDTH_BITS) // SLICES), np.uint8)
    for r in rows:
        counters[r["slice"]] = _unpacked(bytes(r["counters"]))
    return Sketch(counters.reshape(DEPTH, -1))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, lang_n): occurrences of each kept term in a source of its language that has it, and in the language.

    docs(text, lang, source) without nulls; each row is a document.
    """
    sent = docs.sparkSession.sparkContext.broadcast(document_sketch(docs).counters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(sent.value)

        def rows(often: dict, held: dict) -> list[pa.RecordBatch]:
            out = []
            for (lang, source), docs in held.items():
                kept = np.flatnonzero(sketch.possible(term_hashes(lang, terms := list(docs)))).tolist()
                terms, n = [terms[i] for i in kept], often[lang, source]
                same = lambda v: pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(terms), np.int32)), pa.array([v])).cast(pa.string())
                out.append(pa.RecordBatch.from_arrays([same(lang), pa.array(terms, pa.binary()).cast(pa.string(), safe=False), same(source), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], ["lang", "term", "source", "n", "docs"]))
            return out

        for out in _counted(batches, True, rows):
            yield from out

    found = docs.select("text", "lang", "source").mapInArrow(count, "lang string, term string, source string, n long, docs long")
    exact = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return exact.select("lang", "term", "source", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n")).where(F.col("docs") >= MIN_DOCS).drop("docs")


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (n + 1) / (total + kept)), in whole numbers; the product goes beyond a long where counts pass 9 * 10^9."""
    return F.lit(1) + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(WHOLE), (total + kept).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def source_pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each ordered pair of sources of a language the summed divergence over all kept terms.

    groups(g, lang, source, total, kept), counts(g, lang, term, n).
    """
    side = lambda s, *more: groups.select(*more, F.col("g").alias(f"{s}_g"), F.col("source").alias(f"{s}_source"), F.col("total").alias(f"{s}_total"))
    pairs = side("p", "lang", "kept").join(side("q", "lang"), "lang").where(F.col("p_g") != F.col("q_g"))
    P = lambda n: probability(n, F.col("p_total"), F.col("kept"))
    Q = lambda n: probability(n, F.col("q_total"), F.col("kept"))
    none = F.lit(0).cast("long")
    neither = divergence(P(none), Q(none))
    some = pairs.where(F.col("kept") > 0)
    delta = lambda c, terms: (_exact(c) * _exact(terms)).cast("decimal(38,0)").alias("part")
    by = ["lang", "p_source", "q_source"]
    alike = counts.groupBy("g", "n").agg(F.count(F.lit(1)).alias("terms"))
    only_p = some.join(alike.withColumnRenamed("g", "p_g"), "p_g").select(*by, delta(divergence(P(F.col("n")), Q(none)) - neither, F.col("terms")))
    only_q = some.join(alike.withColumnRenamed("g", "q_g"), "q_g").select(*by, delta(divergence(P(none), Q(F.col("n"))) - neither, F.col("terms")))
    a = counts.select("lang", "term", F.col("g").alias("a_g"), F.col("n").alias("a_n"))
    b = counts.select("lang", "term", F.col("g").alias("b_g"), F.col("n").alias("b_n"))
    shared = a.join(b, ["lang", "term"]).where(F.col("a_g") < F.col("b_g")).groupBy("a_g", "a_n", "b_g", "b_n").agg(F.count(F.lit(1)).alias("terms"))
    ways = shared.select("terms", F.explode(F.array(*[F.struct(F.col(f"{x}_g").alias("p_g"), F.col(f"{x}_n").alias("p_n"), F.col(f"{y}_g").alias("q_g"), F.col(f"{y}_n").alias("q_n")) for x, y in ("ab", "ba")])).alias("w")).select("terms", "w.*")
    p_n, q_n = F.col("p_n"), F.col("q_n")
    # Each of the four is below 2^60, so that their sum fits
    both = some.join(ways, ["p_g", "q_g"]).select(*by, delta(divergence(P(p_n), Q(q_n)) - divergence(P(p_n), Q(none)) - divergence(P(none), Q(q_n)) + neither, F.col("terms")))
    base = pairs.select(*by, F.when(F.col("kept") > 0, (_exact(neither) * _exact(F.col("kept"))).cast("decimal(38,0)")).otherwise(_exact(F.lit(0))).alias("part"))
    whole = base.unionByName(only_p).unionByName(only_q).unionByName(both).groupBy(*by).agg(F.sum("part").alias("value"))
    return whole.select("lang", F.col("p_source").alias("source"), F.col("q_source").alias("item"), F.col("value").cast("long").alias("value"))


def audit(docs: DataFrame, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part 'pair' ranks the other sources of the language, 'term' the terms that a
    source uses more than its language.

    Of docs only text, lang and source are read; nulls count as ''. Each row is a document, repeated ones too. Terms are runs of ASCII
    letters and of characters beyond ASCII, A-Z lower-cased, of whole texts. A language without kept terms has pairs of value 0.
    Ties stand in the order of the items' bytes. An empty table gives no rows.
    """
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = settled(term_counts(plain))
    kept = counts.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    occurring = plain.select("lang", "source").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = settled(occurring.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").select(F.monotonically_increasing_id().alias("g"), "lang", "source", zero("total"), zero("kept"), zero("lang_total")))
    coded = counts.join(groups.select("g", "lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    pair = source_pairs(groups, coded.select("g", "lang", "term", "n")).withColumn("part", F.lit("pair"))
    p, q = probability(F.col("n"), F.col("total"), F.col("kept")), probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    term = coded.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where(F.col("p") > F.col("q"))
    term = term.select("lang", "source", "part", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    out = settled(pair.select("*", rank).select(*columns).unionByName(term.select("*", rank).where(F.col("rank") <= top_terms).select(*columns)))
    forget(counts, groups)
    return out


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), t AS (
  SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), g AS (
  SELECT DISTINCT lang, source FROM d
), v AS (
  SELECT lang, count(*)::HUGEINT AS kept, sum(lang_n)::HUGEINT AS lang_total FROM k GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term
), s AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 1)) // (s.total + v.kept) AS p,
         1 + (1000000000 * (k.lang_n::HUGEINT + 1)) // (v.lang_total + v.kept) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term)
  FROM (SELECT lang, source, term, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
