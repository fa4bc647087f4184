"""What several operators of this subpackage share: table access, shared storage, held-out rows and word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, settled, shared_dir  # noqa: F401  operators take them from here

#: Space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forget(*frames: DataFrame) -> None:
    """Deletes the tables of settled frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def barrier(df: DataFrame, column: str) -> DataFrame:
    """df, with a column that no filter or projection above is pushed below: what it takes to make it is worked out once a row."""
    return df.select(*quoted([c for c in df.columns if c != column]), F.explode(F.array(F.col(column))).alias(column))


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left joined to right, which has been grouped by the key, where a few keys may hold most rows of left.

    Adaptive execution splits a skewed join only if both sides were shuffled for the join itself; what a grouping has dealt out
    is taken as it is, with a hot key in one task. With the key's hash as a second key both sides are dealt out anew.
    """
    more = lambda df: df.withColumn("_key_hash", F.xxhash64(on))
    return more(left).join(more(right), [on, "_key_hash"], how).drop("_key_hash")


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels no model may see: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most max_rows labelled documents that aren't held out, in the order of a hash of the id.

    The bound makes the sample safe to broadcast (16 bytes a row). Where a document has several labels the largest counts.
    """
    return (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )


def quoted(names: list[str]) -> list[Column]:
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are hashed together, and the longest word that is hashed with others.
CHUNK, LONG_WORD = 1 << 17, 1 << 12
_BLANK = np.zeros(256, bool)
_BLANK[[*ASCII_SPACE.encode()]] = True
_BYTE = np.random.default_rng(3).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
# powers of an odd number and of its inverse modulo 2^64, so that a word's hash doesn't depend on where it stands
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, _MIX)]))
_INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(CHUNK, np.uint64(pow(int(_MIX), -1, 1 << 64)))]))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of at most CHUNK bytes: runs of anything but ASCII white space, parted at cuts too."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    black, cut = ~_BLANK[data], np.zeros(n + 1, bool)
    cut[cuts] = cut[0] = cut[n] = True
    begins, ends = cut[:n].copy(), cut[1:].copy()
    begins[1:] |= ~black[:-1]
    ends[:-1] |= ~black[1:]
    first, last = np.flatnonzero(black & begins), np.flatnonzero(black & ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWERS[:n], out=sums[1:])
    h = mixed((sums[last] - sums[first]) * _INVERSES[first])
    for i in np.flatnonzero(last - first > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[first[i] : last[i]].tobytes())
    return h, first


def _long_text(data: np.ndarray) -> np.ndarray:
    """Word hashes of a text of any length, a part at a time; parts end at white space."""
    out, at, n = [], 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        if end < n:
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:  # one word that is longer than all that is hashed together
                while end < n and not len(blanks := np.flatnonzero(_BLANK[data[end : end + CHUNK]])):
                    end = min(end + CHUNK, n)
                end += int(blanks[0]) if end < n else 0
                out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end].tobytes())], np.uint64))
                at = end
                continue
        out.append(_words_of(data[at:end], np.zeros(0, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, 64-bit word hashes, words of each row) of rows that follow each other; a null has no words.

    The texts are read where Arrow has them. About CHUNK bytes, or one longer text, are hashed at a time.
    """
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data, at = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        if len(part) > CHUNK:
            h = _long_text(part)
            yield at, h, np.array([len(h)])
        else:
            cuts = offsets[at : to + 1] - offsets[at]
            h, first = _words_of(part, cuts)
            yield at, h, np.diff(np.searchsorted(first, cuts))
        at = to


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words, in order; fewer words are one window, none have none."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ words[i : len(words) - n + 1 + i]) * _MIX + np.uint64(i + 1)
        h ^= h >> np.uint64(29)
    return mixed(h)


def row_shingles(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, sizes, hashes, counts) of rows that follow each other: the distinct windows of n words of each row, in order,
    and how often each occurs. sizes has the number of them in each row."""
    for at, words, sizes in word_hashes(texts):
        windows, parts, end = window_hashes(words, n) if len(words) >= n else words[:0], [], 0
        for size in sizes.tolist():
            begin, end = end, end + size
            parts.append(np.sort(windows[begin : end - n + 1]) if size >= n else window_hashes(words[begin:end], n))
        h, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        starts = np.cumsum(lengths) - lengths
        new[starts[lengths > 0]] = True
        kept = np.flatnonzero(new)
        ends = np.searchsorted(kept, np.concatenate([starts, [len(h)]]))
        yield at, np.diff(ends), h[kept], np.diff(np.append(kept, len(h)))
