"""All pairs of two sides, dealt out in cells: a block of left rows and a block of right ones that meet in one task.

A cell's size is bounded however large a group is, and cells are dealt out by number, so that tasks share the work of small rows with many pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one side of a cell, and pairs that a cell puts out at once.
BLOCK, PAIRS_AT_ONCE = 2048, 1 << 17


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows parted by keys, in so many parts that none is brought together with others for being small."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def blocked(rows: DataFrame, within: str, by: str) -> DataFrame:
    """rows with the number of blocks of their group, _blocks, and the block of each, _block."""
    sizes = rows.groupBy(within).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    return rows.join(sizes, within).withColumn("_block", F.pmod(F.hash(by), F.col("_blocks")))


def both_sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocked rows as lefts and as rights, once for each cell(l_block, r_block) of their group."""
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = rows.select("*", F.col("_block").alias("l_block"), other.alias("r_block")).drop("_block", "_blocks")
    right = rows.select("*", other.alias("l_block"), F.col("_block").alias("r_block")).drop("_block", "_blocks")
    return left, right


def in_cells(left: DataFrame, right: DataFrame, cell: list[str], kind: str, work: Callable[[tuple, list[tuple], list[tuple]], Iterator[list]]) -> DataFrame:
    """What work(cell, lefts, rights) puts out as lists of columns of the schema kind, for each cell that has both.

    left and right have the columns of the cell, then the same others, which work gets as tuples.
    """
    rows = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)))
    rows = spread(rows.select(*cell, "_left", *[c for c in left.columns if c not in cell]), *cell).sortWithinPartitions(*cell)
    width = len(cell)
    schema = rows.sparkSession.createDataFrame([], kind).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema).types
        made = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        now, sides = None, ([], [])
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:width] != now:
                    if sides[0] and sides[1]:
                        yield from map(made, work(now, *sides))
                    now, sides = row[:width], ([], [])
                sides[0 if row[width] else 1].append(row[width + 1 :])
        if sides[0] and sides[1]:
            yield from map(made, work(now, *sides))

    return rows.mapInArrow(run, kind)


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct texts, and the place of each text among them."""
    place: dict[str, int] = {}
    at = np.array([place.setdefault(t, len(place)) for t in texts], np.int64)
    return list(place), at


def shared_characters(lefts: list[str], rights: list[str]) -> np.ndarray:
    """How many characters each of lefts has in common with each of rights."""
    column = {c: i for i, c in enumerate(sorted({c for t in rights for c in t}))}

    def counts(t: str) -> np.ndarray:
        row = np.zeros(len(column), np.int32)
        for c, n in Counter(t).items():
            if c in column:
                row[column[c]] = n
        return row

    table = np.array([counts(t) for t in rights], np.int32).reshape(len(rights), len(column))
    return np.array([np.minimum(table, counts(t)).sum(1) for t in lefts], np.int64).reshape(len(lefts), len(rights))


def slices(lefts: int, rights: int) -> Iterator[slice]:
    """Parts of the lefts whose pairs with all rights are put out at once."""
    step = max(1, PAIRS_AT_ONCE // max(1, rights))
    return (slice(i, i + step) for i in range(0, lefts, step))
