"""Greedy batches over groups of any size, and the lines around each.

A batch closes where the next text would not fit, so where one begins depends on all batches before it: a running total
with reset, which no window expresses. But the end of a batch follows from its begin alone. Texts get places in one order; blocks of BLOCK
places each work out, for every place near their begin where a batch may start (no batch has more than `lines` texts), where
the first batch of the next block then starts and how many batches that makes. These small tables are chained in levels, so
each block learns its real start, and numbers its batches in a second pass. No task holds a group, and the result doesn't depend on the
partitions.

Defined results: sizes under 1 and nulls count as 1; a text over the limit is a batch of its own; null groups are a group.
Equal orders within a group are told apart by a hash of the row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.shared import stored

#: Places in a block, tables that one task chains.
BLOCK, CHAIN = 1 << 16, 512


def numbered(rows: DataFrame, by: list[str], name: str = "place") -> DataFrame:
    """rows with their places (from 0) in the order of the columns by: ranges of the order are counted each on its own, and what is before each is added."""
    part, own = "part__", "own__"
    schema = T.StructType([*rows.schema.fields, T.StructField(part, T.LongType()), T.StructField(own, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, at)), pa.array(np.arange(n, n + b.num_rows))], names=schema.names)
            n += b.num_rows

    tied = F.xxhash64(*rows.columns)
    ranged = rows.withColumn("tie__", tied).repartitionByRange(*by, "tie__").sortWithinPartitions(*by, "tie__").drop("tie__")
    kept = stored(ranged.mapInArrow(run, schema), "places")
    # One row for each range.
    counts = kept.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return kept.join(F.broadcast(before), part).select(*rows.columns, (F.col("before") + F.col(own)).alias(name))


class _Block:
    """Places of a block (and of as many more as a batch may reach into the next)."""

    def __init__(self, table: pa.Table, most: int, lines: int, block: int):
        table = table.sort_by("place")
        place, size = table["place"].to_numpy(), np.maximum(table["size"].fill_null(1).to_numpy(), 1)
        self.place, n = place, len(place)
        group = table["grp"].to_numpy()
        total = np.concatenate([[0], np.cumsum(size)])
        fits = np.searchsorted(total, total[:-1] + most, side="right") - 1
        edges = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
        start = np.arange(n)
        #: Where a batch that starts at a place ends.
        self.end = np.minimum(np.minimum(np.maximum(fits, start + 1), start + lines), edges[np.searchsorted(edges, start, side="right")])
        self.n = min(n, block)

    def exits(self, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """By the place of the first start: the place of the next block's, and the number of batches."""
        at, count = np.arange(lines), np.zeros(lines, np.int64)
        while (go := at < self.n).any():
            at[go] = self.end[at[go]]
            count[go] += 1
        return np.maximum(at - self.n, 0), count

    def starts(self, at: int) -> np.ndarray:
        out = []
        while at < self.n:
            out.append(at)
            at = int(self.end[at])
        return np.array(out, np.int64)


_TABLE = "block long, next array<long>, n array<long>"
_ENTRY = "block long, start long, before long"
_LISTS = pa.list_(pa.int64())


def _rows(cols: list, types: list, names: list[str]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _chained(table: pa.Table, start: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of tables in order: block, and for each start of the first one the start in it and the batches before it."""
    table = table.sort_by("block")
    at, count = start.copy(), np.zeros(len(start), np.int64)
    for block, following, n in zip(table["block"].to_pylist(), table["next"].to_pylist(), table["n"].to_pylist()):
        yield block, at, count
        at, count = np.array(following)[at], count + np.array(n)[at]
    yield -1, at, count


def _entries(tables: DataFrame, lines: int) -> DataFrame:
    """block, start, before: the first start within each block and how many batches lie before it. tables: a written one."""
    if tables.count() <= CHAIN:

        def run(table: pa.Table) -> pa.Table:
            found = list(_chained(table, np.zeros(1, np.int64)))[:-1]
            return _rows([[b for b, _, _ in found], [int(a[0]) for _, a, _ in found], [int(c[0]) for _, _, c in found]], [pa.int64()] * 3, ["block", "start", "before"])

        return tables.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, _ENTRY)
    # A level up: chains of CHAIN blocks as one table each.
    upper = tables.withColumn("up", F.floor(F.col("block") / CHAIN).cast("long"))

    def whole(table: pa.Table) -> pa.Table:
        _, at, count = list(_chained(table, np.arange(lines)))[-1]
        return _rows([[table["up"][0].as_py()], [at], [count]], [pa.int64(), _LISTS, _LISTS], ["block", "next", "n"])

    above = _entries(stored(upper.groupBy("up").applyInArrow(whole, _TABLE), "chains"), lines)

    def down(table: pa.Table) -> pa.Table:
        found = list(_chained(table, table["start"].to_numpy()[:1]))[:-1]
        before = table["before"][0].as_py()
        return _rows([[b for b, _, _ in found], [int(a[0]) for _, a, _ in found], [before + int(c[0]) for _, _, c in found]], [pa.int64()] * 3, ["block", "start", "before"])

    return upper.join(above.withColumnRenamed("block", "up"), "up").groupBy("up").applyInArrow(down, _ENTRY)


def group_batches(rows: DataFrame, group: str, order: str, size: str, most: int = 1500, lines: int = 100) -> DataFrame:
    """rows with batch: its number (from 0) in the order of (group, order). A batch holds rows of one group, sizes up to most together and lines rows at most."""
    if not 1 <= lines <= BLOCK or most < 1:
        raise ValueError("lines must be 1 to the size of a block, most 1 or more")
    length = BLOCK
    placed = stored(numbered(rows, [group, order]), "placed")
    # Groups are told apart by a hash; only neighbours in order are compared.
    narrow = placed.select("place", F.xxhash64(group).alias("grp"), F.col(size).cast("long").alias("size"))
    block = F.floor(F.col("place") / length).cast("long")
    near = F.when((F.col("place") % length < lines) & (F.col("place") >= length), F.array(block, block - 1)).otherwise(F.array(block))
    blocks = narrow.select(F.explode(near).alias("block"), "place", "grp", "size")

    def table(t: pa.Table) -> pa.Table:
        own = _Block(t, most, lines, length)
        return _rows([[t["block"][0].as_py()], *([x] for x in own.exits(lines))], [pa.int64(), _LISTS, _LISTS], ["block", "next", "n"])

    entries = _entries(stored(blocks.groupBy("block").applyInArrow(table, _TABLE), "tables"), lines)

    def number(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Block(left, most, lines, length)
        starts = own.starts(right["start"][0].as_py())
        batch = right["before"][0].as_py() - 1 + np.searchsorted(starts, np.arange(own.n), side="right")
        return _rows([own.place[: own.n], batch], [pa.int64()] * 2, ["place", "batch"])

    found = blocks.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(number, "place long, batch long")
    return placed.join(found, "place").select(*rows.columns, "batch")


def batch_context(batches: DataFrame, lines: DataFrame, group: str, order: str, text: str, width: int = 3) -> DataFrame:
    """batch, before, after: up to width texts of lines (all of the group, repeated ones too) next to each batch's first and last order, in order; empty at a group's edges."""
    placed = stored(numbered(lines.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(text).alias("t")), ["g", "o"]), "lines")
    edges = batches.groupBy("batch").agg(F.first(group).alias("g"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    at = placed.select(F.col("g").alias("g2"), F.col("o").alias("o2"), "place")
    # Places of the two edges, then equi-joins with their neighbours' places.
    near = lambda edge, steps: edges.join(at, edges["g"].eqNullSafe(at["g2"]) & (edges[edge] == at["o2"])).groupBy("batch", "g").agg(F.min("place").alias("p") if edge == "lo" else F.max("place").alias("p")).select("batch", "g", F.lit(edge).alias("edge"), F.explode(F.transform(F.array(*map(F.lit, steps)), lambda s: F.col("p") + s)).alias("place"))
    wanted = near("lo", range(-width, 0)).unionByName(near("hi", range(1, width + 1)))
    got = wanted.join(placed.withColumnRenamed("g", "g3"), "place").where(F.col("g").eqNullSafe(F.col("g3")))
    side = lambda edge: F.transform(F.array_sort(F.collect_list(F.when(F.col("edge") == edge, F.struct("place", "t")))), lambda x: x["t"])
    found = got.groupBy("batch").agg(side("lo").alias("before"), side("hi").alias("after"))
    none = F.array().cast("array<string>")
    return edges.select("batch").join(found, "batch", "left").select("batch", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))
