"""Variable-capacity best-fit packing of sequences.

Texts longer than the largest permitted length are cut into full pieces and a rest. Pieces go, longest first, to the open
bin with the least room that still holds them; when none does, a bin is opened whose size costs least for what it could
hold: for each permitted size the largest pieces still waiting are laid in greedily, and the size with the least cost (its
length and a fixed charge) for each token laid in wins. At the end each bin is downsized to the smallest permitted length
that holds its contents.

Only the number of pieces of each length matters to the plan, and there are no more lengths than the largest capacity, so
the plan is made from that histogram and treats equal bins as one group: its size is bounded by the capacity, not by the
data. Pieces get their rank among pieces of their length from counts by task, and find their bin by a search in the plan.

Defined results: null or zero lengths take no room and go nowhere; negative lengths are an error. Ties in length go by key
and piece. Repeated keys are packed as texts of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._work import free_name, without_clash, written

#: Permitted sequence lengths, and the charge for opening a bin, in tokens.
CAPACITIES = (512, 1024, 2048, 4096)
OPENING = 16


class Plan:
    """Runs of pieces and their bins: the pieces of length[i] with ranks from rank[i] on, one in each bin from bin[i] on, at place offset[i]."""

    def __init__(self, counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, opening: int = OPENING):
        self.capacities, self.opening = sorted(set(capacities)), opening
        self.length: list[int] = []
        self.rank: list[int] = []
        self.bin: list[int] = []
        self.offset: list[int] = []
        #: Room left -> groups (first bin, number of bins, size of the bins).
        self.open: dict[int, list[tuple[int, int, int]]] = {}
        self.rooms: list[int] = []
        self.bins = 0
        self.sizes: list[tuple[int, int, int]] = []
        waiting = {n: c for n, c in counts.items() if c}
        self.lengths = sorted(waiting)
        self.waiting = waiting
        for n in sorted(waiting, reverse=True):
            self._place(n)
        for room, groups in self.open.items():
            for first, many, size in groups:
                self._close(first, many, size - room)
        self.sizes.sort()

    def _close(self, first: int, many: int, used: int) -> None:
        self.sizes.append((first, many, next(c for c in self.capacities if c >= used)))

    def _put(self, room: int, group: tuple[int, int, int]) -> None:
        if not room:
            self._close(group[0], group[1], group[2])
        elif room in self.open:
            self.open[room].append(group)
        else:
            self.open[room] = [group]
            insort(self.rooms, room)

    def _place(self, n: int) -> None:
        left, rank = self.waiting[n], 0
        while left:
            at = bisect_left(self.rooms, n)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, many, size = self.open[room].pop(0)
            else:
                self.waiting[n] = left
                size = self._cheapest(n)
                room, first = size, self.bins
                # As many bins of this size as one after the other would be opened for these pieces: each takes what it can of them.
                many = max(1, left // (size // n))
                self.bins += many
            take = min(many, left)
            if room in self.open and not self.open[room]:
                del self.open[room]
                self.rooms.remove(room)
            if take < many:
                self.open.setdefault(room, []).insert(0, (first + take, many - take, size))
                if room not in self.rooms:
                    insort(self.rooms, room)
            self.length.append(n)
            self.rank.append(rank)
            self.bin.append(first)
            self.offset.append(size - room)
            self._put(room - n, (first, take, size))
            rank, left = rank + take, left - take
        self.waiting[n] = 0

    def _cheapest(self, n: int) -> int:
        best = None
        for size in self.capacities:
            if size < n:
                continue
            room, at = size, bisect_left(self.lengths, n)
            while at >= 0 and room:
                m = self.lengths[at]
                room -= m * min(self.waiting[m], room // m)
                at = min(at - 1, bisect_left(self.lengths, room + 1) - 1)
            cost = (size + self.opening) / (size - room)
            if best is None or cost < best[0]:
                best = (cost, size)
        return best[1]


def pieces(df: DataFrame, length: str, most: int) -> DataFrame:
    """df with piece (from 0), start and size: full pieces of most, then the rest."""
    n = F.col(length).cast("long")
    cut = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / most).cast("long"))
    out = df.withColumn("piece", F.explode(F.when(n > 0, cut).when(n < 0, F.raise_error(F.lit("a length is negative")).cast("array<bigint>"))))
    return out.withColumn("start", F.col("piece") * most).withColumn("size", F.least(n - F.col("start"), F.lit(most)).cast("int"))


def best_fit_packing(df: DataFrame, key: str = "doc_id", length: str = "n_tokens", capacities: Sequence[int] = CAPACITIES, opening: int = OPENING) -> DataFrame:
    """key, piece, start, size, bin, capacity, offset: the place of every piece."""
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    spark, most = df.sparkSession, max(capacities)
    cut = pieces(df.select(F.col(key).alias("key"), F.col(length).alias("length")), "length", most).drop("length")
    # Ordered by size and key, so that a rank is a count of earlier tasks and a place within the task; equal sizes spread over tasks.
    cut = cut.repartitionByRange("size", "key", "piece").sortWithinPartitions("size", "key", "piece")
    cut = written(cut.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "pieces")
    tasks = cut.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = written(tasks.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))), "ranks")
    counts = {r["size"]: r["n"] for r in tasks.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most `most` rows
    plan = Plan(counts, capacities, opening)
    # Of one length the runs lie in order of rank; all runs in one order by length and rank.
    order = np.lexsort((plan.rank, plan.length))
    runs = np.array([plan.length, plan.rank, plan.bin, plan.offset], np.int64).reshape(4, -1)[:, order]
    sizes = np.array(plan.sizes, np.int64).reshape(-1, 3).T
    sent = spark.sparkContext.broadcast((runs, sizes))
    ranked = cut.join(tasks.select("part", "size", "before", "first"), ["part", "size"])
    ranked = ranked.select("key", "piece", "start", "size", (F.col("before") + F.col("at") - F.col("first")).alias("rank"))
    schema = T.StructType([*ranked.drop("rank").schema.fields, T.StructField("bin", T.LongType()), T.StructField("capacity", T.IntegerType()), T.StructField("offset", T.IntegerType())])
    span = 1 << 40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (n, first, bins, offset), (start, _, size) = sent.value
        at = n * span + first
        for b in batches:
            rank = b.column(4).to_numpy()
            k = np.searchsorted(at, b.column(3).to_numpy().astype(np.int64) * span + rank, side="right") - 1
            own = bins[k] + rank - first[k]
            room = size[np.searchsorted(start, own, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(own), pa.array(room.astype(np.int32)), pa.array(offset[k].astype(np.int32))], names=schema.names)

    return ranked.mapInArrow(run, schema).withColumnRenamed("key", key)
