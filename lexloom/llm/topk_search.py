"""Exact top-k search by distributed histogram selection.

Vectors are scaled to whole numbers, packed into blocks, and every query is scored against every block. A pass lays a
histogram of equal bins over each query's current score range; the sums of all blocks show which bin holds the query's kth
best score, and the next pass refines that bin, until bins are single scores. A last pass keeps what lies above the kth
score and, of those equal to it, the smallest ids that are still wanted. Blocks report their best k entries only, since a
query's kth best score can't lie below the kth best of any block; so ties of any number and repeated vectors cost nothing.

Queries are split by a hash into groups of a fixed size. Groups are broadcast, as many at a time as fit BROADCAST_BYTES, and
the candidate blocks meet them where they lie: blocks are scanned once for each such lot in a pass and never shuffled. (One
group is GROUP queries, so a lot is bounded by the length of a vector alone.) Nothing but the bounds of the norms, the
longest vector and the number of queries comes to the driver.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids.
Vectors meet those of the same length only. Of query rows with the same id the smallest vector counts; candidates with the
query's id are left out; other repeated candidate rows are ranked each on its own. Scores need to fit in 62 bits, else a
ValueError says so. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm._work import written

#: Bins of a pass, candidates in a block, queries in a group, bytes of queries sent to all tasks at a time.
BINS, BLOCK, GROUP, BROADCAST_BYTES = 1024, 4096, 1024, 64 << 20
_LISTS = pa.list_(pa.int64())


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id and v, the components as floor(scale * x), of the rows that take part."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    return (
        df.select(F.col(key).cast("long").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(F.forall("v", ok))
        .select("id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))
    )


def _packed(rows: DataFrame) -> DataFrame:
    """dim, ids, data: up to BLOCK vectors of one length in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim)))
            return pa.record_batch([pa.array([dim], pa.int32()), pa.array([ids], _LISTS), pa.array([data], _LISTS)], names=["dim", "ids", "data"])

        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                for k in range(0, len(own), BLOCK):
                    part = own[k : k + BLOCK]
                    held.setdefault(dim, []).append((ids[part], flat[(starts[part][:, None] + np.arange(dim)).ravel()]))
                    if sum(len(x[0]) for x in held[dim]) >= BLOCK:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, "dim int, ids array<long>, data array<long>")


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where they can't round, else in whole numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _met(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """Each candidate block with each group of queries of its length; state: so many groups as may be broadcast."""
    packed = state.groupBy("g", "dim").agg(F.collect_list(F.struct("id", "v", "lo", "need")).alias("q"))
    packed = packed.select("dim", F.col("q.id").alias("q_ids"), F.flatten("q.v").alias("q_data"), F.col("q.lo").alias("q_lo"), F.col("q.need").alias("q_need"))
    return blocks.join(F.broadcast(packed), "dim")


def _lots(blocks: DataFrame, state: DataFrame, groups: int, together: int) -> Iterator[DataFrame]:
    for lo in range(0, groups, together):
        yield _met(blocks, state.where(F.col("g").between(lo, lo + together - 1)) if together < groups else state)


def _all(parts: Iterator[DataFrame], name: str) -> DataFrame:
    """The parts' rows; of several, each is written as it is made."""
    parts = list(parts)
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, [written(p, name) for p in parts])


_COLUMNS = ["dim", "ids", "data", "q_ids", "q_data", "q_lo", "q_need"]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """ids, scores (lowest where ids meet themselves), q_ids, lo, need of each meeting."""
    for b in batches:
        for r in range(b.num_rows):
            dim, ids, data, q_ids, q_data, lo, need = (b.column(k)[r] for k in range(7))
            c, q = (x.values.to_numpy().reshape(-1, dim.as_py()) for x in (data, q_data))
            ids, q_ids, lo, need = (x.values.to_numpy() for x in (ids, q_ids, lo, need))
            s = _scores(q, c)
            s[q_ids[:, None] == ids[None, :]] = np.iinfo(np.int64).min
            yield ids, s, q_ids, lo, need


def _histogram(met: DataFrame, width: int, bins: int) -> DataFrame:
    """id, bin, n: entries by bin, of each block the best that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s, q_ids, lo, need in _each(batches):
            at = np.where(s < lo[:, None], -1, (np.maximum(s, lo[:, None]) - lo[:, None]) // width)
            at[at >= bins] = -1  # counted by an earlier pass
            k = min(int(need.max()), len(ids))
            best = -np.sort(-np.partition(at, len(ids) - k, axis=1)[:, len(ids) - k :], axis=1)
            rows, cols = np.nonzero((best >= 0) & (np.arange(k) < need[:, None]))
            pair, n = np.unique(np.stack([rows, best[rows, cols]]), axis=1, return_counts=True)
            yield pa.record_batch([pa.array(q_ids[pair[0]], pa.int64()), pa.array(pair[1], pa.int64()), pa.array(n, pa.int64())], names=["id", "bin", "n"])

    return met.select(_COLUMNS).mapInArrow(run, "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))


def _refined(state: DataFrame, hist: DataFrame, width: int) -> DataFrame:
    """The bin that holds each query's kth score, and how many are wanted within it."""
    w = Window.partitionBy("id").orderBy(F.desc("bin"))
    run = hist.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = run.join(state.select("id", F.col("need").alias("wanted")), "id")
    # A query with fewer candidates than wanted stays in its lowest bin.
    hit = got.groupBy("id").agg(
        F.min_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), F.when(F.col("upto") >= F.col("wanted"), F.col("upto"))).alias("hit"),
        F.coalesce(F.sum(F.when(F.col("bin") > 0, F.col("n"))), F.lit(0)).alias("over"),
    )
    bin_, above = F.coalesce("hit.bin", F.lit(0)), F.coalesce("hit.above", "over", F.lit(0))
    return state.join(hit, "id", "left").select("g", "dim", "id", "v", (F.col("lo") + bin_ * F.lit(width)).alias("lo"), (F.col("need") - above).cast("long").alias("need"))


def _chosen(met: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s, q_ids, lo, need in _each(batches):
            found = []
            for r in range(len(q_ids)):
                at = np.flatnonzero(s[r] > lo[r])
                ties = np.flatnonzero(s[r] == lo[r])
                if len(ties) > need[r]:
                    ties = ties[np.argsort(ids[ties], kind="stable")[: need[r]]]
                at = np.concatenate([at, ties])
                found.append((np.full(len(at), q_ids[r]), ids[at], s[r, at]))
            yield pa.record_batch([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], names=["query_id", "id", "score"])

    return met.select(_COLUMNS).mapInArrow(run, "query_id long, id long, score long")


def exact_topk(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, bins: int = BINS) -> DataFrame:
    """query_id, rank (from 1), key, score: each query's k best by integer inner product, ties to the smaller key. queries: a condition on the rows."""
    if k < 1 or bins < 2:
        raise ValueError("k must be 1 or more, bins 2 or more")
    rows = whole_vectors(vectors, key, vector, scale)
    blocks = written(_packed(rows), "blocks")
    asked = whole_vectors(vectors.where(queries), key, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(asked.withColumn("dim", F.size("v")), "queries")
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    many = asked.count()
    most = rows.agg(F.max(norm(F.col("v")))).first()[0] or 0.0
    bound = int(most * most * (1 + 1e-9)) + 2
    if bound >= 1 << 62:
        raise ValueError("scores don't fit in 64 bits")
    groups = max(1, -(-many // GROUP))
    longest = asked.agg(F.max("dim")).first()[0] or 1
    together = max(1, BROADCAST_BYTES // (8 * GROUP * longest))
    g = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    state = asked.select(g.alias("g"), "dim", "id", "v", F.lit(-bound).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"))
    width = 1
    while width * bins < 2 * bound + 1:
        width *= bins
    while True:
        hist = _all((_histogram(met, width, bins) for met in _lots(blocks, state, groups, together)), "histogram")
        state = written(_refined(state, hist, width), "state")
        if width == 1:
            break
        width //= bins
    found = _all((_chosen(met) for met in _lots(blocks, state, groups, together)), "chosen")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
