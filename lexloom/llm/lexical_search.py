"""Ranked lexical search, score at a time over impact-ordered postings.

A first pass counts each document's terms and keeps, of those, the ones that any query holds: a table of (document, number
of terms, term numbers, occurrences) in the shared folder. From it come the collection's numbers: documents with a term,
all terms, and documents by term. A second pass turns occurrences into impacts (whole numbers: the term's weight times its
saturated frequency), and each task serves its documents in blocks:

* The postings of a block lie by term and falling impact, those of equal impact together as a group.
* For a query, the groups of its terms are processed by falling contribution, in strides that double. What is still to come
  for any document is at most the sum of each term's next contribution. The strides end only when neither an unseen document
  nor more than a few of the seen ones can reach the kth best score (ties included), and those few get their complete scores.
* The kth best score is carried from block to block of a task, so later blocks end earlier.

Each task hands over k rows for each query at most, and the best of all tasks are ranked. Queries are split by a hash into lots of
about LOT_BYTES of text; a lot's terms and queries are what is sent to the tasks, and its documents by term, as many
numbers as the lot has terms, are what comes to the driver.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.

Defined results: null and empty texts have no terms; a document without a term counts for nothing, and a query without one
finds nothing. Rows with equal keys are documents, or queries, each of its own. Null document keys are searched and come
last among equal scores; null query keys stay null. Without queries or documents the result is empty. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._work import written

#: Bytes of query text served together, postings in a block, contributions in the first stride, candidates completed at once for each wanted.
LOT_BYTES, BLOCK, STRIDE, FEW = 8 << 20, 4_000_000, 4096, 16
#: Lower case for A-Z, a space for what isn't part of a term.
_TERM_BYTES = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """key, n, terms, tfs of every document with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            sizes, found, rows = [], [], []
            for text in b.column(1):
                all_terms = terms(text.as_py())
                counts = Counter(all_terms)
                own = counts.keys() & known.keys()
                sizes.append(len(all_terms))
                found.append([known[t] for t in own])
                rows.append([counts[t] for t in own])
            out = pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(found, ints), pa.array(rows, ints)], names=["key", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(sizes, np.int64) > 0))

    return docs.mapInArrow(run, T.StructType([docs.schema["key"], *T._parse_datatype_string("n long, terms array<int>, tfs array<int>").fields]))


class _Best:
    """The k best documents of each query so far: scores falling, ties by key."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, bool, object]]] = [[] for _ in range(queries)]

    def least(self, q: int) -> int:
        """A score that a document has to reach."""
        own = self.rows[q]
        return -own[-1][0] if len(own) == self.k else 1

    def add(self, q: int, scores: np.ndarray, keys: list) -> None:
        self.rows[q] = sorted([*self.rows[q], *((-s, key is None, key or 0) for s, key in zip(scores.tolist(), keys) if s > 0)])[: self.k]


class Block:
    """Documents with their postings, by document and by term and falling impact."""

    def __init__(self, keys: pa.Array, docs: np.ndarray, words: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.keys, self.n = keys, len(keys)
        self.doc_words, self.doc_impacts = words, impacts
        self.doc_at = np.searchsorted(docs, np.arange(self.n + 1))
        order = np.lexsort((-impacts, words))
        self.docs, words, impacts = docs[order], words[order], impacts[order]
        head = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (impacts[1:] != impacts[:-1]))[: len(words)])
        self.group_at = np.append(head, len(words))
        self.group_impact = impacts[head]
        # The groups of a term are group_of[t] to group_of[t + 1].
        self.group_of = np.searchsorted(words[head], np.arange(n_terms + 1))

    def search(self, words: np.ndarray, times: np.ndarray, weights: np.ndarray, k: int, least: int, stride: int, few: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and complete scores of every document that may be among the k best and reaches least; weights: of all terms, zero or how often the query holds them; stride: contributions in the first one; few: candidates completed for each wanted."""
        lo, hi = self.group_of[words], self.group_of[words + 1]
        size = hi - lo
        which = np.repeat(np.arange(len(words)), size)
        groups = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        gain = self.group_impact[groups] * times[which]
        order = np.argsort(-gain, kind="stable")
        groups, which, gain = groups[order], which[order], gain[order]
        postings = np.cumsum(self.group_at[groups + 1] - self.group_at[groups])
        seen, sums, done, used = np.zeros(self.n, bool), np.zeros(self.n, np.int64), 0, lo.copy()
        candidates = np.zeros(0, np.int64)
        while True:
            upto = max(done + 1, int(np.searchsorted(postings, (postings[done - 1] if done else 0) + stride, side="right")))
            own = slice(done, min(upto, len(groups)))
            n = self.group_at[groups[own] + 1] - self.group_at[groups[own]]
            at = self.docs[np.repeat(self.group_at[groups[own]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            np.add.at(sums, at, np.repeat(gain[own], n))
            seen[at] = True
            used += np.bincount(which[own], minlength=len(words))
            done, stride = own.stop, 2 * stride
            # No document gains more from here on than each term's next group gives.
            left = used < hi
            rest = int((self.group_impact[used[left]] * times[left]).sum())
            candidates = np.flatnonzero(seen)
            bound = least
            if len(candidates) >= k:
                bound = max(bound, int(np.partition(sums[candidates], len(candidates) - k)[len(candidates) - k]))
            candidates = candidates[sums[candidates] + rest >= bound]
            if done >= len(groups) or (rest < bound and len(candidates) <= few * k):
                break
        scores = np.array([(weights[self.doc_words[a:b]] * self.doc_impacts[a:b]).sum() for a, b in zip(self.doc_at[candidates], self.doc_at[candidates + 1])], np.int64)
        good = scores >= bound
        return candidates[good], scores[good]


def _served(postings: DataFrame, asked: list[tuple[object, dict[int, int]]], weights: list[int], n_docs: int, n_terms: int, k: int, kind: T.DataType) -> DataFrame:
    """query, item, key, score: each task's best."""
    shared = postings.sparkSession.sparkContext.broadcast((asked, np.array(weights, np.int64)))
    key, stride, few, most = postings.schema["key"], STRIDE, FEW, BLOCK
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", kind), key, T.StructField("score", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best, held, count = _Best(len(asked), k), [], 0
        times = np.zeros(len(weight), np.int64)

        def serve() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            sizes = table["terms"].combine_chunks().value_lengths().to_numpy()
            docs = np.repeat(np.arange(len(sizes)), sizes)
            words, tf = (table[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            m = 25 + 75 * table["n"].to_numpy() * n_docs // n_terms
            block = Block(table["key"], docs, words, weight[words] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs])), len(weight))
            for q, (_, own) in enumerate(asked):
                if own:
                    at, n = np.fromiter(own, np.int64, len(own)), np.fromiter(own.values(), np.int64, len(own))
                    times[at] = n
                    found, scores = block.search(at, n, times, k, best.least(q), stride, few)
                    times[at] = 0
                    best.add(q, scores, block.keys.take(found).to_pylist())

        for b in batches:
            held.append(b)
            count += len(b.column("terms").flatten()) + b.num_rows
            if count >= most:
                serve()
                held, count = [], 0
        if held and count:
            serve()
        rows = [(q, asked[q][0], None if null else key_, -s) for q, own in enumerate(best.rows) for s, null, key_ in own]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, arrow)], schema=arrow)

    return postings.mapInArrow(run, schema)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text") -> DataFrame:
    """query_key, rank (from 1), key, score: each query's k best documents with a score above 0, ties to the smaller key. Keys of documents are whole numbers."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    found = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    asked = queries.select(F.col(query_key).alias("item"), F.col(query_text).alias("text"))
    kind = asked.schema["item"].dataType
    lots = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // LOT_BYTES))
    parts = []
    for lot in range(lots):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(lots)) == lot).collect()
        counts = [(r["item"], Counter(terms(r["text"]))) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in counts for t in c}))}
        postings = written(_postings(found, vocabulary), "postings")
        total = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not total[0] or not vocabulary:
            continue
        holding = {r["t"]: r["n"] for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
        weights = [term_weight(total[0], holding.get(t, 0)) for t in range(len(vocabulary))]
        own = [(item, {vocabulary[t]: n for t, n in c.items()}) for item, c in counts]
        served = _served(postings, own, weights, total[0], total[1], k, kind)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key")))
        parts.append(served.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(query_key), "rank", F.col("key").alias(key), "score"))
    if not parts:
        schema = T.StructType([T.StructField(query_key, kind), T.StructField("rank", T.IntegerType()), T.StructField(key, T.LongType()), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)
