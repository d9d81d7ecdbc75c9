"""Scores of texts under an n-gram model with deleted interpolation.

The probability of a token w after v is a mixture of maximum-likelihood estimates, for bigrams (the default order, 2)

    a2 * c(v, w) / c(v)  +  a1 * c(w) / N  +  a0 / (V + 1),

and of a higher order with one estimate for each longer context; the weights depend on the bucket of the longest context's
frequency, one bucket for each power of two. The weights are
learned by expectation-maximisation on held-out counts: each chunk of the learning documents in turn is deleted, and its
tokens are predicted from the counts of all others, so all documents learn and none predicts itself. For the weights alone
the held-out tokens are gathered in cells of a logarithmic grid (four to the octave), whose number is bounded by the
largest count's logarithm; the driver gets those cells. Everything else stays exact and distributed (see _tally).

A text is lower-cased in A-Z, parted into words at ASCII white space, and closed by an end token; the first word follows
ends.

Defined results: null texts are empty ones (one end). Null keys and repeated rows are scored as rows of their own, and
learned from if `learn` says so (null: yes). With nothing to learn from, all scores are 0 (one class, the unknown). An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import _tally
from lexloom.llm._work import written

#: Tokens in the longest n-gram (5 at most); cells to the octave, rounds of expectation-maximisation, buckets of context frequency.
ORDER, GRID, ROUNDS, BUCKETS = 2, 4, 40, 64
_END = b""  # no word is empty
_STEP = 0x9E3779B97F4A7C15
_LISTS = pa.list_(pa.int64())


class _Tokens:
    """Tokens of a chunk's documents: places of their n-grams of each length in sorted lists of distinct keys."""

    def __init__(self, docs: pa.Table, order: int):
        words: list[bytes] = []
        ends = []
        for t in docs["text"].cast(pa.binary()).to_pylist():
            words += (t or b"").lower().split()  # bytes: A-Z only, ASCII white space
            words.append(_END)
            ends.append(len(words))
        coded = pa.array(words, pa.binary()).dictionary_encode()
        del words
        keys = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        token = keys[coded.indices.to_numpy()]
        self.ends = np.array(ends, np.int64)
        self.sizes = np.diff(self.ends, prepend=0)
        # Of each length the n-grams are those of one less before, and the token; before a text stand ends.
        grams, end = [token], np.uint64(xxhash.xxh64_intdigest(_END))
        ends_before = end
        for _ in range(1, order):
            before = np.roll(grams[-1], 1)
            before[self.ends - self.sizes] = ends_before
            with np.errstate(over="ignore"):
                grams.append(_tally.mixed(before * np.uint64(_STEP) + token))
                ends_before = _tally.mixed(np.array([ends_before]) * np.uint64(_STEP) + end)[0]
        self.learn = np.repeat(docs["learn"].to_numpy(zero_copy_only=False).astype(bool), self.sizes)
        self.parts, self.at = [], []
        for k in grams:
            u, at = np.unique(k, return_inverse=True)
            self.parts.append((u, np.bincount(at[self.learn], minlength=len(u))))
            self.at.append(at)


def _contexts(counts: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Of counts by length of n-gram, how often each one's context occurs, from length 2 on: the count of the n-gram before; before a text stand as many ends as texts."""
    out = []
    for c in counts[:-1]:
        before = np.roll(c, 1)
        before[starts] = counts[0][ends - 1]
        out.append(before)
    return out


def _octave(x: np.ndarray) -> np.ndarray:
    return 1 + np.rint(GRID * np.log2(x)).astype(np.int64)


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def _cells(counts: list[np.ndarray], contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the grid and how many tokens lie in each: (bucket, word count, inverse share of each context, longest last)."""
    cell = _bucket(contexts[-1]) * 1024 + np.where(counts[0] > 0, _octave(np.maximum(counts[0], 1)), 0)
    for n, context in zip(counts[1:], contexts):
        cell = cell * 1024 + np.where(n > 0, _octave(np.maximum(context, 1) / np.maximum(n, 1)), 0)
    return np.unique(cell, return_counts=True)


def learned_weights(cells: np.ndarray, n: np.ndarray, tokens: float, vocabulary: int, order: int) -> np.ndarray:
    """Weights (longest n-gram first, word, any) by bucket, from the held-out tokens by cell."""
    weights = np.tile([0.0] * order + [1.0], (BUCKETS, 1))
    if not len(cells) or tokens <= 0:
        return weights
    place = lambda k: cells >> 10 * (order - k) & 1023
    bucket, word = cells >> 10 * order, place(1)
    longer = [np.where(place(k) > 0, 2.0 ** ((1 - place(k)) / GRID), 0) for k in range(order, 1, -1)]
    p = np.stack([*longer, np.where(word > 0, 2.0 ** ((word - 1) / GRID) / tokens, 0), np.full(len(cells), 1 / (vocabulary + 1))])
    used = np.unique(bucket)
    weights[used] = 1 / (order + 1)
    for _ in range(ROUNDS):
        share = weights[bucket].T * p
        share *= n / share.sum(0)
        # Half a token for the last part: no token ever becomes impossible.
        new = np.stack([np.bincount(bucket, s, BUCKETS) for s in share], 1)
        new[:, -1] += 0.5
        weights[used] = (new / new.sum(1, keepdims=True))[used]
    for b in range(1, BUCKETS):  # a bucket without held-out tokens is like the one below
        if b not in used and b > used[0]:
            weights[b] = weights[b - 1]
    return weights


def lm_scores(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """key, learned (whether the row was learned from), n_tokens, n_known, train_tokens, base_score (half-smoothed single tokens) and score, log10 probabilities of the text."""
    if not 2 <= order <= 5:
        raise ValueError("order must be 2 to 5")
    chunks, buckets = _tally.plan(df, text)
    docs = df.select(_tally.chunk_of(key, text, chunks).alias("chunk"), F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(learn, F.lit(True)).alias("learn"))
    kind, grams = docs.schema["key"].dataType, [f"grams{k}" for k in range(1, order + 1)]
    schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string("learned boolean, " + "".join(f"{g} array<bigint>, " for g in grams) + "cells array<bigint>, n array<bigint>, tokens bigint, vocabulary bigint").fields])

    def request(table: pa.Table) -> pa.Table:
        return _tally.asked(table["chunk"][0].as_py(), _Tokens(table, order).parts, buckets)

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        t = _Tokens(left, order)
        totals = [x.astype(np.int64)[at] for x, at in zip(_tally.totals(right, order, buckets), t.at)]
        others = [x - own[at] for x, (_, own), at in zip(totals, t.parts, t.at)]
        contexts = _contexts(others, t.ends - t.sizes, t.ends)
        cells, n = _cells([x[t.learn] for x in others], [x[t.learn] for x in contexts])
        offsets = np.concatenate([[0], t.ends]).astype(np.int32)
        many, first = left.num_rows, right.filter(pa.array(right["bucket"].to_numpy() < buckets))["first"].to_numpy().sum()
        none = pa.nulls(many, _LISTS)
        rows = [left["key"].combine_chunks(), left["learn"].combine_chunks(), *(pa.ListArray.from_arrays(offsets, x) for x in totals), none, none, pa.nulls(many, pa.int64()), pa.nulls(many, pa.int64())]
        last = [pa.nulls(1, rows[0].type), pa.nulls(1, pa.bool_()), *[pa.nulls(1, _LISTS)] * order, pa.array([cells], _LISTS), pa.array([n], _LISTS), pa.array([int(t.learn.sum())], pa.int64()), pa.array([int(first)], pa.int64())]
        return pa.table([pa.chunked_array([a, b]) for a, b in zip(rows, last)], names=schema.names)

    found = written(_tally.resolved(docs, request, resolve, schema), "lm")
    notes = found.where(F.col("cells").isNotNull())
    sums = notes.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    grid = notes.select(F.explode(F.arrays_zip("cells", "n")).alias("x")).groupBy("x.cells").agg(F.sum("x.n").alias("n")).toPandas()
    weights = learned_weights(grid["cells"].to_numpy(np.int64), grid["n"].to_numpy(np.int64), sums[0] * (1 - 1 / chunks), sums[1], order)
    return _scored(found.where(F.col("grams1").isNotNull()).select("key", "learned", *grams), weights, sums[0], sums[1]).withColumnRenamed("key", key)


def _scored(rows: DataFrame, weights: np.ndarray, tokens: int, vocabulary: int) -> DataFrame:
    """rows: key, learned, and the counts of each token's n-grams by length."""
    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string("n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _tally.in_slices(batches, 512):
            counts = [c.flatten().to_numpy() for c in b.columns[2:]]
            word, sizes = counts[0], b.column(2).value_lengths().to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            contexts = _contexts(counts, starts, ends)
            w = weights[_bucket(contexts[-1])]
            p = w[:, -2] * word / max(tokens, 1) + w[:, -1] / (vocabulary + 1)
            for k, (n, context) in enumerate(zip(counts[1:], contexts), 2):
                p += w[:, len(counts) - k] * n / np.maximum(context, 1)
            base = np.log10((word + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
            sums = [np.add.reduceat(x, starts) for x in ((word > 0).astype(np.int64), base, np.log10(p))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes), pa.array(sums[0]), pa.array(np.full(len(sizes), tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=schema.names)

    return rows.mapInArrow(run, schema)
