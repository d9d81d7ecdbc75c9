"""Counts of 64-bit keys over a whole corpus, brought back to the chunk of documents that asked.

Documents are dealt into chunks by a hash. A chunk asks once for each of its distinct keys, in sorted order and parted into
buckets by the key's upper bits; a bucket adds up what all chunks report and answers with one number for each key, in the
order asked. So a key costs a few bytes on the way there and less on the way back, and a key that a third of all documents
hold is one entry for each chunk. Chunks and buckets are as many as the characters of the corpus ask for, so that each
stays of one size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters in a chunk and in what a bucket counts; chunks at least.
CHUNK_CHARS, BUCKET_CHARS, LEAST_CHUNKS = 4_000_000, 6_000_000, 12
ASK_SCHEMA = "chunk int, bucket int, keys binary, counts binary"
ANSWER_SCHEMA = "chunk int, bucket int, totals binary, first long"
ASK = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("first", pa.int64())])


def plan(df: DataFrame, text: str) -> tuple[int, int]:
    """Numbers of chunks and buckets."""
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    return max(LEAST_CHUNKS, -(-chars // CHUNK_CHARS)), max(1, -(-chars // BUCKET_CHARS))


def chunk_of(key: str, text: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(key, text), F.lit(chunks)).cast("int")


def planes(a: np.ndarray) -> bytes:
    """The bytes of the numbers by place, which compress well if the numbers are small."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def unplanes(b: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def mixed(a: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def asked(chunk: int, parts: Iterable[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.Table:
    """Rows of ASK; parts: sorted distinct keys and their counts here, one pair for each kind of key."""
    rows: list[tuple[int, int, bytes, bytes]] = []
    for kind, (keys, counts) in enumerate(parts):
        cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
        for b, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if lo < hi:
                rows.append((chunk, kind * buckets + b, planes(np.diff(keys[lo:hi], prepend=np.uint64(0))), planes(counts[lo:hi].astype(np.uint32))))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, ASK)], schema=ASK)


def _answer(table: pa.Table) -> pa.Table:
    keys = [np.cumsum(unplanes(b, np.uint64), dtype=np.uint64) for b in table["keys"].to_pylist()]
    counts = np.concatenate([unplanes(b, np.uint32) for b in table["counts"].to_pylist()])
    ends = np.cumsum([len(k) for k in keys])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, counts).astype(np.uint64)[inverse]
    seen = np.flatnonzero(counts)
    first = np.bincount(np.searchsorted(ends, seen[np.unique(inverse[seen], return_index=True)[1]], side="right"), minlength=len(keys))
    return pa.table([table["chunk"].combine_chunks(), table["bucket"].combine_chunks(), pa.array([planes(x) for x in np.split(totals, ends[:-1])], pa.binary()), pa.array(first, pa.int64())], schema=ANSWER)


def answers(requests: DataFrame) -> DataFrame:
    """For each row asked, the totals of its keys over all chunks, and how many of its keys with a count it is the first row to have."""
    return requests.groupBy("bucket").applyInArrow(_answer, ANSWER_SCHEMA)


def totals(table: pa.Table, kinds: int, buckets: int) -> list[np.ndarray]:
    """Of the answers to one chunk, the totals in the order of its sorted keys, for each kind."""
    table = table.sort_by("bucket")
    kind = table["bucket"].to_numpy() // buckets
    return [np.concatenate([np.zeros(0, np.uint64), *(unplanes(b, np.uint64) for b in table["totals"].filter(pa.array(kind == k)).to_pylist())]) for k in range(kinds)]


def resolved(docs: DataFrame, request: Callable[[pa.Table], pa.Table], resolve: Callable[[pa.Table, pa.Table], pa.Table], schema: object) -> DataFrame:
    """resolve(documents, answers) of each chunk. docs has the column chunk; both sides share one shuffle of it."""
    return docs.groupBy("chunk").cogroup(answers(docs.groupBy("chunk").applyInArrow(request, ASK_SCHEMA)).groupBy("chunk")).applyInArrow(resolve, schema)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
