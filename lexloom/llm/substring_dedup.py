"""Removal of strings of a given number of bytes that occur again, by longest-previous-factor arrays.

A position's longest previous (next) factor is the longest string that starts there and also at an earlier (later) position.
Whether it reaches ``length`` bytes shows in a suffix array: suffixes with the same first ``length`` bytes lie together, and
with ties in order of position the previous smaller and next larger positions are the neighbours there. To sort only
suffixes that can matter, and apart from each other in many tasks:

1. Every window of ``length`` bytes is represented by its smallest k-gram hash (the leftmost one, so equal windows have
   equal representatives, or seeds). Windows in a row with one seed occurrence form a region. Seeds are counted over the
   corpus, and those found once drop out.
2. Regions of the other seeds are sent, compressed, to a bucket that the seed says. Regions equal within a chunk or within a bucket
   are judged as one, so copies cost nothing; the others' suffixes are sorted by prefix doubling over bounded lots of whole
   seeds, and the neighbours in suffix order tell which windows occur elsewhere, and which of them earlier.
3. A seed found more than HOT times would be too much for one lot: its windows go, each on its own, to buckets by a
   128-bit hash of all their bytes, where equal ones meet.
4. What was found returns to the chunk of documents, where windows become merged spans of bytes.

Texts are shuffled once, by a hash, into chunks of about CHUNK_CHARS, in which key and text give the order of documents.

Defined results: texts are UTF-8 bytes; null is taken as empty and has none. Matches never cross documents. Rows with equal
keys are documents of their own, so each loses what it shares with the other (with keep="first" all but the first do; rows equal
in key and text are alike, so which of them that is doesn't show). Null keys come last. Texts shorter than ``length`` lose
nothing. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._tally import chunk_of, mixed, plan

#: Window starts hashed together (a power of two), bytes whose suffixes are sorted together, occurrences of a seed that one lot may hold.
BLOCK, LOT_BYTES, HOT = 1 << 19, 1 << 19, 3000
#: Parts (a power of two) in which a bucket's windows of hot seeds are sorted.
PARTS = 8
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PLACE = np.uint64(BLOCK * 2 - 1)
_NULL_LAST = np.iinfo(np.int64).max


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        a = np.full(n, x, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


class Hashes:
    """Hashes of substrings, by sums from the left."""

    def __init__(self, data: np.ndarray, base: int = _BASES[0]):
        # One table of powers for all usual sizes.
        power, self.inverse = _powers(base, max(2 * BLOCK, 1 << len(data).bit_length()))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            n = len(self.sums) - k
            return mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[:n])


def _window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w numbers in a row."""
    n = len(v)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = v
    full = full.reshape(-1, w)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def regions(data: np.ndarray, sizes: np.ndarray, length: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: seed, first window's start, number of windows and hash of the bytes of each region, in order."""
    k = max(1, length // 3)
    w = length - k + 1
    own = np.maximum(sizes - length + 1, 0)
    starts_ok = np.repeat(np.tile([True, False], len(sizes)), np.stack([own, sizes - own], 1).ravel())
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for lo in range(0, len(data) - length + 1, block):
        hi = min(lo + block, len(data) - length + 1)
        ok = starts_ok[lo:hi]
        if not ok.any():
            continue
        hashes = Hashes(data[lo : hi + length - 1])
        gram = hashes.grams(k)
        at = (_window_minima(gram & ~_PLACE | np.arange(len(gram), dtype=np.uint64), w) & _PLACE).astype(np.int64)
        start = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])))
        n = np.diff(np.append(start, len(at)))
        start, n = start[ok[start]], n[ok[start]]
        out.append((gram[at[start]], lo + start, n, hashes.of(start, start + n + length - 1)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes from each start, end to end."""
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Dense ranks, in suffix order, of the first ``length`` bytes from each place, by prefix doubling; places too near the end count as followed by zeros."""
    rank, have = data.astype(np.int64), 1
    while have < min(8, length):  # so far no sorting is needed
        step = min(have, length - have)
        rank = rank << 8 * step | _shifted(rank, step) & (1 << 8 * step) - 1 if step < have else rank << 8 * have | _shifted(rank, have)
        have += step
    if have == 8:
        rank = rank.view(np.uint64)
    rank = np.unique(rank, return_inverse=True)[1]
    while have < length:
        step = min(have, length - have)
        rank = np.unique(rank << 32 | _shifted(rank, step), return_inverse=True)[1]
        have += step
    return rank


def _shifted(a: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([a[n:], np.zeros(min(n, len(a)), a.dtype)])


def factors_elsewhere(data: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start, in order of position: does its longest previous factor reach ``length``, and does its longest next factor."""
    rank = prefix_ranks(data, length)[start]
    order = np.argsort(rank, kind="stable")
    same = np.append(rank[order][1:] == rank[order][:-1], False)
    earlier, later = np.zeros(len(start), bool), np.zeros(len(start), bool)
    later[order] = same
    earlier[order[1:]] = same[:-1]
    return earlier, later


# -- what is sent between chunks and buckets

def _squeezed(a: np.ndarray) -> bytes:
    """Numbers by byte place, compressed."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 3)


def _restored(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


_SENT = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("heads", pa.binary()), ("body", pa.binary())])
_FOUND = pa.schema([("chunk", pa.int32()), ("runs", pa.binary())])
#: Kinds of what is sent: regions with their bytes, windows with their hashes, runs of windows that are judged already.
_REGIONS, _WINDOWS, _JUDGED = 0, 1, 2


class _Chunk:
    """The documents of a chunk in order, and their bytes end to end."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([("key", "ascending"), ("text", "ascending")]).combine_chunks()
        texts = self.table["text"].combine_chunks()
        texts = (texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)).cast(pa.binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.starts, self.sizes = offsets[:-1] - offsets[0], np.diff(offsets)

    def order_keys(self) -> np.ndarray:
        return self.table["order"].fill_null(_NULL_LAST).to_numpy()


def _bucket_rows(chunk: int, bucket: np.ndarray, kind: int, heads: np.ndarray, body: np.ndarray | None = None, body_sizes: np.ndarray | None = None) -> list[tuple]:
    """One row for each bucket that gets something; heads: a row of numbers for each thing."""
    order = np.argsort(bucket, kind="stable")
    rows = []
    cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else []
    ends = np.cumsum(body_sizes) if body is not None else None
    for own in np.split(order, cuts[1:]) if len(order) else []:
        text = zstandard.compress(_gathered(body, ends[own] - body_sizes[own], body_sizes[own]).tobytes(), 3) if body is not None else None
        rows.append((chunk, int(bucket[own[0]]), kind, _squeezed(heads[own].T.ravel()), text))
    return rows


def _asking(table: pa.Table, length: int, block: int) -> pa.Table:
    own = _Chunk(table)
    seed, n = np.unique(regions(own.data, own.sizes, length, block)[0], return_counts=True)
    return pa.table([pa.array(np.full(len(seed), table["chunk"][0].as_py()), pa.int32()), pa.array(seed.view(np.int64)), pa.array(n)], names=["chunk", "seed", "n"])


def _sending(left: pa.Table, right: pa.Table, length: int, buckets: int, ordered: bool, most: int, block: int) -> pa.Table:
    """What a chunk sends of its regions with repeated seeds. right: those seeds and how often the corpus has them; most: beyond that a seed is hot."""
    if not left.num_rows or not right.num_rows:
        return _SENT.empty_table()
    own, chunk = _Chunk(left), left["chunk"][0].as_py()
    seed, start, n, whole = regions(own.data, own.sizes, length, block)
    asked = right["seed"].to_numpy().view(np.uint64)
    order = np.argsort(asked)
    asked, total = asked[order], right["total"].to_numpy()[order]
    at = np.minimum(np.searchsorted(asked, seed), len(asked) - 1)
    hit = asked[at] == seed
    seed, start, n, whole, total = seed[hit], start[hit], n[hit], whole[hit], total[at[hit]]
    # Regions equal in this chunk: the first stands for all, the others are judged.
    order = np.lexsort((start, n, whole, seed))
    new = np.append(True, (np.diff(seed[order]) != 0) | (np.diff(whole[order]) != 0) | (np.diff(n[order]) != 0))[: len(order)]
    first = order[new]
    more = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
    others = order[~new]
    rows = [(chunk, chunk % buckets, _JUDGED, None, _squeezed(np.stack([start[others], n[others]]).ravel()))] if len(others) else []
    doc = np.searchsorted(own.starts, start[first], side="right") - 1
    keys = own.order_keys()[doc] if ordered else np.zeros(len(first), np.int64)
    seed, start, n, whole, hot = seed[first], start[first], n[first], whole[first], total[first] > most
    cold = ~hot
    heads = np.stack([seed.view(np.int64), whole.view(np.int64), keys, start, n, more.astype(np.int64)], 1)
    size = n + length - 1
    rows += _bucket_rows(chunk, _bucket_of(seed[cold], buckets), _REGIONS, heads[cold], _gathered(own.data, start[cold], size[cold]), size[cold])
    # Windows of hot seeds, of so many regions at a time that their bytes fit a block.
    hot = np.flatnonzero(hot)
    for own_hot in np.split(hot, np.flatnonzero(np.diff(np.cumsum(size[hot]) // block)) + 1) if len(hot) else []:
        count, text = n[own_hot], _gathered(own.data, start[own_hot], size[own_hot])
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(np.cumsum(size[own_hot]) - size[own_hot], count) + within
        one, two = (Hashes(text, base).of(place, place + length) for base in _BASES)
        heads = np.stack([one.view(np.int64), two.view(np.int64), np.repeat(keys[own_hot], count), np.repeat(start[own_hot], count) + within, np.repeat(more[own_hot], count)], 1)
        rows += _bucket_rows(chunk, _bucket_of(one, buckets), _WINDOWS, heads)
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _SENT)], schema=_SENT)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class _Runs:
    """Runs of windows found, by chunk."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, chunk: np.ndarray, start: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((chunk, start, n))

    def table(self, ready: list[tuple[int, bytes]]) -> pa.Table:
        rows = list(ready)
        if self.parts:
            chunk, start, n = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(chunk, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1) if len(order) else []:
                rows.append((int(chunk[own[0]]), _squeezed(np.stack([start[own], n[own]]).ravel())))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 2, _FOUND)], schema=_FOUND)


def _joined(chunk: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Single windows as runs: chunk, start, number of windows."""
    order = np.lexsort((start, chunk))
    chunk, start = chunk[order], start[order]
    first = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (start[1:] > start[:-1] + 1))[: len(chunk)])
    last = np.append(first[1:], len(chunk))[: len(first)] - 1
    return chunk[first], start[first], start[last] - start[first] + 1


def _judging(table: pa.Table, length: int, first: bool, lot: int) -> pa.Table:
    """Of a bucket, the runs of windows that go."""
    runs, kind = _Runs(), table["kind"].to_numpy()
    ready = [(r["chunk"], r["body"]) for r in table.filter(pa.array(kind == _JUDGED)).select(["chunk", "body"]).to_pylist()]
    own = table.filter(pa.array(kind == _REGIONS))
    if own.num_rows:
        heads = [_restored(h, np.int64).reshape(6, -1) for h in own["heads"].to_pylist()]
        chunk = np.repeat(own["chunk"].to_numpy().astype(np.int64), [h.shape[1] for h in heads])
        seed, whole, key, start, n, more = np.concatenate(heads, 1)
        del heads
        text = np.frombuffer(b"".join(map(zstandard.decompress, own["body"].to_pylist())), np.uint8)
        size = n + length - 1
        at = np.cumsum(size) - size
        order = np.lexsort((start, chunk, key, seed))
        # Lots of whole seeds; a seed is in one lot, its regions in order of position.
        ends = np.append(np.flatnonzero(np.diff(seed[order])) + 1, len(order))
        upto = np.cumsum(size[order])[ends - 1]
        lo = 0
        while lo < len(order):
            done = upto[ends.searchsorted(lo, side="right") - 1] if lo else 0
            hi = int(ends[max(ends.searchsorted(lo, side="right"), upto.searchsorted(done + lot, side="right") - 1)])
            _judge_lot(runs, text, length, first, *(x[order[lo:hi]] for x in (seed, whole, chunk, start, n, more, at)))
            lo = hi
    own = table.filter(pa.array(kind == _WINDOWS))
    if own.num_rows:
        heads = [_restored(h, np.int64).reshape(5, -1) for h in own["heads"].to_pylist()]
        chunk = np.repeat(own["chunk"].to_numpy().astype(np.int64), [h.shape[1] for h in heads])
        one, two, key, start, more = np.concatenate(heads, 1)
        del heads
        # Equal hashes lie in one part, so that a fraction of the windows is sorted at a time.
        gone = np.zeros(len(one), bool)
        for part in range(PARTS):
            at = np.flatnonzero(one & PARTS - 1 == part)
            if len(at):
                order = at[np.lexsort((start[at], chunk[at], key[at], two[at], one[at]))]
                new = np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))
                alone = new & np.append(new[1:], True)
                gone[order[~new if first else ~alone | (more[order] > 0)]] = True
        runs.add(*_joined(chunk[gone], start[gone]))
    return runs.table(ready)


def _judge_lot(runs: _Runs, text: np.ndarray, length: int, first: bool, seed: np.ndarray, whole: np.ndarray, chunk: np.ndarray, start: np.ndarray, n: np.ndarray, more: np.ndarray, at: np.ndarray) -> None:
    """Regions of whole seeds, in order of position within a seed."""
    # Equal regions: the first in position stands for all, and the others go.
    order = np.lexsort((np.arange(len(seed)), n, whole, seed))
    new = np.append(True, (np.diff(seed[order]) != 0) | (np.diff(whole[order]) != 0) | (np.diff(n[order]) != 0))
    other = order[~new]
    runs.add(chunk[other], start[other], n[other])
    copied = (np.diff(np.append(np.flatnonzero(new), len(order))) > 1) | (more[order[new]] > 0)
    kept = np.sort(order[new])
    whole_gone = np.zeros(len(seed), bool)
    if not first:
        whole_gone[order[new]] = copied
    # The suffixes of seeds with several regions are sorted; a copied region's windows go anyway, but others may hold them.
    many = np.append(False, np.diff(seed[kept]) == 0) | np.append(np.diff(seed[kept]) == 0, False)
    runs.add(*(x[kept[whole_gone[kept]]] for x in (chunk, start, n)))
    kept = kept[many]
    if not len(kept):
        return
    n, chunk, start = n[kept], chunk[kept], start[kept]
    size = n + length - 1
    data = _gathered(text, at[kept], size)
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(kept)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    earlier, later = factors_elsewhere(data, begin[of] + within, length)
    gone = (earlier if first else earlier | later) & ~whole_gone[kept][of]
    edge = np.flatnonzero(np.append(True, (gone[1:] != gone[:-1]) | (of[1:] != of[:-1])))
    width = np.diff(np.append(edge, len(gone)))
    edge, width = edge[gone[edge]], width[gone[edge]]
    runs.add(chunk[of[edge]], start[of[edge]] + within[edge], width)


def _cutting(left: pa.Table, right: pa.Table, length: int, schema: pa.Schema) -> pa.Table:
    if not left.num_rows:
        return schema.empty_table()
    own = _Chunk(left)
    change = np.zeros(len(own.data) + 1, np.int32)
    for r in right["runs"].to_pylist():
        start, n = _restored(r, np.int64).reshape(2, -1)
        np.add.at(change, start, 1)
        np.add.at(change, start + n + length - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    ends = own.starts + own.sizes
    left_bytes = own.data[~gone]
    upto = np.concatenate([[0], np.cumsum(gone)])
    lost = upto[ends] - upto[own.starts]
    offsets = np.concatenate([[0], np.cumsum(own.sizes - lost)]).astype(np.int32)
    head = np.zeros(len(own.data) + 1, bool)
    head[own.starts] = True
    into = np.flatnonzero(gone & (np.append(True, ~gone[:-1])[: len(gone)] | head[:-1]))
    out = np.flatnonzero(gone & (np.append(~gone[1:], True)[: len(gone)] | head[1:])) + 1
    doc = np.searchsorted(ends, into, side="right")
    spans = pa.StructArray.from_arrays([pa.array(into - own.starts[doc]), pa.array(out - own.starts[doc])], ["start", "end"])
    spans = pa.ListArray.from_arrays(np.searchsorted(into, np.append(own.starts, len(own.data))).astype(np.int32), spans)
    kept = pa.Array.from_buffers(pa.binary(), len(lost), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(left_bytes))])
    return pa.table([own.table["key"], pa.array(own.sizes), spans, kept], names=schema.names).cast(schema)


def substring_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, keep: str = "none") -> DataFrame:
    """key, n_bytes, removed (spans [start, end) of bytes) and kept (the bytes that are left). A byte goes if a string of ``length`` bytes covers it that also starts anywhere else (keep="none") or earlier (keep="first")."""
    if length < 2 or keep not in ("none", "first"):
        raise ValueError("length must be 2 or more, keep one of none and first")
    chunks, buckets = plan(df, text)
    block, lot, most = BLOCK, LOT_BYTES, HOT
    first = keep == "first"
    # The order of documents: by whole numbers as they are, by other keys as Spark hashes them.
    order = F.col(key).cast("long") if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64(key)
    docs = df.select(chunk_of(key, text, chunks).alias("chunk"), F.col(key).alias("key"), order.alias("order"), F.col(text).alias("text"))
    seeds = docs.groupBy("chunk").applyInArrow(lambda t: _asking(t, length, block), "chunk int, seed long, n long")
    again = seeds.groupBy("seed").agg(F.sum("n").alias("total")).where("total > 1")
    asked = seeds.join(again, "seed").select("chunk", "seed", "total")
    sent = docs.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(lambda a, b: _sending(a, b, length, buckets, first, most, block), "chunk int, bucket int, kind int, heads binary, body binary")
    found = sent.groupBy("bucket").applyInArrow(lambda t: _judging(t, length, first, lot), "chunk int, runs binary")
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *T._parse_datatype_string("n_bytes long, removed array<struct<start: long, end: long>>, kept binary").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return docs.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda a, b: _cutting(a, b, length, arrow), schema).withColumnRenamed("key", key)
