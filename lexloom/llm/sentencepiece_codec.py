"""SentencePiece encoding and decoding in batched numpy.

A text becomes words (a run of space marks and what follows up to the next mark; no piece of the model crosses that place,
which is checked), and the distinct words of equal length advance together. Substring hashes probe the sorted keys of the
pieces, and vectorised maxima store what was best:

* Viterbi: for each end place the best of all pieces that end there is kept with a back-pointer. This is the segmentation
  of a unigram model. For a BPE model, whose scores are merge ranks and no probabilities, its pieces are taken as a
  unigram model with log-probability -log(2 + rank) (Zipf's law; nothing is trained).
* BPE models' own segmentation merges the best pair first, so the words' best pairs are merged round by round, leftmost
  first in ties.

The ids of a model are those of the sentencepiece library (unigram: Viterbi, BPE: merges); sp_round_trip gives the Viterbi
path, too. Characters without a piece fall back to bytes where the model has them, else runs of them to the unknown id. Models that take
out extra blanks do so here.

Defined results: null is taken as empty and gives no ids. A literal space mark (U+2581) decodes to a space, as in the
library. Very long words are merged with a heap, and their Viterbi runs over the pieces found at any place. Repeated rows and
null keys are encoded each on their own; an empty table gives an empty result. Columns named like a result are replaced;
others pass through.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._chunks import ChunkMemo
from lexloom.llm._work import without_clash

MARK = "▁"
#: Words longer than this go one by one; words encoded together; documents and characters in a slice; places probed together.
LONG, TOGETHER, SLICE, SLICE_CHARS, PLACES = 48, 20_000, 512, 1_000_000, 1 << 15
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BLANKS = re.compile(" {2,}")
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            x = data[i]
            i += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[i : i + n]
        i += n


class Model:
    """A model file. Public field numbers: pieces 1 (text 1, score 2, type 3), trainer 2 (type 3), normaliser 3 (name 1, prefix 3, extra spaces 4)."""

    def __init__(self, data: bytes):
        pieces, self.bpe, self.prefix, self.squeeze = [], False, True, True
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]), own.get(3, 1)))
            elif field == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif field == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("models with a character map aren't supported")
                self.prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == 1]
        if any(MARK in p.lstrip(MARK) for p, _, _ in normal):
            raise ValueError("a piece crosses the start of a word")
        self.ids = {p: i for p, _, i in normal}
        self.score = {p: s for p, s, _ in normal}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == 2), 0)
        self.bytes = np.full(256, -1, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.bytes[int(p[3:-1], 16)] = i
        self.longest = max((len(p) for p, _, _ in normal), default=1)
        keys = np.array([self._hash(p) for p, _, _ in normal], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.key_ids = np.array([i for _, _, i in normal], np.int64)[order]
        self.key_scores = np.array([s for _, s, _ in normal], np.float32)[order]
        # The scores of paths: the model's own, or Zipf's law over the merge ranks.
        best_first = np.argsort(-self.key_scores, kind="stable")
        self.path_scores = self.key_scores.copy()
        if self.bpe:
            self.path_scores[best_first] = -np.log(2.0 + np.arange(len(best_first)))
        self.least = float(self.path_scores.min(initial=0.0))
        text = [bytes([int(p[3:-1], 16)]) if kind == 6 else b" \xe2\x81\x87 " if kind == 2 else b"" if kind == 3 else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.out = np.frombuffer(b"".join(text), np.uint8)
        self.out_sizes = np.fromiter(map(len, text), np.int64, len(text))
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) & _MASK
        return h

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the sorted keys, -1 where no piece has the hash."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def _prefixes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' beginnings, and the powers that take a beginning off."""
    n, length = chars.shape
    h, power = np.zeros((n, length + 1), np.uint64), np.ones(length + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            h[:, j + 1] = h[:, j] * np.uint64(_BASE) + chars[:, j] + np.uint64(1)
            power[j + 1] = power[j] * np.uint64(_BASE)
    return h, power


def merged(model: Model, chars: np.ndarray) -> np.ndarray:
    """Of equally long words, the starts of the symbols (true) after merging the best pair as long as there is one."""
    n, length = chars.shape
    h, power = _prefixes(chars)
    result = np.zeros((n, length), bool)
    rows = np.arange(n)
    starts = np.tile(np.arange(length + 1), (n, 1))
    while len(rows):
        if starts.shape[1] > 2:
            a, b = starts[:, :-2], starts[:, 2:]
            with np.errstate(over="ignore"):
                at = model.probe(h[rows[:, None], b] - h[rows[:, None], a] * power[b - a])
            score = np.where(at >= 0, model.key_scores[at], -np.inf)
            best = np.argmax(score, axis=1)
            go = score[np.arange(len(rows)), best] > -np.inf
        else:
            best, go = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        done = rows[~go]
        np.put_along_axis(flags := np.zeros((len(done), length + 1), bool), starts[~go], True, axis=1)
        result[done] = flags[:, :length]
        rows, starts, best = rows[go], starts[go], best[go]
        keep = np.arange(starts.shape[1])[None, :] != (best + 1)[:, None]
        starts = starts[keep].reshape(len(rows), starts.shape[1] - 1)
    return result


def best_paths(model: Model, chars: np.ndarray) -> np.ndarray:
    """Of equally long words, the starts of the pieces (true) of the path with the best total score; ties go to the longer last piece."""
    n, length = chars.shape
    h, power = _prefixes(chars)
    total = np.full((n, length + 1), -np.inf, np.float32)
    total[:, 0] = 0
    back = np.zeros((n, length + 1), np.int64)
    unknown = np.float32(model.least - 10)
    for j in range(1, length + 1):
        sizes = np.arange(min(j, model.longest), 0, -1)
        i = j - sizes
        with np.errstate(over="ignore"):
            at = model.probe(h[:, [j]] - h[:, i] * power[sizes])
        score = np.where(at >= 0, model.path_scores[at], -np.inf).astype(np.float32)
        score[:, -1] = np.where(at[:, -1] >= 0, score[:, -1], unknown)
        path = total[:, i] + score
        best = np.argmax(path, axis=1)
        total[:, j], back[:, j] = path[np.arange(n), best], i[best]
    result, rows, at = np.zeros((n, length), bool), np.arange(n), np.full(n, length)
    while len(rows):
        at = back[rows, at]
        result[rows, at] = True
        rows, at = rows[at > 0], at[at > 0]
    return result


def _long_word(model: Model, word: str) -> list[str]:
    """Symbols of one long word of a BPE model."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (s := model.score.get(word[a : end[b]])) is not None:
            heapq.heappush(heap, (-s, a, b, end[b]))

    for k in range(n - 1):
        offer(k, k + 1)
    gone = [False] * n
    while heap:
        _, a, b, stop = heapq.heappop(heap)
        if gone[a] or gone[b] or after[a] != b or end[b] != stop or end[a] != b:
            continue
        end[a], after[a], gone[b] = end[b], after[b], True
        if after[b] >= 0:
            before[after[b]] = a
        offer(before[a], a)
        offer(a, after[a])
    return [word[k : end[k]] for k in range(n) if not gone[k]]


def _long_path(model: Model, word: str) -> list[str]:
    """The pieces of one long word's best path."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, unknown = len(codes), model.least - 10
    total, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
    for lo in range(0, n, PLACES):
        # Pieces that end in this part may begin before it.
        begin, hi = max(0, lo - model.longest), min(n, lo + PLACES)
        h, power = _prefixes(codes[None, begin:hi])
        ends = np.arange(lo + 1, hi + 1) - begin
        found: list[list[tuple[int, float]]] = [[] for _ in ends]
        for size in range(min(model.longest, hi - begin), 0, -1):
            own = np.flatnonzero(ends >= size)
            e = ends[own]
            with np.errstate(over="ignore"):
                at = model.probe(h[0, e] - h[0, e - size] * power[size])
            hit = at >= 0
            for k, s in zip(own[hit].tolist(), model.path_scores[at[hit]].tolist()):
                found[k].append((size, s))
        for k, pieces in enumerate(found):
            j = lo + 1 + k
            if not pieces or pieces[-1][0] > 1:
                pieces.append((1, unknown))
            for size, s in pieces:
                if total[j - size] + s > total[j]:
                    total[j], back[j] = total[j - size] + s, j - size
    out, j = [], n
    while j:
        out.append(word[back[j] : j])
        j = back[j]
    return out[::-1]


class Codec:
    """Encodes by the model's own segmentation; with both, by the Viterbi path, too."""

    def __init__(self, data: bytes, both: bool = False):
        self.model = Model(data)
        self.ways = [self.model.bpe, False] if both else [self.model.bpe]
        self.memo = ChunkMemo(self._fresh, ways=len(self.ways))

    def _fresh(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self._pieces(words, bpe) for bpe in self.ways]

    def _pieces(self, words: list[str], bpe: bool) -> tuple[np.ndarray, np.ndarray]:
        model, length = self.model, np.fromiter(map(len, words), np.int64, len(words))
        # Of each group of words: which, how many ids each has, and the ids end to end.
        groups = []
        for n in np.unique(length).tolist():
            own = np.flatnonzero(length == n)
            if n > LONG:
                lists = [self._spelled((_long_word if bpe else _long_path)(model, words[k])) for k in own.tolist()]
                groups.append((own, np.fromiter(map(len, lists), np.int64, len(lists)), np.array([i for x in lists for i in x], np.int64)))
                continue
            step = max(1, TOGETHER * 8 // n)
            for j in range(0, len(own), step):
                part = own[j : j + step]
                chars = np.frombuffer("".join([words[k] for k in part.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
                groups.append((part, *self._named(chars, (merged if bpe else best_paths)(model, chars))))
        sizes = np.zeros(len(words), np.int64)
        for own, n, _ in groups:
            sizes[own] = n
        start, flat = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.uint32)
        for own, n, ids in groups:
            flat[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = ids
        return flat, sizes

    def _spelled(self, pieces: list[str]) -> list[int]:
        model, out = self.model, []
        for p in pieces:
            i = model.ids.get(p)
            if i is not None:
                out.append(i)
            elif model.bytes[0] >= 0:
                out += model.bytes[np.frombuffer(p.encode("utf-8", "replace"), np.uint8)].tolist()
            else:
                out.append(model.unknown)
        return out

    def _named(self, chars: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of equally long words has, and the ids of the pieces that begin where begins says."""
        model, length = self.model, chars.shape[1]
        rows, cols = np.nonzero(begins)
        ends = np.append(cols[1:], 0)
        ends[np.append(rows[1:] != rows[:-1], True)] = length
        h, power = _prefixes(chars)
        with np.errstate(over="ignore"):
            at = model.probe(h[rows, ends] - h[rows, cols] * power[ends - cols])
        ids, many = model.key_ids[at], np.ones(len(at), np.int64)
        lacks = np.flatnonzero(at < 0)  # single characters
        codes = chars[rows[lacks], cols[lacks]]
        spelled = {c: self._spelled([chr(c)]) for c in np.unique(codes).tolist()}
        many[lacks] = [len(spelled[c]) for c in codes.tolist()]
        out = np.repeat(ids, many)
        first = (np.cumsum(many) - many)[lacks]
        for c, x in spelled.items():
            for j, i in enumerate(x):
                out[first[codes == c] + j] = i
        return np.bincount(rows, many, len(chars)).astype(np.int64), out

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each way, the ids of all texts end to end, and each text's size."""
        mark = MARK if self.model.prefix else ""
        if self.model.squeeze:
            texts = [_BLANKS.sub(" ", t).strip(" ") if t else t for t in texts]
        found = self.memo.encode([_WORDS.findall(mark + t.replace(" ", MARK)) if t else [] for t in texts])
        return found if self.model.bytes[0] >= 0 else [self._one_unknown(*x) for x in found]

    def _one_unknown(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters next to each other in a text are one id."""
        of = np.repeat(np.arange(len(sizes)), sizes)
        lost = ids == self.model.unknown
        again = np.append(False, lost[1:] & lost[:-1] & (of[1:] == of[:-1]))[: len(ids)]
        return ids[~again], np.bincount(of[~again], minlength=len(sizes)).astype(sizes.dtype)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of ids that lie end to end."""
        m, n = self.model, self.model.out_sizes[ids]
        at = np.concatenate([[0], np.cumsum(n)])
        data = m.out[np.repeat(m.out_starts[ids] - at[:-1], n) + np.arange(at[-1])].tobytes()
        ends = at[np.cumsum(sizes)].tolist()
        out = [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends)]
        return [t[1:] if m.prefix and t.startswith(" ") else t for t in out]


@lru_cache(2)
def codec(path: str, both: bool = False) -> Codec:
    """One codec for all tasks of a worker."""
    with open(path, "rb") as f:
        return Codec(f.read(), both)


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices bounded in documents and characters (a longer document is one of its own)."""
    for b in batches:
        sizes, lo = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist(), 0
        while lo < b.num_rows:
            hi, chars = lo, 0
            while hi < b.num_rows and hi - lo < SLICE and (hi == lo or chars + sizes[hi] <= SLICE_CHARS):
                chars += sizes[hi]
                hi += 1
            yield b.slice(lo, hi - lo)
            lo = hi


def _lists(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), ids.astype(np.int32))


def sp_encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of text. model_path: a file that every executor has."""
    if ids.lower() == text.lower():
        raise ValueError("the ids need a column of their own")
    base = without_clash(df, [ids])
    schema, at = T.StructType([*base.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]), base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for b in _slices(batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(*own.encode(b.column(at).to_pylist())[0])], names=schema.names)

    return base.mapInArrow(run, schema)


def sp_decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of ids; null ids give an empty text."""
    base = without_clash(df, [text])
    schema, at = T.StructType([*base.schema.fields, T.StructField(text, T.StringType())]), base.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for b in batches:
            lists = b.column(at)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.decode(lists.flatten().to_numpy(zero_copy_only=False), sizes), pa.string())], names=schema.names)

    return base.mapInArrow(run, schema)


def sp_round_trip(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key; ids, the model's own segmentation; path, the Viterbi path; same and path_same, whether each decodes to the text. A slice is encoded and decoded in one pass of one worker."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string("ids array<int>, same boolean, path array<int>, path_same boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path, both=True)
        for b in _slices(batches, 1):
            texts, cols = b.column(1).to_pylist(), []
            for ids, sizes in own.encode(texts):
                same = [t == (want or "") for t, want in zip(own.decode(ids, sizes), texts)]
                cols += [_lists(ids, sizes), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
