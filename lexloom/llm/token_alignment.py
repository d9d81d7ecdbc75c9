"""Alignment of two tokenizers' tokens over the bytes of the same texts.

A text with a space before it is cut into chunks at spaces that no token of either tokenizer crosses; the distinct new chunks
of a slice are encoded and aligned together. Each byte has an owner among A's tokens and one among B's (``np.repeat`` of the
tokens' places by their sizes). Where the pair of owners changes a new link begins, the pairs in a row being all overlaps;
where both change at once lies a cut between two groups.

align_tokens gives each document's groups and linked ids; pair_counts tells how often two ids are linked in the whole corpus, and
link_scores each document's sums of those counts. The counts are sent to all tasks only while they are few
(BROADCAST_PAIRS); beyond that it is a shuffled join. Counts are summed in the tasks first, so a pair in every document is a
row for each task.

Defined results: null and empty texts, and texts whose tokens of A or B don't give back the text with a space before it
(those with a literal U+2581), have no links. Repeated rows and null keys are documents each of its own, told apart by the
column ``row``. An empty table gives an empty result. Very long texts are aligned whole; chunks of more than 64 characters
are not remembered. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._chunks import ChunkMemo
from lexloom.llm.sentencepiece_codec import MARK, _slices
from lexloom.llm.token_files import _UNSAFE

#: Pairs of ids whose counts may be sent to every task; bytes of the memo; new chunks taken together.
BROADCAST_PAIRS, MEMO_BYTES, FRESH = 3_000_000, 96 << 20, 8192
#: A place that neither tokenizer's tokens cross, in texts with runs of white space.
_CUT = re.compile(r"(?<=[^ ])(?= \S)")
#: A link that goes on with the token of the link before it.
SAME = np.uint32(1 << 31)


def byte_level_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies and their bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Bytes:
    """The bytes of each id's token, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[ids]
        return self.data[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


class Aligner:
    """Links of texts between a byte-level tokenizer (A, a file of the tokenizers library) and a sentencepiece model (B)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of, names = byte_level_alphabet(), self.a.get_vocab()
        spelled = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            spelled[i] = bytes(of[c] for c in name if c in of)
        self.a_bytes = _Bytes(spelled)
        b = self.b
        self.b_bytes = _Bytes([bytes([int(p[3:-1], 16)]) if b.is_byte(i) else b"" if b.is_control(i) or b.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))])
        self.memo = ChunkMemo(self._fresh, MEMO_BYTES, ways=2)

    def _fresh(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = []
        for lo in range(0, len(chunks), FRESH):
            own = chunks[lo : lo + FRESH]
            a, a_n = _flat([e.ids for e in self.a.encode_batch_fast(own, add_special_tokens=False)])
            b, b_n = _flat(self.b.encode([c[1:] for c in own], num_threads=1))
            parts.append(aligned(self, own, a, a_n, b, b_n))
        return [(np.concatenate([p[way][0] for p in parts]), np.concatenate([p[way][1] for p in parts])) for way in (0, 1)]

    def links(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of all links end to end (with SAME where the token is that of the link before) and each text's number of links."""
        cut = []
        for t in texts:
            if not t or MARK in t:
                cut.append([])
            elif _UNSAFE.search(t) or t[0].isspace():
                cut.append(_CUT.split(" " + t))
            else:
                cut.append((" " + t).replace(" ", "\x00 ").split("\x00")[1:])
        (a, n), (b, _) = self.memo.encode(cut)
        # A chunk that isn't given back is one link of no token; its text has no links.
        if (bad := np.flatnonzero((a & ~SAME) == _NONE)).size:
            lost = np.zeros(len(n), bool)
            lost[np.unique(np.searchsorted(np.cumsum(n), bad, side="right"))] = True
            keep = ~np.repeat(lost, n)
            a, b, n = a[keep], b[keep], np.where(lost, 0, n)
        return a, b, n


_NONE = np.uint32(SAME - 1)


def aligned(own: Aligner, chunks: list[str], a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The links of chunks by byte owners: A's and B's ids with SAME, each with the numbers of links by chunk."""
    want = [c.encode("utf-8", "surrogatepass") for c in chunks]
    size = np.fromiter(map(len, want), np.int64, len(want))
    good = np.ones(len(chunks), bool)
    for ids, n, table in ((a, a_n, own.a_bytes), (b, b_n, own.b_bytes)):
        good &= np.bincount(np.repeat(np.arange(len(n)), n), table.sizes[ids], len(n)) == size
    of_a, of_b = np.repeat(np.arange(len(chunks)), a_n), np.repeat(np.arange(len(chunks)), b_n)
    text = np.frombuffer(b"".join(w for w, g in zip(want, good) if g), np.uint8)
    of_byte = np.repeat(np.flatnonzero(good), size[good])
    for ids, of, table in ((a, of_a, own.a_bytes), (b, of_b, own.b_bytes)):
        good[of_byte[table.joined(ids[good[of]])[0] != text[good[of_byte]]]] = False
        of_byte, text = of_byte[good[of_byte]], text[good[of_byte]]
    a, b = a[good[of_a]], b[good[of_b]]
    owner_a, owner_b = (np.repeat(np.arange(len(x)), t.sizes[x]) for x, t in ((a, own.a_bytes), (b, own.b_bytes)))
    new_a, new_b = (np.append(True, o[1:] != o[:-1])[: len(o)] for o in (owner_a, owner_b))
    at = np.flatnonzero(new_a | new_b)
    ids = [np.where(new[at], x[o[at]], x[o[at]] | int(SAME)).astype(np.uint32) for new, x, o in ((new_a, a, owner_a), (new_b, b, owner_b))]
    n = np.bincount(of_byte[at], minlength=len(chunks))
    if good.all():
        return [(x, n) for x in ids]
    n[~good] = 1
    ends = np.cumsum(n)
    out = []
    for x in ids:
        full = np.full(int(ends[-1]), _NONE, np.uint32)
        full[np.repeat(good, n)] = x
        out.append((full, n))
    return out


@lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for all tasks of a worker."""
    return Aligner(a_path, b_path)


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), values)


def _grouped(link_a: np.ndarray, link_b: np.ndarray, n: np.ndarray, names: dict[int, str]) -> list:
    """Numbers of A's and B's tokens and of groups by text, and the groups as text."""
    doc = np.repeat(np.arange(len(n)), n)
    new_a, new_b = link_a < SAME, link_b < SAME
    cut = new_a & new_b
    group = np.cumsum(cut)
    # Tokens in the order of the text form: by group, A's before B's, each followed by its separator.
    token = np.concatenate([link_a[new_a], link_b[new_b]])
    place = np.concatenate([2 * group[new_a], 2 * group[new_b] + 1])
    order = np.argsort(place, kind="stable")
    token, place = token[order], place[order]
    last = np.append(place[1:] != place[:-1], True)[: len(place)]
    texts = _spelled(token, 2 * (place & 1) + last, names)
    per = [np.bincount(doc[x], minlength=len(n)) for x in (new_a, new_b, cut)]
    ends = np.cumsum(per[0] + per[1]).tolist()
    return [*map(pa.array, per), pa.array(["".join(texts[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends)], pa.string())]


def _paired(link_a: np.ndarray, link_b: np.ndarray, n: np.ndarray) -> list:
    """Each text's distinct pairs of linked ids and how often it has them."""
    known, at = np.unique((link_b & ~SAME).astype(np.int64) << 32 | (link_a & ~SAME), return_inverse=True)
    own, times = np.unique(np.repeat(np.arange(len(n)), n) * max(len(known), 1) + at, return_counts=True)
    many = np.bincount(own // max(len(known), 1), minlength=len(n))
    return [_lists(known[own % max(len(known), 1)], many), _lists(times.astype(np.int32), many)]


def align_tokens(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, key, n_a, n_b, n_groups, n_links (long), groups (the ids of each group as `a1,a2|b1;a3|b2`, empty without links), pairs and times (the distinct linked ids, B's in the upper and A's in the lower 32 bits, and how often).

    row numbers the texts as they come, so write what is kept of the result before using it twice.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), rows.schema["key"], *T._parse_datatype_string("n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row, names = aligner(a_path, b_path), TaskContext.get().partitionId() << 33, {}
        for b in _slices(batches, 1):
            link_a, link_b, n = own.links(b.column(1).to_pylist())
            n_a, n_b, n_groups, groups = _grouped(link_a, link_b, n, names)
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), b.column(0), n_a, n_b, n_groups, pa.array(n), groups, *_paired(link_a, link_b, n)], names=schema.names)
            row += len(n)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def _each_pair(aligned_texts: DataFrame) -> DataFrame:
    return aligned_texts.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")


def pair_counts(aligned_texts: DataFrame) -> DataFrame:
    """pair, n: how many links of the corpus hold it, most: the highest n of B's id."""
    counts = _each_pair(aligned_texts).groupBy("pair").agg(F.sum("times").alias("n"))
    of_b = counts.groupBy(F.shiftright("pair", 32).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(of_b, F.shiftright("pair", 32) == F.col("b")).select("pair", "n", "most")


def link_scores(aligned_texts: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best (links whose pair is its B id's most frequent), count_sum (of the pairs' counts, over links); rows without links are left out. counts: a written table."""
    few = counts.count() <= BROADCAST_PAIRS
    met = _each_pair(aligned_texts).join(F.broadcast(counts) if few else counts, "pair")
    return met.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))


#: After a token of A within and at the end of its side of a group, and the same of B.
SEPARATORS = (",", "|", ",", ";")


def _spelled(token: np.ndarray, kind: np.ndarray, known: dict[int, str]) -> list[str]:
    """Each token's number with its separator; known: texts made before, at most four for each id."""
    both = token.astype(np.int64) * 4 + kind
    out = list(map(known.get, both.tolist()))
    if None in out:
        for x in np.unique(both).tolist():
            if x not in known:
                known[x] = f"{x >> 2}{SEPARATORS[x & 3]}"
        out = list(map(known.__getitem__, both.tolist()))
    return out
