"""Language ID by rank-order profiles.

A profile lists the most frequent n-grams (one to four letters, in words padded with "_") by rank. A document's profile is
compared with each language's by the out-of-place distance: for each of the document's n-grams the difference of ranks, or
the largest possible where the language's profile lacks it. The nearest language wins.

Learning covers all labelled rows given: words are counted by language with map-side sums, and n-grams are made of the
distinct words, weighted by their counts. The profiles are as many rows as there are languages times their length, so
they are collected and sent to the tasks; more than MOST_LANGS languages are refused, so that this stays bounded. A
prediction reads the text alone.

Predictions take a slice of documents at a time: words are told apart by 64-bit hashes, each new one is cut into n-grams,
packed into numbers whose order is that of the n-gram's letters, and a document's counts are sums over its distinct words.
A task remembers the n-grams of a bounded number of words.

Defined results: a null text or one without a letter is `und` with score 0, as is every text if nothing was learned. Ties
between n-grams of equal count go by the n-gram, ties between languages by name. Very long texts are read whole. Repeated
rows and null keys are predicted each on their own; an empty table gives an empty result. Columns of the input that carry a
result's name are replaced (the names are parameters); other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import _tally
from lexloom.llm._work import free_name, without_clash

#: Ranks in a language's profile and in a document's, letters in an n-gram, languages at most.
LANG_RANKS, DOC_RANKS, LONGEST, MOST_LANGS = 400, 300, 4, 1000
PIECE = 32
#: Documents and characters in a slice, n-grams of words remembered.
SLICE_DOCS, SLICE_CHARS, MEMO = 512, 400_000, 2_000_000
UNKNOWN, PAD = "und", ord("_")
_STEP = 0x9E3779B97F4A7C15


def learned_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", ranks: int = LANG_RANKS) -> dict[str, dict[str, int]]:
    """n-gram -> rank (from 0) by language. Rows with a null text or lang teach nothing."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word"))
    words = rows.where(F.col("word") != "").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # Long words in pieces that overlap, as a substring costs its place: n-grams begin in a piece's first PIECE letters.
    piece = F.regexp_extract_all(F.concat(F.lit("_"), "word", F.lit("_")), F.lit(f"(?=(.{{1,{PIECE + LONGEST - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    made = F.concat(*[_grams_of(F.col("piece"), n) for n in range(1, LONGEST + 1)])
    counts = words.select("lang", "n", F.explode(piece).alias("piece")).select("lang", "n", F.explode(made).alias("gram")).where(F.col("gram") != "_").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Per language the best ranks of each part first, then of all parts: no task sees all n-grams of a language.
    part = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64)))
    best = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "gram"))
    top = part.withColumn("r", best(["lang", "part"])).where(F.col("r") <= ranks).withColumn("r", best(["lang"])).where(F.col("r") <= ranks)
    found: dict[str, dict[str, int]] = {}
    for row in top.select("lang", "gram", "r").limit(MOST_LANGS * ranks + 1).collect():
        found.setdefault(row["lang"], {})[row["gram"]] = row["r"] - 1
        if len(found) > MOST_LANGS:
            raise ValueError(f"more than {MOST_LANGS} languages to learn")
    return dict(sorted(found.items()))


def _grams_of(piece: Column, n: int) -> Column:
    last = F.least(F.length(piece) - n + 1, F.lit(PIECE))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(piece, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    out = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


def _powers(base: int, many: int) -> np.ndarray:
    out = np.full(many, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Of texts, the words (lower case): document, distinct number, and for each distinct one its hash, place and length in the code points."""

    def __init__(self, texts: list[str | None]):
        lower = [t.lower() if t else "" for t in texts]
        self.codes = _codes("\n".join(lower) + "\n")
        edge = np.flatnonzero(np.diff(_letters()[self.codes].view(np.int8), prepend=0))
        start, stop = edge[::2], edge[1::2]
        ends = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1)
        self.doc = np.searchsorted(ends, start, side="right")
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.codes) + 1, np.uint64)
            np.cumsum(_tally.mixed(self.codes.astype(np.uint64)) * _powers(_STEP, len(self.codes)), out=sums[1:])
            # What stands before a word falls out of the difference, its place by the inverse power.
            hashes = (sums[stop] - sums[start]) * _powers(pow(_STEP, -1, 1 << 64), len(self.codes))[start] + (stop - start).astype(np.uint64)
        self.hashes, first, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.start, self.length = start[first], (stop - start)[first]


def grams_of(codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of words (rows of up to four code points, 0: none), word after word, and how many each word has."""
    padded = np.full(int((length + 2).sum()) + LONGEST, PAD, np.uint32)
    begin = np.cumsum(length + 2) - (length + 2)  # of the pad before a word
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    padded[np.repeat(begin + 1, length) + inner] = codes[np.repeat(start, length) + inner]
    # A word of n letters has n single letters and, padded, n + 3 - k n-grams of k.
    many = [length, *(np.maximum(length + 3 - k, 0) for k in range(2, LONGEST + 1))]
    each = np.sum(many, axis=0)
    out = np.zeros((int(each.sum()), LONGEST), np.uint32)
    place = np.cumsum(each) - each
    for k, own in enumerate(many, 1):
        inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        to, at = np.repeat(place, own) + inner, np.repeat(begin + (k == 1), own) + inner
        for j in range(k):
            out[to, j] = padded[at + j]
        place = place + own
    return out, each


def _packed(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint64)
    return ((c[:, 0] << np.uint64(16) | c[:, 1]) << np.uint64(16) | c[:, 2]) << np.uint64(16) | c[:, 3]


def packed_grams(chars: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each row, ordered as the rows; for rows of known, too (the largest number: has a code point that chars lack)."""
    if chars.max(initial=0) < 1 << 16:
        return _packed(chars), np.where((known >> 16).any(axis=1), np.uint64(2**64 - 1), _packed(known))
    # Code points beyond 16 bits: pairs are ranked among those at hand, and a number is two ranks.
    pair = lambda x, k: x[:, k].astype(np.uint64) << np.uint64(32) | x[:, k + 1]
    ranks = np.unique(np.concatenate([pair(chars, 0), pair(chars, 2)]))
    at = lambda x: np.minimum(np.searchsorted(ranks, x), len(ranks) - 1)
    one, two = ((at(pair(x, 0)) << 32 | at(pair(x, 2))).astype(np.uint64) for x in (chars, known))
    lacks = (ranks[at(pair(known, 0))] != pair(known, 0)) | (ranks[at(pair(known, 2))] != pair(known, 2))
    return one, np.where(lacks, np.uint64(2**64 - 1), two)


class Grams:
    """Numbers, in the n-grams' order, of the n-grams of words met so far, and which of a list of known n-grams each is."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.hashes = self.names = np.zeros(0, np.uint64)
        self.slot = self.start = self.many = self.gram = self.known_at = np.zeros(0, np.int64)

    def places(self, words: Words) -> np.ndarray:
        """The slot of each distinct word; new ones are added."""
        at = np.minimum(np.searchsorted(self.hashes, words.hashes), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != words.hashes) if len(self.hashes) else np.arange(len(words.hashes))
        if len(new):
            chars, each = grams_of(words.codes, words.start[new], words.length[new])
            name, known = packed_grams(chars, self.known)
            names, own = np.unique(name, return_inverse=True)
            merged = np.union1d(self.names, names)
            if len(merged) > len(self.names):
                self.gram = np.searchsorted(merged, self.names)[self.gram]
                self.names, self.known_at = merged, np.full(len(merged), len(self.known))
                k = np.minimum(np.searchsorted(merged, known), len(merged) - 1)
                hit = np.flatnonzero(merged[k] == known)
                self.known_at[k[hit]] = hit
            slots = len(self.many) + np.arange(len(new))
            self.start = np.concatenate([self.start, len(self.gram) + np.cumsum(each) - each])
            self.many = np.concatenate([self.many, each])
            self.gram = np.concatenate([self.gram, np.searchsorted(self.names, names)[own]])
            hashes = np.concatenate([self.hashes, words.hashes[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.slot = hashes[order], np.concatenate([self.slot, slots])[order]
            at = np.searchsorted(self.hashes, words.hashes)
        return self.slot[at]


class Profiles:
    """Distances of texts to the profiles."""

    def __init__(self, profiles: dict[str, dict[str, int]], doc_ranks: int = DOC_RANKS, memo: int = MEMO):
        self.langs, self.doc_ranks, self.memo = list(profiles), doc_ranks, memo
        self.worst = max((len(p) for p in profiles.values()), default=1)
        known = sorted({g for p in profiles.values() for g in p})
        at = {g: i for i, g in enumerate(known)}
        self.table = np.full((len(known) + 1, len(self.langs)), -1, np.int32)
        for k, p in enumerate(profiles.values()):
            for g, r in p.items():
                self.table[at[g], k] = r
        self.known = np.zeros((len(known), LONGEST), np.uint32)
        for i, g in enumerate(known):
            self.known[i, : len(g)] = _codes(g)
        self.grams = Grams(self.known)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, lo = [], 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and hi - lo < SLICE_DOCS and (hi == lo or chars < SLICE_CHARS):
                chars += len(texts[hi] or "")
                hi += 1
            out += self._slice(texts[lo:hi])
            lo = hi
        return out

    def _slice(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = Words(texts)
        if not len(words.doc) or not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.grams.gram) > self.memo:
            self.grams = Grams(self.known)
        # Numbers of n-grams beyond 16 bits hold within the slice only.
        grams = self.grams if words.codes.max() < 1 << 16 else Grams(self.known)
        slot, distinct = grams.places(words), len(words.hashes)
        # The distinct words of each document and their counts.
        pair, n = np.unique(words.doc * distinct + words.number, return_counts=True)
        slot = slot[pair % distinct]
        cuts = np.searchsorted(pair, np.arange(len(texts) + 1) * distinct)
        return [self._nearest(grams, slot[lo:hi], n[lo:hi]) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _nearest(self, grams: Grams, slot: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        """For the distinct words of one document and their counts."""
        if not len(slot):
            return UNKNOWN, 0.0
        each = grams.many[slot]
        g = grams.gram[np.repeat(grams.start[slot] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        counts = np.repeat(n, each)
        # Few n-grams among many numbers are sorted, others counted by number.
        if len(grams.names) > 40 * len(g):
            used, g = np.unique(g, return_inverse=True)
            n = np.bincount(g, counts)
        else:
            n = np.bincount(g, counts)
            used = np.flatnonzero(n)
            n = n[used]
        if len(used) > self.doc_ranks:
            kth = np.partition(n, len(n) - self.doc_ranks)[len(n) - self.doc_ranks]
            keep = n >= kth
            used, n = used[keep], n[keep]
        top = used[np.argsort(-n, kind="stable")[: self.doc_ranks]]
        ranks = self.table[grams.known_at[top]]
        away = np.where(ranks >= 0, np.minimum(np.abs(ranks - np.arange(len(top))[:, None]), self.worst), self.worst).sum(0)
        k = int(np.argmin(away))
        return self.langs[k], round(1.0 - float(away[k]) / (self.worst * len(top)), 6)


def predict_language(df: DataFrame, profiles: dict[str, dict[str, int]], text: str = "text", names: tuple[str, str] = ("lang_pred", "score"), carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, if None) with the predicted language and its score (1: same ranks, 0: no n-gram in common)."""
    base = without_clash(df, list(names))
    kept = base.columns if carry is None else carry
    sent = df.sparkSession.sparkContext.broadcast(profiles)
    schema = T.StructType([*(base.schema[c] for c in kept), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    rows = base.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(free_name(base, "text__")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(sent.value)
        for b in batches:
            got = model.predict(b.column(len(kept)).to_pylist())
            cols = [*b.columns[: len(kept)], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return rows.mapInArrow(run, schema)
