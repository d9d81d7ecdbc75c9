"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document's shingles (five words in a row) weigh their count in it times 1 + log((D + 1) / (df + 1)), where D documents are
compared and df hold the shingle. Improved consistent weighted sampling draws (shingle, level) samples, two documents
sharing each with the probability of their weighted Jaccard similarity; samples are joined to bands, and documents that
share a band and about half of all samples (by four bits of each) are candidates, verified by their exact weighted Jaccard
similarity. Linked documents, and those linked through others, are one class. `damping` divides the logarithm: 1 is TF-IDF,
infinity the bare counts.

In a large group of near copies the shingles that they share weigh little and the few own ones of each much, the more so the
larger the group and the corpus. With `sets`, documents are also linked if the plain Jaccard similarity of their sets of
shingles is as large as asked: the least hash of each draw is a sample of the set, such samples make as many bands more, and
every comparison looks at both similarities. So a link is lost to neither weights nor a group's size.

Documents of the same words are one text from the start, so copies cost nothing further; D and df count them all. Of a band
that many texts share, no pairs are listed: its texts meet a leader (the text with the most company in all its bands); texts
that thereby join one class are done, and what is left in several classes meets the next leaders, more each time and those
of the smallest classes first, until each text of the band has met, or is of one class with, every other. From the second
round on a band's texts and its leaders are dealt into parts of bounded size, each pair of parts is one group, and its task
compares all of them exactly and returns only the links that join classes. Classes are found by passing on the smallest
label. Nothing of this comes to the driver but row counts.

Words are runs of ASCII letters, digits and underscores and of any characters beyond ASCII, in lower case. Texts of one to
four words are one shingle.

Defined results: a null text, or one without a word, is a class of its own. Null keys take part; a class is named by its
smallest key that isn't null. Rows with the same key are documents of their own. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import _tally
from lexloom.llm._work import written

#: Words in a shingle, least similarity; bands, and samples in each: a pair at 0.8 shares no band with a chance of 0.2 %, one at 0.9 of 1e-6.
WORDS, LEAST, BANDS, ROWS = 5, 0.8, 12, 4
#: Divides the logarithm of the inverse document frequency.
DAMPING = 1.0
#: Shingles sampled together, texts whose digests and tags (32 bytes each) may be broadcast, times as many leaders of a band in each round, texts kept by a task.
TOGETHER, BROADCAST_ROWS, MORE, KNOWN = 16_384, 300_000, 16, 3000
#: Texts and characters in a part of a band and in a block of a part; places of a matrix of comparisons.
PART_TEXTS, PART_CHARS, BLOCK_TEXTS, BLOCK_CHARS, PLACES = 2048, 2_000_000, 256, 128_000, 8192
#: Bytes of UTF-8: what parts words becomes a space.
_WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
#: What a text with a word has, as a regular expression of Spark.
WORD = r"[A-Za-z0-9_]|[^\x00-\x7F]"
_STEP = 0x9E3779B97F4A7C15


class Shingles:
    """Of texts, the distinct shingles of each (sorted keys), how often it has them, and a tag for all its words."""

    def __init__(self, texts: list[str | None], size: int = WORDS):
        sizes, parts, self.tags = [], [], []
        for lo in range(0, len(texts), 128):
            words: list[bytes] = []
            for t in texts[lo : lo + 128]:
                own = t.lower().encode("utf-8", "replace").translate(_WORD_BYTES).split() if t else []
                self.tags.append(xxhash.xxh3_128_digest(b" ".join(own)) if own else None)
                sizes.append(len(own))
                words += own
            coded = pa.array(words, pa.binary()).dictionary_encode()
            parts.append(np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()])
        n = np.array(sizes, np.int64)
        # Gaps after each text, so that short texts have whole windows, too.
        flat, gap = np.zeros(int(n.sum()) + len(n) * (size - 1), np.uint64), np.repeat(np.arange(len(n)) * (size - 1), n)
        flat[np.arange(int(n.sum())) + gap] = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        many = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        start = np.repeat(np.cumsum(n + size - 1) - (n + size - 1) - (np.cumsum(many) - many), many) + np.arange(many.sum())
        key = np.zeros(len(start), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size):
                key = key * np.uint64(_STEP) + flat[start + j]
        key, doc = _tally.mixed(key), np.repeat(np.arange(len(n)), many)
        for hi, k in zip(np.cumsum(many).tolist(), many.tolist()):
            key[hi - k : hi].sort()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.keys, self.counts = key[at], np.diff(at, append=len(key))
        self.sizes = np.bincount(doc[at], minlength=len(n))
        self.ends = np.cumsum(self.sizes)


def weights(counts: np.ndarray, df: np.ndarray, docs: int, damping: float = DAMPING) -> np.ndarray:
    return counts * (1 + np.log((docs + 1) / (df.astype(np.float64) + 1)) / damping)


@cache
def _gamma2() -> tuple[np.ndarray, np.ndarray]:
    """65536 equally likely values of a Gamma(2, 1) variate, and their logarithms."""
    p = (np.arange(65536) + 0.5) / 65536
    lo, hi = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return lo.astype(np.float32), np.log(lo).astype(np.float32)


def samples(keys: np.ndarray, weight: np.ndarray, sizes: np.ndarray, many: int, of_set: np.ndarray | None = None) -> np.ndarray:
    """Of each text (a row; none of its sizes is 0) `many` consistent weighted samples, as hashes of shingle and level.

    of_set gets as many samples of its set of shingles, each the least hash of a draw.
    """
    gamma, log_gamma = _gamma2()
    log_w, ends = np.log(weight).astype(np.float32), np.cumsum(sizes)
    out = np.zeros((len(sizes), many), np.uint64)
    lo = 0
    while lo < len(sizes):
        begin = int(ends[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + TOGETHER, side="right")))
        own, k, w = sizes[lo:hi], keys[begin : ends[hi - 1]], log_w[begin : ends[hi - 1]]
        starts = np.cumsum(own) - own
        row = np.repeat(np.arange(len(own)), own)
        for j in range(many):
            with np.errstate(over="ignore"):
                z = (k ^ np.uint64((j + 1) * _STEP & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                z ^= z >> np.uint64(32)
                z *= np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(29)
            if of_set is not None:
                of_set[lo:hi, j] = np.minimum.reduceat(z, starts)
            bits = z.view(np.uint16).reshape(-1, 4)
            r, beta = gamma.take(bits[:, 0]), bits[:, 2].astype(np.float32) * np.float32(1 / 65536) + np.float32(1 / 131072)
            level = np.floor(w / r + beta)
            a = log_gamma.take(bits[:, 1]) - r * (level - beta + np.float32(1))
            hit = np.flatnonzero(a == np.minimum.reduceat(a, starts)[row])
            hit = hit[np.unique(row[hit], return_index=True)[1]] if len(hit) > len(own) else hit
            with np.errstate(over="ignore"):
                out[lo:hi, j] = _tally.mixed(k[hit] * np.uint64(3) + level[hit].astype(np.int64).astype(np.uint64))
        lo = hi
    return out


def band_keys(sampled: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sampled), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(sampled), b + 1, np.uint64)
            for j in range(rows):
                h = _tally.mixed(h * np.uint64(_STEP) + sampled[:, b * rows + j])
            out[:, b] = h
    return out.view(np.int64)


def sketches(sampled: np.ndarray) -> np.ndarray:
    """Four bits of each sample, sixteen samples to a number."""
    n, many = sampled.shape
    out = np.zeros((n, -(-many // 16)), np.uint64)
    for j in range(many):
        out[:, j // 16] |= (sampled[:, j] & np.uint64(15)) << np.uint64(4 * (j % 16))
    return out.view(np.int64)


def differences(a: str, b: str, many: int, first: int = 0) -> Column:
    """How many of the samples differ in their four bits; first: the number that holds the first ones."""

    def part(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    total = part(first)
    for i in range(first + 1, first - (-many // 16)):
        total = total + part(i)
    return total


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sets: bool = False) -> float:
    """Weighted Jaccard of (sorted keys, weights); sets: or that of the keys alone, if larger."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    weighted = both / (float(a[1].sum()) + float(b[1].sum()) - both)
    return max(weighted, len(i) / (len(a[0]) + len(b[0]) - len(i))) if sets else weighted


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text))


def _sketched(df: DataFrame, key: str, text: str, size: int, bands: int, rows: int, damping: float, sets: bool) -> tuple[DataFrame, int]:
    """Written: key, t (digest of the text), tag, bands, sketch, dfs of each row; the number of rows compared."""
    chunks, buckets = _tally.plan(df, text)
    docs = df.select(_tally.chunk_of(key, text, chunks).alias("chunk"), F.col(key).alias("key"), _digest(text).alias("t"), F.col(text).alias("text"))
    many = df.where(F.col(text).isNotNull()).count()
    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), *T._parse_datatype_string("t binary, tag binary, bands array<bigint>, sketch array<bigint>, dfs binary").fields])

    def request(table: pa.Table) -> pa.Table:
        keys, n = np.unique(Shingles(table["text"].to_pylist(), size).keys, return_counts=True)
        return _tally.asked(table["chunk"][0].as_py(), [(keys, n)], buckets)

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Shingles(left["text"].to_pylist(), size)
        df_ = _tally.totals(right, 1, buckets)[0][np.unique(s.keys, return_inverse=True)[1]] if len(s.keys) else np.zeros(0, np.uint64)
        full = s.sizes > 0
        of_set = np.zeros((int(full.sum()), bands * rows), np.uint64) if sets else None
        sampled = [samples(s.keys, weights(s.counts, df_, many, damping), s.sizes[full], bands * rows, of_set)] + ([of_set] if sets else [])
        lists = [iter(x.tolist()) for x in (band_keys(np.hstack(sampled), bands * len(sampled), rows), np.hstack([sketches(x) for x in sampled]))]
        held = [_tally.planes(x.astype(np.uint32)) if len(x) else None for x in np.split(df_, s.ends[:-1])]
        return pa.table([left["key"].combine_chunks(), left["t"].combine_chunks(), pa.array(s.tags, pa.binary()), *(pa.array([next(x) if f else None for f in full.tolist()], pa.list_(pa.int64())) for x in lists), pa.array(held, pa.binary())], names=schema.names)

    return written(_tally.resolved(docs, request, resolve, schema), "sketches"), many


def _linked(pairs: DataFrame, content: DataFrame, docs: int, least: float, size: int, damping: float, sets: bool) -> DataFrame:
    """The pairs (a, b) of tags that are as similar as asked. Spark splits the joins if a leader has many pairs."""
    side = lambda n: content.select(F.col("tag").alias(n), F.col("text").alias(f"{n}_text"), F.col("dfs").alias(f"{n}_dfs"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "a_dfs", "b_text", "b_dfs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def content_of(tag: bytes, text: str, dfs: bytes) -> tuple[np.ndarray, np.ndarray]:
            if tag not in known:
                s = Shingles([text], size)
                if len(known) >= KNOWN:
                    known.clear()
                known[tag] = s.keys, weights(s.counts, _tally.unplanes(dfs, np.uint32), docs, damping)
            return known[tag]

        for b in _tally.in_slices(batches, 256):
            keep = [similarity(content_of(r["a"], r["a_text"], r["a_dfs"]), content_of(r["b"], r["b_text"], r["b_dfs"]), sets) >= least - 1e-12 for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a binary, b binary")


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Of a matrix that says which rows and columns are linked, so many links only as join what all of them join."""
    rows, columns, out = np.zeros(linked.shape[0], bool), np.zeros(linked.shape[1], bool), []
    for c in np.flatnonzero(linked.any(axis=0)).tolist():
        waiting = [] if columns[c] else [c]
        columns[c] = True
        while waiting:
            at = waiting.pop()
            new = np.flatnonzero(linked[:, at] & ~rows)
            rows[new] = True
            out += [(r, at) for r in new.tolist()]
            further = np.flatnonzero(linked[new].any(axis=0) & ~columns)
            columns[further] = True
            out += zip(new[linked[new][:, further].argmax(axis=0)].tolist(), further.tolist()) if len(further) else []
            waiting += further.tolist()
    return out


def similarities(a: Shingles, a_weights: np.ndarray, b: Shingles, b_weights: np.ndarray, sets: bool = False) -> np.ndarray:
    """Weighted Jaccard of each text of a with each of b; a shingle weighs as much for each time that a text has it. sets: or that of the sets, if larger."""
    common = np.intersect1d(a.keys, b.keys)

    def sides(s: Shingles, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        doc = np.repeat(np.arange(len(s.sizes)), s.sizes)
        at = np.minimum(np.searchsorted(common, s.keys), max(len(common) - 1, 0))
        hit = common[at] == s.keys if len(common) else np.zeros(len(s.keys), bool)
        return doc[hit], at[hit], s.counts[hit], (w / s.counts)[hit], np.bincount(doc, w, len(s.sizes))

    (a_doc, a_at, a_n, one, a_all), (b_doc, b_at, b_n, _, b_all) = sides(a, a_weights), sides(b, b_weights)
    each = np.zeros(len(common))
    each[a_at] = one
    both, shared = np.zeros((2, len(a.sizes), len(b.sizes)))
    # The n-th time that one text has a shingle meets the n-th time of the other; what holds for all n between two counts is done at once.
    levels = np.union1d(a_n, b_n)
    levels = levels[levels <= min(a_n.max(initial=0), b_n.max(initial=0))]
    for level, (n, times) in enumerate(zip(levels.tolist(), np.diff(levels, prepend=0).tolist())):
        x, y = a_n >= n, b_n >= n
        places = np.intersect1d(a_at[x], b_at[y])
        for lo in range(0, len(places), PLACES):
            own = places[lo : lo + PLACES]
            sides_ = []
            for doc, at, rows in ((a_doc[x], a_at[x], len(a.sizes)), (b_doc[y], b_at[y], len(b.sizes))):
                m, k = np.zeros((rows, len(own))), np.minimum(np.searchsorted(own, at), len(own) - 1)
                hit = own[k] == at
                m[doc[hit], k[hit]] = 1
                sides_.append(m)
            both += (sides_[0] * (each[own] * times)) @ sides_[1].T
            if sets and level == 0:
                shared += sides_[0] @ sides_[1].T
    weighted = both / np.maximum(a_all[:, None] + b_all[None, :] - both, 1e-300)
    return np.maximum(weighted, shared / np.maximum(a.sizes[:, None] + b.sizes[None, :] - shared, 1)) if sets else weighted


def _parts(rows: DataFrame, content: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (band, tag, label) with text and dfs; and how many parts each band's rows make."""
    rows = rows.join(content.withColumn("chars", F.length("text")), "tag")
    return rows, rows.groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PART_TEXTS), F.ceil(F.sum("chars") / PART_CHARS)).alias("parts"))


def _in_blocks(table: pa.Table) -> Iterator[list[dict]]:
    block, chars = [], 0
    for row in table.to_pylist():
        block.append(row)
        chars += len(row["text"])
        if len(block) >= BLOCK_TEXTS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _met(rest: DataFrame, lead: DataFrame, content: DataFrame, docs: int, least: float, size: int, damping: float, sets: bool) -> DataFrame:
    """Links (a, b) that join what the texts of each band and its leaders have in common, if not of one class yet: every pair is compared exactly.

    A band's texts and leaders are dealt into parts of bounded size by a hash; each pair of parts is a group of its own, so
    that neither a hot band nor its texts lie in one task.
    """
    left, left_parts = _parts(rest.select("band", "tag", "label"), content)
    right, right_parts = _parts(lead.select("band", F.col("leader").alias("tag"), F.col("own").alias("label")), content)
    parts = left_parts.select("band", F.col("parts").alias("l")).join(right_parts.select("band", F.col("parts").alias("r")), "band")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(parts, "band").withColumn(f"{own}_part", F.pmod(F.xxhash64("tag"), F.col(own)))
        return rows.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("band", "l_part", "r_part", F.lit(own == "r").alias("leads"), "tag", "label", "text", "dfs")

    def side(texts: list[dict]) -> tuple[Shingles, np.ndarray]:
        s = Shingles([t["text"] for t in texts], size)
        return s, weights(s.counts, np.concatenate([_tally.unplanes(t["dfs"], np.uint32) for t in texts]), docs, damping)

    def compared(table: pa.Table) -> pa.Table:
        leads, ends = table["leads"].combine_chunks(), []
        lefts, rights = table.filter(pc.invert(leads)), table.filter(leads)
        blocks = [(b, side(b)) for b in _in_blocks(rights)] if lefts.num_rows else []
        for a in _in_blocks(lefts) if blocks else []:
            own = side(a)
            for b, theirs in blocks:
                names = {x: k for k, x in enumerate({t["label"] for t in a + b})}
                classes = [np.array([names[t["label"]] for t in texts]) for texts in (a, b)]
                apart = classes[0][:, None] != classes[1][None, :]
                if apart.any():
                    ends += [(a[i]["tag"], b[j]["tag"]) for i, j in spanning(apart & (similarities(*own, *theirs, sets) >= least - 1e-12))]
        return pa.table([pa.array([f(e) for e in ends], pa.binary()) for f in (min, max)], names=["a", "b"])

    return dealt(left, "l", "r").unionByName(dealt(right, "r", "l")).groupBy("band", "l_part", "r_part").applyInArrow(compared, "a binary, b binary").distinct()


def _labels(edges: DataFrame, before: DataFrame | None) -> DataFrame:
    """tag, label: the smallest tag of each component; before: labels of an earlier, smaller set of edges."""
    both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = both.select(F.col("a").alias("tag")).distinct()
    now = now.withColumn("label", F.col("tag")) if before is None else now.join(before, "tag", "left").withColumn("label", F.coalesce("label", "tag"))
    now = written(now, "labels")
    while True:
        near = both.join(now.withColumnRenamed("tag", "b"), "b").groupBy(F.col("a").alias("tag")).agg(F.min("label").alias("near"))
        step = now.join(near, "tag").select("tag", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("tag").alias("label"), F.col("label").alias("further"))
        after = written(step.join(jump, "label", "left").select("tag", "old", F.coalesce("further", "label").alias("label")), "labels")
        now = after.select("tag", "label")
        if after.where(F.col("old") != F.col("label")).isEmpty():
            return now


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, size: int = WORDS, bands: int = BANDS, rows: int = ROWS, damping: float = DAMPING, sets: bool = False) -> DataFrame:
    """key, class_id (the smallest key of its class), class_size, and copies, the rows with the same words: one row for each row of df."""
    found, many = _sketched(df, key, text, size, bands, rows, damping, sets)
    texts = written(found.where(F.col("tag").isNotNull()).select("tag", "sketch", "bands").distinct(), "texts")
    members = texts.select("tag", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(members.join(shared, "band"), "members")
    company = members.groupBy("tag").agg(F.sum("n").alias("company")).join(texts.select("tag", "sketch"), "tag")
    rest = written(members.join(company, "tag").select("band", "tag", "sketch", "company", F.col("tag").alias("label")), "rest")
    # Of a pair at `least` so many samples differ with a chance of 1e-4 only.
    sampled = bands * rows
    most_apart = math.ceil(sampled * (1 - least) + 3.7 * math.sqrt(sampled * least * (1 - least)))
    labels = edges = content = None
    for k in range(1 << 30):
        live = rest.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
        rest = written(rest.join(live, "band"), "rest")
        if rest.isEmpty():
            break
        if content is None:
            content = _content(df, found, rest.select("tag").distinct(), text)
        # At first those with the most company lead; later those of the smallest classes, as each must meet all the others.
        order = [F.desc("company")] if k < 2 else ["others", F.desc("company")]
        sized = rest if k < 2 else rest.join(rest.groupBy("band", "label").agg(F.count(F.lit(1)).alias("others")), ["band", "label"])
        first = F.row_number().over(Window.partitionBy("band").orderBy(*order, "tag"))
        lead = written(sized.withColumn("rank", first).where(F.col("rank") <= MORE ** min(k, 4)).select("band", "rank", F.col("tag").alias("leader"), F.col("label").alias("own"), F.col("sketch").alias("theirs")), "leaders")
        if k == 0:
            close = differences("sketch", "theirs", sampled) <= most_apart
            close = close | (differences("sketch", "theirs", sampled, -(-sampled // 16)) <= most_apart) if sets else close
            met = rest.join(lead, "band").where((F.col("label") != F.col("own")) & close).select(F.least("tag", "leader").alias("a"), F.greatest("tag", "leader").alias("b")).distinct()
            links = _linked(written(met, "pairs"), content, many, least, size, damping, sets)
        else:
            links = _met(rest, lead, content, many, least, size, damping, sets)
        new = written(links, "links")
        rest = rest.join(lead.select("band", F.col("leader").alias("tag")), ["band", "tag"], "left_anti")
        if not new.isEmpty():
            edges = new if edges is None else edges.union(new)
            labels = _labels(edges, labels)
            rest = rest.drop("label").join(labels, "tag", "left").withColumn("label", F.coalesce("label", "tag")).select("band", "tag", "sketch", "company", "label")
    rows_ = found.select("key", "tag")
    if labels is None:
        rows_ = rows_.withColumn("label", F.col("tag"))
    else:
        rows_ = rows_.join(labels, "tag", "left").withColumn("label", F.coalesce("label", "tag"))
    copies = rows_.where(F.col("tag").isNotNull()).groupBy("label", "tag").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("low"))
    classes = copies.groupBy("label").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size"))
    by_tag = written(copies.join(classes, "label").select("tag", "class_id", "class_size", "copies"), "classes")
    out = found.select("key", "tag").join(by_tag, "tag", "left")
    alone = F.col("tag").isNull()
    return out.select(
        F.col("key").alias(key),
        F.when(alone, F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("copies"),
    )


def _content(df: DataFrame, found: DataFrame, tags: DataFrame, text: str) -> DataFrame:
    """Written: tag, text and dfs, once for each of the tags."""
    source = written(found.join(tags, "tag", "left_semi").groupBy("tag").agg(F.min(F.struct("t", "dfs")).alias("x")).select("tag", "x.*"), "sources")
    ids = source.select("t", "tag")
    # So few that they may go to every task; else both sides are shuffled, and Spark splits the copies of a frequent text.
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = df.select(_digest(text).alias("t"), F.col(text).alias("text"))
    return written(texts.join(ids, "t").select("tag", "text").dropDuplicates(["tag"]).join(source.select("tag", "dfs"), "tag"), "content")
