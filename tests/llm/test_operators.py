"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its defined results in odd cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import language_id, license_scan, line_dedup, lm_scoring, near_dup, packing, quality_rules, queries, sentencepiece_codec, token_files, topk_search

SF = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, N_Words long, tag string"


def rnd_words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, clashing column names."""
    rng = random.Random(1)
    body = " ".join(rnd_words(rng, 80))
    rows = [(1, body, "en", "a"), (1, body, "en", "a"), (2, None, None, None), (3, "", "en", None), (None, body + " x", "en", "a"), (4, " \n\t ", None, "b"), (5, "\n".join([body] * 40), "de", "b"), (6, "x" * 200_000, "de", "b"), (7, "Ünïcode ⁇ \x00 ▁ end", None, "b"), (None, None, None, None)]
    return spark.createDataFrame([(*r, 5, "t") for r in rows], DOCS)


def docs(spark):
    return queries.documents(spark, SF)


# -- top-k

def test_topk_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-3, 4, (300, 8)) / 256
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (None, [0.1] * 8), (903, [1e5] * 3), (10, [float(x) for x in v[11]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank")
    out = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.exact_topk(df, df["vec_id"] % 50 == 0, k=7).collect()]
    w = np.floor(256 * v.astype(np.float32).astype(np.float64)).astype(int)
    cand = [(i, w[i]) for i in range(300)] + [(10, w[11])]
    for q in range(0, 300, 50):
        best = sorted((-int(w[q] @ x), i) for i, x in cand if i != q)[:7]
        assert sorted((r, i, s) for a, r, i, s in out if a == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_topk_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.exact_topk(df, df["vec_id"] >= 0).collect() == []


# -- SentencePiece

def test_sentencepiece_equals_the_library_and_round_trips(spark, odd):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for df in (docs(spark).select("doc_id", "text"), odd.withColumn("ids", F.lit("old")).withColumn("decoded", F.lit("old"))):
        rows = sentencepiece_codec.sp_decode(sentencepiece_codec.sp_encode(df, model), model).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert list(r["ids"]) == sp.encode(r["text"] or "")
            assert r["decoded"] == sp.decode(list(r["ids"]))
        both = {(r["doc_id"], tuple(r["ids"])): r for r in sentencepiece_codec.sp_round_trip(df, model).collect()}
        for r in rows:
            own = both[r["doc_id"], tuple(r["ids"])]
            assert own["same"] == own["path_same"] == ("\u2581" not in (r["text"] or ""))
    assert sentencepiece_codec.sp_round_trip(odd.limit(0), model).collect() == []


def test_viterbi_path_of_the_public_pieces_is_the_best(spark):
    codec = sentencepiece_codec.Codec(open(P.path("piece_bpe_32k.model"), "rb").read(), both=True)
    model = codec.model
    score = {p: float(model.path_scores[np.searchsorted(model.keys, np.uint64(model._hash(p)))]) for p in model.ids}
    rng = random.Random(12)
    words = ["".join(rng.choice("abtheöé私") for _ in range(rng.randint(1, 20))) for _ in range(40)] + ["abthe" * 15 + "私" + "z" * 30]
    ids, sizes = codec.encode(words)[1]
    for word, own in zip(words, np.split(ids, np.cumsum(sizes)[:-1])):
        text, total = "\u2581" + word, [0.0]
        for j in range(1, len(text) + 1):
            ways = [total[i] + score[text[i:j]] for i in range(max(0, j - model.longest), j) if text[i:j] in score]
            total.append(max(ways + ([] if text[j - 1] in score else [total[j - 1] + model.least - 10])))
        pieces = [p for i in own.tolist() for p, k in model.ids.items() if k == i]
        lost = sum(c not in score for c in text)
        assert sum(score[p] for p in pieces) + lost * (model.least - 10) == pytest.approx(total[-1], abs=1e-3)
    assert codec.decode(ids, sizes) == words


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("squeeze", [None, 0, 1])
def test_models_without_bytes_or_that_squeeze_blanks(kind, squeeze):
    """Hand-made model files, against the library."""
    import sentencepiece

    def field(n, payload):
        return bytes([n << 3 | 2, len(payload)]) + payload

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -2, 1), ("a", -3, 1), ("b", -3.5, 1), ("ab", -4, 1), ("▁a", -4.2, 1), ("▁ab", -7, 1), ("▁▁", -8, 1)]
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([0x18, k])) for p, s, k in pieces)
    data += field(2, bytes([0x18, kind])) + field(3, b"\x18\x01" + (b"" if squeeze is None else bytes([0x20, squeeze])))
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sentencepiece_codec.Codec(data)
    texts = ["ab a", " ab  a ", "   ", "xyz ab xx", "a" * 60 + "xx" * 3, "x", "", "a  x  y  b", "xaxxbx"]
    ids, sizes = codec.encode(texts)[0]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [sp.encode(t) for t in texts]


def test_unigram_viterbi_against_all_paths():
    pieces = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -4.2, "ba": -5.0, "aba": -6.5, "▁ab": -7.0, "bb": -6.9}

    def field(n, payload):
        return bytes([n << 3 | 2, len(payload)]) + payload

    data = field(1, field(1, b"<unk>") + b"\x15" + np.float32(0).tobytes() + b"\x18\x02")
    for p, s in pieces.items():
        data += field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes())
    data += field(2, b"\x18\x01") + field(3, b"\x18\x01")
    codec = sentencepiece_codec.Codec(data)
    names = ["<unk>", *pieces]

    def best(w):
        if not w:
            return 0.0
        return max((pieces[w[:n]] + best(w[n:]) for n in range(1, len(w) + 1) if w[:n] in pieces), default=-math.inf)

    rng = random.Random(3)
    for _ in range(60):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        ids = codec.encode([word])[0][0]
        assert "".join(names[i] for i in ids) == "▁" + word
        assert sum(pieces[names[i]] for i in ids) == pytest.approx(best("▁" + word), abs=1e-4)


# -- line dedup

def brute_lines(rows, size=3):
    seen, out = set(), {}
    for key, text in sorted((r for r in rows if r[0] is not None and r[1] is not None)):
        lines = text.split("\n")
        gone = set()
        for i in range(max(len(lines) - size + 1, 1)):
            w = tuple(lines[i : i + size])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone |= set(range(i, min(i + size, len(lines))))
                seen.add(w)
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcdef") * rng.choice((0, 1, 1, 1)) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == brute_lines(rows)


def test_line_dedup_of_odd_rows(spark, odd):
    out = line_dedup.line_dedup(odd).collect()
    assert len(out) == odd.count()
    assert sorted(r["text"] or "" for r in out if r["doc_id"] is None) == sorted(["", next(r["text"] for r in odd.collect() if r["doc_id"] is None and r["text"])])
    assert line_dedup.line_dedup(odd.limit(0)).collect() == []


# -- token files

def test_token_files_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for df in (docs(spark), odd.where("doc_id IS NOT NULL")):
        manifest = token_files.write_token_files(df, P.path("byte_bpe_50k.json"), end_id=2, length=64)
        got = sorted((r["start"], r["key"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_documents(manifest).collect())
        start, want = 0, []
        for key, text in sorted((r["doc_id"], r["text"] or "") for r in df.collect()):
            tok.encode_special_tokens = True
            ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
            want.append((start, key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert got == want
        for row in manifest.collect():
            f = token_files.SequenceFile(row["file"])
            assert len(f) == row["n_sequences"] == -(-row["n_tokens"] // 64)
            ids, mask = f.sequence(len(f) - 1)
            assert len(ids) == 64 and mask.sum() == (row["n_tokens"] - 1) % 64 + 1


def test_token_files_of_null_keys_and_of_nothing(spark, odd):
    path = P.path("byte_bpe_50k.json")
    rows = token_files.read_token_documents(token_files.write_token_files(odd, path, end_id=2)).orderBy("start").collect()
    assert [r["key"] for r in rows][:2] == [None, None] and len(rows) == odd.count()
    assert rows[0]["n_tokens"] == 1  # a null text
    assert token_files.read_token_documents(token_files.write_token_files(odd.limit(0), path, end_id=2)).collect() == []


# -- LM scoring

def brute_base(rows):
    learn = [t for _, t, on in rows if on]
    c = Counter(w for t in learn for w in t)
    n, v = sum(c.values()), len(c)
    return n, {k: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t) for k, t, _ in rows}, {k: sum(c[w] > 0 for w in t) for k, t, _ in rows}


def test_lm_base_and_gain_on_held_out_documents(spark):
    rows = queries.op5_lm_scoring(spark, SF).collect()
    table = {r["doc_id"]: r["text"] or "" for r in docs(spark).collect()}
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    tokens = [(k, [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), ""], zlib.crc32(str(k).encode()) % 5 != 1) for k, t in table.items()]
    n, base, known = brute_base(tokens)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["train_tokens"], r["n_known"]) == (n, known[r["doc_id"]])
        assert r["base_score"] == pytest.approx(base[r["doc_id"]], rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_lm(rows, chunk, chunks, order):
    """Exact expectation-maximisation on the raw held-out counts; rows: key, tokens, learn."""
    grams = lambda t: [tuple((["\0"] * order + t)[i + order - k + 1 : i + order + 1] for k in range(1, order + 1)) for i in range(len(t))]

    def counted(of):
        c = Counter()
        for _, t, learn in of:
            if learn:
                for g in grams(t):
                    c.update(map(tuple, g))
        return c

    def parts(g, c, n, v):
        """The estimates from the longest n-gram down, and the context's bucket."""
        out = []
        for k in range(order, 1, -1):
            before = tuple(g[k - 1][:-1])
            ctx = c[before] if "\0" not in before else c[("\0",)] if set(before) == {"\0"} else c[before]
            out.append((c[tuple(g[k - 1])] / ctx if ctx else 0.0, ctx))
        return [x for x, _ in out] + [c[tuple(g[0])] / n if n else 0.0, 1 / (v + 1)], out[0][1].bit_length()

    whole = counted(rows)
    n, v = sum(x for g, x in whole.items() if len(g) == 1), sum(len(g) == 1 for g in whole)
    ends = sum(learn for _, _, learn in rows)
    whole[("\0",)] = ends
    held = []
    for c in range(chunks):
        own = [r for r in rows if chunk[r[0]] == c]
        left = Counter(whole)
        left.subtract(counted(own))
        left[("\0",)] -= sum(learn for _, _, learn in own)
        held += [parts(g, left, n * (1 - 1 / chunks), v) for _, t, learn in own if learn for g in grams(t)]
    weights = {b: np.full(order + 1, 1 / (order + 1)) for _, b in held}
    for _ in range(lm_scoring.ROUNDS):
        new = {b: np.r_[np.zeros(order), 0.5] for b in weights}
        for p, b in held:
            x = weights[b] * p
            new[b] += x / x.sum()
        weights = {b: x / x.sum() for b, x in new.items()}
    for b in range(64):
        weights.setdefault(b, weights.get(b - 1, np.r_[np.zeros(order), 1.0]))
    out = {}
    for k, t, _ in rows:
        got = [parts(g, whole, n, v) for g in grams(t)]
        out[k] = sum(math.log10(weights[b] @ np.array(p)) for p, b in got)
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_against_exact_expectation_maximisation(spark, order):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(40)]
    texts = []
    for i in range(150):
        t = [rng.choice(vocabulary[:8])]
        while len(t) < rng.randint(1, 25):
            t.append(vocabulary[(vocabulary.index(t[-1]) * 3 + rng.choice([0, 0, 0, 1, 7])) % 40])
        texts.append(t)
    rows = [(i, t, i % 5 != 1) for i, t in enumerate(texts)] + [(1000, ["w1"], False), (1001, ["zz", "zz"], False), (1002, [], False)]
    df = spark.createDataFrame([(i, " ".join(t), learn) for i, t, learn in rows], "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(df, df["learn"], order=order).collect()}
    chunks, _ = lm_scoring._tally.plan(df, "text")
    chunk = {r["doc_id"]: r["c"] for r in df.select("doc_id", lm_scoring._tally.chunk_of("doc_id", "text", chunks).alias("c")).collect()}
    want = brute_lm([(k, [*t, "\0"], learn) for k, t, learn in rows], chunk, chunks, order)
    # The grid's cells round the held-out counts, for the weights alone.
    assert got == pytest.approx(want, rel=0.03)
    assert got[1000] > got[1001]


def test_lm_of_odd_rows(spark, odd):
    assert len(lm_scoring.lm_scores(odd, F.lit(True)).collect()) == odd.count()
    nothing = lm_scoring.lm_scores(odd, F.lit(False)).collect()
    assert {(r["score"], r["base_score"], r["train_tokens"]) for r in nothing} == {(0.0, 0.0, 0)}
    assert lm_scoring.lm_scores(odd.limit(0), F.lit(True)).collect() == []


# -- packing

def test_packing_is_whole_and_fits(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, 1, 2, 3, 50, 511, 512, 513, 900, 4096, 4097, 20_000, rng.randint(1, 3000)])) for i in range(800)] + [(1, 7), (1, 7)]
    out = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()
    assert sum(r["size"] for r in out) == sum(n or 0 for _, n in rows)
    bins = defaultdict(list)
    for r in out:
        bins[r["bin"], r["capacity"]].append((r["offset"], r["size"]))
    assert len(bins) == len({b for b, _ in bins})
    for (_, cap), own in bins.items():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0
        used = own[-1][0] + own[-1][1]
        assert used <= cap and cap == min(c for c in packing.CAPACITIES if c >= used)
    waste = sum(c for _, c in bins) / sum(r["size"] for r in out)
    assert waste < 1.1


def plain_best_fit(sizes, capacity):
    bins = []
    for n in sorted(sizes, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= n]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(n)
        else:
            bins.append([n])
    return bins


@pytest.mark.parametrize("capacities", [(512,), (512, 1024, 2048, 4096)])
def test_packing_against_a_plain_best_fit(spark, capacities):
    rng = random.Random(14)
    rows = [(i, rng.choice([1, 30, 200, 300, rng.randint(1, 512)])) for i in range(400)]
    out = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "1 AS bin", "2 AS Size", "3 AS n"), capacities=capacities).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r["bin"]].append(r["size"])
    plain = plain_best_fit([n for _, n in rows], max(capacities))
    if len(capacities) == 1:
        assert sorted(map(sorted, bins.values())) == sorted(map(sorted, plain))
    downsized = sum(next(c for c in capacities if c >= sum(b)) for b in plain)
    assert sum({r["bin"]: r["capacity"] for r in out}.values()) <= downsized


def test_packing_of_very_long_texts(spark):
    out = packing.best_fit_packing(spark.createDataFrame([(1, 10_000_000), (None, 5)], "doc_id long, n_tokens long")).collect()
    assert len(out) == 10_000_000 // 4096 + 2 and sum(r["size"] for r in out) == 10_000_005


def test_packing_of_nothing(spark):
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []


# -- language ID

def test_language_id_on_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in docs(spark).collect()}
    rows = [r for r in queries.op7_language_id(spark, SF).collect() if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(rows) > 20 and sum(lang[r["doc_id"]] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def brute_language(text, profiles, ranks=language_id.DOC_RANKS):
    grams = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        grams.update(w)
        for n in (2, 3, 4):
            grams.update(f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n))
    if not grams or not profiles:
        return "und", 0.0
    top = [g for _, g in sorted((-n, g) for g, n in grams.items())[:ranks]]
    worst = max(map(len, profiles.values()))
    away = {l: sum(min(abs(p[g] - i), worst) if g in p else worst for i, g in enumerate(top)) for l, p in profiles.items()}
    best = min(away, key=away.get)
    return best, round(1 - away[best] / (worst * len(top)), 6)


def test_language_id_against_brute_force(spark):
    rng = random.Random(15)
    learned = docs(spark).select("text", "lang").union(spark.createDataFrame([("q\u00fcz" * 30 + " " + "ab" * 17, "en")], "text string, lang string"))
    profiles = language_id.learned_profiles(learned)
    counts = defaultdict(Counter)
    for r in learned.collect():
        for w in re.findall(r"[^\W\d_]+", r["text"].lower()) if r["text"] and r["lang"] else []:
            counts[r["lang"]].update(w)
            for n in (2, 3, 4):
                counts[r["lang"]].update(f"_{w}_"[i : i + n] for i in range(len(w) + 3 - n))
    assert profiles == {l: {g: i for i, (_, g) in enumerate(sorted((-n, g) for g, n in c.items())[: language_id.LANG_RANKS])} for l, c in counts.items()}
    # Letters beyond 16 bits, ties, repeated rows, words that a small memory forgets.
    texts = [r["text"] for r in docs(spark).collect()] + [None, "", "12 _ -", "\U00020000\U00020001 a", "\u79c1\u306f \U0001d400x", "ab ba", "ab ba", "x" * 50_000]
    texts += [" ".join(rnd_words(rng, 50)) + chr(rng.randint(0x20000, 0x20100)) for _ in range(5)]
    want = [brute_language(t, profiles) for t in texts]
    assert language_id.Profiles(profiles).predict(texts) == want
    assert language_id.Profiles(profiles, memo=100).predict(texts) == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r["l"], r["s"]) for r in language_id.predict_language(df, profiles, names=("l", "s"), carry=["doc_id"]).orderBy("doc_id").collect()] == want


def test_language_id_of_odd_rows(spark, odd):
    profiles = language_id.learned_profiles(odd)
    out = language_id.predict_language(odd, profiles).collect()
    assert len(out) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if not re.search(r"[^\W\d_]", r["text"] or ""))
    assert {r["lang_pred"] for r in language_id.predict_language(odd, {}).collect()} == {"und"}
    assert language_id.learned_profiles(odd.limit(0)) == {}
    assert language_id.predict_language(odd.limit(0), profiles).collect() == []


# -- near-duplicates

def brute_classes(rows, least=0.8):
    words = {k: re.findall(r"(?:[a-z0-9_]|[^\x00-\x7f])+", (t or "").lower()) for k, t in rows}
    sh = {k: Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) for k, w in words.items() if w}
    df = Counter(s for c in sh.values() for s in c)
    n = sum(t is not None for _, t in rows)
    weigh = lambda c: {s: x * (1 + math.log((n + 1) / (df[s] + 1))) for s, x in c.items()}
    w = {k: weigh(c) for k, c in sh.items()}
    up = {k: k for k, _ in rows}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(sorted(w), 2):
        if w[a].keys() & w[b].keys():
            both = sum(min(x, w[b].get(s, 0)) for s, x in w[a].items())
            if both / (sum(w[a].values()) + sum(w[b].values()) - both) >= least:
                i, j = sorted((top(a), top(b)))
                up[j] = i
    return {k: top(k) for k, _ in rows}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()]
    passage = rnd_words(rng, 60)
    for base in range(6):
        w = passage[: 10 * base] + rnd_words(rng, 200)
        for c in range(8):
            v = list(w)
            for i in rng.sample(range(len(v)), c):
                v[i] = "changed" + str(rng.random())[2:8]
            rows.append((10_000 + base * 100 + c, " ".join(v)))
    rows += [(20_000, "one two"), (20_001, "One, two!"), (20_002, "one"), (20_003, None), (20_004, "..."), (20_005, "...")]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows)
    wrong = [(r["doc_id"], r["class_id"], want[r["doc_id"]]) for r in out if r["class_id"] != want[r["doc_id"]]]
    assert len(out) == len(rows) and not wrong
    size = Counter(want.values())
    assert all(r["class_size"] == size[r["class_id"]] for r in out)


def test_a_class_is_found_through_its_centre(spark):
    """Copies that are near the same text, not near each other."""
    rng = random.Random(7)
    w = rnd_words(rng, 300)
    rows = [(500, " ".join(w))]
    for c in range(60):
        v = list(w)
        for i in range(c, c + 300, 100):
            v[i % 300] = f"new{c}x{i}"
        rows.append((c, " ".join(v)))
    rows += [(1000 + c, " ".join(rnd_words(rng, 20))) for c in range(600)]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in out} == want and len({want[k] for k, _ in rows[:61]}) == 1


def test_near_duplicates_of_odd_rows(spark, odd):
    out = near_dup.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    assert sorted(r["class_size"] for r in out if r["class_id"] == 1) == [3, 3, 3]  # the null key's text is one word longer
    assert near_dup.near_duplicates(odd.limit(0)).collect() == []


def test_samples_collide_as_often_as_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(1, 1 << 62, 90).astype(np.uint64))
    a, b = (keys[:70], rng.uniform(0.5, 3, 70)), (keys[20:], rng.uniform(0.5, 3, 70))
    s = near_dup.samples(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.array([70, 70]), 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(near_dup.similarity(a, b), abs=0.03)


# -- quality rules

def test_quality_of_odd_rows(spark, odd):
    out = quality_rules.host_quality(odd, carry=["doc_id", "tag"]).collect()
    assert len(out) == odd.count() and set(out[0].asDict()) == {"doc_id", "tag", *quality_rules.COUNTS, "host_rate", "kept"}
    assert all(not r["kept"] and r["n_words"] == 0 for r in out if r["doc_id"] in (2, 3, 4))
    assert quality_rules.host_quality(odd.limit(0)).collect() == []


def test_a_host_of_bad_documents_is_rejected(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rnd_words(rng, 120))
    rows = [(i, "too short" if i % 10 else good(), "bad") for i in range(100)] + [(100 + i, good(), f"h{i % 5}") for i in range(200)] + [(999, good(), None)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(kept[i] for i in range(100)) and all(kept[i] for i in range(100, 300)) and kept[999]


# -- licences

def test_licences(spark, odd):
    text = "Intro words here.\nPermission is hereby granted; free of charge, to ANY person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software\nmore"
    df = spark.createDataFrame([(1, text), (2, "Released under the MIT License"), (3, "nothing of the kind"), (4, None), (5, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in license_scan.license_scan(df).collect()}
    assert got == {(1, "MIT"), (2, "MIT")}
    assert license_scan.license_scan(odd).collect() == []
    assert license_scan.license_scan(df, templates={}).collect() == []


def test_wrapped_and_embedded_notices(spark):
    import textwrap

    rng = random.Random(9)
    prose = lambda n: "\n".join(" ".join(rnd_words(rng, 15)) for _ in range(n))
    mit, apache, gpl = (license_scan.TEMPLATES[x][1] for x in ("MIT", "Apache-2.0", "GPL-3.0"))
    texts = [
        prose(6) + "\n" + textwrap.fill(mit, 72) + "\n" + prose(6),
        "Copyright 2020 the authors of this package. " + license_scan.TEMPLATES["Apache-2.0"][0] + " All rights reserved.",
        prose(2) + "\n// " + textwrap.fill(gpl, 60).replace("\n", "\n// ") + " and so on\n" + prose(40) + " " + apache + " " + prose(3),
        prose(3) + "\n" + " ".join(mit.split()[:20]) + "\n" + prose(3),
        prose(30),
    ]
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()

    def brute(text, name):
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        two, best = list(zip(words, words[1:])), 0
        for t in license_scan.TEMPLATES[name]:
            w = re.sub(r"[\W_]+", " ", t.lower()).split()
            have = set(zip(w, w[1:]))
            for at in range(len(two)):
                for n in range(1, min(int(1.5 * len(have) + 1e-9), len(two) - at) + 1):
                    own = set(two[at : at + n])
                    best = max(best, 2 * len(own & have) / (len(own) + len(have)))
        return best

    want = {(i, name): d for i, t in enumerate(texts) for name in license_scan.TEMPLATES if (d := brute(t, name)) >= 0.8}
    assert want.keys() == {(0, "MIT"), (1, "Apache-2.0"), (2, "GPL-3.0"), (2, "Apache-2.0")}
    assert {(r["doc_id"], r["license"]): r["dice"] for r in got} == pytest.approx(want)
    assert next((r["kind"], r["at"]) for r in got if r["doc_id"] == 0) == ("window", 90)


# -- the registered SQL

def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
        assert got == sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())), name


def brute_quality(rows):
    """kept of each row (key, text, source)."""
    fails, good = defaultdict(list), []
    for _, t, host in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        three = Counter(zip(w, w[1:], w[2:]))
        again = {j for i in range(len(w) - 2) if three[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
        n = max(len(w), 1)
        base = len(w) < 50 or 100 * len(again) > 50 * len(w)
        chars = sum(map(len, w))
        bad = base or sum(c in quality_rules.SYMBOLS for c in t or "") > n * 0.5 or chars < 2 * n or chars > 20 * n or 4 * (len(lines) - len(set(lines))) > n
        good.append(not base)
        if host is not None:
            fails[host].append(bad)
    rates = [sum(x) / len(x) for x in fails.values()]
    a, b = quality_rules.beta_prior(float(np.mean(rates)), float(np.var(rates, ddof=1)) if len(rates) > 1 else None, float(np.mean([1 / len(x) for x in fails.values()])), len(rates))
    return [g and (h is None or (sum(fails[h]) + a) / (len(fails[h]) + a + b) <= 0.6) for g, (_, _, h) in zip(good, rows)]


def test_pipeline_and_each_stage_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(16)
    source = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs(spark).limit(70).collect()]
    body = lambda n=90: " ".join(rnd_words(rng, n))
    a, b = body(), "\n".join(" ".join(rnd_words(rng, 12)) for _ in range(8))
    near = a.split()
    near[4] = "changed"
    rows = source + [(900, a, "en", "h1", 1), (901, a, "en", "h1", 1), (901, a, "en", "h1", 1), (902, " ".join(near), "en", None, 1), (902, body(), None, "h1", None), (None, a, "en", "h2", 1), (None, body(), "en", "h2", 1), (903, None, None, None, None), (904, "", "en", "h1", 0), (905, b + "\n" + body(), "de", "h3", 1), (906, body() + "\n" + b, "de", "h3", 1), (907, "1 2 3 4 5 " * 4 + " ".join(map(str, range(60))), "en", "h3", 1), (908, "bad", "en", "h4", 3)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, Score string, lang_pred string, n_removed string, row_id string, t string, bin string"
    df = spark.createDataFrame([(*r, *["own"] * 7) for r in rows], kind)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    same = lambda got, want: sorted(map(repr, got)) == sorted(map(repr, want))
    stages, step = dict(corpus_pipeline.STAGES), df
    assert list(stages) == ["quality_rules", "language_id", "line_dedup", "minhash_near_dedup", "best_fit_packing"]

    def advance(name):
        nonlocal step
        step = stages[name](spark, step, str(tmp_path))
        assert step.columns == df.columns
        found = step.collect()
        assert all(r[5:] == ("own",) * 7 for r in map(tuple, found))
        step = spark.createDataFrame(found, step.schema)
        return [tuple(r)[:5] for r in found]

    got = advance("quality_rules")
    want = [r for r, k in zip(rows, brute_quality([(r[0], r[1], r[3]) for r in rows])) if k]
    assert same(got, want) and len(want) > 40
    got, profiles = advance("language_id"), language_id.learned_profiles(spark.createDataFrame([(r[1], r[2]) for r in want], "text string, lang string"))
    near_enough = [brute_language(r[1], profiles) for r in want]
    want = [r for r, (lang, score) in zip(want, near_enough) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE]
    assert same(got, want) and not any(r[0] == 907 for r in want)
    got = advance("line_dedup")
    text = brute_lines({((r[0] is None, r[0] or 0, r[1]), r[1]) for r in want})
    cut = [(r, text[r[0] is None, r[0] or 0, r[1]]) for r in want]
    want = [(r[0], t, r[2], r[3], r[4] if t == r[1] else len(t)) for r, t in cut if t or not r[1]]
    assert same(got, want) and any(t != r[1] for r, t in cut)
    got = advance("minhash_near_dedup")
    classes = brute_classes([(k, r[1]) for k, r in enumerate(want)])
    assert len(got) == len(set(classes.values())) and set(map(repr, got)) <= set(map(repr, want))
    texts = defaultdict(set)
    for k, r in enumerate(want):
        texts[classes[k]].add(repr((r[0], r[1])))
    kept = [repr((r[0], r[1])) for r in got]
    assert all(sum(x in own for x in kept) == 1 for own in texts.values())
    assert all(r[0] is not None for r in got if r[1] == a)
    out = stages["best_fit_packing"](spark, step, str(tmp_path)).collect()
    assert sum(r["size"] for r in out) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) + 1 for r in got)
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert same([tuple(r) for r in run], [tuple(r) for r in out])


def test_pipeline_of_nothing(spark):
    import corpus_pipeline

    df = docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
        assert df.collect() == []
        df = docs(spark).limit(0)


def test_similarities_of_blocks_are_those_of_pairs():
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base[k] if rng.random() < 0.95 else f"x{rng.integers(9)}" for k in range(40)) for _ in range(12)] + ["a " * 30, "a " * 11 + "b", "one", "a a a a a a"]
    s = near_dup.Shingles(texts)
    df = s.keys % np.uint64(7) + np.uint64(1)
    w = near_dup.weights(s.counts, df, 50)
    parts = list(zip(np.split(s.keys, s.ends[:-1]), np.split(w, s.ends[:-1])))
    got = near_dup.similarities(s, w, s, w)
    assert got == pytest.approx(np.array([[near_dup.similarity(a, b) for b in parts] for a in parts]))


def test_spanning_links_join_what_all_links_join():
    def classes(links, rows, columns):
        label = list(range(rows + columns))
        for _ in label:
            for r, c in links:
                label[r] = label[rows + c] = min(label[r], label[rows + c])
        return label

    rng = np.random.default_rng(6)
    for k in range(30):
        m = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.1 * (k % 5)
        found = near_dup.spanning(m)
        assert all(m[i, j] for i, j in found) and len(found) < max(1, sum(m.shape))
        assert classes(found, *m.shape) == classes(list(zip(*np.nonzero(m))), *m.shape)


def test_texts_of_a_large_band_meet_in_blocks(spark):
    # Texts far enough from the first leader, so that classes are told apart and joined by later rounds.
    rng = np.random.default_rng(8)
    base, rows = [f"w{k}" for k in range(120)], []
    for i in range(150):
        rows.append((i, " ".join(f"y{rng.integers(10**6)}" if k in set(rng.integers(0, 120, i % 6)) else x for k, x in enumerate(base))))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    s = near_dup.Shingles([t for _, t in rows])
    df = np.unique(s.keys, return_inverse=True, return_counts=True)
    w = near_dup.weights(s.counts, df[2][df[1]], len(rows))
    linked = near_dup.similarities(s, w, s, w) >= near_dup.LEAST
    label = np.arange(len(rows))
    for _ in rows:
        label = np.where(linked, label[None, :], len(rows)).min(axis=1)
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(label.tolist()))


def test_the_near_duplicate_stage_keeps_one_row_of_each_class(spark):
    import corpus_pipeline

    rng = random.Random(11)
    a, b, c, d = (" ".join(rnd_words(rng, 90)) for _ in range(4))
    # Key 1 repeats with other texts, one a copy of key 0's; a row that repeats whole; null keys beside and without a key; texts without a word.
    rows = [(0, a), (1, a), (1, b), (1, c), (5, d), (5, d), (5, d), (None, d), (None, c + " end"), (None, "x " + d), (None, b[:200]), (None, b[:200]), (7, None), (7, None), (8, "..."), (None, "...")]
    df = spark.createDataFrame([(k, t, "en", "a", 5, "t") for k, t in rows], DOCS)
    out = corpus_pipeline.near_duplicates(spark, df, SF)
    assert out.columns == df.columns
    want = [(0, a), (1, b), (1, c), (5, d), (None, b[:200]), (7, None), (7, None), (8, "..."), (None, "...")]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, want))


def test_licences_are_scanned_in_texts_that_hold_an_anchor(spark, monkeypatch):
    from lexloom.llm import license_scan

    kept, keep = [], license_scan.written
    monkeypatch.setattr(license_scan, "written", lambda df, name: kept.append(keep(df, name)) or kept[-1])
    texts = ["nothing of it " * 9, "x\nLicensed under CC\nBY-NC 4.0.", "Released, under the MIT license", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in license_scan.license_scan(rows).collect()}
    assert got == {(1, "CC-BY-NC-4.0"), (2, "MIT")} and {r["doc_id"] for r in kept[0].collect()} == {1, 2}
