"""Removal of repeated strings against a brute-force version over all windows, the arrays on their own, and odd cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from lexloom.llm import queries, substring_dedup


def brute(docs, length, first):
    """Spans and left bytes of each document; docs in order of position."""
    places = defaultdict(list)
    data = [(t or "").encode() for _, t in docs]
    for d, b in enumerate(data):
        for p in range(len(b) - length + 1):
            places[b[p : p + length]].append((d, p))
    gone = [bytearray(len(b)) for b in data]
    for own in places.values():
        for d, p in own[1:] if first else own if len(own) > 1 else []:
            gone[d][p : p + length] = b"\1" * length
    out = []
    for (key, _), b, g in zip(docs, data, gone):
        edges = [i for i in range(len(g) + 1) if (g[i] if i < len(g) else 0) != (g[i - 1] if i else 0)]
        out.append((key, len(b), list(zip(edges[::2], edges[1::2])), bytes(x for x, y in zip(b, g) if not y)))
    return sorted(out, key=repr)


def got(df, **more):
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["removed"]], bytes(r["kept"])) for r in substring_dedup.substring_dedup(df, **more).collect()), key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(8, 40)) for _ in range(6)]
    rows = [(i, " ".join([text(rng.randint(0, 25)), rng.choice(shared), text(rng.randint(0, 25)), *rng.choices(shared, k=rng.randint(0, 2))])) for i in range(60)]
    return rows + [(100, rows[3][1]), (101, rows[3][1] + " x"), (102, ""), (103, None), (104, "z" * 400), (105, "ab" * 150), (106, "y" * 51), (107, "short"), (108, "z" * 49), (None, rows[5][1]), (110, "私" * 60)]


@pytest.mark.parametrize("block, lot, hot", [(1 << 20, 1 << 20, 3000), (1 << 20, 2000, 5), (1 << 20, 500, 0), (64, 1 << 20, 3000), (64, 1000, 3)])
def test_against_all_windows(spark, docs, monkeypatch, block, lot, hot):
    for name, value in (("BLOCK", block), ("LOT_BYTES", lot), ("HOT", hot)):
        monkeypatch.setattr(substring_dedup, name, value)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS chunk", "2 AS n_bytes", "3 AS `Kept`", "4 AS key", "5 AS `order`").repartition(3)
    for keep in ("none", "first"):
        assert got(df, length=50, keep=keep) == brute(docs, 50, keep == "first")


def test_repeated_rows_and_keys(spark):
    rng = random.Random(4)
    a, b = ("".join(rng.choice("abc ") for _ in range(90)) for _ in range(2))
    rows = [(1, a), (1, a), (1, b + a), (2, b), (None, b)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    for keep in ("none", "first"):
        want = brute(sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])), 40, keep == "first")
        assert [r[:2] for r in got(df, length=40, keep=keep)] == [r[:2] for r in want]
        if keep == "none":
            assert got(df, length=40, keep=keep) == want


def test_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert got(df) == []
    assert got(spark.createDataFrame([("k", None)], "doc_id string, text string")) == [("k", 0, [], b"")]
    with pytest.raises(ValueError, match="length"):
        substring_dedup.substring_dedup(df, length=1)


def test_prefix_ranks_are_suffix_order():
    rng = np.random.default_rng(1)
    for length in (2, 3, 7, 8, 9, 50):
        data = rng.integers(97, 99, 400).astype(np.uint8)
        data[200:] = data[:200]
        rank = substring_dedup.prefix_ranks(data, length)[: 400 - length + 1]
        words = [data[i : i + length].tobytes() for i in range(len(rank))]
        place = {w: k for k, w in enumerate(sorted(set(words)))}
        assert all((rank[i] < rank[j]) == (place[words[i]] < place[words[j]]) for i in range(0, len(words), 7) for j in range(len(words)))
        earlier, later = substring_dedup.factors_elsewhere(data, np.arange(len(rank)), length)
        assert earlier.tolist() == [words[i] in words[:i] for i in range(len(words))]
        assert later.tolist() == [words[i] in words[i + 1 :] for i in range(len(words))]


def test_query_against_all_windows(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in queries.documents(spark, sf).collect()]
    want = sorted((k, n, sum(e - s for s, e in spans), len(spans), hashlib.sha256(left).hexdigest()) for k, n, spans, left in brute(docs, 200, False))
    rows = queries.op12_substring_dedup(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows) == want
    assert any(n for _, _, n, _, _ in want)


def test_single_windows_become_runs():
    chunk, start = np.array([1, 0, 1, 1, 0, 1]), np.array([7, 3, 5, 6, 9, 6])
    assert [x.tolist() for x in substring_dedup._joined(chunk, start)] == [[0, 0, 1], [3, 9, 5], [1, 1, 3]]
    assert [len(x) for x in substring_dedup._joined(chunk[:0], start[:0])] == [0, 0, 0]
