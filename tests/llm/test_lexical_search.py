"""Ranked search against a brute-force version, small blocks and strides included, and its odd cases."""

import math
import random
import re
from collections import Counter

import pytest

from lexloom.llm import lexical_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    own = [(key, Counter(plain_terms(t))) for key, t in docs]
    own = [(key, c, sum(c.values())) for key, c in own if c]
    n_docs, total, df = len(own), sum(n for _, _, n in own), Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(plain_terms(text)), []
        for key, c, n in own:
            m = 25 + 75 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                found.append((-s, key is None, key or 0))
        out += [(item, r + 1, None if none else key, -s) for r, (s, none, key) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["Day", "day", "été", "Été", "x1", "私は", "_", "a-b", "It's", *(f"w{i}" for i in range(40))]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(150)]
    docs += [(i, docs[7][1]) for i in range(500, 520)] + [(7, docs[7][1]), (None, docs[7][1]), (None, None), (900, ""), (901, " -- \x00 "), (902, "w1 " * 40_000), (903, " 　")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(25)] + [(3, "w1 w1 w1 day"), (None, "w2 DAY"), (80, None), (81, ""), (82, "nowhere"), (83, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("block, stride, few, lot", [(4_000_000, 4096, 16, 8 << 20), (300, 5, 1, 300)])
def test_against_brute_force(spark, texts, monkeypatch, block, stride, few, lot):
    for name, value in (("BLOCK", block), ("STRIDE", stride), ("FEW", few), ("LOT_BYTES", lot)):
        monkeypatch.setattr(lexical_search, name, value)
    docs, items = texts
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS `Rank`", "2 AS terms", "3 AS item_id").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score")
    for k in (1, 4):
        assert rows(lexical_search.ranked_search(df, asked, k=k)) == brute(docs, items, k)


def test_strides_end_early_and_change_nothing():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n, terms = 3000, 30
    docs = np.sort(rng.integers(0, n, 40_000))
    pairs = np.unique(docs * terms + (rng.zipf(1.3, len(docs)) % terms))
    docs, words = pairs // terms, pairs % terms
    impacts = rng.integers(1, 60, len(pairs)) * (1 + words)
    block = lexical_search.Block(pa.array(np.arange(n)), docs, words, impacts, terms)
    for few in [1, 16] * 10:
        own = rng.choice(terms, 5, replace=False)
        times = rng.integers(1, 3, 5)
        dense = np.zeros(terms, np.int64)
        dense[own] = times
        all_scores = np.bincount(docs, dense[words] * impacts, n).astype(np.int64)
        best = sorted(zip((-all_scores).tolist(), range(n)))[:10]
        at, scores = block.search(own, times, dense, 10, 1, 50, few)
        assert len(at) < n
        assert sorted(zip((-scores).tolist(), at.tolist()))[:10] == best


def test_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert lexical_search.ranked_search(docs, items).collect() == []
    assert lexical_search.ranked_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []
    with pytest.raises(ValueError, match="k must be"):
        lexical_search.ranked_search(docs, items, k=0)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in queries.documents(spark, sf).collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows(queries.op13_lexical_search(spark, sf)) == brute(docs, items, 10)
