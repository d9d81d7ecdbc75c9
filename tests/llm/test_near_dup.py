"""Near copies in a group so large that TF-IDF weights alone tell them apart."""

import random

import numpy as np
import pytest

from lexloom.llm import near_dup, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def large_group():
    """140 near copies of one text with up to eight other words in it, and texts of their own."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, rows = [word() for _ in range(160)], []
    for i in range(140):
        w = list(base)
        for at in rng.sample(range(160), i % 9):
            w[at] = word()
        rows.append((i, " ".join(w)))
    return rows + [(1000 + i, " ".join(word() for _ in range(80))) for i in range(160)]


def brute_links(rows):
    """Which texts are linked by their weights, and which by their sets of shingles."""
    s = near_dup.Shingles([t for _, t in rows])
    _, own, df = np.unique(s.keys, return_inverse=True, return_counts=True)
    w = near_dup.weights(s.counts, df[own], len(rows))
    sets = [{tuple(x) for x in zip(*(t.split()[j:] for j in range(5)))} for _, t in rows]
    jaccard = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    return near_dup.similarities(s, w, s, w) >= near_dup.LEAST, jaccard >= near_dup.LEAST


def classes(rows, linked):
    label = np.arange(len(rows))
    for _ in rows:
        label = np.where(linked, label[None, :], len(rows)).min(axis=1)
    return {k: rows[x][0] for (k, _), x in zip(rows, label.tolist())}


def test_op8_finds_near_copies_in_a_large_group(spark, tmp_path):
    rows = large_group()
    weighted, by_set = brute_links(rows)
    want = classes(rows, weighted | by_set)
    # By weights alone many of them are classes of their own.
    assert len(set(classes(rows, weighted).values())) > len(set(want.values())) + 20
    table = spark.createDataFrame([(k, t, "en", "h", len(t)) for k, t in rows], DOCS)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["class_id"] for r in queries.op8_near_duplicates(spark, str(tmp_path)).collect()} == want
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(table).collect()} == classes(rows, weighted)


def test_the_pipeline_keeps_one_of_a_large_group(spark):
    import corpus_pipeline

    rows = large_group()
    want = set(classes(rows, np.logical_or(*brute_links(rows))).values())
    table = spark.createDataFrame([(k, t, "en", "h", len(t)) for k, t in rows], DOCS)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, "").collect()} == want


def test_similarities_of_sets():
    texts = ["a b c d e f g h", "a b c d e f g x", "a b c d e " * 9, "a b c d e " * 3, "one", "one one one one one one", "z y"]
    s = near_dup.Shingles(texts)
    w = near_dup.weights(s.counts, s.keys % np.uint64(7) + np.uint64(1), 50)
    parts = list(zip(np.split(s.keys, s.ends[:-1]), np.split(w, s.ends[:-1])))
    jaccard = np.array([[len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())) for b, _ in parts] for a, _ in parts])
    want = np.maximum(near_dup.similarities(s, w, s, w), jaccard)
    assert near_dup.similarities(s, w, s, w, True) == pytest.approx(want) and jaccard[2, 3] == 1 and want[2, 3] > near_dup.similarity(parts[2], parts[3])
    assert np.array([[near_dup.similarity(a, b, True) for b in parts] for a in parts]) == pytest.approx(want)


def test_least_hashes_collide_as_often_as_the_jaccard_similarity():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(1, 1 << 62, 90).astype(np.uint64))
    of_set = np.zeros((2, 4000), np.uint64)
    near_dup.samples(np.concatenate([keys[:70], keys[20:]]), rng.uniform(0.5, 9, 140), np.array([70, 70]), 4000, of_set)
    assert (of_set[0] == of_set[1]).mean() == pytest.approx(50 / 90, abs=0.03)
