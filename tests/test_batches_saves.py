"""Batches against a plain fold on any partitioning, their context, and the merging of saved differences."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import batches as B
from lexloom.operators import saves


def plain(rows, most, lines):
    out, batch, total, n, group = {}, -1, 0, 0, object()
    for g, o, size in sorted(rows):
        if g != group or total + size > most or total >= most or n >= lines:
            batch, total, n, group = batch + 1, 0, 0, g
        total, n = total + size, n + 1
        out[g, o] = batch
    return out


@pytest.mark.parametrize("partitions, block, chain", [(1, 1 << 16, 512), (7, 64, 512), (40, 50, 3), (5, 20, 2)])
def test_batches_equal_a_plain_fold(spark, monkeypatch, partitions, block, chain):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "CHAIN", chain)
    rng = random.Random(partitions)
    rows = [(rng.choice("abc"), i, rng.choice([1, 2, 5, 30, 200])) for i in range(1200)]
    for most, lines in ((60, 20), (1, 5), (10_000, 20)):
        want = plain(rows, most, lines)
        out = B.group_batches(spark.createDataFrame(rows, "g string, o long, s int").repartition(partitions), "g", "o", "s", most, lines).collect()
        assert {(r["g"], r["o"]): r["batch"] for r in out} == want


def test_batches_of_odd_rows(spark):
    df = spark.createDataFrame([(None, 1, 5), ("a", 1, None), ("a", 2, -3), ("a", 3, 9999), ("a", 4, 1)], "g string, o long, s int")
    got = {(r["g"], r["o"]): r["batch"] for r in B.group_batches(df, "g", "o", "s", 10, 3).collect()}
    assert got == {(None, 1): 0, ("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("a", 4): 3}
    assert B.group_batches(df.limit(0), "g", "o", "s").collect() == []


def test_context_of_batches(spark):
    lines = spark.createDataFrame([("en" if i < 12 else "ru", i, f"t{i}") for i in range(20)], "g string, o long, t string")
    out = B.group_batches(lines.where("o % 3 = 0").withColumn("s", F.lit(1)), "g", "o", "s", 2, 100)
    got = {r["batch"]: (r["before"], r["after"]) for r in B.batch_context(out, lines, "g", "o", "t").collect()}
    assert got == {0: ([], ["t4", "t5", "t6"]), 1: (["t3", "t4", "t5"], ["t10", "t11"]), 2: ([], ["t16", "t17", "t18"]), 3: (["t15", "t16", "t17"], ["t19"])}


def merged(a, b):
    out = dict(a)
    for k, v in b.items():
        out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def tree_of(rows):
    out = {}
    for path, value in sorted(rows):
        node = out
        for p in path[:-1]:
            node = node.setdefault(p, {})
        node[path[-1]] = json.loads(value)
    return out


def test_fold_against_plain_merging(spark):
    rng = random.Random(3)

    def tree(depth):
        return {rng.choice("abc"): rng.choice([1, "x", None, [1, {"k": 2}], {}]) if depth == 0 or rng.random() < 0.4 else tree(depth - 1) for _ in range(rng.randint(0, 3))}

    saved = {k: [tree(3) for _ in range(rng.randint(1, 8))] for k in range(60)}
    rows = [(k, i, json.dumps(t)) for k, ts in saved.items() for i, t in enumerate(ts)]
    got = {}
    for r in saves.folded(spark.createDataFrame(rows, "k int, i int, tree string").repartition(5), "k", "i", "tree").collect():
        got.setdefault(r["k"], []).append((tuple(r["path"]), r["value"]))
    for k, ts in saved.items():
        want = {}
        for t in ts:
            want = merged(want, t)
        assert tree_of(got.get(k, [])) == want, (k, ts)


def test_saved_games(spark):
    deep = cell = {}
    for _ in range(60):
        cell["d"] = {}
        cell = cell["d"]
    delta = [{"variables": {"player": {"money": 50, "hp": 10}}}, {"variables": {"player": {"money": 80}}}, {"variables": {"player": 3}}, {"title": "none"}]
    rows = [("two", {"index": 2, "delta": delta}), ("clamped", {"index": 99, "delta": delta}), ("low", {"index": 0, "delta": delta}), ("all", {"delta": delta[:2]}), ("history", {"index": 1, "history": delta}), ("late", {"index": 9, "history": delta[:3]}), ("deep", {"delta": [{"variables": deep}]}), ("none", {"index": 1}), ("empty", {"delta": []})]
    df = spark.createDataFrame([(k, json.dumps({"state": s})) for k, s in rows] + [("bad", "{"), ("null", None)], "save string, data string")
    got = {}
    for r in saves.save_variables(df).collect():
        got.setdefault(r["save"], {})[".".join(r["path"])] = r["value"]
    assert got.pop("deep") == {".".join(["d"] * 60): "{}"}
    assert got == {"two": {"player.money": "80", "player.hp": "10"}, "clamped": {"player": "3"}, "low": {"player.money": "50", "player.hp": "10"}, "all": {"player.money": "80", "player.hp": "10"}, "history": {"player.money": "50", "player.hp": "10"}, "late": {"player": "3"}}
