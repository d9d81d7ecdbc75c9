"""Streams give what the batch form gives, also when they stop and start again from their checkpoint."""

import json
import os

from lexloom.operators import snapshots as S
from lexloom.streaming import live


def parts(folder, batches):
    os.makedirs(folder, exist_ok=True)
    for k, rows in enumerate(batches):
        yield k, lambda k=k, rows=rows: open(f"{folder}/{k:03d}.json", "w").write("\n".join(map(json.dumps, rows)))


def run_in_steps(spark, tmp_path, name, batches, schema, make):
    """What a stream puts out over files that come one by one, stopped after each."""
    source, checkpoint, out = (str(tmp_path / f"{name}-{x}") for x in ("in", "check", "out"))
    for _, write in parts(source, batches):
        write()
        rows = spark.readStream.schema(schema).json(source)
        make(rows).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


SCHEMA = "k string, t long, v long"
BATCHES = [[{"k": "a", "t": 1, "v": 5}, {"k": "b", "t": 1, "v": 1}], [{"k": "a", "t": 3, "v": 9}, {"k": "a", "t": 2, "v": 5}], [{"k": "a", "t": 4, "v": None}, {"k": "b", "t": 2, "v": 1}], [{"k": "a", "t": 5, "v": 9}, {"k": "a", "t": 6, "v": 2}]]


def test_scans_equal_the_batch_form_after_restarts(spark, tmp_path):
    rows = spark.createDataFrame([tuple(r.values()) for b in BATCHES for r in b], SCHEMA)
    previous = S.with_previous(rows, ["k"], ["t"], "v").withColumnRenamed("previous", "was")
    rules = {"changed": "was <> v", "unchanged": "was = v", "increased": "v > was", "decreased": "v < was", "equal": "v = 9"}
    for mode, rule in rules.items():
        got = run_in_steps(spark, tmp_path, mode, BATCHES, SCHEMA, lambda s, m=mode: live.stream_scan(s, ["k"], ["t"], "v", m, 9))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, previous.where(rule).select("k", "was", "v").collect()), key=repr)


def test_only_new_values_are_passed_on(spark, tmp_path):
    got = run_in_steps(spark, tmp_path, "new", BATCHES, SCHEMA, lambda s: live.until_changed(s, ["k"], ["t"], "v"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2), ("a", 5), ("a", 9), ("b", 1)]


def test_once_for_each_attachment(spark, tmp_path):
    got = run_in_steps(spark, tmp_path, "once", BATCHES, SCHEMA, lambda s: live.once_for_each(s, ["k"], ["t"]))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 5), ("b", 1, 1)]


def test_a_value_that_is_looked_for(spark):
    now, before = (spark.createDataFrame([("a", v), ("b", 2)], "k string, v long") for v in (9, 1))
    assert [tuple(r) for r in S.value_scan(before, now, ["k"], "v", "equal", 9).collect()] == [("a", 9, 1)]


def test_slots_of_a_stream_are_single_files(spark, tmp_path):
    batches = [[{"id": 1, "date": 1_700_000_000_000, "data": "one", "ord": 1}], [{"id": 1, "date": 1_700_000_000_000, "data": "two", "ord": 2}, {"id": 2, "date": None, "data": "x", "ord": 3}]]
    source, top = str(tmp_path / "in"), str(tmp_path / "saves")
    for _, write in parts(source, batches):
        write()
        # A checkpoint lost: everything runs again and writes the same files.
        for check in ("kept", "lost"):
            rows = spark.readStream.schema("id long, date long, data string, ord long").json(source)
            live.write_slots(rows, "G", "20240101-000000", top, str(tmp_path / check)).trigger(availableNow=True).start().awaitTermination()
    assert {f: open(f"{top}/{f}").read() for f in os.listdir(top) if f.endswith(".save")} == {"G-20231114-221320-slot1.save": "two", "G-20240101-000000-slot2.save": "x"}
