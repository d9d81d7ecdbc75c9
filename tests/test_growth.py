"""What keeps work in step with the input: nothing is worked out twice, and rows of a small file go to many tasks."""

import random
import tracemalloc

from pyspark.sql import functions as F

from lexloom.functions import codes as C
from lexloom.functions import text as X
from lexloom.operators import offline as O
from lexloom.operators import translate as T
from lexloom.sources import game_files, game_json
from lexloom.sources import save_files as L
from lexloom.sources import stories as S


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_surplus_codes_that_end_a_quotation(spark):
    rows = spark.createDataFrame([(r"a \E[1]", r"\E[1] b \E[1]"), (r"a \E[1]", "\\E[1] b\x01 \\E[1]")], "s string, t string")
    assert [r[0] for r in rows.select(C.fix_codes(F.col("s"), F.col("t"))).collect()] == [r" b \E[1]", " b\x01 \\E[1]"]


def test_texts_are_set_apart_once(spark):
    texts = spark.createDataFrame([("en", r"\C[8]Go [name] on"), ("en", "img/a.png")], "lang string, original string")
    split = T._set_apart(texts)
    assert "regexp" not in plan(split.where("as_is")) and {r["as_is"]: r["m"]["masked"] for r in split.collect()} == {False: "Go <x0/> on", True: "img/a.png"}


def test_sentences_are_cut_once(spark, monkeypatch):
    names, keep = [], O.stored
    monkeypatch.setattr(O, "stored", lambda df, name: names.append(name) or keep(df, name))
    rows = spark.createDataFrame([(1, "One is here. Two\x01 is there.")], "id long, original string")
    out = O.offline_translations(rows, lambda c: F.concat(F.lit("~"), c), "en", "xx").collect()
    assert names == ["sentences", "pieces"] and out[0]["text"] == "~One is here.~ Two is there."


def test_a_long_save_is_packed_in_little_memory():
    text = "".join(random.Random(3).choices("abcdefgh ", k=200_000))
    tracemalloc.start()
    out = L.packed(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert L.unpacked(out) == text and peak < 8 << 20


def test_a_story_is_read_once(spark):
    files = spark.createDataFrame([("a", '<tw-storydata format="x"><tw-passagedata pid="1" name="N" tags="">Hello you</tw-passagedata>')], "file string, html string")
    out = S.story_entries(files)
    assert "Join" not in plan(out) and [(r["original"], r["context"]) for r in out.collect()] == [("Hello you", "N (pid 1)")]


def test_rows_of_a_small_file_go_to_many_tasks(spark):
    rows = spark.createDataFrame([(k, '{"a":[1,{"b":[]}]}') for k in range(50)], "k long, body string").coalesce(1)
    flat = game_json.flat_paths(rows, "k", "body")
    assert flat.rdd.getNumPartitions() > 1 and {(r["path"], r["value"]) for r in flat.collect()} == {("a[0]", "1"), ("a[1].b", "[]")}
    files = rows.select(F.concat(F.lit("d/"), "k", F.lit("/Own.json")).alias("file"), "body")
    assert game_files.named_files(files).rdd.getNumPartitions() > 1


def test_repeated_stems_of_any_letters(spark):
    texts = ["one two three four", "walking walkie fast slow", "İstanbul istanbu a b", "аб АБ в г", "a a"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.repeated_stems(F.col("t"))).collect()]
    assert got == [0.0, 0.5, 0.0, 0.5, 0.0]
