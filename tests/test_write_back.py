"""Extract, apply, extract again; what shifted stays; bytes outside of the edits stay; published files are whole and single."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexloom.operators import entries as E
from lexloom.operators import write_back as W
from lexloom.sources import game_json
from lexloom.sources import markup as M
from lexloom.sources import stories as S


def test_places_of_json_strings():
    text = '{"a": [1, "x", {"b\\"c": "y"}], "d": {"e": [[], ["z", "q\\n"]]}, "f": "", "g": null}'
    assert [(p, json.loads(text[s:e])) for p, s, e in W.string_places(text)] == [("a[1]", "x"), ('a[2].b"c', "y"), ("d.e[1][0]", "z"), ("d.e[1][1]", "q\n"), ("f", "")]
    assert [p for p, _, _ in W.string_places('[null, {"name": "n"}, "t"]')] == ["[1].name", "[2]"]


def test_json_round_trip(spark):
    body = '[\r\n\tnull,\r\n  {"id":1, "name":"Potion",   "note":"Heals \\"well\\""},\n{"id":2,"name":"Elixir","note":""}]\n'
    files = spark.createDataFrame([("Items.json", body), ("Bad.json", "[1")], "file string, body string")
    found = game_json.record_fields(files, ["name", "note"])
    edits = found.withColumn("translation", F.concat(F.lit('~"'), "original")).unionByName(spark.createDataFrame([("Items.json", "[9].name", "a", "b"), ("Bad.json", "[0]", "a", "b")], "file string, json_path string, original string, translation string"))
    edits = edits.withColumn("original", F.when(F.col("original") == "Elixir", "Shifted").otherwise(F.col("original")))
    out = W.patched(files, edits, W.change_json).collect()
    got = {r["file"]: (r["body"].decode(), r["edits"], r["applied"]) for r in out}
    assert got["Items.json"] == (body.replace('"Potion"', '"~\\"Potion"').replace('"Heals \\"well\\""', '"~\\"Heals \\"well\\""'), 4, 2)
    assert got["Bad.json"] == ("[1", 1, 0)
    again = game_json.record_fields(spark.createDataFrame([("Items.json", got["Items.json"][0])], "file string, body string"), ["name", "note"])
    assert {r["original"] for r in again.collect()} == {'~"Potion', '~"Heals "well"', "Elixir"}


@pytest.mark.parametrize("encoding, end", [("utf-8", "\n"), ("cp932", "\r\n"), ("utf-8-sig", "\r\n")])
def test_scenario_round_trip(spark, encoding, end):
    lines = ["*start", "; comment", "  こんにちは、%name さん  [l][r]", '[link target="*a" text="選択肢[1]"]', "[ruby text='あ']次[endlink]", "", "最後"]
    body = end.join(lines).encode(encoding)
    text = body.decode(encoding)
    found = M.scenario_entries(spark.createDataFrame([("a.ks", text)], "file string, body string"))
    edits = found.select("file", F.format_string("line[%d].seg[%d]", "line", "seg").alias("json_path"), "original", F.concat(F.lit("訳"), "original").alias("translation"))
    edits = edits.withColumn("translation", F.when(F.col("original") == "最後", 'x"y').otherwise(F.col("translation")))
    files = spark.createDataFrame([("a.ks", bytearray(body))], "file string, body binary")
    [r] = W.patched(files, edits, W.change_scenario).collect()
    want = end.join(["*start", "; comment", "  訳こんにちは、%name さん  [l][r]", '[link target="*a" text="訳選択肢[1]"]', "[ruby text='訳あ']訳次[endlink]", "", 'x"y']).encode(encoding)
    assert bytes(r["body"]) == want and r["applied"] == r["edits"] == 5
    again = M.scenario_entries(spark.createDataFrame([("a.ks", want.decode(encoding))], "file string, body string"))
    assert sorted(x["original"] for x in again.collect()) == sorted(x["translation"] for x in edits.collect())
    bad = spark.createDataFrame([("a.ks", "line[3].seg[0]", "こんにちは、%name さん", "без имени"), ("a.ks", "line[4].seg[0]", "選択肢[1]", 'a"b'), ("a.ks", "line[99].seg[0]", "a", "b"), ("a.ks", "line[1].seg[0]", "other", "b")], "file string, json_path string, original string, translation string")
    [r] = W.patched(files, bad, W.change_scenario).collect()
    assert bytes(r["body"]) == body and r["applied"] == 0


STORY = """<tw-storydata name="B" format="{0}"><tw-passagedata pid="1" name="Begin" tags="">Shop &amp; more:
<<link "Open door" "DoorPassage">> <<goto "Begin">>
&lt;&lt;= either('one day', "two days")&gt;&gt; you have $gold.b left
[[Enter the cave|cave2]] [[Home<-Go home]]
(if: $x &gt; 3)[Too many.]
<script>
not text
</script>
</tw-passagedata><tw-passagedata pid="2" name="StoryInit" tags="">hidden</tw-passagedata></tw-storydata>"""


@pytest.mark.parametrize("kind", ["SugarCube", "Harlowe"])
def test_story_round_trip(spark, kind):
    body = STORY.format(kind)
    files = spark.createDataFrame([("s.html", body)], "file string, body string")
    found = S.story_entries(files.withColumnRenamed("body", "html"))
    edits = found.select("file", "json_path", "original", F.concat(F.lit("RU:"), "original").alias("translation"))
    more = [("s.html", "passage[1].line[1].seg[2].arg[0]", "Begin", "Старт"), ("s.html", "passage[1].line[3].seg[0]", "Enter the cave", "a|b"), ("s.html", "passage[2].line[0].seg[0]", "hidden", "shown"), ("s.html", "passage[1].line[1].seg[0].arg[0]", "Open door", 'a"b')]
    crafted = spark.createDataFrame(more, "file string, json_path string, original string, translation string")
    [r] = W.patched(files, edits, W.change_story).collect()
    text = bytes(r["body"]).decode()
    assert r["applied"] == r["edits"] == found.count()
    again = S.story_entries(spark.createDataFrame([("s.html", text)], "file string, html string"))
    # A hook's bracket begins a segment of its own.
    want = [t for x in found.collect() for t in (["RU:", x["original"]] if x["original"].startswith("[") and kind == "Harlowe" else ["RU:" + x["original"]])]
    assert sorted(x["original"] for x in again.collect()) == sorted(want)
    assert '&lt;&lt;link "RU:Open door" "DoorPassage"&gt;&gt;' in text and '&lt;&lt;goto "Begin"&gt;&gt;' in text
    assert "[[RU:Enter the cave|cave2]] [[Home&lt;-RU:Go home]]" in text and "RU:Shop &amp; more:" in text and "not text" in text
    assert ("(if: $x &gt; 3)RU:[Too many.]" if kind == "Harlowe" else "&gt; 3)[Too many.]") in text
    [r] = W.patched(files, crafted, W.change_story).collect()
    assert bytes(r["body"]).decode() == body and r["applied"] == 0


def test_string_files(spark):
    rows = [(1, "game/a.rpy", "p", "", 'Say "hi"', "Скажи", "translated"), (2, "game/a.rpy", "p", "", "Two\nlines", "Две", "manual"), (3, "b.rpy", "p", "", 'Say "hi"', "Other", "translated"), (4, "b.rpy", "p", "", "Skip", "x", "skip")]
    entries = spark.createDataFrame(rows, "id long, file string, json_path string, context string, original string, translation string, status string")
    got = {r["file"]: bytes(r["body"]).decode() for r in W.string_files(E.string_pairs(entries), "russian").collect()}
    assert list(got) == ["game/tl/russian/own_game__a.rpy"]
    [body] = got.values()
    assert body.startswith("translate russian strings:\n\n    # ") and '    old "Say \\"hi\\""\n    new "Скажи"\n' in body and 'old "Two\\nlines"' in body


def test_published_files_are_whole_and_single(spark, tmp_path):
    top, backup = str(tmp_path / "game"), str(tmp_path / "backup")
    files = lambda *rows: spark.createDataFrame([(f, bytearray(b)) for f, b in rows], "file string, body binary").repartition(3)
    out = W.publish(files(("a.json", b"one"), ("d/b.json", b"\xff\x00"), ("d/e/c", b"")), top)
    assert sorted(map(tuple, out.collect())) == [("a.json", 3), ("d/b.json", 2), ("d/e/c", 0)]
    W.publish(files(("a.json", b"two")), top, backup)
    W.publish(files(("a.json", b"three")), top, backup)
    found = {os.path.relpath(f"{d}/{f}", tmp_path): open(f"{d}/{f}", "rb").read() for d, _, names in os.walk(tmp_path) for f in names if not f.endswith(".crc")}
    assert found == {"game/a.json": b"three", "game/d/b.json": b"\xff\x00", "game/d/e/c": b"", "backup/a.json": b"one"}
    assert not [d for d in os.listdir(top) if d.startswith("_attempt")]
    for bad in ("../x", "/x", ""):
        with pytest.raises(ValueError, match="paths"):
            W.publish(files((bad, b"")), top)
    with pytest.raises(ValueError, match="same path"):
        W.publish(files(("x", b"1"), ("x", b"2")), top)
    assert not os.path.exists(f"{top}/x")
