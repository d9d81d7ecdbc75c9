"""The text operators: every registered query against its SQL, and small cases for what SQL can't express."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lexloom.functions import codes as C
from lexloom.functions import text as X
from lexloom.operators import entries as E
from lexloom.operators import game_state as G
from lexloom.operators import translate as T
from lexloom.plans import catalog, translation  # noqa: F401
from lexloom.sources import game_files, game_json, markup
from lexloom.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "pages", "benchmark", "part", "conversations", "events", "customer", "supplier", "nation", "lineitem", "orders"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
    assert got == sorted(map(repr, con.execute(f"SELECT {quoted} FROM ({catalog.ORACLES[name]})").fetchall()))


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_round_trip_of_codes(spark):
    assert all(r["same"] and r["valid"] for r in catalog.QUERIES["mask_roundtrip"](spark, SF).collect())
    got = one(spark, C.mask_codes(F.col("t")), t="\\C[8]Hi %1 <b>x</b>\\!")
    assert got["masked"] == "<x0/>Hi <x1/> <x2/>x<x3/><x4/>" and got["codes"] == ["\\C[8]", "%1", "<b>", "</b>", "\\!"]


@pytest.mark.parametrize("source, target, good", [("[a] x {b}", "y [a] {b}", True), ("[a] x {b}", "{b} [a]", False), ("[a]", "a", False), ("", "anything", True), ("[a][a]", "[a]", False)])
def test_variables_keep_their_order(spark, source, target, good):
    assert one(spark, X.variables_safe(F.col("s"), F.col("t")), s=source, t=target) is good


def test_fixers_and_guards(spark):
    assert one(spark, X.fix_escape(F.col("s"), F.col("t")), s="a", t="b\\\\c") == "b\\c"
    assert one(spark, X.fix_leading_case(F.col("s"), F.col("t")), s="vx", t="Vy") == "vy"
    assert one(spark, X.guard_tokens(F.col("s"), F.col("t")), s="<x0/>a", t="b <x0/>") == "b <x0/>"
    assert one(spark, X.guard_tokens(F.col("s"), F.col("t")), s="<x0/>a", t="b") == "<x0/>a"
    assert one(spark, X.guard_length(F.col("s"), F.col("t")), s="abc", t="x" * 25) == "abc"
    assert one(spark, X.suspicious(F.col("t"), "ru", F.lit(0.0)), t="word word word word") is True
    assert one(spark, X.suspicious(F.col("t"), "ru", F.lit(-2.0)), t="да да") is False and one(spark, X.suspicious(F.col("t"), "ru", F.lit(-2.0)), t="да да нет") is True and one(spark, X.suspicious(F.col("t"), "ru", F.lit(-2.0)), t="") is False
    assert one(spark, X.is_code_token(F.col("t")), t="img/pic.png") is True
    assert one(spark, X.resolve_source(F.col("t"), "ja", "en"), t="...") == "ja"


def test_greedy_batches(spark):
    got = spark.sql("SELECT array(700, 700, 200, 2000, 1, 1) AS a").select(E.greedy_batches(F.col("a")).alias("b")).first()["b"]
    assert got == [0, 0, 1, 2, 3, 3]


def test_scenarios(spark):
    body = "; note\n*label\nHello [name id=\"]\"] world[p]\n[iscript]\nvar a\n[endscript]\n   \n123\nBye"
    rows = markup.scenario_entries(spark.createDataFrame([("a.ks", body), ("b.ks", None)], "file string, body string")).orderBy("line", "seg").collect()
    assert [(r["line"], r["original"]) for r in rows] == [(3, "Hello"), (3, "world"), (9, "Bye")]


def test_game_databases(spark):
    files = spark.createDataFrame([("Actors.json", '[null,{"name":"Ann","note":""},{"name":" "},{"name":"Bo","note":"x"}]'), ("Bad.json", "{")], "file string, body string")
    got = {(r["json_path"], r["original"]) for r in game_json.record_fields(files, ["name", "note"]).collect()}
    assert got == {("[1].name", "Ann"), ("[3].name", "Bo"), ("[3].note", "x")}
    cmds = '[{"code":401,"indent":0,"parameters":["Hi"]},{"code":102,"indent":0,"parameters":[["Yes","No"],1]},{"code":402,"indent":0,"parameters":[0,"Yes"]},{"code":0,"indent":0,"parameters":[]}]'
    got = {(r["json_path"], r["original"]) for r in game_json.command_texts(spark.createDataFrame([("m", cmds)], "file string, body string"), "list").collect()}
    assert got == {("list[0].parameters[0]", "Hi"), ("list[1].parameters[0][0]", "Yes"), ("list[1].parameters[0][1]", "No"), ("list[2].parameters[1]", "Yes")}
    assert one(spark, game_json.path_keys(F.col("p")), p="events[3].pages[0].x") == ["events", "3", "pages", "0", "x"]


def test_tags_that_show_text(spark):
    body = "[link text=\"Go on\" target=*a]\n[button alt=\"text='no'\" text='Start']Hi[ruby text=\"kana\"]x[wait text=\"never\"][links text=\"nor\"]"
    rows = markup.scenario_entries(spark.createDataFrame([("a.ks", body)], "file string, body string")).orderBy("line", "seg").collect()
    assert [(r["line"], r["original"]) for r in rows] == [(1, "Go on"), (2, "Start"), (2, "Hi"), (2, "kana"), (2, "x")]


def test_typed_commands(spark):
    import json

    commands = [(101, ["face", 0, 0, 2, "Ann"]), (356, ["Say hello"]), (357, ["P", "c", "", {"msg": "Hey", "n": 3}]), (357, ["P", "c", "", ["one", 2]]), (657, ["msg = Hey", 4]), (355, ["a('Some text'); // 'not this'\nb(\"key\"); c(\"More \\'text\"); d('Last one')"]), (999, [1, {"deep": [["Two words", "key"]]}, "\u3042"]), (101, ["face", "Old style"])]
    body = json.dumps([{"code": c, "indent": 0, "parameters": p} for c, p in commands])
    got = {(r["json_path"], r["context"], r["original"]) for r in game_json.command_texts(spark.createDataFrame([("m", body), ("bad", "{")], "file string, body string")).collect()}
    want = {(0, "[4]", "speaker name", "Ann"), (1, "[0]", "plugin (MV)", "Say hello"), (2, "[3].msg", "plugin", "Hey"), (3, "[3][0]", "plugin", "one"), (4, "[0]", "plugin", "msg = Hey"), (5, "[0]#script:0", "script", "Some text"), (5, "[0]#script:1", "script", "Last one"), (6, "[1].deep[0][0]", "param 999", "Two words"), (7, "[1]", "param 101", "Old style")}
    assert got == {(f"[{i}].parameters{p}", c, t) for i, p, c, t in want} | {("[6].parameters[2]", "param 999", "\u3042")}


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, "f", "p", "c", 'a;"b"\nc', "t", "new"), (2, "f", "p", "c", "x", "y", "manual")]
    df = spark.createDataFrame(rows, "id long, file string, json_path string, context string, original string, translation string, status string")
    markup.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, markup.read_csv(spark, str(tmp_path / "out")).collect())) == rows


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "event_id", "value")
    events = events.union(spark.createDataFrame([(-1, "x", i, v) for i, v in enumerate((3.0, None, 3.0, 4.0))], events.schema))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.stream_changes(stream, ["user_id", "event_type"], ["event_id"], "value").writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    from lexloom.operators import snapshots as S

    want = S.changes(events, ["user_id", "event_type"], ["event_id"], "value").selectExpr("user_id", "event_type", "previous", "value AS current")
    assert sorted(map(tuple, spark.table("changes").collect())) == sorted(map(tuple, want.collect()))


def test_messages(spark):
    lines = spark.createDataFrame([('{"type":"vars","n":1}',), ('{"type":"state"}',), ("{bad",)], "value string")
    assert [r["n"] for r in live.messages(lines, "vars", "n int").collect()] == [1]


@pytest.mark.parametrize(
    "text, masked, codes",
    [
        ("テ\\V[1]と\\N[2]、\\C[3]赤 \\{大\\} 100\\%1", "テ<x0/>と<x1/>、<x2/>赤 <x3/>大<x4/> 100<x5/><x6/>", ["\\V[1]", "\\N[2]", "\\C[3]", "\\{", "\\}", "\\", "%1"]),
        ("Hello [name]! {w} [gold] a\\\\b", "Hello <x0/>! {w} <x1/> a<x2/>b", ["[name]", "[gold]", "\\\\"]),
        ("Misc [[Requires Restart]", "Misc <x0/>Requires Restart]", ["[["]),
        ("[Сохр %1] text in brackets", "[Сохр %1] text in brackets", []),
    ],
)
def test_masks(spark, text, masked, codes):
    m = C.mask_codes(F.col("t"))
    got = one(spark, m, t=text)
    assert (got["masked"], got["codes"]) == (masked, codes)
    assert one(spark, C.unmask_codes(m["masked"], m["codes"]), t=text) == text


def test_tokens_without_a_code_stay(spark):
    assert one(spark, C.unmask_codes(F.col("t"), F.array(F.lit("a"))), t="<x0/> <x3/> <x99999999999/>") == "a <x3/> <x99999999999/>"


def test_codes_at_the_edges(spark):
    edges = lambda t: tuple(one(spark, C.split_edges(F.col("t")), t=t))
    assert edges("\\V[1]привет\\c[8]") == (["\\V[1]"], "привет", ["\\c[8]"])
    assert edges("{i}[name] hi [Текст]") == (["{i}", "[name]"], " hi [Текст]", [])
    back = lambda t: one(spark, C.reattach(F.col("t"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit("C"), F.lit("D"))), t=t)
    assert [back(t) for t in ("x", "Ax", "ABxCD", "xD")] == ["ABxCD"] * 4
    only = lambda t: one(spark, C.is_code_only(C.mask_codes(F.col("t"))["masked"]), t=t)
    assert only("\\V[1] ...") and not only("text \\V[1]")


def test_fixers(spark):
    fixed = lambda f, s, t: one(spark, f(F.col("s"), F.col("t")), s=s, t=t)
    assert fixed(C.fix_codes, "hi [name]", "[name] yo [name] \\V[1]") == " yo [name] "
    assert fixed(C.fix_circled, "Собрано ① ②", "Собрано 1 2 [a1] 3") == "Собрано ① ② [a1] 3"
    assert fixed(C.fix_signs, "Visible Day: -1", "Видимый день: 1") == "Видимый день: -1"
    assert fixed(C.fix_signs, "-1 2", "1") == "1"
    mark = lambda t, to="ru": one(spark, C.fix_punctuation(F.col("t"), to), t=t)
    assert mark("Да。Нет、a！") == "Да. Нет, a!" and mark("Да.Нет") == "Да. Нет" and mark("。", "ja") == "。"
    assert one(spark, C.apply_fixers(F.col("s"), F.col("t"), "ru"), s="v[config.version]", t="V[config.version]") == "v[config.version]"


def test_glossary_segments_and_single_letters(spark):
    terms = F.array(*[F.struct(F.lit(a).alias("term"), F.lit(b).alias("tr")) for a, b in (("Aira", "1"), ("Memory Orb", "2"), ("Memory", "3"), ("(x)", "4"))])
    got = one(spark, C.glossary_segments(F.col("t"), terms), t="Aira used the Memory Orb (x)!")
    assert [tuple(r) for r in got] == [("Aira", "1"), (" used the ", None), ("Memory Orb", "2"), (" ", None), ("(x)", "4"), ("!", None)]
    assert [one(spark, X.is_single_letter(F.col("t")), t=t) for t in ("ホ", " ホ ", "Я", "c", "私", "ab", "")] == [True] * 4 + [False] * 3


def test_translating_entries(spark):
    rows = [(1, "こんにちは", "new"), (2, "Hello there", "new"), (3, "Уже русский", "new"), (4, "こんにちは", "new"), (5, "img/a.png", "new"), (6, "A", "new"), (7, "\\V[1]", "new"), (8, "skipped", "skip"), (9, "Hi Bob!", "new"), (10, "12", "new"), (11, "known", "new")]
    entries = spark.createDataFrame([(i, "f", "p", "c", t, "", s) for i, t, s in rows], "id long, file string, json_path string, context string, original string, translation string, status string")
    memory = spark.createDataFrame([("known", "en", "ru", "remembered")], "source string, src_lang string, tgt_lang string, target string")
    glossary = spark.createDataFrame([("en", "ru", "Bob", "Боб"), ("en", "de", "Hi", "no")], "src string, tgt string, term string, tr string")
    out = T.translate_entries(entries, "ru", lambda t: F.concat(F.lit("~"), t), memory=memory, glossary=glossary)
    got = {r["id"]: (r["translation"], r["status"]) for r in out.collect()}
    done = lambda t: (t, "translated")
    assert got == {1: done("~こんにちは"), 2: done("~Hello there"), 3: ("", "skip"), 4: done("~こんにちは"), 5: done("img/a.png"), 6: done("A"), 7: ("", "skip"), 8: ("", "skip"), 9: done("~Hi Боб!"), 10: ("", "skip"), 11: done("remembered")}
    learned = {(r["source"], r["src_lang"], r["target"]) for r in T.learned_pairs(entries, out, "ru").collect()}
    assert ("Hello there", "en", "~Hello there") in learned and all(s != "A" for s, _, _ in learned)
    # An engine that loses tokens gets the whole text; one that answers nothing leaves the original.
    lost = T.translate_entries(entries.withColumn("original", F.lit("a [x.y] b")), "ru", lambda t: F.regexp_replace(t, "<x0/>", "")).first()
    assert lost["translation"] == "a [x.y] b"
    empty = T.translate_entries(entries, "ru", lambda t: F.lit(" ")).where("id = 2").first()
    assert empty["translation"] == "Hello there"


def test_layers_tiles_and_coercion(spark):
    layers = lambda n: [list(x) for x in one(spark, G.map_layers(F.expr(f"CASE WHEN {n} = 0 THEN array() ELSE sequence(0, {n} - 1) END").cast("array<int>"), F.lit(4)), t="")]
    assert layers(24) == [list(range(8)), list(range(8, 16)), [16, 17, 18, 19], [20, 21, 22, 23]]
    assert layers(20)[2:] == [[16, 17, 18, 19], []] and layers(16)[1:] == [[8, 9, 10, 11], [12, 13, 14, 15], []] and layers(0) == [[], [], [], []]
    tile = lambda n: one(spark, G.tile_class(F.lit(n)), t="")
    assert tile(0) is None and tile(99999) is None
    assert [tuple(tile(n))[1:4] for n in (1, 16, 128, 1536)] == [(5, 48, 0), (5, 0, 96), (5, 384, 0), (4, 0, 0)]
    assert tuple(tile(2048 + 49))[4:] == (1, 1)
    assert tuple(one(spark, G.coerced(F.lit("int"), F.col("t")), t=" 5 ")) == (True, "5") and not one(spark, G.coerced(F.lit("float"), F.col("t")), t="x")["ok"]


def test_game_files(spark):
    say = lambda t: {"code": 401, "indent": 0, "parameters": [t]}
    files = {
        "data/Actors.json": [None, {"name": "Ann", "nickname": "", "note": "keep out of here", "extra": {"deep": ["some words here", "key"]}}],
        "data/Map001.json": {"displayName": "Town", "events": [None, {"name": "Door", "pages": [{"list": [say("Hi"), {"code": 0, "parameters": []}]}]}]},
        "data/CommonEvents.json": [None, {"name": "Rain", "list": [say("Drip")]}],
        "data/Troops.json": [None, {"name": "Bats", "pages": [{"list": [say("Squeak")]}]}],
        "data/System.json": {"gameTitle": "Quest", "elements": ["", "Fire"], "switches": ["", "Open"], "terms": {"basic": ["Level"], "commands": [None, "Fight"], "messages": {"levelUp": "Up!"}}},
        "data/MapInfos.json": [None, {"name": "Town list"}],
        "data/Own.json": {"title": "two words", "a": {"note": "not this one", "c": "deep text here"}, "l": [{"note": "but this one"}], "path": "img/x y.png"},
        "data/List.json": [{"t": "in a list"}, "日本", "key", ["not looked at"]],
    }
    rows = [(k, json.dumps(v)) for k, v in files.items()] + [("data/Bad.json", "{"), ("data/Empty.json", None), ("js/x.js", "a b")]
    df = spark.createDataFrame(rows, "file string, body string")
    got = {(r["file"][5:-5], r["json_path"], r["context"], r["original"]) for r in game_files.game_texts(df).collect()}
    page = "pages[0].list[0].parameters[0]"
    assert got == {
        ("Actors", "[1].name", "Actors 'Ann'", "Ann"),
        ("Actors", "[1].extra.deep[0]", "Actors 'Ann' / extra", "some words here"),
        ("Map001", "displayName", "map name", "Town"),
        ("Map001", "events[1].name", "Map001 event name", "Door"),
        ("Map001", f"events[1].{page}", "Map001 event 'Door' p.1 / dialog", "Hi"),
        ("CommonEvents", "[1].name", "common event #1", "Rain"),
        ("CommonEvents", "[1].list[0].parameters[0]", "common event 'Rain' / dialog", "Drip"),
        ("Troops", "[1].name", "enemy group #1", "Bats"),
        ("Troops", f"[1].{page}", "battle 'Bats' p.1 / dialog", "Squeak"),
        ("System", "gameTitle", "game title", "Quest"),
        ("System", "elements[1]", "term elements", "Fire"),
        ("System", "switches[1]", "switch #1", "Open"),
        ("System", "terms.basic[0]", "term basic", "Level"),
        ("System", "terms.commands[1]", "term commands", "Fight"),
        ("System", "terms.messages.levelUp", "system message", "Up!"),
        ("MapInfos", "[1].name", "map name (list)", "Town list"),
        ("Own", "title", "file Own.json", "two words"),
        ("Own", "a.c", "file Own.json", "deep text here"),
        ("Own", "l[0].note", "file Own.json", "but this one"),
        ("List", "[0].t", "file List.json #0", "in a list"),
        ("List", "[1]", "file List.json #1", "日本"),
    }
    assert {r["file"] for r in game_files.rejected_files(df).collect()} == {"data/Bad.json", "data/Empty.json"}


def test_flat_paths(spark):
    body = json.dumps({"a": {"b": [1, {"x": None}], "e": {}}, "f": [], "g": True})
    df = spark.createDataFrame([("k", body), ("bad", "{"), ("flat", "3"), ("none", None)], "k string, body string")
    got = {(r["k"], r["path"], r["value"]) for r in game_json.flat_paths(df, "k", "body").collect()}
    assert got == {("k", "a.b[0]", "1"), ("k", "a.b[1].x", None), ("k", "a.e", "{}"), ("k", "f", "[]"), ("k", "g", "true")}


@pytest.mark.parametrize("text, escaped", [('a"b', 'a\\"b'), ("a\nb\tc", "a\\nb\\tc"), ("\\n", "\\\\n"), ("\\", "\\\\"), ("", "")])
def test_literals(spark, text, escaped):
    assert one(spark, X.escape_literal(F.col("t")), t=text) == escaped
    assert one(spark, X.unescape_literal(F.col("t")), t=escaped) == text


def test_unknown_escapes(spark):
    assert one(spark, X.unescape_literal(F.col("t")), t="\\x\\\\\\n\\") == "x\\\n\\"
