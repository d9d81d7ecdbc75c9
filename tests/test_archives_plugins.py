"""Archives of all versions by range, hostile indexes refused; plugins' literals with places, keys left out, texts laid in."""

import json
import os
import pickle
import struct
import zlib

from lexloom.operators import write_back as W
from lexloom.sources import archives as A
from lexloom.sources import plugins as J


def rpa(path, files, version, head=b""):
    key = 0xDEADBEEF if version == 3 else 0
    data, index = b"x" * 64, {}
    for name, body in files.items():
        index[name] = [((len(data)) ^ key, (len(body) - len(head)) ^ key, *([head] if head else []))]
        data += body[len(head) :]
    packed = zlib.compress(pickle.dumps(index, 2))
    first = f"RPA-{version}.0 {len(data):016x}".encode() + (f" {key:08x}".encode() if version == 3 else b"") + b"\n"
    path.write_bytes(first + data[len(first) :] + packed)


def asar(path, tree, data):
    blob = json.dumps({"files": tree}).encode()
    pad = b"\0" * (-len(blob) % 4)
    path.write_bytes(struct.pack("<4I", 4, 8 + len(blob) + len(pad), 4 + len(blob) + len(pad), len(blob)) + blob + pad + data)


class Evil:
    def __reduce__(self):
        return os.system, ("touch /tmp/never-there",)


def test_archives(spark, tmp_path):
    files = {"a.rpy": b'e "Hi"', "d/\u0444.bin": bytes(range(200)), "empty": b""}
    rpa(tmp_path / "two.rpa", files, 2)
    rpa(tmp_path / "three.rpa", files, 3)
    rpa(tmp_path / "head.rpa", {"a.rpy": b"HEADrest"}, 3, b"HEAD")
    (tmp_path / "one.rpa").write_bytes(zlib.compress(pickle.dumps({"x": [(0, 2)]}, 2)))
    (tmp_path / "evil.rpa").write_bytes(b"RPA-2.0 %016x\n" % 40 + b" " * 15 + zlib.compress(pickle.dumps({"x": [(Evil(), 1)]})))
    (tmp_path / "cut.rpa").write_bytes((tmp_path / "two.rpa").read_bytes()[:-5])
    (tmp_path / "text.rpa").write_bytes(b"not an archive at all")
    tree = {"dir": {"files": {"f.txt": {"size": 3, "offset": "0"}, "sub": {"files": {"b.bin": {"size": 2, "offset": "3"}}}, "l": {"link": "dir/f.txt"}, "loop": {"link": "dir/loop"}}}, "out.txt": {"size": 4, "unpacked": True}, "gone.txt": {"size": 4, "unpacked": True}, "root": {"size": 9, "offset": "5"}}
    asar(tmp_path / "app.asar", tree, b"abcXY123456789")
    os.makedirs(tmp_path / "app.asar.unpacked")
    (tmp_path / "app.asar.unpacked" / "out.txt").write_bytes(b"four")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in sorted(os.listdir(tmp_path)) if "unpacked" not in n] + [(str(tmp_path / "missing.rpa"),), (None,)], "archive string")
    index = A.archive_index(paths)
    got = {(os.path.basename(r["archive"]), r["file"]): r["body"] and bytes(r["body"]) for r in A.archive_files(index).collect()}
    for n in ("two.rpa", "three.rpa"):
        assert {f: got.pop((n, f)) or b"" for f in files} == files
    assert got.pop(("head.rpa", "a.rpy")) == b"HEADrest" and got.pop(("one.rpa", "x")) == b"\x78\x9c"
    assert got == {("app.asar", "dir/f.txt"): b"abc", ("app.asar", "dir/sub/b.bin"): b"XY", ("app.asar", "dir/l"): b"abc", ("app.asar", "out.txt"): b"four", ("app.asar", "gone.txt"): None, ("app.asar", "root"): b"123456789"}
    bad = {os.path.basename(r["archive"]): r["error"] for r in A.rejected_archives(paths).collect()}
    assert set(bad) == {"evil.rpa", "cut.rpa", "text.rpa", "missing.rpa"} and "doesn't hold" in bad["evil.rpa"]
    assert not os.path.exists("/tmp/never-there")
    wanted = spark.createDataFrame([(str(tmp_path / "two.rpa"), "a.rpy"), (str(tmp_path / "two.rpa"), "nowhere")], "archive string, file string")
    assert {r["file"]: r["body"] and bytes(r["body"]) for r in A.wanted_files(paths, wanted).collect()} == {"a.rpy": files["a.rpy"], "nowhere": None}


def test_what_a_game_sees(spark):
    disk = spark.createDataFrame([("www/data/a.json", bytearray(b"disk"))], "file string, body binary")
    packed = spark.createDataFrame([("z", "project/data/a.json", bytearray(b"z")), ("b", "data/b.json", bytearray(b"b")), ("c", "www/data/b.json", bytearray(b"c"))], "archive string, file string, body binary")
    assert {r["file"]: bytes(r["body"]) for r in A.overlaid(disk, packed).collect()} == {"data/a.json": b"disk", "data/b.json": b"b"}


CODE = """// 'not this' "nor this"
/* 'nor "this' */ var a = 'Default Rows', b = "Строка сообщения";
Parameters['---General---'] = "It's \\"quoted\\" text"; if (x) y('img/a b.png', 'key', "return of it", 'None yet', "Hello big world", "Hello big world");
var open = "not closed
"""


def test_literals_have_places():
    found = list(J.literal_spans(CODE))
    assert all(CODE[start:end] == quote + raw + quote for raw, quote, start, end in found)
    assert [f[0] for f in found][:4] == ["Default Rows", "Строка сообщения", "---General---", 'It\\\'s'.replace("\\'", "'") + ' \\"quoted\\" text']


def test_plugins(spark):
    listed = 'var $plugins = [\n{"name":"Msg.js","status":true,"parameters":{"Default Rows":"4"}},\n{"name":"Off","status":false,"parameters":{}},\n{"name":"rmmz_core","status":true},{"name":"Gone","status":true},\n];'
    lists = spark.createDataFrame([(listed,), ("no list",), (None,), ('[{"name":"Two","status":1}]',)], "body string")
    plugins = J.enabled_plugins(lists)
    assert {r["name"]: r["keys"] for r in plugins.collect()} == {"Msg": ["Default Rows"], "Gone": [], "Two": []}
    files = spark.createDataFrame([("js/plugins/Msg.js", CODE), ("js/plugins/Off.js", CODE), ("js/other/Two.js", CODE), ("js/plugins/Two.js", 'a("Default Rows")')], "file string, body string")
    rows = J.plugin_texts(files, plugins).orderBy("file", "json_path").collect()
    assert [(r["file"], r["json_path"], r["original"]) for r in rows] == [("js/plugins/Msg.js", "#plugin:0", "Строка сообщения"), ("js/plugins/Msg.js", "#plugin:1", "Hello big world"), ("js/plugins/Msg.js", "#plugin:2", "Hello big world"), ("js/plugins/Two.js", "#plugin:0", "Default Rows")]
    edits = spark.createDataFrame([(r["file"], r["json_path"], r["original"], f'"{r["original"]}"\n') for r in rows] + [("js/plugins/Msg.js", "#plugin:9", "absent", "x")], "file string, json_path string, original string, translation string")
    got = {r["file"]: (bytes(r["body"]).decode(), r["applied"]) for r in W.patched(files, edits, J.change_plugin).collect()}
    want = CODE.replace('"Строка сообщения"', '"\\"Строка сообщения\\"\\n"').replace('"Hello big world"', '"\\"Hello big world\\"\\n"')
    assert got == {"js/plugins/Msg.js": (want, 2), "js/plugins/Two.js": ('a("\\"Default Rows\\"\\n")', 1)}


def test_a_dictionary_within_code():
    code = "var x = 1; var TR = {\"a\": \"}\", 'b': {c: [1]} /* } */}; var y = {};"
    assert J.with_dictionary(code, "TR", {"k": "\u0444"}) == 'var x = 1; var TR = {"k": "\u0444"}; var y = {};'
    assert J.with_dictionary(code, "ZZ", {}) == code
