"""String literals of JavaScript with their places, the texts of a game's plugins, and literals laid in anew."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.write_back import Edits, _spliced
from lexloom.sources import game_json

#: Plugins of the engine itself; what literals of code begin with; literals that are values.
ENGINE_PLUGINS = ("rmmz_", "rpg_", "pixi", "lz-", "effekseer", "kry_")
CODE_BEGINS = (
    "var ", "const ", "let ", "function", "return ", "this.", "new ", "typeof", "instanceof", "delete ", "import ", "export ", "class ", "extends ", "if (", "else", "try ", "catch ", "throw ", "switch ",
    "case ", "while (", "for (", "do ", "break", "continue", "await ", "yield ", "=>", "http", "www.", "use strict",
)
VALUES = ("null", "true", "false", "undefined", "nan", "none", "none yet", "empty")
MARK = "#plugin:"
_LITERAL, _TRAILING = re.compile(game_json.JS_STRING.replace(r"\z", r"\Z")), re.compile(r",(\s*[\]}])")


def literal_spans(code: str) -> Iterator[tuple[str, str, int, int]]:
    """(raw, quote, start, end) of each string literal, quotes within the span; comments are left out."""
    for m in _LITERAL.finditer(code):
        if own := m.group(1):
            yield own[1:-1], own[0], m.start(1), m.end(1)


def quoted(text: str, quote: str) -> str:
    """text as a literal."""
    out = text.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n").replace(quote, "\\" + quote)
    return quote + out + quote


def change_plugin(body: bytes, edits: Edits) -> tuple[bytes, int]:
    """Literals of a plugin, all that are equal to an edit's original; for write_back.patched."""
    code = body.decode()
    wanted = {original: new for place, original, new in edits if MARK in place}
    places = [(raw, start, end, quoted(wanted[raw], quote)) for raw, quote, start, end in literal_spans(code) if raw in wanted]
    return _spliced(code, [p[1:] for p in places]).encode(), len({p[0] for p in places})


def js_value(code: str, start: int) -> tuple[int, int]:
    """The span of the list or object that begins at start, brackets within literals and comments left out."""
    depth, at = 0, start
    hidden = [(m.start(), m.end()) for m in _LITERAL.finditer(code, start)]
    for m in re.finditer(r"[\[\]{}]", code[start:]):
        place = start + m.start()
        while hidden and hidden[0][1] <= place:
            hidden.pop(0)
        if hidden and hidden[0][0] <= place:
            continue
        depth += 1 if m.group() in "[{" else -1
        at = place + 1
        if not depth:
            break
    return start, at


def with_dictionary(code: str, name: str, words: dict[str, str]) -> str:
    """code whose `name = {...}` holds words in place of what it held; code without one stays."""
    m = re.search(rf"\b{re.escape(name)}\s*=\s*(?=\{{)", code)
    if not m:
        return code
    start, end = js_value(code, m.end())
    return _spliced(code, [(start, end, json.dumps(words, ensure_ascii=False))])


def _listed(text: str | None) -> list[dict]:
    """The plugins of a list: JSON, or a script that holds one (commas may trail)."""
    begin, end = (text or "").find("["), (text or "").rfind("]")
    if begin < 0 or end < begin:
        return []
    try:
        found = json.loads(_TRAILING.sub(r"\1", text[begin : end + 1]))
    except ValueError:
        return []
    return [p for p in found if isinstance(p, dict)]


def enabled_plugins(lists: DataFrame, body: str = "body") -> DataFrame:
    """name, keys: plugins that are switched on and not the engine's own, and the names of their parameters."""
    schema = pa.schema([("name", pa.string()), ("keys", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(str(p.get("name") or ""), [str(k) for k in p["parameters"]] if isinstance(p.get("parameters"), dict) else []) for t in b.column(0).to_pylist() for p in _listed(t) if p.get("status")]
            rows = [(re.sub(r"(?i)\.js$", "", name), keys) for name, keys in rows if name and not name.startswith(ENGINE_PLUGINS)]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return lists.select(body).mapInArrow(run, "name string, keys array<string>")


def is_plugin_text(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    begins = F.lit(False)
    for word in CODE_BEGINS:
        begins = begins | F.lower(F.ltrim(raw)).startswith(word)
    return game_json.js_text(raw) & ~low.isin(*VALUES) & ~begins


def plugin_texts(files: DataFrame, plugins: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """file, json_path, context, original: literals that are text of the enabled plugins' files (`.../plugins/NAME.js`), numbered in order; the names of a plugin's parameters are keys, not text."""
    schema = pa.schema([("name", pa.string()), ("file", pa.string()), ("at", pa.int32()), ("original", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r["name"], r["file"], start, raw) for r in b.to_pylist() for raw, _, start, _ in literal_spans(r["body"] or "")]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    named = files.select(F.regexp_extract(file, r"(?:^|/)plugins/([^/]+)\.js$", 1).alias("name"), F.col(file).alias("file"), F.col(body).alias("body")).where("name <> ''")
    own = named.join(plugins.select("name").distinct(), "name", "left_semi").mapInArrow(run, "name string, file string, at int, original string")
    keys = plugins.select("name", F.explode("keys").alias("key")).distinct()
    text = own.where(is_plugin_text(F.col("original"))).withColumn("key", F.trim("original")).join(keys, ["name", "key"], "left_anti")
    # Numbered within a file: one file's literals.
    listed = text.groupBy("file", "name").agg(F.array_sort(F.collect_list(F.struct("at", "original"))).alias("found"))
    rows = listed.select("file", "name", F.posexplode("found").alias("n", "x"))
    return rows.select("file", F.concat(F.lit(MARK), "n").alias("json_path"), F.concat(F.lit("plugin "), "name").alias("context"), "x.original")
