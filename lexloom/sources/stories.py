"""Scan of hypertext stories (HTML with tw-passagedata): passages as rows, their texts by line and segment, and the nested model of a story.

Passages are found by splitting, so a story of any size is cut in one pass. What is said of a line hangs on the lines before it (an
open script, macro or link), so a passage is read in order by one small scanner; passages are independent of each other and
are spread over the tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Passages and tags that hold code, and the macros whose quoted arguments are shown, by place.
SERVICE_NAMES = ("StoryInit", "StoryMenu", "StoryShare", "StoryInterface", "StoryStylesheet", "StoryJavaScript", "StoryCaption", "StoryDisplayTitle", "StorySettings", "PassageReady", "PassageDone")
SERVICE_TAGS = ("widget", "init", "script", "stylesheet")
FIRST_ARGUMENT = ("button", "link", "label", "click", "hover", "linkappend", "linkprepend", "linkreplace", "menu", "option", "radio", "checkbox", "select", "textbox", "textarea", "input", "prompt")
ALL_ARGUMENTS = ("print", "dialog")
#: A variable with members and indices; the code within a text; a link; what makes a label code.
VARIABLE = r"\$[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*|\[[^\]\n]{0,120}\]){0,4}"
CODE = re.compile(r"<<[^>]{1,2000}>>|" + VARIABLE + r"|</?[A-Za-z][^>]{0,2000}>")
LINK, SETTER_LINK = re.compile(r"\[\[([^\]\n]{1,1000})\]\]"), re.compile(r"\[\[[^\]\n]{0,1000}\]\[[^\]\n]{0,1000}\]\]")
LABEL_CODE, ARROWS = re.compile(r"[<>$\[\]]"), ("->", "<-", "|")
HARLOWE_LINK = re.compile(r"\[([^\[\]\n]{1,1000}?(?:->|<-)[^\[\]\n]{1,1000})\]")
TOKEN = re.compile(r"</?x\d+\s*/?>")

_QUOTED = r"""(?:"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+')"""
_MACRO = re.compile(rf"""<<(?:[^"'>]++|>(?!>)|{_QUOTED})*+>>""", re.S)
_LITERAL = re.compile(r"""(["'])((?:\\.|(?!\1).)*+)\1""", re.S)
_NESTING = re.compile(rf"""[()]|{_QUOTED}|["']""", re.S)
_CALL = r"\([A-Za-z][A-Za-z0-9-]*:"
#: Where code may begin, in the plain form and in the one whose macros are calls in brackets.
_BEGINS = {False: re.compile(rf"<<|\[img\[|\[\[|{VARIABLE}|<(?=[A-Za-z!/])"), True: re.compile(rf"<<|{_CALL}|\[img\[|\[\[|\[|{VARIABLE}|<(?=[A-Za-z!/])")}
_NAME = re.compile(r"<<\s*([A-Za-z_]+|=)")
_CONTINUED = re.compile(r"^\\|\s*\\$")


class Segment(NamedTuple):
    kind: str
    raw: str
    start: int


def _call_end(line: str, start: int) -> int:
    """The place after the bracket that closes the one at start, quotes left out; -1 if there is none."""
    depth = 0
    for m in _NESTING.finditer(line, start):
        mark = m.group()
        if mark in "\"'":  # a quote that isn't closed
            return -1
        depth += {"(": 1, ")": -1}.get(mark, 0)
        if not depth:
            return m.end()
    return -1


def _code_at(line: str, begin: re.Match, harlowe: bool) -> tuple[str, int] | None:
    """Kind and end of the code that begins here; None if it is text after all."""
    at, mark = begin.start(), begin.group()
    if mark == "<<":
        m = _MACRO.match(line, at)
        return "macro", m.end() if m else len(line)
    if mark[0] == "(":
        end = _call_end(line, at)
        return "macro", end if end > 0 else len(line)
    if mark[0] == "$":
        return "var", begin.end()
    if mark == "[[" or mark == "[img[":
        end = line.find("]]", at + len(mark))
        if end > 0 or mark == "[[":  # an open link is a structure of code
            return ("macro", len(line)) if end < 0 else ("link" if mark == "[[" else "img", end + 2)
    if mark[0] == "[":
        end = line.find("]", at + 1)
        inner = line[at + 1 : end]
        return ("macro", end + 1) if harlowe and end > 0 and ("->" in inner or "<-" in inner) else None
    end = line.find(">", at + 1)
    return ("tag", end + 1) if end > 0 else None


def segments(line: str, harlowe: bool = False) -> list[Segment]:
    """The line in parts: text, link, img, macro, tag, var. What isn't closed goes to the line's end."""
    out, at, scan = [], 0, 0
    while (begin := _BEGINS[harlowe].search(line, scan)) is not None:
        if begin.start() > at:
            out.append(Segment("text", line[at : begin.start()], at))
            at = begin.start()
        found = _code_at(line, begin, harlowe)
        if found is None:
            scan = at + 1
        else:
            out.append(Segment(found[0], line[at : found[1]], at))
            at = scan = found[1]
    if at < len(line):
        out.append(Segment("text", line[at:], at))
    return out


def link_parts(inner: str) -> tuple[str, str, str]:
    """Label, separator and target of a link; without a separator label and target are one."""
    sep = next((s for s in ARROWS if s in inner), "")
    if not sep:
        return inner.strip(), "", ""
    a, b = (x.strip() for x in inner.split(sep, 1))
    return (b, sep, a) if sep == "<-" else (a, sep, b)


def mask_story_codes(text: str, harlowe: bool = False) -> tuple[str, list[str]]:
    """text with numbered tokens for its codes, and the codes: calls and arrow links first, then links, then the others. A link keeps a plain label."""
    codes: list[str] = []

    def token(code: str) -> tuple[str]:
        codes.append(code)
        return (f"<x{len(codes) - 1}/>",)

    def link(m: re.Match) -> tuple[str]:
        label, sep, target = link_parts(m.group(1))
        if not sep or LABEL_CODE.search(label):
            return token(m.group())
        (t,) = token(target)
        return (f"[[{t}{sep}{label}]]" if sep == "<-" else f"[[{label}{sep}{t}]]",)

    def calls(part: str) -> Iterator[tuple[int, int, str]]:
        at = 0
        while (m := re.compile(_CALL).search(part, at)) and (end := _call_end(part, m.start())) > 0:
            yield m.start(), end, token(part[m.start() : end])[0]
            at = end

    def of(pattern: re.Pattern, f) -> object:
        return lambda part: ((m.start(), m.end(), f(m)[0]) for m in pattern.finditer(part))

    whole = lambda m: token(m.group())
    # Pieces are texts, or tuples of what is masked already.
    pieces: list[str | tuple[str]] = [text]
    for step in ([calls, of(HARLOWE_LINK, whole)] if harlowe else []) + [of(LINK, link), of(CODE, whole)]:
        new: list[str | tuple[str]] = []
        for p in pieces:
            if isinstance(p, tuple):
                new.append(p)
                continue
            at = 0
            for a, b, masked in step(p):
                new += [p[at:a], (masked,)]
                at = b
            new.append(p[at:])
        pieces = new
    return "".join(p if isinstance(p, str) else p[0] for p in pieces), codes


def _lettered(text: str) -> bool:
    return any(map(str.isalpha, text))


def fragments(seg: Segment, harlowe: bool = False) -> list[tuple[int | None, str]]:
    """What of a segment is translated: (argument's place or None, text)."""
    if seg.kind == "text":
        text = seg.raw.strip()
        if not text or ("/*" in text and "*/" in text):
            return []
        masked = mask_story_codes(text, harlowe)[0]
        return [(None, masked)] if _lettered(TOKEN.sub("", masked)) else []
    if seg.kind == "link":
        label, sep, _ = link_parts(seg.raw[2:-2])
        return [(None, label)] if sep and _lettered(label) and not LABEL_CODE.search(label) else []
    name = _NAME.match(seg.raw) if seg.kind == "macro" else None
    if not name:
        return []
    word = name.group(1).lower()
    every = word in ALL_ARGUMENTS or (word == "=" and "either(" in seg.raw)
    found = [m.group(2) for m in _LITERAL.finditer(seg.raw)]
    shown = [(k, a) for k, a in enumerate(found) if every or (k == 0 and word in FIRST_ARGUMENT)]
    return [(k, a) for k, a in shown if _lettered(a) and not LABEL_CODE.search(a)]


def live_lines(body: str) -> Iterator[tuple[int, str]]:
    """Number and text (entities resolved) of the lines outside of scripts and of macros and links over several lines."""
    script = macro = link = False
    for n, raw in enumerate(body.split("\n")):
        line = html.unescape(raw)
        low, opened = line.lower(), line.count("<<") - line.count(">>")
        if "<script" in low:
            script = "</script" not in low
        elif script:
            script = "</script" not in low
        elif link:
            link = not line.rstrip().endswith("]")
        elif macro:
            macro = opened >= 0
        elif opened:
            macro = opened > 0
        elif "[[" in line and "[[" in SETTER_LINK.sub("", LINK.sub("", line)):
            link = True
        elif not _CONTINUED.search(line):
            yield n, line


# -- as rows

def _attribute(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf'(?<![\w-]){name}="([^"]*)"', 1)


def story_passages(files: DataFrame, file: str = "file", body: str = "html") -> DataFrame:
    """file, ord (from 1), pid, name, tags, harlowe, body of every passage, entities as they are. A passage that isn't closed ends the story."""
    story = F.regexp_extract(F.col(body), r"<tw-storydata\b[^>]*>", 0)
    rows = files.select(file, F.lower(F.trim(_attribute(story, "format"))).startswith("harlowe").alias("harlowe"), F.posexplode(F.split(F.col(body), r"<tw-passagedata\b")).alias("ord", "part"))
    head, text = F.split("part", ">", 2), F.split(F.get(F.split("part", ">", 2), F.lit(1)), "</tw-passagedata>", 2)
    rows = rows.where((F.col("ord") > 0) & (F.size(text) == 2)).withColumn("head", head[0]).withColumn("text", text[0])
    pid = F.when(F.col("head").rlike(r'(?<![\w-])pid="'), _attribute(F.col("head"), "pid")).otherwise("?")
    return rows.select(file, F.col("ord").cast("int").alias("ord"), pid.alias("pid"), unescape_html(_attribute(F.col("head"), "name")).alias("name"), _attribute(F.col("head"), "tags").alias("tags"), "harlowe", F.col("text").alias("body"))


@F.pandas_udf(T.StringType())
def _unescaped(texts):
    return texts.map(html.unescape, na_action="ignore")


def unescape_html(text: Column) -> Column:
    """All named and numbered entities resolved. No built-in expression knows their table, so it is a pandas UDF."""
    return _unescaped(text)


def is_service(name: Column, tags: Column) -> Column:
    """Passages that hold code: by name, or by one of their tags."""
    return name.isin(*SERVICE_NAMES) | F.arrays_overlap(F.split(tags, r"\s+"), F.array(*map(F.lit, SERVICE_TAGS)))


FRAGMENTS = "file string, ord int, pid string, line int, seg int, arg int, kind string, original string"


def passage_fragments(passages: DataFrame) -> DataFrame:
    """FRAGMENTS of passages that aren't code: each translated text with its line and segment (from 0) and, in macros, its argument's place."""
    return _named_fragments(passages).drop("name")


def _named_fragments(passages: DataFrame) -> DataFrame:
    """These with the passage's name."""
    schema = pa.schema([("name", pa.string()), ("file", pa.string()), ("ord", pa.int32()), ("pid", pa.string()), ("line", pa.int32()), ("seg", pa.int32()), ("arg", pa.int32()), ("kind", pa.string()), ("original", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in (r.as_py() for r in b.to_struct_array()):
                own = [(p["name"], p["file"], p["ord"], p["pid"], n, k, arg, s.kind, text) for n, line in live_lines(p["body"]) for k, s in enumerate(segments(line, p["harlowe"])) for arg, text in fragments(s, p["harlowe"])]
                if own:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*own), schema)], schema=schema)

    rows = passages.where(~is_service(F.col("name"), F.col("tags")))
    return rows.select(F.col("file").cast("string").alias("file"), "ord", "pid", "harlowe", "body", "name").mapInArrow(run, f"name string, {FRAGMENTS}")


def story_entries(files: DataFrame, file: str = "file", body: str = "html") -> DataFrame:
    """file, ord, line, seg, arg, json_path, context, original: the texts to translate of all stories."""
    passages = story_passages(files, file, body).withColumnRenamed(file, "file")
    # A story's passages lie in one row; they are dealt out before they are read.
    found = _named_fragments(passages.where("file IS NOT NULL").repartition("file", "ord"))
    path = F.concat(F.format_string("passage[%s].line[%d].seg[%d]", "pid", "line", "seg"), F.when(F.col("arg").isNotNull(), F.format_string(".arg[%d]", "arg")).otherwise(""))
    return found.select("file", "ord", "line", "seg", "arg", path.alias("json_path"), F.format_string("%s (pid %s)", "name", "pid").alias("context"), "original")


def story_model(passages: DataFrame) -> DataFrame:
    """file and passages: array of (ord, pid, name, tags, segments of (line, seg, type, raw, translatable)), in order; entities as they are, lines without text left out."""
    made = "segments array<struct<line: int, seg: int, type: string, raw: string, translatable: array<string>>>"
    kind = pa.list_(pa.struct([("line", pa.int32()), ("seg", pa.int32()), ("type", pa.string()), ("raw", pa.string()), ("translatable", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [[{"line": n, "seg": k, "type": s.kind, "raw": s.raw, "translatable": [t for _, t in fragments(s, p["harlowe"])]} for n, line in enumerate(p["body"].split("\n")) if line.strip() for k, s in enumerate(segments(line, p["harlowe"]))] for p in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, kind)], names=[*b.schema.names, "segments"])

    rows = passages.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passages.schema) + ", " + made)
    return rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "pid", "name", "tags", "segments"))).alias("passages"))
