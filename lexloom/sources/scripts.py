"""Scan of visual-novel script sources: dialogue, choices, string blocks, marked strings, and the literals of Python within them.

A file is read in order by one scanner, since a Python block lasts as long as its lines stand deeper than its head and a
dialogue may go on over several lines; files are dealt out over the tasks. Which literals are text is decided by a column
expression, and the first of equal texts over all files has the place.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X

#: Words that begin a statement which isn't a dialogue, and endings of file names.
STATEMENTS = (
    "def default define label screen transform style image scene show hide play stop queue jump call return if elif else while for with menu init translate python layer pause "
    "voice camera animation audio movie window onlayer group when or and not in is None True False pass as at zorder old new"
).split()
FILE_ENDINGS = "png jpg jpeg gif webp bmp ogg mp3 wav flac mp4 webm avi mov ttf otf woff rpy rpyc rpa rpe json txt zip rar 7z xml htm html css js dat sav exe dll py".split()
#: Characters of a line, lines of a dialogue, characters of a hint.
LONGEST_LINE, MOST_LINES, HINT = 4000, 200, 60

_TEXT = r'"((?:[^"\\]++|\\.)*+)"'
_SPEAKER = r"^\s*(?:[a-zA-Z_][\w.]*\s+)?"
_OLD, _CHOICE = re.compile(r"^\s*old\s+" + _TEXT), re.compile(r"^\s*" + _TEXT + r"\s*:\s*$")
_DIALOGUE, _MARKED = re.compile(_SPEAKER + "[fF]?" + _TEXT + r"(?:\s|:|$)"), re.compile(r"_\(\s*" + _TEXT + r"\s*\)")
_STATEMENT = re.compile(r"^\s*(?:" + "|".join(STATEMENTS) + r")\b(?:\s|$)")
_BLOCK = re.compile(r"^\s*(?:init\s+(?:-?\d+\s+)?)?python(?:\s+hide)?\s*:")
_DEFINITION, _COMMENT = re.compile(r"^\s*(?:define|default)\b(?:\s+|$)"), re.compile(r"^\s*#")
_OPENS = re.compile(_SPEAKER + r'"|' + _OLD.pattern)
_ESCAPED_OR_QUOTE = re.compile(r'\\.|"', re.S)
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]++|\\.)*+"', r"'(?:[^'\\\n]++|\\.)*+'"
_LITERALS = re.compile(rf"#[^\n]*+|({_DOUBLE}|{_SINGLE})", re.S)
_LINES = re.compile(r"[^\n]*\n|[^\n]+")

Found = tuple[int, str, str, str]


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip())


def loose_literals(source: str) -> list[str]:
    """Quoted strings of what isn't Python of today, comments left out: the double-quoted ones, then the single-quoted ones."""
    found = [m.group(1) for m in _LITERALS.finditer(source) if m.group(1)]
    return [f[1:-1] for f in found if f[0] == '"'] + [f[1:-1] for f in found if f[0] == "'"]


def _is_text(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, str)


def _without_doc(body: list[ast.stmt]) -> list[ast.stmt]:
    return body[1:] if body and isinstance(body[0], ast.Expr) and _is_text(body[0].value) else body


def python_literals(source: str) -> list[tuple[str, str]]:
    """(literal, hint) of a piece of Python, docstrings left out. The hint is `key=` and the key in a dictionary, else the name assigned to, else the line."""
    source = textwrap.dedent(source)
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(t, "") for t in loose_literals(source)]
    lines, out = source.split("\n"), []
    # A lone string is a value, not a docstring.
    left: list[tuple[ast.AST, str]] = [(n, "") for n in reversed(_without_doc(body) if len(body) > 1 else body)]
    while left:
        node, hint = left.pop()
        said = hint or (lines[node.lineno - 1].strip()[:HINT] if hasattr(node, "lineno") else "")
        if isinstance(node, ast.JoinedStr):
            out += [(t, said) for t in loose_literals(ast.get_source_segment(source, node) or "")]
            continue
        if _is_text(node):
            out.append((node.value, said))
            continue
        if isinstance(node, ast.Dict):
            inner = [(v, f"key={k.value}" if k is not None and _is_text(k) else hint) for k, v in zip(node.keys, node.values)]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = [(s, hint) for s in _without_doc(node.body)]
        elif isinstance(node, ast.Assign):
            inner = [(node.value, hint or next((t.id for t in node.targets if isinstance(t, ast.Name)), ""))]
        else:
            inner = [(c, hint) for c in ast.iter_child_nodes(node)]
        left += reversed(inner)
    return out


def line_texts(line: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of a line, or of a dialogue over several."""
    if len(line) > LONGEST_LINE or _COMMENT.match(line):
        return
    if m := _OLD.match(line):
        yield "translate-block", m.group(1)
    elif m := _CHOICE.match(line):
        yield "choice", m.group(1)
    elif not _STATEMENT.match(line) and (m := _DIALOGUE.match(line)):
        yield "dialogue", m.group(1)
    for m in _MARKED.finditer(line):
        yield "_()", m.group(1)


def _odd_quotes(line: str) -> bool:
    return sum(m.group() == '"' for m in _ESCAPED_OR_QUOTE.finditer(line)) % 2 == 1


def script_texts(body: str) -> Iterator[Found]:
    """(line from 1, kind, hint, text) in order."""
    lines, i = _LINES.findall(body.replace("\r\n", "\n").replace("\r", "\n")), 0
    while i < len(lines):
        line, at = lines[i], i + 1
        i += 1
        if head := _BLOCK.match(line):
            block = [rest] if (rest := line[head.end() :]).strip() else []
            while i < len(lines) and (not lines[i].strip() or _depth(lines[i]) > _depth(line)):
                block.append(lines[i] if lines[i].strip() else "\n")
                i += 1
            yield from ((at, "python", h, t) for t, h in python_literals("".join(block)))
            continue
        if line.lstrip().startswith("$"):
            yield from ((at, "python", h, t) for t, h in python_literals(line.partition("$")[2]))
            continue
        if m := _DEFINITION.match(line):
            yield from ((at, "python", h, t) for t, h in python_literals(line[m.end() :]))
        if _OPENS.match(line) and _odd_quotes(line):
            part, stop = [line], i + MOST_LINES
            while i < min(len(lines), stop):
                part.append(lines[i])
                i += 1
                if _odd_quotes(part[-1]):
                    break
            line = "".join(part)
        yield from ((at, kind, "", text) for kind, text in line_texts(line))


def is_literal_text(s: Column) -> Column:
    """Whether a literal is text: not a file, an address, a colour, a key, a name or a shader."""
    name = s.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z") & ((F.length(s) >= 12) | (s.contains("_") & (F.length(s) >= 8)))
    numbered = s.rlike(r"^[A-Za-z0-9_]+\z") & s.rlike("[0-9]")
    place = s.contains("://") | s.startswith("file:") | s.rlike(r"(?i)\.(?:" + "|".join(FILE_ENDINGS) + r")\s*$") | s.rlike(r"^#[0-9a-fA-F]{3,8}\z")
    shader = s.rlike(r"\b(?:sampler2D|uniform|varying|attribute)\b") | (s.contains(";") & s.contains("\n"))
    return F.length(s).between(2, LONGEST_LINE) & X.has_letter(s) & ~place & ~numbered & ~name & ~shader


def script_files(files: DataFrame, language: str | None = None, file: str = "file", own_prefix: str = "own_") -> DataFrame:
    """The script sources to scan: those of the engine's folders and our own output (own_prefix) are left out; with a language, only its folder of `tl`."""
    path, name = F.col(file), F.element_at(F.split(file, "/"), -1)
    rule = name.endswith(".rpy") & ~path.rlike(r"(?:^|/)(?:renpy|__pycache__)/") & ~F.lower(name).startswith(own_prefix)
    spoken = F.regexp_extract(path, r"(?:^|/)tl/([^/]+)/", 1)
    return files.where(rule if language is None else rule & ((spoken == "") | (spoken == language)))


def script_languages(files: DataFrame, file: str = "file") -> DataFrame:
    """lang: the folders of `tl` that hold sources."""
    spoken = F.regexp_extract(F.col(file), r"(?:^|/)tl/([^/.][^/]*)/.*\.rpyc?$", 1)
    return files.select(spoken.alias("lang")).where("lang <> ''").distinct()


def script_literals(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """file, ord, line, kind, hint, original: all strings of script sources, in order within a file."""
    schema = pa.schema([("file", pa.string()), ("ord", pa.int32()), ("line", pa.int32()), ("kind", pa.string()), ("hint", pa.string()), ("original", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                rows = [(f["file"], k, *x) for k, x in enumerate(script_texts(f["body"] or ""))]
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return files.select(F.col(file).cast("string").alias("file"), F.col(body).alias("body")).mapInArrow(run, "file string, ord int, line int, kind string, hint string, original string")


def script_entries(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """file, ord, json_path, context, original: the texts to translate; of equal ones the first by file and place."""
    found = script_literals(files, file, body)
    code = F.col("kind") == "python"
    good = found.where(F.when(code, is_literal_text(F.col("original"))).otherwise(F.lit(True)) & (F.length(X.stripped(F.col("original"))) >= 2))
    where = F.when(code, F.concat(F.lit("python"), F.when(F.col("hint") != "", F.concat(F.lit(":"), "hint")).otherwise(""))).otherwise(F.concat(F.col("line").cast("string"), F.lit(":"), "kind"))
    named = good.select("file", "ord", F.concat("file", F.lit(":"), where).alias("context"), "original")
    # Reduced before the shuffle: a text in all files is one row for each task.
    first = named.groupBy("original").agg(F.min(F.struct("file", "ord", "context")).alias("x"))
    return first.select("x.file", "x.ord", F.concat(F.lit("ctx:"), F.substring("x.context", 1, 60)).alias("json_path"), "x.context", "original")
