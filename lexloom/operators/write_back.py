"""Translations written back into files: a join of files with their edits, changed in place, and a sink that publishes whole files once.

A file is read by one task with all of its edits. An edit says where it belongs (json_path), what has to stand there (original)
and what replaces it; where something else stands by now, the edit is left out and counted. All bytes outside of the edits stay: indentation,
line ends, byte order marks and encodings.
"""

from __future__ import annotations

import html
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.shared import stored
from lexloom.operators import entries as E
from lexloom.sources import markup as M
from lexloom.sources import stories as S

Edits = list[tuple[str, str, str]]
#: A file's new bytes and how many of its edits are in them.
Change = Callable[[bytes, Edits], tuple[bytes, int]]

_JSON = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\],]')
_LINE_PLACE = re.compile(r"line\[(\d+)\]\.seg\[(\d+)\]$")
_STORY_PLACE = re.compile(r"passage\[([^\]]*)\]\.line\[(\d+)\]\.seg\[(\d+)\](?:\.arg\[(\d+)\])?$")
_TAG, _TEXT_TAG, _ATTRIBUTE = re.compile(M.SCENARIO_TAG), re.compile(M.TEXT_TAG), re.compile(M.ATTRIBUTE)
_VARIABLE, _LINES = re.compile(X.SCENARIO_VARIABLE), re.compile(r"([^\r\n]*)(\r\n|\n|\r|\Z)")
_PASSAGE = re.compile(r"(<tw-passagedata\b([^>]*)>)(.*?)(?=</tw-passagedata>)", re.S)
_ATTRIBUTES = re.compile(r'(?<![\w-])(pid|name|tags)="([^"]*)"')


def _spliced(text: str, places: list[tuple[int, int, str]]) -> str:
    """text with the spans replaced; they don't overlap and are in order."""
    out, at = [], 0
    for start, end, new in places:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def string_places(text: str) -> Iterator[tuple[str, int, int]]:
    """Path, start and end of each string value of a JSON document, in order."""
    # What is open: [the path to it, the number of the value or None in an object, the key or None before one].
    open_: list[list] = []

    def path() -> str:
        if not open_:
            return ""
        base, number, key = open_[-1]
        return f"{base}[{number}]" if number is not None else f"{base}.{key}" if base else key

    for m in _JSON.finditer(text):
        mark = m.group()
        if mark in "{[":
            open_.append([path(), 0 if mark == "[" else None, None])
        elif mark in "}]":
            if open_:
                open_.pop()
        elif mark == ",":
            if open_ and open_[-1][1] is not None:
                open_[-1][1] += 1
            elif open_:
                open_[-1][2] = None
        elif open_ and open_[-1][1] is None and open_[-1][2] is None:
            open_[-1][2] = json.loads(mark, strict=False)
        else:
            yield path(), m.start(), m.end()


def change_json(body: bytes, edits: Edits) -> tuple[bytes, int]:
    """String values of a JSON file, by path."""
    text = body.decode()
    wanted = {path: (original, new) for path, original, new in edits}
    places = []
    for path, start, end in string_places(text):
        if path in wanted and json.loads(text[start:end], strict=False) == wanted[path][0]:
            places.append((start, end, json.dumps(wanted[path][1], ensure_ascii=False)))
    return _spliced(text, places).encode(), len(places)


def decoded(body: bytes) -> tuple[str, str]:
    """The text of a scenario and its encoding: UTF-8 (its mark stays in the text) or cp932."""
    for encoding in ("utf-8", "cp932"):
        try:
            return body.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return body.decode("latin-1"), "latin-1"


def _same_variables(original: str, new: str) -> bool:
    at = 0
    for m in _VARIABLE.finditer(original):
        at = new.find(m.group(), at)
        if at < 0:
            return False
        at += len(m.group())
    return True


def _scenario_part(part: str, original: str, new: str) -> str | None:
    if not part.startswith("[") or not _TAG.fullmatch(part):
        bare = part.strip()
        return part.replace(bare, new, 1) if bare and bare == original else None
    shown = [m for m in _ATTRIBUTE.finditer(part) if m.group(1) == "text"] if _TEXT_TAG.match(part) else []
    if not shown or shown[-1].group(2)[1:-1].strip() != original or shown[-1].group(2)[0] in new:
        return None
    quote = shown[-1].group(2)[0]
    return part[: shown[-1].start(2)] + quote + new + quote + part[shown[-1].end(2) :]


def change_scenario(body: bytes, edits: Edits) -> tuple[bytes, int]:
    """Texts of scenario lines (from 1) and of tags that show some, by segment; variables have to stay."""
    text, encoding = decoded(body)
    by_line: dict[int, dict[int, tuple[str, str]]] = {}
    for place, original, new in edits:
        if (m := _LINE_PLACE.match(place)) and _same_variables(original, new) and "\n" not in new:
            by_line.setdefault(int(m.group(1)), {})[int(m.group(2))] = (original, new)
    out, n = [], 0
    for number, m in enumerate(_LINES.finditer(text), 1):
        line, own = m.group(1), by_line.get(number)
        if own:
            mark = "﻿" if line.startswith("﻿") else ""
            parts, at = [], len(mark)
            for tag in _TAG.finditer(line):
                parts += [line[at : tag.start()], tag.group()]
                at = tag.end()
            parts = [p for p in [*parts, line[at:]] if p]
            for k, (original, new) in own.items():
                changed = _scenario_part(parts[k], original, new) if k < len(parts) else None
                if changed is not None:
                    parts[k], n = changed, n + 1
            line = mark + "".join(parts)
        out += [line, m.group(2)]
    try:
        return "".join(out).encode(encoding), n
    except UnicodeEncodeError:  # the file's encoding can't hold the translation
        return body, 0


def _story_part(seg: S.Segment, arg: int | None, original: str, new: str, harlowe: bool) -> list[tuple[int, int, str]]:
    """Where in its segment an edit goes, and what; nothing if it doesn't fit or would change the code."""
    if (arg, original) not in S.fragments(seg, harlowe) or "<<" in new:
        return []
    if seg.kind == "text":
        bare = seg.raw.strip()
        codes = S.mask_story_codes(bare, harlowe)[1]
        whole = re.sub(r"</?x(\d+)\s*/?>", lambda m: codes[int(m.group(1))] if int(m.group(1)) < len(codes) else m.group(), new)
        at = seg.raw.index(bare)
        return [(at, at + len(bare), whole)] if S.mask_story_codes(whole, harlowe)[1] == codes else []
    if S.LABEL_CODE.search(new):
        return []
    if seg.kind == "link":
        at = seg.raw.rindex(original) if "<-" in seg.raw else seg.raw.index(original)
        return [] if any(a in new for a in S.ARROWS) else [(at, at + len(original), new)]
    m = [*S._LITERAL.finditer(seg.raw)][arg or 0]
    return [(m.start(2), m.end(2), new)] if m.group(1) not in new else []


def change_story(body: bytes, edits: Edits) -> tuple[bytes, int]:
    """Texts of a story by passage, line and segment; changed lines have their entities written anew, service passages stay."""
    text, n = body.decode("utf-8", "surrogateescape"), 0
    harlowe = bool(re.search(r'<tw-storydata\b[^>]*\bformat="\s*harlowe', text, re.I))
    wanted: dict[str, dict[int, dict[int, list]]] = {}
    for place, original, new in edits:
        if (m := _STORY_PLACE.match(place)) and "\n" not in new:
            arg = int(m.group(4)) if m.group(4) else None
            wanted.setdefault(m.group(1), {}).setdefault(int(m.group(2)), {}).setdefault(int(m.group(3)), []).append((arg, original, new))

    def passage(m: re.Match) -> str:
        nonlocal n
        about = dict(_ATTRIBUTES.findall(m.group(2)))
        own = wanted.get(about.get("pid", "?"))
        if not own or html.unescape(about.get("name", "")) in S.SERVICE_NAMES or set(about.get("tags", "").split()) & set(S.SERVICE_TAGS):
            return m.group()
        lines = m.group(3).split("\n")
        for number, line in S.live_lines(m.group(3)):
            parts = S.segments(line, harlowe) if number in own else []
            raws, before = [s.raw for s in parts], n
            for k, changes in own.get(number, {}).items():
                found = sorted(p for arg, original, new in changes if k < len(parts) for p in _story_part(parts[k], arg, original, new, harlowe))
                if found:
                    raws[k], n = _spliced(raws[k], found), n + len(found)
            if n > before:
                lines[number] = html.escape("".join(raws), quote=False)
        return m.group(1) + "\n".join(lines)

    return _PASSAGE.sub(passage, text).encode("utf-8", "surrogateescape"), n


def patched(files: DataFrame, edits: DataFrame, change: Change) -> DataFrame:
    """file, body (bytes), edits, applied: the files (file, body) that have edits (file, json_path, original, translation), changed. A file that can't be read stays as it is, with applied 0."""
    own = edits.groupBy("file").agg(F.collect_list(F.struct("json_path", "original", "translation")).alias("edits"))
    rows = files.select("file", F.col("body").cast("binary").alias("body")).join(own, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in (x.as_py() for x in b.to_struct_array()):
                try:
                    body, n = change(r["body"], [(e["json_path"], e["original"], e["translation"]) for e in r["edits"]])
                except ValueError:
                    body, n = r["body"], 0
                out.append((r["file"], body, len(r["edits"]), n))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.int32(), pa.int32()))], names=["file", "body", "edits", "applied"])

    return rows.mapInArrow(run, "file string, body binary, edits int, applied int")


def edits_of(entries: DataFrame) -> DataFrame:
    """What of entries is written back."""
    return E.applicable(entries).select("file", "json_path", "original", "translation")


def string_files(pairs: DataFrame, language: str, folder: str = "game/tl") -> DataFrame:
    """file, body: the string files of a language, one for each source of pairs (string_pairs), in order."""
    block = F.format_string('    # %s\n    old "%s"\n    new "%s"\n', "tag", "old", "new")
    own = pairs.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("id", block.alias("block")))).alias("blocks"))
    name = F.concat(F.lit(f"{folder}/{language}/own_"), F.replace("file", F.lit("/"), F.lit("__")))
    return own.select(name.alias("file"), F.concat(F.lit(f"translate {language} strings:\n\n"), F.array_join("blocks.block", "\n")).cast("binary").alias("body"))


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def publish(files: DataFrame, folder: str, backup: str | None = None) -> DataFrame:
    """Writes files (file: a relative path, body: bytes) under folder, and gives file, size. Other files there stay.

    Tasks write under names of their own attempt; only what the finished job lists is moved to its place, each move being
    whole and safe to repeat. So a repeated task or a lost executor leaves no second file and no half one. With backup, a file that
    was there is copied to that folder first, unless it holds a copy already.
    """
    attempt = f"{folder.rstrip('/')}/_attempt-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _opened(attempt)
        system.create_dir(at, recursive=True)
        for b in batches:
            held = [f"{at}/{uuid.uuid4().hex}" for _ in range(b.num_rows)]
            for name, body in zip(held, b.column(1).to_pylist()):
                with system.open_output_stream(name) as sink:
                    sink.write(body or b"")
            yield pa.record_batch([b.column(0), pa.array(held, pa.string()), pa.array([len(x or b"") for x in b.column(1).to_pylist()], pa.int64())], names=["file", "held", "size"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _opened(folder.rstrip("/"))
        for b in batches:
            for r in b.to_pylist():
                place = f"{top}/{r['file']}"
                system.create_dir(place.rpartition("/")[0], recursive=True)
                there = system.get_file_info(r["held"]).type == pafs.FileType.File
                if there and backup and system.get_file_info(place).type == pafs.FileType.File:
                    kept = f"{_opened(backup)[1].rstrip('/')}/{r['file']}"
                    if system.get_file_info(kept).type == pafs.FileType.NotFound:
                        system.create_dir(kept.rpartition("/")[0], recursive=True)
                        system.copy_file(place, kept)
                if there:
                    system.move(r["held"], place)
                elif system.get_file_info(place).type != pafs.FileType.File:
                    raise OSError(f"lost: {r['file']}")
            yield b.select(["file", "size"])

    outside = F.col("file").rlike(r"(^|[\\/])\.\.([\\/]|$)|^[\\/]|^$") | F.col("file").isNull()
    if files.where(outside).limit(1).count():
        raise ValueError("paths have to lie within the folder")
    listed = stored(files.select("file", F.col("body").cast("binary").alias("body")).mapInArrow(write, "file string, held string, size long"), "files")
    if listed.groupBy("file").count().where("count > 1").limit(1).count():
        raise ValueError("two rows have the same path")
    done = stored(listed.mapInArrow(move, "file string, size long"), "published")
    system, at = _opened(attempt)
    if system.get_file_info(at).type == pafs.FileType.Directory:
        system.delete_dir(at)
    return done
