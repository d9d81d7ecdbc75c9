"""Files within game archives: RPA (versions 1 to 3) and ASAR.

An archive's index is read once into rows, one for each file with its place; these rows are dealt over the tasks, which read the
bytes by range. So a large archive is read by many tasks, and only what a filter on the rows leaves. Archives have to lie where every
executor can open them (a shared folder, or a scheme that pyarrow knows).

Indexes that are pickles are read without any class: one that asks for a class or a function of its own is refused.
"""

from __future__ import annotations

import io
import json
import pickle
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An archive's file: where its bytes begin, how many there are, what stands before them; apart: in a folder beside the archive.
INDEX = "archive string, file string, offset long, size long, head binary, apart boolean"
_ARROW = pa.schema([("archive", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("head", pa.binary()), ("apart", pa.bool_())])


class Place(NamedTuple):
    file: str
    offset: int
    size: int
    head: bytes = b""
    apart: bool = False


def _bytes_of(text: str, encoding: str) -> bytes:
    if encoding not in ("latin1", "latin-1"):
        raise ValueError("an index holds bytes as latin-1 only")
    return text.encode("latin-1")


def _no_bytes() -> bytes:
    return b""


class _Plain(pickle.Unpickler):
    """Numbers, texts, bytes, lists and dictionaries only. Bytes of older protocols are calls, which are answered by functions of our own."""

    def find_class(self, module: str, name: str) -> object:
        if (module, name) == ("_codecs", "encode"):
            return _bytes_of
        if (module, name) in (("__builtin__", "bytes"), ("builtins", "bytes")):
            return _no_bytes
        raise ValueError(f"an index doesn't hold {module}.{name}")

    def persistent_load(self, pid: object) -> object:
        raise ValueError("an index doesn't refer to anything")


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _text(name: str | bytes) -> str:
    return name.decode("utf-8", "replace") if isinstance(name, bytes) else name


def rpa_places(source: pa.NativeFile) -> list[Place]:
    head = source.read(64)
    if head[:2] == b"\x78\x9c":
        at, key = 0, 0
    elif head[:7] in (b"RPA-2.0", b"RPA-3.0"):
        at, key = int(head[8:24], 16), int(head[25:33], 16) if head[4:5] == b"3" else 0
    else:
        raise ValueError("not an RPA archive")
    source.seek(at)
    index = _Plain(io.BytesIO(zlib.decompress(source.read())), encoding="latin-1").load()
    found = [(_text(name), parts[0]) for name, parts in index.items() if parts and len(parts[0]) > 1]
    before = lambda p: p[2].encode("latin-1") if isinstance(p[2], str) else p[2]
    return sorted(Place(name, p[0] ^ key, p[1] ^ key, before(p) if len(p) > 2 and p[2] else b"") for name, p in found)


def asar_places(source: pa.NativeFile) -> list[Place]:
    magic, _, _, size = struct.unpack("<4I", source.read(16).ljust(16, b"\0"))
    if magic != 4:
        raise ValueError("not an ASAR archive")
    tree = json.loads(source.read(size))
    base = 16 + size + -size % 4
    nodes: dict[str, dict] = {}
    left = [("", tree)]
    while left:
        path, node = left.pop()
        if "files" in node:
            left += [(f"{path}/{name}".lstrip("/"), sub) for name, sub in reversed((node["files"] or {}).items())]
        else:
            nodes[path] = node
    out = []
    for path, node in nodes.items():
        seen = {path}
        while "link" in node and node["link"] in nodes and node["link"] not in seen:
            seen.add(node["link"])
            path_of, node = node["link"], nodes[node["link"]]
        if "link" not in node:
            target = path if len(seen) == 1 else path_of
            own = bool(node.get("unpacked"))
            # A file beside the archive is found by its own path, which head holds for a link.
            out.append(Place(path, 0 if own else base + int(node["offset"]), int(node.get("size", 0)), target.encode() if own else b"", own))
    return out


def archive_index(archives: DataFrame, archive: str = "archive") -> DataFrame:
    """INDEX of archives (their paths). What isn't an archive, or can't be read, gives nothing; rejected_archives tells why."""
    return _indexed(archives, archive).where("error IS NULL").select("archive", "file", "offset", "size", "head", "apart")


def rejected_archives(archives: DataFrame, archive: str = "archive") -> DataFrame:
    """archive, error of those that give no index."""
    return _indexed(archives, archive).where("error IS NOT NULL").select("archive", "error")


def _indexed(archives: DataFrame, archive: str) -> DataFrame:
    schema = _ARROW.append(pa.field("error", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows: list[tuple] = []
                try:
                    system, path = _opened(uri)
                    with system.open_input_file(path) as source:
                        places = asar_places(source) if uri.lower().endswith(".asar") else rpa_places(source)
                    rows = [(uri, *p, None) for p in places]
                except (ValueError, OSError, KeyError, TypeError, IndexError, AttributeError, EOFError, zlib.error, struct.error, pickle.UnpicklingError) as e:
                    rows = [(uri, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select(F.col(archive).cast("string")).where(F.col(archive).isNotNull()).mapInArrow(run, INDEX + ", error string")


def archive_files(index: DataFrame) -> DataFrame:
    """archive, file, body of the rows of an index; body is null where the bytes can't be read (a row that was asked for but isn't in the archive, a cut archive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = []
            for r in b.to_pylist():
                try:
                    system, path = _opened(r["archive"])
                    if r["apart"]:
                        with system.open_input_file(f"{path}.unpacked/{r['head'].decode()}") as source:
                            bodies.append(source.read())
                    else:
                        with system.open_input_file(path) as source:
                            body = source.read_at(r["size"], r["offset"])
                        bodies.append((r["head"] or b"") + body if len(body) == r["size"] else None)
                except (OSError, TypeError, ValueError):
                    bodies.append(None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(bodies, pa.binary())], names=["archive", "file", "body"])

    # Files near each other in an archive are read by one task.
    dealt = index.select("archive", "file", "offset", "size", "head", "apart").repartitionByRange("archive", "offset", "file")
    return dealt.mapInArrow(run, "archive string, file string, body binary")


def wanted_files(archives: DataFrame, wanted: DataFrame, archive: str = "archive") -> DataFrame:
    """archive, file, body of the files wanted (archive, file); a file that the archive lacks has a null body."""
    own = wanted.select("archive", "file").distinct().join(archive_index(archives, archive), ["archive", "file"], "left")
    return archive_files(own)


def overlaid(disk: DataFrame, archived: DataFrame, prefixes: tuple[str, ...] = ("project/", "www/")) -> DataFrame:
    """file, body: what a game sees. The first of the prefixes is taken off a path; a file on the disk hides the archives' files of its path, and of several archives the first by name counts."""
    bare = F.regexp_replace("file", "^(?:" + "|".join(prefixes) + ")", "")
    both = disk.select(bare.alias("file"), F.col("body").cast("binary").alias("body"), F.lit("").alias("from")).unionByName(archived.select(bare.alias("file"), "body", F.col("archive").alias("from")))
    return both.groupBy("file").agg(F.min_by("body", "from").alias("body"))
