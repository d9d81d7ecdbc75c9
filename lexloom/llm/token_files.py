"""Token ids in Arrow stream files of equal-length sequences.

The documents, in ascending key order, form one stream of ids, each document closed by an end id. The stream is cut by
range of keys into files; a file holds record batches of two fixed-size lists, ``ids`` (the smallest unsigned integer that
holds the vocabulary) and ``mask`` (false for the padding of a file's last sequence), so that any sequence is found by
arithmetic and read without a copy from a memory map. A second small stream file beside it tells where each document lies.

Files carry names of their own for each attempt; only the manifest, written after the tasks ended, says which count, so a
repeated task or a lost executor leaves at most an unused file. Files go to any file system that pyarrow opens by URI.

Defined results: a null or empty text is the end id alone. Rows with equal keys follow each other, in order of a hash of the text; null
keys come first. An empty table gives an empty manifest and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm._chunks import ChunkMemo
from lexloom.llm._work import new_path, written

#: Ids in a sequence, sequences in a record batch, texts encoded together, bytes of text in a file at most (but for a text of its own), and at least if there are tasks to spare, chunks encoded end to end.
SEQUENCE, BATCH, SLICE, FILE_BYTES, LEAST_BYTES, JOINED = 2048, 128, 512, 64 << 20, 1 << 20, 4096
#: A space that something other than a word follows: there a chunk would not stand for itself.
_UNSAFE = re.compile(r" (?:\s|\Z)|\x00")


class Encoder:
    """Ids of whole texts by the tokenizers library, asked once for each distinct chunk.

    The byte-level vocabulary's pattern always begins a new piece at a space before a word, so a text may be cut there and
    its chunks encoded apart, with equal ids. Texts with other runs of white space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text, as the tokenizers' README has it
        names = self.tok.get_vocab(with_added_tokens=False)
        # A byte-level vocabulary has a character for each byte.
        self.bytes = np.zeros(max(names.values(), default=0) + 1, np.int64)
        self.bytes[list(names.values())] = list(map(len, names))
        self.memo = ChunkMemo(self._fresh)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        # Chunks that begin with a space may be encoded end to end; whose an id is, its bytes tell.
        sizes, parts = np.zeros(len(chunks), np.int64), []
        led = np.fromiter((c[:1] == " " for c in chunks), bool, len(chunks))
        alone = np.flatnonzero(~led).tolist()
        lists = self._ids([chunks[k] for k in alone])
        sizes[alone] = list(map(len, lists))
        joined = np.flatnonzero(led)
        runs = [joined[k : k + JOINED] for k in range(0, len(joined), JOINED)]
        for own, ids in zip(runs, self._ids(["".join([chunks[k] for k in own.tolist()]) for own in runs])):
            flat = np.array(ids, np.uint32)
            ends = np.cumsum([len(chunks[k].encode("utf-8", "surrogatepass")) for k in own.tolist()])
            sizes[own] = np.diff(np.searchsorted(np.cumsum(self.bytes[flat]), ends, side="right"), prepend=0)
            parts.append(flat)
        at, out = np.cumsum(sizes) - sizes, np.zeros(int(sizes.sum()), np.uint32)
        for k, ids in zip(alone, lists):
            out[at[k] : at[k] + len(ids)] = ids
        n = sizes[joined]
        if len(joined):
            out[np.repeat(at[joined] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.concatenate(parts)
        return [(out, sizes)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = {k for k, t in enumerate(texts) if _UNSAFE.search(t)}
        ids, sizes = self.memo.encode([t.replace(" ", "\x00 ").split("\x00") if t and k not in odd else [] for k, t in enumerate(texts)])[0]
        out = np.split(ids, np.cumsum(sizes)[:-1])
        for k in odd:
            out[k] = np.array(self._ids([texts[k]])[0], np.uint32)
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def file_schema(dtype: np.dtype, length: int) -> pa.Schema:
    kind = pa.from_numpy_dtype(dtype)
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", kind, nullable=False), length), nullable=False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length), nullable=False)])


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them by batches."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, length: int = SEQUENCE, batch: int = BATCH):
        self.schema, self.dtype, self.length, self.room = file_schema(dtype, length), dtype, length, length * batch
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.buffer, self.used, self.total, self.sequences = np.zeros(self.room, dtype), 0, 0, 0

    def add(self, ids: np.ndarray) -> None:
        done = 0
        while done < len(ids):
            n = min(len(ids) - done, self.room - self.used)
            self.buffer[self.used : self.used + n] = ids[done : done + n]
            self.used, done = self.used + n, done + n
            if self.used == self.room:
                self._flush()
        self.total += len(ids)

    def _flush(self) -> None:
        rows = -(-self.used // self.length)
        mask = np.arange(rows * self.length) < self.used
        ids = np.where(mask, self.buffer[: rows * self.length], 0).astype(self.dtype)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=self.schema.field(k).type) for k, v in enumerate((ids, mask))]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.used, self.sequences = 0, self.sequences + rows

    def close(self) -> None:
        if self.used:
            self._flush()
        self.out.close()


class SequenceFile:
    """Random access to the sequences of one file; on a local disk through a memory map, without copies."""

    def __init__(self, uri: str):
        system, path = _opened(uri)
        source = pa.memory_map(path) if isinstance(system, pafs.LocalFileSystem) else pa.BufferReader(system.open_input_stream(path).read())
        reader = pa.ipc.open_stream(source)
        self.schema = reader.schema
        self.length = reader.schema.field("ids").type.list_size
        self.batches = list(reader)
        self.ends = np.cumsum([b.num_rows for b in self.batches])

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """ids (a view) and mask of sequence i."""
        k = int(np.searchsorted(self.ends, i, side="right"))
        row = i - (int(self.ends[k - 1]) if k else 0)
        ids, mask = self.batches[k].column("ids"), self.batches[k].column("mask")
        at = slice(row * self.length, (row + 1) * self.length)
        return ids.flatten().to_numpy()[at], mask.flatten()[at].to_numpy(zero_copy_only=False)

    def stream(self, start: int, n: int) -> np.ndarray:
        """n ids from place start of the file's stream."""
        parts, step = [], 0
        for b in self.batches:
            values, room = b.column("ids").flatten().to_numpy(), b.num_rows * self.length
            if start < step + room and start + n > step:
                parts.append(values[max(0, start - step) : start + n - step])
            step += room
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


_DOCS = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])


def write_token_files(df: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, to: str | None = None) -> DataFrame:
    """The manifest, one row for each file in stream order: part, file, docs, n_docs, n_tokens, n_sequences. key: an integer column."""
    folder = to or new_path(df.sparkSession, "tokens")
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # As many files as the corpus asks for; rows of one key may go to several. Ranges are sampled by short values, never by texts.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // FILE_BYTES), min(df.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "key", "h").sortWithinPartitions("key", "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                part = TaskContext.get().partitionId()
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
                coder = encoder(tokenizer)
                dtype = np.dtype(np.uint16 if max(coder.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32)
                system, path = _opened(name)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                sink, index = system.open_output_stream(f"{path}.arrow"), system.open_output_stream(f"{path}.docs.arrow")
                writer, docs, n_docs = SequenceWriter(sink, dtype, length), pa.ipc.new_stream(index, _DOCS), 0
            for k in range(0, b.num_rows, SLICE):
                piece = b.slice(k, SLICE)
                at, sizes = writer.total, []
                for ids in coder.encode(piece.column(1).to_pylist()):
                    writer.add(ids)
                    writer.add(np.array([end_id]))
                    sizes.append(len(ids) + 1)
                n = np.array(sizes, np.int64)
                docs.write_batch(pa.record_batch([piece.column(0), pa.array(at + np.cumsum(n) - n), pa.array(n)], schema=_DOCS))
                n_docs += len(n)
        if writer is not None:
            writer.close()
            docs.close()
            sink.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{name}.arrow", "docs": f"{name}.docs.arrow", "n_docs": n_docs, "n_tokens": writer.total, "n_sequences": writer.sequences}])

    found = written(rows.mapInArrow(run, "part long, file string, docs string, n_docs long, n_tokens long, n_sequences long"), "manifest")
    return found.orderBy("part")


def read_token_documents(manifest: DataFrame) -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids_crc32 of every document, from the files."""
    # One row for each file: the running sum is of file counts, not of documents.
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", "docs", F.coalesce(before, F.lit(0)).alias("before")).repartition("file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                tokens = SequenceFile(f["file"])
                flat = [x.column("ids").flatten().to_numpy() for x in tokens.batches]
                ends = np.cumsum([len(x) for x in flat])
                system, path = _opened(f["docs"])
                with system.open_input_stream(path) as source:
                    for d in pa.ipc.open_stream(source):
                        crcs = []
                        for at, n in zip(d.column("at").to_pylist(), d.column("n").to_pylist()):
                            crc, k = 0, int(np.searchsorted(ends, at, side="right"))
                            while n:
                                lo = at - (int(ends[k - 1]) if k else 0)
                                part = flat[k][lo : lo + n]
                                crc = zlib.crc32(part.astype("<u4"), crc)
                                at, n, k = at + len(part), n - len(part), k + 1
                            crcs.append(crc)
                        start = pa.array(d.column("at").to_numpy() + f["before"])
                        yield pa.record_batch([d.column("key"), start, d.column("n"), pa.array(crcs, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")
