"""Token files of directly addressable codes.

File, little-endian: parts one after another, then for each part uint64 place in
the file, uint64 ids and uint64 documents before it, then uint64 parts and
b"DACF". Part: b"DAC1", uint32 levels, uint64 documents, uint64 ids, uint64
length of each level; then int64 doc_id, uint8 doc_id-is-null and uint64 end (in
ids of this part) of each document, and for each level its 8-bit chunks (lowest
first), for all but the last also the continuation bitmap (bit i: id i of this
level has a chunk in the next) and the rank directory (uint32 set bits before
each 512-bit block). Id i is read by one chunk a level: where its bit is set, its
place in the next level is the number of set bits before it, which the directory
and at most one block give; nothing else is decoded.

write_tokens() deals documents by ranges of (doc_id, hash of the text), so files
in the order of their part numbers hold all documents in ascending doc_id order
(null first, ties by that hash, then by text). A task appends a part for each
PART_TEXT bytes of text, and begins another file after FILE_TEXT; the rows of the
manifest for its files are one JSON file. Files are written under a temporary
name and renamed, so a task that runs twice, or on another executor, leaves the
same files.

Defined results: a null or empty text is the end id alone; repeated rows are
stored each; an empty table makes no file and an empty result.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedFiles, begin, bounded_batches, by_bytes, new_folder, shuffle_parts
from .packing import with_end
from .tokens import SLICE_BYTES, Encoder

#: Bytes of text whose ids make a part (a longer text is a part of its own).
PART_TEXT = 4 << 20
#: Bytes of text after which a task begins another file.
FILE_TEXT = 256 << 20
BLOCK = 512


def encode_part(doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        levels.append(rest)
        more = rest > 0xFF
        if not more.any():
            break
        rest = rest[more] >> 8
    head = b"DAC1" + struct.pack("<IQQ", len(levels), len(n), len(ids)) + struct.pack(f"<{len(levels)}Q", *map(len, levels))
    out = [head, doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), np.cumsum(n).astype("<u8").tobytes()]
    for k, values in enumerate(levels):
        out.append((values & 0xFF).astype(np.uint8).tobytes())
        if k + 1 < len(levels):
            bits = np.zeros(-(-len(values) // BLOCK) * BLOCK, np.uint8)
            bits[: len(values)] = values > 0xFF
            blocks = bits.reshape(-1, BLOCK).sum(1, dtype=np.int64)
            out += [np.packbits(bits, bitorder="little").tobytes(), (np.cumsum(blocks) - blocks).astype("<u4").tobytes()]
    return out


class TokenPart:
    """Random access to the ids of one part's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a part of a token file")
        count, docs, self.n = struct.unpack_from("<IQQ", data, 4)
        sizes = struct.unpack_from(f"<{count}Q", data, 24)
        at = 24 + 8 * count
        self.levels = []

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.doc_ids, self.null, self.ends = part("<i8", docs), part("u1", docs), part("<u8", docs).astype(np.int64)
        for k, size in enumerate(sizes):
            blocks = -(-size // BLOCK) if k + 1 < count else 0
            self.levels.append((part("u1", size), part("u1", blocks * BLOCK // 8), part("<u4", blocks)))

    def __len__(self) -> int:
        return self.n

    @staticmethod
    def _rank(bitmap: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Set bits before bit i."""
        block, inside = divmod(i, BLOCK)
        if block == len(directory):  # past the last block
            if not block:
                return 0
            block, inside = block - 1, BLOCK
        some = np.unpackbits(bitmap[block * BLOCK // 8 :][: BLOCK // 8], bitorder="little")
        return int(directory[block]) + int(some[:inside].sum())

    def __getitem__(self, i: int) -> int:
        """Id i alone: one chunk from each level that it reaches."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not len(directory) or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(bitmap, directory, i)
        return value

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end-1; reads only their chunks in each level."""
        out = np.zeros(max(0, end - start), np.uint32)
        where = np.arange(len(out))
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            if start >= end:
                break
            out[where] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * k)
            if not len(directory):
                break
            first = start // 8
            bits = np.unpackbits(bitmap[first : -(-end // 8)], bitorder="little")[start - 8 * first :][: end - start].astype(bool)
            where = where[bits]
            start, end = (self._rank(bitmap, directory, i) for i in (start, end))
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this part, ids) of each document."""
        begin = 0
        for doc, null, end in zip(self.doc_ids.tolist(), self.null.tolist(), self.ends.tolist(), strict=True):
            yield None if null else doc, begin, self.ids(begin, end)
            begin = end


class TokenFile:
    """Random access to the ids of a file; a part is read when one of its ids is asked for."""

    def __init__(self, files: SharedFiles, name: str, size: int):
        self.files, self.name = files, name
        many, mark = struct.unpack("<Q4s", files.read(name, size - 12, 12))
        if mark != b"DACF":
            raise ValueError(f"{name} isn't a token file")
        foot = size - 12 - 24 * many
        self.places, self.firsts, self.docs = np.frombuffer(files.read(name, foot, 24 * many), "<u8").astype(np.int64).reshape(-1, 3).T
        self.stops = np.append(self.places[1:], foot)
        self._part = lru_cache(maxsize=2)(self.part)

    def part(self, k: int) -> TokenPart:
        return TokenPart(self.files.read(self.name, int(self.places[k]), int(self.stops[k] - self.places[k])))

    def __getitem__(self, i: int) -> int:
        if i < 0:
            raise IndexError(i)
        k = int(np.searchsorted(self.firsts, i, "right")) - 1
        return self._part(k)[i - int(self.firsts[k])]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this file, ids) of each document, a part in memory at a time."""
        for k, first in enumerate(self.firsts.tolist()):
            for doc, start, ids in self.part(k).documents():
                yield doc, first + start, ids


MANIFEST = "file string, part long, number long, size long, n_docs long, n_ids long"


class Writer:
    """Appends parts to files of one task, and keeps their manifest rows."""

    def __init__(self, files: SharedFiles, part: int):
        self.files, self.part, self.rows, self.text = files, part, [], 0
        self.out = None

    def add(self, doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, n: np.ndarray, text: int) -> None:
        if self.out is None:
            self.name = f"tokens-{self.part:06d}-{len(self.rows):06d}.dac"
            self.out, self.foot, self.n_docs, self.n_ids, self.text = self.files.stream(self.name), [], 0, 0, 0
        self.foot.append((self.out.size, self.n_ids, self.n_docs))
        for x in encode_part(doc_ids, null, ids, n):
            self.out.write(x)
        self.n_docs, self.n_ids, self.text = self.n_docs + len(n), self.n_ids + len(ids), self.text + text
        if self.text >= FILE_TEXT:
            self.end()

    def end(self) -> None:
        if self.out is None:
            return
        self.out.write(np.array(self.foot, "<u8").tobytes() + struct.pack("<Q4s", len(self.foot), b"DACF"))
        self.rows.append({"file": self.name, "part": self.part, "number": len(self.rows), "size": self.out.size, "n_docs": self.n_docs, "n_ids": self.n_ids})
        self.out.close()
        self.out = None


def write_tokens(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Writes the token files into folder; returns their manifest (file, part, number, size, n_docs, n_ids, first_id), first_id being the ids in all files before."""
    spark = df.sparkSession
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens")
        encoder, files, part = Encoder.of(tokenizer), SharedFiles(folder), TaskContext.get().partitionId()
        writer = Writer(files, part)
        for batch in batches:
            for some in by_bytes(batch, "text", PART_TEXT):
                made = [with_end(*encoder(x.column("text")), end_id) for x in by_bytes(some, "text", SLICE_BYTES)]
                ids, n = (np.concatenate(x) for x in zip(*made, strict=True))
                doc = some.column("id")
                size = pc.sum(pc.binary_length(some.column("text"))).as_py() or 0
                writer.add(doc.fill_null(0).to_numpy(), np.array(doc.is_null().to_pylist(), np.uint8), ids, n, size)
        writer.end()
        if writer.rows:
            files.write(f"part-{part:06d}.json", ["\n".join(map(json.dumps, writer.rows)).encode()])
        yield pa.RecordBatch.from_arrays([pa.array([x["file"] for x in writer.rows], pa.string())], ["file"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    key = F.xxhash64("text")
    dealt = rows.repartitionByRange(parts or shuffle_parts(spark), "id", key).sortWithinPartitions("id", key, "text")
    if not dealt.mapInArrow(write, "file string").count():
        return spark.createDataFrame([], MANIFEST + ", first_id long")
    made = spark.read.schema(MANIFEST).json(f"{folder}/*.json")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return made.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, names = SharedFiles(folder), ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for name, size, first in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "first_id")), strict=True):
                found = ((doc, first + start, len(ids), zlib.crc32(ids.astype("<u4"))) for doc, start, ids in TokenFile(files, name, size).documents())
                while some := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some, strict=True)], names)

    dealt = manifest.select("file", "size", "first_id").repartition(max(1, shuffle_parts(manifest.sparkSession) // 3))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents to token files in the shared folder and reads them back."""
    folder = new_folder(df.sparkSession, "tokens")
    return read_tokens(write_tokens(df, folder, tokenizer, end_id, id_col, text_col), folder).withColumnRenamed("doc_id", id_col)
