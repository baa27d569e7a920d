"""Best-fit-decreasing packing of token sequences, exact over the whole corpus.

Best fit decreasing treats pieces of one length alike, so its course depends
only on how many pieces have each length. Those counts (at most `capacity`
rows, whatever the input) go to the driver; there the lengths are taken in
falling order, and a segment tree over remaining capacities finds the tightest
open bins in logarithmic time. Bins that have the same past are one group, so
that a step fills a whole group: the plan has a few rows a length, not one a
document. Pieces get a rank among those of their length (counts per bucket of
a hash, then row numbers inside a bucket, so a length that a third of all
pieces share is spread), and the plan turns (length, rank) into a bin and an
offset inside an Arrow function.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, bounded_batches, by_bytes, materialise, ragged
from .tokens import SLICE_BYTES, Encoder

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def with_end(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with end_id after those of each text."""
    out = np.full(len(ids) + len(n), end_id, np.uint32)
    out[ragged(np.cumsum(n + 1) - n - 1, n)] = ids
    return out, n + 1


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of at most `capacity` ids; only longer documents are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens")
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                ids, n = with_end(*encoder(part.column("text")), end_id)
                many = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), many)
                piece = ragged(np.zeros(len(n), np.int64), many)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                at = (np.cumsum(n) - n)[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


class OpenBins:
    """Groups of bins by remaining capacity, with a segment tree that tells which capacities are there."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.there = bytearray(2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _set(self, leaf: int, value: int) -> None:
        node = leaf + self.size
        self.there[node] = value
        while node > 1:
            node >>= 1
            now = self.there[2 * node] | self.there[2 * node + 1]
            if self.there[node] == now:
                break
            self.there[node] = now

    def add(self, remaining: int, first: int, count: int) -> None:
        if count:
            self.groups[remaining].append((first, count))
            if len(self.groups[remaining]) == 1:
                self._set(remaining, 1)

    def take(self, remaining: int) -> tuple[int, int]:
        group = self.groups[remaining].pop()
        if not self.groups[remaining]:
            self._set(remaining, 0)
        return group

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity >= least that some bin has."""
        node = least + self.size
        if self.there[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.there[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node + (not self.there[2 * node])
                return node - self.size
            node >>= 1
        return None


def best_fit_plan(counts: Mapping[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Rows (length, rank, bin, per_bin, offset): pieces of `length` from `rank` on go to `bin` and the following ones, per_bin to each, from `offset` on; a row holds until the next of its length."""
    bins, rows, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            remaining = bins.tightest(length)
            if remaining is None:
                new = -(-(n - rank) // (capacity // length))
                bins.add(capacity, opened, new)
                opened += new
                continue
            first, count = bins.take(remaining)
            per_bin = remaining // length
            taken = min(n - rank, count * per_bin)
            full, rest = divmod(taken, per_bin)
            rows.append((length, rank, first, per_bin, capacity - remaining))
            rank += taken
            bins.add(remaining - per_bin * length, first, full)
            bins.add(remaining - rest * length, first + full, int(rest > 0))
            used = full + (rest > 0)
            bins.add(remaining, first + used, count - used)
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "bin", "per_bin", "offset"), table.T, strict=True))


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows with id, piece, start, length (1 .. capacity) and ids_crc32."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_plan(counts, capacity)
    key = (plan["length"] << 44) + plan["rank"]
    buckets = max(64, sum(counts.values()) >> 20)
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own) - 1).join(firsts, ["length", "bucket"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            past = rank - plan["rank"][at]
            sequence = plan["bin"][at] + past // plan["per_bin"][at]
            offset = plan["offset"][at] + past % plan["per_bin"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return pack(materialise(pieces(df, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity).withColumnRenamed("id", id_col)
