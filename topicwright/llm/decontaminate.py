"""Benchmark decontamination by the q-gram lemma over diagonal bands, verified by banded alignment.

Texts are compared in lower case with each run of white space as one space.
Windows are laid over each benchmark item: of WINDOW characters every STEP, of
QUOTE characters every so many as their edit budget allows (so that a verbatim
quotation of QUOTE characters is found at any place of an item), and the whole
item if it is short; the last one of each kind ends with the item. A window of
m characters that lies in a document with at most k = floor(rate * m) edits
shares at least m + 1 - Q * (k + 1) of its Q-grams with it, on diagonals (place
in the document less place in the item) that span at most k + 1. So shared
Q-grams are counted in overlapping bands of diagonals, each of which holds any
such span whole: first for whole items, which leaves few, then, in those, for
each window. Regions that reach a window's bound are retained, and a region
counts if a banded alignment finds the window in it within k edits. Items under
EXACT characters have no edits: they count where they stand as they are.

The index holds each place of an item once. It lies in the shared folder in
blocks of BLOCK_CHARS benchmark characters; a task reads one block at a time and
takes a whole Arrow batch of texts through it: the benchmark may grow without
anything being broadcast. Documents are scanned whole, where they lie, without a
shuffle.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedFiles, begin, bounded_batches, by_bytes, keeps, new_folder, ragged

Q = 8
WINDOW = 128
STEP = 64
#: A verbatim quotation of so many characters is found wherever it begins.
QUOTE = 60
#: Fewest shared Q-grams that the bound of a window with edits asks for.
LEAST = 8
#: Items under this length must stand in a text as they are.
EXACT = 32
BLOCK_CHARS = 1 << 20
SLICE_BYTES = 1 << 18
#: Shared Q-grams that are counted at a time.
HITS = 1 << 17
_GAP = 0xFFFFFFFF
_TABLE_BITS = 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(texts: list[str], marks: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all texts, and after each text so many marks that no Q-gram and no alignment within its budget crosses; where each starts)."""
    gap = np.full(marks, _GAP, np.uint32)
    parts, starts, at = [], [], 0
    for t in texts:
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += [c, gap]
        starts.append(at)
        at += len(c) + marks
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), np.array(starts, np.int64)


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 8 characters from each place on; by doubling."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    h, base, width = codes.astype(np.uint64) + np.uint64(0x9E3779B9), 0x9E3779B97F4A7C15, 1
    while width < Q:
        h = h[:-width] * np.uint64(base) + h[width:]
        h ^= h >> np.uint64(29)
        base = (base * base + 2 * width) & 0xFFFFFFFFFFFFFFFF
        width *= 2
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _TABLE_BITS)


def windows(length: int, rate: float) -> list[tuple[int, int, int]]:
    """(start, size, edits) of the windows over an item of so many characters."""

    def edits(size: int) -> int:
        return 0 if length < EXACT else max(0, min(int(size * rate), (size + 1 - LEAST) // Q - 1))

    out = set()
    for width, step in ((WINDOW, STEP), (QUOTE, max(1, edits(QUOTE)))):
        if width == QUOTE and length < QUOTE:
            continue
        if length < width + step and width == WINDOW:
            out.add((0, length, edits(length)))
        else:
            out |= {(at, width, edits(width)) for at in (*range(0, length - width + 1, step), length - width)}
    return sorted(out)


@dataclass
class Index:
    """A block of items: their characters one after another, the Q-grams there by hash, and the windows of each item."""

    items: np.ndarray  # id of each item
    codes: np.ndarray  # characters of all items
    hashes: np.ndarray  # ascending, distinct
    first: np.ndarray  # places of hashes[i] are places[first[i] : first[i + 1]]
    places: np.ndarray  # in codes
    item: np.ndarray  # number of the item that holds each of these places
    own: np.ndarray  # windows of item i are own[i] .. own[i + 1] - 1
    start: np.ndarray  # of each window, in codes
    size: np.ndarray
    edits: np.ndarray

    def __post_init__(self) -> None:
        self.there = np.zeros(1 << _TABLE_BITS, bool)
        self.there[_slot(self.hashes)] = True
        self.bound = self.size + 1 - Q * (self.edits + 1)
        self.least = np.minimum.reduceat(self.bound, self.own[:-1]) if len(self.items) else self.bound
        # bands of twice `stride` diagonals begin every `stride`, which is more than any budget
        self.stride = int(self.edits.max(initial=0)) + 1

    @classmethod
    def of(cls, items: list[tuple[int, str]], rate: float) -> Index:
        """Of the items of at least Q characters."""
        texts = [(k, t) for k, t in ((k, normal(t)) for k, t in dict.fromkeys(items)) if len(t) >= Q]
        codes, hashes, places, number, cut, own, at = [], [], [], [], [], [0], 0
        for n, (_, t) in enumerate(texts):
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            g = _grams(c)
            codes.append(c)
            hashes.append(g)
            places.append(np.arange(at, at + len(g)))
            number.append(np.full(len(g), n))
            cut += [(at + s, size, e) for s, size, e in windows(len(c), rate)]
            own.append(len(cut))
            at += len(c)
        codes, h, place, item = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((codes, np.uint32), (hashes, np.uint64), (places, np.int64), (number, np.int64)))
        order = np.argsort(h, kind="stable")
        distinct, first = np.unique(h[order], return_index=True)
        start, size, edits = np.array(cut, np.int64).reshape(-1, 3).T
        return cls(np.array([k for k, _ in texts], np.int64), codes, distinct, np.append(first, len(h)), place[order], item[order], np.array(own), start, size, edits)

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        with np.load(io.BytesIO(data)) as f:
            return cls(**dict(f))


def _least_edits(windows: np.ndarray, size: np.ndarray, texts: np.ndarray, width: int) -> np.ndarray:
    """Least edits of each window in its text where its place i lies at text places i + 0 .. width-1 (a band); a column of windows and texts holds the characters of each."""
    n, cells = windows.shape[1], np.arange(width, dtype=np.int16)[:, None]
    row = np.zeros((width, n), np.int16)  # an alignment may begin anywhere in the band
    down = np.full((width, n), 1 << 14, np.int16)
    steps = [1 << k for k in range((width - 1).bit_length())]
    best = np.zeros(n, np.int64)
    for i in range(int(size.max())):
        np.add(row[1:], 1, out=down[:-1])  # a window character without a partner
        row = np.minimum(row + (texts[i : i + width] != windows[i]), down) - cells
        for step in steps:  # text characters without a partner: the least so far, over twice as many cells each time
            row[step:] = np.minimum(row[step:], row[:-step])
        row += cells
        ended = size == i + 1
        if ended.any():
            best[ended] = row[:, ended].min(axis=0)
    return best


def _hits(index: Index, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in the texts, place in the items, item) of the Q-grams at these places that both have, about HITS at a time: text that repeats itself may hit very often."""
    at = at[index.there[_slot(h[at])]]
    found = np.searchsorted(index.hashes, h[at])
    found[found == len(index.hashes)] = 0
    right = index.hashes[found] == h[at]
    at, found = at[right], found[right]
    many = index.first[found + 1] - index.first[found]
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(many) // HITS)) + 1).tolist(), len(many)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        post = ragged(index.first[found[a:b]], many[a:b])
        yield np.repeat(at[a:b], many[a:b]), index.places[post], index.item[post]


def regions(index: Index, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, first place of the band in the normalised text, edits) of every verified region."""
    none = np.empty(0, np.int64)
    if not len(index.hashes) or not texts:
        return none, none, none, none
    stride, many = index.stride, len(index.items)
    codes, starts = _codes(texts, max(Q, stride))
    h = _grams(codes)
    shift = len(index.codes)
    # keeps bands from going below 0
    offset = shift // stride + 2

    def keys(place: np.ndarray, other: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The number of (text, band, item) of each hit's upper band; its lower one is `many` less."""
        band = (place - other) // stride + offset
        text = np.searchsorted(starts, place, "right") - 1
        return (text * (len(codes) // stride + offset + 2) + band) * many + item

    counted: tuple[np.ndarray, np.ndarray] | None = None
    for place, other, item in _hits(index, h, np.arange(len(h))):
        key = keys(place, other, item)
        some, n = np.unique(np.concatenate([key, key - many]), return_counts=True)
        if counted is not None:
            some, back = np.unique(np.concatenate([counted[0], some]), return_inverse=True)
            n = np.bincount(back, np.concatenate([counted[1], n]), len(some)).astype(np.int64)
        counted = some, n
    if counted is None:
        return none, none, none, none
    kept = counted[0][counted[1] >= index.least[counted[0] % many]]
    if not len(kept):
        return none, none, none, none

    # the hits of the groups that are left, group by group, by place in the items
    group, inside = [], []
    some = np.unique(kept // many // (len(codes) // stride + offset + 2))
    stops = np.append(starts[1:], len(h))
    for place, other, item in _hits(index, h, ragged(starts[some], np.minimum(stops, len(h))[some] - starts[some])):
        key = keys(place, other, item)
        for k in (key, key - many):
            at = np.searchsorted(kept, k)
            at[at == len(kept)] = 0
            own = kept[at] == k
            group.append(at[own])
            inside.append(other[own])
    group, inside = np.concatenate(group), np.concatenate(inside)
    line = np.sort(group * shift + inside)
    item = kept % many
    per = index.own[item + 1] - index.own[item]
    window, which = ragged(index.own[item], per), np.repeat(np.arange(len(kept)), per)
    low = which * shift + index.start[window]
    count = np.searchsorted(line, low + index.size[window] - Q, "right") - np.searchsorted(line, low, "left")
    good = count >= index.bound[window]
    window, which = window[good], which[good]
    if not len(window):
        return none, none, none, none

    row = kept[which] // many
    text, band = row // (len(codes) // stride + offset + 2), row % (len(codes) // stride + offset + 2)
    low = (band - offset) * stride + index.start[window]  # where the window's first character lies at the earliest
    order = np.argsort(index.size[window], kind="stable")
    text, window, low = text[order], window[order], low[order]
    width, longest = 2 * stride, int(index.size.max())
    edits = np.empty(len(window), np.int64)
    lead = shift + 2 * width
    padded = np.concatenate([np.full(lead, _GAP, np.uint32), codes, np.full(longest + 2 * width, _GAP, np.uint32)])
    for a in range(0, len(window), 4096):
        some = slice(a, a + 4096)
        size = index.size[window[some]]
        wide = int(size.max())
        last = len(index.codes) - 1
        chars = padded[np.clip((low[some] + lead) + np.arange(wide + width)[:, None], 0, len(padded) - 1)]
        edits[some] = _least_edits(index.codes[np.minimum(index.start[window[some]] + np.arange(wide)[:, None], last)], size, chars, width)
    good = edits <= index.edits[window]
    return text[good], window[good], (low - starts[text])[good], edits[good]


@lru_cache(maxsize=2)
def _loaded(folder: str, name: str) -> Index:
    return Index.load(SharedFiles(folder).read(name))


keeps("decontaminate", _loaded.cache_clear)


def write_index(benchmark: DataFrame, rate: float, item_col: str = "item_id", text_col: str = "text") -> tuple[str, list[str]]:
    """Writes the index in blocks of about BLOCK_CHARS characters to the shared folder; returns it and the names of their files."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(1, -(-total // BLOCK_CHARS))
    folder = new_folder(benchmark.sparkSession, "benchmark")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, some in zip(batch.column("block").to_pylist(), batch.column("some").to_pylist(), strict=True):
                name = f"block-{block:06d}.npz"
                SharedFiles(folder).write(name, [Index.of(sorted((x["item"], x["text"]) for x in some), rate).save()])
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    blocks = items.groupBy(F.pmod(F.xxhash64("item", "text"), F.lit(many)).alias("block")).agg(F.collect_list(F.struct("item", "text")).alias("some"))  # about BLOCK_CHARS each, as items are distinct
    return folder, sorted(r["name"] for r in blocks.mapInArrow(write, "name string").collect())


def _scan(rows: DataFrame, benchmark: DataFrame, rate: float, column: str, schema, give) -> DataFrame:
    """Rows that give(batch, items, windows, fewest) makes of each batch of rows with what was found in its texts."""
    bounded_batches(rows.sparkSession)
    folder, names = write_index(benchmark, rate)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("decontaminate")
        for batch in batches:
            items: list[set[int]] = [set() for _ in range(len(batch))]
            windows: list[set[tuple[str, int]]] = [set() for _ in range(len(batch))]
            fewest: list[int | None] = [None] * len(batch)
            for name in names:
                index, before = _loaded(folder, name), 0
                for some in by_bytes(batch, column, SLICE_BYTES):
                    text, window, _, edits = regions(index, [normal(t) for t in some.column(column).to_pylist()])
                    which = np.searchsorted(index.own, window, "right") - 1
                    for t, w, i, e in zip((text + before).tolist(), window.tolist(), index.items[which].tolist(), edits.tolist(), strict=True):
                        items[t].add(i)
                        windows[t].add((name, w))
                        fewest[t] = e if fewest[t] is None else min(e, fewest[t])
                    before += len(some)
            yield give(batch, items, windows, fewest)

    return rows.mapInArrow(scan, schema)


def contamination(df: DataFrame, benchmark: DataFrame, rate: float = 0.08, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, contaminated, items, n_windows, fewest_edits) of each row.

    items: ids of the benchmark items found, ascending; n_windows: distinct
    windows found, of all kinds; fewest_edits: least edits of these, null if
    none. Null and empty texts hold nothing; repeated rows are tested each; items
    with a null id or text, or of fewer than Q characters (which have no Q-gram),
    are left out; items of fewer than EXACT characters count where they stand as
    they are; repeated items count once; an empty benchmark finds nothing.
    """

    def give(some, items, windows, fewest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([some.column("id"), pa.array([bool(x) for x in items], pa.bool_()), pa.array([sorted(x) for x in items], pa.list_(pa.int64())), pa.array(list(map(len, windows)), pa.int64()), pa.array(fewest, pa.int64())], ["id", "contaminated", "items", "n_windows", "fewest_edits"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, contaminated boolean, items array<long>, n_windows long, fewest_edits long"
    return _scan(rows, benchmark, rate, "text", schema, give).withColumnRenamed("id", id_col)


def clean_rows(df: DataFrame, benchmark: DataFrame, rate: float = 0.08, text_col: str = "text") -> DataFrame:
    """The rows of df in which nothing of the benchmark is found, with all columns; cases as in contamination()."""

    def give(some, items, windows, fewest) -> pa.RecordBatch:
        return some.filter(pa.array([not x for x in items], pa.bool_()))

    return _scan(df, benchmark, rate, text_col, df.schema, give)
