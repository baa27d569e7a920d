"""WARC archives of a capture table, and their index by an external merge.

Writing. Of captures with equal payloads of at least `revisit_from` bytes the
one with the largest id is the response; the others become revisits of it. Which
they are is found on (place, id, digest, size) alone; each group of rows (see
common.located) has its revisits in a file, which the pass that writes reads, so
no html is shuffled. Each task writes archive files (one gzip member a record,
about FILE_BYTES of payload each) and, beside each, a run: the records' index
lines sorted by URL key, timestamp and id, in blocks of RUN_BLOCK lines.

Index. While there are more than `fan_in` runs, each `fan_in` of them are merged
into one longer run; what is left is merged into ranges of the whole index. A
merge task has one range of keys of one set of runs: it reads the blocks of each
run that reach into it and merges the runs by a loser tree, one block of a run
in memory at a time. Ranges are cut at quantiles of a bounded sample of the
blocks' first keys (SAMPLE of them, those with the smallest hash; only their
balance depends on it). Ranges in order, and rows in a range, give the capture
histories of the whole archive in global order.

Reading back goes file by file. Files are written under a temporary name and
renamed; a task that runs twice leaves the same files.

Defined results: null html is an empty payload; a null url has an empty URL key;
a null id stays null, its record is a response and goes first among its URL
key's of that time; of rows that repeat the largest id and the payload each is a
response, and each row of the others a revisit; an empty
table gives no files and empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from itertools import islice
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedFiles, bounded_batches, by_bytes, discard, join_hot, located, materialise, new_folder, shuffle_parts

FILE_BYTES = 64 << 20
SLICE_BYTES = 4 << 20
RUN_BLOCK = 256
#: Runs that a merge task reads at a time.
FAN_IN = 256
#: Lines that a task merges into a longer run, about.
RANGE_LINES = 500_000
#: Blocks whose first keys cut the ranges.
SAMPLE = 50_000
_EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host parts reversed, then path and query; without scheme, user, default port, fragment, leading www., and case in the host."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:  # such as a wrong port: the text as it is
        return re.sub(r"\s", "%20", (url or "").strip())
    if not host:
        return re.sub(r"\s", "%20", (url or "").strip())
    host = re.sub(r"^www\d*\.", "", host)
    at = f":{port}" if port and (u.scheme, port) not in (("http", 80), ("https", 443)) else ""
    path = re.sub(r"\s", "%20", (u.path or "/") + (f"?{'&'.join(sorted(u.query.split('&')))}" if u.query else ""))
    return f"{','.join(reversed(host.split('.')))}{at}){path}"


def _when(capture: int | None) -> datetime:
    """Capture time of tables that have none: the id, modulo 10**9, in seconds after 2020; a null id as 0."""
    return _EPOCH + timedelta(seconds=(capture or 0) % 10**9)


def timestamp(capture: int | None) -> str:
    return _when(capture).strftime("%Y%m%d%H%M%S")


def _urn(capture: int | None) -> str:
    return f"<urn:capture:{'' if capture is None else capture}>"


def _line(text: str) -> str:
    """A header value: no line ends."""
    return re.sub(r"[\r\n]+", " ", text)


def record(kind: str, capture: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    when = _when(capture).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": _urn(capture),
        "WARC-Target-URI": _line(url),
        "WARC-Date": when,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(refers_to)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive file, in order; ValueError where it is damaged."""
    at = 0
    while at < len(data):
        member, parts, end = zlib.decompressobj(31), [], at
        while not member.eof and end < len(data):  # by pieces: what a member leaves over is copied
            parts.append(member.decompress(data[end : end + 65536]))
            end = min(len(data), end + 65536)
        if not member.eof:
            raise ValueError("the archive ends inside a record")
        raw, length = b"".join(parts), end - len(member.unused_data) - at
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        found = dict(x.split(": ", 1) for x in lines)
        size = int(found["Content-Length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has another length than it says")
        yield at, length, found, rest[:size]
        at += length


class LoserTree:
    """Merges streams sorted by their items' first part: inner nodes hold the loser of the match below, so the next item takes one match a level."""

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams = streams
        self.size = max(1, len(streams))
        self.heads = [next(s, None) for s in streams] or [None]
        self.losers = [-1] * self.size
        for k in range(self.size):
            self._play(k)

    def _before(self, a: int, b: int) -> bool:
        """Whether stream a's head goes first; a stream at its end goes last, ties by stream."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or y is None and a < b
        return (x[0], a) < (y[0], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.size) >> 1
        while node:
            other = self.losers[node]
            if other < 0:  # first to come here: waits for the other side
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node >>= 1
        self.winner = winner

    def __iter__(self) -> Iterator[tuple]:
        while (item := self.heads[self.winner]) is not None:
            yield item
            self.heads[self.winner] = next(self.streams[self.winner], None)
            self._play(self.winner)


BLOCKS = "file string, run string, piece string, first_key string, last_key string, n_lines long, start long, size long"
INDEX = "range_id long, position long, url_key string, captured string, id long, file string, start long, size long, record_type string, payload_digest string"


def _types(schema: str) -> tuple[list[str], list[pa.DataType]]:
    parts = [x.split() for x in schema.split(", ")]
    return [n for n, _ in parts], [pa.string() if t == "string" else pa.int64() for _, t in parts]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = _types(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _sort_key(line: list) -> str:
    """Text that sorts as (URL key, timestamp, id): parts joined by a byte that sorts first, ids by their order."""
    return f"{line[0]}\x00{line[1]}\x00{'' if line[2] is None else f'{line[2] + (1 << 63):020d}'}"


def write_run(files: SharedFiles, piece: str, run: str, file: str | None, lines: Iterator[list]) -> list[tuple]:
    """Writes sorted lines as blocks of RUN_BLOCK; returns a row of BLOCKS for each."""
    packed, made, begin, lines = [], [], 0, iter(lines)
    while cut := list(islice(lines, RUN_BLOCK)):
        packed.append(zlib.compress(json.dumps(cut).encode(), 3))
        made.append((file, run, piece, _sort_key(cut[0]), _sort_key(cut[-1]), len(cut), begin, len(packed[-1])))
        begin += len(packed[-1])
    if made:
        files.write(piece, packed)
    return made


def _revisits(rows: DataFrame, revisit_from: int) -> str:
    """For rows (group, row, id, html) a file a group of (row, id of the response) of those that are revisits; returns the folder."""
    folder = new_folder(rows.sparkSession, "revisits")
    slim = materialise(rows.select("group", "row", "id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size")), "digests")
    large = slim.filter(F.col("size") >= revisit_from)
    kept = materialise(large.groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("n")).filter("n > 1"), "kept")
    of = join_hot(large.select("group", "row", "id", "digest"), kept, "digest", "n").filter("id < keep")
    lists = of.groupBy("group").agg(F.collect_list(F.struct("row", "keep")).alias("of"))  # at most common.GROUP_ROWS

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, own in zip(batch.column("group").to_pylist(), batch.column("of").to_pylist(), strict=True):
                SharedFiles(folder).write(f"{group}.json", [json.dumps({str(x["row"]): x["keep"] for x in own or ()}).encode()])
            yield batch.select(["group"])

    slim.select("group").distinct().join(lists, "group", "left").mapInArrow(write, "group long").write.format("noop").mode("overwrite").save()
    discard(slim, kept)
    return folder


@lru_cache(maxsize=4)
def _revisits_of(folder: str, group: int) -> dict[str, int]:
    return json.loads(SharedFiles(folder).read(f"{group}.json"))


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000) -> DataFrame:
    """Writes archives and their runs into folder; returns a row for each block of a run."""
    bounded_batches(df.sparkSession)
    found, group, row = located(df, html_col)
    rows = found.select(F.col(group).alias("group"), F.col(row).alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    revisits = _revisits(rows, revisit_from)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, part, number, payload, at = SharedFiles(folder), TaskContext.get().partitionId(), 0, 0, 0
        out: list[bytes] = []
        lines: list[list] = []

        def give() -> pa.RecordBatch:
            files.write(f"{name}.warc.gz", out)
            return _rows(write_run(files, f"{name}.run", f"{name}.run", f"{name}.warc.gz", sorted(lines, key=_sort_key)), BLOCKS)

        for batch in batches:
            for some in by_bytes(batch, "html", SLICE_BYTES):
                for key, place, capture, url, html in zip(*(some.column(c).to_pylist() for c in ("group", "row", "id", "url", "html")), strict=True):
                    name = f"captures-{part:06d}-{number:06d}"
                    keep, data = _revisits_of(revisits, key).get(str(place)), html.encode()
                    kind, digest = "response" if keep is None else "revisit", hashlib.sha1(data).hexdigest()
                    out.append(record(kind, capture, url, data, digest, keep))
                    lines.append([url_key(url), timestamp(capture), capture, f"{name}.warc.gz", at, len(out[-1]), kind, digest])
                    at += len(out[-1])
                    payload += len(data)
                    if payload >= FILE_BYTES:
                        yield give()
                        out, lines, number, payload, at = [], [], number + 1, 0, 0
        if out:
            yield give()

    return materialise(rows.mapInArrow(write, BLOCKS), "warc-runs")


def _borders(runs: DataFrame, many: int) -> list[str]:
    """At most many - 1 keys that cut the lines of runs into ranges of about one size."""
    if many < 2:
        return []
    some = sorted(r["first_key"] for r in runs.select("first_key", "piece", "start").orderBy(F.xxhash64("piece", "start"), "piece", "start").limit(SAMPLE).collect())
    return sorted({some[k * len(some) // many] for k in range(1, many)}) if some else []


def _merged(runs: DataFrame, folder: str, borders: list[str], give, schema: str) -> DataFrame:
    """What give(set, range, lines) makes of the lines of each range of each set of runs (column `set`), which come merged by (URL key, timestamp, id)."""

    def reach(first: pd.Series, last: pd.Series) -> pd.Series:
        """Ranges that hold keys from first to last: range k ends before border k."""
        return pd.Series([list(range(bisect_right(borders, a), bisect_right(borders, b) + 1)) for a, b in zip(first, last, strict=True)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SharedFiles(folder)
        for batch in batches:
            for number, k, found in zip(*(batch.column(c).to_pylist() for c in ("set", "range_id", "blocks")), strict=True):
                low, high = borders[k - 1] if k else "", borders[k] if k < len(borders) else None
                by_run: dict[str, list[tuple[str, int, int]]] = {}
                for b in found:
                    by_run.setdefault(b["run"], []).append((b["first_key"], b["piece"], b["start"], b["size"]))

                def stream(parts: list[tuple], low: str = low, high: str | None = high) -> Iterator[tuple]:
                    for _, piece, start, size in sorted(parts):
                        for line in json.loads(zlib.decompress(files.read(piece, start, size))):
                            if low <= (key := _sort_key(line)) and (high is None or key < high):
                                yield key, line

                yield from give(number, k, (line for _, line in LoserTree([stream(parts) for _, parts in sorted(by_run.items())])))

    dealt = runs.select("set", "run", "piece", "first_key", "start", "size", F.explode(F.pandas_udf(reach, "array<long>")("first_key", "last_key")).alias("range_id"))
    grouped = dealt.groupBy("set", "range_id").agg(F.collect_list(F.struct("run", "piece", "first_key", "start", "size")).alias("blocks"))  # blocks, not lines, of one range
    return grouped.mapInArrow(merge, schema)


def longer_runs(runs: DataFrame, folder: str, fan_in: int) -> DataFrame:
    """Merges each fan_in runs into one; returns the blocks of the new runs."""
    order = Window.orderBy("run")  # a row a run, that is, an archive of FILE_BYTES
    sets = runs.select("run").distinct().withColumn("set", F.floor((F.row_number().over(order) - 1) / fan_in).cast("long"))
    lines, many = runs.agg(F.sum("n_lines"), F.count_distinct("run")).first()
    borders = _borders(runs, -(-lines * fan_in // max(many, fan_in) // RANGE_LINES))
    own = uuid.uuid4().hex[:8]

    def write(number: int, k: int, lines: Iterator[list]) -> Iterator[pa.RecordBatch]:
        made = write_run(SharedFiles(folder), f"merged-{own}-{number:06d}-{k:06d}.run", f"merged-{own}-{number:06d}", None, lines)
        if made:
            yield _rows(made, BLOCKS)

    return materialise(_merged(runs.join(sets, "run"), folder, borders, write, BLOCKS), "warc-runs")


def merge_index(runs: DataFrame, folder: str, lines_per_range: int = 20_000, fan_in: int = FAN_IN) -> DataFrame:
    """The index lines of all runs in global order of URL key, timestamp and id: (range_id, position) orders them.

    There are as many ranges as lines_per_range asks for, but at most four for each shuffle partition.
    """
    first = runs
    while runs.select("run").distinct().count() > fan_in:
        before, runs = runs, longer_runs(runs, folder, fan_in)
        if before is not first:
            discard(before)
    total = runs.agg(F.sum("n_lines")).first()[0] or 0
    borders = _borders(runs, max(1, min(-(-total // lines_per_range), 4 * shuffle_parts(runs.sparkSession))))

    def rows(_: int, k: int, lines: Iterator[list]) -> Iterator[pa.RecordBatch]:
        numbered = ((k, position, *line) for position, line in enumerate(lines))
        while some := list(islice(numbered, 10_000)):
            yield _rows(some, INDEX)

    return _merged(runs.withColumn("set", F.lit(0).cast("long")), folder, borders, rows, INDEX)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, start long"


def read_archives(runs: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the archives, read file by file; the digest of a response is taken anew from its payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SharedFiles(folder)
        number = re.compile(r"<urn:capture:(-?\d*)>")
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                for at, _, head, block in records(files.read(name)):
                    kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name} at {at}: the payload isn't the one written")
                    refers = number.match(head["WARC-Refers-To"]) if kind == "revisit" else None
                    own = number.match(head["WARC-Record-ID"])[1]
                    rows.append((int(own) if own else None, size, digest, kind, int(refers[1]) if refers else None, name, at))
                if rows:
                    yield _rows(rows, RECORDS)

    return runs.select("file").distinct().repartition(shuffle_parts(runs.sparkSession)).mapInArrow(read, RECORDS)


def archive_round_trip(df: DataFrame, **columns: str) -> DataFrame:
    """Writes the archives, merges their index, reads all back: records with their URL key, capture time and place in the whole index, from 0."""
    folder = new_folder(df.sparkSession, "warc")
    runs = write_archives(df, folder, **columns)
    index = materialise(merge_index(runs, folder).select("file", "start", "url_key", "captured", "range_id", "position"), "index")
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)  # a row a range, at most four for each shuffle partition
    ranges = index.groupBy("range_id").agg(F.count("*").alias("n")).select("range_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = index.join(F.broadcast(ranges), "range_id").withColumn("index_place", F.col("first") + F.col("position")).drop("range_id", "position", "first")
    return read_archives(runs, folder).join(placed, ["file", "start"]).drop("file", "start")
