"""What the operators share: the cluster's shared folder, tables cut off from their lineage, slices balanced by bytes."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file in a group, for texts of up to SHORT bytes; a sixteenth for each sixteenfold size.
GROUP_ROWS = 1 << 15
SHORT = 1 << 15
#: A key that has more than one of so many rows is joined by broadcast; so there are fewer such keys than this.
HOT = 1000
#: Folders of the tables that materialise() has made.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent on one machine (tests) a temporary folder is made
    once per session and set as the checkpoint folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='topicwright-')}")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder of its own in the shared folder; it goes when the driver ends."""
    uri = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, uri)
    return uri


def _delete(spark: SparkSession, uri: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have ended before; then the cluster's own cleaning applies
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: later plans survive lost executors and don't compute it twice."""
    spark = df.sparkSession
    uri = new_folder(spark, name)
    df.write.parquet(uri)
    made = spark.read.schema(df.schema).parquet(uri)
    _FOLDERS[made] = uri
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of materialised tables that no later plan reads."""
    for t in tables:
        if uri := _FOLDERS.pop(t, None):
            _delete(t.sparkSession, uri)


def free_names(wanted: tuple[str, ...], taken: list[str]) -> list[str]:
    """Column names like the wanted ones that no column has, whatever its case."""
    low = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is files as they are read, but for filters and columns that always come out the same."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation"


def located(df: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    """df, or a copy of it in the shared folder, with two columns more, and their names: a row's group and its place in its file.

    A group is rows of one file that stand in one block of GROUP_ROWS rows and
    are of one size class (longer texts go in smaller blocks, so a group holds at
    most GROUP_ROWS * SHORT bytes of text or a single text). It is what the rows
    say of themselves, whatever splits they are read in. A table that is no plain
    scan of Parquet files is written to the shared folder first.
    """
    try:
        source = df if _plain_scan(df) and df.select(df.metadataColumn("_metadata")["row_index"]).columns else None
    except AnalysisException:  # files of another kind
        source = None
    if source is None:
        source = materialise(df, "documents")
    group, row = free_names(("group", "row"), df.columns)
    at = source.metadataColumn("_metadata")
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0))
    shift, rows = F.lit(0), F.lit(GROUP_ROWS).cast("long")
    for k in range(1, 5):
        longer = size > SHORT << 4 * (k - 1)
        shift, rows = F.when(longer, k).otherwise(shift), F.when(longer, max(1, GROUP_ROWS >> 4 * k)).otherwise(rows)
    block = F.floor(at["row_index"] / rows).cast("long")
    return source.withColumns({group: F.xxhash64(at["file_path"], block, shift), row: at["row_index"]}), group, row


def join_hot(many: DataFrame, one: DataFrame, key: str, count: str) -> DataFrame:
    """many joined to one, whose column `count` has the rows of many with its key: keys of more than a share of 1 / HOT, fewer than HOT, by broadcast, all others by shuffle."""
    total = many.count()
    hot = one.filter(F.col(count) * HOT > total).drop(count)  # fewer than HOT rows
    rest = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.filter(F.col(count) * HOT <= total).drop(count), key)
    return many.join(F.broadcast(hot), key).unionByName(rest)


class SharedFiles:
    """Plain files in a shared folder, for use inside tasks; file: by the mount, other schemes by pyarrow's file systems."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        parsed = urlparse(self.uri)
        self.local = unquote(parsed.path) if parsed.scheme in ("", "file") else None

    def _remote(self, name: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.uri}/{name}")

    def write(self, name: str, parts: list[bytes]) -> None:
        """Write under another name first and rename: a task that runs twice leaves one whole file."""
        out = self.stream(name)
        for x in parts:
            out.write(x)
        out.close()

    def stream(self, name: str) -> Stream:
        return Stream(self, name)

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        if self.local is not None:
            with open(f"{self.local}/{name}", "rb") as f:
                f.seek(start)
                return f.read() if length is None else f.read(length)
        files, path = self._remote(name)
        with files.open_input_file(path) as f:
            f.seek(start)
            return f.read() if length is None else f.read(length)


class Stream:
    """A file that is written piece by piece, and has its name only once it is closed."""

    def __init__(self, files: SharedFiles, name: str):
        self.size, self.files, self.name, self.own = 0, files, name, f".{name}.{uuid.uuid4().hex}"
        if files.local is not None:
            os.makedirs(files.local, exist_ok=True)
            self.out = open(f"{files.local}/{self.own}", "wb")  # noqa: SIM115
        else:
            self.fs, self.path = files._remote(self.own)
            self.fs.create_dir(os.path.dirname(self.path), recursive=True)
            self.out = self.fs.open_output_stream(self.path)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        if self.files.local is not None:
            os.replace(f"{self.files.local}/{self.own}", f"{self.files.local}/{self.name}")
        else:
            self.fs.move(self.path, f"{os.path.dirname(self.path)}/{self.name}")


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds the bytes of the Arrow batches that tasks exchange with Python, unless the session sets its own: long texts would fill a batch of 10,000 rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.isModifiable(name) or spark._jsparkSession.sessionState().conf().contains(name):
        return
    spark.conf.set(name, size)


#: What operators keep in a worker between tasks: by operator, how to drop it.
_KEPT: dict[str, Callable[[], None]] = {}
_now: list[str] = [""]


def keeps(operator: str, drop: Callable[[], None]) -> None:
    _KEPT[operator] = drop


def begin(operator: str) -> None:
    """At the start of a task: a worker that goes from one operator to another drops what the others kept."""
    if _now[0] != operator:
        _now[0] = operator
        for other, drop in _KEPT.items():
            if other != operator:
                drop()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on, and its peaks would stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def by_bytes(batch: pa.RecordBatch, column: str, target: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows of about `target` bytes in `column`, and at most `rows`; a longer row is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    at, n = 0, len(sizes)
    while at < n:
        end = int(np.searchsorted(before, before[at] + target, "right")) - 1
        end = max(at + 1, min(end, n, at + rows))
        yield batch.slice(at, end - at)
        at = end
    give_back()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+lengths[i]-1 of all i, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def table_parts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
