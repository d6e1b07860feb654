"""Source trees as file tables."""

from __future__ import annotations

import os
import tarfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayweft.functions.strings import suffix
from wayweft.operators.sections import DOC_SUFFIXES
from wayweft.session import materialise
from wayweft.sources.scan import IGNORED, OPEN_HIDDEN, is_pruned, within_limit

READ_BATCH = 32
#: Entries that a task lists before it hands folders back to be dealt out anew.
LISTED_AT_ONCE = 10_000
ARCHIVE_COLUMNS = ["archive", "path", "size", "content"]


class Folders:
    """Entries and contents below a root: a local path, or a URI that Arrow's file systems open (hdfs, s3, gs)."""

    def __init__(self, root: str):
        self.local = "://" not in root or root.startswith("file://")
        if self.local:
            self.base = str(Path(root.removeprefix("file://")).resolve())
        else:
            self.system, self.base = pyarrow.fs.FileSystem.from_uri(root)

    def is_folder(self) -> bool:
        if self.local:
            return os.path.isdir(self.base)
        return self.system.get_file_info(self.base).type == pyarrow.fs.FileType.Directory

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int, int]]:
        """(name, is folder, size, time of the last change in ns); links to folders are not followed, what cannot be read is left out."""
        if not self.local:
            for e in self.system.get_file_info(pyarrow.fs.FileSelector(f"{self.base}/{folder}".rstrip("/"), allow_not_found=True)):
                yield e.base_name, e.type == pyarrow.fs.FileType.Directory, e.size or 0, e.mtime_ns or 0
            return
        try:
            with os.scandir(os.path.join(self.base, folder)) as found:
                for e in found:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            yield e.name, True, 0, 0
                        elif e.is_file():
                            yield e.name, False, e.stat().st_size, e.stat().st_mtime_ns
                    except OSError:
                        continue
        except OSError:
            return

    def content(self, path: str) -> bytes | None:
        try:
            if self.local:
                return Path(self.base, path).read_bytes()
            with self.system.open_input_file(f"{self.base}/{path}") as stream:
                return stream.read()
        except OSError:
            return None


def _skipped(name: str, include_hidden: bool) -> bool:
    return name in IGNORED or (not include_hidden and name.startswith(".") and name != OPEN_HIDDEN)


def _listing(root: str, include_hidden: bool):
    """Walk below each given folder until ``LISTED_AT_ONCE`` entries were met; folders not entered are handed back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = Folders(root)
        met, rows = 0, []
        for batch in batches:
            stack = batch.column("path").to_pylist()
            while stack:
                folder = stack.pop()
                if met >= LISTED_AT_ONCE:
                    rows.append((folder, None, None))
                    continue
                for name, is_folder, size, changed in folders.entries(folder):
                    met += 1
                    if _skipped(name, include_hidden):
                        continue
                    path = f"{folder}/{name}" if folder else name
                    if is_folder:
                        stack.append(path)
                    else:
                        rows.append((path, size, changed))
                    if len(rows) >= 4096:
                        yield _rows(rows)
                        rows = []
            if rows:
                yield _rows(rows)
                rows = []

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["path", "size", "changed"])


def list_files(spark: SparkSession, root: str, include_hidden: bool = False) -> DataFrame:
    """``path, size, changed`` of all files below a folder that every executor can open, without ignored and hidden names.

    The folders to enter are rows. Each task walks on below its own until it has met
    ``LISTED_AT_ONCE`` entries and hands back those it has not entered, which are dealt out anew; so a
    small tree takes one step, a large one is listed by all tasks, and no list is held by the driver.
    """
    if not Folders(root).is_folder():
        raise ValueError(f"invalid repository path: {root}")
    cores = spark.sparkContext.defaultParallelism
    open_, parts = spark.createDataFrame([("",)], "path string"), []
    while True:
        level = materialise(open_.mapInArrow(_listing(root, include_hidden), "path string, size long, changed long"))
        parts.append(level.where("size IS NOT NULL"))
        open_ = level.where("size IS NULL").select("path")
        waiting = open_.count()
        if not waiting:
            break
        open_ = open_.repartition(min(waiting, cores * 4))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tree_stamp(listing: DataFrame) -> str:
    """One value for the names, sizes and times of a listing, whatever its order."""
    row = F.xxhash64("path", "size", "changed")
    found = listing.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(2**31 - 1))).alias("s")).first()
    return f"{found.n}-{found.x or 0}-{found.s or 0}"


def files_from_tree(
    spark: SparkSession, root: str, include_hidden: bool = False, max_files: int | None = None, max_bytes: int | None = None, listing: DataFrame | None = None
) -> DataFrame:
    """``path, size, text, sha256`` of a tree that all executors can open, listed and read by the tasks.

    ``max_files`` takes one more than that in path order, so that a limit can be seen to be hit. With
    ``max_bytes``, larger files keep a null text unless they are documents; a file that vanishes keeps
    nulls. A ``listing`` made before saves making it again.
    """
    names = list_files(spark, root, include_hidden) if listing is None else listing
    names = names.select("path", "size")
    if max_files is not None:
        names = within_limit(names, max_files + 1)
    cores = spark.sparkContext.defaultParallelism
    wide = F.ceil(F.count("*") / 64).cast("int").alias("n")
    spread = names.repartition(max(1, min(names.agg(wide).first().n, cores * 4)), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = Folders(root)
        for batch in batches:
            for start in range(0, batch.num_rows, READ_BATCH):
                some = batch.slice(start, READ_BATCH)
                yield some.append_column("content", pa.array([folders.content(p) for p in some.column("path").to_pylist()], pa.binary()))

    loaded = spread.mapInArrow(read, "path string, size long, content binary")
    return with_text(loaded, max_bytes)


def with_text(files: DataFrame, max_bytes: int | None = None, *keep: str) -> DataFrame:
    """``<keep>, path, size, text, sha256`` from binary contents; bytes that are no UTF-8 become U+FFFD."""
    small = F.lit(True) if max_bytes is None else F.col("size") <= max_bytes
    wanted = small | suffix(F.col("path")).isin(*DOC_SUFFIXES)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    digest = F.coalesce(F.sha2("content", 256), F.lit("unreadable"))
    return files.select(*keep, "path", "size", F.when(wanted, text).alias("text"), digest.alias("sha256"))


def files_from_archives(
    spark: SparkSession, paths: list[str], include_hidden: bool = False, max_bytes: int | None = None
) -> DataFrame:
    """``archive, path, size, text, sha256`` of tar archives, without their common top folder.

    One task reads one archive member by member; entries outside the first top folder are ignored,
    as are links and paths that climb out.
    """
    names = spark.createDataFrame([(p,) for p in paths], "archive string").repartition(max(1, len(paths)), "archive")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive in batch["archive"]:
                with tarfile.open(archive, "r:*") as tar:
                    top, rows = None, []
                    for member in tar:
                        head, _, rest = member.name.partition("/")
                        top = top or head
                        if head != top or not rest or not member.isfile() or ".." in rest.split("/"):
                            continue
                        rows.append((archive, rest, member.size, tar.extractfile(member).read()))
                        if len(rows) == READ_BATCH:
                            yield pd.DataFrame(rows, columns=ARCHIVE_COLUMNS)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=ARCHIVE_COLUMNS)

    loaded = names.mapInPandas(read, "archive string, path string, size bigint, content binary")
    return with_text(loaded.filter(~is_pruned(F.col("path"), include_hidden)), max_bytes, "archive")
