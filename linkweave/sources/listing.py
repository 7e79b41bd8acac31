"""Projects and their files, listed and read by tasks.

The driver knows the root and nothing below it: one task lists the root and passes the project folders on as
rows, others look inside the folders, and others again read the files they found, dealt out one by one, so that a project
with very many files is read by all. Plans have the same size however many projects there are. Empty files
are files like others: an empty change, candidate or fragment means something here.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

FOLDERS = "chain_id bigint, folder string"
LISTED = "chain_id bigint, folder string, inside string"
CONTENTS = "chain_id bigint, inside string, content binary"
_ROWS = 10_000  # of a batch of names
_BYTES = 32 << 20  # of a batch of contents, but for one larger file


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _batches(rows: Iterator[tuple], names: list[str], most: int = _ROWS) -> Iterator[pa.RecordBatch]:
    types = [pa.int64() if n == "chain_id" else pa.string() for n in names]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def listing_tasks(spark: SparkSession) -> int:
    """Tasks of a listing; a number of its own, since adaptive execution would put short names into one task."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def project_folders(spark: SparkSession, root: str) -> DataFrame:
    """``(chain_id, folder)`` for every numbered folder of ``root``; none if there is no such folder."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("root").to_pylist():
                system, base = _open(uri)
                found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
                named = ((i.base_name, f"{uri.rstrip('/')}/{i.base_name}") for i in found if i.type == fs.FileType.Directory)
                rows = ((int(n), f) for n, f in named if n.isascii() and n.isdecimal() and int(n) < 2**63)
                yield from _batches(rows, ["chain_id", "folder"])

    roots = spark.createDataFrame([(root,)], "root string").coalesce(1)
    return roots.mapInArrow(look, FOLDERS).repartition(listing_tasks(spark), "folder")


def project_files(folders: DataFrame, name: str, suffix: str = "", recursive: bool = False) -> DataFrame:
    """``(chain_id, folder, inside)``: the files of ``name`` in each project, or ``name`` itself if it is a file.

    ``inside`` is the path below the project. A name that is all suffix does not have it.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for chain_id, uri in zip(batch.column("chain_id").to_pylist(), batch.column("folder").to_pylist()):
                    system, base = _open(uri)
                    start = f"{base.rstrip('/')}/{name}"
                    found = [system.get_file_info(start)]
                    if found[0].type == fs.FileType.Directory:
                        found = system.get_file_info(fs.FileSelector(start, allow_not_found=True, recursive=recursive))
                    for info in found:
                        has = info.base_name.endswith(suffix) and info.base_name != suffix
                        if info.type == fs.FileType.File and has:
                            yield chain_id, uri, info.path[len(base.rstrip("/")) + 1:]

        yield from _batches(rows(), ["chain_id", "folder", "inside"])

    return folders.mapInArrow(look, LISTED)


def contents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``CONTENTS`` rows of the files that rows of ``chain_id, folder, inside`` name."""
    names, held, size = ["chain_id", "inside", "content"], [], 0
    types = [pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("chain_id", "folder", "inside")]
        for chain_id, uri, inside in zip(*columns):
            system, base = _open(uri)
            with system.open_input_stream(f"{base.rstrip('/')}/{inside}") as data:
                held.append((chain_id, inside, data.readall()))
            size += len(held[-1][2])
            if size >= _BYTES or len(held) == _ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def read_contents(listed: DataFrame) -> DataFrame:
    """``(chain_id, inside, content)`` of listed files; a file that is gone by then ends the job."""
    return listed.repartition(listing_tasks(listed.sparkSession), "folder", "inside").mapInArrow(contents_of, CONTENTS)


def folder_faults(spark: SparkSession, root: str) -> DataFrame:
    """E02 for a project without ``committed``, E38 for one that has a ``current`` folder."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chain_id, uri in zip(batch["chain_id"], batch["folder"]):
                system, base = _open(uri)
                kinds = {i.base_name: i.type for i in system.get_file_info([f"{base}/committed", f"{base}/current"])}
                if kinds["committed"] != fs.FileType.Directory:
                    rows.append((chain_id, "committed", "E02"))
                if kinds["current"] == fs.FileType.Directory:
                    rows.append((chain_id, "current", "E38"))
            yield pd.DataFrame(rows, columns=["chain_id", "filename", "error_code"]).astype({"chain_id": "int64"})

    return project_folders(spark, root).mapInPandas(
        look, "chain_id bigint, filename string, error_code string"
    )


def file_stamps(root: str) -> Iterator[tuple[str, int, int]]:
    """Path, change time in milliseconds and size of the files below ``root``, or of ``root`` if it is one."""
    system, base = _open(root)
    if isinstance(system, fs.LocalFileSystem):
        yield from _local_stamps(base)
        return
    info = system.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    for info in found:
        if info.type == fs.FileType.File:
            yield root.rstrip("/") + info.path[len(base.rstrip("/")):], info.mtime_ns // 1_000_000, info.size


def _local_stamps(base: str) -> Iterator[tuple[str, int, int]]:
    waiting = [base]
    while waiting:
        path = waiting.pop()
        if os.path.islink(path) or not os.path.exists(path):
            continue
        if os.path.isdir(path):
            waiting.extend(entry.path for entry in os.scandir(path))
            continue
        seen = os.stat(path)
        yield path, seen.st_mtime_ns // 1_000_000, seen.st_size


def is_hidden(name: str, folder: bool = False) -> bool:
    """Whether Spark's own file sources pass over a file, or a folder, of this name."""
    passed_over = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return passed_over and not (folder and name.startswith(("_common_metadata", "_metadata")))


def _entries(system: fs.FileSystem, start: str, linked: bool, deep: bool) -> Iterator[tuple]:
    """``path, is_folder, modified_ms, size, linked`` of ``start`` if it is a file, else of what is in it.

    With ``deep`` folders are entered, else named. Links of a local file system are followed and marked.
    """
    if not isinstance(system, fs.LocalFileSystem):
        info = system.get_file_info(start)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(
            fs.FileSelector(start, allow_not_found=True, recursive=deep)
        )
        for info in found:
            if info.type == fs.FileType.File:
                yield info.path, False, info.mtime_ns // 1_000_000, info.size, False
            elif info.type == fs.FileType.Directory and not deep:
                yield info.path, True, None, None, False
        return
    waiting = [(start, linked)]
    while waiting:
        path, linked = waiting.pop()
        linked = linked or os.path.islink(path)
        if not os.path.exists(path):
            continue
        if not os.path.isdir(path):
            seen = os.stat(path)
            yield path, False, seen.st_mtime_ns // 1_000_000, seen.st_size, linked
        elif deep or path == start:
            waiting.extend((entry.path, linked) for entry in os.scandir(path))
        else:
            yield path, True, None, None, linked


_TOPS = {
    "root": pa.string(), "first": pa.bool_(), "path": pa.string(), "is_folder": pa.bool_(),
    "modified_ms": pa.int64(), "size": pa.int64(), "linked": pa.bool_(), "hidden": pa.bool_(),
}
_TOPS_DDL = (
    "root string, first boolean, path string, is_folder boolean, modified_ms bigint, size bigint, linked boolean, hidden boolean"
)


def _top_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, _ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _TOPS.values())], names=list(_TOPS))


def tops_of_roots(roots: DataFrame) -> DataFrame:
    """What is right in each ``root``, which a table names with a column ``first``: files with their stamps, and folders.

    ``linked`` says that a link leads there, ``hidden`` that Spark's file sources pass it over.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for root, first in zip(batch.column("root").to_pylist(), batch.column("first").to_pylist()):
                    system, base = _open(root)
                    for path, *rest in _entries(system, base, False, False):
                        yield root, first, path, *rest, is_hidden(path.rpartition("/")[2], folder=rest[0])

        return _top_batches(rows())

    return roots.select("root", "first").repartition(listing_tasks(roots.sparkSession), "root").mapInArrow(look, _TOPS_DDL)


def stamps_below(tops: DataFrame) -> DataFrame:
    """``path, modified_ms, size, first, linked, hidden`` of the files of ``tops_of_roots`` and of those below its folders.

    The folders are dealt out one by one, so the files of one root are listed by many tasks.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = lru_cache(_open)

        def named(root: str, path: str) -> str:
            """As ``file_stamps`` has it: with the scheme of ``root``, but for local files."""
            system, base = opened(root)
            return path if isinstance(system, fs.LocalFileSystem) else root.rstrip("/") + path[len(base.rstrip("/")):]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for top in batch.to_pylist():
                    root, first, start = top["root"], top["first"], top["path"]
                    if not top["is_folder"]:
                        yield root, first, named(root, start), *list(top.values())[3:]
                        continue
                    for path, *rest in _entries(opened(root)[0], start, top["linked"], True):
                        *folders, name = path[len(start) + 1:].split("/")
                        hidden = top["hidden"] or is_hidden(name) or any(is_hidden(f, folder=True) for f in folders)
                        yield root, first, named(root, path), *rest, hidden

        return _top_batches(rows())

    found = tops.repartition(listing_tasks(tops.sparkSession), "root", "path").mapInArrow(look, _TOPS_DDL)
    return found.select("path", "modified_ms", "size", "first", "linked", "hidden")


def stamps_of_roots(roots: DataFrame) -> DataFrame:
    """``(path, modified_ms, size)`` of the files below each ``root``, which a table names; links are not followed."""
    named = roots.select("root").where("root is not null").distinct().selectExpr("root", "true AS first")
    return stamps_below(tops_of_roots(named)).where("not linked").select("path", "modified_ms", "size")
