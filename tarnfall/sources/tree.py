"""A folder of source files as a data source: folders are planned as partitions, executors list them.

The planner lists folders only from the top down until there are enough of them to share out, so the driver never holds
the paths of the files. Conditions on extension and size are part of the listing. A partition is a folder with all
that is below it, or the files of a folder whose folders are partitions of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnfall.model import PRUNED_DIRS

FORMAT = "source_tree"
MANIFEST = "rel string, ext string, size long, path string"
ARROW = pa.schema([("rel", pa.string()), ("ext", pa.string()), ("size", pa.int64()), ("path", pa.string())])
ROWS = 4096


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def extension(name: str) -> str:
    """What follows the last dot, in lower case; none where the dot is the name's first character or there is none."""
    return name.rpartition(".")[2].lower() if name.find(".", 1) > 0 else ""


@dataclass
class Folder(InputPartition):
    """A folder by its path relative to the root (empty, or ending in a slash), with or without what is in its folders."""

    rel: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, root: str, spread: int = 256, exts: tuple[str, ...] = (), over: int = -1, up_to: int | None = None):
        self.root, self.spread = root.rstrip("/") or "/", spread
        self.exts, self.over, self.up_to = {e.lower() for e in exts}, over, up_to

    def _listed(self, fs: pafs.FileSystem, base: str, rel: str) -> tuple[list[pafs.FileInfo], list[str]]:
        """Files and folders right in a folder; a folder that is gone or may not be read is empty."""
        try:
            found = fs.get_file_info(pafs.FileSelector(f"{base}/{rel}".rstrip("/") or "/", allow_not_found=True))
        except (PermissionError, NotADirectoryError, FileNotFoundError):
            return [], []
        folders = [f"{rel}{x.base_name}/" for x in found if x.type == pafs.FileType.Directory and x.base_name not in PRUNED_DIRS]
        return [x for x in found if x.type == pafs.FileType.File], folders

    def partitions(self) -> list[Folder]:
        """Folders level by level until there are ``spread`` of them; those above are partitions of their own files."""
        fs, base = opened(self.root)
        if fs.get_file_info(base).type != pafs.FileType.Directory:
            return []
        done, level = [], [""]
        while level and len(level) + len(done) < self.spread:
            below = [self._listed(fs, base, rel)[1] for rel in level]
            done += [Folder(rel, False) for rel in level]
            level = [x for some in below for x in some]
        return done + [Folder(rel, True) for rel in level]

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what the engine reads where nothing was planned
            return
        fs, base = opened(self.root)
        rows, folders = [], [partition.rel]
        while folders:
            rel = folders.pop()
            files, below = self._listed(fs, base, rel)
            folders += below if partition.deep else []
            for x in files:
                ext = extension(x.base_name)
                if (not self.exts or ext in self.exts) and x.size > self.over and (self.up_to is None or x.size <= self.up_to):
                    rows.append({"rel": rel + x.base_name, "ext": ext, "size": x.size, "path": f"{self.root}/{rel}{x.base_name}"})
            while len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows[:ROWS], schema=ARROW)
                rows = rows[ROWS:]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


class SourceTree(DataSource):
    """Options: ``path``, the folder; ``spread``, how many partitions are planned at least if there are so many folders; and
    what is listed at all: ``exts`` (separated by commas), sizes ``over`` and ``up_to``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MANIFEST

    def reader(self, schema) -> TreeReader:
        o = self.options
        exts = tuple(e for e in o.get("exts", "").split(",") if e)
        return TreeReader(o["path"], int(o.get("spread", 256)), exts, int(o.get("over", -1)), int(o["up_to"]) if "up_to" in o else None)


def manifest(spark: SparkSession, root: str, exts: tuple[str, ...] = (), over: int = -1, up_to: int | None = None, spread: int = 256) -> DataFrame:
    """rel, ext, size and path of every file below a folder, build output included; a file as root has none.

    Conditions that are given here are tested while folders are listed. They are options and no pushed filters, as the
    engine keeps the filters that one query has pushed into such a source for later queries of the same DataFrame.
    """
    spark.dataSource.register(SourceTree)
    options = {"spread": spread, "exts": ",".join(exts), "over": over} | ({} if up_to is None else {"up_to": up_to})
    return spark.read.format(FORMAT).options(**options).load(root)


def _opened_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, inner = opened(row["path"])
            try:
                with fs.open_input_stream(inner) as f:
                    content = f.read()
            except (FileNotFoundError, PermissionError, IsADirectoryError):
                continue
            yield pa.RecordBatch.from_pylist([{**row, "content": content}], schema=READ)


READ = pa.schema([("rel", pa.string()), ("ext", pa.string()), ("size", pa.int64()), ("path", pa.string()), ("content", pa.binary())])


def contents(chosen: DataFrame) -> DataFrame:
    """rel, ext, size, path and the bytes of a manifest's rows. Files are dealt out by their paths, so that a folder that holds
    most of them is read by many tasks; those that are gone or may not be read are left out."""
    return chosen.select("rel", "ext", "size", "path").repartition("path").mapInArrow(_opened_files, f"{MANIFEST}, content binary")
