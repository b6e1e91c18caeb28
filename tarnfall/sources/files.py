"""Source files as DataFrames: a manifest of metadata first, contents of the chosen files later.

Spark's file sources leave out names that begin with a dot or an underscore, whatever path they are given, and list through
the driver. So the manifest is a data source of its own (:mod:`tree`), whose folders executors list, and executors open
the chosen files. Folders that are never read are not even listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfall.functions.paths import in_build_output
from tarnfall.model import BUILD_DIRS
from tarnfall.sources.tree import contents, manifest

__all__ = ["manifest", "source_files", "oversized_build_files", "read_contents", "lines", "line_of"]
FILES = "rel string, ext string, size long, content string"
MAX_BYTES = 2 << 20
CODE = ("ts", "tsx", "js", "jsx", "mjs", "cjs")


def source_files(found: DataFrame, exts: tuple[str, ...] = (), include_built: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of a manifest that analyzers read: by extension (none given: all), size, and outside of build output."""
    rows = found.where(F.col("size") <= max_bytes)
    if exts:
        rows = rows.where(F.col("ext").isin(*(e.lower() for e in exts)))
    return rows if include_built else rows.where(~_below_build("rel"))


def oversized_build_files(found: DataFrame, min_bytes: int, max_bytes: int, exts: tuple[str, ...] = ()) -> DataFrame:
    """Metadata of files in build output that :func:`source_files` leaves out as too large."""
    rows = found.where((F.col("size") > min_bytes) & (F.col("size") <= max_bytes) & in_build_output(F.col("rel")))
    return rows.where(F.col("ext").isin(*(e.lower() for e in exts))) if exts else rows


def _below_build(rel: str) -> Column:
    """A folder of the path, not the file's own name, is build output."""
    return F.arrays_overlap(F.slice(F.split(rel, "/"), 1, F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0))), F.array(*map(F.lit, BUILD_DIRS)))


def read_contents(chosen: DataFrame) -> DataFrame:
    """rel, ext, size, content of a manifest's rows; bytes that are no UTF-8 become replacement characters. Files that vanish
    meanwhile or may not be read are left out."""
    return contents(chosen).select("rel", "ext", "size", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def lines(files: DataFrame) -> DataFrame:
    """file, line_no (from 1) and line of every line of the contents."""
    each = files.select(F.col("rel").alias("file"), F.posexplode(F.split("content", r"\r?\n")).alias("at", "line"))
    return each.select("file", (F.col("at") + 1).alias("line_no"), "line")


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of an offset from 0: line feeds before it, plus one."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
