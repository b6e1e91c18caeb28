"""Token counts from flat token files by a separator scan.

A token file is a bare sequence of little-endian identifiers, each document followed by an end-of-document identifier;
there is no index, and documents straddle any block. Every block of a file is read by its byte range and searched for
separators with arrays; a running maximum over a file's blocks (a prefix scan of one small row per block) carries the
place of the last separator before each block, which completes the documents that cross block boundaries.

Defined results: a document without tokens has count 0. Tokens after a file's last separator form one open document
(``closed`` false); an empty file has no documents. Null texts are empty documents. Repeated rows and null ids are
documents like any other. Ids have 16 bits: a vocabulary with larger ones is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfall.llm.shared import bound_batches, filesystem, saved, shared_dir, write_file
from tarnfall.llm.word_bpe import loaded, read_tokenizer, some_rows

DTYPE = np.dtype("<u2")


def stored(ids: np.ndarray) -> np.ndarray:
    """The ids as a file holds them; ids that do not fit are an error."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) <= np.iinfo(DTYPE).max:
        raise ValueError(f"token ids beyond {np.iinfo(DTYPE).max} do not fit into a token file")
    return ids.astype(DTYPE)


def write_token_files(docs: DataFrame, path: str, folder: str, separator: int) -> DataFrame:
    """Encodes the texts of each partition into one flat file below ``folder``.

    Returns file, bytes and doc_ids (in file order), a few rows per file of up to 100,000 ids each (``part`` counts them).
    The file has a name of its own in each attempt, so a task that runs twice does no harm; only files named in the
    returned rows belong to the data set, which the caller saves before reading.
    """
    bound_batches(docs.sparkSession)
    stored(np.array([separator]))
    source = read_tokenizer(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, ids = loaded(source.value, False), []
        uri = f"{folder}/tokens-{uuid.uuid4().hex}.bin"

        def chunks() -> Iterator[bytes]:
            for part in chain.from_iterable(map(some_rows, batches)):
                tokens, bounds = bpe.encode_texts(part.column("text").to_pylist())
                ids.append(part.column("doc_id"))
                yield stored(np.insert(tokens, bounds[1:], separator)).tobytes()

        size = write_file(uri, chunks())
        if ids:
            order = pa.chunked_array(ids).combine_chunks()
            for k, lo in enumerate(range(0, len(order), 100_000)):
                some = order.slice(lo, 100_000)
                lists = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size], pa.int64()), pa.array([k * 100_000], pa.int64()), lists], names=["file", "bytes", "part", "doc_ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "file string, bytes long, part long, doc_ids array<long>")


def list_token_files(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes of the files at a path or pattern; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def count_tokens(files: DataFrame, separator: int, block_bytes: int = 4 << 20) -> DataFrame:
    """file, ordinal, start (in tokens), n_tokens and closed of each document in flat token files.

    files: distinct rows of file and bytes. Blocks are dealt out over the executors whatever file they are from.
    """
    spark = files.sparkSession
    step = block_bytes - block_bytes % DTYPE.itemsize
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("at"))
    blocks = blocks.repartition(max(spark.sparkContext.defaultParallelism, 1) * 4, "file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, at in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "at")), strict=True):
                fs, inner = filesystem(file)
                with fs.open_input_file(inner) as f:
                    tokens = np.frombuffer(f.read_at(min(step, size - at), at), DTYPE)
                found = np.flatnonzero(tokens == separator) + at // DTYPE.itemsize
                lists = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found, pa.int64()))
                end = (at + min(step, size - at)) // DTYPE.itemsize
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at]), pa.array([end], pa.int64()), lists], names=["file", "at", "end", "found"])

    scanned = saved(blocks.mapInArrow(run, "file string, at long, end long, found array<long>"), "blocks")
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.select("file", "at", F.size("found").cast("long").alias("n"), F.try_element_at("found", F.lit(-1)).alias("last"), "end").select(
        "file", "at", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_ordinal"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carry"),
        (F.lead("at").over(Window.partitionBy("file").orderBy("at")).isNull()).alias("final"),
    )
    tasks = max(spark.sparkContext.defaultParallelism, 1) * 4  # a row is a block with all of its separators
    stitched = scanned.join(carried, ["file", "at"]).repartition(tasks, "file", "at")
    after = F.coalesce(F.try_element_at("found", F.lit(-1)), F.col("carry"))
    open_end = F.when(F.col("final") & (after < F.col("end") - 1), F.array(F.col("end")))
    ends = F.concat("found", F.coalesce(open_end, F.array().cast("array<long>")))
    begins = F.concat(F.array("carry"), F.col("found"))
    each = stitched.select("file", "first_ordinal", F.size("found").alias("n"), begins.alias("begins"), F.posexplode(ends).alias("k", "stop"))
    start = F.element_at("begins", F.col("k") + 1) + 1
    return each.select("file", (F.col("first_ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("k") < F.col("n")).alias("closed"))


def document_token_counts(docs: DataFrame, path: str, separator: int) -> DataFrame:
    """doc_id, n_tokens of every document, by way of flat token files in the shared folder."""
    written = saved(write_token_files(docs, path, shared_dir(docs.sparkSession, "token-files"), separator), "order")
    counts = count_tokens(written.where("part = 0").select("file", "bytes"), separator)
    order = written.select("file", "part", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("part") + F.col("k")).alias("ordinal"), "doc_id")
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
