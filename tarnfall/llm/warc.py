"""WARC archives: index first, then coalesced range reads.

Writing puts the records of each partition into one archive of gzip members (one per record) and gives an index row for
every record: archive, offset, length, URL, digest. Reading takes any selection of index rows, sorts them by archive and
offset, coalesces neighbouring byte ranges, and parses the selected records out of each range.

Records with equal payloads are written once: that with the least page_id is the response, the others are revisits that
name it and carry the full payload's digest and length. Which digests occur twice is found from (digest, page_id) alone;
that table is broadcast while it is small, so pages are written where they are read; else it is joined by digest, a join
whose large side Spark can split where one payload is very common.

Defined results: a null html is an empty payload; a null URL is written as ``urn:page:<id>``. Null page ids are written
as such and never become a response while another row has the payload. Rows repeated with one page_id are separate
records; one of them is the response, equal ones of that id are all responses. Payloads of fewer than ``min_bytes`` bytes
are always responses. An empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.llm.shared import bound_batches, broadcast_if_small, filesystem, saved, shared_dir, write_file

INDEX = "archive string, offset long, length long, url string, payload_digest string, page_id long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"
#: Fixed value: the profile of a revisit with an identical payload (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # of the record; pages carry no time


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, compressed as a gzip member of its own."""
    url = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Target-URI": url,
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest}",
        **({} if refers_to is None else {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress(raw.encode() + body + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> dict[str, object]:
    """The fields of one uncompressed record; the payload of a revisit is None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda s: None if s is None or s[10:-1] == "None" else int(s[10:-1])  # noqa: E731  <urn:page:N>
    kind = fields["WARC-Type"]
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": kind, "payload_bytes": size,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the response's page_id for a revisit, else null."""
    html = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    slim = pages.select("page_id", F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"))
    first = slim.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = marked.join(broadcast_if_small(saved(first, "repeated"), 200_000), "sha", "left")
    own = F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", F.when(~own, F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Writes the marked pages; returns the index, which the caller saves before reading: it names the archives that count."""
    bound_batches(marked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, rows = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", []

        def chunks() -> Iterator[bytes]:
            at = 0
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    payload = html.encode()
                    digest = base32_sha1(payload)
                    out = record(page_id, url, payload, digest, refers_to)
                    rows.append((uri, at, len(out), url, digest, page_id))
                    at += len(out)
                    yield out

        write_file(uri, chunks())
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for lo in range(0, len(rows), 10_000):
            columns = zip(*rows[lo : lo + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["archive", "offset", "length", "url", "payload_digest", "page_id"])

    return marked.mapInArrow(run, INDEX)


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records that the index rows select, payloads verified against their digests.

    Rows are dealt out by archive and stretch of ``most`` bytes, over as many tasks as the records' bytes need (the rows
    themselves are few, so their own size must not decide it); in a task, ranges with gaps of up to ``gap`` bytes between
    them are read at once, up to ``most`` bytes unless one record is longer.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(2 * index.sparkSession.sparkContext.defaultParallelism, -(-total // (4 * most)))
    index = index.repartition(tasks, "archive", F.expr(f"offset div {most}")).sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fetch(archive: str, spans: list[tuple[int, int]]) -> pa.RecordBatch:
            fs, inner = filesystem(archive)
            base = spans[0][0]
            with fs.open_input_file(inner) as f:
                data = f.read_at(spans[-1][0] + spans[-1][1] - base, base)
            out = [parse(zlib.decompress(data[at - base : at - base + n], wbits=31)) for at, n in spans]
            for x in out:
                if x["payload"] is not None and base32_sha1(x["payload"]) != x["payload_digest"]:
                    raise ValueError(f"digest mismatch in {archive}, record {x['page_id']}")
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            names = list(out[0])
            return pa.RecordBatch.from_arrays([pa.array([x[c] if c != "payload" or x[c] is None else x[c].decode() for x in out], t) for c, t in zip(names, types, strict=True)], names=names)

        archive, spans = None, []
        for batch in batches:
            for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if spans and (name != archive or at - sum(spans[-1]) > gap or at + n - spans[0][0] > most):
                    yield fetch(archive, spans)
                    spans = []
                archive = name
                spans.append((at, n))
        if spans:
            yield fetch(archive, spans)

    return index.select("archive", "offset", "length").mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads all records back."""
    folder = shared_dir(pages.sparkSession, "warc")
    index = saved(write_archives(mark_revisits(pages, min_bytes), folder), "index")
    return read_records(index)
