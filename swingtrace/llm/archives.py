"""WARC archives: written as gzip members by Spark, read back by a sequential reader.

Every record is one gzip member, so an archive can be cut at any record. Of records with equal
payloads the one with the least id is a response and the others are revisits without payload that refer
to it; which that is comes from one aggregation over payload digests.

Spark's text writer stores the archives, so they go to any file system with its commit protocol: a
member of less than 2^24 bytes ends in a zero byte (the high byte of its length field), and that byte is
the writer's line separator. A longer record is written as two members whose halves a reader joins, as
gzip allows. Archives take about `archive_bytes` of payload at most.

The reader takes an archive's bytes in order: it feeds a zlib decompressor chunk by chunk, takes as many bytes as
Content-Length says, checks the block and the payload digest, and starts the next member where the last one
ended.

Defined results: a null html is an empty payload; repeated rows each get a record, and of equal payloads
with one least id (ties included) one record stays the response; a null id sorts after all others and is
written as an empty header; a null url is written as an empty one; an empty table gives no archives;
other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingtrace.llm.common import shared_dir, stored, table

CHUNK = 1 << 16
LIMIT = 1 << 24
VERSION = b"WARC/1.1"
#: The archives bear no time of their own, so that a rerun writes the same bytes.
DATE = b"2026-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: str) -> str:
    return f"<urn:page:{page_id}>"


def encode(page_id: str, url: str, payload: bytes, sha: str, refers_to: str | None) -> bytes:
    """One record as one gzip member; a revisit has an empty block and names the record it repeats."""
    block = b"" if refers_to is not None else payload
    head = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + record_id(page_id).encode(),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + url.encode("utf-8", "surrogatepass").replace(b"\r", b"%0D").replace(b"\n", b"%0A"),
        b"WARC-Payload-Digest: sha1:" + sha.encode(),
        b"WARC-Block-Digest: sha1:" + digest(block).encode(),
        b"WARC-Payload-Length: " + str(len(payload)).encode(),
        b"Content-Type: text/html",
        b"Content-Length: " + str(len(block)).encode(),
    ]
    if refers_to is not None:
        head.insert(4, b"WARC-Refers-To: " + record_id(refers_to).encode())
        head.insert(5, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    raw = b"\r\n".join([*head, b"", b""]) + block + b"\r\n\r\n"
    return b"".join(_member(raw[i : i + LIMIT - 1]) for i in range(0, len(raw), LIMIT - 1))


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Reader:
    """Records of an archive, in order, from an iterator of byte chunks."""

    def __init__(self, chunks):
        self.chunks = iter(chunks)
        self.plain = bytearray()  # decompressed, not yet consumed
        self.packed = b""
        self.inflate = None

    def _more(self) -> bool:
        """Decompress one more chunk; False at the end of the archive."""
        while True:
            if not self.packed:
                self.packed = next(self.chunks, b"")
                if not self.packed:
                    if self.inflate is not None:
                        raise ValueError("the archive ends inside a gzip member")
                    return False
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            got = self.inflate.decompress(self.packed, CHUNK)
            if self.inflate.eof:
                self.packed, self.inflate = self.inflate.unused_data, None
            else:
                self.packed = self.inflate.unconsumed_tail
            if got:
                self.plain += got
                return True

    def _take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def _line(self) -> bytes | None:
        while (at := self.plain.find(b"\r\n")) < 0:
            if not self._more():
                if self.plain:
                    raise ValueError("the archive ends inside a header")
                return None
        return self._take(at + 2)[:-2]

    def __iter__(self):
        while (first := self._line()) is not None:
            if first != VERSION:
                raise ValueError(f"not a record: {first[:40]!r}")
            head: dict[str, str] = {}
            while line := self._line():
                name, _, value = line.partition(b":")
                head[name.decode().lower()] = value.strip().decode("utf-8", "surrogatepass")
            block = self._take(int(head["content-length"]))
            if self._take(4) != b"\r\n\r\n":
                raise ValueError("a record is not closed where its length says")
            if head["warc-block-digest"] != f"sha1:{digest(block)}":
                raise ValueError(f"block digest of {head['warc-record-id']}")
            if head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha1:{digest(block)}":
                raise ValueError(f"payload digest of {head['warc-record-id']}")
            yield head, block


def _digests(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """(page_id, place, sha, bytes) of every row."""

    def run(iterator):
        for batch in iterator:
            raw = [(h or "").encode("utf-8", "surrogatepass") for h in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([digest(r) for r in raw]), pa.array([len(r) for r in raw], pa.int64())],
                names=["page_id", "place", "sha", "bytes"],
            )

    kind = pages.schema[page_id].dataType.simpleString()
    narrow = pages.select(F.col(html).alias("html"), F.col(page_id).alias("page_id"), F.col("_place").alias("place"))
    return narrow.mapInArrow(run, f"page_id {kind}, place long, sha string, bytes long")


def write(
    pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
    archive_bytes: int = 32 << 20,
) -> None:
    """Archives of all pages under path; payloads under min_bytes are never revisits."""
    # rows get a place of their own, fixed by storing it, so that ties have one response
    placed = stored(
        pages.select(F.col(page_id).alias(page_id), F.col(url).alias(url), F.col(html).alias(html), F.monotonically_increasing_id().alias("_place")),
        "pages",
    )
    sums = stored(_digests(placed, page_id, html), "digests")
    first = (
        sums.filter(F.col("bytes") >= min_bytes)
        .groupBy("sha", "bytes")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "place")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("sha", "bytes", F.col("first.page_id").alias("first_id"), F.col("first.place").alias("first_place"))
    )
    revisits = sums.join(stored(first, "first"), ["sha", "bytes"]).filter(F.col("place") != F.col("first_place"))
    revisits = stored(revisits.select("place", F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("refers_to")), "revisits")
    rows = placed.join(revisits, placed["_place"] == revisits["place"], "left")
    mean = sums.agg(F.avg("bytes")).first()[0] or 0.0

    def run(iterator):
        for batch in iterator:
            out = []
            for i, u, h, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (h or "").encode("utf-8", "surrogatepass")
                member = encode(i, u, payload, digest(payload), ref)
                out.append(member[:-1])  # the last zero byte is the writer's line separator
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    members = rows.select(text(page_id), text(url), F.col(html), "refers_to").mapInArrow(run, "member binary")
    value = members.select(F.col("member").cast("string").alias("value"))
    # a task rolls over to a new archive, so pages are not dealt out anew
    value.write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, int(archive_bytes / (mean + 512)))).text(path)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the archives under path: type, id, url, payload digest and length, what it refers to (and the payload)."""

    def run(iterator):
        for batch in iterator:
            for content in batch.column(0):
                view = memoryview(content.as_buffer())
                chunks = (bytes(view[i : i + CHUNK]) for i in range(0, len(view), CHUNK))
                rows, size = [], 0
                for head, block in Reader(chunks):
                    ident = lambda name, h=head: h[name][len("<urn:page:") : -1] if name in h else None
                    rows.append((ident("warc-record-id"), head["warc-target-uri"], head["warc-type"], head["warc-payload-digest"][5:],
                                 int(head["warc-payload-length"]), ident("warc-refers-to"), block if payloads else None))
                    size += len(block)
                    if len(rows) >= 1000 or payloads and size > CHUNK * 64:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(
        run, "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = shared_dir(spark, "warc")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    named = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind).alias(c)
    return read(spark, path).select(named("page_id"), "payload_bytes", "payload_digest", "record_type", named("refers_to"))
