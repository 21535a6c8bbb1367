"""WARC archives as seekable Zstandard bundles.

Records are written into bundles, one file each: independent Zstandard frames of about
FRAME bytes, then a skippable frame with the seek table (the published seekable format:
compressed and decompressed size of each frame, footer magic 0x8F92EAB1). The write
returns an index that maps each record to its bundle, frame and offset within the frame,
so one record is read by fetching the footer and a single frame.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest
page_id is a response and the others revisit it; smaller ones are all responses. The
digests of repeated payloads are found on (digest, page_id) alone. A bitmap of them, of at
most 2^26 bits (8 MB) however many there are, goes to all tasks. Pages that it rules out
are written straight from the scan, and are not moved at all; the others, the repeated
ones and a few that share a bit with one (all of them once the bitmap is full), meet the
repeated digests in a join over the digest and a salt, so that a payload that a third of
all pages have is spread over SALTS keys.

Files go to a folder that all executors share, through pyarrow's file systems (a local or
mounted path, HDFS, object stores): each task writes under names of its own attempt, frame
by frame, so a task that is run again never touches a file that a reader may see; readers
take only the files that the committed index names, deal them over the tasks and fetch
frame by frame by the seek table.

Defined cases: a null html is an empty payload; a null url an empty target; line breaks
and other control characters of a URL are percent-encoded in the header. Rows with equal
page_id are records of their own (rows that repeat the response's page_id with the same
payload are responses as well). A null page_id never wins against another; if all are
null, all are responses. An empty table gives no bundles.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterable, Iterator
from hashlib import sha1
from typing import BinaryIO
from urllib.parse import quote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravia.llm.common import fresh_path, kept

MIN_REVISIT = 1000
FRAME, BUNDLE = 1 << 20, 32 << 20
#: Bits of the bitmap of repeated digests, and keys that one of them is spread over.
BITS, SALTS = 1 << 26, 64
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Tasks that the bundles are dealt over; each takes several where there are more.
MOST_READERS = 100_000
INDEX = "page_id long, bundle string, frame int, offset int, length int"


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, size: int, refers_to: int | None) -> bytes:
    """A response record, or a revisit without a payload. digest and size are of the whole payload."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the position behind the record that starts at `at`."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return headers, data[start:stop], stop + 4


class BundleWriter:
    """Frames of whole records, written as they fill; finish() appends the seek table."""

    def __init__(self, out: BinaryIO, frame_bytes: int = FRAME):
        self.out, self.frame_bytes = out, frame_bytes
        self.sizes: list[tuple[int, int]] = []
        self.open = bytearray()
        self.size = 0
        self._compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset within it)."""
        if self.open and len(self.open) + len(data) > self.frame_bytes:
            self._close_frame()
        where = len(self.sizes), len(self.open)
        self.open += data
        return where

    def _close_frame(self) -> None:
        frame = self._compressor.compress(bytes(self.open))
        self.out.write(frame)
        self.sizes.append((len(frame), len(self.open)))
        self.size += len(frame)
        self.open = bytearray()

    def finish(self) -> None:
        if self.open:
            self._close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(position, compressed size, decompressed size) of each frame, from a bundle or the end of one."""
    frames, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    entries = struct.iter_unpack("<II", tail[-9 - 8 * frames : -9])
    out, at = [], 0
    for packed, plain in entries:
        out.append((at, packed, plain))
        at += packed
    return out


class Bundle:
    """A bundle opened for reading: its footer and seek table, then frames one at a time."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        count = struct.unpack("<I", self.file.read_at(4, size - 9))[0]
        self.table = seek_table(self.file.read_at(min(size, 9 + 8 * count), max(0, size - 9 - 8 * count)))

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.table[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def __enter__(self) -> Bundle:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def read_record(path: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle: its footer, its seek table and one frame are read."""
    with Bundle(path) as bundle:
        return parse(bundle.frame(frame), offset)[:2]


def _sized(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    bit = F.pmod(F.xxhash64("digest"), F.lit(BITS)) + 1
    return full.withColumn("digest", F.sha1("payload")).withColumns({"map": F.bitmap_bucket_number(bit), "bit": F.bitmap_bit_position(bit)})


def with_roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> list[DataFrame]:
    """Two tables, of the pages that are surely not repeated and of the others: page_id, url, payload, digest, refers_to."""
    sized = _sized(pages)
    long = F.octet_length("payload") >= min_revisit
    again = sized.where(long).groupBy("digest", "map", "bit").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1 AND last IS NOT NULL")
    again = kept(again.select("digest", "map", "bit", "last"))
    # at most BITS / 32768 rows of 4096 bytes
    bitmap = F.broadcast(again.groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits")))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.element_at(F.array(*(byte.bitwiseAND(F.lit(1 << k)) for k in range(8))), (F.col("bit") % 8).cast("int") + 1) != 0
    known = sized.join(bitmap, "map", "left").withColumn("may", long & F.coalesce(marked, F.lit(False)))
    columns = ["page_id", "url", "payload", "digest"]
    single = known.where(~F.col("may")).select(*columns, F.lit(None).cast("long").alias("refers_to"))
    several = known.where("may").select(*columns, F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("salt"))
    salted = again.select("digest", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    revisits = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    joined = several.hint("merge").join(salted.hint("merge"), ["digest", "salt"], "left")
    return [single, joined.select(*columns, F.when(revisits, F.col("last")).alias("refers_to"))]


def write(pages: DataFrame, folder: str, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE) -> DataFrame:
    """Write the archives into folder; returns the committed index (page_id, bundle, frame, offset, length)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, entries = None, []

        def close() -> pd.DataFrame:
            nonlocal out, entries
            bundle.finish()
            out.close()
            done = pd.DataFrame(entries, columns=["page_id", "frame", "offset", "length"]).assign(bundle=name)
            out, entries = None, []
            return done.astype({"page_id": "Int64"})[["page_id", "bundle", "frame", "offset", "length"]]

        for rows in batches:
            for page_id, url, payload, digest, refers_to in rows.itertuples(index=False):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                    bundle = BundleWriter(out, frame_bytes)
                data = record(_whole(page_id), url, payload, bytes.fromhex(digest), len(payload), _whole(refers_to))
                entries.append((_whole(page_id), *bundle.add(data), len(data)))
                if bundle.size >= bundle_bytes:
                    yield close()
        if out is not None:
            yield close()

    # identifiers go through pandas as text: a column with a null would turn into floats
    typed = [rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")}).mapInPandas(run, INDEX) for rows in with_roles(pages)]
    typed[0].unionByName(typed[1]).write.parquet(f"{folder}/index.parquet")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index.parquet")


def _whole(text: str | None) -> int | None:
    return None if text is None else int(text)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(folder: str, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the bundles that the index names."""
    names = kept(index.select("bundle").distinct())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["bundle"]:
                with Bundle(f"{folder}/{name}") as bundle:
                    for i in range(len(bundle.table)):
                        frame, out, at = bundle.frame(i), [], 0
                        while at < len(frame):
                            headers, block, at = parse(frame, at)
                            out.append(_described(headers, block))
                        yield pd.DataFrame(out, columns=[c.split()[0] for c in READ.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})

    # a bundle is a task's worth of work, so names are dealt out one by one
    return names.repartition(max(1, min(names.count(), MOST_READERS))).mapInPandas(run, READ)


def _described(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    number = lambda urn: None if urn in (None, "<urn:page:null>") else int(urn[10:-1])
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(headers["WARC-Payload-Digest"][5:])
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or sha1(payload).digest() != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
    return number(headers["WARC-Record-ID"]), size, digest.hex(), kind, number(headers.get("WARC-Refers-To"))


def op5(pages: DataFrame) -> DataFrame:
    folder = fresh_path(pages.sparkSession, "warc")
    return read(folder, write(pages, folder))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
 g AS (SELECT d, count(*) AS k, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN k > 1 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k > 1 AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
