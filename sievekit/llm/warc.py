"""Seekable Zstandard WARC bundles.

Records are grouped into independent Zstandard frames; a bundle is the frames
followed by a footer seek table (a skippable frame with the compressed and the
uncompressed size of every frame), so any frame opens without its neighbours.
The index maps a record's identifier to (bundle, frame, offset in the
uncompressed frame, length).  Bundles are rows of a binary column, written by
Spark wherever it can write; ``export`` turns them into ``.warc.zst`` files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm._common import rows, stash
from sievekit.llm._words import sliced

#: Fixed values of the seekable format: skippable frame and seek table footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 1 << 20

INDEX = "array<struct<page_id:bigint,record_id:string,frame:int,offset:bigint,length:bigint>>"
BUNDLE = f"bundle_id string, data binary, n_records int, entries {INDEX}"
RECORD = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
          "refers_to bigint, record_id string, target_uri string")
_ENTRY = pa.struct([("page_id", pa.int64()), ("record_id", pa.string()), ("frame", pa.int32()),
                    ("offset", pa.int64()), ("length", pa.int64())])
_BUNDLE = pa.schema([("bundle_id", pa.string()), ("data", pa.binary()), ("n_records", pa.int32()),
                     ("entries", pa.list_(_ENTRY))])
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
                     ("target_uri", pa.string())])


def record_bytes(page_id, url, payload: bytes, digest: str, first_id, record_id: str) -> bytes:
    """One WARC record; ``first_id`` is the page a revisit refers to, else None."""
    revisit = first_id is not None
    block = b"" if revisit else payload
    uri = (url or "").replace("\r", " ").replace("\n", " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
            f"X-Page-ID: {'' if page_id is None else page_id}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{first_id}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record at the start of ``data``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.partition(": ")[::2] for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer for frames of these (compressed, uncompressed) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_places(data: bytes) -> list[tuple[int, int, int]]:
    """(place, compressed, uncompressed size) of each frame, from the footer alone."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    at, out = 0, []
    for c, u in struct.iter_unpack("<II", data[-9 - 8 * n:-9]):
        out.append((at, c, u))
        at += c
    return out


def read_frame(data: bytes, frame: int, places=None) -> bytes:
    """The uncompressed bytes of one frame, without touching the others."""
    import zstandard
    at, c, u = (places or frame_places(data))[frame]
    return zstandard.ZstdDecompressor().decompress(data[at:at + c], max_output_size=max(u, 1))


def read_record(data: bytes, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Random access to one record by its index entry."""
    return parse_record(read_frame(data, frame)[offset:offset + length])


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    zip_ = zstandard.ZstdCompressor(level=3)
    frames: list[bytes] = []
    sizes: list[tuple[int, int]] = []
    entries: list[dict] = []
    frame: list[bytes] = []
    filled = total = 0

    def close_frame():
        nonlocal frame, filled, total
        if frame:
            plain = b"".join(frame)
            packed = zip_.compress(plain)
            frames.append(packed)
            sizes.append((len(packed), len(plain)))
            frame, filled, total = [], 0, total + len(packed)

    def close_bundle():
        nonlocal frames, sizes, entries, total
        close_frame()
        data = b"".join(frames) + seek_table(sizes)
        name = hashlib.sha256(data).hexdigest()[:32]
        out = rows(_BUNDLE, bundle_id=[name], data=[data], n_records=[len(entries)], entries=[entries])
        frames, sizes, entries, total = [], [], [], 0
        return out

    for b in sliced(batches, "payload", 8 << 20):
        for page, url, body, digest, first in zip(*(b.column(c).to_pylist() for c in (
                "page_id", "url", "payload", "digest", "first_id"))):
            payload = body or b""
            # the id names the page and, for odd inputs that repeat a page, its payload
            rid = f"urn:page:{'' if page is None else page}:{digest[:16]}"
            rec = record_bytes(page, url, payload, digest, first, rid)
            if filled and filled + len(rec) > FRAME_BYTES:
                close_frame()
            entries.append({"page_id": page, "record_id": rid, "frame": len(frames), "offset": filled,
                            "length": len(rec)})
            frame.append(rec)
            filled += len(rec)
            if total >= BUNDLE_BYTES or len(entries) >= 20_000:
                yield close_bundle()
    if entries:
        yield close_bundle()


def _unbundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, "data", 8 << 20):
        for data, entries in zip(b.column("data").to_pylist(), b.column("entries").to_pylist()):
            places, at, plain, out = frame_places(data), -1, b"", []
            for e in entries:
                if e["frame"] != at:
                    at = e["frame"]
                    plain = read_frame(data, at, places)
                head, block = parse_record(plain[e["offset"]:e["offset"] + e["length"]])
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                revisit = head["WARC-Type"] == "revisit"
                if not revisit and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                out.append((int(head["X-Page-ID"]) if head["X-Page-ID"] else None, int(head["X-Payload-Length"]),
                            digest, head["WARC-Type"],
                            int(head["WARC-Refers-To"][len("<urn:page:"):-1]) if revisit else None,
                            head["WARC-Record-ID"][1:-1], head["WARC-Target-URI"]))
            yield rows(_RECORD, **dict(zip(_RECORD.names, map(list, zip(*out)))))


def with_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, digest, first_id``: ``first_id`` is the smallest page
    with the same payload of at least ``min_bytes`` bytes, null for that page
    itself and for payloads without a copy.

    Only (digest, page_id) rows meet on the digest; the payload itself moves once,
    by page.  A digest shared by much of the table is pre-aggregated per task, and
    the join that hands its first page out is one Spark splits when it is skewed.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     payload.alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    slim = stash(p.where(F.octet_length("payload") >= min_bytes)
                 .select("page_id", F.unhex("digest").alias("d")), "digests")
    firsts = (slim.groupBy("d").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
              .where((F.col("n") > 1) & F.col("first_id").isNotNull()).select("d", "first_id"))
    later = (slim.join(firsts, "d").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
             .select(F.col("page_id").alias("_page"), F.lower(F.hex("d")).alias("_digest"), "first_id").distinct())
    return (p.join(later, p["page_id"].eqNullSafe(later["_page"]) & (p["digest"] == later["_digest"]), "left")
            .select("page_id", "url", "payload", "digest", "first_id"))


def write_bundles(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write every page as a WARC record and return the stored bundles
    (``bundle_id, data, n_records, entries``).

    Null html is an empty payload.  Equal payloads of ``min_bytes`` bytes and more:
    the record of the smallest page_id is the response, the others revisit it
    (rows that repeat the smallest page_id are responses too, null ids always
    revisit).  An empty table gives no bundle; other columns are ignored.  A bundle
    holds about ``BUNDLE_BYTES`` compressed bytes, a record is never cut.
    """
    return stash(with_revisits(pages, min_bytes).mapInArrow(_bundles, BUNDLE), "warc")


def record_index(bundles: DataFrame) -> DataFrame:
    """``page_id, record_id, bundle_id, frame, offset, length`` of every record."""
    return (bundles.select("bundle_id", F.explode("entries").alias("e"))
            .select("e.page_id", "e.record_id", "bundle_id", "e.frame", "e.offset", "e.length"))


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Read every record back through footer and index; a response whose bytes do
    not match their digest raises."""
    return bundles.select("data", "entries").mapInArrow(_unbundle, RECORD)


def export(bundles: DataFrame, uri: str) -> DataFrame:
    """Write each bundle as ``<uri>/<bundle_id>.warc.zst`` from the executors, to any
    file system Arrow opens; returns ``bundle_id, bytes``."""
    def put(batches):
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, data in zip(b.column("bundle_id").to_pylist(), b.column("data").to_pylist()):
                with store.open_output_stream(f"{root}/{name}.warc.zst") as out:
                    out.write(data)
            yield pa.record_batch([b.column("bundle_id"), pa.array([len(x.as_py()) for x in b.column("data")], pa.int64())],
                                  names=["bundle_id", "bytes"])
    return bundles.select("bundle_id", "data").mapInArrow(put, "bundle_id string, bytes bigint")
