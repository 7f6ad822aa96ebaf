"""WARC archives in seekable Zstandard bundles.

Records are written in order into frames of about ``frame_bytes``; every frame is compressed on its own, and a bundle
ends with a seek table (a skippable frame) that lists the compressed and raw size of each frame, so a reader that knows
a frame's number fetches and decompresses only that frame. An index row maps each record identifier to its bundle,
frame, and offset and length inside the raw frame. Payloads that occur more than once are stored once: the record with
the largest id is the response, the others are revisit records that name it and keep its HTTP head.

A bundle is written under a name of its own attempt and renamed when complete, so a task that is run again after an
executor is lost leaves no half bundle. Paths may be any that ``pyarrow.fs`` opens; they are below the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longform.llm.common import small_batches

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9
# Fixed values of WARC 1.1.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX_SCHEMA = ("record_id string, page_id {0}, bundle string, frame bigint, frame_at bigint, frame_bytes bigint, "
                "raw_bytes bigint, offset bigint, length bigint")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: object, url: str | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{sha1}')}>"


def _line(value: object) -> str:
    """A header value on one line; an empty string stands for null."""
    return "" if value is None else str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str | None:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") or None


def write_record(page_id: object, url: str | None, payload: bytes, refers_to: object, revisit: bool) -> tuple[str, bytes]:
    """(record id, record). A revisit holds the HTTP head alone, with the full payload's length."""
    sha1 = digest(payload)
    name = record_name(page_id, url, sha1)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{sha1}",
            f"X-Page-Id: {_line(page_id)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {_line(refers_to)}"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> dict[str, object]:
    """Fields of one record; the digest of a response is computed anew from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {"record_id": fields["WARC-Record-ID"], "page_id": _unline(fields["X-Page-Id"]),
            "url": _unline(fields["WARC-Target-URI"]), "payload_bytes": size, "payload_digest": stated,
            "record_type": fields["WARC-Type"], "refers_to": _unline(fields.get("X-Refers-To-Page-Id", "")),
            "payload": payload if fields["WARC-Type"] == "response" else None}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, raw) sizes and the footer: frame count, descriptor, magic."""
    body = b"".join(struct.pack("<II", c, r) for c, r in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(start, compressed, raw) of each frame of an open bundle."""
    end = file.size()
    file.seek(end - FOOTER_BYTES)
    n, descriptor, magic = struct.unpack("<IBI", file.read(FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC or descriptor:
        raise ValueError("no seek table")
    file.seek(end - FOOTER_BYTES - 8 * n)
    sizes = list(struct.iter_unpack("<II", file.read(8 * n)))
    out, at = [], 0
    for c, r in sizes:
        out.append((at, c, r))
        at += c
    return out


class _Bundle:
    """One bundle in the making: records go to the open frame, full frames to the file."""

    def __init__(self, folder: str, level: int):
        self.files, path = fs.FileSystem.from_uri(folder)
        self.name = uuid.uuid4().hex
        self.path, self.part = f"{path}/{self.name}.warc.zst", f"{path}/_{self.name}.part"
        self.files.create_dir(path, recursive=True)
        self.out = self.files.open_output_stream(self.part, compression=None)
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.at = 0
        self.raw = bytearray()
        self.open: list[tuple] = []

    def add(self, name: str, page_id: object, record: bytes) -> None:
        self.open.append((name, page_id, len(self.raw), len(record)))
        self.raw += record

    def cut(self) -> list[tuple]:
        """Close the frame; its index rows."""
        if not self.open:
            return []
        packed = self.packer.compress(bytes(self.raw))
        self.out.write(packed)
        rows = [(name, page, f"{self.name}.warc.zst", len(self.frames), self.at, len(packed), len(self.raw), off, size)
                for name, page, off, size in self.open]
        self.frames.append((len(packed), len(self.raw)))
        self.at += len(packed)
        self.raw, self.open = bytearray(), []
        return rows

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.files.move(self.part, self.path)


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """Write ``pages`` as bundles below ``folder``; returns the index, one row per row of ``pages``, read from disk.

    Null payloads are empty ones. Of records whose payloads are equal and hold at least ``min_revisit_bytes`` bytes, the
    one with the largest id is the response (rows that repeat its id are responses too: there is nothing else to refer
    to); without any id in the group all are responses. Very long payloads make a frame of their own. Other columns are
    not written, so their names cannot clash.
    """
    small_batches(pages.sparkSession, 256)
    folder = _uri(folder)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    key = [F.sha1("payload").alias("k"), F.octet_length("payload").alias("n")]
    last = (rows.select("page_id", *key).where(F.col("n") >= min_revisit_bytes).groupBy("k", "n")
            .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).where("c > 1")
            .select("k", "n", "refers_to"))
    named = rows.withColumns({"k": key[0], "n": key[1]}).join(last, ["k", "n"], "left").select(
        "page_id", "url", "payload", "refers_to",
        F.coalesce(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")),
                   F.lit(False)).alias("revisit"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    schema = INDEX_SCHEMA.format(id_type)
    bundles = f"{folder}/bundles"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, index = None, []
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = None
        for rb in batches:
            kinds = kinds or [pa.string(), rb.schema.field("page_id").type, pa.string()] + [pa.int64()] * 6
            cols = [rb.column(i).to_pylist() for i in range(5)]
            for page_id, url, payload, refers_to, revisit in zip(*cols):
                bundle = bundle or _Bundle(bundles, level)
                name, record = write_record(page_id, url, payload, refers_to, revisit)
                if bundle.raw and len(bundle.raw) + len(record) > frame_bytes:
                    index += bundle.cut()
                    if bundle.at >= bundle_bytes:
                        bundle.close()
                        bundle = _Bundle(bundles, level)
                bundle.add(name, page_id, record)
            if len(index) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), kinds)], names)
                index = []
        if bundle:
            index += bundle.cut()
            bundle.close()
        if index:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), kinds)], names)

    named.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """Fields of the records that ``index`` (default: all) names.

    Index rows are grouped by frame; a frame is fetched by the range in its bundle's seek table, decompressed once, and
    its records cut out at their offsets.
    """
    folder = _uri(folder)
    index = index if index is not None else spark.read.parquet(f"{folder}/index")
    id_type = index.schema["page_id"].dataType.simpleString()
    cols = ["record_id", "bundle", "frame", "offset", "length"]
    bundles = f"{folder}/bundles"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(bundles)
        name = file = table = held = raw = None
        unpack = zstandard.ZstdDecompressor()
        for rb in batches:
            out = []
            for record_id, bundle, frame, offset, length in zip(*[rb.column(c).to_pylist() for c in cols]):
                if bundle != name:
                    file, name, held = files.open_input_file(f"{path}/{bundle}"), bundle, None
                    table = read_seek_table(file)
                if frame != held:
                    start, packed, size = table[frame]
                    file.seek(start)
                    raw, held = unpack.decompress(file.read(packed), max_output_size=size), frame
                got = read_record(raw[offset:offset + length])
                if got["record_id"] != record_id:
                    raise ValueError(f"index points to {got['record_id']}, not {record_id}")
                out.append(got)
            names = ["record_id", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to",
                     "payload"]
            kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, kinds)], names)

    small_batches(spark, 256)
    read = (index.select(*cols).repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
            .mapInArrow(run, "record_id string, page_id string, url string, payload_bytes bigint, "
                             "payload_digest string, record_type string, refers_to string, payload binary"))
    return read.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})
