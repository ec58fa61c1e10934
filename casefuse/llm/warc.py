"""WARC archives compressed with Zstandard and a shared dictionary.

An archive starts with a skippable frame that holds the (itself compressed) dictionary; each record
is a frame of its own, so a reader can start at any record. Equal payloads are stored once: the
record of the smallest page is a response, the others are revisits that refer to it.

Each task writes its own archive under a name that no other attempt uses, and reports it as a row.
Spark commits the rows of successful attempts only, so that list is the only way to the archives:
what a lost executor leaves behind is never read. Archives go through `pyarrow.fs`, to any store
that executors reach by a URI.
"""

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefuse.llm.common import mix64, row_order, written
from casefuse.session import shared_dir

# Fixed values of the two formats.
SKIPPABLE = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_BYTES = 112_640
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 1 << 28
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_RECORD = "page_id long, url string, payload binary, payload_bytes long, sha1 string, at long"


def record_id(page_id, at) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}:{at}')}>"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record(page_id, url, payload, size, sha1, at, first=None, date="2000-01-01T00:00:00Z") -> bytes:
    """One WARC record; `first` is (page_id, at, url) of the response that a revisit refers to."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = http if first else http + payload
    head = [("WARC-Type", "revisit" if first else "response"),
            ("WARC-Record-ID", record_id(page_id, at)), ("WARC-Date", date),
            ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"),
            ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if first:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first[0], first[1]))]
        if first[2] is not None:
            head.append(("WARC-Refers-To-Target-URI", _line(first[2])))
        if first[0] is not None:
            head.append(("X-Refers-To-Page-Id", first[0]))
    head.append(("Content-Length", len(block)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on sample records; raw content where they are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _loaded(dictionary: bytes):
    if not dictionary:
        return None
    full = len(dictionary) > 8 and struct.unpack("<I", dictionary[:4])[0] == DICTIONARY_MAGIC
    return zstandard.ZstdCompressionDict(
        dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if full
        else zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes records to one archive of a file system."""

    def __init__(self, where: str, dictionary: bytes, level: int = 3):
        self.where, self.n_records, self.n_bytes = where, 0, 0
        system, path = fs.FileSystem.from_uri(where)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.compressor = zstandard.ZstdCompressor(
            level=level, dict_data=_loaded(dictionary), write_checksum=True)
        if dictionary:
            body = zstandard.compress(dictionary)
            self._put(struct.pack("<II", SKIPPABLE, len(body)) + body)

    def _put(self, data: bytes):
        self.out.write(data)
        self.n_bytes += len(data)

    def add(self, data: bytes):
        self._put(self.compressor.compress(data))
        self.n_records += 1

    def close(self):
        self.out.close()


def open_archive(where: str):
    """(dictionary, stream of the records one after the other) of an archive."""
    system, path = fs.FileSystem.from_uri(where)
    source = system.open_input_stream(path, compression=None)
    head = source.read(8)
    dictionary = b""
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        dictionary = zstandard.decompress(source.read(struct.unpack("<I", head[4:])[0]))
        head = b""
    rest = io.BufferedReader(_Joined(head, source), 1 << 16)
    reader = zstandard.ZstdDecompressor(dict_data=_loaded(dictionary)).stream_reader(
        rest, read_across_frames=True)
    return dictionary, io.BufferedReader(reader, 1 << 16)


class _Joined(io.RawIOBase):
    """Bytes already read, then the rest of a source."""

    def __init__(self, head, source):
        self.head, self.source = head, source

    def readable(self):
        return True

    def readinto(self, into):
        data = self.head or self.source.read(len(into))
        self.head = data[len(into):]
        data = data[:len(into)]
        into[:len(data)] = data
        return len(data)


def read_records(stream) -> Iterator[tuple]:
    """(headers, block) of each record of a stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


def _parsed(headers: dict, block: bytes) -> tuple:
    """(page_id, url, record_type, payload or None, bytes, digest, refers_to) of a record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?i)content-length: *(\d+)", http)
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
        size = len(payload)
    else:
        payload, size = None, int(said.group(1))
    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
    return (None if page is None else int(page), headers.get("WARC-Target-URI"), kind, payload,
            size, digest, None if refers is None else int(refers))


def payload_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages as payloads with their SHA-1; null html is an empty payload."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        payload.alias("payload"), F.length(payload).cast("long").alias(
                            "payload_bytes"), F.sha1(payload).alias("sha1"),
                        row_order(pages).alias("at"))


def firsts(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`sha1, first`: the page that keeps the payload, where several pages have it."""
    order = F.struct(F.col("page_id").isNull(), "page_id", "at", "url")
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").select("sha1", "first")


def sample_dictionary(rows: DataFrame, records: int = 1000, sample_bytes: int = 16384) -> bytes:
    """A dictionary from about `records` rows chosen by hash, `sample_bytes` of payload each.

    Only this sample, whose size does not depend on the table's, reaches the driver. It decides how
    small archives get, never what is in them.
    """
    share = int((1 << 30) * min(1.0, records / max(1, rows.count())))
    chosen = rows.select("page_id", "url", F.substring("payload", 1, sample_bytes).alias("payload"),
                         "payload_bytes", "sha1", "at")
    chosen = chosen.where(F.pmod(mix64(F.col("at"), seed=13), F.lit(1 << 30)) < share)
    return build_dictionary([record(*r) for r in sorted(chosen.collect(), key=lambda r: r.at)])


def write_archives(rows: DataFrame, folder: str, least_bytes: int = 0, level: int = 3,
                   archive_bytes: int = ARCHIVE_BYTES, records: int = 1000) -> DataFrame:
    """Write all payload rows (a written table) and list the archives: `path, n_records, n_bytes`."""
    dictionary = sample_dictionary(rows, records)
    same = written(firsts(rows, least_bytes), "firsts")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None

        def closed():
            out.close()
            return pa.record_batch({"path": [out.where], "n_records": [out.n_records],
                                    "n_bytes": [out.n_bytes]})
        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in batch.schema.names)):
                page_id, url, payload, size, sha1, at, first = r
                if out is None:
                    out = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst", dictionary, level)
                other = first is not None and first["at"] != at
                out.add(record(page_id, url, payload, size, sha1, at, (
                    first["page_id"], first["at"], first["url"]) if other else None))
                if out.n_bytes >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    told = rows.join(same, "sha1", "left").select(
        "page_id", "url", F.when(F.col("first").isNull() | (F.col("first.at") == F.col("at")),
                                 F.col("payload")).alias("payload"),
        "payload_bytes", "sha1", "at", "first")
    return written(told.mapInArrow(archive, "path string, n_records long, n_bytes long"),
                   "archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the listed archives; payloads are checked against their digest."""
    schema = ("page_id long, url string, record_type string, payload_bytes long, "
              "payload_digest string, refers_to long" + ", payload binary" * payloads)
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            columns = dict(zip(("page_id", "url", "record_type", "payload", "payload_bytes",
                                "payload_digest", "refers_to"), map(list, zip(*rows))))
            kinds = {"url": pa.string(), "record_type": pa.string(), "payload": pa.binary(),
                     "payload_digest": pa.string()}
            return pa.record_batch([pa.array(columns[n], kinds.get(n, pa.int64())) for n in names],
                                   names)
        for listed in batches:
            for where in listed.column("path").to_pylist():
                rows, held = [], 0
                for headers, block in read_records(open_archive(where)[1]):
                    got = _parsed(headers, block)
                    rows.append(got if payloads else (*got[:3], None, *got[4:]))
                    held += len(block) if payloads else 100
                    if held > 1 << 22 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    spread = archives.repartition(max(1, archives.count()), "path")
    return spread.select("path").mapInArrow(read, schema)


def archive_pages(pages: DataFrame, folder: str = None, id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write pages to archives below `folder` and read every record back.

    Gives `page_id, url, record_type, payload_bytes, payload_digest, refers_to`. A null html is an
    empty payload; null ids come last in the choice of the response and are read back as null;
    a null url has no target header; repeated rows are one response and revisits; an empty table
    writes no archive and gives no rows. Further columns are ignored. Control characters in a url
    are percent-encoded.
    """
    rows = written(payload_rows(pages, id_col, url_col, html_col), "payloads")
    folder = folder or shared_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(rows, folder, least_bytes))
