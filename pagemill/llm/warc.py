"""WARC archives in Zstandard: a dictionary in a leading skippable frame, then one frame per record.

Writing: each task writes the archives of its rows into the shared folder and returns a manifest of them.
Reading: each task streams archives, takes the dictionary from the first frame, decodes frame by frame and
checks headers, lengths and digests.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import bound_batches, checkpoint

#: Fixed values of the format.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1"

#: Payload bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
#: A dictionary is trained on so many bytes at most of an archive's first records; it changes sizes, never contents.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
#: Bytes read from an archive at a time.
READ_BYTES = 1 << 20
#: Payloads from this size on are written once.
REVISIT_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format."""


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it; ``file:`` in any spelling is the local one, else as pyarrow knows it."""
    if local := re.match(r"(?:file:/*)?(/.*)", uri):
        return pafs.LocalFileSystem(), "/" + local[1].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


# Writing


def _field(value: str) -> str:
    """A header value on one line: white space and controls are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, name: str, refers: str | None, uri: str | None, payload: bytes, digest: str, size: int) -> bytes:
    """One record, response or revisit; a revisit has the http headers of the payload and not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{_field(name)}>"), ("WARC-Date", DATE)]
    if uri is not None:
        lines.append(("WARC-Target-URI", _field(uri)))
    lines.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    lines.append(("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()))
    if kind == "revisit":
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{_field(refers)}>")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few records to learn from
        return None


class _Archive:
    """One archive that is being written. The first records wait until there are enough to train the dictionary."""

    def __init__(self, folder: str, name: str) -> None:
        self.system, path = filesystem(f"{folder}/{name}")
        self.path, self.uri = path, f"{folder}/{name}"
        self.waiting: list[bytes] = []
        self.held = self.taken = self.records = 0
        self.out = self.tool = None

    def add(self, data: bytes) -> None:
        self.taken += len(data)
        self.records += 1
        if self.out is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= SAMPLE_BYTES:
                self._open()
        else:
            self.out.write(self.tool.compress(data))

    def _open(self) -> None:
        learned = _dictionary(self.waiting)
        self.out = self.system.open_output_stream(self.path, compression=None)
        self.tool = zstandard.ZstdCompressor(level=3, dict_data=learned, write_content_size=True, write_checksum=True)
        if learned:
            packed = zstandard.ZstdCompressor(level=3).compress(learned.as_bytes())
            self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        for data in self.waiting:
            self.out.write(self.tool.compress(data))
        self.waiting = []

    def close(self) -> dict:
        if self.out is None:
            self._open()
        self.out.close()
        return {"path": self.uri, "records": self.records}


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (name, uri, kind, refers, payload, digest, size); returns (path, records), checkpointed.

    An archive's name has the number of the attempt that wrote it and only committed attempts are in the
    manifest, so archives of lost or repeated tasks are never read. Memory: one record, and the first records' sample.
    """
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        archive, number, done = None, 0, []
        for batch in batches:
            columns = [batch.column(c) for c in ("kind", "name", "refers", "uri", "payload", "digest", "size")]
            for values in zip(*columns):
                if archive is None:
                    archive = _Archive(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst")
                kind, name, refers, uri, payload, digest, size = (v.as_py() for v in values)
                archive.add(record(kind, name, refers, uri, payload, digest, size))
                if archive.taken >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive, number = None, number + 1
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return checkpoint(pages.mapInArrow(run, "path string, records long"))


# Reading


def frames(stream) -> Iterator[bytes]:
    """Contents of the frames of an archive, one after the other; skippable frames are passed over after the first."""
    held = stream.read(READ_BYTES)
    if not held:
        return
    learned = None

    def more(n: int) -> bool:
        nonlocal held
        while len(held) < n and (new := stream.read(max(READ_BYTES, n - len(held)))):
            held += new
        return len(held) >= n

    first = True
    while more(4) or held:
        if len(held) < 4:
            raise WarcError("the archive ends inside a frame")
        magic = int.from_bytes(held[:4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if not more(8):
                raise WarcError("the archive ends inside a frame")
            size = int.from_bytes(held[4:8], "little")
            if not more(8 + size):
                raise WarcError("the archive ends inside a frame")
            if first and magic == SKIPPABLE:
                content = held[8 : 8 + size]
                if content[:4] == struct.pack("<I", FRAME):
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                learned = zstandard.ZstdCompressionDict(content)
            held = held[8 + size :]
            first = False
            continue
        if magic != FRAME:
            raise WarcError(f"no frame begins with {magic:#x}")
        first = False
        tool = zstandard.ZstdDecompressor(dict_data=learned).decompressobj()
        parts = []
        try:
            while True:
                parts.append(tool.decompress(held))
                if tool.eof:
                    held = tool.unused_data
                    break
                held = stream.read(READ_BYTES)
                if not held:
                    raise WarcError("the archive ends inside a frame")
        except zstandard.ZstdError as err:
            raise WarcError(f"broken frame: {err}") from err
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Fields of the one record that a frame holds; raises WarcError for anything that does not fit the format."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC header: {data[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"no field: {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise WarcError(f"content-length is {fields['content-length']!r}")
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise WarcError(f"{fields['warc-record-id']}: block of {len(rest) - 4} bytes, content-length {size}")
    block = rest[:size]
    _verify(fields, "warc-block-digest", block)
    out = {"kind": fields["warc-type"], "id": fields["warc-record-id"], "uri": fields.get("warc-target-uri"), "refers": fields.get("warc-refers-to"), "digest": None, "size": size, "payload": block}
    if fields.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
        if not found:
            raise WarcError(f"{out['id']}: no end of the http headers")
        if out["kind"] == "response":
            if length and int(length[1]) != len(payload):
                raise WarcError(f"{out['id']}: payload of {len(payload)} bytes, http length {int(length[1])}")
            _verify(fields, "warc-payload-digest", payload)
        elif payload:
            raise WarcError(f"{out['id']}: a revisit with a payload")
        out |= {"payload": payload, "size": int(length[1]) if length else len(payload)}
    if out["kind"] == "revisit" and not (out["refers"] and fields.get("warc-profile")):
        raise WarcError(f"{out['id']}: a revisit without profile or reference")
    if digest := fields.get("warc-payload-digest"):
        out["digest"] = _hex(digest)
    return out


def _hex(digest: str) -> str:
    kind, _, value = digest.partition(":")
    if kind.lower() != "sha1":
        raise WarcError(f"digest {digest!r} is not sha1")
    try:
        return base64.b32decode(value.upper()).hex()
    except binascii.Error as err:
        raise WarcError(f"digest {digest!r}") from err


def _verify(fields: dict, name: str, data: bytes) -> None:
    if name in fields and _hex(fields[name]) != hashlib.sha1(data).hexdigest():
        raise WarcError(f"{fields['warc-record-id']}: {name} does not fit")


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in column ``path``: (kind, id, uri, refers, digest, size, payload), payload null if not asked for.

    Archives are streamed, one frame in memory at a time; null paths are passed over, a path that is listed
    twice is read twice. A broken archive fails the job with the record's name.
    """
    schema = pa.schema([("kind", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                if uri is None:
                    continue
                system, path = filesystem(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for frame in frames(stream):
                        row = parse_record(frame)
                        held += len(row["payload"])
                        rows.append(row if payloads else row | {"payload": None})
                        if len(rows) >= 1000 or held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return paths.select("path").mapInArrow(run, "kind string, id string, uri string, refers string, digest string, size long, payload binary")


def as_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Rows for ``write_archives``: of equal payloads of at least ``least`` bytes, the one with the largest key is the response.

    Null html is an empty payload. Rows that share the largest key are all responses. A null key is named
    by the empty string and is a response only if its payload has no other. The largest keys are aggregates, joined
    back by digest only for payloads that occur twice; the join has a row per digest and may be split or broadcast.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("uri"), body.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    repeated = pages.select(F.col(key).alias("key"), body.alias("payload")).where(F.octet_length("payload") >= least)
    repeated = repeated.groupBy(F.sha1("payload").alias("digest")).agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(repeated, "digest", "left")
    # Without any key in its group, last is null and all rows are responses.
    again = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    return joined.select(
        F.coalesce(F.col("key").cast("string"), F.lit("")).alias("name"), "uri", F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("last").cast("string")).alias("refers"), F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "size",
    )


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in ``folder``, by default a new one in the checkpoint folder; the manifest."""
    sc = pages.sparkSession.sparkContext
    if folder is None:
        if sc.getCheckpointDir() is None:
            checkpoint(pages.sparkSession.range(0))  # sets the folder
        folder = f"{sc.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    return write_archives(as_records(pages), folder)


def page_of(column: str):
    """The key in a record's name."""
    return F.nullif(F.regexp_extract(column, r"^<urn:page:(.*)>$", 1), F.lit(""))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = read_archives(archive_pages(pages), payloads=False)
    return found.select(
        page_of("id").cast("long").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), page_of("refers").cast("long").alias("refers_to"),
    )


OP4_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select *, max(page_id) over (partition by payload_digest) as last from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
from g
"""
