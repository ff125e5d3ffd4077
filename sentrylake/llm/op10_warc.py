"""WARC archives: writing, a normaliser for archives that are one gzip stream, and reading back.

An archive written or received as a single gzip member can only be read from its start. The
normaliser inflates such a stream once, front to back, writes every record again as a gzip member
of its own and a sidecar index with one line per record (offset and length of the member, type,
id), so that any record can be read alone afterwards. It holds a piece of a record at a time,
whatever the size of archives and records.

Archives lie in a folder that all executors reach. A task names its files with a random part and
only the files of tasks that succeeded are in the manifest, so a task that runs again, or twice at
once, leaves at most unused files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from ..operators.staging import stage, stage_observed
from .common import text_pieces

# Payloads from this size on are stored once.
LEAST_SHARED_BYTES = 100
# An archive is closed when it holds this much payload.
ARCHIVE_BYTES = 64 << 20
# Up to this many repeated payloads (some 100 bytes each) their table is broadcast.
BROADCAST_ROWS = 50_000
_LEVEL = 4
_READ_BYTES = 1 << 20
_GZIP = 31
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"

_MANIFEST = "archive string, records bigint"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _record_id(key: str | None) -> str:
    return "<urn:page>" if key is None else f"<urn:page:{quote(key, safe='')}>"


def _key(record_id: str) -> str | None:
    inner = record_id.strip("<>").removeprefix("urn:page")
    return unquote(inner[1:]) if inner else None


def _record(row: dict) -> bytes:
    """Head and block of one record. A revisit has no block; its payload's length is noted."""
    payload = row["payload"] or b""
    lines = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if row["refers_to"] is None else "revisit"),
        "WARC-Record-ID: " + _record_id(row["page_id"]),
        "WARC-Date: " + _DATE,
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
    ]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["url"], safe="/:?#[]@!$&'()*+,;=%~-._"))
    if row["refers_to"] is not None:
        lines += ["WARC-Refers-To: " + _record_id(row["refers_to"]), "WARC-Profile: " + _PROFILE]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def mark_repeats(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html",
                 url_col: str = "url", least: int = LEAST_SHARED_BYTES) -> DataFrame:
    """page_id, url, payload (binary), digest and refers_to: the smallest id with an equal payload
    of at least `least` bytes, or null if the row is that one or there is none."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url") if url_col in pages.columns
        else F.lit(None).cast("string").alias("url"),
        payload.alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    repeats = (
        rows.filter(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n"))
        .filter("__n > 1 and __first is not null")
        .drop("__n")
    )
    repeats, seen = stage_observed(repeats, "repeats", F.count(F.lit(1)).alias("n"))
    if seen["n"] <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(repeats), "digest", "left")
    else:
        joined = spread_join(rows, repeats, ["digest"], ["page_id"], "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first"))
    return joined.select("page_id", "url", "payload", "digest", other.alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of mark_repeats as archives of one gzip stream each -> manifest (archive,
    records). The files are written when the manifest is."""

    def write(batches):
        files, root = _place(folder)
        files.create_dir(root, recursive=True)
        out = squeeze = name = None
        records = held = 0

        def close():
            out.write(squeeze.flush())
            out.close()
            return pa.RecordBatch.from_pydict(
                {"archive": [f"{folder}/{name}"], "records": [records]}
            )

        for batch in batches:
            for piece in text_pieces(batch, "payload"):
                for row in piece.to_pylist():
                    if out is None:
                        name = f"whole-{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                        squeeze, records, held = zlib.compressobj(_LEVEL, wbits=_GZIP), 0, 0
                    record = _record(row)
                    out.write(squeeze.compress(record))
                    records += 1
                    held += len(record)
                    if held >= archive_bytes:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    text_ids = marked.select(
        F.col("page_id").cast("string"), "url", "payload", "digest",
        F.col("refers_to").cast("string"),
    )
    return text_ids.mapInArrow(write, _MANIFEST)


@dataclass
class Part:
    """A piece of a record: its head (first piece only), some of its block, and if it ends."""

    head: bytes | None
    block: bytes
    last: bool


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _inflated(stream) -> Iterator[bytes]:
    """The content of a gzip file of one member or several, in pieces."""
    inflate = zlib.decompressobj(wbits=_GZIP)
    while data := stream.read(_READ_BYTES):
        while data:
            if inflate.eof:
                inflate = zlib.decompressobj(wbits=_GZIP)
            yield inflate.decompress(data, _READ_BYTES)
            data = inflate.unconsumed_tail or inflate.unused_data
    yield inflate.flush()
    if not inflate.eof:
        raise ValueError("the gzip stream ends early")


def record_parts(stream) -> Iterator[Part]:
    """Walks a WARC stream; a block longer than what is read at once comes in several parts."""
    held = b""
    left, inside = 0, False
    for data in _inflated(stream):
        held += data
        while True:
            if not inside:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                head, held = held[: at + 4], held[at + 4 :]
                # two line ends close the block
                left, inside = int(header_fields(head[:-4])["content-length"]) + 4, True
                take, held = held[:left], held[left:]
            else:
                head, take, held = None, held[:left], held[left:]
            left -= len(take)
            inside = left > 0
            if head or take:
                yield Part(head, take, not inside)
            if inside:
                break
    if inside or held:
        raise ValueError("the archive ends within a record")


def _a_task_each(manifest: DataFrame) -> DataFrame:
    """One archive is read front to back by one task. A manifest is tiny, so only a partitioning
    of a given number is not merged into one task by adaptive execution."""
    return manifest.repartitionByRange(max(manifest.count(), 1), "archive")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Archives of a manifest -> manifest of their normalised copies in folder: every record a
    gzip member of its own, and beside each archive its index <archive>.idx with a JSON line per
    record (offset, length, type, id)."""

    def rewrite(batches):
        files, root = _place(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                source, path = _place(archive)
                name = f"members-{uuid.uuid4().hex}.warc.gz"
                records = offset = 0
                with (
                    source.open_input_stream(path, compression=None) as stream,
                    files.open_output_stream(f"{root}/{name}", compression=None) as out,
                    files.open_output_stream(f"{root}/{name}.idx") as index,
                ):
                    for part in record_parts(stream):
                        if part.head is not None:
                            squeeze, begin = zlib.compressobj(_LEVEL, wbits=_GZIP), offset
                            fields = header_fields(part.head[:-4])
                        done = squeeze.compress((part.head or b"") + part.block)
                        if part.last:
                            done += squeeze.flush()
                        out.write(done)
                        offset += len(done)
                        if part.last:
                            line = {"offset": begin, "length": offset - begin,
                                    "type": fields["warc-type"], "id": fields["warc-record-id"]}
                            index.write(json.dumps(line).encode() + b"\n")
                            records += 1
                yield pa.RecordBatch.from_pydict(
                    {"archive": [f"{folder}/{name}"], "records": [records]}
                )

    return _a_task_each(manifest).mapInArrow(rewrite, _MANIFEST)


def _index_lines(stream) -> Iterator[dict]:
    held = b""
    while data := stream.read(_READ_BYTES):
        *lines, held = (held + data).split(b"\n")
        yield from map(json.loads, lines)


def read_records(manifest: DataFrame) -> DataFrame:
    """Records of normalised archives, each read alone at the offset its index names: page_id
    (text), payload_bytes, payload_digest, record_type, refers_to (text). Digest and length of a
    response are taken from its block and must equal what its head says; those of a revisit
    stand in its head."""

    def read(batches):
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                files, path = _place(archive)
                with (
                    files.open_input_file(path) as data,
                    files.open_input_stream(f"{path}.idx") as index,
                ):
                    rows: list[dict] = []
                    for line in _index_lines(index):
                        data.seek(line["offset"])
                        member = zlib.decompress(data.read(line["length"]), wbits=_GZIP)
                        rows.append(_read(member))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, _READ_SCHEMA)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, _READ_SCHEMA)

    return _a_task_each(manifest).mapInArrow(
        read, "page_id string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to string",
    )


_READ_SCHEMA = pa.schema(
    [("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.string())]
)


def _read(member: bytes) -> dict:
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = header_fields(head)
    block = rest[: int(fields["content-length"])]
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    length = int(fields["warc-payload-length"])
    if fields["warc-type"] == "response" and (
        length != len(block) or hashlib.sha256(block).hexdigest() != digest
    ):
        raise ValueError(f"{fields['warc-record-id']}: the payload is not the one described")
    refers_to = fields.get("warc-refers-to")
    return {
        "page_id": _key(fields["warc-record-id"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": None if refers_to is None else _key(refers_to),
    }


def archive_round_trip(pages: DataFrame, folder: str, id_col: str = "page_id",
                       payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Writes a record per row of pages, normalises the archives and reads them back: id,
    payload_bytes, payload_digest, record_type, refers_to, one row per input row.

    Null payloads are empty. Null ids come back as null; they refer to a named row with the same
    payload and are never referred to, so equal payloads without any id are all responses. Rows
    repeated with the smallest id of their payload are all responses. Null addresses are left
    out of the head. Payloads may be of any size that fits in a row. An empty table gives no
    archive and an empty result. Other columns are not read.
    """
    kind = pages.schema[id_col].dataType
    whole = stage(
        write_archives(mark_repeats(pages, id_col, payload_col, url_col), f"{folder}/whole"),
        "whole-manifest",
    )
    members = stage(normalise(whole, f"{folder}/members"), "members-manifest")
    return read_records(members).select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"),
    )
