"""Operator 3: writing and reading WARC archives.

Writer: each task streams its rows into archive files in a shared folder, one
gzip member a record, and starts a new file beyond ``archive_bytes``. Payloads
of at least ``revisit_bytes`` that occur more than once are stored once, with the
largest page_id, and the other pages get revisit records that refer to it. A
task's files carry a name of their own, and only files in the manifest count,
so the files of lost or repeated tasks are never read.

Reader: sequential. A file is read in blocks and inflated incrementally, member
by member; a record's header names its content length, and the block's and the
payload's digests are verified. Memory holds one record and one block.

Scale: digests with their largest page_id are combined before their shuffle and
joined back with salts, so a payload that a third of all pages share is dealt
out, whatever page_ids they have. Bodies are shuffled once; archives, not records,
are read tasks. Archives are the result: who asks for them removes them.

Defined results: null html is an empty payload; rows without url get an urn as
target; repeated rows give a record each; null page_id is kept and is never the
largest unless all are; other columns are ignored; an empty table gives an empty
result. A record that breaks framing or a digest raises ``BadRecord``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ARCHIVE_BYTES = 64 << 20
REVISIT_BYTES = 1000
_LINE = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    pass


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str | None = None) -> str:
    """That of a stored payload names page and payload, for revisits to refer to; any other is of its own."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest or uuid.uuid4().hex}>"


def make_record(page_id, url, payload: bytes, refers_to, is_revisit: bool, date: str, is_stored: bool = False) -> bytes:
    """One record as a gzip member."""
    block = _HTTP % len(payload) + (b"" if is_revisit else payload)
    digest = hashlib.sha1(payload).hexdigest()
    fields = {
        "WARC-Type": "revisit" if is_revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest if is_stored else None),
        "WARC-Date": date,
        "WARC-Target-URI": (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": _digest(payload),
        "WARC-Block-Digest": _digest(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if is_revisit:
        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(refers_to, digest)}
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode() + _LINE for k, v in fields.items())
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(head + _LINE + block + _LINE + _LINE) + pack.flush()


# --- reading -----------------------------------------------------------------


def members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other."""
    inflate, parts, data = None, [], b""
    while True:
        if not data:
            data = stream.read(block)
            if not data:
                break
        if inflate is None:
            data = data.lstrip(b"\0")  # padding between members
            if not data:
                continue
            inflate = zlib.decompressobj(31)
        try:
            parts.append(inflate.decompress(data))
        except zlib.error as error:
            raise BadRecord(f"not gzip: {error}") from error
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = None, []
    if inflate is not None:
        raise BadRecord("the archive ends within a record")


def read_record(data: bytes) -> dict:
    """Header fields (lower-case names), block, and for HTTP the payload; framing and digests are verified."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        raise BadRecord("no WARC header")
    lines = data[:end].split(_LINE)
    fields: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in b" \t" and name:  # a folded line
            fields[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, found, value = line.partition(b":")
        name = name.strip().decode("utf-8", "replace").lower()
        if not found:
            raise BadRecord(f"bad header line {line[:40]!r}")
        fields[name] = value.strip().decode("utf-8", "replace")
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError) as error:
        raise BadRecord("no content length") from error
    block = data[end + 4 : end + 4 + length]
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise BadRecord("content length and record differ")
    if "warc-block-digest" in fields and not _same(fields["warc-block-digest"], block):
        raise BadRecord("block digest differs")
    head, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields and not _same(fields["warc-payload-digest"], payload):
        raise BadRecord("payload digest differs")
    return {"fields": fields, "block": block, "http": head, "payload": payload}


def _raw_digest(said: str) -> bytes:
    name, _, value = said.partition(":")
    if name.lower() != "sha1":
        raise BadRecord(f"digest {name} isn't known")
    return bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())


def _same(said: str, data: bytes) -> bool:
    return _raw_digest(said) == hashlib.sha1(data).digest()


def _page(urn: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+)(?::|>)", urn or "")
    return int(found[1]) if found else None


# --- Spark -------------------------------------------------------------------


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, refers_to, is_revisit, is_stored: which pages repeat a payload that another stores."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    # payloads too small to be shared get a key of their own, so nothing gathers them
    own = F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("_key", F.when(F.octet_length("payload") >= revisit_bytes, F.sha1("payload")).otherwise(own))
    keepers = rows.where(~F.col("_key").startswith("~")).groupBy("_key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    joined = common.salted_lookup(rows, keepers, ["_key"], F.monotonically_increasing_id())
    repeats = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "payload", F.when(repeats, F.col("keeper")).alias("refers_to"), repeats.alias("is_revisit"), (F.col("n").isNotNull() & ~repeats).alias("is_stored"))


def _open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write ``records`` (as of ``plan_records``) below ``folder``; the written manifest: path, n_records, n_bytes."""
    spark: SparkSession = records.sparkSession

    def run(batches):
        store, base = _open_folder(folder)
        store.create_dir(f"{base}/archives", recursive=True)
        out, done = None, []

        def close():
            out["stream"].close()
            done.append((out["path"], out["records"], out["bytes"]))

        for batch in batches:
            for page_id, url, payload, refers_to, is_revisit, is_stored in zip(*(batch.column(i) for i in range(6)), strict=True):
                if out is None:
                    path = f"{base}/archives/{uuid.uuid4().hex}.warc.gz"
                    out = {"path": path, "stream": store.open_output_stream(path, compression=None), "records": 0, "bytes": 0}
                data = make_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), is_revisit.as_py(), date, is_stored.as_py())
                out["stream"].write(data)
                out["records"] += 1
                out["bytes"] += len(data)
                if out["bytes"] >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "n_records", "n_bytes"])

    schema = "path string, n_records long, n_bytes long"
    records.select("page_id", "url", "payload", "refers_to", "is_revisit", "is_stored").mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a record: page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest (hex), refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def row(record: dict) -> dict:
        fields, revisit = record["fields"], record["fields"]["warc-type"] == "revisit"
        said = next((int(x.partition(b":")[2]) for x in record["http"].split(_LINE) if x.lower().startswith(b"content-length:")), None)
        return {
            "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
            "payload": None if revisit else record["payload"], "payload_bytes": said if revisit else len(record["payload"]),
            "payload_digest": _raw_digest(fields["warc-payload-digest"]).hex(), "refers_to": _page(fields.get("warc-refers-to")),
        }

    def run(batches):
        store, _ = _open_folder(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for data in members(stream):
                        held.append(row(read_record(data)))
                        size += len(data)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    names = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    paths = manifest.select("path")
    parts = max(1, min(manifest.count(), 100_000))
    return paths.repartition(parts).mapInArrow(run, names)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as archives and read these back."""
    spark = pages.sparkSession
    folder = folder or common.shared_path(spark, "warc")
    return read_archives(write_archives(plan_records(pages), folder), folder)
