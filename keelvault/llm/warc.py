"""WARC archives in Zstandard (operator 6): writer, reader and identical-payload revisits.

An archive is a ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D) with the dictionary, then one frame per record.
The reader walks the frames by their block headers, so it holds one record at a time, decodes each with the archive's
dictionary, and validates version line, required fields, Content-Length and, for responses, the payload's digest.

Duplicates: payloads of at least REVISIT_BYTES bytes with equal SHA-1 form a group; the largest page_id is the response,
the others are revisits that refer to it and carry no payload.  Groups are found by an aggregation (partial sums before the
shuffle) and joined back on the digest; a hot digest is split by adaptive execution, as any skewed join.

Archives go to the shared folder under a name of their own for each attempt; only those in the manifest, a table that the
writing tasks return, are read.  So a lost executor leaves at most an unread file.

Defined results: a null html is an empty payload; an empty or short payload is always a response; a null page_id is
written and read as null, and never refers or is referred to; a null url is written without a target; line breaks in a url
are percent-encoded; rows that repeat the largest page_id of a group are responses each; an empty table gives no archive
and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import scratch_path, stored

#: Fixed values of the formats: magic of the dictionary's skippable frame, of a Zstandard frame and of a raw dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN, DATE = "<urn:keelvault:page:{}>", "2024-01-01T00:00:00Z"
REVISIT_BYTES = 1000
#: An archive is closed beyond this size; its dictionary is trained on its first records, as many as SAMPLE_BYTES hold.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, SAMPLE_EACH = 16 << 20, 2 << 20, 32 << 10, 32 << 10


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and refers_to (null: a response)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    # smaller payloads, the empty ones above all, have keys of their own, so that they don't meet in one task for nothing
    large = F.col("payload_bytes") >= REVISIT_BYTES
    rows = rows.withColumn("_key", F.when(large, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id())))
    groups = rows.filter(large).groupBy("_key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.filter("n > 1").select("_key", "refers_to"), "warc-groups")
    joined = rows.join(groups, "_key", "left").drop("_key")
    return joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to")))


def record(page_id: int | None, url: str | None, html: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit holds the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {RECORD_URN.format('none' if page_id is None else page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD_URN.format(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for an archive; where its records are too few or too alike to train one, the beginnings of some of them."""
    samples = [s[:SAMPLE_EACH] for s in samples]
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 16)), samples)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive file."""

    def __init__(self, target: str, samples: list[bytes]) -> None:
        self.uri = f"{target}/{uuid.uuid4().hex}.warc.zst"
        store, path = fs.FileSystem.from_uri(self.uri)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.n, self.size = store.open_output_stream(path, compression=None), 0, 0
        own = trained(samples)
        self.codec = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=True, write_checksum=True)
        raw = own.as_bytes()
        self._write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._write(self.codec.compress(data))
        self.n += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.n, self.size


def write_archives(rows: DataFrame, target: str) -> DataFrame:
    """Writes the rows of with_digests() as archives under ``target``; returns the manifest: uri, n_records, n_bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, archive, done = 0, None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    data = record(row["page_id"], row["url"], row["html"].encode(), row["payload_bytes"], row["payload_digest"], row["refers_to"])
                    if archive is None:
                        held.append(data)
                        size += len(data)
                        if size < SAMPLE_BYTES:
                            continue
                        archive = Archive(target, held)
                        for x in held:
                            archive.add(x)
                        held, size = [], 0
                    else:
                        archive.add(data)
                    if archive.size >= ARCHIVE_BYTES:
                        done.append(archive.close())
                        archive = None
        if held:
            archive = Archive(target, held)
            for x in held:
                archive.add(x)
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["uri", "n_records", "n_bytes"])

    return stored(rows.select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to").mapInArrow(work, "uri string, n_records long, n_bytes long"), "warc-manifest")


class Frames:
    """The frames of a stream, one after the other, read by their headers."""

    def __init__(self, stream) -> None:  # noqa: ANN001
        self.stream = stream

    def take(self, n: int, may_end: bool = False) -> bytes:
        data = self.stream.read(n)
        if len(data) < n and not (may_end and not data):
            raise ValueError(f"archive ends within a frame: {len(data)} of {n} bytes")
        return data

    def __iter__(self) -> Iterator[tuple[bool, bytes]]:
        """(whether it is a skippable frame, its bytes; of a skippable frame the content alone)."""
        while magic := self.take(4, True):
            (kind,) = struct.unpack("<I", magic)
            if kind & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
                yield True, self.take(struct.unpack("<I", self.take(4))[0])
                continue
            if kind != FRAME:
                raise ValueError(f"not a frame: {magic.hex()}")
            flags = self.take(1)
            single = flags[0] >> 5 & 1
            rest = (not single) + (0, 1, 2, 4)[flags[0] & 3] + ((1 if single else 0), 2, 4, 8)[flags[0] >> 6]
            parts, last = [magic, flags, self.take(rest)], 0
            while not last:
                head = self.take(3)
                value = int.from_bytes(head, "little")
                last, kind_of, size = value & 1, value >> 1 & 3, value >> 3
                parts += [head, self.take(1 if kind_of == 1 else size)]
            if flags[0] >> 2 & 1:
                parts.append(self.take(4))
            yield False, b"".join(parts)


def read_archive(stream) -> Iterator[dict]:  # noqa: ANN001
    """The records of an archive, validated; ValueError where one isn't sound."""
    codec, first = zstandard.ZstdDecompressor(), True
    for skippable, data in Frames(stream):
        if skippable:
            if first:
                if len(data) >= 4 and struct.unpack("<I", data[:4])[0] == FRAME:
                    data = zstandard.ZstdDecompressor().decompress(data)
                codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
            first = False
            continue
        first = False
        yield parse(codec.decompress(data))


def parse(data: bytes) -> dict:
    """A record's fields, its HTTP fields and its payload."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not mark or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in fields:
            raise ValueError(f"record without {name}")
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: Content-Length {n}, but {len(rest) - 4} bytes")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "response":
        if len(payload) != int(http_fields["Content-Length"]):
            raise ValueError(f"{fields['WARC-Record-ID']}: payload of another length")
        if hashlib.sha1(payload).hexdigest() != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
            raise ValueError(f"{fields['WARC-Record-ID']}: payload of another digest")
    elif payload:
        raise ValueError(f"{fields['WARC-Record-ID']}: a {fields['WARC-Type']} with a payload")
    return {"fields": fields, "http": http_fields, "payload": payload}


def id_of(urn: str | None) -> int | None:
    last = (urn or "none").rpartition(":")[2].rstrip(">")
    return None if last == "none" else int(last)


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and html)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()][: 6 + payloads]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"][: 6 + payloads]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for r in read_archive(stream):
                        f = r["fields"]
                        row = (id_of(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), int(r["http"]["Content-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], id_of(f.get("WARC-Refers-To")))
                        rows.append((*row, r["payload"].decode() if payloads else None)[: 6 + payloads])
                        size += len(r["payload"]) if payloads else 0
                        if len(rows) >= 4096 or size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)
                            rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

    archives = max(1, manifest.count())
    return manifest.select("uri").repartition(archives, "uri").mapInArrow(work, schema)


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes a record per page and reads the archives back."""
    spark = pages.sparkSession
    manifest = write_archives(with_digests(pages), scratch_path(spark, "warc"))
    return read_archives(spark, manifest, payloads)
