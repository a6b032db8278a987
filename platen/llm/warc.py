"""Zstandard WARC archives: a writer, and a reader that checks what it reads.

An archive starts with a skippable frame that holds the dictionary; then comes one frame per record, so
that a record can be read without its neighbours. The writer's tasks put archives of a bounded size into
the shared folder under names that no other attempt uses and return a manifest; once the manifest is
staged, only its archives count, so that a lost executor leaves orphans but no doubles.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, join_counted, new_path, parts, stage

#: Fixed values of the format: magic numbers of the dictionary's frame and of a frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528

MANIFEST = "path string, records long, bytes long"
RECORDS = "record_id string, record_type string, target_uri string, page_id long, payload binary, payload_bytes long, payload_digest string, refers_to long, problem string"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text's UTF-8: 160 bits are 32 digits of 5, four to every five hex digits."""
    digest = F.sha1(text)
    fours = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "payload", least: int = 0) -> DataFrame:
    """pages and payload_bytes, payload_digest, record_type, refers_to.

    Of equal payloads of at least ``least`` bytes the one with the largest key is the response, the others
    revisit it. Rows that share that largest key are all responses; a null key revisits if another has one.
    Only (digest, count, key) of each distinct payload is gathered; hot payloads are joined in place. pages'
    own columns stay, but for those that have one of the four names and are neither key nor payload.
    """
    own = [c for c in pages.columns if c in (key, payload) or c.lower() not in ("payload_bytes", "payload_digest", "record_type", "refers_to")]
    same, latest, size, digest, n = free_names(own, "warc_payload", "warc_latest", "warc_bytes", "warc_digest", "warc_n")
    pages = pages.select(*own, F.octet_length(payload).cast("long").alias(size), base32_sha1(F.col(payload)).alias(digest))
    pages = pages.withColumn(same, F.concat_ws("-", F.when(F.col(size) >= least, F.lit("")).otherwise(F.lit("small")), F.col(size).cast("string"), F.col(digest)))
    counted = stage(pages.groupBy(same).agg(F.count(F.lit(1)).alias(n), F.max(key).alias(latest)), "warc-payloads")
    total = counted.agg(F.sum(n)).first()[0] or 0
    out = join_counted(pages, counted, same, n, total)
    revisit = (F.col(size) >= least) & F.col(latest).isNotNull() & ~F.col(key).eqNullSafe(F.col(latest))
    return out.select(*own, F.col(size).alias("payload_bytes"), F.col(digest).alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col(latest)).alias("refers_to"))


def _uri(key: int | None) -> str:
    return f"<urn:x-page:{'' if key is None else key}>"


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers: int | None, date: str) -> bytes:
    """A WARC/1.1 record. A revisit holds the HTTP headers alone, with the length of the whole payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(key)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(payloads: list[bytes], headers: list[bytes]) -> bytes:
    """A dictionary of some payloads' beginnings and records' headers. Headers fill up what is too little to train on."""
    samples = [p[:4096] for p in payloads if p] + headers
    samples += headers * (256 // max(1, len(headers)))
    total = sum(map(len, samples))
    return zstandard.train_dictionary(max(256, min(16_384, total // 16)), samples).as_bytes()


def _store(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def write_warc(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "payload", archive_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes pages (with the columns of with_revisits) to archives and returns their manifest, staged."""
    folder = new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        frames, held, raw, made, packer = [], 0, 0, [], None

        def made_of(r: dict) -> bytes:
            return record_bytes(r["key"], r["url"], (r["payload"] or "").encode(), r["payload_digest"], r["record_type"], r["refers_to"], date)

        def closed() -> None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{top}/{name}", compression=None) as out:
                out.write(b"".join(frames))
            made.append((f"{folder}/{name}", len(frames) - 1, held))

        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if packer is None:
                    some = rows[:400]  # the dictionary's samples alone
                    data = trained([(x["payload"] or "").encode() for x in some], [made_of({**x, "payload": ""}) for x in some])
                    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True)
                    frames, held, raw = [struct.pack("<II", SKIPPABLE, len(data)) + data], 8 + len(data), 0
                record = made_of(r)
                frames.append(packer.compress(record))
                held += len(frames[-1])
                raw += len(record)
                if raw >= archive_bytes:
                    closed()
                    packer = None
        if packer is not None:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).alias("payload"), "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
    return stage(rows.mapInArrow(run, MANIFEST), "warc-manifest")


class Cut:
    """Cuts a stream into frames; what it holds of the stream is a frame and what was read with it."""

    def __init__(self, stream, step: int = 1 << 20):
        self.stream, self.step, self.data, self.at = stream, step, b"", 0

    def has(self, n: int) -> bool:
        """Whether n bytes are left; they are then in data from at on."""
        if len(self.data) - self.at < n:
            parts = [self.data[self.at :]]
            held = len(parts[0])
            while held < n and (more := self.stream.read(max(self.step, n - held))):
                parts.append(bytes(more))
                held += len(more)
            self.data, self.at = b"".join(parts), 0
        return len(self.data) - self.at >= n

    def take(self, n: int) -> bytes:
        if not self.has(n):
            raise ValueError("truncated frame")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, offset: int, n: int) -> int:
        if not self.has(offset + n):
            raise ValueError("truncated frame")
        return int.from_bytes(self.data[self.at + offset : self.at + offset + n], "little")

    def frame(self) -> bytes:
        """The next frame: its header, its blocks by their three-byte headers, its checksum."""
        self.has(18)
        head = self.data[self.at : self.at + 18]
        try:
            n, checked = zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum
        except zstandard.ZstdError as e:
            raise ValueError(f"no frame: {e}") from e
        last = False
        while not last:
            block = self.number(n, 3)
            last = bool(block & 1)
            n += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        return self.take(n + 4 * checked)


def read_records(data) -> Iterator[dict]:
    """The records of an archive (bytes or a stream), a frame at a time.

    What can't be read becomes a row whose problem says why; after a frame of unknown length nothing can be
    found, so that row is the last.
    """
    cut = Cut(io.BytesIO(data) if isinstance(data, bytes) else data)
    words = None
    try:
        if cut.has(8) and cut.number(0, 4) == SKIPPABLE:
            own = cut.take(8 + cut.number(4, 4))[8:]
            if own[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
                own = zstandard.ZstdDecompressor().decompressobj().decompress(own)
            words = zstandard.ZstdCompressionDict(own) if own else None
    except (zstandard.ZstdError, ValueError):
        yield {"problem": "truncated dictionary"}
        return
    reader = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    while cut.has(1):
        try:
            if cut.has(8) and cut.number(0, 4) & 0xFFFFFFF0 == 0x184D2A50:
                cut.take(8 + cut.number(4, 4))
                continue
            frame = cut.frame()
        except ValueError as e:
            yield {"problem": str(e)}
            return
        try:
            yield parse_record(reader.decompressobj().decompress(frame))
        except (zstandard.ZstdError, ValueError) as e:
            yield {"problem": str(e) or "bad frame"}


def _headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8")
    return out


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def parse_record(data: bytes) -> dict:
    """A record's row; raises ValueError if its version, headers, lengths or payload digest aren't right."""
    if not re.match(rb"WARC/1\.[01]\r\n", data):
        raise ValueError("no WARC version")
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("unended headers")
    headers = _headers(head)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    if not headers["content-length"].isdigit() or rest[int(headers["content-length"]) :] != b"\r\n\r\n":
        raise ValueError("content-length doesn't match the record")
    block = rest[: int(headers["content-length"])]
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP headers")
    length, kind = _headers(http).get("content-length", ""), headers["warc-type"]
    if not length.isdigit() or kind == "response" and int(length) != len(payload) or kind == "revisit" and payload:
        raise ValueError("payload length doesn't match the HTTP headers")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError("payload digest doesn't match")
    uri = headers.get("warc-target-uri")
    return {
        "record_id": headers["warc-record-id"], "record_type": kind, "page_id": _page(headers["warc-record-id"]), "payload": payload if kind == "response" else None, "payload_bytes": int(length),
        "target_uri": uri and re.sub(r"%([01][0-9A-F]|20|7F|25)", lambda m: chr(int(m[1], 16)), uri), "payload_digest": digest, "refers_to": _page(headers.get("warc-refers-to")),
    }


_KINDS = [("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("problem", pa.string())]


def _batches(records: Iterator[dict], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for r in records:
        rows.append(r)
        held += len(r.get("payload") or b"") + 200
        if held >= most:
            yield pa.RecordBatch.from_pylist(rows, pa.schema(_KINDS))
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema(_KINDS))


def _read(paths: Iterator[str]) -> Iterator[pa.RecordBatch]:
    for path in paths:
        store, at = _store(path)
        with store.open_input_stream(at, compression=None) as f:
            yield from _batches(read_records(f))


def read_archives(manifest: DataFrame) -> DataFrame:
    """RECORDS of the archives that a manifest (its column path) names, each read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _read(batch.column(0).to_pylist())

    return manifest.select("path").repartition(parts(manifest.count(), 1)).mapInArrow(run, RECORDS)


def read_warc(spark: SparkSession, path: str, most: int = 1 << 30) -> DataFrame:
    """RECORDS of all archives under a path.

    Archives of up to ``most`` bytes come through Spark's own reader, which opens whatever Spark can; it
    can't hold larger ones, which are read as streams.
    """
    files = spark.read.format("binaryFile").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield from _batches(read_records(data))

    small = files.filter(F.col("length") <= most).select("content").mapInArrow(run, RECORDS)
    return small.unionByName(read_archives(files.filter(F.col("length") > most).select("path")))
