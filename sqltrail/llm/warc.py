"""Web archives packed in ZIP files: written by Spark tasks and read by range, without extraction.

Writing: each task packs its pages into archives of bounded size. An archive is a ZIP file with stored
members: ``archive/data.warc.gz`` (WARC 1.1, each record a gzip member of its own), ``indexes/index.cdxj``
(one line a record: key, date and JSON with offset and length) and ``datapackage.json``. File names are
unique for each attempt, and only names reported by tasks that ended well are in the returned manifest.

Pages with equal payloads become one response and revisits of it. Payload digests are grouped (combined
before the shuffle), and only digests with several pages are joined back, so a payload that a third of all
pages share costs one row there and is salted in the join.

Reading: a task parses the central directory from the end of each archive (ZIP64 too), locates the stored
index and archive members, and turns the index into ranges of about ``RANGE`` bytes. The ranges are dealt
over all tasks; each is read with one seek and its records are parsed one by one. An archive without an
index gives one range for each archive member.

Defined cases: a null html is an empty payload; empty payloads are equal payloads like others. A null url
is an empty one; blanks and control characters in it are percent-encoded. A null ``page_id`` is kept as
null; among equal payloads the smallest id that is not null is the response, and without any id all are
responses. Repeated rows with the response's id are responses too. An empty table gives no archive. Other
columns are not read. A very long payload is one record, held whole by the task that writes or reads it. A broken archive raises ``ValueError`` and names the file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, new_folder, salted_join, stored

DATE = "2024-01-01T00:00:00Z"
RECORDS, BYTES, RANGE = 20_000, 256 << 20, 4 << 20
_NO_ID = "null"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri) if ":" in uri else f"file://{uri}")


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


# ------------------------------------------------------------------ writing


def _name(page_id: int | None) -> str:
    return f"<urn:page:{_NO_ID if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which holds the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class ArchiveWriter:
    """Packs records into one ZIP archive; index lines are kept until the end, so records are bounded."""

    def __init__(self, folder: str):
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        self.uri = f"{folder}/{name}"
        self.stream = system.open_output_stream(f"{path}/{name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, raw: bytes, url: str | None, digest: str) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        self.member.write(packed)
        about = {"url": url or "", "digest": f"sha1:{digest}", "offset": self.size, "length": len(packed), "filename": "data.warc.gz"}
        self.lines.append(f"{_CONTROL.sub('', url or '-')} {re.sub(r'[^0-9]', '', DATE)} {json.dumps(about)}\n")
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", "".join(self.lines))
        parts = [{"name": "data.warc.gz", "path": "archive/data.warc.gz"}, {"name": "index.cdxj", "path": "indexes/index.cdxj"}]
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": parts}))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines), self.size


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, sha1, refers_to`` of each page."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_bytes)
    firsts = large.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    firsts = stored(firsts, "equal-payloads")
    joined = salted_join(rows, firsts.select("sha1", "first"), ["sha1"], ["page_id"], hot_keys(firsts, ["sha1"], "n"), "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "sha1", refers_to.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, records: int = RECORDS, size: int = BYTES) -> DataFrame:
    """Write the rows of ``with_revisits`` and return the stored manifest ``path, records, bytes``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, done = None, []
        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(batch[c].astype(object) for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                writer = writer or ArchiveWriter(folder)
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                url, digest = (None if pd.isna(url) else url), base32(sha1)
                writer.add(record(page_id, url, bytes(payload), digest, refers_to), url, digest)
                if len(writer.lines) >= records or writer.size >= size:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return stored(rows.mapInPandas(run, "path string, records long, bytes long"), "warc-manifest")


# ------------------------------------------------------------------ reading


def members(source, size: int, name: str = "archive") -> Iterator[tuple[str, int, int, int]]:
    """Name, method, packed size and place of the data of each member, by the central directory."""

    def at(offset: int, n: int) -> bytes:
        source.seek(offset)
        return source.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    found = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))
    while found >= 0 and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] != len(tail):
        found = tail.rfind(b"PK\x05\x06", 0, found)
    if found < 0:
        raise ValueError(f"{name}: no end of a central directory")
    count, length, offset = struct.unpack_from("<HII", tail, found + 10)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, offset):
        locator = at(tail_at + found - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError(f"{name}: no ZIP64 locator")
        end = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError(f"{name}: no ZIP64 end of a central directory")
        count, length, offset = struct.unpack_from("<QQQ", end, 32)
    place, stop = offset, offset + length
    for _ in range(count):
        fixed = at(place, 46)
        if fixed[:4] != b"PK\x01\x02" or place >= stop:
            raise ValueError(f"{name}: broken central directory")
        method = struct.unpack_from("<H", fixed, 10)[0]
        packed, plain, names, extras, notes = struct.unpack_from("<IIHHH", fixed, 20)
        header = struct.unpack_from("<I", fixed, 42)[0]
        more = at(place + 46, names + extras)
        title, extra = more[:names].decode("utf-8", "replace"), more[names:]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the fields that did not fit, in this order
                values = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        local = at(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: broken member {title}")
        yield title, method, packed, header + 30 + sum(struct.unpack_from("<HH", local, 26))
        place += 46 + names + extras + notes


def _lines(source, start: int, length: int) -> Iterator[bytes]:
    """Lines of a stored member, read block by block."""
    rest, at, stop = b"", start, start + length
    while at < stop:
        source.seek(at)
        data = source.read(min(1 << 20, stop - at))
        if not data:
            raise ValueError("an archive ends within a member")
        at += len(data)
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def ranges(uri: str, most: int = RANGE) -> Iterator[tuple[str, int, int]]:
    """Ranges of an archive's file that hold whole records, next to each other and about ``most`` bytes long."""
    system, path = _open(uri)
    with system.open_input_file(path) as source:
        found = {}
        for name, method, packed, start in members(source, source.size(), uri):
            if method and re.match(r"(archive|indexes)/.", name):
                raise ValueError(f"{uri}: {name} is not stored but compressed")
            found[name] = (start, packed)
        indexed: dict[str, list[tuple[int, int]]] = {}
        for name in (n for n in found if re.search(r"^indexes/.*\.cdxj?$", n)):
            for line in _lines(source, *found[name]):
                if b"{" in line:
                    about = json.loads(line[line.index(b"{") :])
                    indexed.setdefault(f"archive/{about['filename']}", []).append((int(about["offset"]), int(about["length"])))
        for name in (n for n in found if re.search(r"^archive/.*\.warc(\.gz)?$", n)):
            start, packed = found[name]
            if name not in indexed:
                yield uri, start, packed
                continue
            from_, to = None, None
            for offset, length in sorted(indexed[name]):
                if from_ is not None and (offset != to or to - from_ + length > most):
                    yield uri, start + from_, to - from_
                    from_ = None
                from_ = offset if from_ is None else from_
                to = offset + length
            if from_ is not None:
                yield uri, start + from_, to - from_


def _plain(source, start: int, length: int) -> Iterator[bytes]:
    """Bytes of a range in blocks, gzip members unpacked."""
    at, stop, packer = start, start + length, None
    source.seek(start)
    zipped = source.read(2) == b"\x1f\x8b"
    while at < stop:
        source.seek(at)
        data = source.read(min(1 << 20, stop - at))
        if not data:
            raise ValueError("an archive ends within a range")
        at += len(data)
        while data:
            if not zipped:
                yield data
                break
            packer = packer or zlib.decompressobj(31)
            yield packer.decompress(data)
            data = packer.unused_data
            if packer.eof:
                packer = None
            elif not data:
                break


def records(uri: str, start: int, length: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record in a range."""
    system, path = _open(uri)
    with system.open_input_file(path) as source:
        held = bytearray()
        data = _plain(source, start, length)

        def need(enough) -> bool:
            while not enough():
                more = next(data, None)
                if more is None:
                    return False
                held.extend(more)
            return True

        while True:
            need(lambda: len(held.lstrip(b"\r\n")) > 0)
            del held[: len(held) - len(held.lstrip(b"\r\n"))]
            if not held:
                return
            if not need(lambda: b"\r\n\r\n" in held):
                raise ValueError(f"{uri}: a record's head has no end")
            cut = held.index(b"\r\n\r\n")
            version, *lines = held[:cut].decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"{uri}: no record where one should begin")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            n = int(fields["content-length"])
            if not need(lambda: len(held) >= cut + 4 + n):  # noqa: B023
                raise ValueError(f"{uri}: a record's block has no end")
            block = bytes(held[cut + 4 : cut + 4 + n])
            del held[: cut + 4 + n]
            yield fields, block


def _id(urn: str | None) -> int | None:
    found = re.search(r"urn:page:(-?\d+)", urn or "")
    return int(found[1]) if found else None


def read_archives(manifest: DataFrame, parts: int | None = None) -> DataFrame:
    """Records of the archives in ``manifest`` (column ``path``), each with what its head and payload say.

    ``digest_ok``: the payload's own digest is the one in the head (null for a revisit, which has none).
    """
    parts = parts or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["path"]:
                yield pd.DataFrame(list(ranges(uri)), columns=["path", "start", "length"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, start, length in zip(batch["path"], batch["start"], batch["length"], strict=True):
                out = []
                for fields, block in records(uri, start, length):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    declared = fields.get("warc-payload-digest", "").partition(":")[2]
                    kind, ok = fields.get("warc-type", ""), None
                    if kind == "revisit":
                        size = int(re.search(rb"(?i)content-length:\s*(\d+)", head)[1])
                    else:
                        size, ok = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode() == declared
                    out.append((_id(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, declared, kind, _id(fields.get("warc-refers-to")), ok, payload if kind != "revisit" else None))
                    if len(out) >= 500:
                        yield _table(out)
                        out = []
                yield _table(out)

    placed = manifest.select("path").repartition(parts, "path").mapInPandas(locate, "path string, start long, length long")
    dealt = placed.repartition(parts, "path", "start")
    return dealt.mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, payload binary")


def _table(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok", "payload"]
    return pd.DataFrame(rows, columns=names, dtype=object).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64", "digest_ok": "boolean"})


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    folder = new_folder(spark, "warc")
    manifest = write_archives(with_revisits(pages, min_bytes), folder)
    return read_archives(manifest)


def report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Per page: size and digest of its payload, its record's type and what it refers to; a wrong digest raises."""
    rows = round_trip(spark, pages)
    sound = F.when(F.col("digest_ok") | F.col("digest_ok").isNull(), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload of page "), F.col("page_id").cast("string"), F.lit(" does not have its digest")))
    )
    return rows.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")
