"""WARC records packed in ZIP archives: written by tasks, read back by range, never extracted.

An archive has two stored (uncompressed) members: `archive/data.warc.gz`, one gzip member for each
record, and `indexes/index.cdxj`, a line for each record with its offset and length. The reader finds the
end record of the ZIP, its ZIP64 twin, the central directory and the local headers by itself, locates all members below
`indexes/` and the stored members that their lines name, and reads these records in ranges. So it also reads archives of others: with several
data files, plain or packed indexes of either form, records that are not packed, data in front of the archive, and names of old writers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attempt_name, open_for_read, open_for_write, shared_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads of at least so many bytes are stored once; an archive is closed beyond ARCHIVE_BYTES.
REVISIT_BYTES, ARCHIVE_BYTES = 1000, 24 << 20
#: Neighbouring records are read in one range of up to so many bytes.
RANGE_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
_BIG16, _BIG32 = 0xFFFF, 0xFFFFFFFF


# ---- ZIP -------------------------------------------------------------------------------------


def write_zip(out, members: list[tuple[str, bytes]], zip64: bool = False) -> None:
    """Stored members; ZIP64 fields where a size or place needs them, or everywhere if zip64 is set."""
    central, place = [], 0
    for name, data in members:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or size >= _BIG32 or place >= _BIG32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        out.write(struct.pack("<4s5H3I2H", b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, _BIG32 if wide else size, _BIG32 if wide else size, len(raw), len(extra)) + raw + extra)
        out.write(data)
        more = struct.pack("<HHQQQ", 1, 24, size, size, place) if wide else b""
        central.append(
            struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, _BIG32 if wide else size, _BIG32 if wide else size, len(raw), len(more), 0, 0, 0, 0, _BIG32 if wide else place) + raw + more
        )
        place += 30 + len(raw) + len(extra) + size
    directory = b"".join(central)
    out.write(directory)
    n = len(members)
    wide = zip64 or n >= _BIG16 or place >= _BIG32 or len(directory) >= _BIG32
    if wide:
        out.write(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(directory), place))
        out.write(struct.pack("<4sIQI", b"PK\6\7", 0, place + len(directory), 1))
    out.write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, _BIG16 if wide else n, _BIG16 if wide else n, _BIG32 if wide else len(directory), _BIG32 if wide else place, 0))


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int
    start: int | None = None


class ZipIndex:
    """The members of a ZIP file, from its directories alone."""

    def __init__(self, source, size: int):
        self.source = source
        tail_at = max(0, size - 22 - _BIG16)
        tail = self._at(tail_at, size - tail_at)
        end = tail.rfind(b"PK\5\6", 0, max(0, len(tail) - 18))
        while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
            end = tail.rfind(b"PK\5\6", 0, end)  # the mark can also stand in a comment
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP archive")
        n, length, place = struct.unpack_from("<H2I", tail, end + 10)
        end_at = tail_at + end
        if end_at >= 20 and (locator := self._at(end_at - 20, 20))[:4] == b"PK\6\7":
            (at,) = struct.unpack_from("<Q", locator, 8)
            record = self._at(at, 56)
            if record[:4] != b"PK\6\6":
                at = end_at - 20 - 56  # data stand in front: the record stands before its locator
                record = self._at(at, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("ZIP64 end record is not where its locator says")
            end_at = at
            n, length, place = struct.unpack_from("<3Q", record, 32)
        self.members: dict[str, Member] = {}
        # data in front of the archive move everything by as much as the directory is off its place
        self.shift = end_at - length - place
        directory, at = self._at(place + self.shift, length), 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("damaged central directory")
            (flags,) = struct.unpack_from("<H", directory, at + 8)
            method, packed, plain, names, extras, comments, header = *struct.unpack_from("<H", directory, at + 10), *struct.unpack_from("<2I3H", directory, at + 20), *struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437", "replace")
            extra = directory[at + 46 + names : at + 46 + names + extras]
            while len(extra) >= 4:
                tag, long = struct.unpack_from("<2H", extra)
                if tag == 1:  # the fields that are full, in this order
                    wide = list(struct.unpack_from(f"<{long // 8}Q", extra, 4))
                    plain = wide.pop(0) if plain == _BIG32 else plain
                    packed = wide.pop(0) if packed == _BIG32 else packed
                    header = wide.pop(0) if header == _BIG32 else header
                extra = extra[4 + long :]
            self.members[name] = Member(name, method, packed, header + self.shift)
            at += 46 + names + extras + comments

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def start(self, name: str) -> int:
        """Where the data of a stored member begin."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored: no range of it can be read")
        if member.start is None:
            local = self._at(member.header, 30)
            if local[:4] != b"PK\3\4":
                raise ValueError(f"no local header of {name}")
            member.start = member.header + 30 + sum(struct.unpack_from("<2H", local, 26))
        return member.start

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        return self._at(self.start(name) + at, self.members[name].size - at if n is None else n)


# ---- WARC ------------------------------------------------------------------------------------


def one_line(url: str) -> str:
    """A url that stands in one line of a header or index."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", one_line(url)))
        if one_line(url) != url:  # so that it reads back as it was
            fields.append(("X-Target-URI-JSON", json.dumps(url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Truncated", "length")]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(lines.encode() + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and block of a record, packed or plain."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def _page(urn: str | None) -> int | None:
    """The page in a record id of ours; None for others."""
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(number) if number.removeprefix("-").isdigit() else None


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (None for a revisit) of a record.

    The payload of a response is what follows its HTTP head, that of other records their block. A response's digest is computed from its payload and must be the SHA-1 in its header, if one
    is there. A revisit has the size and digest of its headers (null without them), since its payload is elsewhere.
    """
    kind, http = fields.get("warc-type"), block.startswith(b"HTTP/")
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    said = fields.get("warc-payload-digest", "")
    named = base64.b32decode(said[5:].upper()).hex() if said.lower().startswith("sha1:") and len(said) == 37 else None
    url = json.loads(fields["x-target-uri-json"]) if "x-target-uri-json" in fields else fields.get("warc-target-uri")
    page, refers = _page(fields.get("warc-record-id")), _page(fields.get("warc-refers-to"))
    if kind == "revisit":
        sizes = [line.partition(b":")[2] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        return page, url, int(sizes[0]) if sizes else None, named, kind, refers, None
    digest = hashlib.sha1(payload).hexdigest()
    if kind == "response" and http and named is not None and named != digest:
        raise ValueError(f"damaged payload in {fields.get('warc-record-id')}")
    return page, url, len(payload), digest, kind, refers, payload


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages with digest (hex SHA-1 of the payload) and refers_to: the largest page_id of an equal payload of at least
    `least` bytes, null for that page itself, for payloads that occur once and for smaller ones."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", "html").withColumn("digest", F.sha1(payload)).withColumn("_n", F.octet_length(payload))
    groups = hashed.filter(F.col("_n") >= least).groupBy("digest").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").drop("_rows")
    # written, so that its size is known: the planner broadcasts it below its threshold and joins by shuffle beyond
    groups = written(groups, "warc-groups")
    refers = F.when((F.col("_n") >= least) & ~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return hashed.join(groups, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of pages(page_id long, url, html) and returns the manifest (file, records, bytes).

    Null html is an empty payload, a null url leaves the header out (one with line ends is escaped there and kept whole beside it), a null page_id has an empty record id and
    refers to the page of its payload that has one. Repeated rows of the largest page_id are all responses. An
    empty table writes nothing. The manifest lists the files of finished tasks only.
    """
    folder = folder or shared_path(pages.sparkSession, "warc")

    def run(batches):
        data, lines, held = [], [], 0

        def close():
            nonlocal data, lines, held
            name = f"{folder}/{attempt_name('pages')}.wacz"
            index = "".join(sorted(lines)).encode()
            with open_for_write(name) as out:
                write_zip(out, [(DATA, b"".join(data)), (INDEX, index)])
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)], pa.int64()), pa.array([held], pa.int64())], ["file", "records", "bytes"])
            data, lines, held = [], [], 0
            return row

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                raw = record(page_id, url, (html or "").encode(), digest, refers)
                entry = {"page": page_id, "offset": held, "length": len(raw), "filename": DATA}
                lines.append(f"{one_line(url or '-').replace(' ', '%20')} {DATE} {json.dumps(entry)}\n")
                data.append(raw)
                held += len(raw)
                if held >= archive_bytes:
                    yield close()
        if lines:
            yield close()

    ready = revisits(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    return written(ready.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


def index_spans(text: str) -> list[tuple[str, int, int]]:
    """(file, offset, length) of each line of an index: JSON behind key and time, or columns by the letters of a first line (V offset, S length, g file)."""
    spans, letters = [], []
    for line in text.split("\n"):
        line = line.strip("\r")
        if line.lstrip().startswith("CDX "):
            letters = line.split()[1:]
        elif " {" in line:
            entry = json.loads(line[line.index(" {") + 1 :])
            spans.append((entry["filename"], int(entry["offset"]), int(entry["length"])))
        elif letters and line.strip():
            entry = dict(zip(letters, line.split(" ")))
            spans.append((entry["g"], int(entry["V"]), int(entry["S"])))
    return spans


def records_in(source, size: int):
    """(fields, block) of every record that an archive's indexes name, in the order of their places; a record that several lines name comes once."""
    archive = ZipIndex(source, size)
    indexes = sorted(m for m in archive.members if m.startswith("indexes/") and m.removesuffix(".gz").endswith((".cdx", ".cdxj")))
    if not indexes:
        raise ValueError("archive without an index")
    spans: dict[str, set[tuple[int, int]]] = {}
    for name in indexes:
        raw = archive.read(name)
        for file, at, n in index_spans((gzip.decompress(raw) if name.endswith(".gz") else raw).decode()):
            place = next((m for m in (file, f"archive/{file}") if m in archive.members), None)
            if place is None:
                raise ValueError(f"the index names {file}, which the archive does not have")
            spans.setdefault(place, set()).add((at, n))
    for place in sorted(spans):
        yield from _records_of(archive, place, sorted(spans[place]))


def _records_of(archive: ZipIndex, place: str, spans: list[tuple[int, int]]):
    i = 0
    while i < len(spans):
        j, begin = i + 1, spans[i][0]
        while j < len(spans) and spans[j][0] == sum(spans[j - 1]) and sum(spans[j]) - begin <= RANGE_BYTES:
            j += 1
        chunk = archive.read(place, begin, sum(spans[j - 1]) - begin)
        for at, n in spans[i:j]:
            yield parse_record(chunk[at - begin : at - begin + n])
        i = j


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in manifest(file): page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and payload (null for revisits) if payloads is set."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if payloads else 6]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open_for_read(name) as source:
                    rows, held = [], 0
                    for fields, block in records_in(source, source.size()):
                        rows.append(page_of(fields, block))
                        held += len(block)
                        if len(rows) == 2000 or held > RANGE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows))[: len(names)], kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows))[: len(names)], kinds)], names)

    files = manifest.count()
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    # dealt in turn, not by a hash, so that no task gets several archives while others get none
    return manifest.select("file").repartition(min(max(files, 1), 4096)).mapInArrow(run, schema)
