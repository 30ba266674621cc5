"""WARC records in ZIP-packaged archives: written by tasks, read back by byte ranges without extraction.

An archive is one ZIP file with two stored members: ``archive/data.warc.gz``, a gzip member per
record, and ``indexes/index.tsv`` with a line per record (offset and length inside the data member, id). A
reader looks for the end-of-central-directory record, follows ZIP64 locators where sizes ask for
it, parses the directory, takes the index by range, and then reads each record by its own range.
Paths are URIs of any file system that pyarrow opens. A task names its archive anew on every
attempt and reports the name, so a lost or doubled attempt leaves a file that nobody reads.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharelens.llm.common import small
from sharelens.session import scratch_path, settle

DATA, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
#: Fixed values of the ZIP format: signatures, the value that sends a reader to ZIP64, its extra-field tag.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL32, FULL16, EXTRA64 = 0xFFFFFFFF, 0xFFFF, 0x0001


# ---------------------------------------------------------------- records


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page: str, url: str, kind: str, digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC/1.1 record, gzipped on its own. ``page`` and ``refers_to`` name pages; a revisit carries no payload."""
    block = payload if kind == "response" else b""
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>")] if refers_to is not None else []),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if kind == "revisit" else []),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzipped record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def page_of(urn: str) -> str:
    return urn.removeprefix("<urn:page:").removesuffix(">")


# ---------------------------------------------------------------- ZIP


class StoredZip:
    """Writes stored members one after the other; ZIP64 fields appear where 32 bits are not enough.

    A member's size is not known when it starts, so its local header keeps ZIP64 room and the sizes
    follow in a data descriptor; the central directory is what readers trust.
    """

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, pieces: Iterator[bytes]) -> None:
        start, raw = self.at, name.encode()
        self._write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)
        size = crc = 0
        for piece in pieces:
            crc, size = zlib.crc32(piece, crc), size + len(piece)
            self._write(piece)
        self._write(struct.pack("<IIQQ" if size >= FULL32 else "<IIII", 0x08074B50, crc, size, size))
        self.members.append((raw, start, size, crc))

    def close(self, always64: bool = False) -> None:
        start = self.at
        for raw, offset, size, crc in self.members:
            big = always64 or max(offset, size) >= FULL32
            extra = struct.pack("<HHQQQ", EXTRA64, 24, size, size, offset) if big else b""
            small_size, small_at = (FULL32, FULL32) if big else (size, offset)
            self._write(
                struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, small_size, small_size, len(raw), len(extra), 0, 0, 0, 0, small_at)
                + raw
                + extra
            )
        size, n = self.at - start, len(self.members)
        if always64 or max(start, size) >= FULL32 or n >= FULL16:
            end64 = self.at
            self._write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            start, size, n = FULL32, FULL32, FULL16
        self._write(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, start, 0))


def stored_members(file, length: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset of its bytes, size) of the stored members of a ZIP of ``length`` bytes.

    ``file`` needs ``seek`` and ``read``; what is read is the tail, the directory and the local headers.
    """

    def at(offset: int, size: int) -> bytes:
        file.seek(offset)
        return file.read(size)

    tail_at = max(0, length - 22 - FULL16 - 20)
    tail = at(tail_at, length - tail_at)
    end = tail.rfind(struct.pack("<I", END))
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(struct.pack("<I", END), 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    *_, n, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, end)
    if FULL32 in (size, start) or n == FULL16:
        signature, _, end64, _ = struct.unpack("<IIQI", at(tail_at + end - 20, 20))
        if signature != LOCATOR64:
            raise ValueError("ZIP64 locator is missing")
        signature, *_, n, size, start = struct.unpack("<IQHHIIQQQQ", at(end64, 56))
        if signature != END64:
            raise ValueError("ZIP64 end of central directory is missing")
    directory, place, found = at(start, size), 0, {}
    for _ in range(n):
        fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, place)
        if fields[0] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain, names, extras, comments, offset = fields[4], fields[8], fields[9], *fields[10:13], fields[16]
        name = directory[place + 46 : place + 46 + names].decode()
        extra = directory[place + 46 + names : place + 46 + names + extras]
        place += 46 + names + extras + comments
        while len(extra) >= 4:
            tag, span = struct.unpack_from("<HH", extra)
            if tag == EXTRA64:
                wide = iter(struct.unpack_from(f"<{span // 8}Q", extra, 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            extra = extra[4 + span :]
        if method == 0:
            head = struct.unpack("<IHHHHHIIIHH", at(offset, 30))
            found[name] = (offset + 30 + head[9] + head[10], packed)
    return found


# ---------------------------------------------------------------- Spark


def base32_of(sha1_hex: str | None) -> str | None:
    return base64.b32encode(binascii.unhexlify(sha1_hex)).decode() if sha1_hex is not None else None


def with_roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page, url, html, sha1, kind, refers_to. Only payloads that occur more than once are joined back."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    plain = pages.select(
        F.col("page_id").alias("page"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    several = (
        plain.where(F.octet_length("payload") >= least_bytes)
        .groupBy(F.col("sha1").alias("of"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first"))
        .where("n > 1")
        .select("of", "first")
    )
    several = small(settle(several), 200_000)  # a digest and an id each, about 20 MB
    revisit = F.col("of").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    return plain.join(several, F.col("sha1") == F.col("of"), "left").select(
        "page",
        "url",
        "payload",
        "sha1",
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = 256 << 20) -> DataFrame:
    """Writes every page as a record; returns the archives as rows (path, records, bytes).

    Each task writes archives of up to ``archive_bytes`` below ``folder``. What it holds is one record
    and the index of one archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c for c in batch.columns), strict=True))
        fs, base = pafs.FileSystem.from_uri(folder)
        for first in rows:
            path = f"{base}/{uuid.uuid4().hex}.zip"
            index: list[str] = []

            def records(first=first, index=index):
                at, row = 0, first
                while row is not None:
                    page, url, payload, sha1, kind, refers_to = (x.as_py() for x in row)
                    name = "" if page is None else str(page)
                    data = record_bytes(name, url, kind, base32_of(sha1), refers_to, payload)
                    index.append(f"{at}\t{len(data)}\t{name}\n")
                    at += len(data)
                    yield data
                    row = next(rows, None) if at < archive_bytes else None

            with fs.open_output_stream(path) as out:
                archive = StoredZip(out)
                archive.member(DATA, records())
                archive.member(INDEX, iter(["".join(index).encode()]))
                archive.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [len(index)], "bytes": [archive.at]})

    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return settle(with_roles(pages, least_bytes).mapInArrow(run, "path string, records bigint, bytes bigint"))


def read_records(archives: DataFrame, folder: str, piece: int = 500, task_bytes: int = 64 << 20) -> DataFrame:
    """Reads archives back: page, payload_bytes (null for revisits), payload_digest, record_type, refers_to.

    First the indexes are located and cut into pieces of at most ``piece`` records and an eighth of ``task_bytes``, then the pieces
    are dealt over as many tasks as the archives' bytes ask for, at least one a core. The number is given, so it is not cut down
    because the rows of offsets are few and short.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(path) as file:
                    members = stored_members(file, file.size())
                    (data, _), (at, size) = members[DATA], members[INDEX]
                    file.seek(at)
                    lines = [tuple(map(int, line.split("\t")[:2])) for line in file.read(size).decode().split("\n")[:-1]]
                pieces, full = [], 0
                for line in lines:
                    if not pieces or len(pieces[-1]) >= piece or full + line[1] > task_bytes // 8:
                        pieces.append([])
                        full = 0
                    pieces[-1].append(line)
                    full += line[1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [path] * len(pieces),
                        "start": pa.array([data + p[0][0] for p in pieces], pa.int64()),
                        "sizes": pa.array([[size for _, size in p] for p in pieces], pa.list_(pa.int32())),
                    }
                )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out: dict[str, list] = {k: [] for k in ("page", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                with fs.open_input_file(path) as file:
                    at = start
                    for size in sizes:
                        file.seek(at)
                        headers, block = parse_record(file.read(size))
                        at += size
                        kind, stated = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and digest_of(block) != stated:
                            raise ValueError(f"{path}: payload at {at - size} does not match its digest")
                        refers = headers.get("WARC-Refers-To")
                        out["page"].append(page_of(headers["WARC-Record-ID"]) or None)
                        out["payload_bytes"].append(len(block) if kind == "response" else None)
                        out["payload_digest"].append(stated)
                        out["record_type"].append(kind)
                        out["refers_to"].append(page_of(refers) if refers is not None else None)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    pieces = archives.select("path").mapInArrow(locate, "path string, start bigint, sizes array<int>")
    located = settle(pieces)
    total = located.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda t, x: t + x))).first()[0] or 0
    dealt = located.repartition(max(archives.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes)))
    return dealt.mapInArrow(fetch, "page string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def resolve(records: DataFrame, id_type: str) -> DataFrame:
    """Contract rows: revisits get the size of the payload that they refer to."""
    stored = settle(records)
    full = (
        stored.where("record_type = 'response'")
        .join(stored.where("record_type = 'revisit'").select(F.col("payload_digest").alias("asked")).distinct(), F.col("payload_digest") == F.col("asked"), "left_semi")
        .groupBy(F.col("payload_digest").alias("of"))
        .agg(F.first("payload_bytes").alias("full"))
    )
    return stored.join(full, F.col("payload_digest") == F.col("of"), "left").select(
        F.col("page").cast(id_type).alias("page_id"),
        F.coalesce("payload_bytes", "full").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"),
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back, one row per page.

    Of pages with equal payloads of at least ``least_bytes`` that with the smallest id is the response,
    the others revisit it. Null html: empty payload. Rows that repeat both the smallest id and the payload are
    all responses; a null id is read back as null and revisits any page with an id. An empty table
    gives an empty result. Other columns are ignored.
    """
    folder = scratch_path(pages.sparkSession, "archives")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    archives = write_archives(pages, folder, least_bytes)
    return resolve(read_records(archives, folder), pages.schema["page_id"].dataType.simpleString())


def archive_sql() -> str:
    """The query's rows in DuckDB's SQL; base32 is spelled out over 5-bit groups of the SHA-1."""
    five = "CAST(('0x' || substr(h, 10 * (k // 8) + 1, 10)) AS BIGINT) >> (35 - 5 * (k % 8)) & 31"
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({five} AS INT) + 1, 1)), 'string_agg', '') AS digest,
  min(page_id) AS first FROM (SELECT * FROM p) GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN d USING (h)"""
