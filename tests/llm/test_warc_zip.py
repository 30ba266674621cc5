"""ZIP archives: our reader on our and others' archives, ZIP64, range reads, the round trip."""

import base64
import gzip
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sharelens.llm import warc_zip


def written(members, **how):
    out = io.BytesIO()
    archive = warc_zip.StoredZip(out)
    for name, data in members.items():
        archive.member(name, iter([data[: len(data) // 2], data[len(data) // 2 :]]))
    archive.close(**how)
    return out.getvalue()


MEMBERS = {"archive/data.warc.gz": b"x" * 1000 + bytes(range(256)), "indexes/index.tsv": b"", "né.txt": b"PK\x05\x06 in the data"}


@pytest.mark.parametrize("always64", [False, True])
def test_written_archives_are_zip_files(always64):
    data = written(MEMBERS, always64=always64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == MEMBERS
    found = warc_zip.stored_members(io.BytesIO(data), len(data))
    assert {n: data[at : at + size] for n, (at, size) in found.items()} == MEMBERS


def test_reads_others_archives_with_comment_and_skips_compressed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"stored", zipfile.ZIP_STORED)
        z.writestr("b", b"packed" * 100, zipfile.ZIP_DEFLATED)
        with z.open("c", "w", force_zip64=True) as member:
            member.write(b"wide")
        z.comment = b"PK\x05\x06 a comment that looks like an end"
    data = out.getvalue()
    found = warc_zip.stored_members(io.BytesIO(data), len(data))
    assert {n: data[at : at + size] for n, (at, size) in found.items()} == {"a": b"stored", "c": b"wide"}


@pytest.mark.parametrize("data", [b"", b"not a zip", written(MEMBERS)[:-1], written(MEMBERS)[:200]])
def test_broken_archives_are_refused(data):
    with pytest.raises(ValueError):
        warc_zip.stored_members(io.BytesIO(data), len(data))


def test_record_round_trip():
    body = "é\r\n\r\nWARC/1.1\r\n😀".encode()
    headers, block = warc_zip.parse_record(warc_zip.record_bytes("7", "http://x/\n", "response", warc_zip.digest_of(body), None, body))
    assert block == body and warc_zip.page_of(headers["WARC-Record-ID"]) == "7" and "WARC-Refers-To" not in headers
    headers, block = warc_zip.parse_record(warc_zip.record_bytes("8", "", "revisit", "D", "7", body))
    assert block == b"" and warc_zip.page_of(headers["WARC-Refers-To"]) == "7"


PAGES = [
    (5, "http://a/", "<p>same</p>"), (3, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://c/", None), (2, "", ""),
    (7, "http://d/", "é" * 300_000), (None, "http://e/", "<p>same</p>"), (None, "http://f/", "alone"), (4, "http://g/", "\x00\r\n\r\n"),
]


def pages(spark):
    table = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3)
    return table.select("*", *(F.lit("x").alias(c) for c in "page payload sha1 kind of first n path refers_to".split()))


def want(least=0):
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    rows = []
    for page, _, text in PAGES:
        size = len((text or "").encode())
        same = [p for p, _, t in PAGES if (t or "") == (text or "") and p is not None]
        revisit = size >= least and len([1 for _, _, t in PAGES if (t or "") == (text or "")]) > 1 and page != min(same)
        rows.append((page, size, digest(text), "revisit" if revisit else "response", min(same) if revisit else None))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    assert sorted((tuple(r) for r in warc_zip.round_trip(pages(spark), least).collect()), key=repr) == want(least)


def test_empty_table(spark):
    assert warc_zip.round_trip(pages(spark).where("false")).count() == 0


def test_many_archives_and_pieces(spark, tmp_path):
    folder = f"file://{tmp_path}"
    table = spark.range(500).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.col("id").cast("string").alias("html"))
    archives = warc_zip.write_archives(table.coalesce(1), folder, archive_bytes=10_000)
    assert archives.count() > 5 and archives.agg(F.sum("records")).first()[0] == 500
    records = warc_zip.read_records(archives, folder, piece=7).collect()
    assert sorted(int(r.page) for r in records) == list(range(500))
    size = archives.agg(F.sum("bytes")).first()[0]
    assert warc_zip.read_records(archives, folder, task_bytes=2000).rdd.getNumPartitions() >= size // 4000 > 8
    path = archives.first().path
    with zipfile.ZipFile(path) as z:
        data = z.read(warc_zip.DATA)
        line = z.read(warc_zip.INDEX).decode().splitlines()[1].split("\t")
    assert gzip.decompress(data[int(line[0]) : int(line[0]) + int(line[1])]).startswith(b"WARC/1.1")


def test_damaged_record_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}"
    body = b"payload"
    data = warc_zip.record_bytes("1", "", "response", warc_zip.digest_of(b"other"), None, body)
    with open(tmp_path / "x.zip", "wb") as out:
        archive = warc_zip.StoredZip(out)
        archive.member(warc_zip.DATA, iter([data]))
        archive.member(warc_zip.INDEX, iter([f"0\t{len(data)}\t1\n".encode()]))
        archive.close()
    archives = spark.createDataFrame([(str(tmp_path / "x.zip"),)], "path string")
    with pytest.raises(Exception, match="does not match its digest"):
        warc_zip.read_records(archives, folder).collect()
