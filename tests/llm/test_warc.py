import base64
import hashlib

import zstandard

from casefuse.llm import warc
from casefuse.llm.queries import QUERIES


def pages(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, b"x", "y") for r in rows],
        "page_id long, url string, html string, at long, payload binary, sha1 string")


def expected(rows, least=0):
    first = {}
    for i, h in sorted(((r[0], r[2] or "") for r in rows), key=lambda x: (x[0] is None, x[0])):
        first.setdefault(h, i)
    out, used = [], set()
    for i, _, h in rows:
        h = h or ""
        data = h.encode()
        new = len(data) < least or first[h] == i and h not in used
        if new and len(data) >= least:
            used.add(h)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if new else "revisit", None if new else first[h]))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()
    assert collected(QUERIES["op6_warc_dictionary"](spark, sf)) == expected([tuple(r) for r in rows])


def test_awkward_rows(spark):
    rows = [(3, "http://a/x y\r\nZ: 1", "same"), (1, None, "same"), (2, "u", "same"), (2, "u", "same"),
            (None, "u", "same"), (5, "u", None), (4, "u", ""), (None, None, "only null ids"),
            (None, None, "only null ids"), (6, "é", "WARC/1.1\r\n\r\n" * 5), (7, "u", "ü" * 300000)]
    df = pages(spark, rows)
    assert collected(warc.archive_pages(df)) == expected(rows)
    assert collected(warc.archive_pages(df, least_bytes=5)) == expected(rows, 5)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_archives_are_frames_behind_a_dictionary(spark, tmp_path):
    """Payloads come back whole, each record is a frame of its own, archives stay below their size."""
    html = [f"<html><p>page {i} of the same site, same frame and menu</p>{'x' * i}" for i in range(400)]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(html)]
    payloads = warc.written(warc.payload_rows(pages(spark, rows), "page_id", "url", "html"), "p")
    archives = warc.write_archives(payloads, str(tmp_path), archive_bytes=8000)
    listed = archives.collect()
    assert len(listed) > 1 and sum(r.n_records for r in listed) == 400
    got = warc.read_archives(archives, payloads=True).collect()
    assert {(r.page_id, r.payload.decode()) for r in got} == set(enumerate(html))
    for r in listed:
        data = open(r.path, "rb").read()
        assert len(data) == r.n_bytes
        assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
        size = int.from_bytes(data[4:8], "little")
        known = warc._loaded(zstandard.decompress(data[8:8 + size]))
        rest, n = data[8 + size:], 0
        while rest:
            one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, n = one.unused_data, n + 1
        assert n == r.n_records


def test_a_changed_payload_is_noticed(spark, tmp_path):
    out = warc.ArchiveWriter(f"{tmp_path}/x.warc.zst", b"")
    data = warc.record(1, "u", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), 0)
    out.add(data.replace(b"abc", b"abd"))
    out.close()
    headers, block = next(warc.read_records(warc.open_archive(f"{tmp_path}/x.warc.zst")[1]))
    try:
        warc._parsed(headers, block)
    except ValueError:
        return
    raise AssertionError("not noticed")
