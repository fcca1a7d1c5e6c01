from __future__ import annotations

import base64
import hashlib
import io
import zipfile

import numpy as np
import pytest
from alertloom.llm import urlfilter, warc
from alertloom.llm.files import RangeReader
from alertloom.llm.queries import URL_RULES
from alertloom.storage import scratch_path
from pyspark.sql import functions as F

URLS = [
    "https://a.example.org/en/12", "HTTP://EXAMPLE.org/es/", None, "nope", "x://org", "x://.org/", "x://org./", "x://forg/", "x://a.com/de/x?q://org/",
    "x://a.com/fr/\n?", "", "://", "https://a.example.org/en/12", "https://example.com/de/", "http://ex.org:80/", "a://" + "b." * 400 + "org/" + "c" * 3000, "x://Ä.COM/de/",
]


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("rules", [URL_RULES, [("block", "org", ""), ("allow", "example.org", "/en/12"), ("block", "com", "/de/x")], []])
def test_verdicts_equal_brute_force(spark, rules):
    pages = spark.createDataFrame([(i, u, "own", "own", "own") for i, u in enumerate(URLS)], "page_id long, url string, rule string, host string, key_host string")
    listed = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, listed).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(URLS)}
    assert urlfilter.filter_urls(pages.limit(0), listed).count() == 0


def test_bloom_passes_every_key_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("h"), "id").alias("h"), F.lit("/").alias("p"))
    hashes = urlfilter._hashes(F.col("h"), F.col("p"))
    bloom = urlfilter.BlockedBloom.of(keys, *hashes, 20_000)
    rows = np.array(keys.select(*hashes).collect(), np.int64)
    assert bloom.passes(rows[:, 0].copy(), rows[:, 1].copy()).all()
    other = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, (50_000, 2))
    assert bloom.passes(other[:, 0].copy(), other[:, 1].copy()).mean() < 0.02


def test_a_small_filter_only_passes_more(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_WORDS", 8)
    rules = [("block", f"h{i}.org", "/") for i in range(3000)]
    pages = spark.createDataFrame([(i, f"http://h{i}.org/x") for i in range(2990, 3010)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    assert got == {i: "block" if i < 3000 else "allow" for i in range(2990, 3010)}


PAGES = [(1, "u", "x"), (2, "u\r\n b", "x"), (2, None, "x"), (None, "q", "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 10), (6, "u", "long " * 400_000), (None, None, "alone"), (None, None, "alone")]


def expected(pages, min_bytes=0):
    largest, out = {}, []
    for page, _, html in pages:
        if page is not None:
            largest[html or ""] = max(largest.get(html or "", page), page)
    for page, _, html in pages:
        data = (html or "").encode()
        keeper = largest.get(html or "")
        revisit = len(data) >= min_bytes and keeper is not None and keeper != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 2])
def test_pages_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*p, "own", "own") for p in PAGES], "page_id long, url string, html string, path string, keeper string")
    got = warc.archive_pages(pages, min_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(PAGES, min_bytes)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_packages_open_with_other_readers(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.write_packages(warc.mark_copies(pages), scratch_path(spark, "packages")).collect()
    assert sum(r.records for r in rows) == len(PAGES)
    for row in rows:
        with RangeReader(row.path) as file:
            data, members = file.at(0, file.size), warc.central_directory(file)
        archive = zipfile.ZipFile(io.BytesIO(data))
        assert archive.testzip() is None and archive.namelist() == [m.name for m in members]
        assert [i.compress_type for i in archive.infolist()] == [0, 0]


def test_rolling_makes_several_packages(spark, monkeypatch):
    writer = warc.PackageWriter(scratch_path(spark, "roll") + "/a.zip")
    monkeypatch.setattr(warc, "ROLL_RECORDS", 2)
    writer.add(1, None, b"x", None, False)
    assert not writer.full
    writer.add(2, None, b"x", None, False)
    assert writer.full and writer.close()[1] == 2


class Bytes:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def at(self, offset, length):
        return self.data[offset : offset + length]


def test_zip64_directory_and_comment():
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w") as archive:
        for name in ("archive/data.warc.gz", "indexes/index.cdxj"):
            with archive.open(name, "w", force_zip64=True) as member:
                member.write(name.encode())
        archive.comment = b"PK\x05\x06 in a comment"
    plain = Bytes(stream.getvalue())
    members = warc.central_directory(plain)
    assert [plain.at(warc.data_offset(plain, m), m.size) for m in members] == [m.name.encode() for m in members]
    # The same directory with its numbers moved to ZIP64 records.
    data = stream.getvalue()
    end = data.rfind(b"PK\x05\x06", 0, len(data) - 22)
    count, size, start = 2, int.from_bytes(data[end + 12 : end + 16], "little"), int.from_bytes(data[end + 16 : end + 20], "little")
    record = b"PK\x06\x06" + (44).to_bytes(8, "little") + bytes(2 + 2 + 4 + 4) + b"".join(x.to_bytes(8, "little") for x in (count, count, size, start))
    locator = b"PK\x06\x07" + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    tail = b"PK\x05\x06" + bytes(4) + b"\xff" * 12 + bytes(2)
    wide = Bytes(data[:end] + record + locator + tail)
    assert warc.central_directory(wide) == members
    assert warc._zip64(b"\x01\x00\x10\x00" + (5).to_bytes(8, "little") + (6).to_bytes(8, "little"), [0xFFFFFFFF, 7, 0xFFFFFFFF]) == [5, 7, 6]


def test_damaged_payload_is_noticed():
    record = warc.record_bytes(1, "u", b"payload", None, False)
    assert warc.parse_record(record)["payload_bytes"] == 7
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(record.replace(b"payload\r\n", b"PAYLOAD\r\n"))
