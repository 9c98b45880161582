from __future__ import annotations

import gzip
import io

import pytest

from chronolith.llm import warc as W
from chronolith.llm.common import scratch

PAGES = "page_id long, url string, html string, payload_bytes string"


def read(spark, rows, least=0):
    path = scratch(spark, "warc-test")
    W.write_archives(spark.createDataFrame(rows, PAGES), path, least_bytes=least)
    found = W.read_archives(spark, path, with_payload=True)
    return path, found, W.resolved(found)


def test_revisits_resolve_to_the_smallest_id(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né😀"
    rows = [(5, "http://b", "same", "x"), (3, "http://a", "same", "x"), (9, None, "same", "x"), (4, "http://c\r\nX: y", tricky, "x"), (6, "u", None, "x"), (7, "u", "", "x"), (8, "u", "solo", "x")]
    _, found, resolved = read(spark, rows)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"], r["html"]) for r in resolved.collect()}
    assert got == {
        3: ("response", None, 4, "same"), 5: ("revisit", 3, 4, "same"), 9: ("revisit", 3, 4, "same"), 4: ("response", None, len(tricky.encode()), tricky),
        6: ("response", None, 0, ""), 7: ("revisit", 6, 0, ""), 8: ("response", None, 4, "solo"),
    }
    digests = {r["page_id"]: r["payload_digest"] for r in found.collect()}
    assert digests[3] == W.python_digest(b"same") and digests[6] == W.python_digest(b"")
    assert len({r["record_id"] for r in found.collect()}) == 7


def test_small_payloads_can_be_left_alone(spark):
    _, _, resolved = read(spark, [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")], least=5)
    assert {r["page_id"]: r["record_type"] for r in resolved.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_null_and_repeated_ids(spark):
    _, _, resolved = read(spark, [(1, "u", "x", ""), (1, "u", "x", ""), (None, "u", "x", ""), (None, "v", "y", ""), (1, "u", "z", "")])
    got = sorted(((r["page_id"], r["html"], r["record_type"], r["refers_to"]) for r in resolved.collect()), key=repr)
    assert got == sorted([(1, "x", "response", None), (1, "x", "response", None), (None, "x", "revisit", 1), (None, "y", "response", None), (1, "z", "response", None)], key=repr)


def test_many_copies_and_an_empty_table(spark):
    rows = [(i, f"http://h/{i}", "copy" if i % 3 == 0 else f"page {i}", "") for i in range(600)]
    _, _, resolved = read(spark, rows)
    got = resolved.collect()
    assert len(got) == 600 and sum(r["record_type"] == "revisit" for r in got) == 199 and {r["refers_to"] for r in got} == {None, 0}
    assert read(spark, [])[2].collect() == []


def test_archives_follow_the_format(spark):
    path, found, _ = read(spark, [(1, "http://a", "x", ""), (2, "http://b", "x", "")])
    files = {r["path"]: r["content"] for r in spark.read.format("binaryFile").load(path).collect()}
    records = [r for f in files.values() for r in W.parse_archive(io.BufferedReader(gzip.open(io.BytesIO(f))))]
    assert sum(f["warc-type"] == "warcinfo" for f, _ in records) == len(files)
    by = {f["warc-page-id"]: (f, block) for f, block in records if "warc-page-id" in f}
    assert by["1"][0]["warc-type"] == "response" and by["1"][1].startswith(b"HTTP/1.1 200 OK\r\n") and by["1"][1].endswith(b"\r\n\r\nx")
    revisit = by["2"][0]
    assert revisit["warc-profile"] == W.REVISIT_PROFILE and revisit["warc-refers-to"] == by["1"][0]["warc-record-id"] and revisit["warc-refers-to-target-uri"] == "http://a"
    assert revisit["warc-refers-to-date"] == by["1"][0]["warc-date"] and revisit["warc-block-digest"] == "sha1:" + W.python_digest(by["2"][1])
    for r in found.collect():  # a record is a member of its own and can be read from its offset
        _, member = next(W.members(memoryview(files[r["archive"]])[r["offset"] :]))
        (fields, _), = W.parse_archive(io.BytesIO(member))
        assert fields["warc-page-id"] == str(r["page_id"])


def test_archives_are_bounded_by_bytes(spark):
    import random

    draw = random.Random(1)
    rows = [(i, "u", "".join(chr(draw.randrange(33, 0x2FFF)) for _ in range(4000 if i else 60_000)), "") for i in range(60)]
    path = scratch(spark, "warc-test")
    W.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path, archive_bytes=40_000)
    sizes = [len(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(sizes) > 10 and sorted(sizes)[-2] < 60_000
    got = {r["page_id"]: r["html"] for r in W.read_archives(spark, path, with_payload=True).collect()}
    assert got == {i: h for i, _, h, _ in rows}


def test_damage_is_noticed():
    for raw in (b"nonsense\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"):
        with pytest.raises(ValueError):
            list(W.parse_archive(io.BytesIO(raw)))
    whole = W._member(b"WARC/1.1\r\nWARC-Type: resource", b"abc")
    with pytest.raises(ValueError):
        list(W.members(memoryview(whole[:-9])))
    with pytest.raises(ValueError):
        list(W.parse_archive(io.BytesIO(gzip.decompress(whole).replace(b"abc", b"abd"))))
