import gzip
import hashlib
import random

import pytest

from tallyforge.llm import warc


def rows_of(spark, folder):
    return {r["record_id"]: r for r in warc.read_archives(spark, folder, with_payload=True).collect()}


def test_round_trip(spark, tmp_path):
    big = "x" * 999 + "é"
    pages = [(1, "http://a/", big), (2, "http://b/", big), (3, None, None), (4, "http://c/\n", "short"), (5, "http://d/", "short"), (6, "http://e/", "y" * (17 << 20)), (7, "u", "\0\0tail\0"), (None, "http://n/", big), (2, "http://b/", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(df, folder)
    found = warc.read_archives(spark, folder, with_payload=True).collect()
    assert len(found) == len(pages)
    got = {}
    for r in found:
        got.setdefault(r["record_id"], r)
    assert got["urn:page:1"]["record_type"] == "revisit" and got["urn:page:1"]["refers_to"] == "urn:page:2" and got["urn:page:1"]["payload_bytes"] == 1001
    assert [r["record_type"] for r in found if r["record_id"] == "urn:page:2"] == ["response", "response"]
    assert all(r["verified"] for r in found if r["record_type"] == "response")
    assert got["urn:page:5"]["record_type"] == "response" and got["urn:page:3"]["payload_bytes"] == 0
    assert bytes(got["urn:page:6"]["payload"]) == b"y" * (17 << 20) and bytes(got["urn:page:7"]["payload"]) == b"\0\0tail\0"
    for path in (tmp_path / "w").glob("part-*"):
        gzip.decompress(path.read_bytes())  # a common reader takes the members too
    warc.write_archives(df.limit(0), f"{folder}0")
    assert warc.read_archives(spark, f"{folder}0").count() == 0


def test_reader_frames_and_checks():
    one = warc.member("response", "urn:page:1", "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    for size in (1, 7, 1000):
        data = one + b"\0\0" + one
        found = list(warc.read_records((data[i : i + size] for i in range(0, len(data), size)), step=5))
        assert [b for _, b in found] == [b"abc", b"abc"]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records([one[:-9]]))
    with pytest.raises(ValueError, match="length"):
        list(warc.read_records([gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n")]))
    with pytest.raises(ValueError, match="version"):
        list(warc.read_records([gzip.compress(b"HTTP/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")]))


def test_archives_are_bounded_and_read_in_chunks(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh \0\n") for _ in range(n))
    rows = [(k, f"http://x/{k}", text(rng.choice([0, 10, 3000, 40_000])), "a", "b") for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, length string")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(df, folder, archive_bytes=100_000)
    files = list((tmp_path / "w").glob("part-*"))
    assert len([f for f in files if f.stat().st_size]) > 3 and max(f.stat().st_size for f in files) < 300_000
    for chunk in (977, 1 << 20):
        found = {r["record_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, folder, with_payload=True, chunk=chunk).collect()}
        assert found == {f"urn:page:{k}": html for k, _, html, _, _ in rows}
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "part-0").write_bytes(max(files, key=lambda f: f.stat().st_size).read_bytes()[:-50])
    with pytest.raises(Exception, match="ends within"):
        warc.read_archives(spark, f"file://{cut}").collect()


def test_revisits_are_held_against_what_they_refer_to(spark, tmp_path):
    page = b"z" * 1200
    digest = hashlib.sha1(page).hexdigest()
    other = hashlib.sha1(b"other").hexdigest()
    records = [("response", "urn:page:9", page, digest, 1200, None), ("revisit", "urn:page:1", b"", digest, 1200, "urn:page:9"), ("revisit", "urn:page:2", b"", other, 1200, "urn:page:9"), ("revisit", "urn:page:3", b"", digest, 1201, "urn:page:9"), ("revisit", "urn:page:4", b"", digest, 1200, "urn:page:8"), ("response", "urn:page:5", b"damaged", digest, 7, None), ("revisit", "urn:page:6", b"", digest, 7, "urn:page:5")]
    (tmp_path / "part-0").write_bytes(b"".join(warc.member(kind, name, "u", payload, d, n, refers, "2020-02-02T00:00:00Z") for kind, name, payload, d, n, refers in records))
    found = {r["record_id"]: r["verified"] for r in warc.resolve(warc.read_archives(spark, f"file://{tmp_path}")).collect()}
    assert found == {f"urn:page:{k}": k in (9, 1) for k in (9, 1, 2, 3, 4, 5, 6)}


def test_archives_from_elsewhere(spark, tmp_path):
    """Other record types, HTTP messages, header names of any case, without a space, folded; digests in other forms or none."""
    import base64

    digest = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    page = b"<html>\r\n\r\nbody</html>"
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page

    def record(block, *lines):
        return gzip.compress(b"\r\n".join([b"WARC/1.0", *lines, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n")

    kind = lambda k, name: (b"WARC-Type: " + k, b"WARC-Record-ID: <urn:" + name + b">")
    http, said = b"content-type:application/http; msgtype=response", f"WARC-Payload-Digest: {digest(page)}".encode()
    parts = [
        record(b"software: x\r\n", *kind(b"warcinfo", b"info"), b"Content-Type: application/warc-fields"),
        record(b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", *kind(b"request", b"ask"), b"WARC-TARGET-URI:http://a/", b"Content-Type: application/http; msgtype=request"),
        record(message, *kind(b"response", b"one"), b"Warc-Target-Uri:http://a/\r\n  folded", http, said),
        record(message, *kind(b"response", b"hex"), http, b"WARC-Payload-Digest: sha1:" + hashlib.sha1(page).hexdigest().upper().encode()),
        record(message, *kind(b"response", b"bad"), http, f"WARC-Payload-Digest: {digest(b'other')}".encode()),
        record(message, *kind(b"response", b"md5"), http, b"WARC-Payload-Digest: md5:abc"),
        record(b"x: y", *kind(b"metadata", b"meta"), f"WARC-Block-Digest: {digest(b'x: y')}".encode()),
        record(b"HTTP/1.1 304 Not Modified\r\n\r\n", *kind(b"revisit", b"two"), http, said, b"WARC-Refers-To: <urn:one>"),
    ]
    (tmp_path / "crawl.warc.gz").write_bytes(b"".join(parts))
    found = {r["record_id"]: r for r in warc.resolve(warc.read_archives(spark, f"file://{tmp_path}", with_payload=True)).collect()}
    assert {k: r["verified"] for k, r in found.items()} == {"urn:info": None, "urn:ask": None, "urn:one": True, "urn:hex": True, "urn:bad": False, "urn:md5": None, "urn:meta": True, "urn:two": True}
    assert bytes(found["urn:one"]["payload"]) == page and found["urn:one"]["target_uri"] == "http://a/ folded" and found["urn:info"]["target_uri"] is None
    assert found["urn:two"]["payload_bytes"] is None and found["urn:one"]["payload_bytes"] == len(page)
    with pytest.raises(ValueError, match="state its length"):
        list(warc.read_records([gzip.compress(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n")]))


def test_a_page_that_repeats_spreads_over_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "z" * 900)] * 800, "page_id long, url string, html string").repartition(3)
    warc.write_archives(df, f"file://{tmp_path}/w", archive_bytes=90_000)
    sizes = sorted(len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("part-*") if f.stat().st_size)
    assert len(sizes) > 5 and sizes[-1] < 3 * sum(sizes) / len(sizes)
    assert warc.read_archives(spark, f"file://{tmp_path}/w").where("verified").count() == 800
