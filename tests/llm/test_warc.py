import base64
import gzip
import hashlib
import zlib
from pathlib import Path

from plankit.llm import warc
from plankit.llm.scratch import new_path

SCHEMA = "page_id long, url string, html string, record_type int, refers_to string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def archived(spark, rows, **options):
    path = new_path(spark, "warc")
    pages = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, warc.archive(pages, path, **options).collect()), key=repr), path


def expected(rows):
    best = {}
    for i, _, text in rows:
        if i is not None:
            best[text or ""] = max(best.get(text or "", i), i)
    out = []
    for i, url, text in rows:
        to = best.get(text or "")
        again = to is not None and i != to
        out.append((i, url, "revisit" if again else "response", to if again else None, len((text or "").encode()), digest(text)))
    return sorted(out, key=repr)


def test_payloads_come_back_and_copies_are_revisits(spark):
    tricky = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>"
    rows = [(1, "http://a", tricky), (2, "http://b", tricky), (9, "http://c", None), (4, None, ""), (5, "u", "x" * 300_000), (6, "u", "y"), (None, "q", "y"), (None, "q", "z")]
    found, _ = archived(spark, rows)
    assert found == expected(rows)


def test_repeated_rows_and_many_small_archives(spark):
    rows = [(i // 2, f"http://h/{i}", f"text {i % 5}") for i in range(60)] + [(99, "u", "text 0")] * 2
    found, path = archived(spark, rows, archive_bytes=50)
    assert found == expected(rows)
    files = [f.read_bytes() for f in Path(path.removeprefix("file:")).glob("part-*")]
    texts = [gzip.decompress(f) for f in files]
    assert len([t for t in texts if t]) > 3
    ids = [h["warc-record-id"] for t in texts for h, _, _ in warc.parse(t)]
    assert len(ids) == len(set(ids)) == len(rows)
    named = {h["warc-refers-to"] for t in texts for h, _, _ in warc.parse(t) if h["warc-type"] == "revisit"}
    assert named <= set(ids)
    # a reader may start at any record: each is a gzip member of its own
    for file in files:
        starts = []
        while file:
            member = zlib.decompressobj(31)
            starts.append(member.decompress(file)[:8])
            file = member.unused_data
        assert set(starts[:-1]) == {b"WARC/1.1"} and starts[-1] == b""
    assert sum(t.count(b"WARC-Type: response") for t in texts) == sum(r[2] == "response" for r in found)


def test_smaller_payloads_than_the_least_are_all_responses(spark):
    path = new_path(spark, "warc")
    found = warc.records(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long text"), (4, "u", "long text")], "page_id long, url string, html string"))
    warc.write_archives(found, found.select("page_id", "payload_digest", "payload_bytes"), path, 100, min_payload=5)
    kinds = {r.page_id: (r.record_type, r.payload) for r in warc.read_archives(spark, path, with_payload=True).collect()}
    assert kinds == {1: ("response", b"ab"), 2: ("response", b"ab"), 3: ("revisit", None), 4: ("response", b"long text")}


def test_no_pages(spark):
    assert archived(spark, [])[0] == []
