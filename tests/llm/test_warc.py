import hashlib
import random

import pytest
from pyarrow import fs

from creditmill.llm.warc import Archive, Gap, Record, member, page_urn, pages_from_archives, read_archives, record, write_archives
from tests.llm.fixtures import pages_schema


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def entries(data):
    return list(Archive(Bytes(data), len(data)).entries())


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", "f") for i, u, h in rows], pages_schema())


LONG = "<p>ä long page</p>" * 100
ROWS = [(1, "http://a/\n b", LONG), (2, None, LONG), (9, "http://c", LONG), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
        (7, "", ""), (None, "u", LONG), (8, "u", "x" * 300_000 + "\r\n\r\nWARC/1.1\r\n"), (10, "u", "z" * 999), (11, "u", "z" * 999),
        (12, "u", "y" * 1000), (12, "u", "y" * 1000), (13, "u", "\x1f\x8b\x08\x00 no member")]


def test_pages_there_and_back(spark):
    got = sorted(map(tuple, pages_from_archives(pages(spark, ROWS)).collect()), key=repr)
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        last = max((j for j, _, h in ROWS if h == html and j is not None), default=None)
        revisit = i is not None and len(data) >= 1000 and last != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    want = [(i, n, d, k, r) for i, n, d, k, r in want]
    assert [w for w in got if w[0] is not None] == sorted((w for w in want if w[0] is not None), key=repr)
    assert [w[1:4] for w in got if w[0] is None] == [(len(LONG.encode()), hashlib.sha1(LONG.encode()).hexdigest(), "response")]
    assert pages_from_archives(pages(spark, [])).collect() == []


@pytest.mark.parametrize("packed", [True, False])
def test_later_records_are_recovered(packed):
    rnd = random.Random(5)
    records = [record(i, f"http://x/{i}", bytes(rnd.randrange(256) for _ in range(rnd.randrange(3000))), None if i % 3 else i + 1) for i in range(40)]
    parts = [member(r) if packed else r for r in records]
    whole = b"".join(parts)
    assert [type(e) for e in entries(whole)] == [Record] * 40
    for trial in range(120):
        data, hit = bytearray(whole), rnd.randrange(40)
        start, n = sum(map(len, parts[:hit])), len(parts[hit])
        if trial % 4 == 0:
            data[start + rnd.randrange(n)] ^= 1 << rnd.randrange(8)
        elif trial % 4 == 1:
            del data[start + rnd.randrange(n) : start + n]
        elif trial % 4 == 2:
            data[start:start] = bytes(rnd.randrange(256) for _ in range(50))
        else:
            data[start : start + n] = b"\0" * n
        found = entries(bytes(data))
        names = [e.fields["warc-record-id"] for e in found if isinstance(e, Record)]
        assert {page_urn(i) for i in range(40)} - set(names) <= {page_urn(hit)}
        place = 0
        for e in found:  # records and gaps cover the file
            assert e.start == place
            place = e.end
        assert place == len(data)


def test_gaps_say_why():
    one, two = record(1, "u", b"a" * 50, None), record(2, "u", b"b" * 50, None)
    broken = one.replace(b"aaaa", b"axaa", 1)
    gap, rest = entries(broken + two)
    assert gap == Gap(0, len(one), "block digest differs") and rest.fields["warc-record-id"] == page_urn(2)
    assert entries(b"") == []
    assert [e.reason for e in entries(b"noise")] == ["no version line"]
    assert [getattr(e, "reason", None) for e in entries(member(one) + member(two)[:-20])] == [None, "member cut off"]


def test_gaps_are_rows(spark):
    listed = write_archives(pages(spark, ROWS).coalesce(1))
    name = listed.first()["file"]
    files, place = fs.FileSystem.from_uri(name)
    data = bytearray(files.open_input_file(place).read())
    data[3] ^= 255
    data[:0] = b"junk"
    with files.open_output_stream(place + ".bad", compression=None) as out:
        out.write(bytes(data))
    rows = read_archives(spark.createDataFrame([(name + ".bad",), (name,)], "file string")).collect()
    assert sum(r.reason is not None for r in rows) >= 1
    assert sum(r.reason is None for r in rows if r.file == name) == len(ROWS)
    assert sum(r.reason is None for r in rows if r.file != name) >= len(ROWS) - 1


@pytest.mark.parametrize("url", ["http://x/" + "a" * 200_000, "http://x/" + "日本" * 20_000])
def test_urls_of_any_length(spark, url):
    for packed in (True, False):
        parts = [record(k, u, b"page", None) for k, u in enumerate(["u", url, "u"])]
        parts = [member(p) for p in parts] if packed else parts
        found = entries(b"".join(parts))
        assert [e.fields["warc-record-id"] for e in found] == [page_urn(k) for k in range(3)]
        assert len(found[1].fields["warc-target-uri"]) >= 200_000
        found = entries(parts[0] + parts[1][:-9] + parts[2])  # a long one cut off: the next is found
        assert [getattr(e, "fields", {}).get("warc-record-id") for e in found] == [page_urn(0), None, page_urn(2)]
    assert len(pages_from_archives(pages(spark, [(1, url, LONG), (2, url, "short")])).collect()) == 2


def test_header_that_never_ends():
    start = record(1, "u", b"", None)[:40]
    found = entries(start + b"x" * 300_000 + b"\r\n" + record(2, "u", b"page", None))
    assert [type(e) for e in found] == [Gap, Record] and found[0].reason == "header without an end"
    assert [e.reason for e in entries(start + b"x" * 300_000)] == ["header without an end"]


def test_records_of_one_member():
    three = [record(k, "u", b"a" * 50, None) for k in range(3)]
    data = member(b"".join(three)) + member(record(3, "u", b"\x1f\x8b\x08\x00 no member", None))
    found = entries(data)
    assert [e.fields["warc-record-id"] for e in found] == [page_urn(k) for k in range(4)]
    assert found[0].start == 0 and found[0].end == found[2].end == found[3].start and found[3].end == len(data)
    broken = member(three[0] + three[1].replace(b"aaaa", b"axaa", 1) + three[2])
    assert [getattr(e, "reason", None) for e in entries(broken)] == [None, "block digest differs", None]
    assert [e.reason for e in entries(member(three[1].replace(b"aaaa", b"axaa", 1)))] == ["block digest differs"]


def test_a_broken_member_gives_what_came_before():
    rnd = random.Random(6)
    many = [record(k, f"http://x/{k}", bytes(rnd.randrange(256) for _ in range(rnd.randrange(20, 900))), None) for k in range(200)]
    whole, after = member(b"".join(many)), member(record(900, "u", b"after", None))
    flipped = bytearray(whole)
    flipped[len(whole) * 9 // 10] ^= 16
    for broken, least in ((whole[:-50], 190), (bytes(flipped), 170), (whole[: len(whole) // 2], 90)):
        found = entries(broken + after)
        ids = [e.fields["warc-record-id"] for e in found if isinstance(e, Record)]
        assert ids[:-1] == [page_urn(k) for k in range(200) if page_urn(k) in ids] and len(ids) > least and ids[-1] == page_urn(900)
        gaps = [e for e in found if isinstance(e, Gap)]
        assert gaps and all(g.inside is not None and g.start == 0 and g.end == len(broken) for g in gaps)
        assert gaps[0].inside >= sum(map(len, many[:least]))
        assert found[-1].start == len(broken) and found[-1].end == len(broken) + len(after)
    alone = entries(whole[:-50])  # nothing follows
    assert len(alone) > 190 and alone[-1].end == len(whole) - 50 and isinstance(alone[-1], Gap)
    two = entries(whole[:-50] + bytes(flipped) + after)  # one broken member after the other
    assert sum(isinstance(e, Record) for e in two) > 190 + 170 and isinstance(two[-1], Record)


def test_damaged_check_sum_costs_the_last_record_only():
    three = b"".join(record(k, "u", b"a" * 50, None) for k in range(3))
    data = bytearray(member(three))
    data[-5] ^= 1
    found = entries(bytes(data))
    assert [type(e) for e in found] == [Record] * 2 + [Gap] and found[-1].inside == len(three) * 2 // 3


def test_files_are_read_by_a_task_each(spark):
    listed = write_archives(pages(spark, [(k, "u", f"page {k}") for k in range(40)]).repartition(20))
    n = listed.count()
    read = read_archives(listed, with_payload=False)
    assert n > 10 and read.rdd.getNumPartitions() == n
    assert read.where("reason is null").count() == 40
