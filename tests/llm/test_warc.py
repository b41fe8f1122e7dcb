import base64
import gzip
import hashlib
import random

import pytest

from strata.llm import warc

PAGES = "page_id long, url string, html string, payload string, sha1 string"


def rows(df):
    return sorted(((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in df.collect()), key=str)


def test_table(spark, data):
    from strata.llm.queries import op5_warc

    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r.page_id: r for r in op5_warc(spark, data).collect()}
    last = {}
    for p in pages:
        last[p.html or ""] = max(p.page_id, last.get(p.html or "", p.page_id))
    assert len(got) == len(pages)
    for p in pages:
        body = (p.html or "").encode()
        refers = last[p.html or ""] if last[p.html or ""] != p.page_id else None
        r = got[p.page_id]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if refers is not None else "response", refers)


def test_sql(spark, data):
    import duckdb

    from strata.llm.queries import op5_warc

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{data}/pages.parquet'")
    out = op5_warc(spark, data)
    want = con.sql(f"select {', '.join(out.columns)} from ({warc.ROUND_TRIP_SQL})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_odd_pages(spark, tmp_path):
    html = ["", None, "a", "a", "é" * 50_000, "WARC/1.1\r\n\r\n", "x\r\n\r\ny", "a", "\x1f\x8b\x08"]
    pages = spark.createDataFrame([(i, None if i % 3 == 0 else f"http://e.org/ü?{i}\r\nX: y", h, "x", "y") for i, h in enumerate(html)] + [(None, "u", "a", "x", "y"), (2, "u", "a", "x", "y")], PAGES)
    got = warc.archive_round_trip(pages, f"file://{tmp_path}/w")
    d = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = [(i, "response", len((h or "").encode()), d(h or ""), None) for i, h in enumerate(html) if i not in (0, 2, 3)]
    want += [(0, "revisit", 0, d(""), "1"), (2, "revisit", 1, d("a"), "7"), (2, "revisit", 1, d("a"), "7"), (3, "revisit", 1, d("a"), "7"), (None, "response", 1, d("a"), None)]
    assert rows(got) == sorted(want, key=str)
    assert got.where("problem is not null").count() == 0
    least = warc.archive_round_trip(pages, f"file://{tmp_path}/least", least=1)
    assert least.where("payload_bytes = 0 and record_type = 'response'").count() == 2
    assert warc.archive_round_trip(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def some(n=6):
    return [warc.record(i, "http://e.org", b"payload %d " % i * 50, warc.digest(b"payload %d " % i * 50), None) for i in range(n)]


def pages_of(data):
    out = list(warc.salvage(data))
    return [int(h["x-page-id"]) for _, _, h, _, _ in out if h], [(o, n) for o, n, h, _, _ in out if h is None]


@pytest.mark.parametrize("damaged", range(6))
def test_salvage_of_members(damaged):
    members = [warc.gzipped(r) for r in some()]
    sizes = [len(m) for m in members]
    for at in (0, 3, 30, sizes[damaged] - 4):
        broken = [bytearray(m) for m in members]
        broken[damaged][at] ^= 0x5A
        assert pages_of(b"".join(map(bytes, broken))) == ([i for i in range(6) if i != damaged], [(sum(sizes[:damaged]), sizes[damaged])])
    cut = b"".join(members[:damaged]) + members[damaged][: sizes[damaged] // 2] + b"".join(members[damaged + 1 :])
    assert pages_of(cut)[0] == [i for i in range(6) if i != damaged]
    assert pages_of(b"junk" + b"".join(members)) == (list(range(6)), [(0, 4)])


def test_salvage_of_plain_archives():
    records = some()
    assert pages_of(b"".join(records)) == (list(range(6)), [])
    sizes = [len(r) for r in records]
    wrong = records[2].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    assert pages_of(b"".join([*records[:2], wrong, *records[3:]])) == ([0, 1, 3, 4, 5], [(sum(sizes[:2]), len(wrong))])
    flipped = records[2].replace(b"payload 2", b"payload 7", 1)
    assert pages_of(b"".join([*records[:2], flipped, *records[3:]]))[0] == [0, 1, 3, 4, 5]
    assert pages_of(b"".join(records)[:-30]) == (list(range(5)), [(sum(sizes[:5]), sizes[5] - 30)])


def test_gaps_are_logged(spark, tmp_path):
    members = [warc.gzipped(r) for r in some()]
    (tmp_path / "one.warc.gz").write_bytes(members[0] + members[1][:40] + b"".join(members[2:]))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(some())))
    (tmp_path / "plain.warc").write_bytes(b"".join(some()))
    out = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted(r.page_id for r in out if r.file == "one.warc.gz" and r.problem is None) == [0, 2, 3, 4, 5]
    assert [(r.offset, r.length) for r in out if r.problem] == [(len(members[0]), 40)]
    assert all(sorted(r.page_id for r in out if r.file == f) == list(range(6)) for f in ("whole.warc.gz", "plain.warc"))


def many(n=40):
    return [warc.record(i, "http://e.org", random.Random(i).randbytes(30_000), warc.digest(random.Random(i).randbytes(30_000)), None) for i in range(n)]


@pytest.mark.parametrize("step", [1 << 20, 5_000])
def test_a_shared_member_that_is_damaged(monkeypatch, step):
    """All records before the damage are kept, and those of later members; the gap is logged once."""
    monkeypatch.setattr(warc, "STEP", step)
    records = many()
    shared, later = bytearray(warc.gzipped(b"".join(records))), warc.gzipped(some()[5])
    assert pages_of(bytes(shared) + later) == ([*range(40), 5], [])
    cut = bytes(shared[: len(shared) * 3 // 4])
    for broken in (cut, cut + later):
        pages, gaps = pages_of(broken)
        kept = [i for i in pages if i != 5 or pages.index(i) == 5]
        assert 28 <= len([*dict.fromkeys(pages)]) <= 30 and kept[:28] == [*range(28)] and len(gaps) == 1
        assert (pages[-1] == 5) == (broken != cut)
    shared[len(shared) // 2] ^= 0x10
    pages, gaps = pages_of(bytes(shared) + later)
    assert {*range(39)} - {*pages[:-1]} < {18, 19, 20, 21} and pages[-1] == 5 and len(gaps) == 1  # by the records' own digests


def test_headers_that_are_folded_and_several_version_lines(monkeypatch):
    folded = some()[1].replace(b"WARC-Target-URI: http://e.org", b"WARC-Target-URI: http://e.org\r\n  /more\r\n\tstill")
    found = list(warc.salvage(warc.gzipped(folded)))
    assert [h["warc-target-uri"] for _, _, h, _, _ in found] == ["http://e.org /more still"]
    lines = b"WARC/1.0\r\nWARC/1.1\r\nnothing\r\n\r\n"
    assert pages_of(some()[0] + lines + some()[2]) == ([0, 2], [(len(some()[0]), len(lines))])
    member = warc.gzipped(lines + some()[3])
    assert [int(h["x-page-id"]) if h else p for _, _, h, _, p in warc.salvage(member)] == [3, "in a member: a header without a colon"]


@pytest.mark.parametrize("n", [0, 1, 20, 10_000])
def test_noise(n):
    noise = random.Random(n).randbytes(n)
    assert pages_of(noise) == ([], [(0, n)] if n else [])
    assert pages_of(some()[0] + noise)[0] == [0]
    assert pages_of(warc.gzipped(some()[0]) + noise + warc.gzipped(some()[1]))[0] == [0, 1]


def test_records_beyond_the_bound_are_logged():
    found = list(warc.salvage(b"".join(some()), largest=100))
    assert {p.split(",")[0][:10] for *_, p in found} == {"a block of"} and all(h is None for _, _, h, _, _ in found)


def test_large_payloads_in_several_archives(spark, tmp_path):
    """Payloads beyond the size of an archive, which the reader streams in small steps; read by pyarrow and by Spark."""
    html = [random.Random(i).randbytes(400_000).hex() for i in range(6)]
    pages = spark.createDataFrame([(i, "u", h, "x", "y") for i, h in enumerate(html)], PAGES).coalesce(1)
    made = warc.write_archives(pages, f"file://{tmp_path}/w x", archive_bytes=300_000)
    assert made.count() == 6
    for whole in (False, True):
        got = warc.read_archives(spark, f"file://{tmp_path}/w x", whole=whole)
        assert sorted((r.page_id, bytes(r.payload).decode()) for r in got.collect()) == [*enumerate(html)]
