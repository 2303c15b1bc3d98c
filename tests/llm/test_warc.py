"""WARC archives: round trips, and what is left of damaged ones."""

import gzip
import random

import duckdb
import pytest

from docrecon.llm.warc import OP12_SQL, archived_pages, digest32, gaps, op12_warc, read_member, read_warc, records, scan, write_warc


def pages(spark):
    rows = [(3, "http://a/ b", "<p>one</p>"), (1, None, "<p>one</p>"), (2, "u", None), (9, "u", ""), (None, "n", "<p>one</p>"), (5, "é", "WARC/1.1\r\nWARC-Type: response\r\n\r\nno"), (6, "x", "y" * 300_000), (1, "again", "<p>one</p>"), (7, "z", "ü\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS record_type", "'x' AS payload", "2 AS digest")


WANT = [(None, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (5, "response", None), (6, "response", None), (7, "response", None), (9, "revisit", 2)]


def key(t):
    return (t[0] is not None, t[0] or 0)


@pytest.mark.parametrize("zipped", [True, False])
def test_round_trip(spark, tmp_path, zipped):
    df = pages(spark).repartition(3)
    write_warc(df, f"file://{tmp_path}/w", gzip=zipped)
    found = read_warc(spark, f"file://{tmp_path}/w")
    assert gaps(found).count() == 0
    got = archived_pages(found).collect()
    assert sorted([(r.page_id, r.record_type, r.refers_to) for r in got], key=key) == sorted(WANT, key=key)
    text = {r.page_id: r.html or "" for r in df.collect()}
    assert all(r.payload_bytes == len(text[r.page_id].encode()) and r.payload_digest == digest32(text[r.page_id].encode()) for r in got)
    bodies = {r.record_id: r.payload for r in records(found).where("record_type = 'response'").collect()}
    assert sorted(bodies.values()) == sorted({t.encode() for t in text.values()})
    for file in (tmp_path / "w").glob("part*"):
        data = file.read_bytes()
        plain = gzip.decompress(data) if zipped else data
        assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")


def test_small_payloads_and_empty_tables(spark, tmp_path):
    write_warc(pages(spark), f"file://{tmp_path}/w", at_least=1)
    got = {r.page_id: r.record_type for r in archived_pages(read_warc(spark, f"file://{tmp_path}/w")).collect()}
    assert got[9] == "response" and got[3] == "revisit"
    write_warc(pages(spark).where("false"), f"file://{tmp_path}/e")
    assert read_warc(spark, f"file://{tmp_path}/e").count() == 0


def archive(zipped, n=40, seed=5):
    """The members or records of an archive, each apart."""
    from docrecon.llm.warc import _page_record

    rng = random.Random(seed)
    out = []
    for i in range(n):
        payload = bytes(rng.choices(b"abcdefgh \x1f\x8b\x08\r\n", k=rng.randrange(2000)))
        record = _page_record(i, f"u{i}", payload, None, False, "2020-01-01T00:00:00Z", "")
        out.append(gzip.compress(record, mtime=0) if zipped else record)
    return out


def ids(data):
    return [x[3]["warc-record-id"].split(":")[3] for x in scan(data) if x[0] == "record"]


def holes(data):
    return [(x[1], x[2]) for x in scan(data) if x[0] == "gap"]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    """A bit, a cut, foreign bytes, a wrong length: the other records are found, and the gap covers the damaged bytes."""
    parts = archive(zipped)
    whole = b"".join(parts)
    places = [0]
    for p in parts:
        places.append(places[-1] + len(p))
    assert ids(whole) == [str(i) for i in range(len(parts))] and not holes(whole)
    rng = random.Random(7)
    for _ in range(60):
        k = rng.randrange(len(parts))
        at = places[k] + rng.randrange(len(parts[k]))
        bad = bytearray(whole)
        bad[at] ^= 1 << rng.randrange(8)
        found, gap = ids(bytes(bad)), holes(bytes(bad))
        # Bits of a header's names and values, and a member's time, aren't under any checksum.
        assert [i for i in found if i != str(k)] == [str(i) for i in range(len(parts)) if i != k] or not zipped
        assert len(found) >= len(parts) - 2 and (gap or len(found) == len(parts))
        assert all(start <= at < start + size for start, size in gap) or not zipped
    k = 11
    cut = whole[: places[k] + 40] + whole[places[k + 1] :]
    assert ids(cut) == [str(i) for i in range(len(parts)) if i != k] and holes(cut) == [(places[k], 40)]
    junk = bytes(rng.choices(range(256), k=5000)) + b"\x1f\x8b\x08\x00WARC/1.1\r\n"
    mixed = whole[: places[k]] + junk + whole[places[k] :]
    assert ids(mixed) == [str(i) for i in range(len(parts))] and holes(mixed) == [(places[k], len(junk))]
    short = whole[: places[-2] + 30]
    assert ids(short) == [str(i) for i in range(len(parts) - 1)] and holes(short) == [(places[-2], 30)]
    assert ids(b"") == [] and holes(b"nothing of the kind") == [(0, 19)]
    assert ids(b"\0\0" + whole[: places[3]] + b"\0\r\n") == ["0", "1", "2"] or not zipped


def test_wrong_length_and_digest():
    parts = archive(False, 4)
    longer = parts[1].replace(b"Content-Length: ", b"Content-Length: 9")
    assert ids(parts[0] + longer + parts[2]) == ["0", "2"] and holes(parts[0] + longer + parts[2]) == [(len(parts[0]), len(longer))]
    other = parts[1].replace(b"HTTP/1.1 200", b"HTTP/1.1 404")
    assert ids(parts[0] + other + parts[2]) == ["0", "2"]


def test_members_of_many_records():
    """One member for all records: a damaged record inside, and a member that breaks off."""
    parts = archive(False, 6)
    inside = b"".join([parts[0], parts[1][:-60], *parts[2:]])
    found = list(scan(gzip.compress(inside)))
    assert [x[0] for x in found] == ["record", "gap", "record", "record", "record", "record"]
    rng = random.Random(1)
    for level in (0, 6):
        data = gzip.compress(b"".join(archive(False, 6, seed=rng.random())), compresslevel=level)
        broken = data[: len(data) * 2 // 3] + gzip.compress(parts[5])
        names = ids(broken)
        assert names[:2] == ["0", "1"] and names[-1] == "5" and len(names) == len(set(names)) and holes(broken)
    assert read_member(data)[2] == ""


def test_damaged_files_in_spark(spark, tmp_path):
    parts = archive(True, 30)
    whole = b"".join(parts)
    bad = bytearray(whole)
    at = len(b"".join(parts[:4])) + len(parts[4]) - 6  # a member's checksum
    bad[at] ^= 255
    (tmp_path / "a.warc.gz").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(bytes(bad))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    found = read_warc(spark, f"file://{tmp_path}")
    assert records(found).where("length > 0").count() == 59
    # What the damaged member holds could be inflated and its digests are right.
    assert [r.length for r in records(found).where("length = 0").collect()] == [0]
    hole = gaps(found).collect()
    assert [(r.file.rsplit("/", 1)[1], r.start, r.length) for r in hole] == [("b.warc.gz", len(b"".join(parts[:4])), len(parts[4]))]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = op12_warc(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet' UNION ALL SELECT page_id + 100000, url, html FROM '{sf}/pages.parquet' WHERE page_id % 3 = 0")
    assert (con.execute(OP12_SQL).df().record_type == "revisit").sum() > 0
    want = con.execute(OP12_SQL.replace("FROM pages", f"FROM '{sf}/pages.parquet'")).df()
    a = got.sort_values("page_id")[sorted(got.columns)].astype(object).where(lambda d: d.notna(), None).values.tolist()
    b = want.sort_values("page_id")[sorted(want.columns)].astype(object).where(lambda d: d.notna(), None).values.tolist()
    assert a == b
