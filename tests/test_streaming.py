"""The stream jobs against their batch rules, and request limits against a loop."""

import tempfile
from collections import defaultdict

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from docrecon.operators.layout import group_cells, row_numbers, rows_of_pages, zone_overlaps
from docrecon.plans.access import requests
from docrecon.streaming.jobs import admit, failed_login_stream, failed_logins, ingest, rate_limit, rate_limit_stream, revocation_stream

SF = "/root/testdata/sf0.001"


def by_loop(rows, limit, micros):
    kept, out = defaultdict(list), set()
    for r in sorted(rows, key=lambda r: (r["micros"], r["id"])):
        recent = [t for t in kept[r["route"], r["ip"]] if t >= r["micros"] - micros]
        if len(recent) < limit:
            recent.append(r["micros"])
            out.add(r["id"])
        kept[r["route"], r["ip"]] = recent
    return out


def streamed(spark, df, parts, name, job):
    """job over df, read as one file for each micro-batch."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = job(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in"))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_admitted_by_blocks():
    rng = np.random.default_rng(1)
    for _ in range(300):
        times, limit, window = np.sort(rng.integers(0, 200, rng.integers(0, 60))), int(rng.integers(1, 6)), int(rng.integers(0, 60))
        kept, want = [], []
        for t in times:
            kept = [s for s in kept if s >= t - window]
            want.append(len(kept) < limit)
            kept += [t] * want[-1]
        cut = int(rng.integers(0, len(times) + 1))
        one, stamps = admit(times[:cut], np.empty(0, np.int64), limit, window)
        two, _ = admit(times[cut:], stamps, limit, window)
        assert [*one, *two] == want


def test_rate_limit_batch_and_stream(spark):
    """Batch and stream decide alike, though the stream's rows arrive in another order."""
    req = requests(spark, SF)
    want = by_loop(req.collect(), 2, 18_000_000_000)
    assert 0 < len(want) < req.count()
    assert {r["id"] for r in rate_limit(req, 2, 18_000).where("accepted").collect()} == want
    last = req.selectExpr("'end' AS route", "'' AS ip", "-1L AS id", "micros + 1000000000000000 AS micros").limit(1)
    got = streamed(spark, req.union(last), ["id % 3 = 0", "id % 3 = 1", "id % 3 = 2", "id = -1"], "limited", lambda s: rate_limit_stream(s, 2, 18_000, "3000 days"))
    rows = got.collect()
    assert len(rows) == req.count() and {r["id"] for r in rows if r["accepted"]} == want


def test_failed_logins_as_the_window_counts_them(spark):
    rows = spark.sql("select id, timestamp_seconds(1000000 + pow(id * 37 % 101, 2)) as at, if(id % 3 = 0, ' A@x ', 'b@x') as email, 'i' as ip, id % 5 > 0 as failed from range(101)")
    last = spark.sql("select -1L as id, timestamp_seconds(90000000) as at, 'end' as email, '' as ip, true as failed")
    got = streamed(spark, rows.union(last), ["id % 2 = 0 and id >= 0", "id % 2 = 1", "id = -1"], "failures", lambda s: failed_login_stream(s, "300 days"))
    own = rows.where("failed").withColumn("email", F.lower(F.trim("email")))
    want = own.withColumn("n", F.count("*").over(Window.partitionBy("email", "ip").orderBy(F.unix_micros("at")).rangeBetween(-900_000_000, 0)))
    assert {(r["id"], r["n"]) for r in got.collect()} == {(r["id"], r["n"]) for r in want.collect()}


def test_rows_of_cells():
    rng = np.random.default_rng(2)
    for _ in range(100):
        y = np.sort(rng.integers(0, 300, rng.integers(1, 80)))
        want, anchor, row = [], None, 0
        for v in y:
            if anchor is None or v - anchor > 14:
                anchor, row = v, row + 1
            want.append(row)
        cut = int(rng.integers(0, len(y) + 1))
        one, *state = row_numbers(y[:cut], 14)
        assert [*one, *row_numbers(y[cut:], 14, *state)[0]] == want


def test_rejected_requests_do_not_count(spark):
    req = spark.createDataFrame([("login", "a", i, i * 1_000_000) for i in range(8)] + [("login", None, 9, 0)], "route string, ip string, id long, micros long")
    got = {r["id"] for r in rate_limit(req, 2, 3).where("accepted").collect()}
    assert got == {0, 1, 4, 5, 9}


def test_revocations_keep_the_first(spark):
    rows = spark.sql("select id % 3 as jti, timestamp_seconds(id) as revoked_at, id from range(9)")
    got = streamed(spark, rows, ["id < 5", "id >= 5"], "revoked", revocation_stream)
    assert sorted(r["jti"] for r in got.collect()) == [0, 1, 2]


def test_failed_login_windows(spark):
    rows = spark.sql("select timestamp_seconds(600 + 60 * id) as at, ' A@x ' as email, 'i' as ip, id < 5 as failed from range(7)")
    assert {r["n"] for r in failed_logins(rows, 5).collect()} == {5}


def test_ingest(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    text = "654321 05-06-2022\nTYPE DECLARATION EA 1 20 fin\n1 8542319000 TN 100.500 x 2 8542319000 DE 7000,250 y\n602 10.500 1.250000 13.000 end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "c")], "id long, text string")
    docs.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{folder}/in")
    ingest(stream, f"{folder}/out", f"{folder}/c").awaitTermination(180)
    header = {r["id"]: r for r in spark.read.parquet(f"{folder}/out/header").collect()}
    assert set(header) == {1, 2, 3} and header[1]["number"] == "654321" and header[1]["score"] > header[2]["score"] and "number" in header[3]["flags"]
    assert sorted(tuple(r)[:5] for r in spark.read.parquet(f"{folder}/out/articles").drop("batch").select("id", "position", "line", "hs", "value").collect()) == [(1, 0, 1, "8542319000", "100.500"), (1, 1, 2, "8542319000", "7000.250")]
    assert [r["code"] for r in spark.read.parquet(f"{folder}/out/taxes").collect()] == ["602"]


def test_zone_overlap_across_cells(spark):
    zones = spark.createDataFrame([(1, 1, 0, 0, 100, 100), (1, 2, 50, 50, 150, 150), (1, 3, 100, 0, 120, 40), (2, 4, 0, 0, 9, 9)], "page long, id long, x1 long, y1 long, x2 long, y2 long")
    assert [tuple(r) for r in zone_overlaps(zones).collect()] == [(1, 1, 2)]


def test_rows_of_many_pages_at_once(spark):
    """As page by page, for a page cut between batches, and whatever its first cell is."""
    rng = np.random.default_rng(7)
    for first in (None, float("nan")):
        for _ in range(200):
            pages = [np.sort(rng.integers(-30, 90, n)).astype(float if first else int) for n in rng.integers(1, 12, 4)]
            if first:
                pages[rng.integers(4)][0] = first
            want = np.concatenate([row_numbers(y, 14)[0] for y in pages])
            y, page = np.concatenate(pages), np.repeat(range(4), [len(p) for p in pages])
            cut, starts = int(rng.integers(1, len(y))), lambda p: np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            one, *state = rows_of_pages(y[:cut], starts(page[:cut]), 14)
            two = rows_of_pages(y[cut:], starts(page[cut:]), 14, *(state if page[cut] == page[cut - 1] else ()))[0]
            assert [*one, *two] == want.tolist()
    assert rows_of_pages(np.array([3, 50]), np.array([0]), 14, float("nan"), 1)[0].tolist() == [1, 1]
    cells = spark.createDataFrame([(p, i, 0, y) for p in (None, 1, 2) for i, y in enumerate([0, 14, 15, 29, 30])], "page int, id int, x int, y int")
    assert sorted((r.page or 0, r.y, r.row) for r in group_cells(cells).collect()) == [(p, y, n) for p in (0, 1, 2) for y, n in [(0, 1), (14, 1), (15, 2), (29, 2), (30, 3)]]
