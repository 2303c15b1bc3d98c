"""WARC archives of pages: a writer, and a reader that salvages what damage has left.

Archives are written by Spark's text sink, whose line end stands for the last bytes of a chunk of records, so files appear by
Spark's commit in any store it writes to, and hold nothing but WARC: one gzip member a record, or plain records. They are read
with the binaryFile source. Where a member or record fails a check (header, lengths, checksums, digests), the reader searches for
the next gzip member or version line that passes all of them and goes on there; the bytes between are logged as a gap.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docrecon.llm.common import load, scratch_dir

# The WARC 1.1 format.
VERSION, GZIP, END = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of members in a chunk (one row that is written), and chunks in a file.
CHUNK, CHUNKS = 4 << 20, 16
#: A header longer than this fails the check.
HEAD = 1 << 20
NAME = "urn:docrecon:page:"


def digest32(data: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _page_name(page: int | None, digest: str, place: str = "") -> str:
    return f"<{NAME}{'' if page is None else page}:{digest}{place and ':' + place}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + b"1\r\n" + head.encode() + b"\r\n" + block + END


def _page_record(page: int | None, url: str | None, payload: bytes, first: int | None, is_revisit: bool, date: str, place: str) -> bytes:
    digest = digest32(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", _page_name(page, digest, place if is_revisit else "")), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", uri)] if uri else []
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _page_name(first, digest)), ("WARC-Refers-To-Date", date)]
    else:
        block += payload
    return _record([*fields, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/http; msgtype=response")], block)


def write_warc(pages: DataFrame, path: str, at_least: int = 0, gzip: bool = True, level: int = 6, date: str | None = None) -> None:
    """Archives of pages (page_id, url, html; other columns are left out) in the folder path.

    Payload: html in UTF-8, null as empty. Of the pages with equal payloads of at_least bytes or more, those with the smallest
    page_id (null is larger than any other) are responses, the others revisits of it; so all rows that repeat the smallest
    page_id are responses, equal ones under one record id. The smallest id of a payload is taken from partial ones and joined
    back by digest; a payload that many pages share is a key with one row on the other side, which Spark splits.
    """
    spark = pages.sparkSession
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    firsts = rows.where(F.octet_length("payload") >= at_least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "first", F.expr("first IS NOT NULL AND NOT first <=> page_id AND octet_length(payload) >= " + str(int(at_least))).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docrecon.llm.common import task_number

        part, done, held, size = task_number(), 0, [], 0

        def packed(record: bytes) -> bytes:
            if not gzip:
                return record
            squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
            return squeeze.compress(record) + squeeze.flush()

        def chunk() -> pa.RecordBatch:
            info = packed(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{NAME.replace('page', 'info')}{part}.{done}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: docrecon\r\nformat: WARC File Format 1.1\r\n"))
            data = info + b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([_without_end(data, gzip)], pa.binary())], ["value"])

        for batch in batches:
            for page, url, payload, first, again in zip(*(batch.column(i).to_pylist() for i in range(5))):
                held.append(packed(_page_record(page, url, payload, first, again, date, f"{part}.{done}")))
                size, done = size + len(held[-1]), done + 1
                if size >= CHUNK:
                    yield chunk()
                    held, size = [], 0
        if held:
            yield chunk()

    chunks = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    chunks.write.option("lineSep", _line_end(gzip)).option("maxRecordsPerFile", CHUNKS).text(path)


def _line_end(gzip: bool) -> str:
    return "\0" if gzip else END.decode()


def _without_end(data: bytes, gzip: bool) -> bytes:
    """The chunk without what the sink appends: a plain record's end, or a zero, which is the last byte of a member of less than
    16 MB; behind a longer one it is padding, which readers of gzip pass over."""
    if not gzip:
        return data[: -len(END)]
    return data[:-1] if data.endswith(b"\0") else data


class Broken(Exception):
    """Why a record or member fails."""


def _same(told: str, data: bytes) -> bool:
    """Whether a labelled digest is that of data; of an unknown algorithm nothing is known."""
    kind, _, value = told.strip().partition(":")
    if kind.lower() not in ("sha1", "sha256", "sha512", "md5"):
        return True
    h = hashlib.new(kind.lower(), data)
    return value.upper().rstrip("=") == base64.b32encode(h.digest()).decode().rstrip("=") or value.lower() == h.hexdigest()


def _payload(fields: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header of a block, if it has one, and the rest."""
    if fields.get("content-type", "").lower().startswith("application/http"):
        head, end, rest = block.partition(END)
        return (head, rest) if end else (b"", block)
    return b"", block


def read_record(data: bytes, at: int = 0) -> tuple[int, dict[str, str], bytes]:
    """The record that begins at this place: where the next one does, its fields by lower-case name, its block. Raises Broken."""
    if not data.startswith(VERSION, at):
        raise Broken("no version line")
    head = data.find(END, at, at + HEAD)
    if head < 0:
        raise Broken("no end of header")
    fields: dict[str, str] = {}
    name = ""
    for line in data[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Broken("header line without a name")
        fields[name] = value.strip()
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit() or len(length) > 18:
        raise Broken("no content length")
    if not fields.get("warc-type"):
        raise Broken("no type")
    start, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != END:
        raise Broken("block shorter than its length" if end + 4 > len(data) else "no end behind the block")
    block = data[start:end]
    if "warc-block-digest" in fields:
        if not _same(fields["warc-block-digest"], block):
            raise Broken("block digest")
    elif "warc-payload-digest" in fields and fields["warc-type"] != "revisit" and not _same(fields["warc-payload-digest"], _payload(fields, block)[1]):
        raise Broken("payload digest")
    return end + 4, fields, block


def read_member(data: bytes, at: int = 0) -> tuple[int, bytes, str]:
    """Where the member that begins at this place ends, what it holds, and what is wrong with it; a member that breaks off gives
    what could be inflated."""
    inflate, out, pos, step = zlib.decompressobj(31), [], at, 1 << 18
    view = memoryview(data)
    while not inflate.eof:
        piece = view[pos : pos + step]
        if not len(piece):
            return at, b"".join(out), "member breaks off"
        before = inflate.copy() if step > 1 else None
        try:
            out.append(inflate.decompress(piece))
        except zlib.error as e:
            if before is None:
                return at, b"".join(out), f"member: {str(e).rpartition(': ')[2]}"
            inflate, step = before, 64 if step > 64 else 1  # up to where the damage shows
            continue
        pos += len(piece)
    return pos - len(inflate.unused_data), b"".join(out), ""


#: What scan() yields: ('record', start, length, fields, block) or ('gap', start, length, reason, b"").
Found = tuple[str, int, int, dict | str, bytes]


def _plain(data: bytes, at: int = 0) -> Iterator[Found]:
    gap, why = None, ""
    while at < len(data):
        if data.startswith(b"\r\n", at) and gap is None:  # more line ends than needed
            at += 2
            continue
        try:
            end, fields, block = read_record(data, at)
        except Broken as e:
            if gap is None:
                gap, why = at, str(e)
            at = data.find(VERSION, at + 1)
            at = len(data) if at < 0 else at
            continue
        if gap is not None:
            yield "gap", gap, at - gap, why, b""
            gap = None
        yield "record", at, end - at, fields, block
        at = end
    if gap is not None:
        yield "gap", gap, len(data) - gap, why, b""


def scan(data: bytes) -> Iterator[Found]:
    """All records of an archive and the gaps between them, in order. Places are those of the file; those of what a member holds
    are its own. Zeros between members and line ends between records are no gaps."""
    at, gap, why = 0, None, ""
    nearest: dict[bytes, int] = {}
    known: set[str] = set()  # names of what was salvaged: a member that isn't compressed shows its records a second time

    def following(place: int) -> int:
        for mark in (GZIP, VERSION):
            if nearest.get(mark, -1) < place:
                found = data.find(mark, place)
                nearest[mark] = len(data) if found < 0 else found
        return min(nearest.values())

    while at < len(data):
        found: list[Found] = []
        salvaged: list[Found] = []
        if data.startswith(GZIP, at):
            end, text, wrong = read_member(data, at)
            inside = list(_plain(text)) if text else []
            records = [x for x in inside if x[0] == "record"]
            if not wrong and (records or not text):
                found = [(kind, at, end - at, f"in a member: {x}" if kind == "gap" else x, block) for kind, _, _, x, block in inside]
            else:
                wrong = wrong or "member holds no record"
                salvaged = [(kind, at, 0, x, block) for kind, _, _, x, block in records] if gap is None else []
                end = at
        else:
            try:
                end, fields, block = read_record(data, at)
                found, wrong = [("record", at, end - at, fields, block)], ""
            except Broken as e:
                end, wrong = at, str(e)
        if end > at:
            if gap is not None:
                yield "gap", gap, at - gap, why, b""
                gap = None
            yield from (x for x in found if not (known and x[0] == "record" and x[3].get("warc-record-id") in known))
            at = end
            while at < len(data) and (data[at] == 0 or data.startswith(b"\r\n", at)):
                at += 1 if data[at] == 0 else 2
            continue
        if gap is None:
            gap, why = at, wrong
        known.update(x[3].get("warc-record-id", "") for x in salvaged)
        yield from salvaged
        at = following(at + 1)
    if gap is not None:
        yield "gap", gap, len(data) - gap, why, b""


FOUND = "file string, kind string, start long, length long, reason string, record_type string, record_id string, target_uri string, refers_to string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record (kind 'record') and each gap (kind 'gap', with reason) of the archives in path.

    start and length are bytes of the file; a record that was salvaged out of a damaged member has length 0 and starts where
    the member does, and the member is in a gap. payload_bytes and payload_digest (bare base32 SHA-1, if the digest is one) are of
    the full payload, so a revisit has those its headers tell; payload is what the archive holds, or null where it isn't asked
    for. A file is read whole by one task (write_warc ends a file after 64 MB of members), a damaged one too; an archive
    beyond 2 GB is more than the binaryFile source reads. Empty files have no rows. Records whose version line stands inside
    the block of a damaged plain record can't be told from those behind it and are found too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = {"start": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary(), "fields": pa.map_(pa.string(), pa.string())}

    def row(file: str, found: Found) -> dict:
        kind, start, length, x, block = found
        out = dict.fromkeys(names) | {"file": file, "kind": kind, "start": start, "length": length}
        if kind == "gap":
            return out | {"reason": x}
        head, body = _payload(x, block)
        digest, size = x.get("warc-payload-digest", ""), len(body)
        told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
        if x["warc-type"] == "revisit":
            size = int(told[1]) if told else None
        digest = digest[5:] if digest.lower().startswith("sha1:") else None if digest else digest32(body)
        out |= {"record_type": x["warc-type"], "record_id": x.get("warc-record-id"), "target_uri": x.get("warc-target-uri"), "refers_to": x.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest}
        return out | {"fields": list(x.items()), "payload": body} if payload else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for found in scan(content.as_py()):
                    rows.append(row(file, found))
                    size += len(found[4]) * payload
                    if size >= CHUNK or len(rows) >= 10_000:
                        yield _batch(rows, names, kinds)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names, kinds)

    return files.mapInArrow(run, FOUND)


def _batch(rows: list[dict], names: list[str], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)


def records(found: DataFrame) -> DataFrame:
    return found.where("kind = 'record'")


def gaps(found: DataFrame) -> DataFrame:
    """file, start, length, reason of the quarantined bytes."""
    return found.where("kind = 'gap'").select("file", "start", "length", "reason")


def page_of(name: str) -> F.Column:
    """The page id in the name of a record that write_warc has written, null where that was null."""
    return F.regexp_extract(name, f"^<{NAME}(-?[0-9]*):", 1).try_cast("long")


def archived_pages(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes long, payload_digest, record_type string, refers_to long of the pages in archives of write_warc."""
    pages = records(found).where(F.col("record_type").isin("response", "revisit"))
    return pages.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


def op12_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/warc"
    write_warc(load(spark, sf_dir, "pages"), path)
    return archived_pages(read_warc(spark, path, payload=False))


BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(hex, {5 * k + 1}, 5))::BIGINT >> {s}) & 31 AS INTEGER) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0)
)
OP12_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS least FROM p)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to FROM f"""
