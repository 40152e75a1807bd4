"""WARC archives: written with segmented records and chunked bodies, read back by segment reassembly.

A record whose block is longer than a segment is written as a first segment (WARC-Segment-Number 1) and continuation
records that name it by WARC-Segment-Origin-ID, the last with WARC-Segment-Total-Length. The reader groups continuations by
that id, orders them by number, verifies numbers and total length, decodes the chunked transfer framing of the HTTP body and
holds its digest against the stated one. Payloads seen before become revisit records. Each record is a gzip member.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, stage, work_dir

#: Bytes of a segment's block, of a chunk of an HTTP body, and (about) of an archive's payloads.
SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 8192, 4096, 16 << 20
#: Shorter payloads are never revisits.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer coding."""
    parts = [b"%x\r\n%b\r\n" % (len(body[at : at + size]), body[at : at + size]) for at in range(0, len(body), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The body of a chunked message; ValueError where the framing is broken. Extensions and trailers are skipped."""
    at, out = 0, []
    while True:
        line = data.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size without end")
        n = int(data[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(out)
        if data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk of another length than stated")
        out.append(data[at : at + n])
        at += n + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record but for the two line ends that close it. Line ends inside field values become spaces."""
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block


def records(kind: str, ident: str, fields: list[tuple[str, str]], block: bytes, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record, or its segments where its block is longer than a segment."""
    own = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), ("WARC-Date", DATE), *fields]
    if len(block) <= segment:
        yield record(own, block)
        return
    yield record([*own, ("WARC-Segment-Number", "1")], block[:segment])
    last = -(-len(block) // segment)
    for k in range(2, last + 1):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{ident}:s{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{ident}>"), ("WARC-Segment-Number", str(k))]
        if k == last:
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(more, block[(k - 1) * segment : k * segment])


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of an archive's records."""
    whole, at = archive, 0
    while at < len(whole):
        end = whole.find(b"\r\n\r\n", at)
        if not whole.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record begins at byte {at}")
        lines = whole[at:end].split(b"\r\n")[1:]
        fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines)}
        n = int(fields["content-length"])
        yield fields, whole[end + 4 : end + 4 + n]
        at = end + 4 + n
        if whole[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record not closed at byte {at}")
        at += 4


def member(data: bytes) -> bytes:
    """A gzip member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(content: bytes | memoryview) -> Iterator[bytes]:
    """The contents of a file's gzip members, one at a time; ValueError where the last is cut off."""
    whole, at, step = memoryview(content), 0, 1 << 14
    while at < len(whole):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(whole):
                raise ValueError("gzip member cut off")
            out.append(unpack.decompress(whole[at : at + step]))
            at = min(at + step, len(whole)) - len(unpack.unused_data)
        yield b"".join(out)


def ident(row: int, page: str | None) -> str:
    """The name of a row's record, which holds the id of its page."""
    return f"urn:page:{row}" + ("" if page is None else f":{urllib.parse.quote(page, safe='')}")


def page_of(name: str) -> str | None:
    found = name.split(":")[3:]
    return urllib.parse.unquote(found[0]) if found else None


def joined(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length of the last, bytes) in any order; ValueError if one is missing or lengths differ."""
    segments = sorted(segments, key=lambda s: s[0])
    block, totals = b"".join(s[2] for s in segments), [s[1] for s in segments if s[1] is not None]
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)) or len(segments) > 1 and totals != [len(block)]:
        raise ValueError("segments are missing or their total length differs")
    return block


def payload(block: bytes) -> bytes:
    """The body of an HTTP response, transfer coding undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write a record (and its continuations) for each row to archives of about file_bytes under path.

    Of rows with equal payloads of at least revisit_bytes, the one with the largest id is a response and the others revisit
    it; of rows that also tie on the id, exactly one is the response. Ids may have any type that orders. Null payloads are
    empty, null ids and addresses are left out of the record. Extra columns are left out. An empty table writes no records.
    """
    body = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"), F.monotonically_increasing_id().alias("row"))
    # Written once: row numbers of two scans might differ, where splits follow the cores that are alive.
    rows = stage(rows.withColumn("digest", F.sha1("body")).withColumn("n", F.octet_length("body").cast("long")), "warc-rows")
    # Digests first and narrow; only groups of equal long payloads are met again.
    long = rows.where(F.col("n") >= revisit_bytes).select("id", "row", "digest")
    heads = long.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1")
    heads = stage(heads.select(F.col("digest").alias("d"), F.col("head.id").alias("of"), F.col("head.row").alias("of_row")), "warc-heads")
    total, rows_n = (x or 0 for x in rows.agg(F.sum("n"), F.count(F.lit(1))).first())
    revisits = long.join(heads, F.col("digest") == F.col("d")).where("row <> of_row").select(F.col("row").alias("r"), "of", "of_row")
    revisits = stage(revisits, "warc-revisits")
    marked = rows.join(revisits, F.col("row") == F.col("r"), "left")

    def build(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for r in batch.slice(at, 200).to_pylist():
                    name, body = ident(r["row"], r["id"]), r["body"]
                    fields = [("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("Content-Type", "application/http; msgtype=response")]
                    fields += [("WARC-Target-URI", r["url"])] if r["url"] is not None else []
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                    if r["of_row"] is None:
                        made = records("response", name, fields, http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(body), segment)
                    else:
                        fields += [("WARC-Refers-To", f"<{ident(r['of_row'], r['of'])}>"), ("WARC-Profile", REVISIT_PROFILE)]
                        made = records("revisit", name, fields, http + b"\r\n", segment)
                    out += [member(x + b"\r\n\r\n") for x in made]
                # A member's last byte is the highest of its content's length, zero below 16 MB: the sink writes it.
                yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.binary())], ["value"])

    if segment >= 1 << 23:
        raise ValueError("segments must be shorter than 8 MB")
    # Each scan task writes its own archives. The text sink writes each value's bytes as they are and a zero byte, on any
    # file system that Spark can write, and begins a new archive after so many records.
    most = max(1, int(file_bytes * rows_n / max(1, total)))
    made = marked.select(F.col("id").cast("string").alias("id"), "url", "body", "row", "digest", F.col("of").cast("string").alias("of"), "of_row")
    made = made.mapInArrow(build, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", most).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """(record_id, record_type, refers_to, uri, digest, payload) of every record under path, segments joined and transfer
    coding undone; a revisit's payload is null. A response whose payload has not the stated digest is an error."""

    def split(batches):
        for batch in batches:
            for content in batch.column("content"):
                for at in _runs(x for m in members(content.as_buffer()) for x in parse(m)):
                    yield pa.RecordBatch.from_pylist(at, schema=PARTS)

    PARTS = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("whole", pa.bool_()), ("block", pa.binary())])
    schema = "origin string, number int, total long, kind string, refers_to string, uri string, digest string, whole boolean, block binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    parts = files.select("content").mapInArrow(split, schema)
    # Records of one segment pass straight on; only the others are grouped by their origin.
    several = (
        parts.where("not whole").groupBy("origin")
        .agg(
            F.collect_list(F.struct("number", "total", "block")).alias("segments"),
            *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("kind", "refers_to", "uri", "digest")],
        )
    )
    one = parts.where("whole").select("origin", F.array(F.struct("number", "total", "block")).alias("segments"), "kind", "refers_to", "uri", "digest")

    def rebuild(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                bodies = []
                for kind, segments, digest in zip(*(some.column(c).to_pylist() for c in ("kind", "segments", "digest"))):
                    if kind is None:
                        raise ValueError("a continuation's first segment is missing")
                    block = joined([(s["number"], s["total"], s["block"]) for s in segments])
                    bodies.append(payload(block) if kind == "response" else None)
                    if kind == "response" and digest and hashlib.sha1(bodies[-1]).hexdigest() != digest:
                        raise ValueError("a payload has another digest than stated")
                yield pa.RecordBatch.from_arrays([some.column(c) for c in ("origin", "kind", "refers_to", "uri", "digest")] + [pa.array(bodies, pa.binary())], ["record_id", "record_type", "refers_to", "uri", "digest", "payload"])

    return one.unionByName(several.select(one.columns)).mapInArrow(rebuild, "record_id string, record_type string, refers_to string, uri string, digest string, payload binary")


def _runs(found: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[list[dict]]:
    bare = lambda v: v.strip("<>") if v else None
    rows: list[dict] = []
    for fields, block in found:
        more = fields["warc-type"] == "continuation"
        number, total = (fields.get(k) for k in ("warc-segment-number", "warc-segment-total-length"))
        rows.append({
            "origin": bare(fields["warc-segment-origin-id"] if more else fields["warc-record-id"]), "number": int(number or 1), "total": int(total) if total else None,
            "kind": None if more else fields["warc-type"], "refers_to": bare(fields.get("warc-refers-to")), "uri": fields.get("warc-target-uri"),
            "digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "whole": number is None, "block": block,
        })
        if len(rows) >= 500:
            yield rows
            rows = []
    if rows:
        yield rows


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT_BYTES) -> DataFrame:
    """Write archives to the shared folder and read them back: (page_id, payload_bytes, payload_digest, record_type,
    refers_to) of each record. Length and digest are those of the reassembled payload, for a revisit of the response that it
    refers to; a revisit of a response that isn't there, or has another digest than the revisit states, is an error."""
    path = work_dir(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col, segment)
    back = read_archives(pages.sparkSession, path)

    def page(names: pa.Array) -> pa.Array:
        return pa.array([None if x is None else page_of(x) for x in names.to_pylist()], pa.string())

    page.__annotations__ = {"names": pa.Array, "return": pa.Array}
    kind, page = pages.schema[id_col].dataType, F.arrow_udf(page, "string")
    back = back.select("record_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha"))
    back = stage(back.select("*", page("record_id").cast(kind).alias("page"), page("refers_to").cast(kind).alias("of")), "warc-read")
    found = back.where("record_type = 'response'").select(F.col("record_id").alias("found"), F.col("n").alias("found_n"), F.col("sha").alias("found_sha"))
    revisits = back.where("record_type = 'revisit'").join(found, F.col("refers_to") == F.col("found"), "left")
    same = F.when(F.col("found_sha") == F.col("digest"), F.col("found_sha")).otherwise(F.raise_error(F.lit("a revisit's response is missing or has another digest")))
    named = lambda n, sha, of: [F.col("page").alias("page_id"), F.col(n).alias("payload_bytes"), sha.alias("payload_digest"), "record_type", of.alias("refers_to")]
    return back.where("record_type = 'response'").select(*named("n", F.col("sha"), F.col("of"))).unionByName(revisits.select(*named("found_n", same, F.col("of"))))
