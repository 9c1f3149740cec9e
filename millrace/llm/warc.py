"""WARC archives in Zstandard, one frame for each record, with a dictionary in a leading skippable frame.

Writing: each task packs its rows into archives of bounded size. An archive begins with a skippable frame (magic 0x184D2A5D)
that holds a dictionary trained on the first records of that archive (bounded), itself a Zstandard frame; then one frame for
each record. Archive names hold the task attempt, and a manifest, written by the tasks that succeeded, says which archives
count; what a lost or repeated attempt left behind is never read.

Which record is the response: of records with equal payloads of at least 1000 bytes that with the largest page_id; the
others are revisits without a payload. Smaller payloads are all responses.

Reading: archives of any writer, with or without a dictionary. For each archive the dictionary is loaded, frames are walked and
decoded one at a time, and each record's version line, required headers, content length and block and payload digests are checked; a
violation raises ValueError, or with strict=False yields a row with `error`. Ids are text, and those of this writer (`urn:page:N`)
give page_id and refers_to as well. SHA-1 digests come out in lower-case hex, whether written in hex or in base32; digests of other
kinds come out as they are, checked if Python knows the kind. A response's payload is its HTTP body (checked as it stands or, if
chunked, without the chunks' frames), that of other records with a block (warcinfo, request, metadata, resource, conversion and
unknown types) the whole block; a revisit has none.

Null html is an empty payload. A null url is left out of the headers. A null page_id counts as the least; rows that share the
largest page_id and the payload are all responses. Control characters in a URL are percent-encoded. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import materialise, shared_path

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Bytes of records in an archive, of records for its dictionary, and of the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 8 << 20, 512 << 10, 16 << 10
LEAST_BYTES = 1000
#: Repeated payloads' digests up to this number are broadcast to the pages; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to (page_id, url, payload, digest, refers_to): refers_to is set for revisits."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    repeated = materialise(rows.where(F.col("size") >= LEAST_BYTES).groupBy("digest", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "kept"), "repeated")
    few = repeated.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(repeated) if few else repeated, ["digest", "size"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.expr("case when kept is not null and not (page_id <=> kept) then kept end").alias("refers_to"))


def _header_value(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    block = b""
    if refers_to is None:
        head.append("Content-Type: application/http; msgtype=response")
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive of the records."""
    import zstandard

    sample, size = [], 0
    for r in records:
        if size + len(r) > SAMPLE_BYTES and sample:
            break
        sample.append(r)
        size += len(r)
    trained = b""
    if len(sample) >= 8:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
        except zstandard.ZstdError:  # too little in common
            pass
    body = zstandard.ZstdCompressor(level=3).compress(trained) if trained else b""
    coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_content_size=True, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(body)), body, *(coder.compress(r) for r in records)])


def frame_ends(data: bytes, at: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each Zstandard frame from `at` on, from the frame and block headers."""
    import zstandard

    while at < len(data):
        begin = at
        magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no Zstandard frame at byte {at}")
        head = data[at : at + 18]
        at += zstandard.frame_header_size(head)
        while True:
            if at + 3 > len(data):
                raise ValueError("a frame is cut off")
            block = int.from_bytes(data[at : at + 3], "little")
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            if block & 1:
                break
        at += 4 * zstandard.get_frame_parameters(head).has_checksum
        if at > len(data):
            raise ValueError("a frame is cut off")
        yield begin, at


def records_of(archive: bytes) -> Iterator[bytes]:
    import zstandard

    if len(archive) < 8:
        raise ValueError("no leading frame")
    magic, size = struct.unpack_from("<II", archive)
    trained, begin = None, 0
    if magic == SKIPPABLE:
        body, begin = archive[8 : 8 + size], 8 + size
        if len(body) != size:
            raise ValueError("the dictionary's frame is cut off")
        if body[:4] == struct.pack("<I", FRAME):
            body = zstandard.ZstdDecompressor().decompress(body)
        trained = zstandard.ZstdCompressionDict(body) if body else None
    decoder = zstandard.ZstdDecompressor(dict_data=trained)
    for s, e in frame_ends(archive, begin):
        yield decoder.decompress(archive[s:e])


#: Lengths of digests, by kind, in bytes.
_KINDS = {"sha1": 20, "sha256": 32, "sha512": 64, "md5": 16}


def digest_of(header: str | None) -> tuple[str, str] | None:
    """Kind and value of a digest header; the value in lower-case hex if it is hex or base32 of the kind's length."""
    if not header:
        return None
    kind, colon, value = header.strip().rpartition(":")
    kind = kind.lower().replace("-", "") if colon else "sha1"
    size = _KINDS.get(kind)
    if size and len(value) == 2 * size and all(c in "0123456789abcdefABCDEF" for c in value):
        return kind, value.lower()
    if size and len(value.rstrip("=")) == -(-size * 8 // 5):
        try:
            return kind, base64.b32decode(value.upper().rstrip("=") + "=" * (-len(value.rstrip("=")) % 8)).hex()
        except ValueError:
            pass
    return kind, value


def _has(digest: tuple[str, str] | None, data: bytes) -> bool:
    """Whether the data has the digest; a digest of an unknown kind says nothing."""
    return digest is None or digest[0] not in _KINDS or hashlib.new(digest[0], data).hexdigest() == digest[1]


def _unchunked(body: bytes) -> bytes | None:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        try:
            n = int(size, 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return None


def headers_of(lines: list[str]) -> dict[str, str]:
    """Named headers, names in lower case; a line that begins with white space goes on with the one before."""
    headers: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in " \t" and name:
            headers[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError(f"not a header: {line[:80]!r}")
        headers[name] = value.strip()
    return headers


def parse(record: bytes) -> dict:
    """Headers and payload of one record; ValueError if it isn't sound."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    headers = headers_of(lines[1:])
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - headers.keys():
        raise ValueError(f"no {', '.join(sorted(missing))}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length isn't Content-Length")
    kind, block = headers["warc-type"].lower(), rest[:-4]
    if not _has(digest_of(headers.get("warc-block-digest")), block):
        raise ValueError("the block doesn't have the digest in the header")
    payload, digest = None if kind in ("revisit", "continuation") else block, digest_of(headers.get("warc-payload-digest"))
    if kind == "response" and headers.get("content-type", "application/http").lower().startswith("application/http"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep or not http.startswith(b"HTTP/"):
            raise ValueError("not a sound HTTP response")
        fields = dict(x.lower().split(b":", 1) for x in http.split(b"\r\n")[1:] if b":" in x)
        chunked = b"chunked" in fields.get(b"transfer-encoding", b"")
        if not chunked and "warc-truncated" not in headers and (length := fields.get(b"content-length", b"").strip()) and (not length.isdigit() or int(length) != len(payload)):
            raise ValueError("not a sound HTTP response")
        if not _has(digest, payload) and not (chunked and (plain := _unchunked(payload)) is not None and _has(digest, plain)):
            raise ValueError("the payload doesn't have the digest in the header")
    elif kind in ("response", "resource", "conversion") and not _has(digest, block):
        raise ValueError("the payload doesn't have the digest in the header")
    elif kind == "revisit" and not (digest and ("warc-refers-to" in headers or "warc-refers-to-target-uri" in headers)):
        raise ValueError("a revisit without digest or what it refers to")
    record_id, refers_to = (headers.get(h, "").strip("<>") or None for h in ("warc-record-id", "warc-refers-to"))
    page = lambda x: int(x[9:]) if x and re.fullmatch(r"urn:page:-?\d{1,19}", x) else None
    return {"record_id": record_id, "page_id": page(record_id), "url": headers.get("warc-target-uri"), "record_type": kind, "payload_digest": digest and digest[1], "payload": payload, "refers_to_id": refers_to, "refers_to": page(refers_to)}


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        attempt, held, size, n = uuid.uuid4().hex, [], 0, 0

        def put() -> pa.RecordBatch:
            name = f"{attempt}-{n:06d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(pack(held))
            return pa.record_batch([pa.array([name]), pa.array([len(held)], pa.int64())], ["archive", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                held.append(record_bytes(*(batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to"))))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put()
                    held, size, n = [], 0, n + 1
        if held:
            yield put()

    return run


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Write the records (as of plan_records) as archives under path, a folder that executors and driver share; returns the manifest (archive, records)."""
    return materialise(records.mapInArrow(_write(path), "archive string, records long"), "manifest")


_FIELDS = [("record_id", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("error", pa.string())]
SCHEMA = "archive string, record_id string, refers_to_id string, page_id long, url string, record_type string, payload_digest string, payload binary, refers_to long, payload_bytes long, error string"


def _read(strict: bool, payloads: bool):
    def rows(archive: bytes) -> Iterator[dict]:
        try:
            for record in records_of(archive):
                try:
                    x = parse(record)
                    x["payload_bytes"] = None if x["payload"] is None else len(x["payload"])
                    yield x if payloads else x | {"payload": None}
                except (ValueError, UnicodeDecodeError) as e:
                    if strict:
                        raise ValueError(str(e)) from e
                    yield {"error": str(e)}
        except Exception as e:
            if strict:
                raise ValueError(f"unsound archive: {e}") from e
            yield {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                held: list[dict] = []
                size = 0

                def out() -> pa.RecordBatch:
                    return pa.record_batch([pa.array([name.as_py()] * len(held)), *(pa.array([x.get(k) for x in held], t) for k, t in _FIELDS)], ["archive", *(k for k, _ in _FIELDS)])  # noqa: B023

                for x in rows(content.as_py()):
                    held.append(x)
                    size += len(x.get("payload") or b"")
                    if len(held) >= 2000 or size >= 4 << 20:
                        yield out()
                        held, size = [], 0
                if held:
                    yield out()

    return run


def read_archives(spark: SparkSession, path: str, manifest: DataFrame | None = None, strict: bool = True, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives under path (of those in the manifest, if given): archive, record_id, refers_to_id, page_id,
    url, record_type, payload_digest, payload (null for revisits, or always without payloads), refers_to, payload_bytes, error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    if manifest is not None:
        files = files.join(F.broadcast(manifest.select("archive")) if manifest.count() <= BROADCAST_ROWS else manifest.select("archive"), "archive", "left_semi")
    return files.mapInArrow(_read(strict, payloads), SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Give revisits the payload length of the response that they refer to, by page_id and digest."""
    full = records.where("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("of_response"))
    full = full.select(F.col("page_id").alias("refers_to"), "payload_digest", "of_response")
    revisits = records.where("record_type = 'revisit'").join(full, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("of_response"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return records.where("record_type != 'revisit'").select(columns).unionByName(revisits.select(columns))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = shared_path(spark, "warc")
    manifest = write_archives(plan_records(pages), path)
    records = materialise(read_archives(spark, path, manifest, payloads=False).drop("payload"), "records")
    return resolved(records).drop("url")


SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as n, sha1(payload) as digest from p),
k as (select *, case when n >= 1000 then max(page_id) over (partition by n, digest) else page_id end as kept from d)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when page_id is distinct from kept then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from kept then kept end as refers_to from k
"""
