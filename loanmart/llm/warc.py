"""WARC archives: one gzip member per record, read back in splits of byte ranges.

Writing: the largest id of each payload shared by several pages becomes a response, the
others revisits that refer to it; short payloads are always responses.  A task writes
files under names of its own and returns them; only files in the stored manifest count, so
attempts that failed or ran twice leave nothing that is read.

Reading: the manifest is cut into byte ranges.  A task searches its range for the gzip magic,
takes a place for a member only if it decodes, checksum included, to a record with a proper
header, and owns the records that start inside, reading past its end for the last one.

Defined cases: a null payload is empty; a null url is left out of the header; a null id
never is the response of a group that has ids; rows equal in id and payload are all
responses; an empty table gives an empty manifest and no records; columns other than
the named three are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..scratch import new_path, stored
from .common import open_store, qualified

DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 1000
FILE_BYTES = 256 << 20
SPLIT_BYTES = 8 << 20
MAX_TASKS = 20_000
MAGIC = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_MORE = 1 << 20
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _from_urn(urn: str | None) -> int | None:
    last = urn.strip("<>").rpartition(":")[2] if urn else "none"
    return None if last == "none" else int(last)


def encode_record(page_id, url, payload: bytes | None, size: int, sha1: str, refers_to, date: str = DATE) -> bytes:
    """One record as a gzip member; without a payload it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # whatever could end the line or the header travels percent-encoded
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if payload is None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_urn(refers_to)}")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + _END + block + _END) + pack.flush()


def decode_record(data: bytes) -> dict | None:
    """Header fields and block of an unpacked record; None if it is none."""
    if not data.startswith(b"WARC/1."):
        return None
    head, sep, rest = data.partition(_END)
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not sep or not length.isdigit() or len(rest) != int(length) + len(_END) or not rest.endswith(_END):
        return None
    return {"fields": fields, "block": rest[: int(length)]}


def scan(read, size: int, start: int, end: int) -> Iterator[dict]:
    """Records that start in [start, end) of a file of ``size`` bytes; ``read(at, n)`` gives bytes."""
    have = read(start, min(end + len(MAGIC) - 1, size) - start)
    at = 0
    while True:
        at = have.find(MAGIC, at)
        if at < 0 or start + at >= end:
            return
        unpack, out, fed, bad = zlib.decompressobj(31), [], at, False
        while not unpack.eof:
            piece = have[fed : fed + _MORE]
            if not piece:
                more = read(start + len(have), min(_MORE, size - start - len(have)))
                if not more:
                    bad = True
                    break
                have += more
                continue
            try:
                out.append(unpack.decompress(piece))
            except zlib.error:
                bad = True
                break
            fed += len(piece)
            if len(out) == 1 and len(out[0]) >= 7 and not out[0].startswith(b"WARC/1."):
                bad = True
                break
        record = None if bad else decode_record(b"".join(out))
        if record is None:
            at += 1
            continue
        at = fed - len(unpack.unused_data)
        yield record


def _plain(record: dict) -> tuple:
    fields, block = record["fields"], record["block"]
    http, _, payload = block.partition(_END)
    claimed = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    kind = fields["warc-type"]
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != claimed:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    else:
        size = int(http.rpartition(b"Content-Length:")[2].split(b"\r\n")[0])
        digest, payload = claimed, None
    refers = _from_urn(fields.get("warc-refers-to"))
    return _from_urn(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, refers, payload


def write_warc(
    pages: DataFrame, folder: str | None = None, page_id="page_id", url="url", html="html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the pages below ``folder`` and return the manifest (path, length, records)."""
    spark = pages.sparkSession
    folder = qualified(spark, folder or new_path(spark, "warc"))
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        text.alias("html"),
        F.octet_length(text).cast("long").alias("size"),
        F.sha1(F.encode(text, "UTF-8")).alias("sha1"),
    )
    shared = (
        rows.where(F.col("size") >= min_revisit_bytes)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and keeper is not null")
        .drop("n")
    )
    rows = rows.join(shared, "sha1", "left")
    same = F.col("page_id").eqNullSafe(F.col("keeper")) | F.col("keeper").isNull()
    rows = rows.select(
        "page_id", "url", "size", "sha1",
        F.when(same, F.col("html")).alias("html"),
        F.when(~same, F.col("keeper")).alias("refers_to"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_store(folder)
        fs.create_dir(base, recursive=True)
        out, path, length, n, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    path, length, n = f"{base}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                number = [None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to)]
                payload = None if row.html is None else row.html.encode()
                data = encode_record(number[0], row.url, payload, int(row.size), row.sha1, number[1])
                out.write(data)
                length, n = length + len(data), n + 1
                if length >= file_bytes:
                    out.close()
                    out = None
                    done.append((path, length, n))
        if out is not None:
            out.close()
            done.append((path, length, n))
        prefix = folder[: folder.rindex(base)]
        yield pd.DataFrame([(prefix + p, b, k) for p, b, k in done], columns=["path", "length", "records"])

    return stored(rows.mapInPandas(write, "path string, length long, records long"), "manifest")


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the archives a manifest lists."""
    starts = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.where("length > 0").select("path", "length", starts.alias("start"))
    # a split is a few bytes here and some MB to read: a number given by hand is not coalesced
    n = splits.count()
    splits = splits.repartition(max(1, min(n, MAX_TASKS)), F.col("path"), F.col("start"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for split in batch.itertuples(index=False):
                fs, path = open_store(split.path)
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    end = min(split.start + split_bytes, split.length)
                    for record in scan(lambda at, n: file.read_at(n, at), split.length, split.start, end):
                        plain = _plain(record)
                        rows.append(plain if payloads else (*plain[:-1], None))
                        held += len(record["block"])
                        if held > split_bytes:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return splits.mapInPandas(read, RECORD)
