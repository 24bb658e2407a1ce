import gzip
import hashlib
import random

import pytest
from pyspark.sql import types as T

from loanmart.llm import warc

KIND = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
     T.StructField("sha1", T.StringType()), T.StructField("size", T.LongType())]
)


def pages():
    rng = random.Random(5)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abé<>\r\n") for _ in range(rng.randint(0, 4000))), "x", 1) for i in range(80)]
    rows += [(100 + i, "http://h/same\nX: 1", "copy " * 400, "x", 1) for i in range(30)]
    rows += [(200 + i, None, "short copy", "x", 1) for i in range(3)]
    rows += [(300, "u", None, None, None), (301, "u", "", None, None), (None, "u", "copy " * 400, None, None), (400, "u", "z" * 300000, "", 0)]
    return rows


@pytest.mark.parametrize("split", [700, 5000, 1 << 20])
def test_round_trip(spark, split):
    rows = pages()
    manifest = warc.write_warc(spark.createDataFrame(rows, KIND).repartition(3), file_bytes=20000)
    assert manifest.agg({"records": "sum"}).first()[0] == len(rows)
    got = warc.read_warc(manifest, split_bytes=split).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for i, url, html, *_ in rows:
        r, data = by_id[i], (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        copy = html == "copy " * 400 and i != 129
        assert (r["record_type"], r["refers_to"]) == (("revisit", 129) if copy else ("response", None))
        assert r["payload"] is None if copy else bytes(r["payload"]) == data
        assert (r["url"] is None) == (url is None)


def test_archives_are_gzip_members(spark):
    manifest = warc.write_warc(spark.createDataFrame(pages(), KIND))
    for row in manifest.collect():
        data = open(row["path"].removeprefix("file:"), "rb").read()
        assert len(data) == row["length"]
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == row["records"]


def test_false_magic_is_not_taken():
    record = warc.encode_record(1, "u", b"x" * 50, 50, hashlib.sha1(b"x" * 50).hexdigest(), None)
    noise = warc.MAGIC + b"\x00" * 20 + gzip.compress(b"not a record")
    data = noise + record + warc.MAGIC + record[:20]
    read = lambda at, n: data[at : at + n]
    assert len(list(warc.scan(read, len(data), 0, len(data)))) == 1
    at = len(noise)
    assert not list(warc.scan(read, len(data), 0, at)) and len(list(warc.scan(read, len(data), at, at + 1))) == 1


def test_empty(spark):
    manifest = warc.write_warc(spark.createDataFrame([], KIND))
    assert warc.read_warc(manifest).count() == 0
