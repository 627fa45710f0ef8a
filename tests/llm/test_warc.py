import base64
import gzip
import hashlib

import pytest

from gridcast.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u", ""), (10**17 + 1, "u", "é" * 9),
    (10**17 + 2, "u", "é" * 9), (5, "u\r\nX: y", "long " * 200_000), (6, "u", "WARC/1.1\r\n\r\n\x1f"), (None, "u", "<p>x</p>"), (None, "u", "only"),
]


def want(rows, least=0):
    top = {}
    for k, _, h in rows:
        if k is not None:
            top[h or ""] = max(top.get(h or "", k), k)
    out = []
    for k, _, h in rows:
        p = (h or "").encode()
        t = top.get(h or "")
        other = len(p) >= least and t is not None and k != t
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((k, len(p), digest, "revisit" if other else "response", t if other else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, byte_range", [(0, warc.RANGE), (0, 97), (5, 1000)])
def test_round_trip(spark, least, byte_range):
    got = warc.archive_round_trip(spark.createDataFrame(ROWS, PAGES), least, byte_range)
    assert sorted(map(tuple, got.collect()), key=str) == want(ROWS, least)


def test_given_pages(given):
    pages = given("pages")
    got = warc.archive_round_trip(pages, byte_range=5000)
    assert sorted(map(tuple, got.collect()), key=str) == want([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_extra_columns_and_repeated_rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([ROWS[0], ROWS[0], ROWS[1]], PAGES)
    for c in ("id", "u", "payload", "h", "n", "top", "leader"):
        df = df.withColumn(c, F.lit(1))
    assert sorted(map(tuple, warc.archive_round_trip(df).collect()), key=str) == want([ROWS[0], ROWS[0], ROWS[1]])


def test_every_range_owns_the_records_that_start_in_it(spark, tmp_path):
    """False gzip magics between and inside members, foreign members and plain garbage are passed over."""
    noise = b"\x1f\x8b\x08garbage" + gzip.compress(b"no record")
    members = [warc.record(i, f"http://x/{i}", bytes([i]) * (50 * i) + b"\x1f\x8b\x08" * 3, None) for i in range(1, 30)]
    data, places = b"", []
    for i, m in enumerate(members):
        if i % 4 == 0:
            data += noise
        places.append(len(data))
        data += m
    file = tmp_path / "x.warc.gz"
    file.write_bytes(data + b"\x1f\x8b\x08")
    for size in (1, 7, 100, 5000, len(data) + 9):
        found = [at for start in range(0, len(data), size) for at, _, _ in warc.read_range(str(file), start, start + size)]
        assert found == places
    got = warc.read_archives(warc.archives(spark, str(tmp_path)), 300)
    assert sorted(r["page_id"] for r in got.collect()) == list(range(1, 30))
    assert all(r["intact"] and bytes(r["payload"]).endswith(b"\x1f\x8b\x08") for r in got.collect())


def test_damaged_payload_is_reported(spark, tmp_path):
    good = gzip.decompress(warc.record(1, "u", b"payload", None))
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(good.replace(b"payload", b"pay1oad")))
    assert [r["intact"] for r in warc.read_archives(warc.archives(spark, str(tmp_path))).collect()] == [False]


def test_gzip_reads_the_archives_too(spark, tmp_path):
    files = warc.write_archives(spark.createDataFrame(ROWS, PAGES), str(tmp_path)).collect()
    text = b"".join(gzip.decompress((tmp_path / f["path"].rpartition("/")[2]).read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\nWARC-Type") == len(ROWS) == sum(f["records"] for f in files)


def test_a_header_may_be_of_any_length(spark, tmp_path):
    """An address of 3 MB that does not compress comes back, and so does the record after it."""
    import random

    rng = random.Random(3)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_", k=3 << 20))
    path = f"{tmp_path}/x.warc.gz"
    data = warc.record(1, long, b"one", None) + warc.record(2, "u", b"two", None)
    with open(path, "wb") as file:
        file.write(data)
    got = [(h.get("warc-target-uri"), b.partition(b"\r\n\r\n")[2]) for _, h, b in warc.read_range(path, 0, len(data))]
    assert got == [(long, b"one"), ("u", b"two")]
    pages = spark.createDataFrame([(1, long, "a"), (2, "u", "b")], "page_id long, url string, html string")
    assert {r["page_id"] for r in warc.archive_round_trip(pages, byte_range=1 << 18).collect()} == {1, 2}


def test_payloads_are_written_without_a_copy_in_pandas(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(2**60 + 1, "u", "x" * 50), (2**60 + 3, None, "x" * 50), (None, "v", None)], "page_id long, url string, html string")
    monkeypatch.setattr(type(pages), "mapInPandas", lambda *_: pytest.fail("batches are copied"))
    files = warc.write_archives(pages, f"file://{tmp_path}/a")
    monkeypatch.undo()
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(files).collect()}
    assert got == {(2**60 + 1, "revisit", 2**60 + 3, 50), (2**60 + 3, "response", None, 50), (None, "response", None, 0)}
