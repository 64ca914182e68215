import hashlib
import io
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from keelvault.llm import warc


def pages(spark):
    big, other = "<html>" + "x y " * 500 + "é</html>", "<p>" + "unlike " * 300
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (2, "http://b", "small"), (4, "http://c", "small"), (6, "u", None), (7, "http://d/\r\nX: y", other), (None, "n", other), (8, "z", "")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark):
    rows, df = pages(spark)
    found = warc.round_trip(df, payloads=True).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(h for p, _, h in rows if p == r["page_id"]) or ""
        assert r["payload_bytes"] == len(text.encode()) and r["payload_digest"] == hashlib.sha1(text.encode()).hexdigest()
        copy = r["page_id"] in (1, 3)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if copy else ("response", None))
        assert r["html"] == ("" if copy else text)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_odd_pages(spark):
    """Repeated ids, a very long payload, repeated rows, and columns with the names of results."""
    long = "<p>" + "übung " * 400_000
    rows = [(1, "u", long), (1, "u", "x" * 2000), (2, "u", "x" * 2000), (2, "u", "x" * 2000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, None, long)]
    df = spark.createDataFrame([(*r, "own", 7, 8) for r in rows], "page_id long, url string, html string, payload_digest string, _key int, refers_to int")
    found = warc.round_trip(df).collect()
    want = [(1, long, 5), (1, "x" * 2000, 2), (2, "x" * 2000, None), (2, "x" * 2000, None), (3, "x" * 999, None), (4, "x" * 999, None), (5, long, None)]
    assert sorted(str((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in found) == sorted(str((i, hashlib.sha1(t.encode()).hexdigest(), "revisit" if to else "response", to)) for i, t, to in want)


def test_small_pages_do_not_meet_in_one_task(spark):
    """Nine tenths of the pages are small; without a broadcast their join is spread over all tasks."""
    rows = [(i, "u", "small" if i % 10 else "large " * 300) for i in range(2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for k, v in (("autoBroadcastJoinThreshold", "-1"), ("adaptive.enabled", "false"), ("shuffle.partitions", "8")):
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        found = warc.with_digests(df)
        tasks = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(tasks) == 2000 and len(tasks) == 8 and max(tasks) < 600 and found.filter("refers_to IS NOT NULL").count() == 199
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def archive(tmp_path, records):
    a = warc.Archive(f"file://{tmp_path}", records)
    for r in records:
        a.add(r)
    return open(a.close()[0].removeprefix("file://"), "rb").read()


def record(i, html=b"<html>hello</html>" * 20):
    return warc.record(i, f"http://x/{i}", html, len(html), hashlib.sha1(html).hexdigest(), None)


def test_dictionary_leads_and_frames_are_records(tmp_path):
    data = archive(tmp_path, [record(i, f"<html><body>{i}{'text ' * (i % 40)}</body></html>".encode() * 9) for i in range(300)])
    assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE
    frames = list(warc.Frames(io.BytesIO(data)))
    assert frames[0][0] and len(frames) == 301 and not any(s for s, _ in frames[1:])
    assert [warc.id_of(r["fields"]["WARC-Record-ID"]) for r in warc.read_archive(io.BytesIO(data))] == list(range(300))
    # a compressed dictionary is read as well
    size = struct.unpack("<I", data[4:8])[0]
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    again = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + data[8 + size :]
    assert len(list(warc.read_archive(io.BytesIO(again)))) == 300


def test_unsound_archives(tmp_path):
    data = archive(tmp_path, [record(1)])
    assert len(list(warc.read_archive(io.BytesIO(data)))) == 1  # too few records to train a dictionary
    good = record(1)
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARK/1.1"), good.replace(b"WARC-Date", b"WARC-Data"), good.replace(b"hello", b"hallo"), good + b"x"):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(b"GIF89a..")))
