import gzip
import zlib

from pyspark.sql import functions as F

from newsweave.sources import feeds as FE
from newsweave.streaming import pipelines as ST

ATOM = '<feed><entry><title>A</title><link href="https://x.org/1"/><published>2024-01-02T03:04:05Z</published></entry></feed>'
RSS = "<?xml version='1.0'?><rss><channel><item><title>B</title><link>https://x.org/2</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item></channel></rss>"


def test_decoding(spark):
    rows = [("a", "text/xml", None, ATOM.encode()), ("b", "text/xml", "gzip", gzip.compress(RSS.encode())), ("c", "text/xml", None, zlib.compress(b"zz")), ("d", None, "br", b"x"), ("e", None, None, "é".encode("latin-1")), ("f", None, None, None)]
    df = spark.createDataFrame(rows, "feed_url string, content_type string, content_encoding string, body binary")
    got = {r.feed_url: (r.text, r.status) for r in FE.decoded_payloads(df).collect()}
    assert got["a"][0] == ATOM and got["b"][0] == RSS and got["c"][0] == "zz" and got["e"][0] == "é"
    assert got["d"][1] == "unsupported_encoding" and got["f"][1] == "empty"


def test_entries(spark):
    df = spark.createDataFrame([("a", ATOM), ("b", RSS), ("c", "junk before " + RSS.replace("B<", "B&nbsp;<"))], "feed_url string, text string")
    got = {r.feed_url: (r.url, r.published[:10]) for r in FE.xml_entries(df).collect()}
    assert got["a"] == ("https://x.org/1", "2024-01-02") and got["b"] == ("https://x.org/2", "2024-01-02") and got["c"][0] == "https://x.org/2"
    js = spark.createDataFrame([("j", '{"items": [{"id": "https://x.org/9", "title": "T"}, {"title": "no url"}]}')], "feed_url string, text string")
    assert [r.url for r in FE.json_entries(js).collect()] == ["https://x.org/9"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counted = ST.windowed_counts(stream, "1 hour", watermark=None)
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = lambda df: sorted((str(r.start), r.event_type, r.events) for r in df.collect())
    assert rows(spark.table("counted")) == rows(ST.windowed_counts(table, "1 hour"))


def test_fresh_entries(spark, tmp_path):
    rows = [("http://a.org/1", "2024-01-01 00:00:00"), ("https://www.a.org/1/", "2024-01-01 01:00:00"), ("http://a.org/2", "2024-01-01 02:00:00"), (None, "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "url string, seen_at string").withColumn("seen_at", F.to_timestamp("seen_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("a.org/2",)], "normalized_url string")
    q = ST.fresh_entries(stream, known).writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.normalized_url for r in spark.table("fresh").collect()] == ["a.org/1"]


def test_late_rows_are_routed(spark):
    rows = [("a", "2024-01-01", "2024-01-20"), ("b", "2024-01-19", "2024-01-20"), ("c", None, "2024-01-20")]
    df = spark.createDataFrame(rows, "url string, pub_date string, seen_at string").withColumn("pub_date", F.to_timestamp("pub_date")).withColumn("seen_at", F.to_timestamp("seen_at"))
    got = {}
    ST.route_late(7, lambda d: got.update(queue=sorted(r.url for r in d.collect())), lambda d: got.update(stale=[r.url for r in d.collect()]))(df, 0)
    assert got == {"queue": ["b", "c"], "stale": ["a"]}
