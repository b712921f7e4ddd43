import json

from pyspark.sql import functions as F

from newsweave.plans.tables import MAX_PARTS, Tables
from newsweave.sources import pages as PG
from newsweave.streaming import pipelines as ST


def test_queue_is_cleaned_and_taken_from(spark, tmp_path):
    land = str(tmp_path / "land")
    feed = lambda *ids: json.dumps({"items": [{"id": f"http://x/{i}", "title": f"t{i}"} for i in ids]}).encode()
    put = lambda *ids: spark.createDataFrame([("f", "application/json", None, bytearray(feed(*ids)), None)], ST.PAYLOADS).coalesce(1).write.mode("append").parquet(land)
    tables = ST.queue_tables(spark, str(tmp_path / "queue"), 2)
    done = ["x/2"]
    articles = lambda: spark.createDataFrame([(u,) for u in done], "normalized_url string")
    run = lambda: ST.ingest_queue(tables, land, str(tmp_path / "c"), articles, files=1).awaitTermination()
    urls = lambda: sorted(r.normalized_url for r in tables.read("queue").collect())
    put(1, 2, 3)
    run()
    assert urls() == ["x/1", "x/3"]  # an article is not queued
    done.append("x/1")
    put(3, 4)
    run()
    assert urls() == ["x/3", "x/4"]  # what became an article is taken out
    first = ST.take_from_queue(tables, 1, 0)
    assert [r.normalized_url for r in first.collect()] == ["x/3"] and urls() == ["x/4"]
    assert ST.take_from_queue(tables, 1, 0).count() == 0 and urls() == ["x/4"]
    put(3, 5)
    run()
    assert urls() == ["x/4", "x/5"]  # taken rows are not queued again


def test_ten_batches_keep_few_files(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "q"), {"queue": (("normalized_url",), 1), "queued": (("normalized_url",), 1)})
    body = ST.keep_counters(tables, "queue", lambda df: df, lambda df: df.dropDuplicates(["normalized_url"]), "n")
    sizes = []
    for n in range(MAX_PARTS + 2):
        body(spark.createDataFrame([(f"u{n}",), ("u0",)], "normalized_url string"), n)
        sizes.append(sum(1 for f in (tmp_path / "q" / "data").rglob("*.parquet")))
    assert max(sizes) <= 2 * MAX_PARTS and tables.read("queue").count() == MAX_PARTS + 2


def test_counters_survive_a_restart_with_late_rows(spark, tmp_path):
    schema = "device_id long, ip_address string, ts timestamp"
    put = lambda rows: spark.createDataFrame(rows, "device_id long, ip_address string, t string").select("device_id", "ip_address", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tables = Tables(spark, str(tmp_path / "t"), {"addresses": (("device_id", "ip_address"), 4)})
    body = ST.keep_counters(tables, "addresses", ST.address_counters, ST.merged_addresses, "addresses")

    def run(sink):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    put([(1, "a", "2024-01-02 00:00:00"), (1, "a", "2024-01-03 00:00:00"), (2, "b", "2024-01-02 00:00:00")])
    run(body)

    def committed_then_lost(rows, n):
        body(rows, n)
        raise RuntimeError("lost after the commit")

    put([(1, "a", "2023-12-01 00:00:00"), (3, "c", "2024-01-05 00:00:00")])  # a late row
    try:
        run(committed_then_lost)
    except Exception as error:
        assert "lost after" in str(error)
    run(body)  # the same batch again
    got = {(r.device_id, r.ip_address): (str(r.first_seen)[:10], str(r.last_seen)[:10], r.events) for r in tables.read("addresses").collect()}
    assert got == {(1, "a"): ("2023-12-01", "2024-01-03", 3), (2, "b"): ("2024-01-02", "2024-01-02", 1), (3, "c"): ("2024-01-05", "2024-01-05", 1)}


def test_pages(spark):
    cases = {
        "<html><head><title>A &amp; B</title></head><body>menu<article>one<article>two</article>three &hellip; &eacute;</article>after</body>": ("A & B", "one two three … é"),
        "<body><p>no article &copy;2024&nbsp;x<script>var a='</p>';</script><noscript>n</noscript></p></body>": ("", "no article ©2024 x"),
        "<title>T</title><article>a < b &lt;tag&gt; &amp;lt;<br/>c<!-- no --></article>": ("T", "a < b <tag> &lt; c"),
        "<article>unclosed <b>bold": ("", "unclosed bold"),
        "": ("", ""),
        "plain": ("", "plain"),
    }
    for html, want in cases.items():
        assert PG.page_parts(html) == want
    rows = [(1, "https://a.org/x", "<title>Access denied</title><body>Please wait</body>"), (2, "https://a.org/y", "<title>T</title><body>b</body>"), (3, None, None)]
    parsed = PG.page_articles(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in parsed.collect()}
    assert [got[k].status for k in (1, 2, 3)] == ["denied", "ok", "failed"] and got[1].text == "" and got[2].text == "Title: T\nBody: b\n"
    (wall,) = PG.denied_records(parsed).collect()
    assert wall.page_id == 1 and wall.title_domain_hash == got[1].title_domain_hash and not wall.is_relevant and wall.hash is None
