import json

import pytest
from pyspark.sql import functions as F

from newsweave.functions import names as N
from newsweave.streaming import items as IT
from newsweave.streaming import pipelines as ST

AS_OF = "2024-03-10 00:00:00"
QUESTIONS = ("summary", "tiny_summary", "critical_analysis", "logical_fallacies", "sources_quality", "argument_quality", "source_type")


def item(n, name="Acme Corp", other="Paris", complete=True, kind="matched_topic", hash_=None, title=None, vector=None, text="Nothing here."):
    answers = [{"question": q, "response": "2" if "quality" in q else f"{q} {n}"} for q in QUESTIONS if complete or q != "tiny_summary"]
    entities = [{"name": name, "type": "ORGANIZATION", "importance": "PRIMARY"}, {"name": other, "type": "LOCATION", "importance": "SECONDARY"}]
    return {
        "id": n, "normalized_url": f"u{n}", "hash": hash_ or f"h{n}", "title_domain_hash": title or f"t{n}", "topic": "news", "kind": kind, "text": text, "pub_date": None, "event_date": "2024-03-0" + str(1 + n % 7),
        "alert": None, "relation": None, "answers": answers, "entities": entities, "embedding": vector,
    }


BATCHES = [
    [item(1, vector=[1.0, 0.0]), item(2, "Acme Corps", "Paris", vector=[0.9, 0.1]), item(3, "Zeta Works", "Oslo", vector=[0.0, 1.0]), item(4, hash_="h1"), item(5, title="t2"), item(6, complete=False), item(7, kind="life_safety")],
    [item(11, "Acme Corp", "Paris", vector=[1.0, 0.05], text="Acme Corp, also known as Big Acme, is new."), item(12, hash_="h3"), item(13, title="t1"), item(14, "Zeta Works", "Oslo", vector=[0.1, 1.0]), item(11, "Acme Corp", hash_="h11")],
]


def write_queue(spark, path):
    for n, rows in enumerate(BATCHES):
        df = spark.createDataFrame(rows, IT.ITEMS.replace("pub_date TIMESTAMP_NTZ", "pub_date STRING")).withColumn("pub_date", F.lit("2024-03-05 10:00:00").cast("timestamp_ntz"))
        df.select(*[f.split(":")[0].split()[0] for f in ("id", "normalized_url", "hash", "title_domain_hash", "topic", "kind", "text", "pub_date", "event_date", "alert", "relation", "answers", "entities", "embedding")]).coalesce(1).write.mode("append").parquet(path)


def content(tables):
    out = {}
    for name in ("records", "entities", "links", "aliases", "vectors", "similar", "documents", "assignments", "text_keys"):
        df = tables.read(name)
        out[name] = sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.drop("at").collect())
    return out


@pytest.fixture(scope="module")
def unbroken(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("items")
    write_queue(spark, str(base / "queue"))
    tables = IT.item_tables(spark, str(base / "tables"), 2)
    IT.item_stream(spark, str(base / "queue"), tables, AS_OF, str(base / "check"), files=1).awaitTermination()
    return base, tables


def test_the_pipeline_to_its_end(unbroken):
    _, tables = unbroken
    records = {r.id: r for r in tables.read("records").collect()}
    assert set(records) == {1, 2, 3, 6, 7, 11, 14}  # 4 and 12 repeat a text, 5 and 13 a title, 11 comes twice
    assert {i for i, r in records.items() if r.is_relevant} == {1, 2, 3, 11, 14}
    clusters = {i: r.cluster_id for i, r in records.items() if r.is_relevant}
    assert clusters[1] == clusters[11] == 1 and clusters[3] == clusters[14] == 3
    assert (clusters[2] == 1) == (N.normal_form("Acme Corps", "ORGANIZATION") == N.normal_form("Acme Corp", "ORGANIZATION"))
    assert {(r.canonical, r.alias) for r in tables.read("aliases").collect()} == {tuple(N.normal_form(x, "PERSON") for x in ("Acme Corp", "Big Acme"))}
    similar = {(r.source_id, r.target_id): r for r in tables.read("similar").where("status = 'match'").collect()}
    assert (11, 1) in similar and (11, 2) in similar and (14, 3) in similar and (11, 3) not in similar
    documents = {r.id: json.loads(r.document) for r in tables.read("documents").collect()}
    assert set(documents) == {1, 2, 3, 11, 14} and [s["id"] for s in documents[14]["similar_articles"]] == [3]


def test_a_batch_that_fails_between_two_tables_is_repeated_whole(spark, unbroken, tmp_path, monkeypatch):
    base, tables = unbroken
    broken = IT.item_tables(spark, str(tmp_path / "tables"), 2)
    real, left = IT.DL.article_documents, [1]

    def fail_once(articles, similar):
        if broken.committed("items", 0) and left:
            left.pop()
            raise OSError("the disk is full")
        return real(articles, similar)

    monkeypatch.setattr(IT.DL, "article_documents", fail_once)
    start = lambda: IT.item_stream(spark, str(base / "queue"), broken, AS_OF, str(tmp_path / "check"), files=1)
    with pytest.raises(Exception, match="disk is full"):
        start().awaitTermination()
    half = {r.id for r in broken.read("records").collect()}
    assert half == {1, 2, 3, 6, 7} and broken.read("links").where("article_id > 10").count() == 0  # complete batches only
    start().awaitTermination()
    assert content(broken) == content(tables)
    IT.item_body(broken, AS_OF)(spark.read.parquet(str(base / "queue")), 1)  # repeated after its commit
    assert content(broken) == content(tables)


def test_late_rows_are_released_when_a_sink_fails(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", "2024-01-20")], "url string, p string, s string").select("url", F.to_timestamp("p").alias("pub_date"), F.to_timestamp("s").alias("seen_at"))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()

    def sink(df):
        df.collect()
        raise ValueError("sink")

    with pytest.raises(ValueError):
        ST.route_late(7, sink, sink)(rows, 0)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
