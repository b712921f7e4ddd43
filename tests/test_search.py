import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from newsweave.functions import names as N
from newsweave.functions import text as T
from newsweave.operators import aliases as AL
from newsweave.operators import articles as AR
from newsweave.operators import evaluation as EV
from newsweave.operators import matching as MA
from newsweave.operators import similarity as SI
from newsweave.plans import durable as D
from newsweave.plans.graph import connected_components
from newsweave.sources import bindings as B
from newsweave.sources import feeds as FE
from newsweave.streaming import pipelines as ST

WEIGHT = {"PRIMARY": 1.0, "SECONDARY": 0.6, "MENTIONED": 0.3}


def test_entity_metrics_match_a_loop(spark):
    """Two lists of entities with fuzzy names: greedy scores by type, overlaps, proximity."""
    lists = {
        1: [("Jeff Bezos", "PERSON", "PRIMARY"), ("Blue Origin", "ORGANIZATION", "PRIMARY"), ("Project Kuiper", "PRODUCT", "SECONDARY"), ("Seattle", "LOCATION", "MENTIONED"), ("Ann Hill", "PERSON", "MENTIONED")],
        2: [("Jeffrey Bezos", "PERSON", "PRIMARY"), ("BlueOrigin", "ORGANIZATION", "SECONDARY"), ("Projekt Kuiper", "PRODUCT", "PRIMARY"), ("Seattle", "LOCATION", "PRIMARY")],
        3: [("SpaceX", "ORGANIZATION", "PRIMARY"), ("Elon Musk", "PERSON", "PRIMARY")],
        4: [],
    }
    rows = [(a, 100 * a + k, *e) for a, es in lists.items() for k, e in enumerate(es)]
    named = spark.createDataFrame(rows, "article_id long, entity_id long, name string, type string, importance string")
    names = named.select("name", "type").distinct()
    pairs = [(a, b) for a in lists for b in lists if a != b]
    days = spark.createDataFrame([(1, "2024-03-01"), (2, "2024-03-05"), (3, None)], "article_id long, day string").withColumn("day", F.col("day").cast("date"))
    got = {(r.source_id, r.target_id): r for r in SI.entity_metrics(spark.createDataFrame(pairs, "source_id long, target_id long"), named, MA.name_matches(names, names), days).collect()}
    assert set(got) == {p for p in pairs if 4 not in p}
    for (s, t), r in got.items():
        order = lambda es: sorted(es, key=lambda e: (e[2], e[0]))
        score, hit, primary = {}, set(), set()
        for kind in SI.ENTITY_TYPES:
            mine, theirs = (order([e for e in lists[x] if e[1] == kind]) for x in (s, t))
            free, total = list(theirs), 0.0
            for e in mine:
                for f in free:
                    if N.names_match(e[0], f[0], kind):
                        total += (WEIGHT[e[2]] + WEIGHT[f[2]]) / 2
                        free.remove(f)
                        break
            score[kind] = total / ((len(mine) + len(theirs)) / 2) if mine and theirs else 0.0
        for e, f in itertools.product(lists[s], lists[t]):
            if e[1] == f[1] and N.names_match(e[0], f[0], e[1]):
                hit.add(e)
                if e[2] == f[2] == "PRIMARY":
                    primary.add(e)
        near = 0.7 if {s, t} == {1, 2} else 0.0
        assert [r[k.lower()] for k in SI.ENTITY_TYPES] == pytest.approx([score[k] for k in SI.ENTITY_TYPES])
        assert (r.overlap, r.primary_overlap, r.proximity) == (len(hit), len(primary), near)
        assert r.entity_score == pytest.approx(0.25 * score["PERSON"] + 0.2 * score["ORGANIZATION"] + 0.1 * score["LOCATION"] + 0.1 * score["EVENT"] + 0.2 * score["PRODUCT"] + 0.15 * near)


@pytest.mark.parametrize("final", [False, True])
def test_order_of_evidence(spark, final):
    pairs = spark.createDataFrame([("Blue-Origin", "blue origin", "ORGANIZATION"), ("Meta", "Facebook", "ORGANIZATION"), ("Jon Smith", "John Smith", "PERSON"), ("Ann Lee", "Anne Lee", "PERSON"), ("Rome", "Oslo", "LOCATION")], "name_a string, name_b string, type string")
    aliases = spark.createDataFrame([(N.normal_form("Meta", "ORGANIZATION"), N.normal_form("Facebook", "ORGANIZATION"), "ORGANIZATION", "APPROVED")], "canonical string, alias string, type string, status string")
    negatives = spark.createDataFrame([("john smith", "jon smith", "PERSON")], "name_lo string, name_hi string, type string")
    got = {r.name_a: (r.verdict, r.evidence) for r in MA.same_names(pairs, aliases, negatives, final).collect()}
    assert got["Blue-Origin"] == (True, "normal form") and got["Meta"] == (True, "alias") and got["Ann Lee"] == (True, "fuzzy") and got["Rome"] == (False, "fuzzy")
    assert got["Jon Smith"] == ((False, "negative pair") if final else (True, "fuzzy"))


def varied_names(n=70):
    rng = random.Random(6)
    syllables = ["ka", "ro", "min", "tel", "vor", "sa", "lin", "dra", "bel", "us", "jo", "han"]
    rows = set()
    for _ in range(n):
        name = " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))).title() for _ in range(rng.randrange(1, 4)))
        for _ in range(3):
            chars = list(name)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(chars))
                chars[at : at + rng.randrange(0, 2)] = rng.choice(["", "e", "s", "in"])
            rows.add(("".join(chars).strip() or "x", rng.choice(["PERSON", "ORGANIZATION", "LOCATION", "PRODUCT"])))
    return sorted(rows)


def matching(rows):
    ok = lambda a, b: a == b or {a, b} == {"PRODUCT", "ORGANIZATION"}
    return {(a, k, b, m) for (a, k), (b, m) in itertools.product(rows, rows) if ok(k, m) and (N.normal_form(a, k) == N.normal_form(b, m) or N.fuzzy_match(N.normal_form(a, k), N.normal_form(b, m), a, b, k))}


def test_names_recall_and_the_exact_mode(spark, sf_dir):
    tables = [varied_names(), sorted((r.name, r.type) for r in B.entities(spark, sf_dir).select("name", "type").distinct().collect())]
    for rows in tables:
        want = matching(rows)
        df = spark.createDataFrame(rows, "name string, type string")
        got = {tuple(r) for r in MA.name_matches(df, df).collect()}
        assert got <= want and len(got) >= 0.9 * len(want)  # 0.977 on the first table
        assert {tuple(r) for r in MA.name_matches(df, df, exact=True).collect()} == want


def test_built_in_verdicts_agree_with_the_verifier(spark):
    rows = [(N.normal_form(a, k), N.normal_form(b, k), a, b, k) for (a, k), (b, m) in itertools.product(varied_names(40), repeat=2) if k == m]
    df = spark.createDataFrame(rows, "a string, b string, raw_a string, raw_b string, kind string").where("a <> b")
    got = df.withColumn("s", N.settled(F.col("a"), F.col("b"), F.col("kind"))).where("s IS NOT NULL").collect()
    assert len(got) > 500 and all(r.s == N.fuzzy_match(r.a, r.b, r.raw_a, r.raw_b, r.kind) for r in got)


def test_alias_sentences(spark):
    said = [
        ("Apple Inc., also known as Apple Computer, reported record earnings.", ("Apple Inc", "Apple Computer")),
        ("Microsoft Corporation (formerly Micro-Soft) was founded by Bill Gates.", ("Microsoft Corporation", "Micro-Soft")),
        ("Meta (aka Facebook) has rebranded itself to focus on the metaverse.", ("Meta", "Facebook")),
        ("Tim Cook, the CEO of Apple Inc., announced new products today.", ("Tim Cook", "Apple Inc")),
        ("IBM, which acquired Red Hat in 2019, continues to focus on cloud computing.", ("IBM", "Red Hat")),
        ("JK (full name Joanne Kathleen Rowling) is the author of Harry Potter.", ("Joanne Kathleen Rowling", "JK")),
        ("SpaceX, which was founded by Elon Musk, launched another rocket today.", ("Elon Musk", "SpaceX")),
        ("Warner Bros Discovery, which is the parent company of HBO, reported earnings.", ("Warner Bros Discovery", "HBO")),
        ("Bank of America, which rebranded itself as BofA. It grew.", ("Bank of America", "BofA")),
        ("Old Mill, now New Mill, is open.", ("New Mill", "Old Mill")),
        ("The weather was nice today and the temperature was 75 degrees.", None),
        ("Body: NEW YORK CITY - The mayor announced a new policy today.", None),
        ("they are known as such, the director of it all", None),
        ("", None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(said)] + [(99, None)], "id int, text string")
    got = {r.id: (r.canonical, r.alias) for r in AL.alias_pairs(df).collect()}
    assert got == {k: want for k, (_, want) in enumerate(said) if want}


def test_pairs_and_their_files(spark, tmp_path):
    articles = spark.createDataFrame([(k, f"2024-01-{1 + k % 9:02d}") for k in range(60)], "id long, pub_date string")
    pairs = EV.pair_set(articles, 120, per_day=5, seed=4).collect()
    keys = [frozenset((p.source_id, p.target_id)) for p in pairs]
    assert len(keys) == len(set(keys)) == 120 and all(len(k) == 2 for k in keys)
    assert sum(p.source_id % 9 == p.target_id % 9 for p in pairs) >= 45
    assert EV.pair_set(articles, 10).count() == 45 and EV.random_pairs(articles.limit(1), 5).count() == 0
    assert EV.random_pairs(articles.limit(3), 50).count() == 3
    first = spark.createDataFrame([(k,) for k in (5, 8, 13)], "id long")
    drawn = [sorted(tuple(r) for r in EV.random_pairs(first, n, seed).collect()) for seed in range(12) for n in (1, 3)]
    assert all(len(set(d)) == len(d) == (1 if k % 2 == 0 else 3) and {x for p in d for x in p} <= {5, 8, 13} and all(a < b for a, b in d) for k, d in enumerate(drawn)) and len({tuple(d) for d in drawn[::2]}) == 3
    every = EV.random_pairs(articles, 60 * 59 // 2 - 1, 3).collect()
    assert len({tuple(r) for r in every}) == 60 * 59 // 2 - 1
    EV.write_pairs(spark.createDataFrame(pairs), str(tmp_path / "pairs"))
    assert {(r.source_id, r.target_id) for r in EV.pair_list(spark.read.text(str(tmp_path / "pairs"))).collect()} == {(p.source_id, p.target_id) for p in pairs}
    results = spark.createDataFrame([(1, 2, True, 0.812, 0.9, 0.5, 2, "Match, success", None)], "source_id long, target_id long, is_match boolean, score double, vector_score double, entity_score double, overlap int, reason string, expected boolean")
    EV.write_results(results, str(tmp_path / "results"))
    row = spark.read.csv(str(tmp_path / "results"), header=True).first().asDict()
    assert tuple(row) == EV.RESULT_COLUMNS and row["combined_score"] == "0.81" and row["reason"] == "Match; success" and row["expected_vs_actual"] == "unknown"


def test_labelled_corpus(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"title": "T", "body": "B", "relevance": {"space": "Yes", "llm": "No.", "rust": "No"}}, indent=1))
    got = {(r.file, r.topic): r.relevant for r in AR.labelled_corpus(spark, str(tmp_path)).collect()}
    assert got == {("a.json", "space"): True, ("a.json", "llm"): False, ("a.json", "rust"): False}


def test_chat_markup_rules(spark):
    cases = {
        "**a** __b__ ~~c~~": "*a* *b* ~c~", "# H\n### K": "*H*\n*K*", "- x\n  * y": "• x\n• y", "[t](http://u)": "<http://u|t>", "```\ncode```": "```\ncode\n```", "a\r\nb\rc": "a\nb\nc", "#### deep": "*# deep*",
    }
    df = spark.createDataFrame(list(cases.items()), "m string, want string")
    assert [(r.got, r.want) for r in df.select(T.chat_markup(F.col("m")).alias("got"), "want").collect()] == [(w, w) for w in cases.values()]


def test_feed_references(spark):
    names = {n: chr(k) for n, k in FE.REFERENCES}
    body = "junk<rss><channel>" + "".join(f"<item><title>{n}:&{n};</title><link>http://x/{n}</link></item>" for n in names) + "<item><title>&amp;amp;</title><link>http://x/amp</link></item></channel></rss>"
    raw = spark.createDataFrame([("f", None, None, bytearray(body.encode()))], "feed_url string, content_type string, content_encoding string, body binary")
    got = {r.url.rsplit("/", 1)[1]: r.title for r in FE.xml_entries(FE.decoded_payloads(raw)).collect()}
    assert got == {n: f"{n}:{c}".strip() for n, c in names.items()} | {"amp": "&"} or got == {n: f"{n}:{c}" for n, c in names.items()} | {"amp": "&"}


def test_streams_hand_on(spark, tmp_path):
    land, queue, topics, rest = (str(tmp_path / n) for n in ("land", "queue", "topics", "rest"))
    feed = lambda *ids: json.dumps({"items": [{"id": f"http://x/{i}", "title": f"t{i}"} for i in ids]}).encode()
    put = lambda *bodies: spark.createDataFrame([("f", "application/json", None, bytearray(b), None) for b in bodies], ST.PAYLOADS).write.mode("append").parquet(land)
    schema = "normalized_url STRING, url STRING, title STRING, published STRING, feed_url STRING"
    decide = lambda df: df.withColumn("route", F.when(F.col("title").endswith("2"), "topic").otherwise("rest"))
    for bodies, total in (((feed(1, 2), feed(2, 3)), 3), ((feed(3, 4, 12), b"<rss><channel><item><link>http://x/5</link></item></channel></rss>"), 6)):
        put(*bodies)
        ST.ingest_feeds(spark, land, queue, str(tmp_path / "c1")).awaitTermination()
        assert spark.read.schema(schema).parquet(f"{queue}/batch=*").count() == total
        ST.hand_off(spark, queue, schema, decide, {"topic": topics, "rest": rest}, str(tmp_path / "c2")).awaitTermination()
    read = lambda path: {r.title for r in spark.read.schema(schema).parquet(f"{path}/batch=*").collect()}
    assert read(topics) == {"t2", "t12"} and read(rest) >= {"t1", "t3", "t4"}


def test_stream_counters(spark, tmp_path):
    rows = [("s1", "APPROVE", None, "a", "b", "P"), ("s1", "REJECT", "different entity", "b", "a", "P"), ("s2", "REJECT", "different entity", "a", "b", "P")]
    schema = "source string, decision string, reason string, canonical string, alias string, type string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    for name, build, want in (("by_source", ST.decision_counters, {("s1", 2, 1, 1), ("s2", 1, 0, 1)}), ("by_pair", ST.rejection_counters, {("a", "b", "P", 2)})):
        build(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        assert {tuple(r) for r in spark.table(name).collect()} == want


def test_components_of_a_long_chain(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10_000), 600)
    edges = [(a, b) for chain in (ids[:400], ids[400:]) for a, b in zip(chain, chain[1:])] + [(1, 1), (None, 5)]
    rounds = []
    write = D.durable
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("newsweave.plans.graph.durable", lambda df, name, replaces=None: rounds.append(name) or write(df, name, replaces))
        got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: min(c) for c in (ids[:400], ids[400:]) for i in c} and rounds.count("hooked") <= 12


def test_broadcast_bounds(spark):
    df = spark.createDataFrame([(k, "x" * 100, [1, 2], [("a" * 50,)]) for k in range(20)], "id long, t string, n array<long>, s array<struct<u: string>>")
    assert D.is_small(df, 20, 20 * 600) and not D.is_small(df, 19) and not D.is_small(df, 20, 20 * 150) and D.is_small(df.limit(0), 0)


def test_written_documents_and_seeds(spark, tmp_path):
    from newsweave.operators import delivery as DL

    articles = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", None)], "id long, category string, title string")
    similar = spark.createDataFrame([(1, 2, 0.5, "T2"), (1, 3, 0.9, "T3")], "source_id long, target_id long, score double, title string")
    DL.write_documents(articles, similar, str(tmp_path / "docs"))
    got = {r.category: [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/docs/category={r.category}").collect()] for r in articles.select("category").distinct().collect()}
    one = next(d for d in got["a"] if d["id"] == 1)
    assert [s["id"] for s in one["similar_articles"]] == [3, 2] and one["similar_articles"][0]["title"] == "T3" and len(got["a"]) == 2 and got["b"][0]["similar_articles"] == []
    (tmp_path / "seeds.csv").write_text("type,canonical,alias,source,confidence\norganization,International Machines,IM,SEED,0.9\nperson,Ann Lee,A. Lee,SEED,0.8\nperson,McDonald's,Mickey,SEED,0.8\n")
    none = spark.createDataFrame([], "name_lo string, name_hi string, type string")
    seeds = AL.seed_aliases(spark, str(tmp_path / "seeds.csv"))
    table = AL.approve_pending(AL.upsert_aliases(seeds.limit(0), seeds, none), "admin")
    assert {(r.canonical, r.alias, r.status, r.approved_by) for r in table.collect()} == {(N.normal_form("International Machines", "ORGANIZATION"), "im", "APPROVED", "admin"), ("ann lee", "a lee", "APPROVED", "admin"), ("mcdonald", "mickey", "APPROVED", "admin")}


def test_batches_join_existing_clusters(spark, tmp_path):
    from newsweave.operators.clusters import leader_clusters

    old = spark.createDataFrame([(1, e) for e in (1, 2, 3)] + [(2, e) for e in (7, 8)], "item long, entity long")
    new = [(10, (1, 2, 3)), (11, (1, 2)), (12, (7, 8, 9)), (13, (20, 21)), (14, (20, 21)), (15, (20, 21, 22)), (16, (1, 2, 3))]
    batch = spark.createDataFrame([(i, e) for i, es in new for e in es], "item long, entity long")
    written = []
    ST.assign_batches(lambda: old, lambda df, n: written.append({r.item: r.cluster_id for r in df.collect()}))(batch, 0)
    assert written == [{10: 1, 11: 1, 12: 2, 13: 13, 14: 13, 15: 13, 16: 1}]
    assert {r.item: r.cluster_id for r in leader_clusters(batch, 0.6, old).collect()} == written[0]


def test_projections_find_near_vectors(spark):
    import numpy as np

    from newsweave.operators import vectors as VE

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    v = centres[rng.integers(0, 20, 400)] + 0.35 * rng.normal(size=(400, 24))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(400, [0.0] * 24)], "id long, embedding array<double>")
    exact = {(r.source_id, r.target_id): r.score for r in VE.cosine_top_k(df.where("id % 10 = 0"), df, 10, 0.8).collect()}
    found = {(r.source_id, r.target_id): r.score for r in VE.lsh_top_k(df.where("id % 10 = 0"), df, 10, 0.8).collect()}
    assert len(exact) > 200 and len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(found[p] == pytest.approx(exact[p]) for p in exact.keys() & found.keys())


def test_fuzzy_search_equals_all_name_pairs(spark, sf_dir):
    from newsweave import queries_search as QS

    _, _, _, names = QS._embedded(spark, sf_dir)
    parts = {r.p_partkey: r.p_name for r in B.table(spark, sf_dir, "part").collect()}
    known = sorted({(parts[r.entity_id], r.type) for r in names.collect() if r.entity_id in parts})
    both = {"PRODUCT", "ORGANIZATION"}
    pairs = [(a, s, b, t) for a, s in known for b, t in known if (s == t or {s, t} <= both) and N.names_match(a, b, s)]
    brute = spark.createDataFrame(pairs, "name_a string, type_a string, name_b string, type_b string")
    columns = ["source_id", "target_id", "overlap", "primary_overlap", "score", "status", "rank"]
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())
    assert rows(QS.fuzzy_similar_articles(spark, sf_dir)) == rows(QS.fuzzy_search(spark, sf_dir, brute)) != []
