"""Text, URL, HTML, crawl, source, clustering, streaming and service operators on small fixtures."""

import json
import threading
import tracemalloc
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sparkseek import service
from sparkseek.functions import html, stemmer, text, urls
from sparkseek.operators import cluster, crawl
from sparkseek.plans import corpus, stored, web
from sparkseek.sources import fetch
from sparkseek.sources import pages as files
from sparkseek.streaming import ingest
from tests import oracle

URLS = [
    ("HTTP://Ex.COM:80/a/../b/?z=1&utm_source=x&A=2#f", None, "http://ex.com/b?A=2&z=1"),
    ("../c?q=a b", "https://ex.com/x/y/z", "https://ex.com/x/c?q=a+b"),
    ("//ex.com/p", None, "http://ex.com/p"),
    ("mailto:a@b", None, ""),
    ("https://u:p@ex.com:8443//a//b/", None, "https://ex.com:8443//a/b"),
    ("/rel", None, ""),
    ("https://ex.com", None, "https://ex.com/"),
    ("https://ex.com/?k=&gclid=1", None, "https://ex.com/?k="),
    ("http://h:99999/", None, None),
    (None, None, ""),
]


@pytest.mark.parametrize("url, base, expected", URLS)
def test_normalized(url, base, expected):
    assert urls.normalized(url, base) == expected


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"https?://[a-z]{1,5}\.[a-z]{2,3}(:[0-9]{1,4})?(/[a-zA-Z0-9.]{1,4}){0,4}/?(\?([a-z]{1,3}=[a-z0-9]{0,3}&?){0,3})?", fullmatch=True))
def test_normalized_is_idempotent(url):
    once = urls.normalized(url)
    assert urls.normalized(once) == once


def test_simple_normalize_equals_the_full_rules(spark):
    given_urls = ["http://A.com/x//y/?b=1&a=2&utm_x=3", "https://a.com:443", "https://a.com:8443/x/", "ftp://a/b", "http://a.com/?gclid=1&K", ""]
    rows = spark.createDataFrame([(u,) for u in given_urls], "u STRING").select(urls.simple_normalize(F.col("u")), urls.normalize_url(F.col("u"))).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]


def test_url_parts(spark):
    row = spark.sql("SELECT 'https://U@Ex.com:90/About-us?x=1' AS u, 'http://a/aboutus' AS v").select(urls.extract_domain(F.col("u")), urls.origin(F.col("u")), urls.is_utility_url(F.col("u")), urls.is_utility_url(F.col("v")), urls.is_http_url(F.col("u"))).first()
    assert tuple(row) == ("ex.com", "https://u@ex.com:90", True, False, True)


def test_stems(spark):
    words = "caresses ponies ties cats agreed motoring hopping falling filing happy relational digitizer electricity hopefulness adjustable adoption probate controlling geology volcanic volcanoes earthquakes was by dying skies"
    expected = "caress poni tie cat agre motor hop fall file happi relat digit electr hope adjust adopt probat control geolog volcan volcano earthquak wa by die sky"
    found = {r["term"]: r["stem"] for r in stemmer.stem_words(spark.createDataFrame([(w,) for w in words.split()], "term STRING")).collect()}
    assert [found[w] for w in words.split()] == expected.split()


def test_topic_and_priority_scores(spark):
    row = spark.sql("SELECT 'Fault lines' AS title, 'fault fault fault fault rock volcano' AS x, 'http://a.com/plate-tectonics' AS u, 'http://a.com/contact' AS c").select(
        text.topic_score(F.col("title"), F.col("x"), F.col("u")), text.topic_score(F.lit("Contact us"), F.lit("fault"), F.col("c")), text.link_priority(F.lit(20), F.lit("the fault"), F.col("u")), text.link_priority(F.lit(1), F.lit(None), F.col("c"))
    ).first()
    assert tuple(row) == (4 + 2 + 2 + 3, 0, 10 + 2 + 1, 0)


def test_texts(spark):
    row = spark.sql("SELECT ' A  b\n' AS x, CAST(NULL AS STRING) AS n").select(text.safe_text(F.col("x")), text.safe_text(F.col("n")), text.content_hash(F.col("n")), text.slug(F.lit("Big Rocks")), text.search_url(F.lit("a b&c"), "bing")).first()
    assert tuple(row) == ("A b", "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "big_rocks", "https://www.bing.com/search?q=a+b%26c")
    assert text.added_terms("Fault line", "fault line rock rock") == ["rock", "rock"]


PAGE = """<html><head><title> A &amp; B </title><script>var x='<p>no</p>'</script></head><body><nav><a href="/n">nav</a></nav>
<article><p>One <b>two</b></p><a href="/x#f">first</a><a href="/x">second</a><a href="mailto:q">m</a><a href="http://o.com">out</a></article><footer>foot</footer></body></html>"""


def test_html_tree():
    title, body, links, anchors = html.parse(PAGE, "http://h.com/d/")
    assert (title, body) == ("A & B", "One two first second m out")
    assert links == ["http://h.com/x", "http://o.com/"] and anchors["http://h.com/x"] == "first"
    assert "http://h.com/n" in html.parse(PAGE, "http://h.com/d/", keep_chrome=True)[2]
    assert html.parse("  <?xml version='1'?><a href='x'>", "http://h/") == ("", "", [], {}) and html.parse(None, None) == ("", "", [], {})


def test_a_reference_ends_with_its_semicolon(spark):
    page = '<html><head><title>a&amp;&amp</title></head><body><p>x &lt y &amp; &copy &#39 &ampere; <a href="/q?a=1&copy=2">z&amp</a></p></body></html>'
    title, body, links, anchors = html.parse(page, "http://h.x/")
    assert (title, body) == ("a&&amp", "x &lt y & &copy &#39 &ampere; z&amp")
    assert links == ["http://h.x/q?a=1&copy=2"] and anchors[links[0]] == "z&amp"
    row = spark.createDataFrame([(page,)], "html STRING").select(html.title_of(F.col("html")).alias("t")).first()
    assert row["t"] == title


@pytest.mark.parametrize("name", ["html_parse", "batch_pages", "crawl_round", "crawled_pages"])
def test_cut_references_stay_in_pages_as_in_their_sql(spark, tmp_path, name):
    body = "the and que les estion lava " * 20
    rows = [(i, f"http://h.x/p{i}", f"<html><head><title>A {i} {cut}</title></head><body><article><h1>A {i} {cut}</h1><p>{body}&amp;</p></article></body></html>") for i, cut in enumerate(("&amp", "&quot", "&am", "&", "&amp;"), 1)]
    spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    found = web.QUERIES | stored.QUERIES, web.ORACLES | stored.ORACLES
    assert found[0][name](spark, str(tmp_path)).count() == 5
    assert oracle.compare(spark, oracle.database(str(tmp_path)), found[0][name], found[1][name], str(tmp_path)) == ""


def test_frontier(spark):
    rows = spark.createDataFrame([("a", 1, 9, 1, 1), ("b", 1, 2, 1, 2), ("a", 1, 2, 1, 3), ("c", 9, 9, 1, 4), ("", 1, 9, 1, 5), ("q", 1, 9, 1, 6), ("v", 1, 9, 1, 7), ("d", 1, 8, 1, 8)], "url STRING, depth INT, score INT, discovered_from LONG, seq LONG")
    one = lambda *u: spark.createDataFrame([(x,) for x in u], "url STRING")
    kept = crawl.keep_new(rows, one("q"), one("v"))
    assert {(r["url"], r["queue"]) for r in kept.collect()} == {("a", "high"), ("b", "normal"), ("d", "high")}
    assert [r["url"] for r in crawl.pop(kept, 2).collect()] == ["a", "d"]


def test_robots(spark):
    rows = spark.createDataFrame([("http://a/x",), ("http://a/private/x",), ("http://b/y",), ("http://c/z",)], "url STRING")
    rules = spark.createDataFrame([("http://a", 200, "User-agent: *\nDisallow: /private/"), ("http://b", 404, "User-agent: *\nDisallow: /")], "origin STRING, status INT, body STRING")
    assert {r["url"] for r in crawl.allowed(rows, rules).collect()} == {"http://a/x", "http://b/y", "http://c/z"}


def test_crawl_round(spark):
    body = "<html><title>Fault</title><body><article>" + "fault volcano mineral earthquake tectonic igneous " * 8 + '<a href="/next-fault">fault</a><a href="/login">in</a></article></body></html>'
    fetched = spark.createDataFrame([("http://h/1", body, 200), ("http://h/2", body, 200), ("http://h/3", "<p>short</p>", 200), ("http://h/4", None, 500)], "url STRING, html STRING, status INT")
    frontier = spark.createDataFrame([(f"http://h/{i}", 0, 9, None, "high", i) for i in (1, 2, 3, 4)], "url STRING, depth INT, score INT, discovered_from LONG, queue STRING, seq LONG")
    out = crawl.crawl_round(fetched, frontier, spark.createDataFrame([], "url STRING"), first_id=7)
    assert [(r["doc_id"], r["url"]) for r in out["pages"].collect()] == [(7, "http://h/1")]
    assert [(r["source_doc_id"], r["target_url"], r["anchor_text"]) for r in out["edges"].collect()] == [(7, "http://h/next-fault", "fault")]
    counts = out["funnel"].first().asDict()
    assert (counts["attempted"], counts["fetched_ok"], counts["long_enough"], counts["kept_after_quality"], counts["kept_after_dedup"], counts["duplicates_content"]) == (4, 3, 2, 2, 1, 1)
    assert [(r["url"], r["depth"], r["queue"]) for r in out["queued"].collect()] == [("http://h/next-fault", 1, "high")]
    assert out["visited"].count() == 4


def test_numbers_are_dense(spark):
    rows = crawl.numbered(spark.range(0, 1000, 3).withColumnRenamed("id", "seq"), "seq", 10).orderBy("seq").collect()
    assert [r["doc_id"] for r in rows] == list(range(10, 10 + len(rows)))


def test_numbers_of_wide_rows_are_complete(spark):
    n, before = 300_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        pages = spark.range(n).select((F.lit(n) - F.col("id")).alias("seq"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 16).alias("clean_text"))
        found = crawl.numbered(pages, "seq").agg(F.count("*"), F.count_distinct("doc_id"), F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id") == F.col("seq")), F.sum(F.length("clean_text"))).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(found) == (n, n, 1, n, n, n * 1024)


def test_files(spark, tmp_path):
    folder = str(tmp_path)
    pages = spark.createDataFrame([(1, "http://a/x", "", "T", "é text", "text/html", 1.0, 200, 0, 5), (2, "http://a/login", "", "T", "t", "text/html", 1.0, 200, 0, 5)], files.PAGE)
    edges = spark.createDataFrame([(1, "http://a/x", "http://a/y", "y")], files.EDGE)
    files.export_batch(pages, edges, folder, 1, {"seen": 2}, {"s": 0.5}, 3.0)
    assert [r["doc_id"] for r in files.load_pages(spark, folder, 2).collect()] == [1]
    assert files.load_edges(spark, folder).count() == 1
    assert files.read_document(spark, f"{folder}/metadata_batch_0001")["pages_in_batch"] == 2
    assert files.read_document(spark, f"{folder}/none", {"a": 1}) == {"a": 1}
    (tmp_path / "seeds.txt").write_text("# c\n\nHTTP://B.com\nmailto:x\n")
    assert [r["url"] for r in files.load_seeds(spark, f"{folder}/seeds.txt").collect()] == ["http://b.com/"]
    assert files.load_seeds(spark, f"{folder}/missing.txt").count() == 0
    lines = [json.dumps({"status": 200, "url": "u", "title": "A", "text": "w " * 20}), "{broken", json.dumps({"status": 404, "url": "u", "title": "", "text": "w " * 30}), json.dumps({"status": 200, "url": "u", "title": "", "text": "w " * 5})]
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    assert files.load_for_clustering(spark, f"{folder}/p.jsonl").count() == 1
    files.write_lines(pages, "url", f"{folder}/lines")
    assert files.read_lines(spark, f"{folder}/lines").count() == 2
    for i in range(3):
        files.log_query(spark, f"{folder}/log", f"q{i}", "vector", 0.12345, f"2024-01-0{i + 1}T00:00:00+00:00")
    total, tail = files.tail_log(spark.read.schema(files.LOG).json(f"{folder}/log"), 2)
    assert total == 3 and [(r["query"], r["elapsed_sec"]) for r in tail.collect()] == [("q1", 0.1235), ("q2", 0.1235)] or total == 3


def test_agglomeration():
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [-1, 0.01]])
    for how in ("average", "complete"):
        labels = cluster.agglomerate(x, 3, how)
        assert labels[0] == labels[1] and labels[2] == labels[3] and len(set(labels)) == 3


def _greedy(x, k, linkage):
    """Merge the two closest clusters by all pairs of their rows until k are left."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, own = 1 - unit @ unit.T, [[i] for i in range(len(x))]
    of = np.mean if linkage == "average" else np.max
    while len(own) > k:
        _, i, j = min((of(d[np.ix_(a, b)]), i, j) for i, a in enumerate(own) for j, b in enumerate(own) if i < j)
        own[i] += own.pop(j)
    return {frozenset(c) for c in own}


@pytest.mark.parametrize("how", ["average", "complete"])
@pytest.mark.parametrize("k", [1, 4, 12])
def test_chains_equal_greedy_merging(how, k):
    for seed in range(4):
        x = np.random.default_rng(seed).normal(size=(26, 5))
        labels = cluster.agglomerate(x, k, how)
        assert {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)} == _greedy(x, k, how)


def test_tree_of_clustering_features():
    x = np.random.default_rng(4).normal(size=(3000, 6))
    tree = cluster.Tree(0.9, branching=8)
    for row in x:
        tree.add(1.0, row, float(row @ row))
    count, total, square = tree.subclusters()
    assert count.sum() == 3000 and np.allclose(total.sum(0), x.sum(0)) and np.isclose(square.sum(), (x * x).sum())
    assert tree.n == len(count) > 8 and (np.sqrt(np.maximum(square / count - ((total / count[:, None]) ** 2).sum(1), 0)) <= 0.9 + 1e-9).all()
    depths, waiting = [], [(tree.root, 0)]
    while waiting:
        node, depth = waiting.pop()
        assert node.n <= 8
        if node.children is None:
            depths.append(depth)
        else:
            assert all(np.isclose(node.count[i], child.whole()[0]) and np.allclose(node.sum[i], child.whole()[1]) for i, child in enumerate(node.children))
            waiting += [(child, depth + 1) for child in node.children]
    assert len(set(depths)) == 1


def test_too_many_subclusters_raise_the_threshold(spark):
    rows = spark.createDataFrame([(i, Vectors.dense([float(i % 40), 0.0])) for i in range(200)], ["doc_id", "features"])
    labels, means = cluster.birch(rows, threshold=0.1, most=100)
    assert len(means) <= 40 and labels.count() == 200


def test_kmeans_cost_is_near_the_best(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.1, (40, 3)) for c in np.eye(3) * 5])
    rows = spark.createDataFrame([(i, Vectors.dense(p)) for i, p in enumerate(x)], ["doc_id", "features"])
    labels = np.array([r["flat_cluster"] for r in cluster.kmeans(rows, k=3).orderBy("doc_id").collect()])
    cost = lambda own: sum(((x[own == c] - x[own == c].mean(0)) ** 2).sum() for c in set(own))
    assert cost(labels) == pytest.approx(cost(np.repeat(range(3), 40)))


def test_latent_rows_equal_the_decomposition(spark):
    x = np.random.default_rng(7).normal(size=(60, 8)) * np.arange(1, 9)
    rows = spark.createDataFrame([(i, Vectors.dense(p)) for i, p in enumerate(x)], ["doc_id", "features"])
    found = np.array([r["features"].toArray() for r in cluster.latent(rows, components=3).orderBy("doc_id").collect()])
    own = x @ np.linalg.svd(x, full_matrices=False)[2][:3].T
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    assert np.allclose(found @ found.T, own @ own.T, atol=1e-6)


def test_subclusters_keep_their_radius(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.02, (30, 2)) for c in ((0, 0), (1, 1), (3, 0))])
    rows = spark.createDataFrame([(i, Vectors.dense(p)) for i, p in enumerate(points)], ["doc_id", "features"])
    labels, means = cluster.birch(rows, threshold=0.35)
    found = np.array([r["birch_cluster"] for r in labels.orderBy("doc_id").collect()])
    assert len(means) == 3 and all(len(set(found[i : i + 30])) == 1 for i in (0, 30, 60))
    final = cluster.agglomerated(cluster.usable(cluster.centroids(rows, labels)), 2)
    assert final.count() == 3
    assert cluster.mapped(labels, final.filter("birch_cluster < 2")).filter("agg_average_cluster = -1").count() == 30


def test_rows_meet_centroids_in_portions():
    """A batch of rows takes little memory beside 20,000 centroids, and so do the distances of a large cluster."""
    rng = np.random.default_rng(4)
    x, c = rng.random((1000, 20)), rng.random((cluster.MOST_SUBCLUSTERS, 20))
    expected = [int(((c - row) ** 2).sum(1).argmin()) for row in x[:20]]
    tracemalloc.start()
    try:
        found = cluster.nearest_of(x, c)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert list(found[:20]) == expected and len(found) == 1000 and most < 60 << 20


def test_document_clusters(spark):
    texts = [f"{w} {w} common rock number{i % 3}" for w in ("fault quake", "ocean wave") for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    rows = cluster.cluster_documents(docs, k=2, components=3, threshold=0.5).orderBy("doc_id").collect()
    assert len(rows) == 20 and len({r["flat_cluster"] for r in rows[:10]}) == 1 and rows[0]["flat_cluster"] != rows[10]["flat_cluster"]


def test_document_features_have_the_whole_vocabulary(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range((1 << 18) + 5000))
    spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["n_terms"] for r in corpus.document_features(spark, str(tmp_path)).collect()}
    assert found == {1: (1 << 18) + 5000, 2: (1 << 18) + 5000, 3: 0}


def test_tfidf_features_equal_the_formula(spark):
    docs = spark.createDataFrame([(1, "rock rock lava"), (2, "rock sand"), (3, "lava sand sand"), (4, "iron iron")], "doc_id LONG, text STRING")
    rows = cluster.tfidf_features(docs, min_df=2, max_df=0.9).collect()
    got = {r["doc_id"]: sorted(round(float(x), 6) for x in r["features"].toArray() if x) for r in rows}
    idf = np.log(5 / 3) + 1
    first = np.array([2 * idf, idf])
    assert got[1] == sorted(np.round(first / np.linalg.norm(first), 6)) and got[4] == []


def test_streams(spark, tmp_path):
    body = "fault volcano mineral earthquake tectonic igneous " * 8
    rows = [(i, f"http://h/{u}", "", "Fault", body + t, "text/html", 1000.0 + i, 200, 0, 0) for i, (u, t) in enumerate([("1", "a"), ("1?utm_x=1", "b"), ("2", "a"), ("3", "c")])]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, files.PAGE).coalesce(1).write.json(folder)
    stream = ingest.usable_pages(ingest.page_stream(spark, folder))
    ingest.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.select("url").distinct().count() == kept.count() and kept.select("content_hash").distinct().count() == kept.count() and kept.count() >= 2


def test_windows(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2024-01-01 01:05:00', 'a'")
    assert sorted(r["n"] for r in ingest.windowed(rows, "ts", "k").collect()) == [1, 2]
    assert sorted(r["n"] for r in ingest.sessions(rows, "ts", "k", "20 minutes").collect()) == [1, 2]


def test_engine(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "", "", t, "text/html", 1.0, 200, 0, i) for i, t in enumerate(["faults and rocks", "rocks", "volcanic ash", "fault"], 1)]
    pages = spark.createDataFrame(rows, files.PAGE)
    edges = spark.createDataFrame([(1, "", "http://h/2", ""), (2, "", "http://h/4", ""), (4, "", "http://h/1", "")], files.EDGE)
    service.SearchEngine.build(pages, edges, str(tmp_path / "index"))
    engine = service.SearchEngine.load(spark, str(tmp_path / "index"))
    engine.log = str(tmp_path / "log")
    for model in ("vector", "pagerank", "hits", "combined", "other"):
        found = engine.answer("fault rock", model)
        assert found["results"] and "error" not in found, found
    assert engine.answer(" ") == {"error": "Query cannot be empty."}
    assert found["model"] == "OTHER" and spark.read.json(engine.log).count() == 5
    assert [r["doc_id"] for r in engine.search("fault", "bm25").orderBy("rank").collect()] == [4, 1]
    assert engine.expanded("fault", "association")["added"] == ["rock"]
    assert engine.pagerank_report(2).count() == 2 and engine.examples(["fault"]).count() == 2
    with pytest.raises(ValueError):
        engine.search("x", "nope")
    assert engine.clusters("fault") == service.NO_CLUSTERS and engine.clusters(" ") == {"error": "Query cannot be empty."}
    engine.labels = spark.createDataFrame([(1, 2), (2, 0), (3, -1)], "doc_id LONG, flat_cluster INT")
    said = engine.clusters("fault rock ash", k=4)
    assert [(c["id"], c["name"], c["count"]) for c in said["clusters"]] == [("cluster_0", "Cluster 0", 1), ("cluster_2", "Cluster 2", 1)]
    assert [(r["doc_id"], r["cluster"]) for r in said["results"]] == [(2, "cluster_0"), (1, "cluster_2")] and said["available"]
    assert "error" in engine.clusters("fault", "no_such_label")
    rows = {r["term"]: (r["n_docs"], r["postings"]) for r in engine.term_report(["fault", "rock", "none"], 1).collect()}
    assert rows == {"fault": (2, "1:1"), "rock": (2, "1:1"), "none": (0, "")}
    assert engine.summary().first()["n_terms"] == 4 and engine.summary().first()["n_edges"] == 3
    sizes = {r["name"]: r["bytes"] for r in service.file_sizes(spark, str(tmp_path / "index")).collect()}
    assert {"postings", "doc_store", "pagerank", "graph_stats"} <= set(sizes) and sizes["postings"] > 0


@pytest.fixture
def site():
    """A small local site: two good pages with the same text, a link cycle, a missing page, a busy page, a private one."""
    body = "<html><head><title>Fault</title></head><body><article>" + "fault volcano mineral earthquake tectonic igneous " * 8
    pages = {"/": body + "start <a href='/a'>fault a</a><a href='/b'>b</a><a href='/busy'>x</a><a href='/private/p'>p</a><a href='/gone'>g</a></article></body></html>", "/a": body + "<a href='/'>home</a></article></body></html>", "/b": body + "<a href='/'>home</a></article></body></html>", "/private/p": body}
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            text = "User-agent: *\nDisallow: /private/" if self.path == "/robots.txt" else pages.get(self.path)
            busy = self.path == "/busy" and seen.count("/busy") < 3
            self.send_response(503 if busy else 200 if text or self.path == "/busy" else 404)
            self.send_header("Content-Type", "text/plain" if self.path == "/robots.txt" else "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write((text or "late").encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_fetch_and_crawl(spark, site, tmp_path):
    base, seen = site
    urls_in = spark.createDataFrame([(f"{base}/a",), (f"{base}/gone",), (f"{base}/busy",), ("http://127.0.0.1:9/x",)], "url STRING")
    rows = {r["url"].removeprefix(base): r for r in fetch.fetch(urls_in, 0.0, backoff=0.01, retries=2, timeout=3).collect()}
    assert rows["/a"]["status"] == 200 and "fault" in rows["/a"]["html"]
    assert rows["/gone"]["status"] == 404 and rows["/gone"]["html"] is None
    assert rows["/busy"]["status"] == 200 and seen.count("/busy") == 3
    assert rows["http://127.0.0.1:9/x"]["error"] and rows["http://127.0.0.1:9/x"]["status"] is None
    seeds = spark.createDataFrame([(f"{base}/",)], "url STRING")
    quick = lambda df: fetch.fetch(df, 0.0, backoff=0.01, timeout=3)
    folder = str(tmp_path / "crawl")
    first = crawl.crawl(spark, seeds, folder, 1, retrieve=quick)
    assert (first["attempted"], first["final_usable"]) == (1, 1)
    both = crawl.crawl(spark, seeds, folder, 3, retrieve=quick)
    assert both["final_usable"] == 2 and both["duplicates_content"] == 1
    pages = files.load_pages(spark, folder).orderBy("doc_id").collect()
    assert [(p["doc_id"], p["url"].removeprefix(base)) for p in pages] == [(1, "/"), (2, "/a")]
    assert "/private/p" not in seen and seen.count("/a") == 2
    assert files.load_edges(spark, folder).filter("source_doc_id = 1").count() == 5


#: Words and stems as the algorithm's paper gives them, with the outcome of all steps.
PAPER = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit radicalli radic differentli differ analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend
adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil connection connect connected connect connecting connect connections connect universities univers""".split()


def test_stems_of_the_paper(spark):
    pairs = [(w, s) for w, s in zip(PAPER[::2], PAPER[1::2], strict=True)]
    rows = spark.createDataFrame(pairs, "term STRING, expected STRING")
    found = {r["term"]: r["stem"] for r in stemmer.stem_words(rows).collect()}
    assert {w: found[w] for w, _ in pairs} == dict(pairs)


@pytest.fixture
def large_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    yield
    spark.conf.set(name, before)


def test_a_worker_parses_few_pages_at_a_time(spark, large_batches):
    """The parser sees at most so many rows at once as a worker may hold, whatever the session had before."""
    parsed = html.parse_pages(spark.range(5000, numPartitions=1).select(F.lit("<a href='/x'>y</a>").alias("html"), F.concat(F.lit("http://h/"), "id").alias("url")))
    seen = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    assert parsed.select(seen(F.size("outlinks")).alias("n")).agg(F.max("n"), F.count("*")).first() == (1000, 5000)


def test_latent_vectors_go_to_workers_in_small_batches(spark, large_batches):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, Vectors.dense(rng.random(4))) for i in range(1500)], ["doc_id", "features"]).coalesce(1)
    seen = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    for found in (cluster.latent(rows, components=2), cluster.birch(rows, threshold=0.9)[0]):
        assert found.select(seen("doc_id").alias("n")).agg(F.max("n")).first()[0] <= 1000
