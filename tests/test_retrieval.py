"""Index, ranking, expansion and graph operators on small fixtures with known values."""

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek import session
from sparkseek.operators import expand, graph, index, rank, segments
from sparkseek.plans import analytics, corpus, engine

TEXTS = {1: "fault fault rock", 2: "fault rock mineral", 3: "volcano ash", 4: ""}


def pages_of(spark, texts):
    rows = [(i, f"http://x/{i}", "", "", t, 0) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id LONG, url STRING, final_url STRING, title STRING, clean_text STRING, geology_score INT")


@pytest.fixture(scope="module")
def mini(spark):
    return index.build_index(pages_of(spark, TEXTS), "raw")


def scores(df):
    return {r["doc_id"]: round(r["score"], 6) for r in df.collect()}


def test_statistics_count_empty_documents(mini):
    assert mini.stats.first() == (4, 2.0)
    assert {r["doc_id"]: r["doc_len"] for r in mini.doc_store.collect()} == {1: 3, 2: 3, 3: 2, 4: 0}


def test_statistics_of_no_documents(spark):
    assert index.build_index(pages_of(spark, {1: "a"}).limit(0), "raw").stats.first() == (0, 0.0)


@pytest.mark.parametrize(
    "query, expected",
    [("fault", {1: 0.835575, 2: 0.575443}), ("fault fault", {1: 1.671149, 2: 1.150886}), ("fault mineral", {2: 1.574968, 1: 0.835575}), ("zzz", {}), ("", {})],
)
def test_bm25(mini, query, expected):
    assert scores(rank.bm25(mini, query)) == expected


@pytest.mark.parametrize("query, expected", [("fault", {1: 1.0, 2: 1.0}), ("fault mineral", {2: 1.0, 1: 0.447214}), ("fault fault rock", {2: 1.0, 1: 0.991551})])
def test_tfidf(mini, query, expected):
    assert scores(rank.tfidf_rank(mini, query)) == expected


def test_association(mini):
    found = {r["term"]: r["score"] for r in expand.association(mini, "fault").collect()}
    assert found == {"rock": 1.0, "mineral": 0.5}


def test_rocchio_needs_a_pool(mini):
    assert expand.rocchio(mini, "fault", rank.bm25(mini, "fault")).count() == 0


def test_full_analyzer_and_repeated_analysis(spark):
    found = index.build_index(pages_of(spark, {1: "Geological formations include rocks"}), "full")
    assert sorted(r["term"] for r in found.postings.collect()) == ["format", "geolog", "includ", "rock"]
    assert expand.analyzed_query(found, "the Rocks of rocks") == ["rock", "rock"]


def test_results_prefer_the_final_url(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 3.0)], "doc_id LONG, score DOUBLE")
    store = spark.createDataFrame([(1, "a", "b", "t", "x" * 400), (2, "a", "", None, None)], "doc_id LONG, url STRING, final_url STRING, title STRING, clean_text_preview STRING")
    found = [tuple(r) for r in rank.format_results(rows, store).orderBy("rank").collect()]
    assert found == [(1, 2, 3.0, "a", "", ""), (2, 1, 2.0, "b", "t", "x" * 300)]


def test_blend_and_normalise(spark):
    rows = spark.createDataFrame([(1, 4.0), (2, 2.0)], "doc_id LONG, score DOUBLE")
    ranks = spark.createDataFrame([(2, 0.01)], "doc_id LONG, score DOUBLE")
    assert scores(rank.blend(rows, ranks)) == {2: 3.35, 1: 0.7}
    assert scores(rank.normalized(rows.withColumn("score", F.lit(0.0)))) == {1: 0.0, 2: 0.0}


def test_ensemble_sums_lists(spark):
    lists = {n: spark.createDataFrame(v, "doc_id LONG, score DOUBLE") for n, v in {"tfidf": [(1, 2.0), (2, 1.0)], "pagerank": [(2, 5.0)], "hits": [(3, 1.0)]}.items()}
    assert scores(rank.ensemble(lists)) == {1: 0.5, 2: 0.55, 3: 0.2}


@pytest.fixture(scope="module")
def mini_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id LONG")
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (1, 1), (1, 2), (9, 1)], "src LONG, dst LONG")
    return graph.Graph(nodes, graph.simple_links(links, nodes))


@pytest.fixture(scope="module")
def topic(spark):
    return spark.createDataFrame([(1, 10), (2, 0), (3, 5)], "doc_id LONG, score INT")


def test_pagerank(mini_graph, topic):
    assert scores(graph.topic_pagerank(mini_graph, topic, rounds=1)) == {1: 0.353860, 2: 0.168199, 3: 0.415993, 4: 0.061949}
    ranks = scores(graph.topic_pagerank(mini_graph, topic))
    assert ranks == pytest.approx({1: 0.416763, 2: 0.188329, 3: 0.383703, 4: 0.011204}, abs=2e-6)
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-5)


def test_pagerank_without_nodes(spark, mini_graph):
    assert graph.topic_pagerank(graph.Graph(mini_graph.nodes.limit(0), mini_graph.links.limit(0))).count() == 0


def test_hits(spark, mini_graph):
    root = spark.createDataFrame([(1,), (2,)], "id LONG")
    found = {r["doc_id"]: (r["hub"], r["authority"]) for r in graph.hits(mini_graph, root).collect()}
    expected = {1: (0.850651, 0.0), 2: (0.525731, 0.525731), 3: (0.0, 0.850651)}
    assert set(found) == set(expected)
    for k, v in expected.items():
        assert found[k] == pytest.approx(v, abs=1e-4)


def test_graph_statistics(mini_graph):
    assert graph.graph_stats(mini_graph).first().asDict() == {"n_nodes": 4, "n_edges": 4, "max_out_degree": 2, "max_out_node": 1, "max_in_degree": 2, "max_in_node": 3, "avg_out_degree": 1.0}


def test_graph_from_pages(spark):
    pages = spark.createDataFrame([(1, "a", "a"), (2, "b", "c"), (3, "c", "")], "doc_id LONG, url STRING, final_url STRING")
    edges = spark.createDataFrame([(1, "c"), (1, "b"), (2, "a"), (7, "a"), (3, "zz"), (1, "a")], "source_doc_id LONG, target_url STRING")
    found = {tuple(r) for r in graph.build_graph(pages, edges).links.collect()}
    assert found == {(1, 3), (1, 2), (2, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_search(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    expected = {x: c for x, c in label.items() if any(x in p and p[0] != p[1] for p in pairs)}
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a LONG, b LONG"), "a", "b").collect()}
    assert found == expected


def test_metric_clusters_equal_all_pairs(spark):
    texts = {1: "a b c", 2: "a b d", 3: "d e", 4: "d e f", 5: "g h", 6: "g h b"}
    found = index.build_index(pages_of(spark, texts), "raw")
    mine = {r["term"]: r["cluster_id"] for r in expand.metric_clusters(found, cosine=0.6).collect()}
    n, tf = len(texts), {t: {d: x.split().count(t) for d, x in texts.items() if t in x.split()} for t in "abcdefgh"}
    vec = {t: {d: (1 + math.log10(c)) * math.log10(n / len(p)) for d, c in p.items()} for t, p in tf.items() if 2 <= len(p) <= 5}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    label = {t: t for t in vec}
    for _ in vec:
        for a in vec:
            for b in vec:
                if set(vec[a]) & set(vec[b]) and sum(vec[a][d] * vec[b].get(d, 0) for d in vec[a]) / norm(vec[a]) / norm(vec[b]) >= 0.6:
                    label[a] = label[b] = min(label[a], label[b])
    assert mine == label


@pytest.mark.parametrize(("widths", "cells", "cosine"), [((2, 9, 1), 20, 0.5), ((5, 64, 3), 0, 0.12), ((16384, 4096, 2048), 1 << 24, 0.95)])
def test_metric_clusters_in_groups_of_any_width(spark, monkeypatch, widths, cells, cosine):
    """No pair of terms is a row before it is close: groups meet by documents, and all give the clusters of all pairs."""
    rng = np.random.default_rng(7)
    texts = {i: " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.4, 12), 60)) + f" x{i // 2} y{i // 2} z{i % 9}" for i in range(60)}
    monkeypatch.setattr(expand, "CELLS", cells)
    monkeypatch.setattr(expand, "PORTION", 50)
    monkeypatch.setattr(expand, "FREQUENT", 0.05)
    monkeypatch.setattr(expand, "CHUNK_DOCS", 25)
    found = index.build_index(pages_of(spark, texts), "raw")
    mine = {r["term"]: r["cluster_id"] for r in expand.metric_clusters(found, cosine=cosine, per_doc=8, widths=widths).collect()}
    counts = {d: collections.Counter(x.split()) for d, x in texts.items()}
    df = collections.Counter(t for c in counts.values() for t in c)
    vocab = {t for t in df if 2 <= df[t] <= 51}
    vec = {t: {d: (1 + math.log10(c[t])) * math.log10(60 / df[t]) for d, c in counts.items() if t in c} for t in vocab}
    norm = {t: math.sqrt(sum(x * x for x in v.values())) for t, v in vec.items()}
    few = [sorted(vocab & set(c), key=lambda t: (hashlib.md5(t.encode()).hexdigest(), t))[:8] for c in counts.values()]
    near = {(a, b) for f in few for a in f for b in f if a < b and round(sum(w * vec[b].get(d, 0) for d, w in vec[a].items()) / norm[a] / norm[b], 9) >= cosine}
    label = {t: t for t in vocab}
    for _ in vocab:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert mine == label and len(set(label.values())) < len(vocab)


def test_metric_clusters_join_all_terms_of_a_document(spark):
    """Terms of the same two documents are one cluster, however many they are; a given number of terms joins those only."""
    words = [f"w{i}" for i in range(130)]
    found = index.build_index(pages_of(spark, {1: " ".join(words), 2: " ".join(words), 3: "a b", 4: "a"}), "raw")
    sizes = lambda **cut: sorted(r["count"] for r in expand.metric_clusters(found, 0.5, **cut).groupBy("cluster_id").count().collect())
    assert sizes() == [1, 130] and sizes(per_doc=100) == [1] * 31 + [100]


def test_groups_of_terms_are_bounded_by_postings(monkeypatch):
    """However many terms there are, a task has two groups of bounded postings, and no more products at once than a portion."""
    monkeypatch.setattr(expand, "GROUP", 1000)
    monkeypatch.setattr(expand, "PORTION", 500)
    monkeypatch.setattr(expand, "TOP_GROUPS", 0)
    sizes = [(2, 3001), (3, 500), (40, 7), (1500, 2)]
    starts = expand._group_starts(sizes, 1 << 20, expand.WIDTHS)
    dfs = np.repeat([df for df, _ in sizes], [n for _, n in sizes])
    groups = np.split(dfs, starts[1:])
    assert starts[0] == 0 and all(g.sum() <= 1000 or len(g) == 1 for g in groups) and len(groups) == 10

    rng = np.random.default_rng(5)
    n, tfs = 40, rng.integers(0, 3, (90, 40)) * (rng.random((90, 40)) < 0.4)
    tfs[0] += 1  # each term has a posting
    doc, slot = np.nonzero(tfs)
    row = {"a_docs": np.arange(90), "a_lens": np.bincount(doc, minlength=90).astype(np.int32), "a_slots": slot.astype(np.uint16), "a_tfs": tfs[doc, slot].astype(np.int8), "a_slot_bytes": 2, "a_tf_bytes": 1}
    one = expand.Side(row, "a", n, False)
    w = np.where(tfs > 0, 1 + np.log10(np.maximum(tfs, 1)), 0)
    w /= np.sqrt((w * w).sum(0))
    for cells in (0, 50, 1 << 20):
        monkeypatch.setattr(expand, "CELLS", cells)
        found = {(int(a), int(b)) for x, y in expand._close_slots(one, one, True, 0.4, 0) for a, b in zip(x, y, strict=True)}
        assert found == {(a, b) for a in range(n) for b in range(a + 1, n) if round(w[:, a] @ w[:, b], 9) >= 0.4}


def _single_pass(vectors, cosine, size):
    """The pass as defined: running means, full cosines."""
    cents, counts, out = [], [], {}
    cos = lambda a, b: sum(a[d] * b.get(d, 0) for d in a) / (math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values())))
    for t, v in vectors:
        sims = [(cos(v, c), -i) for i, c in enumerate(cents) if counts[i] < size]
        best = max(sims, default=(-1, 0))
        if best[0] < cosine:
            out[t] = len(cents)
            cents.append(dict(v))
            counts.append(1)
        else:
            i = -best[1]
            cents[i] = {d: (cents[i].get(d, 0) * counts[i] + v.get(d, 0)) / (counts[i] + 1) for d in set(cents[i]) | set(v)}
            counts[i] += 1
            out[t] = i
    return out


def test_scalar_clusters_equal_the_definition(spark):
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(list("abcdefghijklmnop"), 6)) for i in range(14)}
    found = index.build_index(pages_of(spark, texts), "raw")
    mine = {r["term"]: r["cluster_id"] for r in expand.scalar_clusters(found, cosine=0.3, size=3).collect()}
    n = len(texts)
    tf = {t: {d: x.split().count(t) for d, x in texts.items() if t in x.split()} for t in "abcdefghijklmnop"}
    tf = {t: p for t, p in tf.items() if 2 <= len(p) <= int(n * 0.85)}
    order = sorted(tf, key=lambda t: (len(tf[t]), t))
    assert mine == _single_pass([(t, {d: (1 + math.log10(c)) * math.log10(n / len(tf[t])) for d, c in tf[t].items()}) for t in order], 0.3, 3)


def test_full_clusters_are_no_longer_met():
    """A document's slots are those of clusters with room, however many clusters were filled before."""
    own = expand.SinglePass(0.5, 2)
    found = [own.assigned([7, 8], np.array([1.0, 1.0])) for _ in range(400)]
    assert found == [i // 2 for i in range(400)]
    assert own.sums.used.max() <= 2 and own.sums.end <= 16 and len(own.name) == 64


@pytest.mark.parametrize("terms", [["a"], ["a", "b"], ["b", "x", "a", "c"], ["a", "a"]])
def test_siblings_equal_the_sequential_rule(spark, mini, terms):
    members = {0: list("abcdefgh"), 1: ["w", "x", "y"]}
    clusters = spark.createDataFrame([(t, c) for c, ts in members.items() for t in ts], "term STRING, cluster_id INT")
    seen, expected = set(), []
    for t in terms:
        c = next((c for c, ts in members.items() if t in ts), None)
        for u in [u for u in sorted(members.get(c, [])) if u not in terms and u not in seen][:2]:
            if len(expected) < 5:
                seen.add(u)
                expected.append(u)
    assert [r["term"] for r in expand.siblings(clusters, terms, mini, each=2, most=5).collect()] == expected


def test_expand_falls_back_and_searches_again(mini):
    found = expand.expand(mini, "fault", "no such method")
    assert found["method"] == "rocchio" and found["added_terms"] == [] and found["documents"].count() == 2
    assert expand.expand(mini, "  ", "metric")["documents"] is None
    assert expand.expand(mini, "fault", "association")["expanded_query"] == "fault rock mineral"


def test_judged_queries(spark, mini):
    judged = spark.createDataFrame([("fault", 1, 1), ("fault", 2, 0), ("fault mineral", 2, 1), ("zzz", 1, 1)], "query STRING, doc_id LONG, relevant INT")
    results = expand.bm25_of_all(mini, judged)
    assert {(r["query"], r["doc_id"]): round(r["score"], 6) for r in results.collect()} == {("fault", 1): 0.835575, ("fault", 2): 0.575443, ("fault mineral", 2): 1.574968, ("fault mineral", 1): 0.835575}
    found = {r["query"]: (r["precision"], r["average_precision"]) for r in expand.judge(judged, results).collect()}
    assert found == {"fault": (0.5, 1.0), "fault mineral": (0.5, 1.0)}


def test_partitions_grow_with_the_rows(spark, sf_dir, monkeypatch, tmp_path):
    """A task's rows stay the same: pairs of parts, and a segment's postings, those of one frequent term too."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    assert analytics.self_join_pairs(spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 100
    own = segments.SegmentedIndex(spark, str(tmp_path), "raw")
    own.add(pages_of(spark, {i: "rock" for i in range(1000)}))
    assert own.snapshot().postings.select(F.input_file_name()).distinct().count() >= 8


def test_postings_that_are_read_several_times_are_written_once(spark, sf_dir):
    for query in (corpus.tfidf_weights, corpus.term_cosine):
        assert any("/table-" in f for f in query(spark, sf_dir).inputFiles())


def test_a_question_of_links_writes_no_postings(spark, sf_dir, monkeypatch):
    written = []
    monkeypatch.setattr(engine, "durable", lambda df: written.append(df.columns) or df)
    monkeypatch.setattr(graph, "hits", lambda links, root: root.select(F.col("id").alias("doc_id"), F.lit(1.0).alias("authority")))
    assert engine.engine_hits(spark, sf_dir).count() <= 10
    assert written == [["src", "dst"]]
