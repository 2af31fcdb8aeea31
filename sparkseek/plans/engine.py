"""Queries through the engine as one object: documents as pages, the suppliers' graph as their links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import PALETTE
from ..operators import cluster, graph, index, rank
from ..service import SearchEngine
from ..session import durable
from .corpus import _PR, CTES, QUERY, _blend_sql, _hits_sql, _list_sql, _terms_sql, corpus, documents, tfidf_sql
from .links import _LINKS, ORACLES as LINK_ORACLES, fixed_pagerank, hits_sql, supplier_graph

#: Terms of a report; the last stands in no document.
REPORTED = ["estion", "queque", "tionen", "nowhere0"]


def engine(spark, sf_dir, ranked: bool = True) -> SearchEngine:
    found = corpus(spark, sf_dir)
    found = index.Index(durable(found.postings), found.doc_store, found.stats, "raw").settled()
    labels = documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 7 - 1).cast("int").alias("flat_cluster"))
    return SearchEngine(found, supplier_graph(spark, sf_dir), fixed_pagerank(spark, sf_dir) if ranked else None, labels=labels)


def linked(spark, sf_dir) -> SearchEngine:
    """An engine for one question of links: its links are written once, and its postings only as far as the question's terms go."""
    made = supplier_graph(spark, sf_dir)
    return SearchEngine(corpus(spark, sf_dir), graph.Graph(made.nodes, durable(made.links)), None)


def _shown(rows):
    return rows.select("rank", "doc_id", "score")


def engine_vector(spark, sf_dir):
    """A model that the service does not know is the vector model."""
    return _shown(engine(spark, sf_dir, False).relevance(QUERY, "unknown"))


def engine_pagerank(spark, sf_dir):
    return _shown(engine(spark, sf_dir).relevance(QUERY, "pagerank"))


def engine_hits(spark, sf_dir):
    """Authorities among the pages that hold a term of the query and their neighbours."""
    return _shown(linked(spark, sf_dir).relevance(QUERY, "hits"))


def engine_combined(spark, sf_dir):
    return _shown(engine(spark, sf_dir).relevance(QUERY, "combined"))


def engine_answer(spark, sf_dir):
    """The service's answer to a padded query, as rows with the label of its model."""
    said = engine(spark, sf_dir).answer(f"  {QUERY} ", " PageRank ")
    return spark.createDataFrame([(r["rank"], r["doc_id"], r["score"], said["model"]) for r in said["results"]], "rank INT, doc_id LONG, score DOUBLE, model STRING")


def clustered_results(spark, sf_dir):
    """The first thirty results with their clusters; a seventh of all documents has none."""
    made = engine(spark, sf_dir, False)
    return cluster.clustered_results(made.search(QUERY, k=30), made.labels, "flat_cluster").select("rank", "doc_id", "score", "cluster")


def clustered_shapes(spark, sf_dir):
    """The clusters of these results, as the service describes them."""
    said = engine(spark, sf_dir, False).clusters(QUERY, k=30)
    return spark.createDataFrame(said["clusters"], "id STRING, name STRING, color STRING, count LONG")


def term_report(spark, sf_dir):
    return engine(spark, sf_dir, False).term_report(REPORTED)


def engine_summary(spark, sf_dir):
    return engine(spark, sf_dir, False).summary().withColumn("avg_dl", F.round("avg_dl", 6))


_FOUND = f"WITH {CTES}, {_PR}"
_ROOT = f"WITH {CTES} SELECT DISTINCT doc_id AS id FROM p WHERE term IN (SELECT term FROM {_terms_sql(QUERY)})"
_HITS = f"SELECT doc_id, authority AS score FROM ({hits_sql(_ROOT, graph.HITS_ROUNDS, graph.HITS_TOLERANCE)})"
_CLUSTERED = f"WITH {CTES}, r AS ({tfidf_sql(QUERY)}), c AS (SELECT *, doc_id % 7 - 1 AS label FROM ({_hits_sql('r', 30)}) WHERE doc_id % 7 > 0)"

QUERIES = {f.__name__: f for f in (engine_vector, engine_pagerank, engine_hits, engine_combined, engine_answer, clustered_results, clustered_shapes, term_report, engine_summary)}
ORACLES = {
    "engine_vector": f"WITH {CTES}, r AS ({tfidf_sql(QUERY)}) {_hits_sql('r')}",
    "engine_pagerank": f"{_FOUND}, r AS ({_blend_sql(QUERY, 10)}) {_hits_sql('r')}",
    "engine_hits": f"WITH r AS ({_HITS}) {_hits_sql('r')}",
    "engine_combined": f"""{_FOUND}, lists AS ({_list_sql(tfidf_sql(QUERY), 0.5)} UNION ALL {_list_sql(_blend_sql(QUERY, 40), 0.3)} UNION ALL {_list_sql(_HITS, 0.2)}),
r AS (SELECT doc_id, round(sum(score), 6) AS score FROM lists GROUP BY doc_id) {_hits_sql('r')}""",
    "engine_answer": f"SELECT *, '{rank.LABELS['pagerank']}' AS model FROM ({_FOUND}, r AS ({_blend_sql(QUERY, 10)}) {_hits_sql('r')})",
    "clustered_results": f"{_CLUSTERED} SELECT rank, doc_id, score, 'cluster_' || label AS cluster FROM c",
    "clustered_shapes": f"{_CLUSTERED} SELECT 'cluster_' || label AS id, 'Cluster ' || label AS name, [{', '.join(repr(c) for c in PALETTE)}][1 + (row_number() OVER (ORDER BY label) - 1) % {len(PALETTE)}] AS color, count(*) AS count FROM c GROUP BY label",
    "term_report": f"""WITH {CTES} SELECT v.term, count(p.doc_id) AS n_docs, coalesce(array_to_string(list_slice(list(p.doc_id || ':' || p.tf ORDER BY p.doc_id) FILTER (WHERE p.doc_id IS NOT NULL), 1, 4), ' '), '') AS postings
FROM {_terms_sql(' '.join(REPORTED))} LEFT JOIN p ON p.term = v.term GROUP BY v.term""",
    "engine_summary": f"SELECT * FROM (WITH {CTES} SELECT n, round(avg_dl, 6) AS avg_dl, (SELECT count(*) FROM df) AS n_terms FROM s) CROSS JOIN ({LINK_ORACLES['graph_stats']})",
}
