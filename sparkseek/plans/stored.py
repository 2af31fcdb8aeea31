"""Queries over tables that went through files: batches, text lines, saved indexes and graphs, logs, crawl state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..functions.urls import simple_normalize
from ..operators import blocks, crawl, graph, index, rank
from ..operators.blocks import BlockIndex
from ..operators.seen import SeenSet
from ..operators.segments import SegmentedIndex
from ..session import durable, shared_folder
from ..sources import pages as files
from . import web
from .corpus import CTES, REPEATED, TOKENS, _hits, _hits_sql, bm25_sql, corpus, documents
from .links import _LINKS, PAGERANK_SQL, fixed_pagerank, supplier_graph


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def jsonl_documents(spark, sf_dir):
    """Documents through gzipped JSON lines."""
    folder = _folder(spark)
    files.write_jsonl(documents(spark, sf_dir).select("doc_id", "text"), folder)
    return files.read_jsonl(spark, folder, "doc_id LONG, text STRING")


def _batches(spark: SparkSession, sf_dir: str) -> tuple[str, list[list[str]]]:
    """Pages and their edges exported as two batches, by odd and even ids; the folder and the paths."""
    rows = durable(web.parsed(spark, sf_dir))
    page = rows.select("doc_id", "url", F.col("url").alias("final_url"), "title", "clean_text", F.lit("text/html").alias("content_type"), F.lit(0.0).alias("fetch_time"), F.lit(200).alias("status"), "depth", "geology_score")
    edges, folder = crawl.page_edges(rows).select("source_doc_id", "source_url", "target_url", "anchor_text"), _folder(spark)
    return folder, [files.export_batch(page.filter(F.col("doc_id") % 2 == i), edges.filter(F.col("source_doc_id") % 2 == i), folder, i, {"pages": i}, {"crawl": 0.5}, 1.5) for i in (0, 1)]


def batch_pages(spark, sf_dir):
    return files.load_pages(spark, _batches(spark, sf_dir)[0]).select("doc_id", "url", "title", content_hash(F.col("clean_text")).alias("content_hash"))


def batch_edges(spark, sf_dir):
    return files.load_edges(spark, _batches(spark, sf_dir)[0]).select("source_doc_id", "target_url", "anchor_text")


def batch_metadata(spark, sf_dir):
    rows = [files.read_document(spark, paths[2]) for paths in _batches(spark, sf_dir)[1]]
    return spark.createDataFrame([(r["batch"], r["pages_in_batch"], r["edges_in_batch"], r["stats"]["pages"]) for r in rows], "batch LONG, pages_in_batch LONG, edges_in_batch LONG, stat LONG")


def seeds(spark, sf_dir):
    """URLs of pages as a seeds file: every fifth is a comment, every seventh is padded, and a line is blank."""
    path, n = _folder(spark), F.col("page_id")
    line = F.when(n % 5 == 0, F.concat(F.lit("# "), "url")).when(n % 7 == 0, F.concat(F.lit("  "), "url", F.lit(" "))).otherwise(F.col("url"))
    lines = web.pages(spark, sf_dir).select(line.alias("value")).unionByName(spark.createDataFrame([("",)], "value STRING"))
    files.write_lines(lines, "value", path)
    return files.load_seeds(spark, path)


def text_lines(spark, sf_dir):
    """Hashes of the documents' texts through a gzipped file of lines."""
    path = _folder(spark)
    files.write_lines(documents(spark, sf_dir).select(content_hash(F.col("text")).alias("h")), "h", path)
    return files.read_lines(spark, path).select(F.col("value").alias("content_hash"))


def saved_index(spark, sf_dir):
    """BM25 over an index that was saved and loaded."""
    folder = _folder(spark)
    corpus(spark, sf_dir).save(folder)
    return _hits(rank.bm25(index.Index.load(spark, folder, "raw"), REPEATED))


def saved_graph(spark, sf_dir):
    """Degrees in a graph that was saved and loaded."""
    links, folder = supplier_graph(spark, sf_dir), _folder(spark)
    files.save_tables(folder, nodes=links.nodes, links=links.links)
    return graph.degrees(graph.Graph(*(files.load_table(spark, folder, t) for t in ("nodes", "links"))))


def saved_pagerank(spark, sf_dir):
    folder = _folder(spark)
    files.save_tables(folder, pagerank=fixed_pagerank(spark, sf_dir))
    return files.load_table(spark, folder, "pagerank").select("doc_id", F.round("score", 6).alias("score"))


def cluster_csv(spark, sf_dir):
    path = _folder(spark)
    files.write_cluster_csv(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label"), path)
    return spark.read.option("header", True).schema("vec_id LONG, label INT").csv(path)


#: Entries of a query log: query, method, seconds.
LOGGED = [("fault rock", "vector", 0.25), ("lava", "hits", 1.5), ("ash", "combined", 0.125), ("plate", "pagerank", 2.0)]


def logged_queries(spark, sf_dir):
    """The last three of four entries, with the number of all."""
    path = _folder(spark)
    for i, (query, method, elapsed) in enumerate(LOGGED):
        files.log_query(spark, path, query, method, elapsed, f"2024-01-0{i + 1}T00:00:00")
    n, last = files.tail_log(files.read_jsonl(spark, path, files.LOG), 3)
    return last.withColumn("entries", F.lit(n).cast("long"))


def restored_frontier(spark, sf_dir):
    """A saved crawl's queue when it is read again: no repeats, nothing visited, nothing too deep."""
    rows = web._links(spark, sf_dir).filter("target <> ''")
    seq = F.col("page_id") * 100_000 + F.col("pos")
    front = rows.select(F.col("target").alias("url"), (F.col("page_id") % 11).cast("int").alias("depth"), F.lit(1).alias("score"), F.col("page_id").alias("discovered_from"), F.lit("normal").alias("queue"), seq.alias("seq"))
    visited = web.pages(spark, sf_dir).filter("page_id % 3 = 0").select(simple_normalize(F.col("url")).alias("url"))
    folder = _folder(spark)
    files.save_crawl(folder, front, visited, visited.select(content_hash(F.col("url")).alias("content_hash")), {"next_doc_id": 7})
    found, _, hashes, state = files.load_crawl(spark, folder)
    return found.select("url", "depth", "discovered_from", "seq", F.lit(state["next_doc_id"]).cast("long").alias("next_doc_id"), F.lit(hashes.count()).cast("long").alias("n_hashes"))


def _segmented(spark: SparkSession, sf_dir: str) -> SegmentedIndex:
    """The documents as three batches: English ones; all others, and changed texts for one source; deletions of another source."""
    own = SegmentedIndex(spark, _folder(spark), "raw", fanout=2)
    none, lang, source = F.lit(""), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    rows = documents(spark, sf_dir)
    text = F.when(source == "src1", F.concat(lang, F.lit(" "), F.coalesce("text", none))).otherwise(F.col("text"))
    page = lambda t, clean: t.select("doc_id", none.alias("url"), none.alias("final_url"), none.alias("title"), clean.alias("clean_text"), F.lit(0).alias("geology_score"))
    own.add(page(rows.filter(lang == "en"), F.col("text")))
    own.add(page(rows.filter((lang != "en") | (source == "src1")), text))
    own.delete(rows.filter(source == "src2").select("doc_id"))
    return own


def segment_postings(spark, sf_dir):
    """Live postings after all segments have been merged."""
    own = _segmented(spark, sf_dir)
    own.merge(whole=True)
    return own.snapshot().postings


def segment_df(spark, sf_dir):
    """Document frequencies over several segments and tombstones."""
    return index.term_df(_segmented(spark, sf_dir).snapshot().postings)


def segment_search(spark, sf_dir):
    """BM25 over the last snapshot."""
    return _hits(rank.bm25(_segmented(spark, sf_dir).snapshot(), REPEATED))


def segment_history(spark, sf_dir):
    """The size of each version, as its document has it and as its snapshot's rows give it, read after a merge."""
    own, rows = _segmented(spark, sf_dir), None
    own.merge(whole=True)
    for version in own.versions.all():
        found = own.snapshot(version)
        part = found.doc_store.agg(F.lit(version).cast("long").alias("version"), F.count("*").alias("n_rows"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("words"))
        part = part.crossJoin(F.broadcast(found.stats)).withColumn("avg_dl", F.round("avg_dl", 6))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _visited(spark: SparkSession, sf_dir: str) -> SeenSet:
    """Addresses of pages, first links, and links of pages whose path begins /en, as runs of a set of seen URLs."""
    own, links = SeenSet(spark, _folder(spark), buckets=16, cell=200, fanout=3), web._links(spark, sf_dir)
    batches = [web.pages(spark, sf_dir).select(simple_normalize(F.col("url")).alias("url")), links.filter("pos = 0").select(F.col("target").alias("url")), links.filter(F.col("url").rlike("^https?://[^/]+/en/")).select(F.col("target").alias("url"))]
    for batch in batches:
        own.add(own.new(batch.filter("url <> ''")))
    return own


def seen_urls(spark, sf_dir):
    """All URLs of the set."""
    return _visited(spark, sf_dir).all()


def unseen_links(spark, sf_dir):
    """Links that the set doesn't hold."""
    links = web._links(spark, sf_dir).select(F.col("target").alias("url")).filter("url <> ''")
    return _visited(spark, sf_dir).new(links)


def block_max_topk(spark, sf_dir):
    """The ten best documents for the first line of each document whose id 50 divides, by saved blocks with score bounds."""
    folder = _folder(spark)
    found = corpus(spark, sf_dir).settled()
    BlockIndex.save_ranges(blocks.with_ranges(found, documents(spark, sf_dir)), folder)
    queries = documents(spark, sf_dir).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.substring_index("text", "\n", 1).alias("text"))
    return blocks.top_k(BlockIndex.load_ranges(spark, folder, "raw"), queries).withColumn("score", F.round("score", 6))


_KEPT_EDGES = f"(SELECT page_id, target, anchor FROM {web._FIRST_SQL} WHERE NOT {web._utility_sql('target')})"
_SEEN = f"(SELECT DISTINCT {web._normalize_sql('url')} AS url FROM pages WHERE page_id % 3 = 0)"

#: The documents as the three batches leave them.
_LIVE = "live AS (SELECT doc_id, CASE WHEN source = 'src1' THEN coalesce(lang, '') || ' ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE coalesce(source, '') <> 'src2')"
_LIVE_CTES = f"{_LIVE}, {CTES.replace('documents', 'live')}"
_SIZES = "count(*) AS n_rows, CAST(sum(len(" + TOKENS + ")) AS BIGINT) AS words, count(*) AS n, round(CAST(sum(len(" + TOKENS + ")) AS DOUBLE) / count(*), 6) AS avg_dl"
_VISITED = f"SELECT {web._normalize_sql('url')} AS url FROM pages UNION SELECT target FROM {web._LINKS_SQL} WHERE pos = 0 OR regexp_matches(url, '^https?://[^/]+/en/')"

QUERIES = {f.__name__: f for f in (jsonl_documents, batch_pages, batch_edges, batch_metadata, seeds, text_lines, saved_index, saved_graph, saved_pagerank, cluster_csv, logged_queries, restored_frontier, segment_postings, segment_df, segment_search, segment_history, seen_urls, unseen_links, block_max_topk)}
ORACLES = {
    "jsonl_documents": "SELECT doc_id, text FROM documents",
    "batch_pages": f"SELECT page_id AS doc_id, url, title, sha256(text) AS content_hash FROM {web._PAGE_SQL} WHERE NOT ({web._utility_sql('url')} OR regexp_matches(lower(title), '{'|'.join(web.UTILITY_TITLES_INDEX)}'))",
    "batch_edges": f"SELECT page_id AS source_doc_id, target AS target_url, anchor AS anchor_text FROM {_KEPT_EDGES}",
    "batch_metadata": f"SELECT b AS batch, (SELECT count(*) FROM pages WHERE page_id % 2 = b) AS pages_in_batch, (SELECT count(*) FROM {_KEPT_EDGES} WHERE page_id % 2 = b) AS edges_in_batch, b AS stat FROM range(2) t(b)",
    "seeds": f"SELECT url FROM (SELECT DISTINCT page_id % 7 = 0 AS padded, url AS line, {web._normalize_sql('url')} AS url FROM pages WHERE page_id % 5 <> 0) WHERE url <> ''",
    "text_lines": "SELECT DISTINCT sha256(coalesce(text, '')) AS content_hash FROM documents",
    "saved_index": f"WITH {CTES}, r AS ({bm25_sql(REPEATED)}) {_hits_sql('r')}",
    "segment_postings": f"WITH {_LIVE_CTES} SELECT term, doc_id, tf FROM p",
    "segment_df": f"WITH {_LIVE_CTES} SELECT term, df FROM df",
    "segment_search": f"WITH {_LIVE_CTES}, r AS ({bm25_sql(REPEATED)}) {_hits_sql('r')}",
    "segment_history": f"""WITH {_LIVE}, changed AS (SELECT doc_id, CASE WHEN source = 'src1' THEN coalesce(lang, '') || ' ' || coalesce(text, '') ELSE text END AS text FROM documents)
SELECT CAST(1 AS BIGINT) AS version, {_SIZES} FROM documents WHERE lang = 'en' UNION ALL SELECT 2, {_SIZES} FROM changed UNION ALL SELECT 3, {_SIZES} FROM live UNION ALL SELECT 4, {_SIZES} FROM live""",
    "block_max_topk": f"""WITH {CTES}, q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT doc_id AS query_id, unnest({TOKENS.replace('text', 'string_split(text, chr(10))[1]')}) AS term FROM documents WHERE doc_id % 50 = 0) GROUP BY ALL),
r AS (SELECT query_id, p.doc_id, sum(q.qtf * ln((s.n - df.df + 0.5) / (df.df + 0.5) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * d.doc_len / s.avg_dl))) AS score FROM q JOIN p USING (term) JOIN df USING (term) JOIN d ON d.doc_id = p.doc_id CROSS JOIN s GROUP BY query_id, p.doc_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM r QUALIFY rank <= 10""",
    "seen_urls": f"SELECT url FROM ({_VISITED}) WHERE url <> ''",
    "unseen_links": f"SELECT DISTINCT target AS url FROM {web._LINKS_SQL} WHERE target <> '' AND target NOT IN (SELECT url FROM ({_VISITED}))",
    "saved_graph": f"WITH {_LINKS} SELECT id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM links GROUP BY src) o ON o.src = id LEFT JOIN (SELECT dst, count(*) AS n FROM links GROUP BY dst) i ON i.dst = id",
    "saved_pagerank": f"SELECT doc_id, round(score, 6) AS score FROM ({PAGERANK_SQL})",
    "cluster_csv": "SELECT vec_id, label FROM embeddings",
    "logged_queries": "SELECT query, method, elapsed_sec, timestamp, CAST(4 AS BIGINT) AS entries FROM (VALUES "
    + ", ".join(f"('{q}', '{m}', {e}::DOUBLE, '2024-01-0{i + 1}T00:00:00')" for i, (q, m, e) in enumerate(LOGGED))
    + ") v(query, method, elapsed_sec, timestamp) ORDER BY timestamp DESC LIMIT 3",
    "restored_frontier": f"""WITH f AS (SELECT target AS url, CAST(page_id % 11 AS INTEGER) AS depth, page_id AS discovered_from, page_id * 100000 + pos AS seq FROM {web._LINKS_SQL} WHERE target <> '' AND page_id % 11 <= 8),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1) SELECT *, CAST(7 AS BIGINT) AS next_doc_id, (SELECT count(*) FROM {_SEEN}) AS n_hashes FROM b WHERE url NOT IN (SELECT url FROM {_SEEN})""",
}
