"""Queries over `documents` as a corpus: index, ranking, expansion."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import STOP_WORDS
from ..functions.stemmer import stem_sql, stem_words
from ..functions.text import content_hash, remove_stop_words, tokenize
from ..functions.urls import first_by
from ..operators import cluster, expand, index, rank
from ..session import durable
from .links import HITS_SQL, PAGERANK_SQL, authority, fixed_pagerank

QUERY = "estion ndtion tionen"
REPEATED = "estion estion queque"
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def corpus(spark: SparkSession, sf_dir: str, analyzer: str = "raw") -> index.Index:
    """The documents as pages without titles and addresses."""
    none = F.lit("")
    pages = documents(spark, sf_dir).select("doc_id", none.alias("url"), none.alias("final_url"), none.alias("title"), F.col("text").alias("clean_text"), F.lit(0).alias("geology_score"))
    return index.build_index(pages, analyzer)


def written(spark: SparkSession, sf_dir: str) -> index.Index:
    """The same with its postings written once, for queries that read them several times."""
    found = corpus(spark, sf_dir)
    return index.Index(durable(found.postings), found.doc_store, found.stats, "raw")


CTES = f"""t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY term, doc_id),
d AS (SELECT doc_id, len({TOKENS}) AS doc_len FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(doc_len) AS DOUBLE) / count(*) AS avg_dl FROM d),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""


def _terms_sql(query: str) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(query.split())) + ") AS v(pos, term)"


def bm25_sql(query: str) -> str:
    """CTE body: doc_id, score."""
    return f"""SELECT p.doc_id, sum(q.qtf * ln((s.n - df.df + 0.5) / (df.df + 0.5) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * d.doc_len / s.avg_dl))) AS score
FROM (SELECT term, count(*) AS qtf FROM {_terms_sql(query)} GROUP BY term) q JOIN p USING (term) JOIN df USING (term) JOIN d ON d.doc_id = p.doc_id CROSS JOIN s GROUP BY p.doc_id"""


def tfidf_sql(query: str) -> str:
    return f"""SELECT doc_id, sum(qw * dw) / coalesce(nullif(qn * sqrt(sum(dw * dw)), 0), 1) AS score FROM (
SELECT p.doc_id, log10(s.n / df.df) AS qw, (1 + log10(p.tf)) * log10(s.n / df.df) AS dw FROM (SELECT DISTINCT term FROM {_terms_sql(query)}) q JOIN p USING (term) JOIN df USING (term) CROSS JOIN s)
CROSS JOIN (SELECT sqrt(sum(power(log10(s.n / df.df), 2))) AS qn FROM (SELECT DISTINCT term FROM {_terms_sql(query)}) q JOIN df USING (term) CROSS JOIN s) GROUP BY doc_id, qn"""


def _hits(ranked: DataFrame) -> DataFrame:
    order = Window.orderBy(*rank.by_score())  # over the k rows of a result
    return ranked.select(F.row_number().over(order).alias("rank"), "doc_id", F.round("score", 6).alias("score"))


def _hits_sql(name: str, k: int = 10) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM {name} ORDER BY round(score, 9) DESC, doc_id LIMIT {k}"


def bm25_topk(spark, sf_dir):
    found = corpus(spark, sf_dir).settled()
    return rank.format_results(rank.bm25(found, QUERY), found.doc_store)


def bm25_dup_terms(spark, sf_dir):
    return _hits(rank.bm25(corpus(spark, sf_dir).settled(), REPEATED))


def tfidf_topk(spark, sf_dir):
    return _hits(rank.tfidf_rank(corpus(spark, sf_dir), QUERY))


def tfidf_single_term(spark, sf_dir):
    return _hits(rank.tfidf_rank(corpus(spark, sf_dir), "estion"))


def bm25_full_analyzer(spark, sf_dir):
    return _hits(rank.bm25(corpus(spark, sf_dir, "full").settled(), "nations the running estions"))


def postings_tf(spark, sf_dir):
    return corpus(spark, sf_dir).postings


def doc_len(spark, sf_dir):
    return corpus(spark, sf_dir).doc_store.select("doc_id", "doc_len")


def doc_store(spark, sf_dir):
    return corpus(spark, sf_dir).doc_store.select("doc_id", "clean_text_preview", "doc_len", "geology_score")


def corpus_stats(spark, sf_dir):
    return corpus(spark, sf_dir).stats.select("n", F.round("avg_dl", 6).alias("avg_dl"))


def term_df(spark, sf_dir):
    return index.term_df(corpus(spark, sf_dir).postings)


def vocab_prune(spark, sf_dir):
    found = corpus(spark, sf_dir)
    return index.prune_vocab(found.postings, found.stats)


def tfidf_weights(spark, sf_dir):
    found = written(spark, sf_dir)
    return index.tfidf_weights(found.postings, found.stats).withColumn("w", F.round("w", 6))


def doc_terms(spark, sf_dir):
    return index.doc_terms(corpus(spark, sf_dir).postings).select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", " ").alias("terms"))


def term_cosine(spark, sf_dir):
    """Cosines of one term with all terms that stand in a document with it."""
    found = written(spark, sf_dir)
    weights = index.tfidf_weights(found.postings, found.stats)
    near = found.postings.filter("term = 'estion'").select("doc_id")
    pairs = found.postings.join(near, "doc_id", "left_semi").filter("term <> 'estion'").select(F.lit("estion").alias("a"), F.col("term").alias("b")).distinct()
    return index.term_cosines(weights, pairs).select("a", "b", F.round("cosine", 6).alias("cosine"))


def stopword_filter(spark, sf_dir):
    kept = remove_stop_words(tokenize(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", F.size(kept).cast("long").alias("n_kept"), F.array_join(kept, " ").alias("kept"))


def porter_vocab(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.explode(tokenize(F.col("text"))).alias("term"))
    return stem_words(rows, vocabulary=True)


def content_hash_dedup(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("content_hash", content_hash(F.col("text")))
    return first_by(rows.select("doc_id", "content_hash"), "content_hash", "doc_id")


def min_length_filter(spark, sf_dir):
    return documents(spark, sf_dir).filter(F.length("text") >= 200).select("doc_id", F.length("text").cast("long").alias("n"))


def max_normalize(spark, sf_dir):
    return rank.normalized(rank.bm25(corpus(spark, sf_dir).settled(), QUERY, 30)).select("doc_id", F.round("score", 6).alias("score"))


def pagerank_blend(spark, sf_dir):
    return _hits(rank.pagerank_search(corpus(spark, sf_dir).settled(), QUERY, fixed_pagerank(spark, sf_dir)))


def ensemble(spark, sf_dir):
    found, ranks, most = corpus(spark, sf_dir).settled(), fixed_pagerank(spark, sf_dir), rank.fetch_size(10)
    lists = {"tfidf": rank.tfidf_rank(found, QUERY, most), "pagerank": rank.pagerank_search(found, QUERY, ranks, most), "hits": rank.top(authority(spark, sf_dir), most)}
    return _hits(rank.ensemble(lists))


def precision_at_10(spark, sf_dir):
    judged = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("relevant"))
    return rank.precision_at(rank.bm25_scores(corpus(spark, sf_dir).settled(), QUERY), judged, 10)


def _rocchio(spark, sf_dir):
    found = written(spark, sf_dir).settled()
    return found, expand.rocchio(found, QUERY, rank.bm25(found, QUERY, expand.POOL))


def rocchio_terms(spark, sf_dir):
    return _rocchio(spark, sf_dir)[1].select("term", F.round("weight", 6).alias("weight"))


def rocchio_requery(spark, sf_dir):
    found, terms = _rocchio(spark, sf_dir)
    words = " ".join([*QUERY.split(), *(r["term"] for r in terms.collect())])
    return _hits(rank.bm25(found, words))


def association_jaccard(spark, sf_dir):
    return expand.association(written(spark, sf_dir), QUERY).select("term", F.round("score", 6).alias("score"))


def _metric(spark, sf_dir, per_doc=None):
    found = corpus(spark, sf_dir)
    return expand.metric_clusters(index.Index(durable(found.postings), found.doc_store, durable(found.stats), "raw"), 0.5, per_doc)


def metric_components(spark, sf_dir):
    """Clusters at a cosine of 0.5; the default of 0.12 joins nearly all words of these texts."""
    return _metric(spark, sf_dir)


def metric_expand(spark, sf_dir):
    """Siblings of the first terms of the first three clusters that have any, each document joining the first METRIC_TERMS_PER_DOC of its terms."""
    found, clusters = corpus(spark, sf_dir), durable(_metric(spark, sf_dir, expand.METRIC_TERMS_PER_DOC))
    several = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("term").alias("term")).filter("n > 1").orderBy("cluster_id").limit(3)
    return expand.siblings(clusters, [r["term"] for r in several.orderBy("cluster_id").collect()], found)


def scalar_clusters(spark, sf_dir):
    return expand.scalar_clusters(corpus(spark, sf_dir))


def scalar_expand(spark, sf_dir):
    found = corpus(spark, sf_dir)
    return expand.siblings(scalar_clusters(spark, sf_dir), QUERY.split(), found)


def document_features(spark, sf_dir):
    """Each document's unit vector over the whole pruned vocabulary: its number of terms, its sum, its largest weight."""
    rows = documents(spark, sf_dir)
    found = cluster.word_weights(rows).groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("w").alias("s"), F.max("w").alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    share = lambda c: F.round(F.coalesce(F.col(c) / F.col("l"), F.lit(0.0)), 6)
    return rows.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), share("s").alias("total"), share("m").alias("largest"))


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_KEPT = f"list_filter({TOKENS}, lambda w: NOT list_contains({_STOP}, w))"
_PR = f"pr AS (SELECT doc_id, score FROM ({PAGERANK_SQL}))"


def _blend_sql(query: str, k: int) -> str:
    return f"""SELECT b.doc_id, 0.7 * b.score / max(b.score) OVER () + 0.3 * coalesce(pr.score, 0) * 1000 AS score
FROM (SELECT * FROM ({bm25_sql(query)}) ORDER BY round(score, 9) DESC, doc_id LIMIT {5 * k}) b LEFT JOIN pr ON pr.doc_id = b.doc_id"""


def _list_sql(body: str, weight: float, k: int = 40) -> str:
    return f"SELECT doc_id, round(score, 6) / max(round(score, 6)) OVER () * {weight} AS score FROM (SELECT * FROM ({body}) ORDER BY round(score, 9) DESC, doc_id LIMIT {k})"


_ROCCHIO = f"""pool AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rn, count(*) OVER () AS size FROM (SELECT * FROM ({bm25_sql(QUERY)}) ORDER BY round(score, 9) DESC, doc_id LIMIT 80)),
picked AS (SELECT doc_id, CASE WHEN rn <= 10 THEN 0.75 / 10 WHEN size >= 17 AND rn > size - 5 THEN -0.15 / 5 END AS share FROM pool WHERE size > 10),
parts AS (SELECT p.term, share * (1 + log10(p.tf)) * log10(s.n / df.df) AS w FROM picked JOIN p USING (doc_id) JOIN df ON df.term = p.term CROSS JOIN s WHERE share IS NOT NULL
UNION ALL SELECT df.term, log10(s.n / df.df) FROM (SELECT DISTINCT term FROM {_terms_sql(QUERY)}) q JOIN df USING (term) CROSS JOIN s WHERE (SELECT max(size) FROM pool) > 10),
best AS (SELECT term, sum(w) AS weight FROM parts GROUP BY term HAVING sum(w) > 0),
rocchio AS (SELECT term, weight FROM best WHERE term NOT IN (SELECT term FROM {_terms_sql(QUERY)}) ORDER BY round(weight, 9) DESC, term LIMIT 8)"""
_REQUERY = bm25_sql(QUERY).replace(_terms_sql(QUERY), f"(SELECT term FROM {_terms_sql(QUERY)} UNION ALL SELECT term FROM rocchio)")

#: Labels spread along links by their smallest value, SPREAD times at most.
SPREAD = 60
_METRIC = f"""{CTES}, vocab AS (SELECT term FROM df CROSS JOIN s WHERE df BETWEEN 2 AND greatest(1, floor(n * 0.85))),
w AS MATERIALIZED (SELECT term, doc_id, (1 + log10(tf)) * log10(n / df) AS w FROM p JOIN df USING (term) JOIN vocab USING (term) CROSS JOIN s), m AS MATERIALIZED (SELECT term, sqrt(sum(w * w)) AS m FROM w GROUP BY term),
few AS MATERIALIZED (SELECT doc_id, term FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(term), term) <= {expand.METRIC_TERMS_PER_DOC}),
pairs AS MATERIALIZED (SELECT DISTINCT a.term AS a, b.term AS b FROM few a JOIN few b ON a.doc_id = b.doc_id AND a.term < b.term),
near AS MATERIALIZED (SELECT pairs.a, pairs.b FROM pairs JOIN w x ON x.term = a JOIN w y ON y.term = b AND y.doc_id = x.doc_id JOIN m mx ON mx.term = a JOIN m my ON my.term = b GROUP BY pairs.a, pairs.b, mx.m, my.m HAVING mx.m * my.m > 0 AND round(sum(x.w * y.w) / (mx.m * my.m), 9) >= 0.5),
e AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
step AS (SELECT 0 AS i, term AS node, term AS c FROM vocab UNION ALL SELECT i + 1, node, least(min(c), min(o)) FROM (SELECT s.i, s.node, s.c, coalesce(t.c, s.c) AS o FROM step s LEFT JOIN e ON e.a = s.node LEFT JOIN step t ON t.node = e.b) WHERE i < {SPREAD} GROUP BY i, node),
metric AS MATERIALIZED (SELECT node AS term, c AS cluster_id FROM step WHERE i = {SPREAD})"""

#: The same where a document joins all of its terms.
_METRIC_ALL = "".join(re.split("few AS MATERIALIZED.*?(?=near AS)", _METRIC, flags=re.S)).replace("FROM pairs JOIN w x ON x.term = a JOIN w y ON y.term = b AND y.doc_id = x.doc_id JOIN m mx ON mx.term = a JOIN m my ON my.term = b GROUP BY pairs.a, pairs.b,", "FROM w x JOIN w y ON y.doc_id = x.doc_id AND x.term < y.term JOIN m mx ON mx.term = x.term JOIN m my ON my.term = y.term GROUP BY x.term, y.term,").replace("SELECT pairs.a, pairs.b", "SELECT x.term AS a, y.term AS b")

_FEATURES = f"""f AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w))) AS term FROM documents),
ft AS (SELECT doc_id, term, count(*) AS tf FROM f GROUP BY ALL), fd AS (SELECT term, count(*) AS df FROM ft GROUP BY term), fw AS (SELECT doc_id, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM ft JOIN fd USING (term) CROSS JOIN (SELECT count(*) AS n FROM documents) WHERE df BETWEEN 2 AND 0.8 * n)"""

QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_dup_terms, tfidf_topk, tfidf_single_term, bm25_full_analyzer, postings_tf, doc_len, doc_store, corpus_stats, term_df, vocab_prune, tfidf_weights, doc_terms, term_cosine,
        stopword_filter, porter_vocab, content_hash_dedup, min_length_filter, max_normalize, pagerank_blend, ensemble, precision_at_10, rocchio_terms, rocchio_requery, association_jaccard,
        metric_components, metric_expand, scalar_clusters, scalar_expand, document_features,
    )
}

ORACLES = {
    "bm25_topk": f"""WITH {CTES}, r AS ({bm25_sql(QUERY)}) SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, r.doc_id) AS INTEGER) AS rank, r.doc_id, round(score, 6) AS score, '' AS url, '' AS title, substr(text, 1, 300) AS snippet
FROM r JOIN documents USING (doc_id) ORDER BY round(score, 9) DESC, r.doc_id LIMIT 10""",
    "bm25_dup_terms": f"WITH {CTES}, r AS ({bm25_sql(REPEATED)}) {_hits_sql('r')}",
    "tfidf_topk": f"WITH {CTES}, r AS ({tfidf_sql(QUERY)}) {_hits_sql('r')}",
    "tfidf_single_term": f"WITH {CTES}, r AS ({tfidf_sql('estion')}) {_hits_sql('r')}",
    "bm25_full_analyzer": f"""WITH w AS (SELECT doc_id, unnest({_KEPT}) AS word FROM documents), stems AS ({stem_sql("(SELECT word FROM w UNION SELECT unnest(['nations', 'running', 'estions']))", "word")}),
t AS (SELECT doc_id, stem AS term FROM w JOIN stems USING (word)), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY term, doc_id), d AS (SELECT doc_id, len({_KEPT}) AS doc_len FROM documents),
s AS (SELECT count(*) AS n, CAST(sum(doc_len) AS DOUBLE) / count(*) AS avg_dl FROM d), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS ({bm25_sql(QUERY).replace(_terms_sql(QUERY), "(SELECT stem AS term FROM stems WHERE word IN ('nations', 'running', 'estions'))")}) {_hits_sql('r')}""",
    "postings_tf": f"WITH {CTES} SELECT * FROM p",
    "doc_len": f"SELECT doc_id, CAST(len({TOKENS}) AS INTEGER) AS doc_len FROM documents",
    "doc_store": f"SELECT doc_id, substr(text, 1, 500) AS clean_text_preview, CAST(len({TOKENS}) AS INTEGER) AS doc_len, 0 AS geology_score FROM documents",
    "corpus_stats": f"WITH {CTES} SELECT n, round(avg_dl, 6) AS avg_dl FROM s",
    "term_df": f"WITH {CTES} SELECT * FROM df",
    "vocab_prune": f"WITH {CTES} SELECT term, df FROM df CROSS JOIN s WHERE df BETWEEN 2 AND greatest(1, floor(n * 0.85))",
    "tfidf_weights": f"WITH {CTES} SELECT term, doc_id, round((1 + log10(tf)) * log10(n / df), 6) AS w FROM p JOIN df USING (term) CROSS JOIN s",
    "doc_terms": f"WITH {CTES} SELECT doc_id, count(*) AS n_terms, string_agg(term, ' ' ORDER BY term) AS terms FROM p GROUP BY doc_id",
    "term_cosine": f"""WITH {CTES}, w AS (SELECT term, doc_id, (1 + log10(tf)) * log10(n / df) AS w FROM p JOIN df USING (term) CROSS JOIN s), m AS (SELECT term, sqrt(sum(w * w)) AS m FROM w GROUP BY term)
SELECT x.term AS a, y.term AS b, round(CASE WHEN mx.m > 0 AND my.m > 0 THEN sum(x.w * y.w) / (mx.m * my.m) ELSE 0 END, 6) AS cosine FROM w x JOIN w y USING (doc_id) JOIN m mx ON mx.term = x.term JOIN m my ON my.term = y.term
WHERE x.term = 'estion' AND y.term <> 'estion' GROUP BY x.term, y.term, mx.m, my.m""",
    "stopword_filter": f"SELECT doc_id, len({_KEPT}) AS n_kept, array_to_string({_KEPT}, ' ') AS kept FROM documents",
    "porter_vocab": stem_sql(f"(SELECT unnest({TOKENS}) AS term FROM documents)", "term"),
    "content_hash_dedup": "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents GROUP BY 2",
    "min_length_filter": "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 200",
    "max_normalize": f"WITH {CTES}, r AS (SELECT * FROM ({bm25_sql(QUERY)}) ORDER BY round(score, 9) DESC, doc_id LIMIT 30) SELECT doc_id, round(score / max(score) OVER (), 6) AS score FROM r",
    "pagerank_blend": f"WITH {CTES}, {_PR}, r AS ({_blend_sql(QUERY, 10)}) {_hits_sql('r')}",
    "ensemble": f"""WITH {CTES}, {_PR}, lists AS ({_list_sql(tfidf_sql(QUERY), 0.5)} UNION ALL {_list_sql(_blend_sql(QUERY, 40), 0.3)} UNION ALL {_list_sql(f"SELECT doc_id, authority AS score FROM ({HITS_SQL})", 0.2)}),
r AS (SELECT doc_id, round(sum(score), 6) AS score FROM lists GROUP BY doc_id) {_hits_sql('r')}""",
    "precision_at_10": f"WITH {CTES}, r AS (SELECT * FROM ({bm25_sql(QUERY)}) ORDER BY round(score, 9) DESC, doc_id LIMIT 10) SELECT sum(coalesce(quality, 0)) / 10 AS precision FROM r LEFT JOIN labels USING (doc_id)",
    "rocchio_terms": f"WITH {CTES}, {_ROCCHIO} SELECT term, round(weight, 6) AS weight FROM rocchio",
    "rocchio_requery": f"WITH {CTES}, {_ROCCHIO}, r AS ({_REQUERY}) {_hits_sql('r')}",
    "association_jaccard": f"""WITH {CTES}, q AS (SELECT DISTINCT term FROM {_terms_sql(QUERY)}), co AS (SELECT a.term AS q, b.term, count(*) AS co FROM p a JOIN q ON q.term = a.term JOIN p b ON b.doc_id = a.doc_id AND b.term NOT IN (SELECT term FROM q) GROUP BY a.term, b.term)
SELECT co.term, round(max(co.co / (x.df + y.df - co.co)), 6) AS score FROM co JOIN df x ON x.term = co.q JOIN df y ON y.term = co.term GROUP BY co.term ORDER BY round(max(co.co / (x.df + y.df - co.co)), 9) DESC, co.term LIMIT 12""",
    "metric_components": f"WITH RECURSIVE {_METRIC_ALL} SELECT term, cluster_id FROM metric",
    "metric_expand": f"""WITH RECURSIVE {_METRIC}, several AS (SELECT cluster_id, CAST(row_number() OVER (ORDER BY cluster_id) - 1 AS INTEGER) AS pos FROM metric GROUP BY cluster_id HAVING count(*) > 1 ORDER BY cluster_id LIMIT 3)
SELECT pos, term FROM metric JOIN several USING (cluster_id) WHERE term <> cluster_id QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY term) <= {expand.SIBLINGS} ORDER BY pos, term LIMIT {expand.MOST}""",
    "document_features": f"""WITH {_FEATURES}, v AS (SELECT doc_id, count(*) AS n_terms, sum(w) AS s, max(w) AS m, sqrt(sum(w * w)) AS l FROM fw GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_terms, 0) AS n_terms, round(coalesce(s / l, 0), 6) AS total, round(coalesce(m / l, 0), 6) AS largest FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id""",
}
