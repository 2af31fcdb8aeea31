"""Queries for clustering, the query log and windows, joins and the service."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import service
from ..operators import cluster
from ..session import partitions_for
from ..sources.pages import clusterable, tail_log
from ..streaming.ingest import sessions, windowed


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def document_clusters(spark, sf_dir):
    """All four clusterings of the documents, with 50 latent dimensions."""
    return cluster.cluster_documents(_read(spark, sf_dir, "documents"), components=50, threshold=0.6)


def kmeans(spark, sf_dir):
    return cluster.kmeans(_vectors(spark, sf_dir), "vec_id", k=10)


def lsa(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows = cluster.latent(_vectors(spark, sf_dir), "vec_id", 8)
    return rows.select("vec_id", F.round(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, v: a + v * v), 6).alias("norm"))


def birch(spark, sf_dir):
    return cluster.birch(_vectors(spark, sf_dir), "vec_id", threshold=6.0)[0]


def agglomerative(spark, sf_dir):
    """Final labels of vectors by their subclusters' centroids."""
    vectors = _vectors(spark, sf_dir).persist()
    labels, _ = cluster.birch(vectors, "vec_id", threshold=6.0)
    return cluster.mapped(labels, cluster.agglomerated(cluster.usable(cluster.centroids(vectors, labels, "vec_id")), 10))


def label_centroids(spark, sf_dir):
    """Mean vectors by label, in long form."""
    from pyspark.ml.functions import vector_to_array

    rows = cluster.centroids(_vectors(spark, sf_dir), _read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label")
    return rows.select("label", F.posexplode(vector_to_array("centroid")).alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("mean"))


def cluster_backmap(spark, sf_dir):
    """Labels 0 to 9 mapped to five final ones; every fifth has none."""
    final = spark.createDataFrame([(i, i // 2) for i in range(10) if i % 5], "label INT, final_cluster INT")
    return cluster.mapped(_read(spark, sf_dir, "embeddings").select("vec_id", "label"), final, "label")


def cluster_counts(spark, sf_dir):
    return cluster.cluster_counts(_read(spark, sf_dir, "embeddings"), "label")


def clusterable_pages(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.lit(200).alias("status"), F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.lit("").alias("title"), "text")
    return clusterable(rows).select("url", F.length("text").cast("long").alias("n"))


def query_log_tail(spark, sf_dir):
    """The last entries of the events as a log; ids tell equal times apart."""
    log = _read(spark, sf_dir, "events").withColumn("timestamp", F.concat_ws(" ", F.col("ts").cast("string"), F.lpad(F.col("event_id").cast("string"), 12, "0")))
    return tail_log(log)[1].select("event_id", "user_id", "event_type")


def tumbling_window(spark, sf_dir):
    return windowed(_read(spark, sf_dir, "events"), "ts", "event_type", "1 hour", value="value")


def sliding_window(spark, sf_dir):
    return windowed(_read(spark, sf_dir, "events"), "ts", "event_type", "2 hours", "1 hour")


def session_window(spark, sf_dir):
    return sessions(_read(spark, sf_dir, "events"), "ts", "user_id", "30 minutes")


def join_semi(spark, sf_dir):
    big = _read(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return _read(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


def join_anti(spark, sf_dir):
    big = _read(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return _read(spark, sf_dir, "customer").join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


def join_full_outer(spark, sf_dir):
    """Customers and suppliers of each nation, nations of either kind alone included."""
    one = _read(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    two = _read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return one.join(two, "nation", "full_outer").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def join_left(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("judged"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("toxic"))


def self_join_pairs(spark, sf_dir):
    """Pairs of parts that stand in an order together, at least twice."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    # An order has a few lines, so pairs are some times the lines; most are the only ones of their kind.
    n = partitions_for(spark, 4 * lines.count())
    lines = lines.repartition(n, "l_orderkey").distinct()
    pairs = lines.toDF("o", "a").join(lines.toDF("o", "b"), "o").filter("a < b").select("a", "b")
    rows = pairs.repartition(n, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return rows.filter("n >= 2")


def set_operations(spark, sf_dir):
    one, two = (_read(spark, sf_dir, t).select(F.col(c).alias("nation")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    tag = lambda df, name: df.select("nation", F.lit(name).alias("kind"))
    return tag(one.union(two).distinct(), "union").unionByName(tag(one.intersect(two), "intersect")).unionByName(tag(one.subtract(two), "except"))


def top_per_group(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _read(spark, sf_dir, "orders").withColumn("n", F.row_number().over(order)).filter("n <= 2").select("o_custkey", "o_orderkey", F.col("n").cast("long").alias("n"))


def outside_searches(spark, sf_dir):
    return service.outside_searches(_read(spark, sf_dir, "part").select(F.col("p_name").alias("query")).distinct())


def capabilities(spark, sf_dir):
    return service.capabilities(spark)


_WINDOW = "time_bucket(INTERVAL '1 hour', ts)"
QUERIES = {
    f.__name__: f
    for f in (
        document_clusters, kmeans, lsa, birch, agglomerative, label_centroids, cluster_backmap, cluster_counts, clusterable_pages, query_log_tail, tumbling_window, sliding_window, session_window,
        join_semi, join_anti, join_full_outer, join_left, self_join_pairs, set_operations, top_per_group, outside_searches, capabilities,
    )
}
ORACLES = {
    "label_centroids": "SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings WHERE label >= 0) GROUP BY label, dim",
    "cluster_backmap": "SELECT vec_id, label, CASE WHEN label BETWEEN 0 AND 9 AND label % 5 <> 0 THEN label // 2 ELSE -1 END AS final_cluster FROM embeddings",
    "cluster_counts": f"""SELECT 'cluster_' || label AS id, 'Cluster ' || label AS name, [{', '.join(f"'{c}'" for c in cluster.PALETTE)}][1 + (row_number() OVER (ORDER BY label) - 1) % {len(cluster.PALETTE)}] AS color, count(*) AS count FROM embeddings GROUP BY label""",
    "clusterable_pages": "SELECT 'u' || doc_id AS url, length(x) AS n FROM (SELECT doc_id, trim(regexp_replace(lower(' ' || text), '\\s+', ' ', 'g')) AS x FROM documents WHERE text <> '') WHERE len(list_filter(string_split(x, ' '), lambda w: w <> '')) >= 20",
    "query_log_tail": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "tumbling_window": f"SELECT {_WINDOW} AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_window": f"SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT unnest([{_WINDOW}, {_WINDOW} - INTERVAL '1 hour']) AS w, event_type FROM events) GROUP BY ALL",
    "session_window": """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "join_full_outer": "SELECT coalesce(a.k, b.k) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k",
    "join_left": "SELECT lang, count(*) AS n, count(quality) AS judged, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "self_join_pairs": "WITH l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem) SELECT x.s AS a, y.s AS b, count(*) AS n FROM l x JOIN l y ON x.o = y.o AND x.s < y.s GROUP BY 1, 2 HAVING count(*) >= 2",
    "set_operations": "SELECT *, 'union' AS kind FROM (SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT *, 'intersect' FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT *, 'except' FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
    "top_per_group": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders QUALIFY n <= 2",
    "outside_searches": "SELECT DISTINCT p_name AS query, e AS engine, CASE e WHEN 'google' THEN 'https://www.google.com/search?q=' ELSE 'https://www.bing.com/search?q=' END || replace(p_name, ' ', '+') AS search_url FROM part CROSS JOIN (VALUES ('google'), ('bing')) v(e)",
    "capabilities": "SELECT * FROM (VALUES ('relevance', true, ['vector', 'pagerank', 'hits', 'combined']), ('clustering', true, ['flat', 'birch', 'agg_average', 'agg_complete']), ('expansion', true, ['rocchio', 'association', 'metric', 'scalar']), ('comparison', true, ['google', 'bing'])) v(module, available, methods)",
}
