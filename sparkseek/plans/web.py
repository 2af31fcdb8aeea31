"""Queries over `pages` and `documents` as crawled pages: URLs, titles, links, gates, scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions.lexicon import CHROME_TAGS, TRACKING_PARAMS, TRACKING_PREFIX, UTILITY_TITLES_CRAWL, UTILITY_TITLES_INDEX, UTILITY_WORDS
from ..functions.text import added_terms as text_added_terms
from ..functions.text import content_hash, is_utility_title, keyword_hits, link_priority, topic_score
from ..functions.urls import extract_domain, is_http_url, is_utility_page, is_utility_url, normalize_url, simple_normalize, url_map
from ..operators import crawl, graph
from ..session import durable, shared_folder

#: Words of the driver's texts that stand for topic keywords.
WORDS = ["estion", "ndtion", "tionen", "queque", "enlich"]
#: Words that are frequent in some of the texts' languages, so that every gate of a crawl stops some pages and lets some pass.
COMMON = ["the", "and", "que", "les", "estion"]
#: Non-ASCII characters as letters, so that both engines find the same word borders.
PLAIN = "regexp_replace({0}, '[^\\x00-\\x7F]', 'x', 'g')"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, pos, target, anchor of the links of whole pages, navigation included, by expressions."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    rows = pages(spark, sf_dir).select("page_id", "url", F.posexplode(found).alias("pos", "a"))
    href, anchor = F.regexp_extract("a", '<a href="([^"]*)">', 1), F.regexp_extract("a", ">([^<]*)<", 1)
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    return rows.select("page_id", "url", "pos", simple_normalize(F.concat(base, href)).alias("target"), anchor.alias("anchor"))


def url_normalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", simple_normalize(F.col("url")).alias("url"))


def url_normalize_full(spark, sf_dir):
    """The same by the complete rules, in Arrow batches."""
    return pages(spark, sf_dir).select("page_id", normalize_url(F.col("url")).alias("url"))


def url_domain(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(extract_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def url_dedup(spark, sf_dir):
    return pages(spark, sf_dir).groupBy(simple_normalize(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"))


def html_title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.title_of(F.col("html")).alias("title"))


def html_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.text_of(F.col("html")).alias("text"))


def html_parse(spark, sf_dir):
    """Title, text and links by the tree walk."""
    rows = html.parse_pages(pages(spark, sf_dir), keep_chrome=True)
    return rows.select("page_id", "title", F.length("clean_text").alias("n_chars"), F.size("outlinks").alias("n_links"), content_hash(F.col("clean_text")).alias("content_hash"))


def utility_filter(spark, sf_dir):
    title = html.title_of(F.col("html"))
    keep = ~is_utility_page(F.col("url"), F.lit(""), title) & ~is_utility_title(title) & ~is_utility_url(F.col("url"))
    return pages(spark, sf_dir).filter(keep).select("page_id", "url")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, navigation included, by the tree walk, as crawled ones without score at depth 0."""
    rows = html.parse_pages(pages(spark, sf_dir), keep_chrome=True)
    return rows.withColumns({"doc_id": F.col("page_id"), "geology_score": F.lit(0), "depth": F.lit(0)})


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.page_edges(parsed(spark, sf_dir))


def utility_links(spark, sf_dir):
    rows = html.parse_pages(pages(spark, sf_dir), keep_chrome=True).select("page_id", F.explode("outlinks").alias("target"))
    return rows.groupBy("page_id").agg(F.count_if(is_utility_url(F.col("target"))).alias("n_utility"), F.count("*").alias("n_links"))


def outlinks_edges(spark, sf_dir):
    """The first link of each page to each target that is no utility page, with its anchor text."""
    return _edges(spark, sf_dir).select("source_doc_id", "target_url", "anchor_text")


def _plain(column: str):
    return F.regexp_replace(column, r"[^\x00-\x7F]", "x")


def keyword_score(spark, sf_dir):
    hits, found = keyword_hits(_plain("text"), WORDS, 3)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", hits.cast("long").alias("hits"), F.size(found).cast("long").alias("n_found"))


def page_topic_score(spark, sf_dir):
    title, text = _plain("title"), _plain("text")
    rows = pages(spark, sf_dir).select("page_id", "url", html.title_of(F.col("html")).alias("title"), html.text_of(F.col("html")).alias("text"))
    return rows.select("page_id", topic_score(title, text, F.col("url"), WORDS).cast("long").alias("score"))


def link_priority_score(spark, sf_dir):
    rows = _links(spark, sf_dir)
    score = link_priority(F.col("page_id") % 13, _plain("anchor"), F.col("target"), WORDS)
    return rows.select("page_id", "pos", score.cast("long").alias("score"))


def per_group_first_n(spark, sf_dir):
    """The first three frontier candidates of each page."""
    rows = crawl.candidates(_edges(spark, sf_dir), WORDS, most=3)
    return rows.select(F.col("discovered_from").alias("page_id"), F.col("seq.pos").alias("pos"), F.col("url").alias("target"), "depth")


def _judged(spark, sf_dir, *more: str):
    """Documents as crawled pages: ids decide status, kind of content and title, words the score; with further columns."""
    n = F.col("doc_id")
    title, address = F.when(n % 8 == 3, "Contact us").otherwise(""), F.concat(F.lit("http://x.example/p"), n)
    html, status = F.when(n % 9 != 1, F.col("text")), F.when(n % 10 == 0, 404).otherwise(200)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", title.alias("title"), _plain("text").alias("clean_text"), address.alias("url"), html.alias("html"), status.alias("status"), *more)
    return crawl.judged(rows, COMMON)


def _given(spark, sf_dir):
    """Pages by their addresses, of equal ones the first: url, p (page_id, html)."""
    return pages(spark, sf_dir).select("page_id", simple_normalize(F.col("url")).alias("url"), "html").groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p"))


def _fetched(given: DataFrame) -> DataFrame:
    return given.select("url", "p.html", F.when(F.col("p.page_id") % 10 == 0, 404).otherwise(200).alias("status"))


def crawl_round(spark, sf_dir):
    """One round over all pages as the queue, in order of their ids: what it keeps, numbered from 100."""
    given = _given(spark, sf_dir)
    frontier = given.select("url", F.lit(0).alias("depth"), F.lit(9).alias("score"), F.lit(None).cast("long").alias("discovered_from"), F.lit("high").alias("queue"), F.col("p.page_id").alias("seq"))
    out = crawl.crawl_round(_fetched(given), frontier, spark.createDataFrame([], "url STRING"), first_id=100, size=1 << 30, keywords=COMMON)
    return out["pages"].select("doc_id", "url", F.length("clean_text").cast("long").alias("n_chars"), "depth")


def _crawled(spark: SparkSession, sf_dir: str) -> crawl.Crawl:
    """A crawl of all pages as seeds, in order of their ids, a hundred or so a round, until its queue is empty."""
    folder, given = f"{shared_folder(spark)}/crawl-{uuid.uuid4().hex}", durable(_given(spark, sf_dir))
    size = max(100, given.count() // 3)
    seeds = given.select("url", F.col("p.page_id").alias("seq"))
    fetched = _fetched(given).withColumns({"final_url": F.col("url"), "content_type": F.lit("text/html"), "fetch_time": F.lit(0.0)})
    none = spark.createDataFrame([], "origin STRING, status INT, body STRING")
    crawl.crawl(spark, seeds, folder, 10, size, COMMON, lambda asked: asked.join(fetched, "url"), lambda asked: none, buckets=8)
    return crawl.Crawl(spark, folder, 8)


def crawled_pages(spark, sf_dir):
    """What a crawl of several rounds exports, by the state it saved."""
    return _crawled(spark, sf_dir).pages().select("doc_id", "url", F.length("clean_text").cast("long").alias("n_chars"))


def crawled_state(spark, sf_dir):
    """Its counters, summed over the rounds, and the sizes of its sets."""
    own = _crawled(spark, sf_dir)
    sizes = {"known": own.known.all(own.now["known"]).count(), "hashes": own.hashes.all(own.now["hashes"]).count(), "batches": len(own.now["batches"])}
    return spark.createDataFrame(sorted((own.now["stats"] | sizes).items()), "name STRING, n LONG")


def _narrow(spark, sf_dir):
    """The judged documents without their texts, written once; and their funnel as that write counted it."""
    rows, counts = crawl.observed(_judged(spark, sf_dir))
    return durable(rows.select("doc_id", "stop", F.when(F.col("stop").isNull(), content_hash(F.col("clean_text"))).alias("content_hash"))), counts


def quality_funnel(spark, sf_dir):
    """The funnel, counted by the one pass that judges the documents."""
    rows, counts = _narrow(spark, sf_dir)
    found = counts(rows.filter(F.col("stop").isNull()).select("content_hash").distinct().count())
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{c} LONG" for c in found))


def stop_counts(spark, sf_dir):
    return crawl.stop_counts(_judged(spark, sf_dir))


def stop_cube(spark, sf_dir):
    """How many pages each gate stops, by language and source, with all subtotals; `level` tells which columns are summed over."""
    rows = _judged(spark, sf_dir, "lang", "source").select("lang", "source", F.coalesce("stop", F.lit("kept")).alias("stop"))
    counts = rows.cube("lang", "source", "stop").agg(F.grouping_id("lang", "source", "stop").cast("long").alias("level"), F.count("*").alias("pages"))
    return counts.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "stop")], "level", "pages")


def sequential_ids(spark, sf_dir):
    rows = crawl.first_contents(_judged(spark, sf_dir).filter(F.col("stop").isNull()), "doc_id")
    return crawl.numbered(rows.select("doc_id", "clean_text"), "doc_id", 1, "new_id").select("doc_id", "new_id", F.col("clean_text").alias("text"))


def frontier_priority_topk(spark, sf_dir):
    """The first 200 links of all pages by queue, then by order of arrival."""
    score = link_priority(F.col("page_id") % 13, _plain("anchor"), F.col("target"), WORDS)
    rows = _links(spark, sf_dir).select(F.col("target").alias("url"), F.lit(1).alias("depth"), score.alias("score"), F.col("page_id").alias("discovered_from"), (F.col("page_id") * 100_000 + F.col("pos")).alias("seq"))
    none = spark.createDataFrame([], "url STRING")
    return crawl.pop(crawl.keep_new(rows, none, none), 200).select("url", F.col("score").cast("long").alias("score"), "queue", "seq")


#: Queries and what an expansion made of them.
EXPANDED = [("fault rock", "fault rock lava ash lava"), ("Fault", "fault Fault ROCK"), ("a", "a"), ("ash ash", "ash cloud"), ("x y z", "z y x w")]


def added_terms(spark, sf_dir):
    rows = [(a, b, " ".join(text_added_terms(a, b))) for a, b in EXPANDED]
    return spark.createDataFrame(rows, "original STRING, expanded STRING, added STRING")


def robots_gate(spark, sf_dir):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: sparkseek\nDisallow: /en/\n"
    hosts = pages(spark, sf_dir).select(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("origin")).distinct()
    rules = hosts.select("origin", F.lit(200).alias("status"), F.lit(body).alias("body"))
    return crawl.allowed(pages(spark, sf_dir).select("page_id", "url"), rules)


def http_urls(spark, sf_dir):
    """Which addresses are of the web; every seventh is made one of a file server."""
    url = F.when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^[a-zA-Z]+:", "ftp:")).otherwise(F.col("url"))
    return pages(spark, sf_dir).select("page_id", is_http_url(url).alias("web"))


def _addressed(spark, sf_dir):
    return pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), "url", simple_normalize(F.col("url")).alias("final_url"))


def page_addresses(spark, sf_dir):
    return url_map(_addressed(spark, sf_dir))


def page_graph_edges(spark, sf_dir):
    """Links between pages, by the addresses that their links name; a page ends at the first link of the page after it."""
    ends = _links(spark, sf_dir).filter("pos = 0").select((F.col("page_id") - 1).alias("doc_id"), F.col("target").alias("final_url"))
    rows = _addressed(spark, sf_dir).drop("final_url").join(ends, "doc_id", "left")
    return graph.build_graph(rows, _edges(spark, sf_dir)).links


def host_turns(spark, sf_dir):
    """Seconds until each page's turn, two for each page of its host before it."""
    return crawl.host_delay(pages(spark, sf_dir).select("page_id", "url", F.col("page_id").alias("seq")), 2.0).select("page_id", "wait")


def frontier_unseen(spark, sf_dir):
    """Links that are neither seen (pages of even id) nor queued (pages of ids that three divides)."""
    rows = _links(spark, sf_dir).select(F.col("target").alias("url"), F.lit(1).alias("depth"), F.lit(1).alias("score"), F.col("page_id").alias("discovered_from"), (F.col("page_id") * 100_000 + F.col("pos")).alias("seq"))
    own = lambda n: pages(spark, sf_dir).filter(F.col("page_id") % n == 0).select(simple_normalize(F.col("url")).alias("url"))
    return crawl.keep_new(rows, own(2), own(3)).select("url", "discovered_from", "seq")


_STRINGS = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_PART = "^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?"


def _utility_sql(url: str) -> str:
    text = f"lower({url})"
    tokens = f"list_concat(regexp_split_to_array(regexp_extract({text}, '{_PART}', 3), '[/\\-_.]+'), regexp_split_to_array(regexp_extract({text}, '{_PART}', 4), '[=&\\-_.]+'))"
    return f"list_has_any({tokens}, {_STRINGS(UTILITY_WORDS)})"


def _normalize_sql(url: str) -> str:
    part = lambda n: f"regexp_extract(trim({url}), '{_PART}', {n})"
    host = f"regexp_replace(regexp_replace(lower(regexp_replace({part(2)}, '^[^@]*@', '')), ':$', ''), CASE WHEN lower({part(1)}) = 'http' THEN ':80$' ELSE ':443$' END, '')"
    pairs = f"list_filter(string_split({part(4)}, '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^{TRACKING_PREFIX}|^({'|'.join(TRACKING_PARAMS)})(=|$)'))"
    pairs = f"list_transform({pairs}, lambda q: CASE WHEN contains(q, '=') THEN q ELSE q || '=' END)"
    keyed = f"list_sort(list_transform({pairs}, lambda q: {{'k': lower(string_split(q, '=')[1]), 'v': regexp_replace(q, '^[^=]*=', ''), 'p': q}}))"
    query = f"array_to_string(list_transform({keyed}, lambda x: x.p), '&')"
    path = f"regexp_replace({part(3)}, '/+$', '')"
    path = f"CASE WHEN {path} = '' THEN '/' ELSE substr({path}, 1, 1) || regexp_replace(substr({path}, 2), '/{{2,}}', '/', 'g') END"
    return f"CASE WHEN lower({part(1)}) IN ('http', 'https') AND {host} <> '' THEN lower({part(1)}) || '://' || {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END ELSE '' END"


def _squash_sql(text: str) -> str:
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{mark}')"
    return f"trim(regexp_replace({text}, '[\\s\\x{{A0}}\\x{{2028}}\\x{{3000}}]+', ' ', 'g'))"


def _text_sql() -> str:
    text = "html"
    for tag in CHROME_TAGS:
        text = f"regexp_replace({text}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}>', ' ', 'g')"
    return text


_TITLE_SQL = _squash_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_ROOT = "coalesce(" + ", ".join(f"nullif(regexp_extract(x, '(?is)<{tag}(?:\\s[^>]*)?>(.*)</{tag}>', 1), '')" for tag in ("main", "article", "body")) + ", x)"
_PAGE_SQL = f"(SELECT page_id, url, {_TITLE_SQL} AS title, {_squash_sql(f'regexp_replace({_ROOT}, ' + chr(39) + '(?s)<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS text FROM (SELECT page_id, url, html, {_text_sql()} AS x FROM pages))"
_LINKS_SQL = f"""(SELECT page_id, url, pos, {_normalize_sql("regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_extract(a, '<a href=\"([^\"]*)\">', 1)")} AS target, regexp_extract(a, '>([^<]*)<', 1) AS anchor
FROM (SELECT page_id, url, unnest(l) AS a, unnest(range(len(l))) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS l FROM pages)))"""


def _count(text: str, word: str) -> str:
    return f"len(regexp_extract_all(lower({PLAIN.format(text)}), '\\b{word}\\b'))"


def _found_sql(text: str, words: list[str] = WORDS) -> str:
    return "(" + " + ".join(f"CAST({_count(text, w)} > 0 AS BIGINT)" for w in words) + ")"


def _hits_sql(text: str, words: list[str] = WORDS) -> str:
    return "(" + " + ".join(f"least({_count(text, w)}, 3)" for w in words) + ")"


_SPACED = "translate({0}, '-_', '  ')"
_UTILITY_TITLE = f"regexp_matches(lower(title), '{'|'.join(UTILITY_TITLES_CRAWL)}')"
_PRIORITY = f"greatest(least(page_id % 13, 10) + 2 * {_found_sql('anchor')} + {_found_sql(_SPACED.format('target'))} - CASE WHEN {_utility_sql('target')} THEN 5 ELSE 0 END, 0)"
_COVER = "(" + " + ".join(f"CAST({_count('title', w)} + {_count('text', w)} + {_count(_SPACED.format('url'), w)} > 0 AS BIGINT)" for w in WORDS) + ")"
_JUDGED = f"""j AS (SELECT doc_id, lang, source, {PLAIN.format('text')} AS text, CASE WHEN doc_id % 10 = 0 THEN 'status' WHEN text IS NULL OR doc_id % 9 = 1 THEN 'html' WHEN length(text) < 200 THEN 'length' WHEN doc_id % 8 = 3 THEN 'utility' WHEN {_hits_sql('text', COMMON)} + {_found_sql('text', COMMON)} < {crawl.TOPIC} THEN 'topic' END AS stop FROM documents),
k AS (SELECT min(doc_id) AS doc_id FROM j WHERE stop IS NULL GROUP BY sha256(coalesce(text, '')))"""

#: Each page's targets at their first sight, numbered in that order.
_FIRST_SQL = f"(SELECT page_id, target, anchor, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS pos FROM (SELECT page_id, target, min(pos) AS first, arg_min(anchor, pos) AS anchor FROM {_LINKS_SQL} WHERE target <> '' GROUP BY page_id, target))"
#: A page's score without utility marks; {0} is its URL.
_SCORE_SQL = "(" + " + ".join(f"(least({_count('x.text', w)}, 3) + 2 * CAST({_count('x.title', w)} > 0 AS BIGINT) + 2 * CAST({_count(_SPACED.format('{0}'), w)} > 0 AS BIGINT) + CAST({_count('x.title', w)} + {_count('x.text', w)} + {_count(_SPACED.format('{0}'), w)} > 0 AS BIGINT))".replace("{0}", "@") for w in COMMON).replace("@", "{0}") + ")"

#: What a crawl over all pages keeps: url, page_id, text.
_KEPT_SQL = f"""g AS (SELECT {_normalize_sql('url')} AS url, min(page_id) AS page_id FROM pages GROUP BY 1),
t AS (SELECT g.url, g.page_id, x.text, CASE WHEN g.page_id % 10 = 0 THEN 'status' WHEN length(x.text) < 200 THEN 'length' WHEN {_utility_sql('g.url')} OR {_UTILITY_TITLE} THEN 'utility' WHEN {_SCORE_SQL.format('g.url')} < {crawl.TOPIC} THEN 'topic' END AS stop FROM g JOIN {_PAGE_SQL} x ON x.page_id = g.page_id),
k AS (SELECT min_by(url, page_id) AS url, min(page_id) AS page_id, text FROM t WHERE stop IS NULL GROUP BY text)"""

#: Addresses of pages: the last page of each, by id, its final address after its own.
_ADDRESS_SQL = "(SELECT url, max_by(page_id, 2 * page_id + n) AS page_id FROM (SELECT page_id, 0 AS n, url FROM pages UNION ALL {0}) WHERE url <> '' GROUP BY url)"
_ENDS_SQL = f"SELECT page_id - 1, 1, target FROM {_LINKS_SQL} WHERE pos = 0 AND page_id - 1 IN (SELECT page_id FROM pages)"

QUERIES = {
    f.__name__: f
    for f in (
        url_normalize, url_normalize_full, url_domain, url_dedup, html_title, html_text, html_parse, utility_filter, utility_links, outlinks_edges, keyword_score, page_topic_score,
        link_priority_score, per_group_first_n, quality_funnel, stop_counts, stop_cube, sequential_ids, crawl_round, crawled_pages, crawled_state, added_terms, frontier_priority_topk, robots_gate,
        http_urls, page_addresses, page_graph_edges, host_turns, frontier_unseen,
    )
}

ORACLES = {
    "url_normalize": f"SELECT page_id, {_normalize_sql('url')} AS url FROM pages",
    "url_normalize_full": f"SELECT page_id, {_normalize_sql('url')} AS url FROM pages",
    "url_domain": f"SELECT lower(regexp_replace(regexp_replace(regexp_extract(url, '{_PART}', 2), '^[^@]*@', ''), ':[0-9]*$', '')) AS domain, count(*) AS n FROM pages GROUP BY 1",
    "url_dedup": f"SELECT {_normalize_sql('url')} AS url, min(page_id) AS page_id FROM pages GROUP BY 1",
    "html_title": f"SELECT page_id, title FROM {_PAGE_SQL}",
    "html_text": f"SELECT page_id, text FROM {_PAGE_SQL}",
    "utility_filter": f"SELECT page_id, url FROM {_PAGE_SQL} WHERE NOT ({_utility_sql('url')} OR regexp_matches(lower(title), '{'|'.join(UTILITY_TITLES_INDEX)}') OR {_UTILITY_TITLE})",
    "utility_links": f"SELECT page_id, CAST(count_if({_utility_sql('target')}) AS BIGINT) AS n_utility, count(*) AS n_links FROM {_FIRST_SQL} GROUP BY page_id",
    "outlinks_edges": f"SELECT page_id AS source_doc_id, target AS target_url, anchor AS anchor_text FROM {_FIRST_SQL} WHERE NOT {_utility_sql('target')}",
    "keyword_score": f"SELECT doc_id, {_hits_sql('text')} AS hits, {_found_sql('text')} AS n_found FROM documents",
    "page_topic_score": f"SELECT page_id, greatest({_hits_sql('text')} + 2 * {_found_sql('title')} + 2 * {_found_sql(_SPACED.format('url'))} + {_COVER} - CASE WHEN {_utility_sql('url')} THEN 4 ELSE 0 END - CASE WHEN {_UTILITY_TITLE} THEN 4 ELSE 0 END, 0) AS score FROM {_PAGE_SQL}",
    "link_priority_score": f"SELECT page_id, CAST(pos AS INTEGER) AS pos, {_PRIORITY} AS score FROM {_LINKS_SQL}",
    "per_group_first_n": f"SELECT page_id, CAST(pos AS INTEGER) AS pos, target, 1 AS depth FROM {_FIRST_SQL} WHERE NOT {_utility_sql('target')} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 3",
    "added_terms": "SELECT original, expanded, array_to_string(list_filter(string_split(expanded, ' '), lambda w: NOT list_contains(string_split(lower(original), ' '), w)), ' ') AS added FROM (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in EXPANDED)
    + ") v(original, expanded)",
    "crawl_round": f"WITH {_KEPT_SQL} SELECT 99 + row_number() OVER (ORDER BY page_id) AS doc_id, url, length(text) AS n_chars, 0 AS depth FROM k",
    "crawled_pages": f"WITH {_KEPT_SQL} SELECT row_number() OVER (ORDER BY page_id) AS doc_id, url, length(text) AS n_chars FROM k",
    "crawled_state": f"""WITH {_KEPT_SQL}, c AS (SELECT count(*) AS attempted, count_if(coalesce(stop, '') <> 'status') AS fetched_ok, count_if(coalesce(stop, '') <> 'status') AS parsed, count_if(coalesce(stop, '') NOT IN ('status', 'length')) AS long_enough, count_if(stop = 'utility') AS filtered_utility,
count_if(stop = 'topic') AS filtered_topic, count_if(stop IS NULL) AS kept_after_quality, (SELECT count(*) FROM k) AS kept_after_dedup, count_if(stop IS NULL) - (SELECT count(*) FROM k) AS duplicates_content, (SELECT count(*) FROM k) AS final_usable,
count(*) AS known, (SELECT count(*) FROM k) AS hashes, CAST(ceil(count(*) / greatest(100, count(*) // 3)) AS BIGINT) AS batches FROM t) SELECT name, CAST(n AS BIGINT) AS n FROM (UNPIVOT (SELECT COLUMNS(*)::BIGINT FROM c) ON COLUMNS(*) INTO NAME name VALUE n)""",
    "quality_funnel": f"""WITH {_JUDGED} SELECT count(*) AS attempted, CAST(count_if(coalesce(stop, '') <> 'status') AS BIGINT) AS fetched_ok, CAST(count_if(coalesce(stop, '') NOT IN ('status', 'html')) AS BIGINT) AS parsed, CAST(count_if(coalesce(stop, '') NOT IN ('status', 'html', 'length')) AS BIGINT) AS long_enough,
CAST(count_if(stop = 'utility') AS BIGINT) AS filtered_utility, CAST(count_if(stop = 'topic') AS BIGINT) AS filtered_topic, CAST(count_if(stop IS NULL) AS BIGINT) AS kept_after_quality, (SELECT count(*) FROM k) AS kept_after_dedup, CAST(count_if(stop IS NULL) AS BIGINT) - (SELECT count(*) FROM k) AS duplicates_content, (SELECT count(*) FROM k) AS final_usable FROM j""",
    "stop_counts": f"WITH {_JUDGED} SELECT coalesce(stop, 'kept') AS stop, count(*) AS pages FROM j GROUP BY 1",
    "stop_cube": f"WITH {_JUDGED}, c AS (SELECT lang, source, coalesce(stop, 'kept') AS stop FROM j) SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(stop, '') AS stop, GROUPING_ID(lang, source, stop) AS level, count(*) AS pages FROM c GROUP BY CUBE (lang, source, stop)",
    "sequential_ids": f"WITH {_JUDGED} SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS new_id, text FROM k JOIN j USING (doc_id)",
    "frontier_priority_topk": f"""WITH c AS (SELECT target AS url, {_PRIORITY} AS score, page_id * 100000 + pos AS seq FROM {_LINKS_SQL} WHERE target <> ''), f AS (SELECT *, CASE WHEN score >= 8 THEN 'high' ELSE 'normal' END AS queue FROM c QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)
SELECT url, score, queue, seq FROM f ORDER BY queue <> 'high', seq LIMIT 200""",
    "robots_gate": "SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^https?://[^/?#]+/en/')",
    "html_parse": f"SELECT x.page_id, title, CAST(length(text) AS INTEGER) AS n_chars, CAST(coalesce(n, 0) AS INTEGER) AS n_links, sha256(text) AS content_hash FROM {_PAGE_SQL} x LEFT JOIN (SELECT page_id, count(*) AS n FROM {_FIRST_SQL} GROUP BY page_id) l ON l.page_id = x.page_id",
    "http_urls": "SELECT page_id, page_id % 7 <> 0 AND regexp_matches(lower(url), '^https?:') AS web FROM pages",
    "page_addresses": f"SELECT url, page_id AS doc_id FROM {_ADDRESS_SQL.format('SELECT page_id, 1, ' + _normalize_sql('url') + ' FROM pages')}",
    "page_graph_edges": f"SELECT DISTINCT e.page_id AS src, a.page_id AS dst FROM {_FIRST_SQL} e JOIN {_ADDRESS_SQL.format(_ENDS_SQL)} a ON a.url = e.target WHERE NOT {_utility_sql('target')} AND e.page_id <> a.page_id",
    "host_turns": f"SELECT page_id, 2.0::DOUBLE * (row_number() OVER (PARTITION BY lower(regexp_extract(url, '{_PART}', 1)), lower(regexp_extract(url, '{_PART}', 2)) ORDER BY page_id) - 1) AS wait FROM pages",
    "frontier_unseen": f"""WITH f AS (SELECT target AS url, page_id AS discovered_from, page_id * 100000 + pos AS seq FROM {_LINKS_SQL} WHERE target <> ''), known AS (SELECT {_normalize_sql('url')} AS url FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0)
SELECT * FROM f WHERE url NOT IN (SELECT url FROM known) QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1""",
}
