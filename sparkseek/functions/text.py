"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, durable
from .lexicon import STOP_WORDS, TOPIC_KEYWORDS, UTILITY_TITLES_CRAWL
from .stemmer import stem_words

TOKEN = "[a-z0-9]+"


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def remove_stop_words(tokens: Column) -> Column:
    """Tokens in order, repeats kept, without stop words."""
    return F.filter(tokens, lambda x: ~x.isin(STOP_WORDS))


def safe_text(text: Column) -> Column:
    """White space squashed to single blanks, ends trimmed; null is empty."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), F.lit(" "))


def clean_text(text: Column) -> Column:
    return safe_text(F.lower(text))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def keyword_hits(text: Column, keywords: list[str] | None = None, cap: int = 3) -> tuple[Column, Column]:
    """Sum of each keyword's occurrences up to `cap`, and the keywords that occur."""
    text = F.lower(F.coalesce(text, F.lit("")))
    counts = [(k, F.regexp_count(text, F.lit(rf"\b{k}\b"))) for k in (keywords or TOPIC_KEYWORDS)]
    total = sum((F.least(n, F.lit(cap)) for _, n in counts), F.lit(0))
    found = F.array_compact(F.array(*[F.when(n > 0, F.lit(k)) for k, n in counts]))
    return total, found


def _spaced(url: Column) -> Column:
    return F.translate(F.coalesce(url, F.lit("")), "-_", "  ")


def is_utility_title(title: Column, phrases: list[str] | None = None) -> Column:
    return safe_text(F.lower(title)).rlike("|".join(phrases or UTILITY_TITLES_CRAWL))


def topic_score(title: Column, text: Column, url: Column, keywords: list[str] | None = None) -> Column:
    """Hits in the text (three a keyword at most), twice the keywords of title and of URL, and all keywords
    found; less 4 each for a utility URL and title; 0 at least."""
    from .urls import is_utility_url

    hits, in_text = keyword_hits(text, keywords, 3)
    _, in_title = keyword_hits(title, keywords, 2)
    _, in_url = keyword_hits(_spaced(url), keywords, 2)
    score = hits + 2 * F.size(in_title) + 2 * F.size(in_url) + F.size(F.array_union(F.array_union(in_text, in_title), in_url))
    score = score - F.when(is_utility_url(url), 4).otherwise(0) - F.when(is_utility_title(title), 4).otherwise(0)
    return F.greatest(score, F.lit(0))


def link_priority(parent_score: Column, anchor: Column, url: Column, keywords: list[str] | None = None) -> Column:
    """Parent's score up to 10, twice the anchor's keywords and the URL's once; less 5 for a utility URL; 0 at least."""
    from .urls import is_utility_url

    _, in_anchor = keyword_hits(anchor, keywords, 2)
    _, in_url = keyword_hits(_spaced(url), keywords, 2)
    score = F.least(parent_score, F.lit(10)) + 2 * F.size(in_anchor) + F.size(in_url) - F.when(is_utility_url(url), 5).otherwise(0)
    return F.greatest(score, F.lit(0))


def added_terms(original: str, expanded: str) -> list[str]:
    """Words of the expanded query that the original lacks, in order, repeats kept."""
    known = set(original.lower().split())
    return [w for w in expanded.split() if w not in known]


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def search_url(query: Column, engine: str) -> Column:
    """Redirect address of an outside search."""
    return F.concat(F.lit({"google": "https://www.google.com/search?q=", "bing": "https://www.bing.com/search?q="}[engine]), F.url_encode(query))


def words_of(docs: DataFrame, key: str, text: str, analyzer: str = "full") -> DataFrame:
    """key, term: a row for each token that the analyzer looks at."""
    if analyzer not in ("raw", "full"):
        raise ValueError(f"unknown analyzer {analyzer!r}")
    rows = docs.select(key, F.explode(tokenize(F.col(text))).alias("term"))
    return rows if analyzer == "raw" else rows.filter(~F.col("term").isin(STOP_WORDS))


def analyzed(docs: DataFrame, key: str, text: str, analyzer: str = "full") -> DataFrame:
    """key, term: a row for each term occurrence of a few texts. `raw`: tokens; `full`: stop words removed, stemmed."""
    rows = words_of(docs, key, text, analyzer)
    return rows if analyzer == "raw" else rows.join(stem_words(rows), "term").select(key, F.col("stem").alias("term"))


def term_counts(docs: DataFrame, key: str, text: str, analyzer: str = "full") -> DataFrame:
    """term, key, tf.

    The stems of the distinct words are written once. If they are few enough to be broadcast, words become stems
    where the text is read, and one exchange counts them; a query's semi-join then leaves only the words that have
    its stems. Else words are counted before they meet their stems, so that no frequent word is a hot key.
    """
    rows = words_of(docs, key, text, analyzer)
    if analyzer == "raw":
        return rows.groupBy("term", key).agg(F.count("*").alias("tf"))
    stems = durable(stem_words(rows, vocabulary=True))
    if stems.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(stems), "term").groupBy(F.col("stem").alias("term"), key).agg(F.count("*").alias("tf"))
    counted = rows.groupBy("term", key).agg(F.count("*").alias("n")).join(stems, "term")
    return counted.groupBy(F.col("stem").alias("term"), key).agg(F.sum("n").alias("tf"))
