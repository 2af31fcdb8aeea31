"""URL functions. Predicates are column expressions; normalisation against a base is an Arrow-batched UDF."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicon import TRACKING_PARAMS, TRACKING_PREFIX, UTILITY_TITLES_INDEX, UTILITY_WORDS

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def normalized(url: str | None, base: str | None = None) -> str | None:
    """The canonical form of an http(s) URL; empty if it is none; None where a port or a base is malformed."""
    text = (url or "").strip()
    if not text:
        return ""
    try:
        text = urljoin(base, text) if base else text
    except ValueError:
        return None
    try:
        parts = urlsplit(text)
        host = (parts.hostname or "").lower()
    except ValueError:
        return ""
    scheme = parts.scheme.lower() or ("http" if parts.netloc else "")
    if scheme not in ("http", "https") or not host:
        return ""
    try:
        port = parts.port
    except ValueError:
        return None
    if port and port != {"http": 80, "https": 443}[scheme]:
        host = f"{host}:{port}"
    path = posixpath.normpath(parts.path or "/")
    path = path if path.startswith("/") else f"/{path}"
    path = path[:-1] if path != "/" and path.endswith("/") else path
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith(TRACKING_PREFIX) and k.lower() not in TRACKING_PARAMS]
    return urlunsplit((scheme, host, path, urlencode(sorted(kept, key=lambda x: (x[0].lower(), x[1])), doseq=True), ""))


@F.pandas_udf(StringType())
def _normalize(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([normalized(u, b) for u, b in zip(url, base, strict=True)], dtype=object)


def normalize_url(url: Column, base: Column | None = None) -> Column:
    return _normalize(url, F.lit(None).cast("string") if base is None else base)


def simple_normalize(url: Column) -> Column:
    """The same for absolute URLs without dot segments or escapes in the query, within code generation."""
    text = F.btrim(F.coalesce(url, F.lit("")))
    part = lambda n: F.regexp_extract(text, _PARTS, n)
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(F.regexp_replace(part(2), r"^[^@]*@", "")), ":$", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_replace(part(3), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "(?<=.)/{2,}", "/"))
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^{TRACKING_PREFIX}|^({'|'.join(TRACKING_PARAMS)})(=|$)"))
    pairs = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    keyed = F.transform(pairs, lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v"), p.alias("p")))
    query = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    good = scheme.isin("http", "https") & (host != "")
    return F.when(good, F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))).otherwise(F.lit(""))


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?:"), F.lit(False))


def extract_domain(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)
    return F.lower(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":\d*$", ""))


def origin(url: Column) -> Column:
    """scheme://netloc, http where there is no scheme: the key of a robots file."""
    part = lambda n: F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, n))
    return F.concat(F.when(part(1) == "", "http").otherwise(part(1)), F.lit("://"), part(2))


def is_utility_url(url: Column) -> Column:
    """Whether a whole word of the path or the query is a utility word."""
    text = F.lower(F.coalesce(url, F.lit("")))
    tokens = F.concat(F.split(F.regexp_extract(text, _PARTS, 3), r"[/\-_.]+"), F.split(F.regexp_extract(text, _PARTS, 4), r"[=&\-_.]+"))
    return F.arrays_overlap(tokens, F.lit(UTILITY_WORDS))


def is_utility_page(url: Column, final_url: Column, title: Column) -> Column:
    """Of an indexed page: by its final URL, or by a phrase anywhere in its title."""
    return is_utility_url(F.coalesce(F.nullif(final_url, F.lit("")), url)) | F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(map(re.escape, UTILITY_TITLES_INDEX)))


def url_map(pages: DataFrame, order: str = "doc_id") -> DataFrame:
    """url, doc_id: the last page (by `order`) that has the URL as its url or final_url, final_url later."""
    rows = pages.select("doc_id", order, F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("url").alias("u")), F.struct(F.lit(1).alias("n"), F.col("final_url").alias("u")))).alias("x"))
    rows = rows.filter(F.coalesce(F.col("x.u"), F.lit("")) != "")
    return rows.groupBy(F.col("x.u").alias("url")).agg(F.max_by("doc_id", F.struct(order, "x.n")).alias("doc_id"))


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
