"""Porter's stemmer as a chain of regular-expression rules, rendered for Spark columns or as SQL.

A step is a list of (test, match, replacement): the first rule whose test is found applies, and its
replacement happens only where `match` is found too. No rule needs a back-reference inside a pattern, so the
same rules run on Java's and on RE2's regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import IRREGULAR

_HEAD = "(?:[^aeiou][^aeiouy]*)?"
_V, _C = "[aeiouy][aeiou]*", "[^aeiou][^aeiouy]*"
_M0 = f"{_HEAD}{_V}[^aeiou].*"
_M1 = f"{_HEAD}{_V}{_C}{_V}[^aeiou].*"
_SHORT = "[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]"
_SHORT_TWO = "[aeiou][^aeiou]"

Rule = tuple[str, str, str]


def _suffixes(pairs: str, measure: str) -> list[Rule]:
    """`from>to` pairs by the order of their suffixes' length, longest first."""
    rules = [p.partition(">")[::2] for p in pairs.split()]
    return [(f"{old}$", f"^({measure}){old}$", f"$1{new}") for old, new in sorted(rules, key=lambda r: -len(r[0]))]


STEPS: list[list[Rule]] = [
    [("sses$", "sses$", "ss"), ("^.ies$", "ies$", "ie"), ("ies$", "ies$", "i"), ("ss$", "ss$", "ss"), ("s$", "s$", "")],
    [("^.ied$", "ied$", "ie"), ("ied$", "ied$", "i"), ("eed$", f"^({_M0})eed$", "$1ee"), ("(ed|ing)$", f"^({_HEAD}[aeiouy].*?)(?:ed|ing)$", "$1#")],
    [("(at|bl|iz)#$", "#$", "e"), *((f"{c}{c}#$", f"{c}#$", "") for c in "bcdfghjkmnpqrtvwx"), (f"^({_SHORT}|{_SHORT_TWO})#$", "#$", "e"), ("#$", "#$", "")],
    [("y$", "^(.+[^aeiouy])y$", "$1i")],
    [("alli$", f"^({_M0})alli$", "$1al")],
    [
        *_suffixes("ational>ate tional>tion enci>ence anci>ance izer>ize bli>ble entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble fulli>ful", _M0),
        # The l of -logi counts towards the stem's measure.
        ("logi$", f"^({_HEAD}{_V}(?:[^aeiou].*)?l)ogi$", "$1og"),
    ],
    _suffixes("icate>ic ative> alize>al iciti>ic ical>ic ful> ness>", _M0),
    [*_suffixes("al> ance> ence> er> ic> able> ible> ant> ement> ment> ent> ou> ism> ate> iti> ous> ive> ize>", _M1), ("ion$", f"^({_HEAD}{_V}{_C}{_V}.*[st])ion$", "$1")],
    [(f"^{_M1}e$", "e$", ""), (f"^({_SHORT}|{_SHORT_TWO})e$", "^$", ""), (f"^{_M0}e$", "e$", "")],
    [("ll$", f"^({_HEAD}{_V}{_C}{_V}.*l)l$", "$1")],
]

def stem(word: Column) -> Column:
    """The stem of a lower-case word.

    Each step is the body of a lambda over a one-word array: it names its input once, so the chain grows with
    its rules, however the optimizer moves it.
    """
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    out = F.array(word)
    for step in STEPS:
        out = F.transform(out, _applying(step))
    return F.coalesce(F.try_element_at(irregular, word), F.when(F.length(word) <= 2, word).otherwise(F.get(out, F.lit(0))))


def _applying(step: list[Rule]) -> Callable[[Column], Column]:
    def applied(word: Column) -> Column:
        # Most words end in no suffix of a step: one test tells.
        chain = F.when(~word.rlike("|".join(test for test, _, _ in step)), word)
        for test, match, new in step:
            chain = chain.when(word.rlike(test), F.regexp_replace(word, match, new))
        return chain.otherwise(word)

    return applied


def stem_words(words: DataFrame, column: str = "term", vocabulary: bool = False) -> DataFrame:
    """The distinct words with their stems.

    The stem is made from an aggregate of the word, not from the grouping key: otherwise the optimizer moves
    joins on the stem below the grouping and computes it for every occurrence. The words of a corpus (`vocabulary`)
    are dealt to all cores: they are few bytes but much work, and would else be coalesced into a task or two.
    """
    rows = words.groupBy(column).agg(F.max(column).alias("_w"))
    rows = rows.repartition(words.sparkSession.sparkContext.defaultParallelism, "_w") if vocabulary else rows
    return rows.select(column, stem(F.col("_w")).alias("stem"))


def stem_sql(source: str, column: str) -> str:
    """SQL of stem_words over the distinct values of `column` in `source`."""
    query = f"SELECT DISTINCT {column}, {column} AS s FROM {source}"
    for step in STEPS:
        cases = " ".join(f"WHEN regexp_matches(s, '{test}') THEN regexp_replace(s, '{match}', '{new.replace('$1', chr(92) + '1')}')" for test, match, new in step)
        query = f"SELECT {column}, CASE {cases} ELSE s END AS s FROM ({query})"
    cases = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in IRREGULAR.items())
    return f"SELECT {column}, coalesce(CASE {column} {cases} END, CASE WHEN length({column}) <= 2 THEN {column} ELSE s END) AS stem FROM ({query})"
