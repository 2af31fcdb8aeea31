"""Toxicity by a counterfactually regularised linear classifier.

A text's features are its words and their beginnings, each once, hashed to BITS bits; the model has the CHOSEN ones that
differ most between the labels in the sample, of those in SEEN of its texts or more. A logistic regression is trained in numpy on a
bounded, hashed sample of labelled documents. Identity terms in labelled sentences are swapped for others of
their kind, and the square of each such change of the score is a penalty: a mention of a group by itself then
moves the score hardly at all, whatever the sample says of it. Workers take the features of the sample's whole texts
and what each swap takes away and brings; equal changes are counted together, so the driver gets few of them.

Edge cases: null and empty texts score as a text without features (0.1 without labelled rows); null labels are
not learned from; several labels of a document each count; repeated rows and further columns stay; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, crc_mod, durable, slices, word_prefix_hashes
from .quality import labelled

#: At most so many labelled rows are learned from, in near-equal numbers of either label.
LEARN = 6000
#: Lengths in bytes of the words' beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
BITS, CHOSEN, SEEN = 20, 4000, 4
DECAY, SWAPS, ROUNDS, RATE = 2e-3, 5.0, 300, 0.05
#: Share of toxic texts that scores are set to, and the score from which a text is predicted toxic.
SHARE, CUT = 0.2, 0.3
CHARS = 1 << 19
#: Identity terms by kind. A term is swapped for the others of its kind.
IDENTITY = {
    "gender": ["women", "men", "girls", "boys", "transgender"],
    "person": ["woman", "man", "girl", "boy"],
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    "believers": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "queer"],
    "origin": ["african", "asian", "european", "mexican", "american", "arab", "chinese", "indian"],
    "colour": ["black", "white", "latino"],
    "age": ["old", "young", "elderly"],
    "ability": ["disabled", "blind", "deaf"],
}
_OTHERS = {term: [x for x in kind if x != term] for kind in IDENTITY.values() for term in kind}
_TERM = re.compile(r"\b(" + "|".join(sorted(_OTHERS, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hashed feature of every word and beginning of all texts, repeats included."""
    hashes, number = word_prefix_hashes(texts, BEGINNINGS)
    owner = np.repeat(np.arange(len(texts)), number)
    return np.tile(owner, len(hashes)), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def once(owner: np.ndarray, feature: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(owner * width + feature)
    return pairs // width, pairs % width


def swapped(sentence: str) -> list[str]:
    """The sentence with each of its identity terms swapped, once for every other term of the first one's kind."""
    first = _TERM.search(sentence)
    if not first:
        return []
    count = len(_OTHERS[first[0].lower()])
    return [_TERM.sub(lambda m, i=i: _OTHERS[m[0].lower()][i % len(_OTHERS[m[0].lower()])], sentence) for i in range(count)]


def changes(texts: list[str]) -> Counter:
    """How often a swap in a sentence of the texts takes away some features and brings others (two tuples)."""
    pairs = [(s, v) for t in texts for s in re.split(r"[.!?\n]+", t) if _TERM.search(s) for v in swapped(s)]
    found: Counter = Counter()
    for part in slices([len(s) + len(v) for s, v in pairs], CHARS):
        own = pairs[part]
        owner, feature = once(*features([s for pair in own for s in pair]), 1 << BITS)
        cuts = np.searchsorted(owner, np.arange(2 * len(own) + 1))
        for i in range(0, 2 * len(own), 2):
            before, after = feature[cuts[i] : cuts[i + 1]], feature[cuts[i + 1] : cuts[i + 2]]
            found[tuple(np.setdiff1d(before, after).tolist()), tuple(np.setdiff1d(after, before).tolist())] += 1
    return found


def features_once(texts: list[str]) -> list[np.ndarray]:
    """The features of each text."""
    out: list = []
    for part in slices([len(t) for t in texts], CHARS):
        owner, feature = once(*features(texts[part]), 1 << BITS)
        out += np.split(feature, np.searchsorted(owner, np.arange(1, len(texts[part])))) if len(texts[part]) else []
    return out


def best_of(ones: np.ndarray, total: np.ndarray, share: float, moved: Counter) -> np.ndarray:
    """The CHOSEN features that tell most, of those in SEEN texts or more; then those that swaps move, if there is room."""
    score = np.abs(ones - total * share) / np.sqrt(np.maximum(total, 1) * share * (1 - share))
    score[total < SEEN] = 0
    score[np.array([x for lost, new in moved for x in (*lost, *new)], np.int64)] += 1e-9
    best = np.argsort(-score, kind="stable")[:CHOSEN]
    return best[score[best] > 0]


class Classifier:
    """rows: features of each text; moved: what swaps take away and bring, and how often; best: what `best_of` gives, else made here."""

    def __init__(self, rows: list[np.ndarray], labels: list[int], moved: Counter, best: np.ndarray | None = None):
        y = np.array(labels, np.float64)
        self.chosen, self.weights, self.base = np.full(1 << BITS, -1, np.int16), np.zeros(0), float(np.log(0.1 / 0.9))
        if not len(y) or y.min() == y.max():
            return
        owner, feature = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        share = y.mean()
        if best is None:
            best = best_of(np.bincount(feature, y[owner], 1 << BITS), np.bincount(feature, minlength=1 << BITS), share, moved)
        kinds = sorted(moved)
        swap = np.repeat(np.arange(len(kinds)), [len(lost) + len(new) for lost, new in kinds])
        column = np.array([x for lost, new in kinds for x in (*lost, *new)], np.int64)
        sign = np.array([v for lost, new in kinds for v in (*[-1.0] * len(lost), *[1.0] * len(new))])
        often = np.array([moved[k] for k in kinds], np.float64)
        self.chosen[best] = np.arange(len(best))
        known = self.chosen[feature] >= 0
        owner, feature = owner[known], self.chosen[feature[known]].astype(np.int64)
        column = self.chosen[column].astype(np.int64)
        swap, sign, column = swap[column >= 0], sign[column >= 0], column[column >= 0]
        w, b, m, v = np.zeros(len(best)), 0.0, np.zeros(len(best) + 1), np.zeros(len(best) + 1)
        for step in range(1, ROUNDS + 1):
            z = b + np.bincount(owner, w[feature], len(y))
            error = (1 / (1 + np.exp(-z)) - y) / len(y)
            gradient = np.bincount(feature, error[owner], len(w)) + DECAY * w
            if len(kinds):
                change = often * np.bincount(swap, sign * w[column], len(kinds))
                gradient += SWAPS * 2 / often.sum() * np.bincount(column, sign * change[swap], len(w))
            gradient = np.append(gradient, error.sum())
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient * gradient - v)
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        self.weights, self.base = w, float(b + np.log(SHARE / (1 - SHARE)) - np.log(share / (1 - share)))

    def score(self, texts: list[str]) -> np.ndarray:
        owner, feature = features(texts)
        at = self.chosen[feature]
        known = at >= 0
        total = np.full(len(texts), self.base)
        if known.any():
            owner, at = once(owner[known], at[known].astype(np.int64), CHOSEN)
            total += np.bincount(owner, self.weights[at], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def held_out():
    return crc_mod("doc_id", 4) == 2


def _learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        none = [None] * len(texts)
        own = [f.astype(np.int32) for f in features_once(texts)]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "_y": batch["_y"].astype("Int64"), "own": own, "lost": none, "new": none, "n": pd.array(none, "Int64")})
        moved = [(np.array(x, np.int32).tobytes(), np.array(y, np.int32).tobytes(), n) for (x, y), n in changes(texts).items()]
        if moved:
            yield pd.DataFrame(moved, columns=["lost", "new", "n"]).assign(doc_id=pd.NA, _y=pd.NA, own=None)


def train(docs: DataFrame, labels: DataFrame, limit: int = LEARN) -> Classifier:
    """Learn from at most `limit` labelled rows; workers read their whole texts.

    Workers also count the features, of which there are 2**BITS at most, and leave the chosen ones of each text: the
    driver gets three numbers a feature and then two bytes a text and chosen feature, however long the texts are.
    """
    rows = labelled(docs, labels, "toxic", limit)
    rows = durable(rows.mapInPandas(_learned, "doc_id long, _y long, own array<int>, lost binary, new binary, n long"))
    texts = rows.filter("own IS NOT NULL").withColumn("_h", F.xxhash64("doc_id", "_y", "own"))
    # Rows that repeat an id can be more than the limit; a hash decides which are learned from.
    last = texts.select("_h").orderBy("_h").limit(limit).agg(F.max("_h")).first()[0]
    texts = texts.filter(F.col("_h") <= F.lit(last))
    moved = rows.filter("own IS NULL").groupBy("lost", "new").agg(F.sum("n").alias("n")).collect()
    plain = lambda x: tuple(np.frombuffer(x, np.int32).tolist())
    moved = Counter({(plain(r["lost"]), plain(r["new"])): r["n"] for r in moved})
    counts = texts.select("_y", F.explode("own").alias("f")).groupBy("f").agg(F.sum("_y").alias("ones"), F.count("*").alias("total")).filter(F.col("total") >= SEEN).toPandas()
    ones, total = np.zeros(1 << BITS), np.zeros(1 << BITS, np.int64)
    ones[counts["f"]], total[counts["f"]] = counts["ones"], counts["total"]
    share = texts.agg(F.avg("_y")).first()[0]
    best = best_of(ones, total, share, moved) if share and share < 1 else np.zeros(0, np.int64)
    place = np.full(1 << BITS, -1, np.int16)
    place[best] = np.arange(len(best))

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = [place[np.asarray(x, np.int64)] for x in batch["own"]]
            yield pd.DataFrame({"_h": batch["_h"], "_y": batch["_y"], "at": [x[x >= 0].tobytes() for x in at]})

    found = texts.select("_h", "_y", "own").mapInPandas(chosen, "_h long, _y long, at binary").orderBy("_h", "_y").collect()
    return Classifier([best[np.frombuffer(r["at"], np.int16)] for r in found], [r["_y"] for r in found], moved, best)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learned from labels of rows that are not held out."""
    spark = docs.sparkSession
    arrow_limits(spark)
    model = spark.sparkContext.broadcast(vars(train(docs, labels.filter(~held_out()))))

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Classifier.__new__(Classifier)
        vars(own).update(model.value)
        for texts in batches:
            texts = texts.fillna("").tolist()
            found = [own.score(texts[p]) for p in slices([len(t) for t in texts], CHARS)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    score = F.pandas_udf(judge, "double")
    out = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
