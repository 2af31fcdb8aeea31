"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are trigrams of character shapes (lower case, upper case, digit, blank, each mark by itself)
and terms for its shares of repeated words, capitals and marks in steps. A truncated singular value
decomposition of the weighted terms of a bounded, hashed sample of labelled, whole texts gives the latent space. The
sample's vectors and labels are broadcast; every document's vector is multiplied with all of them in exact
blocks, and the labels of the nearest ones are weighted by similarity.

Edge cases: null and empty texts have no terms and get the neutral score of the sample's share of label 1 (0.5
without labelled rows); null labels are not learned from; several labels of a document each count; repeated
rows and further columns stay; equal similarities count alike up to the order of the sample; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, bounded_sample, crc_mod, slices, word_hashes

#: At most so many labelled rows are learned from, in near-equal numbers of either label.
LEARN = 4096
TERMS, STEPS, LATENT = 2048, 12, 48
NEIGHBOURS, SHARPNESS = 31, 6
CUT = 0.3
#: Characters of text, and documents, that are scored at once.
CHARS, DOCS = 1 << 19, 256

_SHAPE = np.zeros(256, np.int64)
_SHAPE[97:123] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_SHAPE[32] = 4
_SHAPE[10] = 5
_SHAPE[128:] = 1
for _n, _byte in enumerate([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 6):
    _SHAPE[_byte] = _n
SHAPES = int(_SHAPE.max()) + 1
_HASH = np.random.default_rng(17).integers(0, TERMS, SHAPES**3)


def counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed trigrams (texts x TERMS), and one-of-STEPS terms of four shares (texts x 4 STEPS)."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\0\0".join(parts) + b"\0\0", np.uint8)
    shape = _SHAPE[data]
    codes = (shape[:-2] * SHAPES + shape[1:-1]) * SHAPES + shape[2:]
    length = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), length + 2)
    bins = owner[:-2] * TERMS + _HASH[codes]
    ends = np.cumsum(length + 2)
    for back in (2, 1):  # trigrams that start in the gap between two texts
        at = ends - back
        bins[at[at < len(bins)]] = -1
    trigrams = np.bincount(bins[bins >= 0], minlength=len(parts) * TERMS).reshape(len(parts), TERMS).astype(np.float32)
    words, number = word_hashes(texts)
    whose = np.repeat(np.arange(len(parts)), number)
    again = np.bincount(whose[1:][(words[1:] == words[:-1]) & (whose[1:] == whose[:-1])], minlength=len(parts)) if len(words) else np.zeros(len(parts))
    pair = np.unique(words ^ (whose.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1] if len(words) else np.zeros(0, int)
    distinct = np.bincount(whose[pair], minlength=len(parts))
    per = lambda mask: np.bincount(owner[mask], minlength=len(parts))
    letters = np.maximum(per((shape == 1) | (shape == 2)), 1)
    number = np.maximum(number, 1)
    shares = np.stack([again / number, np.sqrt(distinct / number), per(shape == 2) / letters, np.minimum(1, 4 * per(shape > 5) / np.maximum(length, 1))], 1)
    steps = np.zeros((len(parts), 4, STEPS), np.float32)
    place = np.minimum((shares * STEPS).astype(int), STEPS - 1)
    np.put_along_axis(steps, place[:, :, None], 1, 2)
    steps[length == 0] = 0
    return trigrams, steps.reshape(len(parts), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


class Voter:
    def __init__(self, trigrams: np.ndarray, steps: np.ndarray, labels: list[int], seed: int = 19):
        self.labels = np.array(labels, np.float32)
        self.neutral = float(self.labels.mean()) if len(labels) else 0.5
        if not len(labels):
            return
        self.weight = np.log((1 + len(labels)) / (1 + (trigrams > 0).sum(0))).astype(np.float32) + 1
        x = self.weighted(trigrams, steps)
        rng = np.random.default_rng(seed)
        q = np.linalg.qr(x @ rng.normal(size=(x.shape[1], LATENT + 16)).astype(np.float32))[0]
        for _ in range(4):
            q = np.linalg.qr(x @ (x.T @ q))[0]
        self.axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:LATENT].T.astype(np.float32).copy()
        self.vectors = unit(x @ self.axes).astype(np.float32)

    def weighted(self, trigrams: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return np.concatenate([unit(np.log1p(trigrams) * self.weight), 0.5 * steps], 1).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """Share of label 1 among the nearest sample vectors, weighted by similarity."""
        out = np.full(len(texts), self.neutral)
        if not len(self.labels):
            return out
        x = self.weighted(*counts_of(texts))
        some = np.flatnonzero(x.any(1))
        near = unit(x[some] @ self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1), 1e-6).astype(np.float64) ** SHARPNESS
        out[some] = (weight * self.labels[at]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """doc_id, _y, text of at most `limit` labelled rows (and the rows that repeat their ids)."""
    picked = bounded_sample(labels.filter(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_y")), "doc_id", limit, "_y")
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter(F.col("text").isNotNull()).select("doc_id", "_y", "text")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices([len(t) for t in batch["text"]], CHARS):
            own = batch.iloc[part]
            trigrams, steps = counts_of(own["text"].tolist())
            yield pd.DataFrame({"doc_id": own["doc_id"], "_y": own["_y"], "trigrams": [x.tobytes() for x in trigrams], "steps": [x.tobytes() for x in steps]})


def train(docs: DataFrame, labels: DataFrame, limit: int = LEARN) -> Voter:
    """Workers count the terms of the whole labelled texts; the driver gets at most `limit` rows of counts."""
    rows = labelled(docs, labels, "quality", limit).mapInPandas(_counted, "doc_id long, _y int, trigrams binary, steps binary")
    rows = rows.orderBy("doc_id", "_y", "trigrams", "steps").limit(limit).collect()
    trigrams, steps = (np.frombuffer(b"".join(r[c] for r in rows), np.float32).reshape(len(rows), -1) for c in ("trigrams", "steps")) if rows else (np.zeros((0, 1)),) * 2
    return Voter(trigrams, steps, [r["_y"] for r in rows])


def held_out():
    return crc_mod("doc_id", 5) == 0


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, learned from labels of rows that are not held out."""
    spark = docs.sparkSession
    arrow_limits(spark)
    voter = spark.sparkContext.broadcast(vars(train(docs, labels.filter(~held_out()))))

    def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Voter.__new__(Voter)
        vars(own).update(voter.value)
        for texts in batches:
            texts = texts.fillna("").tolist()
            found = [own.score(texts[i : i + DOCS][p]) for i in range(0, len(texts), DOCS) for p in slices([len(t) for t in texts[i : i + DOCS]], CHARS)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    score = F.pandas_udf(vote, "double")
    out = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
