"""Language identification by a byte convolutional network.

One-hot UTF-8 bytes of the lower-cased text go through filters of several widths, a maximum over each
fixed-length window, and a softmax. The network is trained in numpy on windows of a bounded, hashed sample of
labelled documents. A whole text is cut into windows that overlap by the widest filter less one byte, so no
byte sequence is lost, and windows of many texts are scored as one batch; a text's probabilities are its
windows' means, weighted by their letters.

A filter of width w adds w table rows, one for each byte; tables for pairs of bytes halve that work.

Edge cases: null texts and texts without a letter are `und` with score 0; so are all texts when no labelled row
is learnable; unlabelled rows are not learned from; repeated rows and further columns stay; ties go to the
first language by name; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, bounded_sample, crc_mod, slices, window_of

WINDOW = 512
WIDTHS, FILTERS = (2, 3, 4), 16
OVERLAP = max(WIDTHS) - 1
#: At most so many labelled documents are learned from, in near-equal numbers of each language.
LEARN = 2000
EPOCHS, BATCH, RATE, DECAY = 14, 64, 0.01, 1e-4
#: Bytes of text that are scored at once.
BYTES = 1 << 19
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
_IS_LETTER = np.zeros(256, np.float32)
_IS_LETTER[[*range(97, 123), *range(128, 256)]] = 1


def windows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts as rows of WINDOW + OVERLAP bytes, and the number of each text's windows."""
    counts = np.array([max(1, -(-len(x) // WINDOW)) for x in data])
    starts = np.cumsum(counts) - counts
    out = np.full((int(counts.sum()), WINDOW + OVERLAP), 32, np.uint8)
    for x, at, n in zip(data, starts, counts, strict=True):
        own = np.full(n * WINDOW + OVERLAP, 32, np.uint8)
        own[: len(x)] = np.frombuffer(x, np.uint8)
        out[at : at + n, :WINDOW] = own[: n * WINDOW].reshape(n, WINDOW)
        out[at : at + n - 1, WINDOW:] = out[at + 1 : at + n, :OVERLAP]
    return out, counts


class Network:
    """tables[w][j]: 256 x FILTERS, what byte j of a width-w filter adds; out: pooled features to languages."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.last = np.zeros(len(languages), np.float32)

    def fit(self, rows: np.ndarray, target: np.ndarray, seed: int = 11) -> Network:
        """Adam on cross-entropy; through the maximum only the winning places of each filter get gradients."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, *self.bias, self.out, self.last]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                x, y = rows[pick], target[pick]
                pooled, wins = [], []
                for w, table, bias in zip(WIDTHS, self.tables, self.bias, strict=True):
                    total = np.take(table[0], x[:, :WINDOW], axis=0)
                    for j in range(1, w):
                        total += np.take(table[j], x[:, j : j + WINDOW], axis=0)
                    place = total.argmax(1)
                    pooled.append(np.take_along_axis(total, place[:, None], 1)[:, 0] + bias)
                    wins.append(place)
                features = np.concatenate(pooled, 1)
                active = features > 0
                features = features * active
                logits = features @ self.out + self.last
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.out.T) * active
                grads = []
                for k, (w, place) in enumerate(zip(WIDTHS, wins, strict=True)):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    grad = np.zeros((w, 256, FILTERS), np.float32)
                    cols = np.broadcast_to(np.arange(FILTERS), place.shape)
                    for j in range(w):
                        np.add.at(grad[j], (np.take_along_axis(x, place + j, 1), cols), g)
                    grads.append(grad)
                grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
                grads += [features.T @ p, p.sum(0)]
                step += 1
                for v, g, m, s in zip(params, grads, first, second, strict=True):
                    g = g + DECAY * v
                    m *= 0.9
                    m += 0.1 * g
                    s *= 0.999
                    s += 0.001 * g * g
                    v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def pairs(self) -> list[list[np.ndarray]]:
        """For each width the tables of byte pairs (65,536 rows), and of a last single byte."""
        found = []
        for table in self.tables:
            own = [(table[j][:, None, :] + table[j + 1][None, :, :]).reshape(-1, FILTERS) for j in range(0, len(table) - 1, 2)]
            found.append(own + ([table[-1]] if len(table) % 2 else []))
        return found

    def probabilities(self, rows: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        """Of each window; places are the outer axis, so that the maximum runs over whole vectors."""
        x = np.ascontiguousarray(rows.T).astype(np.int32)
        two = (x[:-1] << 8) + x[1:]
        pooled = np.empty((len(rows), len(WIDTHS) * FILTERS), np.float32)
        for k, (w, tables) in enumerate(zip(WIDTHS, pairs, strict=True)):
            best = None
            for at in range(0, WINDOW, 64):
                total = np.take(tables[0], two[at : at + 64], axis=0)
                for n, table in enumerate(tables[1:], 1):
                    total += np.take(table, (two if 2 * n + 1 < w else x)[at + 2 * n : at + 2 * n + 64], axis=0)
                top = total.max(0)
                best = top if best is None else np.maximum(best, top)
            pooled[:, k * FILTERS : (k + 1) * FILTERS] = best + self.bias[k]
        logits = np.maximum(pooled, 0) @ self.out + self.last
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def score(self, texts: list[str], pairs: list[list[np.ndarray]]) -> np.ndarray:
        """Probabilities of each text."""
        rows, counts = windows([t.lower().encode("utf-8", "replace") for t in texts])
        weight = _IS_LETTER[rows].sum(1) + 1e-3
        ends = np.cumsum(counts) - counts
        total = np.concatenate([self.probabilities(rows[i : i + 1024], pairs) for i in range(0, len(rows), 1024)])
        return np.add.reduceat(total * weight[:, None], ends, axis=0) / np.add.reduceat(weight, ends)[:, None]


def train(docs: DataFrame, limit: int = LEARN) -> Network:
    """Learn from text and lang of at most `limit` labelled rows of `docs`."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = bounded_sample(rows.select("doc_id", "lang", "text"), "doc_id", limit, "lang").select("lang", window_of("text", "doc_id", WINDOW).alias("text"))
    rows = sorted((r["lang"], r["text"]) for r in rows.collect() if LETTER.search(r["text"]))
    languages = sorted({lang for lang, _ in rows})
    network = Network(languages)
    if len(languages) > 1:
        x = np.stack([windows([t.lower().encode("utf-8", "replace")])[0][0] for _, t in rows])
        network.fit(x, np.array([languages.index(lang) for lang, _ in rows]))
    return network


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """The rows with lang_pred and score; given columns of these names are replaced."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(vars(network))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = Network.__new__(Network)
        vars(net).update(shared.value)
        pairs = net.pairs()
        for texts in batches:
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if net.languages else []
            own = [texts.iloc[i] for i in known]
            for part in slices([len(t) for t in own], BYTES):
                p = net.score(own[part], pairs)
                best = p.argmax(1)
                lang[known[part]] = np.array(net.languages, object)[best]
                score[known[part]] = np.clip(p[np.arange(len(best)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    apply = F.pandas_udf(scored, "lang_pred string, score double")
    out = docs.withColumn("_language", apply("text"))
    return out.withColumns({"lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")}).drop("_language")


def held_out():
    return crc_mod("doc_id", 4) == 2


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out."""
    network = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), network).drop("text")


def accepted(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Documents whose language is known with a score of `least` or more; all columns stay as they are."""
    network = train(docs.filter(~held_out()))
    judged = predict(docs.select(F.struct("*").alias("_row"), "text"), network)
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")
