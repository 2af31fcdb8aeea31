"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ARROW_BYTES, ARROW_ROWS, arrow_limits, drop_table, durable, placed, shared_folder, small

__all__ = ["ARROW_BYTES", "ARROW_ROWS", "arrow_limits", "drop_table", "durable", "placed", "shared_folder", "small"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of an id as text, modulo n; a null id counts as remainder of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, limit: int, by: str | None = None) -> DataFrame:
    """At most `limit` rows, by the order of a hash of `key`; with `by`, near-equal numbers of each value.

    Counts decide a hash threshold, for each value where there is a `by` (of which there may be any number), so no
    sort or group holds more than the sample; an exact top-`limit` by the hash ends it.
    """
    spread = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30))
    share = lambda rows, n: F.least(F.lit(1.0), 1.2 * F.lit(rows) / n + 1e-9) * (1 << 30)
    if by is None:
        df = df.filter(spread < share(limit, max(df.count(), 1)))
    else:
        counts = durable(df.groupBy(F.col(by).alias("_value")).agg(F.count("*").alias("_count")))
        # The largest number of rows a value that leaves the sum within the limit, to a tenth.
        levels = sorted({int(1.1**i) for i in range(1 + int(np.log(limit) / np.log(1.1)))} | {limit})
        sums = counts.agg(*[F.coalesce(F.sum(F.least("_count", F.lit(n))), F.lit(0)) for n in levels]).first()
        level = max([n for n, total in zip(levels, sums, strict=True) if total <= limit], default=1)
        most = small(counts.select("_value", share(level, F.col("_count")).alias("_most")))
        df = df.join(most, F.col(by).eqNullSafe(F.col("_value"))).filter(spread < F.col("_most")).drop("_value", "_most")
    return df.orderBy(spread, F.col(key)).limit(limit)


def window_of(column: str, key: str, length: int):
    """A passage of `length` characters at a place that a hash of the key decides; shorter texts whole."""
    start = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("window")), F.greatest(F.length(column) - length + 1, F.lit(1)))
    return F.col(column).substr(F.lit(1) + start.cast("int"), F.lit(length))


# --- Words, hashed for whole batches at once ---

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class _Powers:
    """Powers of the multiplier and of its inverse, grown as needed; never sent to workers."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(n, _MUL), np.full(n, _INV)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _words(texts: list[str], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the joined bytes, prefix sums of weighted bytes, and each text's words."""
    parts = [(t.lower() if lower else t).encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    up, _ = _POWERS(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    bounds = np.cumsum([len(p) + 1 for p in parts])
    return starts, ends, total, np.diff(np.searchsorted(starts, bounds), prepend=0)


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words of each text.

    A word is a longest run of ASCII letters, digits and non-ASCII characters of the lower-cased text.
    """
    starts, ends, total, number = _words(texts, lower)
    return mix((total[ends] - total[starts]) * _POWERS(len(total))[1][starts]), number


def word_prefix_hashes(texts: list[str], lengths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """As word_hashes, then the same for the words' beginnings of each length in bytes (shorter words whole)."""
    starts, ends, total, number = _words(texts, True)
    down = _POWERS(len(total))[1][starts]
    cuts = [ends, *(np.minimum(starts + n, ends) for n in lengths)]
    return [mix((total[cut] - total[starts]) * down + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) for i, cut in enumerate(cuts)], number


def slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of items whose sizes add up to about `most`; one larger item has a run of its own."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))
