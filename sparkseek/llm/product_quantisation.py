"""Near-duplicate vectors by product quantisation.

Unit vectors are dealt to coarse cells on two levels (k-means inside k-means), and the residual to the cell's
centroid is coded in a byte for every DIMS dimensions. Every vector searches its own cell and each later cell whose borders, on
either level, are within reach of a vector at the threshold; a pair of cells is thus searched from one side, and
what it finds counts for both. With a table of distances from the query's residual parts to all codewords, a
member's distance is a sum of looked-up entries. A member passes when that is within the threshold's distance plus
the member's own coding error, so coding loses nothing; what passes is compared by cosine in double precision.

A change of length r spread over d dimensions moves a vector by about r / sqrt(d) across one border, so cells
within REACH such lengths are searched (never further than r, which is enough for any change). The number of cells
follows the square root of the number of vectors, up to CELLS; cells and codewords are fitted on a hashed sample of
SAMPLE vectors a cell, all vectors are indexed and all are queries.

Groups. Equal vectors are one class first. A cell's members and queries are dealt to groups of bounded size,
and a group returns sums of links and a spanning forest of them, not its pairs, so dense groups cost their
members. Vectors travel in the type they came in. The graph's components come from `components`.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components link with nothing;
shorter vectors count as padded with zeros; repeated rows of an id stay, and link with each other; null ids
stand by a hash of their vector; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import arrow_limits, bounded_sample, durable
from .components import components

LEAST = 0.95
#: Dimensions of a subspace, and its codewords.
DIMS, CODES = 16, 256
REACH = 4.0
#: Cells in all and of one coarse cell, at most; vectors that are fitted on for each cell, and at least.
CELLS, FINE = 16384, 256
SAMPLE, LEAST_SAMPLE = 16, 16384
ROUNDS = 8
#: Members and queries of a group, about.
MEMBERS, QUERIES = 2048, 8192
#: Queries whose distances to a group's members are looked up at once.
TOGETHER = 64


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from k rows; empty clusters keep their place."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    if len(c) < k:
        c = np.concatenate([c, np.zeros((k - len(c), x.shape[1]), x.dtype)])
    for _ in range(ROUNDS):
        near = nearest(x, c)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(count)
        total[some] = np.add.reduceat(x[order], (np.cumsum(count) - count)[some], axis=0)
        c[some] = total[some] / count[some, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def gaps(c: np.ndarray) -> np.ndarray:
    """Distances between centroids."""
    squares = (c * c).sum(1)
    return np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * c @ c.T, 1e-12))


def borders(x: np.ndarray, c: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and how far the row is from the border towards each of the others."""
    d = (c * c).sum(1) - 2 * x @ c.T
    near = d.argmin(1)
    return near, (d - d[np.arange(len(x)), near][:, None]) / (2 * gap[near])


class Index:
    """Coarse centroids, the fine ones of each, and the codewords of each subspace of the residuals to these.

    A cell's number is that of its fine centroid; those of a coarse cell are consecutive.
    """

    def __init__(self, sample: np.ndarray, cells: int):
        self.parts = sample.shape[1] // DIMS
        self.coarse = kmeans(sample, -(-cells // FINE), 3)
        near = nearest(sample, self.coarse)
        parts = [sample[near == k] for k in range(len(self.coarse))]
        # An empty part keeps its coarse centroid as its one cell.
        fine = [kmeans(x, max(1, min(round(cells * len(x) / len(sample)), len(x))), 4) if len(x) else c[None] for x, c in zip(parts, self.coarse, strict=True)]
        self.first = np.cumsum([0, *map(len, fine)])
        self.cells = np.concatenate(fine)
        self.gap, self.gaps = gaps(self.coarse), [gaps(c) for c in fine]
        rest = sample - self.cells[self.place(sample)]
        self.words = np.stack([kmeans(np.ascontiguousarray(self.part(rest, s)), CODES, 5 + s) for s in range(self.parts)])

    def part(self, x: np.ndarray, s: int) -> np.ndarray:
        return x[:, s * DIMS : (s + 1) * DIMS]

    def own(self, k: int) -> np.ndarray:
        return self.cells[self.first[k] : self.first[k + 1]]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        near, cell = nearest(x, self.coarse), np.zeros(len(x), np.int64)
        for k in np.unique(near):
            cell[near == k] = self.first[k] + nearest(x[near == k], self.own(k))
        return cell

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """Squared distances of the rows' parts to all codewords of each subspace, less the rows' own squares."""
        return np.concatenate([(w * w).sum(1)[:, None] - 2 * (w @ self.part(rest, s).T) for s, w in enumerate(self.words)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code bytes and coding error of each row."""
        cell = self.place(x)
        rest = x - self.cells[cell]
        codes = np.stack([nearest(self.part(rest, s), self.words[s]) for s in range(self.parts)], 1).astype(np.uint8)
        back = np.concatenate([self.words[s][codes[:, s]] for s in range(self.parts)], 1)
        return cell, codes, np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, cell: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the cells from their own on whose borders are within reach on both levels."""
        _, away = borders(x, self.coarse, self.gap)
        rows, found = [], []
        for k in range(len(self.coarse)):
            some = np.flatnonzero((away[:, k] <= reach) & (cell < self.first[k + 1]))
            if len(some):
                i, j = np.nonzero(borders(x[some], self.own(k), self.gaps[k])[1] <= reach)
                later = j + self.first[k] >= cell[some[i]]
                rows.append(some[i[later]])
                found.append(j[later] + self.first[k])
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.argsort(rows, kind="stable")
        return rows[order], found[order]


def reach_of(least: float, width: int) -> tuple[float, float]:
    """The distance of unit vectors at the threshold, and how far borders are searched."""
    r = float(np.sqrt(max(2 - 2 * least, 0)))
    return r, r * min(1.0, REACH / np.sqrt(width))


def padded(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node that the links (a, b) join it with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def links_of(members: pd.DataFrame, queries: pd.DataFrame, index: Index, cell: int, least: float, kind: str) -> pd.DataFrame:
    """What a group finds: rows (node, weight) of sums of links, rows (node, other) of a spanning forest.

    Both ends of a link get the other's size. In its own cell a vector asks for later ones only.
    """
    r, _ = reach_of(least, index.cells.shape[1])
    given_of = lambda column: np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
    vectors, raw = unit(given_of(members["vec"]).astype(np.float64)), given_of(queries["asked"])
    codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(members), index.parts).astype(np.int64)
    bound = ((r + members["error"].to_numpy() + 1e-4) ** 2)[:, None]
    node, size = members["node"].to_numpy(), members["size"].to_numpy()
    asking, count, home = (queries[c].to_numpy() for c in ("asking", "count", "home"))
    places = (codes + np.arange(index.parts) * CODES).T.copy()
    given, got, a, b = np.zeros(len(asking), np.int64), np.zeros(len(node), np.int64), [], []
    for at in range(0, len(asking), TOGETHER):
        block = raw[at : at + TOGETHER]
        # Single precision finds who passes, with more than its rounding as allowance; double precision decides.
        rest = (unit(block) - index.cells[cell]).astype(np.float32)
        look = index.tables(rest)
        distance = look[places[0]]
        for s in range(1, index.parts):
            distance += look[places[s]]
        near, q = np.nonzero(distance <= bound - (rest * rest).sum(1))
        if not len(q):
            continue
        later = ~home[at + q] | (node[near] > asking[at + q])
        q, near = q[later], near[later]
        good = np.einsum("ij,ij->i", vectors[near], unit(block.astype(np.float64))[q]) >= least
        q, near = at + q[good], near[good]
        if len(q):
            np.add.at(given, q, size[near])
            np.add.at(got, near, count[q])
            a.append(asking[q])
            b.append(node[near])
    nodes, weights = np.concatenate([asking, node]), np.concatenate([given, got])
    some = weights > 0
    out = [pd.DataFrame({"node": nodes[some], "other": pd.array([None] * int(some.sum()), "Int64"), "weight": weights[some]})]
    if a:
        x, y = forest(np.concatenate(a), np.concatenate(b))
        out.append(pd.DataFrame({"node": x, "other": pd.array(y, "Int64"), "weight": np.zeros(len(x), np.int64)}))
    return pd.concat(out)


def linked_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vec_id, embedding."""
    spark = vectors.sparkSession
    arrow_limits(spark)
    kind = "f4" if vectors.schema["embedding"].dataType.elementType == FloatType() else "f8"
    wide = F.col("embedding").cast("array<double>")
    plain = F.coalesce(F.size(wide) > 0, F.lit(False)) & F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists(wide, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.coalesce("vec_id", -F.abs(F.xxhash64("embedding", F.lit("id")))).alias("id"), F.when(plain, wide).alias("v"))
    # Signed zeros are equal; adding 0.0 makes them so for the hash.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = rows.withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    good = rows.filter(F.col("v").isNotNull())
    classes = durable(good.groupBy("h", "h2").agg(F.min("id").alias("node"), F.count("*").alias("size"), F.max(F.size("v")).alias("width")))
    n, width = classes.agg(F.count("*"), F.max("width")).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    width = -(-width // DIMS) * DIMS
    nodes = durable(good.join(classes.drop("width"), ["h", "h2"]).filter("id = node").dropDuplicates(["h", "h2"]).select("node", "size", "v"))
    cells = int(min(CELLS, 2 ** round(np.log2(max(n, 2)) / 2)))
    sample = bounded_sample(nodes.select("node", "v"), "node", max(LEAST_SAMPLE, SAMPLE * cells)).select("v").toArrow().column("v").to_pandas()
    cells = min(cells, max(1, len(sample) // 8))
    index = spark.sparkContext.broadcast(vars(Index(unit(padded(sample, width)).astype(np.float32), cells)))
    _, reach = reach_of(least, width)

    def load() -> Index:
        own = Index.__new__(Index)
        vars(own).update(index.value)
        return own

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = load()
        for batch in batches:
            x = padded(batch["v"], width)
            single = unit(x).astype(np.float32)
            cell, codes, error = own.encode(single)
            rows, found = own.probes(single, cell, reach)
            probes = np.split(found.astype(np.int32), np.searchsorted(rows, np.arange(1, len(x))))
            yield pd.DataFrame({"node": batch["node"], "size": batch["size"], "vec": [v.tobytes() for v in x.astype(kind)], "code": [c.tobytes() for c in codes], "error": error.astype(np.float64), "cell": cell.astype(np.int32), "probes": probes})

    coded_rows = durable(nodes.mapInPandas(coded, "node long, size long, vec binary, code binary, error double, cell int, probes array<int>"))
    # At most CELLS rows each.
    held = coded_rows.groupBy("cell").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("m"))
    asked = coded_rows.select(F.explode("probes").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q"))
    blocks = F.broadcast(held.join(asked, "cell"))
    spread = F.xxhash64("node", F.lit("group"))
    members = coded_rows.join(blocks, "cell").select("cell", F.pmod(spread, F.col("m")).alias("mi"), F.expr("explode(sequence(0L, q - 1L))").alias("qi"), "node", "size", "vec", "code", "error")
    queries = coded_rows.select(F.col("cell").alias("own"), F.explode("probes").alias("cell"), "node", "vec", "size").withColumn("home", F.col("own") == F.col("cell")).join(blocks, "cell").select("cell", F.expr("explode(sequence(0L, m - 1L))").alias("mi"), F.pmod(spread, F.col("q")).alias("qi"), F.col("node").alias("asking"), F.col("vec").alias("asked"), F.col("size").alias("count"), "home")

    def found(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "other": [], "weight": []})
        return links_of(left, right, load(), key[0], least, kind)

    groups = ["cell", "mi", "qi"]
    out = durable(members.groupBy(*groups).cogroup(queries.groupBy(*groups)).applyInPandas(found, "node long, other long, weight long"))
    comps = durable(components(out.filter("other IS NOT NULL"), "node", "other"))
    links = out.filter("other IS NULL").groupBy("node").agg(F.sum("weight").alias("weight"))
    known = classes.select("h", "h2", "node", "size").join(links, "node", "left").join(comps.withColumnRenamed("node", "c"), F.col("node") == F.col("c"), "left")
    known = known.select("h", "h2", (F.col("size") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = good.select("vec_id", "id", "h", "h2").join(known, ["h", "h2"]).select("vec_id", "id", "n_links", "component_id")
    alone = rows.filter(F.col("v").isNull()).select("vec_id", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
