"""Query expansion: pseudo-relevance feedback, association, metric and scalar term clusters.

All of it works on the postings table; ties are ordered by term. Expanded queries are searched anew as text, so
their terms pass the analyzer once more.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import analyzed
from ..session import BROADCAST_ROWS, arrow_limits, durable, placed, shared_folder, small
from . import graph
from .index import Index, prune_vocab, term_df, tfidf
from .rank import bm25, bm25_part, by_score, format_results, query_terms

METHODS = ("rocchio", "association", "metric", "scalar")
ALPHA, BETA, GAMMA = 1.0, 0.75, 0.15
RELEVANT, NONRELEVANT, ROCCHIO_TERMS, POOL = 10, 5, 8, 80
ASSOCIATION_TERMS = 12
METRIC_COSINE, METRIC_TERMS_PER_DOC = 0.12, 100
#: Most terms of a group: of those in less than a share FREQUENT of documents, of others, and of the most frequent ones, which fill TOP_GROUPS groups; most postings of a group.
WIDTHS, FREQUENT, TOP_GROUPS, GROUP = (1 << 21, 16384, 4096), 1 / 800, 4, 1 << 21
#: Sums that stand in an array; products made at once; an array has so many cells for a product at most.
CELLS, PORTION, DENSE = 1 << 22, 1 << 19, 4
#: Groups whose pairs are one plan; broadcasts that a vocabulary is sent in at most; rows of a batch that is packed.
PASS_GROUPS, BROADCASTS, NARROW_ROWS = 32, 6, 1 << 16
#: The columns of a packed group.
PACKED = "docs binary, lens binary, slots binary, tfs binary, slot_bytes int, tf_bytes int"
#: Of no effect: documents are in no chunks any more, but a test sets their size.
CHUNK_DOCS = 512
SCALAR_COSINE, SCALAR_SIZE = 0.08, 80
#: Ids of a term's postings that stand in one row.
CHUNK = 1 << 16
SIBLINGS, MOST = 8, 16


def _query_rows(index: Index, terms: list[str]) -> DataFrame:
    rows = [(i, t) for i, t in enumerate(terms)]
    return index.postings.sparkSession.createDataFrame(rows, "pos INT, term STRING")


def analyzed_query(index: Index, query: str) -> list[str]:
    """The query's terms in order, repeats kept."""
    from ..functions.stemmer import stem_words
    from ..functions.text import remove_stop_words, tokenize

    spark = index.postings.sparkSession
    tokens = tokenize(F.lit(query))
    rows = spark.range(1).select(F.posexplode(tokens if index.analyzer == "raw" else remove_stop_words(tokens)).alias("pos", "term"))
    if index.analyzer == "full":
        rows = rows.join(stem_words(rows), "term").select("pos", F.col("stem").alias("term"))
    return [r["term"] for r in rows.orderBy("pos").collect()]


def rocchio(index: Index, query: str, ranked: DataFrame, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA, relevant: int = RELEVANT, nonrelevant: int = NONRELEVANT, terms: int = ROCCHIO_TERMS, clip: bool = True) -> DataFrame:
    """term, weight of the best terms that the query lacks; ranked: doc_id, score of the first results.

    The first `relevant` results attract, the last `nonrelevant` repel (if the list is long enough for both);
    a list of `relevant` results or fewer gives no terms.
    """
    order = Window.orderBy(*by_score())  # over the pool's rows, at most POOL
    pool = ranked.withColumns({"rn": F.row_number().over(order), "size": F.count("*").over(Window.partitionBy())}).filter(F.col("size") > relevant)
    apart = F.col("size") >= relevant + nonrelevant + 2
    side = F.when(F.col("rn") <= relevant, F.lit(beta / relevant)).when(apart & (F.col("rn") > F.col("size") - nonrelevant), F.lit(-gamma / nonrelevant))
    picked = pool.withColumn("share", side).filter("share IS NOT NULL").select("doc_id", "share")
    df = term_df(index.postings)
    # At most POOL documents' postings remain before the join with the vocabulary.
    near = index.postings.join(F.broadcast(picked), "doc_id")
    q = query_terms(index, query).select("term")
    own = index.postings.join(F.broadcast(q), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    n = F.broadcast(index.stats.select("n"))
    fed = near.join(df, "term").crossJoin(n).select("term", (F.col("share") * tfidf(F.col("tf"), F.col("df"), F.col("n"))).alias("w"))
    asked = own.crossJoin(n).crossJoin(F.broadcast(pool.agg(F.max("size").alias("size")))).filter("size IS NOT NULL").select("term", (F.lit(alpha) * tfidf(F.lit(1), F.col("df"), F.col("n"))).alias("w"))
    vector = fed.unionByName(asked).groupBy("term").agg(F.sum("w").alias("weight"))
    vector = vector.filter("weight > 0") if clip else vector.filter("weight <> 0")
    return vector.join(F.broadcast(q), "term", "left_anti").orderBy(F.desc(F.round("weight", 9)), "term").limit(terms)


def association(index: Index, query: str, terms: int = ASSOCIATION_TERMS) -> DataFrame:
    """term, score: the highest Jaccard similarity of a term's documents with those of a query term."""
    q = query_terms(index, query).select("term")
    own = index.postings.join(F.broadcast(q), "term", "left_semi").select(F.col("term").alias("q"), "doc_id")
    others = index.postings.join(F.broadcast(q), "term", "left_anti").select("term", "doc_id")
    co = own.join(others, "doc_id").groupBy("q", "term").agg(F.count("*").alias("co"))
    df = term_df(index.postings)
    rows = co.join(df, "term").join(F.broadcast(own.groupBy("q").agg(F.count("*").alias("qdf"))), "q")
    score = F.col("co") / (F.col("df") + F.col("qdf") - F.col("co"))
    return rows.groupBy("term").agg(F.max(score).alias("score")).orderBy(F.desc(F.round("score", 9)), "term").limit(terms)


def metric_clusters(index: Index, cosine: float = METRIC_COSINE, per_doc: int | None = None, widths: tuple[int, int, int] = WIDTHS) -> DataFrame:
    """term, cluster_id for the pruned vocabulary: terms that stand in a document together and whose full vectors
    are close are joined, and clusters are what joins reach. With `per_doc` a document joins only its first terms by
    a hash, so many of them. Cosines within 1e-9 of the threshold reach it, so the order of a sum decides nothing.

    No pair is a row. Terms are cut, in order of their number of documents, into groups of bounded postings; a group
    is written once, as one row, and rows meet where they are read, so no posting is shuffled once more for a group that
    it meets. Two groups' products are added up for some terms at a time, and what leaves them are trees that join what
    is close: a row for a term at most. A term whose largest weights don't reach the threshold over as many documents
    as another has can't be close to it (Cauchy and Schwarz), so a group meets groups of like frequency only. A pair's
    idf stands in both of its norms and is left out.
    """
    spark = index.postings.sparkSession
    vocab = durable(_placed_terms(index, cosine, widths))
    groups = vocab.groupBy("group").agg(F.max("df").alias("df"), F.min("need").alias("need"), F.min("place").alias("start"), F.count("*").alias("n")).orderBy("group").collect()
    rows = _with_terms(index.postings, vocab.select("term", "id", "group", "slot"))
    tf = F.col("tf")
    if per_doc is not None:
        # A count of a term that the document doesn't give is negative.
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")))
        tf = F.when(F.col("n") <= per_doc, tf).otherwise(-tf)
    rows = rows.select("group", "slot", "doc_id", tf.cast("int").alias("tf")).repartition(max(1, len(groups)), "group").sortWithinPartitions("group")
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    # Rows are narrow here, and one row is a group afterwards.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(NARROW_ROWS))
    try:
        rows.mapInArrow(_packed_groups, f"{PACKED}, group int").write.partitionBy("group").parquet(folder)
    finally:
        arrow_limits(spark)
    packed = spark.read.schema(f"{PACKED}, group int").parquet(folder)
    bounds = {g["group"]: (g["start"], g["n"], g["df"], g["need"]) for g in groups}
    edges, joined = [], _joined_terms(bounds, cosine, per_doc is not None)
    for at in range(0, len(groups), PASS_GROUPS):
        part = None
        for g in groups[at : at + PASS_GROUPS]:
            others = [h["group"] for h in groups if h["group"] >= g["group"] and (h["group"] == g["group"] or g["df"] >= h["need"])]
            one, two = (packed.filter(F.col("group").isin(own)).toDF(*(f"{side}_{c}" for c in packed.columns)) for side, own in (("a", [g["group"]]), ("b", others)))
            part = one.crossJoin(two) if part is None else part.unionAll(one.crossJoin(two))
        edges.append(durable(part.mapInArrow(joined, "x long, y long")))
    close = functools.reduce(DataFrame.unionAll, edges) if edges else spark.createDataFrame([], "x long, y long")
    found = graph.components(close, "x", "y")
    rows = durable(vocab.join(found, F.col("place") == F.col("node"), "left").select("term", F.coalesce("component", "place").alias("c")))
    # A component may hold nearly all terms: its name is found by a partial minimum, and no task takes it whole.
    names = durable(rows.groupBy("c").agg(F.min("term").alias("cluster_id")))
    return rows.join(small(names), "c").select("term", "cluster_id")


def _with_terms(postings: DataFrame, vocab: DataFrame) -> DataFrame:
    """Postings with their terms' columns. A vocabulary of a few broadcasts is sent in parts, which shuffles no postings."""
    parts = -(-vocab.count() // BROADCAST_ROWS)
    if parts > BROADCASTS:
        return postings.join(vocab, "term")
    part = F.pmod(F.xxhash64("term"), F.lit(max(1, parts)))
    return functools.reduce(DataFrame.unionAll, [postings.join(F.broadcast(vocab.filter(part == i)), "term") for i in range(max(1, parts))])


def _placed_terms(index: Index, cosine: float, widths: tuple[int, int, int]) -> DataFrame:
    """term, id (place by hash), df, need, place (by df), group, slot of the pruned vocabulary.

    need: the fewest documents over which the term's largest weights reach the threshold.
    """
    square = (1 + F.log10("tf")) * (1 + F.log10("tf"))
    counts = index.postings.groupBy("term", "tf").agg(F.count("*").alias("n")).withColumn("q", F.col("n") * square)
    down = Window.partitionBy("term").orderBy(F.desc("tf"))
    own = Window.partitionBy("term")
    counts = counts.withColumns({"docs": F.sum("n").over(down), "sum": F.sum("q").over(down), "all": F.sum("q").over(own)})
    # Of the first count that reaches the least square a part of its documents may do.
    least = max(cosine - 1e-8, 0.0) ** 2 * F.col("all")
    need = F.when((F.col("sum") >= least) & (F.col("sum") - F.col("q") < least), F.col("docs") - F.floor((F.col("sum") - least) / square))
    vocab = prune_vocab(index.postings, index.stats).join(counts.withColumn("need", need).groupBy("term").agg(F.coalesce(F.min("need"), F.lit(0)).alias("need")), "term")
    vocab = placed(vocab.withColumn("h", F.md5(F.col("term").cast("binary"))), "h", "term", name="id").select("term", "df", "id", "need")
    vocab = durable(placed(vocab, "df", "id", name="place").select("term", "id", "df", "need", "place"))
    sizes = vocab.groupBy("df").agg(F.count("*").alias("n")).orderBy("df").collect()
    starts = _group_starts([(r["df"], r["n"]) for r in sizes], index.stats.first()["n"], widths)
    rows = vocab.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(starts, [*starts[1:], 1 << 62], strict=True))], "group INT, start LONG, end LONG")
    rows = vocab.join(F.broadcast(rows), (F.col("place") >= F.col("start")) & (F.col("place") < F.col("end")))
    return rows.select("term", "id", "df", "need", "place", "group", (F.col("place") - F.col("start")).cast("int").alias("slot"))


def _group_starts(sizes: list[tuple[int, int]], n: int, widths: tuple[int, int, int]) -> list[int]:
    """First places of groups, of (df, number of terms) in order: no group has more than GROUP postings, if it has two terms, nor terms than its width."""
    few, wide, top = widths
    starts, place, terms, postings = [], 0, 0, 0
    last = sum(c for _, c in sizes) - TOP_GROUPS * top
    for df, count in sizes:
        while count:
            most = few if df < n * FREQUENT else wide if place < last else top
            room = min(most - terms, (GROUP - postings) // df)
            if not starts or (terms and room <= 0):
                starts.append(place)
                terms, postings = 0, 0
                continue
            took = min(count, max(1, room))
            place, terms, postings, count = place + took, terms + took, postings + took * df, count - took
    return starts


def _by_slot(slots: np.ndarray) -> np.ndarray:
    """A stable order by slot, by counting in its two halves."""
    order = np.argsort((slots & 0xFFFF).astype(np.uint16), kind="stable")
    return order if not len(slots) or slots.max() < 1 << 16 else order[np.argsort((slots[order] >> 16).astype(np.uint16), kind="stable")]


def _packed_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows group, slot, doc_id, tf, by groups, to one row for each group: documents, how many terms each has, slots and counts."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        docs, slots, tfs = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = _by_slot(slots)
        order = order[np.argsort(docs[order], kind="stable")]
        ids, lens = np.unique(docs[order], return_counts=True)
        kinds = [np.uint16 if slots.max() < 1 << 16 else np.uint32, np.int8 if np.abs(tfs).max() < 128 else np.int32]
        columns = [ids.astype(np.int64), lens.astype(np.int32), slots[order].astype(kinds[0]), tfs[order].astype(kinds[1])]
        own = [pa.array([c.tobytes()], pa.binary()) for c in columns] + [pa.array([np.dtype(k).itemsize], pa.int32()) for k in kinds]
        return pa.RecordBatch.from_arrays([*own, pa.array([now], pa.int32())], names=["docs", "lens", "slots", "tfs", "slot_bytes", "tf_bytes", "group"])

    for batch in batches:
        group, *columns = (batch.column(c).to_numpy() for c in ("group", "slot", "doc_id", "tf"))
        slot, doc, tf = columns
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
        for a, b in itertools.pairwise(cuts):
            if a == b:
                continue
            if held and group[a] != now:
                yield done()
            now = int(group[a])
            held.append((doc[a:b].copy(), slot[a:b].copy(), tf[a:b].copy()))
    if held:
        yield done()


class Side:
    """A group's postings by document and slot, with weights of which each term's squares add up to 1."""

    def __init__(self, row: dict, side: str, n: int, capped: bool):
        get = lambda c, kind: np.frombuffer(row[f"{side}_{c}"], kind)
        self.docs, self.lens, self.n = get("docs", np.int64), get("lens", np.int32).astype(np.int64), n
        self.slots = get("slots", np.uint16 if row[f"{side}_slot_bytes"] == 2 else np.uint32).astype(np.int32)
        tfs = get("tfs", np.int8 if row[f"{side}_tf_bytes"] == 1 else np.int32)
        self.w = 1 + np.log10(np.abs(tfs.astype(np.float64)))
        self.w /= np.sqrt(np.bincount(self.slots, self.w * self.w, n))[self.slots]
        self.given = tfs > 0 if capped else None
        self.ends = np.cumsum(self.lens)


class Forest:
    """Trees of nodes that are joined; a node's root is the least of its tree."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while True:
            up = self.parent[root]
            if np.array_equal(up, root):
                self.parent[at] = root
                return root
            root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _close_slots(one: Side, two: Side, same: bool, cosine: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of close terms of two groups; a group meets itself in a lower and a higher slot. least: documents that a term of the first has at least.

    Terms are taken in runs of about PORTION products. A run's sums stand in an array where it has no more than CELLS of
    them and few are empty, and are sorted else; a term of more products is taken in several portions.
    """
    begin, end = np.arange(1, len(one.slots) + 1), np.repeat(one.ends, one.lens)
    if not same:
        at = np.minimum(np.searchsorted(two.docs, one.docs), len(two.docs) - 1)
        met = two.docs[at] == one.docs
        begin, end = (np.repeat(np.where(met, x, 0), one.lens) for x in ((two.ends - two.lens)[at], two.ends[at]))
    kept = (end > begin) & (np.bincount(one.slots, minlength=one.n) >= least)[one.slots]
    order = _by_slot(one.slots)
    order = order[kept[order]]
    if not len(order):
        return
    begin, times, x, w = begin[order], (end - begin)[order], one.slots[order], one.w[order]
    given = one.given[order] if one.given is not None else None
    last = np.flatnonzero(np.append(np.diff(x) != 0, True)) + 1
    upto = np.cumsum(times)
    total = upto[last - 1]

    def products(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = times[a:b]
        i = np.repeat(np.arange(a, b), t)
        j = np.repeat(begin[a:b] - (np.cumsum(t) - t), t) + np.arange(len(i))
        return i, two.slots[j], w[i] * two.w[j], given[i] & two.given[j] if given is not None else None

    near = lambda sums: (sums > 0) & (np.round(sums, 9) >= cosine)
    k = 0
    while k < len(last):
        before = int(total[k - 1]) if k else 0
        to = max(k + 1, int(np.searchsorted(total, before + PORTION, "right")))
        a, b = int(last[k - 1]) if k else 0, int(last[to - 1])
        if to == k + 1 and total[k] - before > PORTION:
            sums, seen = np.zeros(two.n), np.zeros(two.n, bool)
            while a < b:
                c = min(b, max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PORTION, "right"))))
                _, slot, value, both = products(a, c)
                sums += np.bincount(slot, value, two.n)
                seen[slot if both is None else slot[both]] = True
                a = c
            found = np.flatnonzero(near(sums) & seen)
            yield np.full(len(found), x[b - 1]), found
        else:
            i, slot, value, both = products(a, b)
            run = np.cumsum(np.append(0, np.diff(x[a:b]) != 0))  # numbers of the terms
            cell, cells = run[i - a] * two.n + slot, (to - k) * two.n
            if cells <= min(CELLS, DENSE * len(cell)):
                sums = np.bincount(cell, value, cells)
                if both is not None:
                    seen = np.zeros(cells, bool)
                    seen[cell[both]] = True
                    sums[~seen] = 0
                cell = np.flatnonzero(near(sums))
            else:
                order = np.argsort(cell)
                cell = cell[order]
                start = np.flatnonzero(np.append(True, np.diff(cell) != 0))
                fit = near(np.add.reduceat(value[order], start))
                if both is not None:
                    fit &= np.logical_or.reduceat(both[order], start)
                cell = cell[start[fit]]
            number, y = np.divmod(cell, two.n)
            yield x[last[k:to] - 1][number], y
        k = to


def _joined_terms(bounds: dict[int, tuple[int, int, int, int]], cosine: float, capped: bool):
    """Pairs of packed groups to places of terms and of the roots that close terms join them to. bounds: each group's first place, number of terms, most documents, least need."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_buffer() if pa.types.is_binary(batch.column(c).type) else batch.column(c)[r].as_py() for c in batch.schema.names}
                a, b = row["a_group"], row["b_group"]
                (first, n, _, _), (second, m, _, need) = bounds[a], bounds[b]
                one = Side(row, "a", n, capped)
                two = one if a == b else Side(row, "b", m, capped)
                forest = Forest(n if a == b else n + m)
                for x, y in _close_slots(one, two, a == b, cosine, need):
                    forest.join(x, y if a == b else y + n)
                node = np.flatnonzero(forest.parent != np.arange(len(forest.parent)))
                root = forest.roots(node)
                place = lambda v: np.where(v < n, v + first, v - n + second)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(place(v), pa.int64()) for v in (node, root)], names=["x", "y"])

    return trees


class Sums:
    """Each document's open clusters and their sums of weights: blocks of slots in flat arrays that move when they are full."""

    def __init__(self):
        self.place: dict[int, int] = {}
        self.start, self.used, self.room = (np.zeros(1024, np.int64) for _ in range(3))
        self.cluster, self.total, self.end = np.zeros(4096, np.int64), np.zeros(4096), 0

    def rows(self, docs: list[int]) -> np.ndarray:
        """The documents' numbers; new ones get one."""
        at = np.array([self.place.setdefault(d, len(self.place)) for d in docs])
        if len(self.place) > len(self.start):
            more = np.zeros(len(self.place), np.int64)
            self.start, self.used, self.room = (np.concatenate([x, more]) for x in (self.start, self.used, self.room))
        return at

    def slots(self, at: np.ndarray) -> np.ndarray:
        """All slots of the documents, one document after the other."""
        used = self.used[at]
        ends = np.cumsum(used)
        return np.repeat(self.start[at] - ends + used, used) + np.arange(ends[-1])

    def live(self, at: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of clusters that have a lane, and the lanes; slots of others are given up, each once."""
        slots = self.slots(at)
        lanes = lane[self.cluster[slots]]
        kept = lanes >= 0
        if not kept.all():
            old, lanes = slots[kept], lanes[kept]
            self.used[at] = np.bincount(np.repeat(np.arange(len(at)), self.used[at])[kept], minlength=len(at))
            slots = self.slots(at)
            self.cluster[slots], self.total[slots] = self.cluster[old], self.total[old]
        return slots, lanes

    def add(self, at: np.ndarray, w: np.ndarray, best: int, slots: np.ndarray, hit: np.ndarray) -> float:
        """Add weights to a cluster, which the slots number `hit` are of; gives what its sum of squares grows by."""
        own, who = slots[hit], np.searchsorted(np.cumsum(self.used[at]), hit, "right")
        grown = float((w * w).sum() + 2 * (w[who] * self.total[own]).sum())
        self.total[own] += w[who]
        fresh = np.ones(len(at), bool)
        fresh[who] = False
        rows, new = at[fresh], w[fresh]
        full = rows[self.used[rows] == self.room[rows]]
        if len(full):
            room = np.maximum(4, 2 * self.room[full])
            while self.end + room.sum() > len(self.total):
                self.cluster, self.total = np.concatenate([self.cluster, np.zeros_like(self.cluster)]), np.concatenate([self.total, np.zeros_like(self.total)])
            old = self.slots(full)
            self.start[full], self.room[full] = self.end + np.cumsum(room) - room, room
            moved = self.slots(full)
            self.cluster[moved], self.total[moved], self.end = self.cluster[old], self.total[old], self.end + int(room.sum())
        slot = self.start[rows] + self.used[rows]
        self.cluster[slot], self.total[slot] = best, new
        self.used[rows] += 1
        return grown


class SinglePass:
    """Puts vectors in order into the nearest running-mean centroid that has room, or opens a cluster.

    Open clusters have lanes, which are used again when a cluster is full: a full cluster takes nothing any more, so a
    vector meets open ones only, however many there were before.
    """

    def __init__(self, cosine: float, size: int):
        self.cosine, self.size, self.n, self.sums = cosine, size, 0, Sums()
        self.lane, self.free = np.full(1024, -1), []
        self.name, self.squares, self.counts = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def _open(self) -> int:
        if not self.free:
            more = max(64, len(self.name))
            self.free = list(range(len(self.name) + more - 1, len(self.name) - 1, -1))
            self.name = np.concatenate([self.name, np.full(more, -1)])
            self.squares, self.counts = np.concatenate([self.squares, np.zeros(more)]), np.concatenate([self.counts, np.zeros(more, np.int64)])
        if self.n == len(self.lane):
            self.lane = np.concatenate([self.lane, np.full(self.n, -1)])
        lane = self.free.pop()
        self.name[lane], self.lane[self.n], self.n = self.n, lane, self.n + 1
        return lane

    def assigned(self, docs: list[int], w: np.ndarray) -> int:
        at = self.sums.rows(docs)
        slots, lanes = self.sums.live(at, self.lane)
        best, norm = -1, np.sqrt((w * w).sum())
        # Where few slots are met, only their clusters are looked at: the others' cosine is 0.
        if self.cosine > 0 and len(lanes) < len(self.name):
            own, lanes_of = np.unique(lanes, return_inverse=True)
        else:
            own, lanes_of = np.arange(len(self.name)), lanes
        if len(own):
            dots = np.bincount(lanes_of, np.repeat(w, self.sums.used[at]) * self.sums.total[slots], len(own))
            squares = self.squares[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                sims = np.where(squares * norm > 0, dots / (norm * np.sqrt(squares)), 0.0)
            sims[self.name[own] < 0] = -np.inf
            most = sims.max()
            if most >= self.cosine:  # of equal ones the first
                nearest = own[sims == most]
                best = int(nearest[self.name[nearest].argmin()])
        hit = np.flatnonzero(lanes == best)
        if best < 0:
            best = self._open()
        cluster = int(self.name[best])
        self.squares[best] += self.sums.add(at, w, cluster, slots, hit)
        self.counts[best] += 1
        if self.counts[best] >= self.size:
            self.lane[cluster], self.name[best], self.squares[best], self.counts[best] = -1, -1, 0.0, 0
            self.free.append(best)
        return cluster


def _single_pass(cosine: float, size: int):
    """Assigns terms (term, docs, ws), whose rows follow each other, in order."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters = SinglePass(cosine, size)
        term, docs, weights = None, [], []
        for batch in itertools.chain(batches, [None]):
            out = []
            rows = [(None, None, None)] if batch is None else zip(batch["term"].to_pylist(), batch["docs"], batch["ws"], strict=True)
            for name, ids, w in rows:
                if name != term:
                    if term is not None:
                        out.append((term, clusters.assigned(docs, np.concatenate(weights))))
                    term, docs, weights = name, [], []
                if name is not None:
                    docs += ids.values.to_pylist()
                    weights.append(w.values.to_numpy())
            terms, found = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(found, pa.int32())], names=["term", "cluster_id"])

    return assign


def scalar_clusters(index: Index, cosine: float = SCALAR_COSINE, size: int = SCALAR_SIZE) -> DataFrame:
    """term, cluster_id of the pruned vocabulary by one pass in order of (df, term).

    Every assignment depends on all before it, so the pass is one task. All tasks gather the postings into rows of a
    term and CHUNK ids at most, so that the one task sorts few rows; it holds one term's postings and the sums of the
    clusters that still have room.
    """
    arrow_limits(index.postings.sparkSession)
    vocab = durable(prune_vocab(index.postings, index.stats))
    rows = index.postings.join(small(vocab), "term").crossJoin(F.broadcast(index.stats.select("n")))
    rows = rows.select("df", "term", "doc_id", tfidf(F.col("tf"), F.col("df"), F.col("n")).alias("w"))
    own = F.array_sort(F.collect_list(F.struct("doc_id", "w")))
    rows = rows.groupBy("df", "term", F.floor(F.col("doc_id") / CHUNK).alias("chunk")).agg(own.alias("own"))
    rows = rows.orderBy("df", "term", "chunk").select("term", F.col("own.doc_id").alias("docs"), F.col("own.w").alias("ws")).coalesce(1)
    return rows.mapInArrow(_single_pass(cosine, size), "term string, cluster_id int")


def siblings(clusters: DataFrame, terms: list[str], index: Index, each: int = SIBLINGS, most: int = MOST) -> DataFrame:
    """pos, term: alphabetical siblings of each query term, `each` for one, none twice, `most` in all.

    The k-th query term of a cluster takes the k-th run of its siblings: what the earlier ones took is gone.
    """
    q = _query_rows(index, terms)
    asked = q.join(clusters, "term").withColumn("turn", F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos")))
    asked = asked.select("pos", "cluster_id", "turn")
    pool = clusters.join(F.broadcast(asked.select("cluster_id").distinct()), "cluster_id", "left_semi").join(F.broadcast(q.select("term").distinct()), "term", "left_anti")
    pool = pool.withColumn("n", F.row_number().over(Window.partitionBy("cluster_id").orderBy("term")))
    took = pool.filter(F.col("n") <= each * len(terms)).join(F.broadcast(asked), "cluster_id").filter((F.col("n") > each * (F.col("turn") - 1)) & (F.col("n") <= each * F.col("turn")))
    return took.orderBy("pos", "term").limit(most).select("pos", "term")


def expand(index: Index, query: str, method: str = "rocchio", k: int = 10) -> dict:
    """original_query, expanded_query, method, added_terms and documents (a table); other methods are rocchio."""
    method = (method or "rocchio").strip().lower()
    method = method if method in METHODS else "rocchio"
    terms = analyzed_query(index, query)
    if not terms:
        return {"original_query": query.strip(), "expanded_query": query.strip(), "method": method, "added_terms": [], "documents": None}
    if method == "rocchio":
        found = rocchio(index, query, bm25(index, query, max(POOL, RELEVANT + NONRELEVANT + 5)))
    elif method == "association":
        found = association(index, query)
    else:
        found = siblings(metric_clusters(index) if method == "metric" else scalar_clusters(index), terms, index)
    added = [r["term"] for r in found.collect()]
    expanded = " ".join(terms + added)
    return {"original_query": " ".join(terms), "expanded_query": expanded, "method": method, "added_terms": added, "documents": format_results(bm25(index, expanded, k), index.doc_store)}


def judge(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query, precision, average_precision of judged queries (query, doc_id, relevant) over their results (query,
    doc_id, score), whatever search gave them; queries without results have no row.
    """
    order = Window.partitionBy("query").orderBy(*by_score())
    rows = results.withColumn("rank", F.row_number().over(order)).join(queries, ["query", "doc_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    seen = F.sum("relevant").over(Window.partitionBy("query").orderBy("rank"))
    total = queries.groupBy("query").agg(F.sum("relevant").alias("total"))
    rows = rows.withColumn("at", F.when(F.col("relevant") == 1, seen / F.col("rank")).otherwise(F.lit(0.0))).groupBy("query").agg(F.avg("relevant").alias("precision"), F.sum("at").alias("ap"))
    return rows.join(total, "query").select("query", "precision", F.when(F.col("total") > 0, F.col("ap") / F.col("total")).otherwise(F.lit(0.0)).alias("average_precision"))


def bm25_of_all(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, doc_id, score: the first k results of each query (query), all queries in one plan."""
    asked = queries.select("query").distinct()
    terms = analyzed(asked, "query", "query", index.analyzer).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    wanted = terms.select("term").distinct()
    own = index.postings.join(wanted, "term", "left_semi")
    df = own.groupBy("term").agg(F.count("tf").alias("df"))
    rows = own.join(df, "term").join(terms, "term").join(index.doc_store.select("doc_id", "doc_len"), "doc_id", "left").crossJoin(F.broadcast(index.stats))
    scores = rows.groupBy("query", "doc_id").agg(F.sum(bm25_part()).alias("score"))
    order = Window.partitionBy("query").orderBy(*by_score())
    return scores.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")
