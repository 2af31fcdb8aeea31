"""Near-duplicates by Order MinHash, verified by banded alignment.

Two documents are near-duplicates when the edit similarity of their word sequences, 1 - distance / longer length, is
0.8 or more, where an inserted, deleted or replaced word is an edit.

Search. A document's k-mers are its shingles: the runs of five words (see `common.word_hashes`), or all its words
together where there are fewer, labelled with their occurrence number. For each of SKETCHES hash functions the LENGTH
smallest labelled shingles are kept in the order in which they stand in the text; equal sketches make a pair
likely in proportion to a power of the share of common shingles. An edit costs up to five shingles, so this share is
about 0.63, 0.42, 0.29 and 0.20 for words that differ at random in 5, 10, 15 and 20 of a hundred places, and such pairs
share none of the sketches with a probability of about 1e-11, 1e-4, 0.017 and 0.15; where edits stand together more is shared.
Only pairs with no five words in a row in common can't be found. Texts that share a sketch also get a signature, the
smallest hash of each of BINS bins of their occurrence-labelled words; pairs whose estimated share of labelled words is
below ALIKE are not aligned (at the threshold the share is two thirds or more, four standard deviations above).

Groups. Equal word sequences are one class first, so copies cost one count; classes are numbered in the order of
their smallest ids. Within a bucket of equal sketches every class is aligned with the bucket's first one, which is
linear in the bucket. Only buckets that still hold more than one component are then searched, and there only the
classes outside the bucket's largest component ask: each block of the bucket's classes meets the blocks of askers.
A block gives a forest of links, not its pairs: no link between components is lost, and no group is expanded.

Edge cases: null texts stand alone; texts without words are copies of equal texts only; repeated rows of an
id stay, with one result each; rows of one id with different texts link these texts, each of which is compared;
null ids stand by a hash of their text; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import arrow_limits, drop_table, durable, mix, placed, slices, small, word_hashes
from .components import components

WORDS, LEAST = 5, 0.8
SKETCHES, LENGTH = 48, 2
#: Bins of a signature and the estimated share from which pairs are aligned; FEW bins are compared first.
BINS, ALIKE = 256, 0.55
FEW, ROUGHLY = 64, 0.42
#: Classes of a bucket, and askers, that meet in one block, about.
ROWS = 1024
#: Characters of text that are hashed at once.
CHARS = 1 << 18

_SEEDS = np.random.default_rng(5).integers(1, 1 << 62, (SKETCHES, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(6).integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64((1 << 64) - 1)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, and the number of shingles of each."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    sums = np.zeros(len(words), np.uint64)
    for j in range(WORDS):
        sums[: max(len(words) - j, 0)] += words[j:] * _FACTORS[j]
    number = np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(counts.dtype))
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        own = words[starts[i] : ends[i]]
        sums[starts[i]] = (own * _FACTORS[: len(own)]).sum() + np.uint64(len(own))
    total = int(number.sum())
    at = np.repeat(starts - np.cumsum(number) + number, number) + np.arange(total)
    return mix(sums[at]), number


def occurrences(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The hashes, mixed with their occurrence number where a text repeats a shingle."""
    tagged = hashes ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(tagged, kind="stable")
    run = tagged[order]
    fresh = np.ones(len(run), bool)
    fresh[1:] = run[1:] != run[:-1]
    if fresh.all():
        return hashes
    first = np.flatnonzero(fresh)
    again = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
    occurrence = np.empty(len(run), np.uint64)
    occurrence[order] = again.astype(np.uint64)
    return np.where(occurrence > 0, mix(hashes + occurrence * _GOLD), hashes)


def sketches(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Order MinHash sketches (documents x SKETCHES); all documents have a shingle."""
    docs = len(number)
    ends = np.cumsum(number)
    starts = ends - number
    owner = np.repeat(np.arange(docs), number)
    hashes = occurrences(hashes, owner)
    out = np.zeros((docs, SKETCHES), np.uint64)
    for j, (factor, shift) in enumerate(_SEEDS):
        values = hashes * factor + shift
        values ^= values >> np.uint64(29)
        places, least = np.zeros((LENGTH, docs), np.int64), np.zeros((LENGTH, docs), np.uint64)
        for n in range(LENGTH):
            least[n] = low = np.minimum.reduceat(values, starts)
            hit = np.flatnonzero(values == low[owner])
            place = places[n]
            place[owner[hit[::-1]]] = hit[::-1]
            values[place] = _LAST
        spare = np.arange(LENGTH)[:, None] >= number[None, :]
        places[spare] = np.iinfo(np.int64).max
        least[spare] = 0
        kept = np.take_along_axis(least, np.argsort(places, axis=0, kind="stable"), axis=0)
        total = np.full(docs, np.uint64((j + 1) * int(_GOLD) % (1 << 64)))
        for n in range(LENGTH):
            total = mix(total ^ kept[n]) * _GOLD
        out[:, j] = total
    return out


def signatures(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    """documents x BINS bytes: of each bin's smallest hash of labelled words, 0 for an empty bin."""
    owner = np.repeat(np.arange(len(number)), number)
    values = mix(occurrences(hashes, owner) + _GOLD)
    least = np.full(len(number) * BINS, _LAST)
    np.minimum.at(least, owner * BINS + (values >> np.uint64(56)).astype(np.int64), values)
    return np.where(least == _LAST, 0, 1 + mix(least) % np.uint64(255)).astype(np.uint8).reshape(len(number), BINS)


def _empty_bytes(words: np.ndarray) -> np.ndarray:
    """Number of zero bytes in each row of 64-bit words."""
    some = ((words & _LOW) + _LOW | words) & ~_LOW
    return 8 * words.shape[-1] - np.bitwise_count(some).sum(-1, dtype=np.int64)


def share_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated shares of common labelled words of rows of signatures, as 64-bit words of eight bins."""
    neither = _empty_bytes(x | y)
    return (_empty_bytes(x ^ y) - neither) / np.maximum(8 * x.shape[-1] - neither, 1)


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices([len(t) for t in batch["text"]], CHARS):
            own = batch.iloc[part]
            texts = own["text"].tolist()
            hashes, number = shingle_hashes(texts)
            some = np.flatnonzero(number)
            out = pd.DataFrame({"_doc": own["_doc"].to_numpy(), "_raw": own["_raw"].to_numpy(), "_key": own["_raw"].to_numpy(), "_key2": np.int64(0), "_n": number.astype(np.int64), "_sk": None})
            if len(some):
                starts = (np.cumsum(number) - number)[some]
                place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(starts, number[some]).astype(np.uint64)
                ordered = mix(hashes + mix(place + _GOLD))
                keys = [np.add.reduceat(mix(ordered ^ np.uint64(salt)), starts).astype(np.int64) for salt in (11, 23)]
                sk = [None] * len(own)
                for i, row in zip(some, sketches(hashes, number[some]).astype(np.int64), strict=True):
                    sk[i] = row
                key, key2 = out["_key"].to_numpy().copy(), out["_key2"].to_numpy().copy()
                key[some], key2[some] = keys[0], keys[1]
                out = out.assign(_key=key, _key2=key2, _sk=sk)
            yield out


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if it is `most` or less, else most + 1.

    Bit-parallel alignment: the vertical differences of a column of the edit matrix are bits of whole
    numbers, and only the band of 2 * most + 1 diagonals is kept; it moves down one row a column.
    """
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, 0
    while low < len(a) and a[low] == b[low]:
        low += 1
    while high < len(a) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    m, n = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m or n <= most:
        if not m:
            return n
        most_here = n
    else:
        most_here = most
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    # Rows first + 1 .. first + width of the column are in the band; `score` is the value at its lowest row.
    # Above the band (and below it, when it moves) the differences are taken as +1, which never lowers a
    # value inside the band below the true distance along paths within it.
    width, first = min(m, 2 * most_here + 1), 0
    full = (1 << width) - 1
    up, down, score, top_at = full, 0, width, 1 << width - 1
    for j in range(1, n + 1):
        move = min(j - most_here - 1, m - width) - first
        if move > 0:
            up, down = up >> 1 | top_at, down >> 1
            first += 1
            score += 1
        eq = where.get(b[j - 1], 0) >> first & full
        d0 = ((eq & up) + up ^ up | eq | down) & full
        hp = down | full & ~(d0 | up)
        hn = up & d0
        if hp & top_at:
            score += 1
        elif hn & top_at:
            score -= 1
        hp = hp << 1 | 1
        hn <<= 1
        up = (hn | ~(d0 | hp)) & full
        down = hp & d0 & full
    if first + width < m:
        score += m - first - width
    return score if score <= most else most + 1


def bag(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct elements and their counts."""
    return np.unique(a, return_counts=True)


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST, bags: tuple | None = None) -> bool:
    """Whether the edit similarity of two sequences is `least` or more; bags: of both, if they are at hand."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    (x, xn), (y, yn) = bags or (bag(a), bag(b))
    # Every element of the longer sequence without a partner in the other costs an edit at least.
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    if longer - np.minimum(xn, yn[at])[y[at] == x].sum() > most:
        return False
    return banded_distance(a.tolist(), b.tolist(), most) <= most


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in slices([len(t) for t in batch["text"]], CHARS):
            own = batch.iloc[part]
            hashes, number = word_hashes(own["text"].tolist())
            short = (hashes >> np.uint64(32)).astype(np.uint32).astype(np.int32)
            yield pd.DataFrame({"_node": own["_node"].to_numpy(), "_seq": np.split(short, np.cumsum(number)[:-1]), "_sig": [s.tobytes() for s in signatures(hashes, number)]})


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        good = [alike(np.asarray(x), np.asarray(y)) for x, y in zip(batch["_sa"], batch["_sb"], strict=True)]
        yield batch.loc[good, ["_a", "_b"]]


@F.pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    return pd.Series(share_of(*(np.frombuffer(b"".join(s), np.uint64).reshape(-1, BINS // 8) for s in (a, b))) >= ALIKE)


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of all buckets of a partition that is sorted by bucket and blocks."""
    held = None
    for batch in itertools.chain(batches, [None]):
        rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows is None or not len(rows):
            continue
        key = rows[["_value", "_i", "_j"]].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        ends = cuts if batch is not None else np.append(cuts, len(rows))
        held = rows.iloc[cuts[-1] if len(cuts) else 0 :].reset_index(drop=True)
        if not len(ends):
            continue
        sig = np.frombuffer(b"".join(rows["_sig"]), np.uint64).reshape(len(rows), BINS // 8)
        rest = np.stack(rows["_sk"].to_list()), rows["_seq"].to_numpy(), *(rows[c].to_numpy() for c in ("_node", "_comp", "_asks", "_asker"))
        found, start = [], 0
        for end in ends:
            found += _bucket_links(key[start], sig[start:end], *(x[start:end] for x in rest))
            start = end
        yield pd.DataFrame(found, columns=["_a", "_b"]).astype("int64")


def _bucket_links(key: np.ndarray, sig: np.ndarray, sk: np.ndarray, seq: np.ndarray, node: np.ndarray, comp: np.ndarray, asks: np.ndarray, asker: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the links between the components of a block's askers and its members.

    Of two askers the one with the smaller number asks. A pair is looked at in the first bucket that it shares,
    likeliest partners come first, and components that a link has joined are not aligned again.
    """
    rough = np.ascontiguousarray(sig[:, : FEW // 8])
    names, at = np.unique(comp, return_inverse=True)
    parent = list(range(len(names)))
    here = (sk[0] == key[0]).argmax()
    members = np.flatnonzero(~asks)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bags: dict = {}

    def linked(k: int, o: int) -> bool:
        both = [bags[n] if n in bags else bags.setdefault(n, bag(seq[n])) for n in (k, o)]
        return alike(seq[k], seq[o], bags=both)

    found = []
    for k in np.flatnonzero(asks):
        other = members[(at[members] != at[k]) & (~asker[members] | (node[members] > node[k]))]
        other = other[share_of(rough[other], rough[k]) >= ROUGHLY]
        share = share_of(sig[other], sig[k])
        keep = (share >= ALIKE) & ((sk[other] == sk[k]).argmax(1) == here)
        for o in other[keep][np.argsort(-share[keep], kind="stable")]:
            x, y = root(at[k]), root(at[o])
            if x != y and linked(k, o):
                parent[x] = y
                found.append((node[k], node[o]))
    return found


def node_id() -> Column:
    return F.coalesce(F.col("doc_id"), -F.abs(F.xxhash64("text", F.lit("id"))))


def raw_hash() -> Column:
    """Tells the texts of one id apart."""
    return F.when(F.col("text").isNull(), F.xxhash64(node_id(), F.lit("null"))).otherwise(F.xxhash64("text"))


def grouped(docs: DataFrame, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """_doc, _raw, _node, _first (the class's number and smallest id) of every row, and the components of classes
    (node, component) that links join; with `by_id`, different texts of one id are linked too.
    """
    arrow_limits(docs.sparkSession)
    texts = docs.select(node_id().alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("text"), raw_hash().alias("_raw"))
    rows = durable(texts.mapInPandas(_sketched, "_doc long, _raw long, _key long, _key2 long, _n long, _sk array<long>"))
    classes = rows.groupBy("_key", "_key2").agg(F.min("_doc").alias("_first"))
    classes = placed(classes, "_first", "_key", "_key2", name="_node")
    named = durable(rows.select("_doc", "_raw", "_key", "_key2").join(classes, ["_key", "_key2"]).select("_doc", "_raw", "_node", "_first"))
    # One row stands for its class, by its id and text.
    stands = named.filter("_doc = _first").groupBy("_node").agg(F.min(F.struct("_doc", "_raw")).alias("_s")).select("_node", "_s.*")
    firsts = rows.filter("_n > 0").drop("_n", "_key", "_key2").join(stands, ["_doc", "_raw"]).dropDuplicates(["_node"])
    # Sketches carry their function's number, so the value alone names a bucket.
    buckets = firsts.select("_node", "_doc", "_raw", F.explode("_sk").alias("_value")).repartition("_value")
    shared = buckets.groupBy("_value").agg(F.count("*").alias("_size"), F.min("_node").alias("_lead")).filter("_size > 1")
    buckets = durable(buckets.join(shared, "_value"))
    inside = durable(buckets.select("_node", "_doc", "_raw").distinct())
    # Rows that repeat an id and its text give equal sequences, of which one stays.
    seqs = texts.join(small(inside), ["_doc", "_raw"])
    seqs = seqs.select("_node", "text").mapInPandas(_tokens, "_node long, _seq array<int>, _sig binary")
    seqs = durable(seqs.join(firsts.select("_node", "_sk"), "_node").dropDuplicates(["_node"]))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that alignment verifies."""
        one, two = (seqs.select(F.col("_node").alias(f"_{y}"), F.col("_sig").alias(f"_g{y}")) for y in "ab")
        pairs = pairs.join(one, "_a").join(two, "_b").filter(_near("_ga", "_gb")).select("_a", "_b")
        one, two = (seqs.select(F.col("_node").alias(f"_{y}"), F.col("_seq").alias(f"_s{y}")) for y in "ab")
        return pairs.join(one, "_a").join(two, "_b").mapInPandas(_aligned, "_a long, _b long")

    lead = durable(buckets.filter("_node <> _lead").select(F.col("_lead").alias("_a"), F.col("_node").alias("_b")).distinct())
    edges = linked(lead)
    if by_id:
        several = durable(named.groupBy("_doc").agg(F.min("_node").alias("_a"), F.max("_node").alias("_z")).filter("_a <> _z").select("_doc", "_a"))
        edges = edges.unionByName(named.select("_doc", F.col("_node").alias("_b")).join(small(several), "_doc").filter("_a <> _b").select("_a", "_b").distinct())
    edges = durable(edges)
    comps = components(edges, "_a", "_b")

    # Members of the buckets that hold more than one component, with their components; all but the largest ask.
    own = buckets.select("_value", "_node").join(comps, F.col("_node") == F.col("node"), "left").select("_value", "_node", F.coalesce("component", "_node").alias("_comp"))
    sizes = own.groupBy("_value", "_comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("_value").agg(F.sum("n").alias("_size"), F.max(F.struct("n", "_comp")).alias("_most"), F.count("*").alias("m")).filter("m > 1")
    sizes = sizes.select("_value", F.col("_most._comp").alias("_main"), F.ceil(F.col("_size") / ROWS).cast("int").alias("_blocks"), F.ceil((F.col("_size") - F.col("_most.n")) / ROWS).cast("int").alias("_queues"))
    rest = own.join(sizes, "_value").withColumns({"_asker": F.col("_comp") != F.col("_main"), "_h": F.xxhash64("_node", F.lit("block"))})
    member = F.transform(F.sequence(F.lit(0), F.col("_queues") - 1), lambda q: F.struct(F.lit(False).alias("_asks"), F.pmod("_h", "_blocks").cast("int").alias("_i"), q.alias("_j")))
    asking = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: F.struct(F.lit(True).alias("_asks"), b.alias("_i"), F.pmod("_h", "_queues").cast("int").alias("_j")))
    rest = rest.select("_value", "_node", "_comp", "_asker", F.explode(F.when(F.col("_asker"), F.concat(member, asking)).otherwise(member)).alias("_m")).select("_value", "_node", "_comp", "_asker", "_m.*")
    rest = rest.join(seqs, "_node")
    across = rest.repartition("_value", "_i", "_j").sortWithinPartitions("_value", "_i", "_j").mapInPandas(_across, "_a long, _b long")
    links = durable(edges.unionByName(across))
    for done in (buckets, inside, seqs, lead, edges):
        drop_table(done)
    return named, components(links, "_a", "_b")


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (smallest id of equal word sequences), component_id (smallest id that links reach), kept."""
    if least != LEAST:
        raise ValueError("sketches and signatures are sized for a similarity of 0.8")
    named, comps = grouped(docs, by_id=True)
    # Classes are numbered by their smallest ids, so a component's first class has its smallest id.
    firsts = named.select(F.col("_node").alias("component"), F.col("_first").alias("component_id")).join(comps.select("component").distinct(), "component", "left_semi").distinct()
    names = durable(comps.join(firsts, "component").select(F.col("node").alias("_node"), "component_id"))
    out = named.join(small(names), "_node", "left").select("_doc", F.col("_first").alias("class_id"), F.coalesce("component_id", "_first").alias("component_id"))
    return out.select(F.col("_doc").alias("doc_id"), "class_id", "component_id", (F.col("_doc") == F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicate texts: the one with the smallest id; all columns stay.

    Texts of one id are texts of their own here, so that no distinct text goes with another's group; of rows that
    repeat an id and its text one stays.
    """
    named, comps = grouped(docs, by_id=False)
    copies = comps.filter("node <> component").select(F.col("node").alias("_node"), F.lit(True).alias("_copy"))
    rows = named.join(small(durable(copies)), "_node", "left").groupBy("_node", "_doc", "_raw", "_copy").agg(F.count("*").alias("_rows"))
    stands = rows.filter("_copy IS NULL").groupBy("_node").agg(F.min(F.struct("_doc", "_raw")).alias("_s")).select("_node", "_s.*", F.lit(True).alias("_kept"))
    rows = rows.join(stands, ["_node", "_doc", "_raw"], "left").filter("_kept IS NULL OR _rows > 1")
    found = durable(rows.select(F.col("_doc").alias("_d"), F.col("_raw").alias("_r"), F.coalesce("_kept", F.lit(False)).alias("_kept")))
    lost, twice = (small(found.filter(F.col("_kept") == kept).select("_d", "_r")) for kept in (False, True))
    docs = docs.select(F.struct("*").alias("_row"), node_id().alias("_doc"), raw_hash().alias("_raw"))
    same = (F.col("_doc") == F.col("_d")) & (F.col("_raw") == F.col("_r"))
    stay = docs.join(lost, same, "left_anti")
    once = stay.join(twice, same, "left_anti")
    more = stay.join(twice, same, "left_semi").dropDuplicates(["_doc", "_raw"])
    return once.unionByName(more).select("_row.*")
