"""Joins in time and block-max search against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.operators import blocks, rank
from sparkseek.operators.blocks import BlockIndex
from sparkseek.operators.index import build_index
from sparkseek.operators.temporal import asof_join, overlap_join, overlap_totals
from sparkseek.streaming import stateful

ROW = "user STRING, at INT, id INT"


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("parts", [1, 7])
def test_asof_join_equals_looking_back(spark, strict, parts):
    rng = random.Random(parts)
    # One user has half of all rows, and times repeat.
    user = lambda: rng.choice(["hot", "hot", "hot", "a", "b", "c", None])
    left, right = ([(user(), rng.choice([None, *range(60)]) if rng.random() < 0.1 else rng.randrange(400), i) for i in range(n)] for n in (500, 150))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = asof_join(spark.createDataFrame(left, ROW).withColumn("match_", F.lit(1)), spark.createDataFrame(right, ROW), "user", "at", "id", strict).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = {}
    for u, at, i in left:
        own = [(t, j) for v, t, j in right if u is not None and at is not None and v == u and t is not None and (t < at if strict else t <= at)]
        expected[i] = max(own)[1] if own else None
    assert {r["id"]: r["match"] and r["match"]["id"] for r in rows} == expected and len(rows) == 500 and sum(x is not None for x in expected.values()) > 300


def test_asof_join_of_empty_sides(spark):
    some, none = spark.createDataFrame([("a", 1, 1)], ROW), spark.createDataFrame([], ROW)
    assert asof_join(none, some, "user", "at", "id").count() == 0
    assert [r["match"] for r in asof_join(some, none, "user", "at", "id").collect()] == [None]


SPAN = "k STRING, start DOUBLE, end DOUBLE, id INT"


@pytest.mark.parametrize("by", [(), ("k",)])
def test_overlap_join_gives_each_pair_once(spark, by):
    rng = random.Random(7)

    def spans(n):
        rows = []
        for i in range(n):
            s = rng.choice([rng.uniform(-50, 300), 10.0 * rng.randrange(20)])
            rows.append((rng.choice(["x", "y", None]), s, s + rng.choice([0.0, 5.0, 10.0, 90.0, rng.expovariate(0.1), -3.0]), i))
        return rows + [(None, None, 5.0, n), ("x", 3.0, None, n + 1)]

    left, right = spans(150), spans(120)
    found = overlap_join(spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN), 10.0, by)
    pairs = sorted((r["a"]["id"], r["b"]["id"]) for r in found.collect())
    good = lambda r: r[1] is not None and r[2] is not None and r[1] < r[2]
    expected = sorted((a[3], b[3]) for a in left for b in right if good(a) and good(b) and a[1] < b[2] and b[1] < a[2] and (not by or (a[0] is not None and a[0] == b[0])))
    assert pairs == expected and len(expected) > 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_join_of_timestamps(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = spark.createDataFrame([(at(1), at(3), 1), (at(2), at(2, 30), 2), (at(3), at(4), 3)], "start TIMESTAMP, end TIMESTAMP, id INT")
    found = overlap_join(rows, rows, 3600.0).filter("a.id < b.id").collect()
    assert [(r["a"]["id"], r["b"]["id"]) for r in found] == [(1, 2)]


def test_followed_by_and_turns_of_tables(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    left = spark.createDataFrame([("u", at(0), 1), ("u", at(40), 2), (None, at(0), 3)], "user STRING, at TIMESTAMP, id INT")
    right = spark.createDataFrame([("u", at(0), 11), ("u", at(30), 12), ("u", at(31), 13), ("v", at(1), 14)], "user STRING, at TIMESTAMP, id INT")
    found = stateful.followed_by(left, right, "user").collect()
    assert sorted((r["left_id"], r["right_id"] or 0) for r in found) == [(1, 11), (1, 12), (2, 0), (3, 0)]
    urls = spark.createDataFrame([("http://h/a", 1, 0), ("http://h/b", 2, 0), ("http://h/c", 3, 9), ("http://g/a", 4, 1), (None, 5, 1)], "url STRING, seq LONG, s INT").withColumn("at", F.timestamp_seconds("s"))
    turns = {r["url"]: r["turn"] for r in stateful.turns_of(urls, 2000).collect()}
    assert turns == {"http://h/a": 0, "http://h/b": 2000, "http://h/c": 9000, "http://g/a": 1000}


# --- Block-max search ---


@pytest.fixture(scope="module")
def posted(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(40)], k=rng.randrange(1, 50))) for _ in range(1500)]
    texts[300:330] = ["w39 w38 w1"] * 30  # equal scores
    texts[700:705] = ["w37 w36 w35 " * 6] * 5
    rows = [(i * 3, "", "", "", t, 0) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "doc_id LONG, url STRING, final_url STRING, title STRING, clean_text STRING, geology_score INT")
    return build_index(pages, "raw").settled()


@pytest.mark.parametrize("size,k", [(16, 10), (256, 10), (64, 1), (100_000, 7)])
def test_block_max_equals_bm25(spark, posted, size, k):
    asked = ["w39 w38", "w1", "w37 w36 w35", "w0 w1 w2 w3", "w39 w39 w5", "nowhere", "", None, "w38 nowhere"]
    index = BlockIndex.build(posted, size)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id INT, text STRING")
    found = {}
    for r in blocks.top_k(index, queries, k).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], round(r["score"], 9)))
    for n, text in enumerate(asked):
        expected = rank.bm25(posted, text, k).collect() if text else []
        assert sorted(found.get(n, [])) == [(i, r["doc_id"], round(r["score"], 9)) for i, r in enumerate(expected, 1)], text


def test_no_table_has_a_row_for_a_query_and_a_range(spark, posted, monkeypatch):
    """Several passes; every query meets every range."""
    written = []

    def durable(df, own=blocks.durable):
        written.append(own(df))
        return written[-1]

    monkeypatch.setattr(blocks, "durable", durable)
    monkeypatch.setattr(blocks, "PASS", 25)
    index = BlockIndex.build(posted, 16)
    queries = spark.createDataFrame([(i, f"w0 w{i}") for i in range(40)], "query_id INT, text STRING")
    found = {}
    for r in blocks.top_k(index, queries, 3).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    for i in (0, 7, 39):
        assert sorted(found[i]) == list(enumerate((r["doc_id"] for r in rank.bm25(posted, f"w0 w{i}", 3).collect()), 1))
    ranges = index.blocks.select("range").distinct().count()
    assert max(t.count() for t in written) <= max(ranges, 80) < 40 * ranges


def test_blocks_below_the_threshold_are_not_read(spark, posted, tmp_path):
    BlockIndex.build(posted, 16).save(str(tmp_path))
    index = BlockIndex.load(spark, str(tmp_path), "raw")
    queries = spark.createDataFrame([(1, "w37 w36 w35"), (2, "w0 w37"), (3, "w0")], "query_id INT, text STRING")
    shares = {r["query_id"]: r["n_read"] / r["n_blocks"] for r in blocks.share_read(index, queries, 5).collect()}
    assert shares[1] < 0.05 and shares[2] < 0.3 and 0 < shares[3] < 1
    bounds = blocks.bounds(index, blocks.asked(index, queries))
    assert bounds.filter("bound <= 0").count() == 0


@pytest.mark.parametrize("n, most", [(300, 100), (300, 5), (20_000, 1_000_000)])
def test_overlap_totals_equal_all_pairs(spark, n, most):
    """The last case has some 130 million pairs, of which none may be made."""
    rng = np.random.default_rng(n + most)
    start = rng.integers(0, most, n)
    end = start + rng.integers(-1, most, n)
    rows = spark.createDataFrame([(i, int(s), int(e)) for i, (s, e) in enumerate(zip(start, end, strict=True))] + [(n, None, 3)], "id LONG, start LONG, end LONG")
    found = {r["id"]: (r["n"], r["shared"]) for r in overlap_totals(rows).collect()}
    assert found.keys() == set(np.flatnonzero(start < end).tolist())
    kept = start < end
    for i in list(found)[:300]:
        time = np.minimum(end[i], end[kept]) - np.maximum(start[i], start[kept])
        assert found[i] == ((time > 0).sum() - 1, time[time > 0].sum() - (end[i] - start[i]))


def test_ranges_are_saved_with_one_shuffle(spark, tmp_path, monkeypatch):
    """Texts are shuffled once, by range, and saved ranges answer as the blocks do."""
    from sparkseek.operators import index as indexing

    docs = spark.createDataFrame([(i * 37, " ".join(f"w{(i * j) % 23}" for j in range(1 + i % 9))) for i in range(80)] + [(4000, None)], "doc_id LONG, text STRING")
    pages = docs.selectExpr("doc_id", "'' AS url", "'' AS final_url", "'' AS title", "text AS clean_text", "0 AS geology_score")
    found = indexing.build_index(pages, "raw").settled()
    monkeypatch.setattr(blocks, "FILE_RANGES", 1)
    own = blocks.with_ranges(found, docs, 16)
    plan = blocks.range_rows(own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    BlockIndex.save_ranges(own, str(tmp_path))
    queries = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w22 none"), (3, "")], "query_id LONG, text STRING")
    rows = lambda x: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in blocks.top_k(x, queries).collect())
    loaded = BlockIndex.load_ranges(spark, str(tmp_path), "raw")
    assert rows(loaded) == rows(BlockIndex.build(found, 16)) and len(rows(loaded)) > 10
    assert loaded.blocks.count() == BlockIndex.build(found, 16).blocks.count()
