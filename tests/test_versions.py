"""Versioned folders and what stands on them: index segments, sets of seen URLs, and crawls that are lost midway."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from sparkseek.operators import crawl, rank, seen
from sparkseek.operators.index import build_index
from sparkseek.operators.seen import SeenSet
from sparkseek.operators.segments import SegmentedIndex
from sparkseek.sources import pages as files
from sparkseek.sources.versions import Versions

WORDS = "fault rock lava ash quartz basin ridge plate".split()


def pages(spark, texts):
    rows = [(i, f"http://h/{i}", "", f"title {i}", t, 0) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id LONG, url STRING, final_url STRING, title STRING, clean_text STRING, geology_score INT")


def text(rng):
    return " ".join(rng.choices(WORDS, k=rng.randrange(12)))


def state(index):
    """All that an index says, as plain values."""
    posted = {(r["term"], r["doc_id"]): r["tf"] for r in index.postings.collect()}
    stored = {r["doc_id"]: tuple(r) for r in index.doc_store.select("doc_id", "url", "title", "clean_text_preview", "doc_len").collect()}
    n, avg_dl = index.stats.first()
    return posted, stored, n, pytest.approx(avg_dl)


# --- Versions ---


def test_a_version_exists_when_its_document_is_in_place(spark, tmp_path):
    own = Versions(spark, str(tmp_path))
    assert own.latest() == 0 and own.read() == {} and own.vacuum() == []
    for n in (1, 2, 3):
        spark.range(n).write.parquet(own.at(f"t-{n}"))
        assert own.commit(own.latest() + 1, {"t": f"t-{n}"}, [f"t-{n}"]) == n
    spark.range(1).write.parquet(own.at("orphan"))
    assert own.read()["t"] == "t-3" and own.read(1)["t"] == "t-1" and own.all() == [1, 2, 3]
    with pytest.raises(FileExistsError):
        own.commit(3, {}, [])
    assert own.vacuum(keep=2) == ["orphan", "t-1"] and own.all() == [2, 3]
    assert spark.read.parquet(own.at("t-2")).count() == 2 and own.read()["t"] == "t-3"


# --- Segments ---


@pytest.mark.parametrize("analyzer", ["full"])
def test_segments_equal_an_index_built_anew(spark, tmp_path, analyzer):
    rng, live = random.Random(5), {}
    own = SegmentedIndex(spark, str(tmp_path), analyzer, fanout=2)
    assert own.snapshot().stats.first()["n"] == 0 and own.snapshot().postings.count() == 0
    past = {}
    for batch in range(4):
        added = {i: text(rng) for i in rng.sample(range(40), 15)}
        live |= added
        own.add(pages(spark, added))
        if batch:
            gone = rng.sample(range(60), 12)
            live = {i: t for i, t in live.items() if i not in gone}
            own.delete(spark.createDataFrame([(i,) for i in gone], "doc_id LONG"))
        past[own.versions.latest()] = dict(live)
        if batch == 2:
            own.merge()
            assert len(own.versions.read()["segments"]) < 3
    expected = state(build_index(pages(spark, live), analyzer))
    assert state(own.snapshot()) == expected
    version = own.merge()
    after = own.versions.read()
    assert state(own.snapshot()) == expected and own.merge() == version
    tiers = [int(math.log2(s["docs"])) for s in after["segments"]]
    assert len(set(tiers)) == len(tiers)
    assert all(t["seq"] > min(s["seq"] for s in after["segments"]) for t in after["tombstones"])
    for v, texts in past.items():
        assert state(own.snapshot(v)) == state(build_index(pages(spark, texts), analyzer))
    found = rank.bm25(own.snapshot(), "fault lava", 5).collect()
    assert found == rank.bm25(build_index(pages(spark, live), analyzer), "fault lava", 5).collect() and found


def test_a_reader_keeps_its_segments_until_they_are_vacuumed(spark, tmp_path):
    own = SegmentedIndex(spark, str(tmp_path), "raw", fanout=2)
    own.add(pages(spark, {1: "fault", 2: "rock"}))
    reader = own.snapshot()
    own.add(pages(spark, {1: "lava", 3: "ash"}))
    own.delete(spark.createDataFrame([(2,)], "doc_id LONG"))
    own.merge()
    assert sorted(r["term"] for r in reader.postings.filter("length(term) > 1").collect()) == ["fault", "rock", "title", "title"]
    assert own.vacuum(keep=1) and state(own.snapshot())[2] == 2
    own.delete(spark.createDataFrame([(1,), (3,), (None,)], "doc_id LONG"))
    assert state(own.snapshot())[:3] == ({}, {}, 0)
    own.add(pages(spark, {1: "plate"}))
    assert ("plate", 1) in state(own.snapshot())[0]


def test_a_batch_with_an_id_twice_is_refused(spark, tmp_path):
    own = SegmentedIndex(spark, str(tmp_path), "raw")
    own.add(pages(spark, {1: "fault"}))
    with pytest.raises(ValueError, match="twice"):
        own.add(pages(spark, {2: "rock"}).union(pages(spark, {2: "lava"})))
    assert own.versions.latest() == 1 and state(own.snapshot())[2] == 1


def test_a_lost_writer_leaves_the_last_version(spark, tmp_path, monkeypatch):
    own = SegmentedIndex(spark, str(tmp_path), "raw", fanout=2)
    own.add(pages(spark, {1: "fault", 2: "rock"}))
    own.add(pages(spark, {3: "ash", 4: "ash ash"}))
    before = state(own.snapshot())
    for action in (lambda: own.add(pages(spark, {1: "lava"})), lambda: own.delete(spark.createDataFrame([(2,)], "doc_id LONG")), own.merge):
        with monkeypatch.context() as m:
            m.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                action()
        assert state(own.snapshot()) == before
    # Two segments and two tables of tombstones of lost writers, and one without rows that no version has named.
    assert len(own.vacuum(keep=1)) == 5
    own.add(pages(spark, {1: "lava"}))
    assert ("lava", 1) in state(own.snapshot())[0] and ("fault", 1) not in state(own.snapshot())[0]


# --- Seen sets ---


def urls(spark, hosts, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("http://h"), F.col("id") % hosts, F.lit(".example/p/"), "id").alias("url"))


def read_bytes(own, monkeypatch, asked):
    """Bytes of the cells that an answer reads, and the answer."""
    read = []
    plain = own.spark.read.__class__.parquet
    monkeypatch.setattr(own.spark.read.__class__, "parquet", lambda self, *paths, **more: (read.extend(p for p in paths if "/cells/" in p), plain(self, *paths, **more))[1])
    found = sorted(r["url"] for r in own.new(asked).collect())
    monkeypatch.undo()
    fs, path = own.versions._fs, own.versions._path
    return sum(fs.getContentSummary(path(p)).getLength() for p in read), found


def test_unseen_equals_the_anti_join_and_reads_what_it_must(spark, tmp_path, monkeypatch):
    small, large = SeenSet(spark, str(tmp_path / "s"), buckets=64, cell=500), SeenSet(spark, str(tmp_path / "l"), buckets=64, cell=500)
    small.add(urls(spark, 200, 4_000))
    for own, more in ((small, 0), (large, 40_000)):
        if more:
            own.add(urls(spark, 200, 4_000).union(urls(spark, 3_000, more, 1_000_000).withColumn("url", F.concat("url", F.lit("x")))))
    asked = urls(spark, 1, 300).union(urls(spark, 200, 3, 3_990)).union(urls(spark, 200, 30, 3_995)).union(spark.createDataFrame([(None,), ("no address",), ("no address",)], "url STRING"))
    expected = {r["url"] for r in asked.collect() if r["url"]} - {r["url"] for r in urls(spark, 200, 4_000).collect()}
    few, found = read_bytes(small, monkeypatch, asked)
    many, also = read_bytes(large, monkeypatch, asked)
    assert found == also == sorted(expected)
    whole = lambda own: own.versions._fs.getContentSummary(own.versions._path(own.versions.folder)).getLength()
    assert whole(large) > 5 * whole(small) and many < whole(large) / 5
    # The larger set's cells are at most `cell` URLs, however many it holds.
    rows = spark.read.schema(seen.FILTERS).parquet(large.versions.at(large.state()["runs"][0]["name"]) + "/filters").agg(F.max("n"), F.sum("n")).first()
    assert rows[0] < 700 and rows[1] == 44_000


def test_runs_are_merged_by_size_and_keep_their_values(spark, tmp_path):
    own = SeenSet(spark, str(tmp_path), buckets=8, cell=50, fanout=2)
    for i in range(5):
        batch = urls(spark, 7, 40, 20 * i)
        own.add(own.new(batch))
    assert own.new(urls(spark, 7, 130)).count() == 10 and own.all().count() == own.all().distinct().count() == 120
    assert len(own.state()["runs"]) <= 3 and own.add(own.new(urls(spark, 7, 5))) == 6
    assert own.vacuum() and own.all().count() == 120


def test_filters_take_one_other_value_in_a_hundred_for_their_own():
    high, low = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, (2, 30_000))
    size = 10 * seen.BITS * 1_000
    bits = seen.filter_of(high[:10_000], low[:10_000], size)
    assert seen.may_hold(bits, high[:10_000], low[:10_000], size).all()
    share = seen.may_hold(bits, high[10_000:], low[10_000:], size).mean()
    assert share < 0.012 and share == pytest.approx(seen.false_share(10_000, size), rel=0.25)


# --- Crawls ---

BODY = "fault volcano mineral earthquake tectonic igneous " * 8


@pytest.fixture
def site(spark):
    """url, text and links of a small site; /c has the text of /b."""
    pages = {"/": ("start", ["/a", "/b", "/gone"]), "/a": ("a", ["/", "/c", "/d"]), "/b": ("b", []), "/c": ("b", []), "/d": ("d", ["/e"]), "/e": ("e", [])}
    asked = []
    html = {f"http://site{p}": f"<html><head><title>Fault</title></head><body><p>{BODY} {t}</p>{''.join(f'<a href={u!r}>{u}</a>' for u in links)}</body></html>" for p, (t, links) in pages.items()}

    def retrieve(urls):
        own = sorted(r["url"] for r in urls.collect())
        asked.append(own)
        rows = [(u, u, html.get(u), 200 if u in html else 404, "text/html", 1.0) for u in own]
        return spark.createDataFrame(rows, "url STRING, final_url STRING, html STRING, status INT, content_type STRING, fetch_time DOUBLE")

    return retrieve, asked


def crawled(spark, site, folder, rounds=9):
    none = spark.createDataFrame([], "origin STRING, status INT, body STRING")
    return crawl.crawl(spark, spark.createDataFrame([("http://site/",)], "url STRING"), folder, rounds, 3, None, site[0], lambda urls: none, buckets=2)


def outcome(spark, folder):
    own = crawl.Crawl(spark, folder, 2)
    rows = own.pages().orderBy("doc_id").collect()
    return [(r["doc_id"], r["url"]) for r in rows], own.now["stats"], sorted(r["url"] for r in own.known.all(own.now["known"]).collect()), own.hashes.all(own.now["hashes"]).count(), own.read(own.now["frontier"]).count()


@pytest.fixture(scope="module")
def undisturbed(spark, tmp_path_factory):
    return {}


#: Which write of a crawl breaks: an export, and the version that names it.
BREAKS = ["pages_batch_0002", "version 5"]


@pytest.mark.parametrize("at", BREAKS)
def test_a_crawl_that_is_lost_anywhere_loses_and_repeats_nothing(spark, site, undisturbed, tmp_path, monkeypatch, at):
    if not undisturbed:
        crawled(spark, site, str(tmp_path / "whole"))
        undisturbed["whole"] = outcome(spark, str(tmp_path / "whole"))
        undisturbed["asked"] = sorted(u for own in site[1] for u in own)
        site[1].clear()
    folder, lost = str(tmp_path / "lost"), []

    def breaking(plain, names):
        def call(self, *args, **more):
            if not lost and names(*args):
                lost.append(at)
                if plain is not Versions.commit:
                    plain(self, *args, **more)
                raise OSError("lost")
            return plain(self, *args, **more)

        return call

    plain_commit = Versions.commit
    for method in ("parquet", "json", "text"):
        monkeypatch.setattr(DataFrameWriter, method, breaking(getattr(DataFrameWriter, method), lambda path, *_: at in path))
    monkeypatch.setattr(Versions, "commit", lambda self, version, *rest: (_ for _ in ()).throw(OSError("lost")) if at == f"version {version}" and not lost and not lost.append(at) else plain_commit(self, version, *rest))
    with pytest.raises(OSError, match="lost"):
        crawled(spark, site, folder)
    crawled(spark, site, folder)
    assert outcome(spark, folder) == undisturbed["whole"]
    ids = [i for i, _ in undisturbed["whole"][0]]
    assert ids == list(range(1, 6)) and len(crawl.Crawl(spark, folder).now["batches"]) == 4
    # These are lost after their round's pages are in place, so none is retrieved again.
    again = sorted(u for own in site[1] for u in own)
    assert again == undisturbed["asked"]
    assert files.load_edges(spark, folder).count() == 7
