"""Ranked search, line deduplication and the filter audit against brute force, on small fixtures with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek.llm import audit, lexical, lines

DOC = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
ITEM = "item_id LONG, text STRING"
LABEL = "doc_id LONG, quality INT, toxic INT"
CLASH = ["shard", "term", "block", "rank", "score", "_q", "_lines", "_kept", "high", "hash", "id", "part", "mask", "n", "good"]


def documents(spark, rows):
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    return spark.createDataFrame(rows, DOC).select("*", *[F.lit("x").alias(c) for c in CLASH])


def prose(rng, n, size=60):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), size)}" for _ in range(n))


# --- Ranked search ---


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(lines.LOWER))


def ranked_by_hand(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in own:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, rank + 1, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(3)
    docs = [(i, prose(rng, rng.randrange(1, 60))) for i in range(400)]
    docs += [(400 + i, "Same words HERE, w1 w2") for i in range(30)]
    docs += [(7, docs[7][1]), (900, None), (901, ""), (902, " .,;! "), (None, "w1 w1 w3 Éa"), (903, "é É w1\x00w2 😀 naïve"), (904, prose(rng, 30_000))]
    items = [(0, "w1 w2 w3 w9"), (1, "W1, w1; w40"), (2, "same here"), (3, None), (4, "... "), (None, "É naïve 😀"), (0, "w1 w2 w3 w9"), (5, prose(rng, 40)), (6, "nowhere")]
    return docs, items


@pytest.mark.parametrize("block,shard_bytes,asked", [(4, 2_000, 1 << 20), (128, 24 << 20, 1 << 20), (16, 500, 100)])
def test_search_equals_scores_by_hand(spark, monkeypatch, searched, block, shard_bytes, asked):
    docs, items = searched
    monkeypatch.setattr(lexical, "ASKED_BYTES", asked)
    index = lexical.build(documents(spark, [(i, t, "en") for i, t in docs]), block, shard_bytes)
    found = lexical.search(index, spark.createDataFrame(items, ITEM).withColumn("rank", F.lit("x")), 5)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == ranked_by_hand(docs, items, 5)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_of_empty_tables(spark, searched):
    docs, items = searched
    rows, asked = documents(spark, [(i, t, "en") for i, t in docs]), spark.createDataFrame(items, ITEM)
    assert lexical.search(lexical.build(rows.limit(0)), asked).count() == 0
    assert lexical.search(lexical.build(rows), asked.limit(0)).count() == 0


def whole_shard(texts, block):
    total = sum(len(terms(t)) for t in texts)
    batches = lexical.shard_rows(1, list(range(len(texts))), [t.encode() for t in texts], len(texts), total, block)
    return lexical.Shard(pd.concat([b.to_pandas() for b in batches]), len(texts), total)


def test_blocks_that_cannot_reach_the_threshold_stay_encoded():
    rng = random.Random(1)
    texts = ["common " + prose(rng, 20, 500) for _ in range(5_000)]
    for i in range(40, 52):
        texts[i] = "common rare words here"
    asked = [("common", 1), ("rare", 5_000), ("here", 4_000)]
    shard = whole_shard(texts, 64)
    places, _ = shard.best(asked, 10)
    assert sorted(places.tolist()) == list(range(40, 50))
    first, last = shard.terms["common"]
    decoded = [b for b in shard.open if first <= b < last]
    assert last - first == 79 and len(decoded) <= lexical.AHEAD
    every = whole_shard(texts, 64)
    every.best(asked, 10_000)
    assert sum(first <= b < last for b in every.open) == 79


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=12), min_size=1, max_size=60), st.integers(1, 9), st.integers(1, 5), st.integers(0, 3))
def test_pointers_find_what_all_scores_give(docs, k, block, cut):
    shard = whole_shard([" ".join(f"w{w}" for w in d) for d in docs], block)
    asked = [(f"w{w}", 1 + w % 3) for w in range(13)]
    sums = np.zeros(len(docs), np.int64)
    for t, w in asked:
        for b in range(*shard.terms.get(t, (0, 0))):
            place, worth = shard.postings(b)
            sums[place] += w * worth
    order = [i for i in sorted(range(len(docs)), key=lambda i: (-sums[i], i)) if sums[i] > 0][:k]
    least = int(sorted(sums)[-min(cut, len(docs))]) if cut else 0
    places, scores = shard.best(asked, k, least)
    assert places.tolist() == [i for i in order if sums[i] >= least] and scores.tolist() == sums[places].tolist()


@given(st.lists(st.integers(0, (1 << 35) - 1), min_size=1, max_size=50))
def test_codes_are_read_back(values):
    codes, at = lexical.encoded(np.array(values))
    assert lexical.decoded(codes.tobytes()).tolist() == values and at[-1] == len(codes)


def test_a_shard_keeps_words_apart():
    texts = [b"Ab-cd \xc3\xa9\xc3\x89", b"", b"x" * 3_000_000 + b" ab", b"AB ab\x00ab"]
    data, hashes, starts, sizes, owner = lexical.shard_words(texts)
    own = [data[s : s + n].tobytes() for s, n in zip(starts, sizes, strict=True)]
    assert own == [b"ab", b"cd", b"\xc3\xa9\xc3\x89", b"x" * 3_000_000, b"ab", b"ab", b"ab", b"ab"]
    assert owner.tolist() == [0, 0, 0, 2, 2, 3, 3, 3] and len(set(hashes.tolist())) == 4


# --- Lines ---


def without_by_hand(docs):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(lines.LOWER)
    held = {}
    for n, (i, text) in enumerate(docs):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append((i is not None, i or 0, n))
    last = {k: max(x)[:2] for k, x in held.items() if len(x) >= 5}
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if last.get(key(x), (i is not None, i or 0)) == (i is not None, i or 0)]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(8)
    shared = [f"This line number {n} stands in many documents é" + "x" * (n % 3) for n in range(60)]
    docs = []
    for i in range(300):
        own = rng.choices(shared, k=rng.randrange(4)) + [f"a line of document {i} alone, long enough to count {j}" for j in range(3)] + ["short"] * 2
        rng.shuffle(own)
        docs.append((i, "\n".join(rng.choice(("", " ", "\t\r")) + (x.upper().replace("É", "é") if rng.random() < 0.3 else x) + rng.choice(("", "\x0b ")) for x in own)))
    docs += [(i, shared[0]) for i in range(1_000, 1_400)]
    docs += [(299, docs[299][1]), (None, shared[1] + "\n" + shared[2]), (None, None), (2_000, ""), (2_001, "\n\n"), (2_002, "z" * 300_000 + "\n" + shared[0] + "\n" + shared[0])]
    docs += [(i, "é" * 39 + "\n" + "é" * 40 + "\nİ" + "a" * 45) for i in range(3_000, 3_006)]
    return docs


@pytest.mark.parametrize("most,shard_keys", [(64 << 20, 1 << 20), (64 << 20, 7), (2_000, 7), (0, 7)])
def test_lines_equal_counting_by_hand(spark, lined, most, shard_keys):
    found = lines.deduplicated(documents(spark, [(i, t, "en") for i, t in lined]), most=most, shard_keys=shard_keys)
    assert sorted((tuple(r) for r in lines.digests(found).collect()), key=repr) == without_by_hand(lined)


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_lines_of_an_empty_table(spark, lined, most):
    assert lines.deduplicated(documents(spark, [(i, t, "en") for i, t in lined]).limit(0), most=most).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.tuples(st.integers(-(1 << 63), (1 << 63) - 1), st.integers(-(1 << 63), (1 << 63) - 1)), max_size=300))
def test_the_hash_is_minimal_and_perfect(keys):
    own = np.array(sorted(keys), np.int64).reshape(-1, 2)
    bits, sizes = lines.minimal_hash(own[:, 0].copy(), own[:, 1].copy())
    slots = lines.Table(bits, sizes, b"").slots(own[:, 0].copy(), own[:, 1].copy())
    assert sorted(slots.tolist()) == list(range(len(keys)))


def test_the_hash_is_small_and_tells_strangers():
    rng = np.random.default_rng(4)
    own, other = rng.integers(-(1 << 63), (1 << 63) - 1, (2, 50_000, 2))
    bits, sizes = lines.minimal_hash(own[:, 0].copy(), own[:, 1].copy())
    assert sum(sizes) / len(own) < 3.6
    entries = np.zeros(len(own), lines.ENTRY)
    slot = lines.Table(bits, sizes, b"").slots(own[:, 0].copy(), own[:, 1].copy())
    entries["mark"][slot], entries["count"], entries["last"] = own[:, 1].view(np.uint64), 9, 5
    table = lines.Table(bits, sizes, entries.tobytes())
    ids = np.where(np.arange(len(own)) % 2, 5, 6)
    assert table.dropped(own[:, 0].copy(), own[:, 1].copy(), ids, 5).tolist() == (ids != 5).tolist()
    assert not table.dropped(other[:, 0].copy(), other[:, 1].copy(), ids, 5).any()


# --- Filter audit ---


def audited_by_hand(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = {
        "A": lambda w, t, i: len(w) < 200,
        "B": lambda w, t, i: 100 * len(set(w)) < 50 * len(w),
        "C": lambda w, t, i: 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
        "D": lambda w, t, i: bool(re.search(r"[#$%&*|]", t)),
        "E": lambda w, t, i: any((i is not None, i or 0) > (j is not None, j or 0) for j, u, _ in docs if (u or "") == t),
    }
    rows = [(i, lang or "", {f for f, test in fails.items() if test(re.findall(r"[^\x20\x09-\x0D]+", t or ""), t or "", i)}) for i, t, lang in docs]
    out = {}
    for part in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shapley[f] += len(removed)
                failing = sum(f in r[2] for r in own)
                out[part, order, step] = [len(left), len(removed), failing - len(removed), sum(r[2] == {f} for r in own), sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_equals_applying_the_filters(spark):
    rng = random.Random(2)
    docs = []
    for i in range(1, 240):
        n = rng.choice((20, 199, 200, 260))
        text = " ".join(rng.choice((f"w{rng.randrange(rng.choice((60, 900)))}", "Word")) for _ in range(n)) + rng.choice(("", "", " #", " 50%"))
        docs.append((i, text, rng.choice(("en", "fr", None))))
    docs += [(240 + i, docs[i % 9][1], rng.choice(("en", "de"))) for i in range(60)]
    docs += [(3, docs[2][1], "de"), (3, docs[2][1], "en"), (None, docs[4][1], "en"), (None, None, None), (400, None, ""), (401, "", "en"), (402, " x y", "en"), (403, "w " * 20_000, "fr")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 1, 1), (None, 1, 1)]
    found = audit.audit(documents(spark, docs), spark.createDataFrame(labels, LABEL).withColumn("n", F.lit("x"))).collect()
    assert len(found) == 600 * len({lang or "" for _, _, lang in docs})
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in found} == audited_by_hand(docs, [x for x in labels if x[0] is not None])


def test_audit_of_empty_tables(spark):
    docs, labels = documents(spark, [(1, "a b", "en")]), spark.createDataFrame([(1, 1, 1)], LABEL)
    assert audit.audit(docs.limit(0), labels).count() == 0
    row = audit.audit(docs, labels.limit(0)).filter("filter_order = 'ABCDE' AND step = 1").first()
    assert (row["kept"], row["removed"], row["good_lost"], row["shapley"]) == (0, 1, 0, 120)


def test_matrices_are_incidences():
    by = audit.matrices()
    assert all(m.shape == (32, 600) for m in by.values())
    assert ((by["removed"] + by["redundant"]).sum(1) == [120 * bin(m).count("1") for m in range(32)]).all()
    assert (by["shapley"][31] == 24).all()
