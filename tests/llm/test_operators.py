"""Each training-data operator against brute force, round trips or held-out rows, on small fixtures."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek import session
from sparkseek.llm import chat, components, decontaminate, language, mixing, order_minhash, personal_data, product_quantisation, quality, sharding, toxicity
from sparkseek.llm import queries as llm
from tests.oracle import compare, database

DOC = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(n, seed, size=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, wordless and very long texts, repeated rows, and columns that clash with inner names."""
    rows = [
        (1, "plain text of seven words stands here", "en", "a", 1),
        (1, "plain text of seven words stands here", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "", "", 0),
        (4, "!!! ... ###", "fr", "a", 3),
        (None, "row without an id but with words", None, "b", 5),
        (None, None, None, None, None),
        (5, " ".join(words(60_000, 1)), "en", "b", 9),
        (6, "é" * 20_000, "fr", "b", 9),
        (7, "1" * 30_000 + "@", "en", "b", 9),
        (8, "one", "en", "c", 3),
    ]
    clash = ["_place", "_row", "_slot", "shard", "score", "row", "block", "_node", "_hit", "source_", "lang_pred"]
    return spark.createDataFrame(rows, DOC).select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (5, 1, 0), (8, 0, 1), (8, 0, 1)], "doc_id LONG, quality INT, toxic INT")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "plain text of seven words stands here"), (2, None), (3, ""), (None, "one"), (1, "plain text of seven words stands here")], "item_id LONG, text STRING")


# --- Odd input ---


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_pass_every_operator(spark, odd, labels, items, empty):
    docs, labels, items = (t.limit(0) if empty else t for t in (odd, labels, items))
    n = 0 if empty else 11
    for found in (language.identified(docs), quality.scored(docs, labels), toxicity.scored(docs, labels), personal_data.find(docs), sharding.assign(docs), order_minhash.near_duplicates(docs)):
        assert found.count() == n
    mixed = mixing.mixed(docs)
    assert mixed.count() == n and mixed.columns == docs.columns
    pairs = {(r["doc_id"], r["item_id"]) for r in decontaminate.containment(docs, items).collect()}
    assert pairs == (set() if empty else {(1, 1), (8, None)})
    clean = decontaminate.decontaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == (0 if empty else 8)
    once = order_minhash.deduplicated(docs)
    assert once.columns == docs.columns and once.count() == (0 if empty else 10)
    known = language.accepted(docs)
    assert known.columns == docs.columns
    sharded = sharding.shard_documents(docs)
    assert sharded.count() == n and {"shard", "place"} <= set(sharded.columns)


def test_odd_documents_have_their_defined_results(spark, odd):
    unknown = {r["doc_id"] for r in language.identified(odd).filter("lang_pred = 'und' AND score = 0").collect()}
    assert {2, 3, 4} <= unknown and 5 not in unknown
    spans = {r["doc_id"]: r["base_sha256"] for r in personal_data.find(odd).collect()}
    assert spans[2] == spans[3] == hashlib.sha256(b"").hexdigest()
    same = {r["doc_id"]: r["component_id"] for r in order_minhash.near_duplicates(odd).filter("doc_id IS NOT NULL").collect()}
    assert all(k == v for k, v in same.items())
    size = {r["doc_id"]: r["size"] for r in sharding.assign(odd).collect()}
    assert size[2] == 1 and size[6] == 40_001


def test_no_labels_give_neutral_scores(spark, odd, labels):
    assert {r["score"] for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert {round(r["score"], 6) for r in toxicity.scored(odd, labels.limit(0)).collect()} == {0.1}


# --- Language ---


def test_windows_cover_every_byte():
    data = [bytes(random.Random(n).randrange(256) for _ in range(n)) for n in (0, 1, 511, 512, 513, 3000)]
    rows, counts = language.windows(data)
    at = 0
    for x, n in zip(data, counts, strict=True):
        assert b"".join(r[: language.WINDOW].tobytes() for r in rows[at : at + n])[: len(x)] == x
        for a, b in zip(rows[at : at + n], rows[at + 1 : at + n], strict=False):
            assert (a[language.WINDOW :] == b[: language.OVERLAP]).all()
        at += n


def test_pair_tables_equal_the_plain_convolution():
    net = language.Network(["a", "b"])
    rows, _ = language.windows([b"some text", b"x" * 700])
    pooled = []
    for w, table, bias in zip(language.WIDTHS, net.tables, net.bias, strict=True):
        total = sum(table[j][rows[:, j : j + language.WINDOW]] for j in range(w))
        pooled.append(total.max(1) + bias)
    logits = np.maximum(np.concatenate(pooled, 1), 0) @ net.out + net.last
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    assert np.allclose(net.probabilities(rows, net.pairs()), p, atol=1e-5)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


# --- Vectors ---


def _brute_links(x, least=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None], len(x)).min(1))
        if (new == label).all():
            return near.sum(1), label
        label = new


@pytest.mark.parametrize("dims", [64, 5])
def test_vector_links_equal_all_pairs(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(150, dims))
    near = base[rng.integers(0, 40, 350)]
    x = np.concatenate([base, near + rng.normal(size=near.shape) * 0.25 * np.linalg.norm(near, axis=1, keepdims=True) / np.sqrt(dims), base[:20], base[:1].repeat(60, 0)]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id LONG, embedding ARRAY<FLOAT>")
    found = product_quantisation.linked_vectors(rows).orderBy("vec_id").collect()
    links, label = _brute_links(x.astype(np.float64))
    recall = sum(r["n_links"] for r in found) / links.sum()
    assert 0.999 <= recall <= 1
    assert [r["component_id"] for r in found] == label.tolist()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_two_levels_of_cells_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(product_quantisation, "FINE", 4)
    rng = np.random.default_rng(77)
    base = rng.normal(size=(700, 16))
    x = np.concatenate([base, base[:300] + 0.05 * rng.normal(size=(300, 16))]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id LONG, embedding ARRAY<FLOAT>")
    found = product_quantisation.linked_vectors(rows).orderBy("vec_id").collect()
    links, label = _brute_links(x.astype(np.float64))
    assert [(r["n_links"], r["component_id"]) for r in found] == list(zip(links.tolist(), label.tolist(), strict=True))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 0.0]), (None, [5.0, -1.0])]
    found = product_quantisation.linked_vectors(spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").withColumn("node", F.lit(1))).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found if r["vec_id"]) == sorted([(1, 4, 1), (2, 4, 1), (9, 4, 1), (9, 4, 1), (10, 4, 1), *((i, 0, i) for i in range(3, 9))])
    assert product_quantisation.linked_vectors(spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>")).count() == 0


# --- Chat ---


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab<|\\n\n>im_stardeuo ", max_size=12), st.text("ab<|\\n\n>im_end ", max_size=20)), max_size=5))
def test_turns_are_read_back(turns):
    text = "".join(chat.turn_text(r, t)[0] for r, t in turns)
    assert chat.read_turns(text) == turns


def test_examples_equal_the_definition(spark):
    rows = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a\\<|"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "user", "only"), (None, 0, None, "x"), (3, None, "assistant", "first"), (3, 1, "user", "u"), (4, 1, "b", "z"), (4, 1, "a", "z"), (4, 1, "a", "z")]
    table = spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING").withColumn("_none", F.lit(1))
    found = {r["conv_id"]: r for r in chat.digests(chat.expand(table)).collect()}
    for conv in (1, 2, None, 3, 4):
        own = sorted([(-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv])
        reply = "".join(x for _, r, x in own if r == "assistant")
        got = found[conv]
        assert (got["n_turns"], got["turns_sha256"]) == (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest())
        assert (got["loss_chars"], got["loss_sha256"]) == (len(reply), hashlib.sha256(reply.encode()).hexdigest())
    examples = [r for r in chat.expand(table).collect() if r["conv_id"] == 1]
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in examples] == ["a\\\\<\\|", ""]
    assert chat.digests(chat.expand(table.limit(0))).count() == 0


def test_long_conversation(spark):
    table = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.repeat(F.lit("long text "), 100).alias("text"))
    row = chat.digests(chat.expand(table)).first()
    assert (row["n_turns"], row["loss_chars"]) == (300, 150_000)


# --- Near-duplicates ---


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25), st.integers(0, 12))
def test_banded_distance(a, b, most):
    assert order_minhash.banded_distance(a, b, most) == min(_distance(a, b), most + 1)


def _word_sequences(texts):
    hashes, number = order_minhash.word_hashes(texts)
    return np.split(hashes, np.cumsum(number)[:-1])


def _joined(n, near):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label
    return label


def test_near_duplicates_equal_all_pairs(spark):
    rng, texts = random.Random(4), []
    for family in range(12):
        base = words(rng.randrange(30, 160), family, 3000)
        for copy in range(12):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], [f"x{rng.randrange(99)}"], [own[k], "y"]])
            texts.append(" ".join(own))
    texts += ["short one", "Short ONE!", "tiny", " ".join(["same words again"] * 50), " ".join(["same words again"] * 41), " ".join(["same words again"] * 39)]
    seqs = _word_sequences(texts)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if order_minhash.alike(seqs[i], seqs[j])]
    label = _joined(len(texts), near)
    found = {r["doc_id"]: r["component_id"] for r in order_minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == label
    assert order_minhash.deduplicated(docs_of(spark, texts)).count() == len(set(label))


def test_near_duplicates_of_whole_documents_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    seqs = _word_sequences([r["text"] or "" for r in rows])
    bags = [order_minhash.bag(s) for s in seqs]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if min(len(seqs[i]), len(seqs[j])) >= 0.8 * max(len(seqs[i]), len(seqs[j]), 1) and len(seqs[i]) and order_minhash.alike(seqs[i], seqs[j], bags=(bags[i], bags[j]))]
    found = {r["doc_id"]: r["component_id"] for r in order_minhash.near_duplicates(docs).collect()}
    label = _joined(len(rows), near)
    own = [found[r["doc_id"]] for r in rows]
    # No document is joined with one that links don't reach, and no link is lost.
    assert [rows[i]["doc_id"] for i in label] == own and len(near) > 90


@pytest.mark.parametrize(("edits", "least"), [(5, 1.0), (10, 0.99), (15, 0.95), (19, 0.8)])
def test_share_of_pairs_found_by_similarity(spark, edits, least):
    """Pairs of 200 words of which `edits` in a hundred differ at random: what the docstring expects of them."""
    rng, texts = random.Random(edits), []
    for n in range(150):
        base = words(200, 1000 + n, 5000)
        own = list(base)
        for k in rng.sample(range(200), 2 * edits):
            own[k] = f"x{k}"
        texts += [" ".join(base), " ".join(own)]
    found = {r["doc_id"]: r["component_id"] for r in order_minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert all(found[i] in (i, i - i % 2) for i in found)
    assert sum(found[2 * n] == found[2 * n + 1] for n in range(150)) >= least * 150


def test_texts_of_one_id_are_each_compared(spark):
    one, two, other = (" ".join(words(120, seed, 3000)) for seed in (31, 32, 33))
    rows = [(1, one), (1, two), (2, one + " tail"), (3, two + " tail"), (4, other), (4, other.upper()), (5, other + " tail"), (6, two), (7, None), (7, "seven")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumn("_node", F.lit("x"))
    found = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in order_minhash.near_duplicates(docs).collect())
    assert found == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 4, False), (6, 1, False), (7, 7, True), (7, 7, True)]
    stay = sorted((r["doc_id"], (r["text"] or "").lower()) for r in order_minhash.deduplicated(docs).collect())
    assert stay == sorted([(1, one), (1, two), (4, other), (7, ""), (7, "seven")])


def test_divided_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "ROWS", 16)
    rng, base = random.Random(12), words(100, 12, 3000)
    texts = []
    for family in range(6):
        own = list(base)
        for k in rng.sample(range(100), 14):
            own[k] = f"f{family}x{k}"
        texts += [" ".join([*own, *words(rng.randrange(3), rng.random())]) for _ in range(20)]
    seqs = _word_sequences(texts)
    label = _joined(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if order_minhash.alike(seqs[i], seqs[j])])
    found = {r["doc_id"]: r["component_id"] for r in order_minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == label


def test_a_large_group_of_copies_is_one_component(spark):
    base = words(80, 9)
    texts = [" ".join(base)] * 300 + [" ".join([*base[:40], f"v{i}", *base[41:]]) for i in range(300)]
    found = order_minhash.near_duplicates(docs_of(spark, texts)).agg(F.count_distinct("component_id"), F.count_distinct("class_id"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(found) == (1, 301, 1)


def test_alike_is_the_edit_similarity():
    rng = random.Random(8)
    for _ in range(200):
        a = np.array([rng.randrange(9) for _ in range(rng.randrange(1, 30))])
        b = np.array([x for x in a if rng.random() > 0.15] or [1])
        assert order_minhash.alike(a, b) == (1 - _distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_search(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a LONG, b LONG").repartition(5), "a", "b").collect()}
    assert found == {x: c for x, c in label.items() if x in linked}


# --- Classifiers ---


def _held_out_auc(rows, label):
    y = np.array([r[label] for r in rows])
    order = np.argsort([r["score"] for r in rows])
    rank = np.empty(len(rows))
    rank[order] = np.arange(1, len(rows) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.98), (toxicity, "toxic", 0.95)])
def test_scores_of_held_out_documents(spark, module, label, least):
    docs, judged = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = module.scored(docs, judged).join(judged, "doc_id").filter("held_out").collect()
    assert _held_out_auc(rows, label) > least
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_votes_equal_the_plain_formula():
    texts = [" ".join(words(30, i)) + ("!!! $$$" * (i % 2)) for i in range(60)]
    voter = quality.Voter(*quality.counts_of(texts), [i % 2 for i in range(60)])
    x = quality.unit(voter.weighted(*quality.counts_of(texts[:5])) @ voter.axes)
    for v, score in zip(x, voter.score(texts[:5]), strict=True):
        sims = voter.vectors @ v
        best = np.argsort(-sims)[: quality.NEIGHBOURS]
        weight = np.maximum(sims[best], 1e-6).astype(float) ** quality.SHARPNESS
        assert score == pytest.approx((weight * voter.labels[best]).sum() / weight.sum(), abs=1e-4)


def test_identity_mentions_do_not_decide():
    rng = random.Random(2)
    toxic = [f"those muslims are trash {' '.join(words(8, rng.random()))}" for _ in range(60)] + [f"muslims idiot {' '.join(words(8, rng.random()))}" for _ in range(60)]
    fine = [" ".join(words(10, rng.random())) for _ in range(240)] + [f"the christians and jews {' '.join(words(6, rng.random()))}" for _ in range(20)]
    texts, y = toxic + fine, [1] * 120 + [0] * 260
    model = toxicity.Classifier(toxicity.features_once(texts), y, toxicity.changes(texts))
    neutral = model.score(["muslims met their neighbours today", "christians met their neighbours today", "you are trash"])
    assert abs(neutral[0] - neutral[1]) < 0.1 and neutral[0] < 0.3 < neutral[2]
    assert toxicity.swapped("no group here") == [] and len(toxicity.swapped("The Muslims came")) == 5


def test_toxicity_scores_equal_the_plain_formula(spark):
    rng = random.Random(5)
    texts = [("idiot trash " if i % 3 == 0 else "") + ("the Muslims came. " if i % 4 == 0 else "") + " ".join(words(12, rng.random(), 60)) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id LONG, toxic INT")
    found = {r["doc_id"]: r["score"] for r in toxicity.scored(docs_of(spark, [*texts, None]), labels).collect()}
    learned = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 != 2]
    model = toxicity.train(docs_of(spark, texts), labels.filter(~toxicity.held_out()))
    own = toxicity.Classifier(toxicity.features_once([texts[i] for i in learned]), [int(i % 3 == 0) for i in learned], toxicity.changes([texts[i] for i in learned]))
    assert np.allclose(model.weights, own.weights) and len(model.weights) > 20

    def plain(text):
        """One over one plus e to the minus of the weights of a text's distinct words and beginnings."""
        hashes = {int(h) >> 44 for w in re.findall(r"\w+", (text or "").lower()) for h in np.concatenate(toxicity.word_prefix_hashes([w], toxicity.BEGINNINGS)[0])}
        return 1 / (1 + np.exp(-own.base - sum(own.weights[own.chosen[h]] for h in hashes if own.chosen[h] >= 0)))

    assert all(found[i] == pytest.approx(plain(t), abs=1e-6) for i, t in enumerate([*texts, None]))
    assert np.mean([(found[i] >= 0.3) == (i % 3 == 0) for i in range(120)]) > 0.95


def test_changes_of_swaps():
    moved = toxicity.changes(["The Muslims came. No one else! muslims again", "plain"])
    assert sum(moved.values()) == 10 and all(lost and new and not set(lost) & set(new) for lost, new in moved)


# --- Personal data ---


def _plain_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and personal_data.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], personal_data.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text("0125.@a-+( )é%", max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert personal_data.base_spans(text) == _plain_spans(text)


def test_best_path_equals_all_segmentations():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        segments = [(i, j, rng.normal(size=3)) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.6]
        weights = rng.normal(size=(len(personal_data.KINDS), 3))

        def best(at, n=n, segments=segments, weights=weights):
            return max([0.0] if at == n else [best(at + 1), *[float((weights @ f).max()) + best(j) for i, j, f in segments if i == at]])

        path = personal_data.best_path(n, segments, weights)
        score = sum(float((weights @ f)[k]) for i, j, k in path for a, b, f in segments if (a, b) == (i, j))
        assert score == pytest.approx(best(0))
        assert all(a[1] <= b[0] for a, b in zip(path, path[1:], strict=False))


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(5)
    segments, weights = [(0, 2, rng.normal(size=3)), (1, 3, rng.normal(size=3)), (2, 3, rng.normal(size=3))], rng.normal(size=(4, 3))
    value, gradient = personal_data.likelihood(3, segments, {(0, 2, 1)}, weights)
    for i, j in ((0, 0), (1, 2), (3, 1)):
        moved = weights.copy()
        moved[i, j] += 1e-6
        assert (personal_data.likelihood(3, segments, {(0, 2, 1)}, moved)[0] - value) / 1e-6 == pytest.approx(gradient[i, j], abs=1e-4)


def test_added_spans_on_other_sentences():
    weights = personal_data.trained()
    rows = list(personal_data._templates(4321, 300))
    assert np.mean([personal_data.added_spans(t, [], weights) == s for t, s in rows]) > 0.97
    base = personal_data.base_spans("call +1 (555) 123-4567 now")
    assert personal_data.added_spans("call +1 (555) 123-4567 now", base, weights) == []


# --- Sharding, mixing ---


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 3), (3, 2), (3, 4)):
        place = sharding.hilbert(dims, bits)
        cells = sorted(range(len(place)), key=place.__getitem__)
        assert sorted(place) == list(range(1 << dims * bits))
        split = lambda c, d=dims, b=bits: [c >> b * i & (1 << b) - 1 for i in range(d)]
        assert all(sum(abs(x - y) for x, y in zip(split(a), split(b), strict=True)) == 1 for a, b in zip(cells, cells[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 250])
def test_shards_are_equal_and_gapless(spark, n):
    rng = random.Random(n)
    texts = [" ".join(words(rng.randrange(1, 200), rng.randrange(9))) if i % 7 else None for i in range(n)]
    docs = docs_of(spark, texts, source={i: f"s{i % 3}" for i in range(n)})
    rows = sharding.assign(docs).collect()
    assert len(rows) == n
    counts = [sum(r["shard"] == s for r in rows) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    for s in range(16):
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["place"] for r in order] == sorted(r["place"] for r in rows)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    laid = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs).collect()}
    assert laid == {r["doc_id"]: r["shard"] for r in rows}


GIVEN_WEIGHTS = [[0.7, 0.3], [0.9999, 0.0001], [5, 3, 1, 0.5, 0.1], [1 / 3, 1 / 3, 1 / 7], [x**0.5 for x in (3_000_000, 500_000, 40_000, 900)], [1e-3] * 40 + [1.0]]


def _prefixes_deviate_by_less_than_a_block(blocks, weights):
    """Of all phases, every prefix, against the given weights as exact ratios."""
    left = {s: n for s, n in blocks.items() if n}
    by_base = {}
    for row in mixing.phases(blocks, weights):
        by_base.setdefault(row["base"], {})[row["s"]] = row["slots"]
    for base in sorted(by_base):
        own = by_base[base]
        length = sum(map(len, own.values()))
        assert sorted(x for slots in own.values() for x in slots) == list(range(length))
        ratios = {s: Fraction(weights[s]) for s in left}
        total = sum(ratios.values())
        for s, ratio in ratios.items():
            w, slots = ratio / total, own.get(s, [])
            # Between two of its slots a source's lag grows evenly, so the slots' edges are the extremes.
            for i, slot in enumerate([*slots, length]):
                assert i - w * slot > -1 and (slot == length or i + 1 - w * (slot + 1) < 1), (s, i, slot)
            left[s] -= len(slots)
        left = {s: n for s, n in left.items() if n}
    assert not left


@pytest.mark.parametrize("weights", GIVEN_WEIGHTS)
def test_long_schedules_deviate_from_target_weights_by_less_than_a_block(weights):
    weights = dict(enumerate(weights))
    _prefixes_deviate_by_less_than_a_block({s: max(1, round(60_000 * w / sum(weights.values()))) for s, w in weights.items()}, weights)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(1e-6, 1), st.integers(0, 300)), min_size=1, max_size=12))
def test_schedule_deviates_by_less_than_a_block(sources):
    _prefixes_deviate_by_less_than_a_block({s: n for s, (_, n) in enumerate(sources)}, {s: w for s, (w, _) in enumerate(sources)})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 400), min_size=1), st.booleans())
def test_phases_place_every_block_once(blocks, equal):
    weights = {s: 1.0 if equal else n**0.5 for s, n in blocks.items()}
    slots = [(row["base"] + x, (row["s"], row["first"] + i)) for row in mixing.phases(blocks, weights) for i, x in enumerate(row["slots"])]
    assert sorted(x for x, _ in slots) == list(range(sum(blocks.values())))
    assert sorted(key for _, key in slots) == sorted((s, b) for s, n in blocks.items() for b in range(n))


def _plain_schedule(blocks, weights):
    """Slot by slot: each phase starts the sources anew; of the released blocks the one due first runs."""
    left, done, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    while left:
        total = sum(Fraction(weights[s]) for s in left)
        w, slot, own = {s: Fraction(weights[s]) / total for s in left}, 0, dict.fromkeys(left, 0)
        while len(own) == len(left):
            due = min((math.ceil((own[s] + 1) / w[s]), str(s), s) for s in left if math.floor(own[s] / w[s]) <= slot)[2]
            out.append((due, done[due]))
            own[due], done[due], left[due], slot = own[due] + 1, done[due] + 1, left[due] - 1, slot + 1
            left = {s: n for s, n in left.items() if n}
    return {key: slot for slot, key in enumerate(out)}


@pytest.mark.parametrize("weights", [None, {"s1": 2.0, "s7": 1.0, None: 1.0, "none here": 1.0}])
@pytest.mark.parametrize(("n", "most"), [(5, 500_000), (560, 500_000), (560, 100)])
def test_schedule_equals_a_plain_simulation(spark, monkeypatch, n, most, weights):
    """Each source is mixed by itself at its own weight, whether its plan is broadcast or not; null and None are two."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", most)
    monkeypatch.setattr(mixing, "PART", 300)
    source = {i: None if i % 13 == 0 else "None" if i % 17 == 0 else f"s{i % n if i < 900 else i % 4}" for i in range(1300)}
    rows = mixing.schedule(docs_of(spark, ["t"] * 1300, source=source), weights, block=4).select("row.doc_id", "row.source", "block", "place", "slot").collect()
    assert {r["doc_id"]: r["source"] for r in rows} == source and len({(r["slot"], r["place"]) for r in rows}) == len(rows) == 1300
    named = lambda s: {None: "None", "None": "None\0"}.get(s, s)
    counts = {}
    for s in source.values():
        counts[named(s)] = counts.get(named(s), 0) + 1
    blocks, weights = {s: -(-x // 4) for s, x in counts.items()}, {named(s): w for s, w in (weights or {}).items()}
    first = _plain_schedule({s: x for s, x in blocks.items() if s in weights or not weights}, weights or {s: x**0.5 for s, x in counts.items()})
    rest = _plain_schedule({s: x for s, x in blocks.items() if s not in weights and weights}, dict.fromkeys(blocks, 1.0))
    assert {((named(r["source"]), r["block"]), r["slot"]) for r in rows} == {*first.items(), *((key, len(first) + slot) for key, slot in rest.items())}


def test_blocks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 10)
    docs = docs_of(spark, ["t"] * 1000, source={i: f"s{i % 3 and 1}" for i in range(1000)})
    rows = mixing.schedule(docs).select("row.doc_id", "place", "slot").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1000)) and {r["place"] for r in rows} == set(range(100))
    assert {r["slot"] for r in rows} == set(range(11))


@pytest.mark.parametrize("weight", [float("inf"), float("nan")])
def test_weights_that_are_no_numbers_are_refused(spark, weight):
    with pytest.raises(ValueError, match="finite"):
        mixing.schedule(docs_of(spark, ["t"]), {"s": weight})


def test_mixing_keeps_every_row(spark):
    docs = docs_of(spark, ["t"] * 900, source={i: "hot" if i % 3 else f"s{i % 5}" for i in range(900)})
    rows = mixing.schedule(docs, block=8).select("row.doc_id", "row.source", "block", "place", "slot").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(900))
    assert len({(r["slot"], r["place"]) for r in rows}) == 900
    by = {}
    for r in rows:
        by.setdefault((r["source"], r["block"]), set()).add((r["slot"], r["place"]))
    assert all(len({s for s, _ in own}) == 1 and {p for _, p in own} == set(range(len(own))) for own in by.values())
    assert mixing.mixed(docs, weights={"hot": 1.0, "s0": 0.0}).count() == 900


# --- Decontamination ---


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_its_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(spark, database(sf_dir), llm.QUERIES[name], llm.ORACLES[name], sf_dir) == ""


def test_containment_equals_brute_force(spark):
    rng = random.Random(6)
    items = [" ".join(words(rng.randrange(1, 70), 100 + i, 5000)) for i in range(40)]
    texts = [" ".join(words(300, i, 5000)) for i in range(20)]
    for i in range(20, 80):
        item = items[rng.randrange(40)].split()
        for _ in range(rng.randrange(4)):
            item[rng.randrange(len(item))] = "changed"
        cut = rng.randrange(len(item) + 1)
        body = words(400, i, 5000)
        texts.append(" ".join(body[:100] + item[:cut] + (body[100:200] if rng.random() < 0.3 else []) + item[cut:] + body[200:]))
    texts += items[:10]

    def grams(t):
        w = [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)}

    expected = {(d, i): len(grams(x) & grams(t)) / len(grams(x)) for d, t in enumerate(texts) for i, x in enumerate(items) if len(grams(x) & grams(t)) >= 0.8 * len(grams(x)) - 1e-9}
    table = spark.createDataFrame(list(enumerate(items)), "item_id LONG, text STRING")
    found = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.containment(docs_of(spark, texts), table).collect()}
    assert found == pytest.approx(expected) and len(expected) > 20


# --- Pipeline ---


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "mixing", "sharding"]
    assert set(docs.columns) <= set(out.columns)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    ids = sorted(known)
    seqs = dict(zip(ids, _word_sequences([texts[i] for i in ids]), strict=True))
    label = {i: i for i in ids}
    near = [(i, j) for i in ids for j in ids if j < i and len(seqs[i]) and len(seqs[j]) and order_minhash.alike(seqs[i], seqs[j])]
    for _ in range(20):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    hit = {r[0] for r in database(sf_dir).execute(f"SELECT DISTINCT doc_id FROM ({decontaminate.ORACLE_SQL})").fetchall()}
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {i for i in ids if label[i] == i and i not in hit}
    counts = [sum(r["shard"] == s for r in rows) for s in range(16)]
    assert max(counts) - min(counts) <= 1
