"""Prefix trie, whitening and toxicity: brute force, SQL, defined cases, held-out labels."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from compare import difference

from sqltrail.llm import prefix_trie, queries, toxicity, whitening

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"

# ------------------------------------------------------------------ prefix trie


def brute_trie(rows):
    """Rows of the report from (conv_id, turn, role, text), without ties of turns."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    leaves, saved, children = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(members) - 1) * (len(path[-1][1]) if path else 0)
    ends = {p: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)) for p, m in nodes.items()}
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items()
    ) if own else []


def trie(df, **sizes):
    return sorted((tuple(r) for r in prefix_trie.report(df, **sizes).collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize(("shard", "segment"), [(512, 512), (4, 3), (1, 1), (64, 2)])
def test_trie_equals_brute_force(spark, shard, segment):
    chance = random.Random(2)
    rows = []
    for conv in [*range(0, 40), *range(100, 130), 199, 205, 1000, -7, -100]:  # 200 is absent, 205 has no first turns to share
        for turn in range(chance.choice([1, 1, 2, 3, 5, 9])):
            rows.append((conv, None if turn == 0 and conv % 3 == 0 else turn, chance.choice(["user", None, "ab"]), chance.choice([None, "", "c", "bc", "x" * 9000])))
    rows += [(300, t, "user", f"turn {t // 2}") for t in range(23)] + [(c, t, "user", "same") for c in range(301, 330) for t in range(6)]
    chance.shuffle(rows)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, x string, depth int")
    assert trie(df, shard=shard, segment=segment) == brute_trie(rows)


def test_trie_cases(spark):
    fields = "conv_id long, turn long, role string, text string"
    assert trie(spark.createDataFrame([], fields)) == []
    assert trie(spark.createDataFrame([(None, 1, "a", "b")], fields)) == []
    rows = [(7, 1, "a", "b"), (7, 1, "a", "b"), (8, None, None, None)]  # repeated rows are turns each
    found = trie(spark.createDataFrame(rows, fields))
    assert found == brute_trie(rows)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_trie_query(spark, sf):
    df = queries.queries()["op13_conversation_trie"](spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1])) == brute_trie(rows)
    assert difference(df, sf, queries.oracle_sql()["op13_conversation_trie"]) is None


# ------------------------------------------------------------------ whitening


def sound(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute_whitening(rows, count=16):
    """Per row (id, vector): components, exact deviation; the exact covariance of the fit list."""
    xs = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in rows if sound(v)}
    points = sorted(set(xs.values()))
    n, dim = len(points), len(points[0])
    s = [sum(p[k] for p in points) for k in range(dim)]
    cov = np.array([[float(sum((n * p[i] - s[i]) * (n * p[j] - s[j]) for p in points) / Fraction(n) ** 3) for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    whitened = {i: np.array([float(Fraction(n * x[k] - s[k], n)) for k in range(dim)]) @ vectors / np.sqrt(values) for i, x in xs.items()}
    deviation = {i: sum((n * x[k] - s[k]) ** 2 for k in range(dim)) for i, x in xs.items()}
    return n, values / np.trace(cov), whitened, deviation


def check_whitening(got, rows, count=16):
    n, explained, whitened, deviation = brute_whitening(rows, count)
    signs = {}
    assert len(got) == len(whitened) * count and {r.component for r in got} == set(range(1, count + 1))
    for r in got:
        k = r.component - 1
        mine = whitened[r.vec_id][k]
        if abs(mine) > 1e-3:
            signs.setdefault(k, np.sign(mine) * np.sign(r.whitened))
        assert abs(r.whitened * signs.get(k, 1) - mine) < 1e-7 or k not in signs
        assert r.n == n and r.deviation == deviation[r.vec_id] and r.explained == pytest.approx(explained[k], rel=1e-10) and r.identity_error < 1e-9


def test_whitening_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.queries()["op11_embedding_whitening"](spark, SF).collect(), rows)


def test_whitening_cases(spark):
    chance = np.random.default_rng(3)
    rows = [(i, (chance.normal(size=5) * [9, 3, 1, 0.5, 0.1] + 1000).tolist()) for i in range(80)]
    rows += [(100, rows[0][1]), (101, None), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5)]
    fields = "vec_id long, embedding array<double>, n int, component string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], fields)
    check_whitening(whitening.whiten(df).collect(), rows, 5)
    check_whitening(whitening.whiten(df, 2).collect(), rows, 2)
    # two lengths, an empty vector, a null id beside a large one, a flat direction, one vector alone
    large = 2**60 + 1
    odd = [(None, [1.0, 2.0, 7.0]), (large, [2.0, 4.0, 7.0]), (3, [3.0, 6.5, 7.0]), (4, []), (5, [1.0]), (5, [1.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, "x") for r in odd], fields)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (3, 1), (3, 2), (large, 1), (large, 2)]
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 101")).count() == 0
    huge = [(i, [1e300 * (-1) ** i, float(i), float(i * i % 7)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, "x") for r in huge], fields)).collect()
    assert len(got) == 27 - 9 * (3 - max(r.component for r in got)) and all(math.isfinite(r.whitened) for r in got) and all(r.deviation is None for r in got)


def test_inertia_counts():
    chance = np.random.default_rng(4)
    for size in (1, 2, 3, 8, 30):
        for _ in range(20):
            a = chance.normal(size=(size, size))
            a = a + a.T
            if size > 2:
                a[0, 0] = 0  # pivots of two rows
            assert whitening.positive(a) == (np.linalg.eigvalsh(a) > 0).sum()
    assert whitening.positive(np.zeros((3, 3))) == 0 and whitening.positive(np.array([[0.0, 1], [1, 0]])) == 1


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1, 0.5], [1, 1, 1, 1, 1, 1], [9, 2, 2, 2, 1, 0], [1, 1 - 1e-9, 1e-3, 1e-8, 0, 0], [3, 3 - 1e-15, 1, 1, 0, 0]])
def test_spectrum_slicing(spectrum):
    q = np.linalg.qr(np.random.default_rng(5).normal(size=(6, 6)))[0]
    v = q @ np.diag(spectrum) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading(v, 4)
    kept = min(4, sum(x > 0 for x in spectrum))
    assert len(values) == kept and np.allclose(values, spectrum[:kept], rtol=1e-7, atol=1e-13)
    assert np.allclose(vectors.T @ vectors, np.eye(kept), atol=1e-12) and np.allclose(v @ vectors, vectors * values, atol=1e-7)


# ------------------------------------------------------------------ toxicity


def test_toxicity_query(spark):
    rows = queries.queries()["op12_toxicity"](spark, MORE).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MORE}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.lang_predicted == (r.score >= r.lang_threshold)
    judged = [(r.predicted, r.lang_predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    for k in (0, 1):
        caught = [x[k] for x in judged if x[2] == 1]
        clean = [x[k] for x in judged if x[2] == 0]
        assert len(caught) > 50 and np.mean(caught) > 0.85 and np.mean(clean) < 0.02


def test_toxicity_cases(spark):
    chance = random.Random(6)
    plain = [f"w{i}" for i in range(60)]
    texts = [" ".join(chance.choices(plain, k=30) + (["vile"] if i % 3 == 0 else [])) for i in range(200)] + [None, "", "..", "Vile! " + "w1 " * 90_000, "VILE"]
    rows = [(i, t, "en" if i % 2 else None, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", "en", 1, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label int, fold string")
    known = [(i, int(i % 3 == 0), 5) for i in range(200)] + [(0, 1, 5), (999, 1, 5), (3, None, 5), (None, 1, 5), (203, 0, 5)]
    labels = spark.createDataFrame(known, "doc_id long, toxic int, text int")
    model = toxicity.train(docs, labels)
    scored = docs.select("doc_id", toxicity.score(docs, model).alias("score")).collect()
    by = {r.doc_id: r.score for r in scored}
    assert len(scored) == len(rows) and all(by[i] > 0.5 for i in range(0, 200, 3)) and all(by[i] < 0.5 for i in range(200) if i % 3)
    assert by[203] > 0.5 and by[204] > 0.5 and by[200] == by[201] == by[202] < 0.5
    got = toxicity.report(docs, labels).collect()
    assert {r.doc_id: r.score for r in got} == by  # same rows, same model
    assert all(r.held_out for r in got if r.doc_id is None)
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert {r.doc_id: r.score for r in docs.select("doc_id", toxicity.score(docs, toxicity.train(docs, flipped)).alias("score")).collect()} == by
    assert {r.score for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in toxicity.report(docs, labels.where("toxic = 0")).collect()} == {0}
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_pieces_of_long_texts():
    network = toxicity.Network()
    chance = np.random.default_rng(7)
    network.table[:] = chance.normal(size=network.table.shape)
    vectors = chance.normal(size=(41, toxicity.SIZE)).astype(np.float32)
    whole = network.pooled(vectors)
    before, toxicity.PIECE = toxicity.PIECE, 7
    assert np.allclose(network.pooled(vectors), whole)
    toxicity.PIECE = before


def test_thresholds_by_language(spark):
    network = toxicity.Network()
    scores = np.array([0.1] * 20 + [0.3] * 20 + [0.8] * 20 + [0.6] * 5)
    labels = np.array([0] * 20 + [1] * 20 + [1] * 20 + [0] * 5)
    network.calibrate(scores, labels, ["a"] * 40 + [None] * 25)
    assert network.thresholds == {"a": pytest.approx(0.2), None: pytest.approx(0.7)} and network.overall == pytest.approx(0.2)
    loaded = toxicity.Network.load(network.dump())
    assert loaded.thresholds == network.thresholds and loaded.overall == network.overall
    langs = spark.createDataFrame([("a",), ("b",), (None,)], "lang string")
    got = [r.t for r in langs.select(toxicity.thresholds(network.dump(), langs.lang).alias("t")).collect()]
    assert got == [pytest.approx(0.2), pytest.approx(0.2), pytest.approx(0.7)]


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Rows of several tasks, and words that stand in long texts only, are learnt."""
    monkeypatch.setattr(toxicity, "STEPS", 48)
    chance = random.Random(4)
    kinds = ["vile", "nasty", "foul", "grim", "rotten"]
    docs, labels = [], []
    for i in range(1200):
        words = chance.choices([f"w{k}" for k in range(50)], k=chance.choice([3, 12, 40]))
        if i % 3 == 0:
            words.insert(chance.randrange(len(words)), kinds[i % 5])
        filler = " w1 w2" * 3500 if i % 15 == 3 else ""  # all texts of one kind are long
        docs.append((i, " ".join(words) + filler, "ab"[i % 2]))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = {r.doc_id for r in docs.select("doc_id").where(toxicity.held_out(docs.doc_id)).collect()}
    for rows in (400, 10_000):
        model = toxicity.train(docs, labels, shard_rows=rows)
        found = {r.doc_id: r.score for r in docs.select("doc_id", toxicity.score(docs, model).alias("score")).collect()}
        wrong = [i for i in held if (found[i] >= 0.5) != (i % 3 == 0)]
        assert len(wrong) <= 0.02 * len(held), (rows, wrong)


def test_toxicity_pieces_of_training_texts():
    """Long texts find the same windows in pieces as whole."""
    network = toxicity.Network()
    network.table = np.random.default_rng(3).normal(size=network.table.shape).astype(np.float32)
    network.table[0] = 0
    numbers, slots, _ = toxicity.read(["a b c d e f g h i j k l m", "", "n o", "p q r s t u v w x y z a b c d"])
    whole = network._tops(numbers, slots)
    before, toxicity.PIECE = toxicity.PIECE, 4
    pieces = network._tops(numbers, slots)
    toxicity.PIECE = before
    assert np.allclose(whole[0], pieces[0], atol=1e-5) and (whole[1] == pieces[1]).all()
    vectors = [network.table[slots[n]].sum(1) for n in numbers]
    assert np.allclose(whole[0], [network.pooled(v) for v in vectors], atol=1e-5)


def test_toxicity_thresholds_of_bins():
    chance = np.random.default_rng(6)
    labels = (chance.random(400) < 0.3).astype(int)
    scores = np.floor(np.clip(labels * 0.3 + chance.random(400) * 0.6, 0, 1) * 50) / 50
    bins, counts = np.unique(np.stack([scores, labels]), axis=1, return_counts=True)
    got = toxicity.Network().calibrate(bins[0], bins[1], ["x"] * len(counts), counts)

    def f1(t):
        return 2 * ((scores >= t) & (labels == 1)).sum() / ((scores >= t).sum() + labels.sum())

    assert f1(got.overall) == max(f1(t) for t in scores) and got.thresholds == {"x": got.overall}
