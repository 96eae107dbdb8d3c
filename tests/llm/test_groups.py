"""SimHash, embeddings, components and decontamination against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from sqltrail.llm import common, decontaminate, embedding_dedup, queries, simhash
from sqltrail.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "random", "star", "none"])
def test_components(spark, shape):
    chance = random.Random(3)
    names = chance.sample(range(-500, 10_000), 300)
    links = {
        "path": list(zip(names, names[1:], strict=False)),
        "random": [(chance.choice(names), chance.choice(names)) for _ in range(200)],
        "star": [(names[7], n) for n in names],
        "none": [],
    }[shape]
    found = connected_components(spark.createDataFrame(links + links[:5], "a long, b long")).collect()
    expected = roots(names, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert len(found) == len(touched) and {r.node: r.component for r in found} == {n: expected[n] for n in touched}


# ------------------------------------------------------------------ SimHash


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance=4):
    values = sorted(set(prints))
    packed = np.array(values, np.uint64)
    links = [(values[i], values[i + 1 + int(j)]) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(packed[i] ^ packed[i + 1 :]) <= distance)]
    return roots(values, links)


def test_fingerprint_equals_spark(spark):
    assert spark.sql("SELECT xxhash64('a b c d')").first()[0] == np.array(xxhash.xxh64_intdigest(b"a b c d", 42), np.uint64).astype(np.int64)
    for text in [None, "", " \n", "One", "ONE two", "a b c d", "a b c d e f É", "x " * 5000, "a\x1cb c\x85d e f"]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_simhash_query(spark):
    rows = queries.queries()["op3_simhash_near_dedup"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    group = brute_groups(prints.values())
    lowest = {}
    for i, p in prints.items():
        lowest[group[p]] = min(i, lowest.get(group[p], i))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{p:016x}", lowest[group[p]]) for i, p in prints.items()}


def near_prints(count, seed=1):
    """Fingerprints in dense groups, in chains, in pairs at the limit and alone."""
    chance = np.random.default_rng(seed)
    out = []
    for c in chance.integers(0, 2**63, 6, dtype=np.uint64):
        for _ in range(count):
            out.append(int(c) ^ sum(1 << int(b) for b in chance.choice(64, int(chance.integers(0, 5)), replace=False)))
    for c in chance.integers(0, 2**63, 200, dtype=np.uint64):
        out += [int(c), int(c) ^ sum(1 << int(b) for b in chance.choice(64, int(chance.integers(3, 7)), replace=False))]
    chain = 5
    for _ in range(60):
        chain ^= sum(1 << int(b) for b in chance.choice(64, 4, replace=False))
        out.append(chain)
    return [0, 2**64 - 1, *out]


@pytest.mark.parametrize("bucket", [50_000, 20])
def test_links_join_all_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    prints = sorted(set(near_prints(80)))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, first long")
    found = [(a, b) for a, b in simhash.links(classes).collect()]
    packed = [tuple(np.array(x, np.int64).view(np.uint64).tolist()) for x in found]
    assert all((a ^ b).bit_count() <= 4 for a, b in packed)
    assert roots(prints, packed) == brute_groups(prints)


@pytest.mark.parametrize(("classes", "distance"), [(10, 4), (10**5, 4), (10**7, 4), (10**9, 4), (10**6, 1), (10**6, 0)])
def test_thresholds_cover_the_distance(classes, distance):
    sample = np.array(near_prints(20), np.uint64)
    parts = simhash.plan(sample, classes, distance)
    bits = [b for bits, _ in parts for b in bits]
    assert len(bits) == len(set(bits)) and sum(t + 1 for _, t in parts) == distance + 1
    chance = np.random.default_rng(2)
    for _ in range(300):  # whatever bits differ, some partition differs in no more than its threshold
        differ = set(chance.choice(64, distance, replace=False).tolist())
        assert any(len(differ & set(b)) <= t for b, t in parts)


def test_simhash_cases(spark):
    texts = [None, "", " ", "same text of five words here", "SAME text of five words here", "another one that is quite different", "same text of five words here", None]
    ids = [3, 2, None, 7, 5, 6, 7, None]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp int, component string")
    rows = simhash.report(table).collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert by["0" * 16] == {2} and all(len(v) == 1 for v in by.values())
    kept = simhash.deduplicate(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6]
    assert simhash.report(table.limit(0)).count() == 0 and simhash.deduplicate(table.limit(0)).count() == 0
    nameless = simhash.deduplicate(table.where("doc_id IS NULL"))
    assert nameless.count() == 1


# ------------------------------------------------------------------ embeddings


def brute_vectors(rows, cosine=0.9):
    """Links and smallest ids of rows (id, vector) by comparing all."""
    sound = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a, i in enumerate(sound):
        x = np.array(rows[i][1], np.float64)
        for j in sound[a + 1 :]:
            y = np.array(rows[j][1], np.float64)
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                links.append((i, j))
    group = roots(range(len(rows)), links)
    lowest = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            lowest[group[i]] = min(k, lowest.get(group[i], k))
    return [(k, sum(i in x for x in links), lowest.get(group[i]), k == lowest.get(group[i])) for i, (k, _) in enumerate(rows)]


def test_vector_cases(spark):
    chance = np.random.default_rng(4)
    base = chance.normal(size=8).tolist()
    rows = [(9, base), (2, base), (2, base), (4, [2 * x for x in base]), (5, [-x for x in base]), (6, None), (7, []), (8, [0.0] * 8), (10, [None, *base[1:]]),
            (11, [float("nan"), *base[1:]]), (12, [float("inf"), *base[1:]]), (13, [0.0, *([-0.0] * 7)]), (14, base[:4]), (15, base[:4]), (None, [x + 0.01 for x in base]),
            (16, [1e30 * x for x in base]), (17, [0.0, 1.0]), (18, [-0.0, 1.0]), (None, None)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, node int, key string")
    got = [tuple(r) for r in embedding_dedup.report(table).collect()]
    assert sorted(got, key=repr) == sorted([(k, n, c, (k == c)) for k, n, c, _ in brute_vectors(rows)], key=repr)
    assert embedding_dedup.report(table.limit(0)).count() == 0
    whole = table.select("vec_id", table.embedding.cast("array<float>").alias("embedding"))
    assert embedding_dedup.report(whole).count() == len(rows)


@pytest.mark.parametrize("block", [4_096, 32])
def test_forest_recall(spark, monkeypatch, block):
    """Small leaves, dense groups, and pairs just above and just below the threshold."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "LEAF", 20)
    chance = np.random.default_rng(6)
    x = chance.normal(size=(500, 32))
    rows = x.tolist()
    for c in (0.88, 0.895, 0.905, 0.93, 0.99):
        other = chance.normal(size=(60, 32))
        some = x[:60] / np.linalg.norm(x[:60], axis=1, keepdims=True)
        other -= (other * some).sum(1, keepdims=True) * some
        rows += (c * some + np.sqrt(1 - c * c) * other / np.linalg.norm(other, axis=1, keepdims=True)).tolist()
    rows += (x[400] + chance.normal(size=(150, 32)) * 0.1).tolist()
    table = list(enumerate(rows))
    got = {r.vec_id: r for r in embedding_dedup.report(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()}
    expected = brute_vectors(table)
    true, found = sum(n for _, n, _, _ in expected), sum(r.n_links for r in got.values())
    assert all(got[k].n_links <= n for k, n, _, _ in expected)
    assert found >= 0.95 * true
    assert all(got[k].kept == (got[k].component_id == k) and got[k].component_id >= c for k, _, c, _ in expected)


def test_vector_query(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [tuple(r) for r in queries.queries()["op9_embedding_near_dedup"](spark, SF).collect()]
    assert sorted(got) == sorted(brute_vectors(rows))


@pytest.mark.parametrize("depth", [8, 14, 20])
def test_forest_recall_by_depth(depth):
    """Pairs at the threshold share a leaf however deep the trees are, as their number follows."""
    chance = np.random.default_rng(depth)
    size, pairs = 64, 250
    x = chance.normal(size=(pairs, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = chance.normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * other / np.linalg.norm(other, axis=1, keepdims=True)
    sample = embedding_dedup.units(list(chance.normal(size=(4000, size))))
    trees = [embedding_dedup.grow(sample, depth, 0.9, 100 + t) for t in range(embedding_dedup.trees_for(depth, 0.9))]
    met, places = set(), 0
    for tree in trees:
        left, right = tree.leaves(x), tree.leaves(y)
        places += len(left[0])
        at = set(zip(*left, strict=True))
        met |= {i for i, leaf in zip(*right, strict=True) if (i, leaf) in at}
    print(depth, len(trees), places / pairs, len(met) / pairs)
    assert len(met) >= 0.95 * pairs
    assert places / pairs * 300 < 40_000  # bytes a vector


# ------------------------------------------------------------------ decontamination


def split(text):
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", "".join(c.lower() if c < "\x80" else c for c in text or "")).split()


def brute_overlaps(docs, items, window=20, identity=0.8):
    """Every diagonal of every document and item: does a window of the item agree well enough?"""
    first = {}
    for k, t in items:
        if (words := tuple(split(t))) and len(words) >= 8:
            first[words] = min(k, first.get(words, k))
    out = set()
    for d, text in docs:
        words = split(text)
        for item, k in first.items():
            size = min(window, len(item))
            for shift in range(-len(item) + 1, len(words)):
                same = [0 <= shift + i < len(words) and words[shift + i] == item[i] for i in range(len(item))]
                if any(sum(same[s : s + size]) >= identity * size - 1e-9 for s in range(len(item) - size + 1)):
                    out.add((d, k))
                    break
    return out


def test_decontamination_cases(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    chance = random.Random(8)
    word = lambda: "".join(chance.choices("abcdefgh", k=6))
    long, other, short = [word() for _ in range(60)], [word() for _ in range(30)], [word() for _ in range(9)]
    items = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(short)), (4, " ".join(long).upper() + "!"), (5, None), (6, ""), (7, "too short an item"), (None, "x y z")]
    pad = lambda: [word() for _ in range(40)]
    changed = [word() if i % 7 == 3 else w for i, w in enumerate(long)]  # six of seven words stay
    strange = [word() if i % 2 else w for i, w in enumerate(long)]  # half of the words stay
    texts = [pad() + long + pad(), pad() + changed, strange + pad(), pad() + long[20:40], pad() + long[20:33] + pad(), other, pad() + short + pad(), short[:8], pad(), [],
             [x.capitalize() + "," for x in long], long[:19], pad() + other + pad() + short]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100, None), (0, " ".join(pad())), (None, " ".join(other))] + [(200 + i, " ".join(pad() + other)) for i in range(20)]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, hash int, salt string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, n int")
    got = decontaminate.overlaps(table, bench).collect()
    expected = brute_overlaps(docs, [x for x in items if x[0] is not None])
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
    assert {(0, 1), (1, 1), (6, 3), (None, 2)} <= expected and not {2, 8, 9} & {d for d, _ in expected}
    clean = decontaminate.decontaminate(table, bench)
    dirty = {d for d, _ in expected}
    assert clean.columns == table.columns and sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((d for d, _ in docs if d not in dirty), key=repr)
    assert decontaminate.overlaps(table.limit(0), bench).count() == 0 and decontaminate.decontaminate(table, bench.limit(0)).count() == len(docs)


@pytest.mark.parametrize("length", range(8, 21))
def test_masks_cover_the_identity(length):
    """Whatever tokens are substituted, one mask lies on equal tokens only."""
    places = [{at + start + i for start in starts for i in range(size)} for size, starts in decontaminate.masks(length).values() for at in range(length - starts[-1] - size + 1)]
    for changed in itertools.combinations(range(length), length // 5):
        assert any(not place.intersection(changed) for place in places)


def test_substituted_items_are_found(spark):
    """Items of 8, 13, 16 and 20 tokens with each placement of the substitutions that defeated the former masks at times."""
    chance = random.Random(9)
    word = lambda: "".join(chance.choices("abcdefgh", k=6))
    items, docs = [], []
    for k, n in enumerate((8, 13, 16, 20)):
        item = [word() for _ in range(n)]
        items.append((k, " ".join(item)))
        for changed in itertools.islice(itertools.combinations(range(n), n // 5), 0, None, 7 if n < 20 else 97):
            docs.append((1000 * k + len(docs), " ".join([word(), *(word() if i in changed else w for i, w in enumerate(item)), word()])))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, d // 1000) for d, _ in docs}


def test_tokens_of_any_script(spark):
    words = lambda t: [w.decode() for w in decontaminate.split(t)]
    assert words("It’s “an” Été—Ok… naïve_x\u00a0y\u3000z") == ["it", "s", "an", "Été", "ok", "naïve", "x", "y", "z"]
    assert words("水は低い、ＡＢ。ไทย 𠀋😀a 한국 ① हिन्दी") == [*"水は低い", "ＡＢ", *"ไทย", "𠀋", "a", "한국", "①", "हिन्दी"]
    assert words(None) == words("、。") == [] and all(words(" ".join(words(t))) == words(t) for t in ("“中文”—ab’c", "ไทย"))


def test_short_and_unspaced_items_are_found(spark):
    chinese = "光合作用是植物把光能变成化学能的过程，它在叶绿体中进行。"
    items = [(1, chinese), (2, "Capital of “Peru”?"), (3, "lima"), (4, "、"), (5, "LIMA!"), (6, "of peru capital")]
    docs = [(1, f"老师说：「{chinese}」大家记住了。"), (2, "老师说光合作用是植物把光能转成化学能的过程它在叶绿体中进行大家"), (3, "the capital—of ‘Peru’ and the capital of Peru"), (4, "capital of all Peru"),
            (5, "Lima"), (6, "limas"), (7, "光合作用"), (8, "capital of"), (None, "lima, lima")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(table, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (5, 3), (None, 3)}
    assert [tuple(got[3, 2])[2:], tuple(got[None, 3])[2:]] == [(2, 1, 6, 1.0), (2, 0, 1, 1.0)]
    assert {r.doc_id for r in decontaminate.decontaminate(table, bench).collect()} == {4, 6, 7, 8}


def stems(n, chance):
    """Items of one common stem of 13 tokens, clean documents that hold it, and one document that quotes an item with substitutions."""
    word = lambda: "".join(chance.choices("abcdefgh", k=6))
    stem = [word() for _ in range(13)]
    tails = [[word() for _ in range(12)] for _ in range(n)]
    items = [(i, " ".join(stem + tail)) for i, tail in enumerate(tails)]
    docs = [(i, " ".join([*(word() for _ in range(8)), *stem, *(word() for _ in range(20))])) for i in range(n)]
    quoted = stem + tails[3]
    changed = [word() if i in (2, 7, 15, 18) else w for i, w in enumerate(quoted)]
    return items, [*docs, (-1, " ".join(["x", *changed])), (-2, " ".join(["y"] * 3 + quoted[9:]))]


def test_common_stems_make_no_product(spark, monkeypatch):
    """Rows that are compared grow with the documents, not with documents times items; nothing is missed."""
    compared = []
    pairs = decontaminate._pairs

    def counted(*args):
        found = common.stored(pairs(*args), "pairs")
        compared.append(found.count())
        return found

    monkeypatch.setattr(decontaminate, "_pairs", counted)
    for n in (60, 240):
        items, docs = stems(n, random.Random(4))
        got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(-1, 3), (-2, 3)}
    assert compared[1] <= 4 * max(compared[0], 50)


@pytest.mark.parametrize("shared", [2, 1000])
def test_shared_seeds_against_brute_force(spark, monkeypatch, shared):
    """Items with common parts of all lengths: rare tokens or not, the same overlaps are found."""
    monkeypatch.setattr(decontaminate, "SHARED", shared)
    chance = random.Random(11)
    word = lambda: "".join(chance.choices("abcd", k=2))
    parts = [[word() for _ in range(n)] for n in (7, 12, 18, 30)]
    texts = [chance.choice(parts) + [word() for _ in range(chance.randint(0, 14))] + chance.choice([[], parts[1]]) for _ in range(60)]
    items = [(i, " ".join(t)) for i, t in enumerate(texts) if len(t) >= 8]
    docs = []
    for i in range(60):
        base = list(chance.choice(texts))
        for _ in range(chance.randint(0, 6)):
            base[chance.randrange(len(base))] = word()
        docs.append((i, " ".join([word() for _ in range(3)] + base + [word() for _ in range(3)])))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_overlaps(docs, items)


def test_a_large_benchmark_takes_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BITS", 1 << 12)
    items, docs = stems(30, random.Random(5))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(-1, 3), (-2, 3)}


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = {r.item_id: split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = {}
    for k, words in items.items():
        for i in range(len(words) - 9):
            grams.setdefault(tuple(words[i : i + 10]), set()).add(k)
    expected = set()
    for d, text in docs:
        words = split(text)
        for i in range(len(words) - 9):
            expected |= {(d, k) for k in grams.get(tuple(words[i : i + 10]), ())}
    assert {(r.doc_id, r.item_id) for r in queries.queries()["op8_decontamination"](spark, SF).collect()} == expected
