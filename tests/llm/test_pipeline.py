"""The quality classifier and the pipeline: held-out accuracy, defined cases, brute force for each stage."""

import hashlib
import zlib

import numpy as np
import pytest
from test_groups import brute_groups, brute_overlaps, brute_print
from test_texts import brute_lines

import corpus_pipeline
from sqltrail.llm import bpe, quality, queries

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def area(scores, labels):
    """Area under the ROC curve."""
    good, bad = scores[labels == 1], scores[labels == 0]
    return (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2


def test_held_out_accuracy(spark):
    rows = queries.queries()["op10_quality_classifier"](spark, MORE).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MORE}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MORE}/documents.parquet").count()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    judged = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    scores, predicted, true = map(np.array, zip(*judged, strict=True))
    assert len(judged) > 500 and area(scores, true) > 0.99 and (predicted == true).mean() > 0.98


def test_factors_equal_all_pairs():
    """The sum-of-squares identity against the sum over pairs."""
    chance = np.random.default_rng(1)
    machine = quality.FactorisationMachine(quality.BUCKETS + quality.STATISTICS)
    machine.w, machine.v, machine.base = chance.normal(size=machine.w.shape), chance.normal(size=machine.v.shape) * 0.1, 0.3
    at, values = quality.features("Some words, some WORDS again | 12\nline")
    x = machine.scaled(values)
    pairs = sum(machine.v[a] @ machine.v[b] * x[i] * x[j] for i, a in enumerate(at) for j, b in enumerate(at) if i < j)
    assert machine.score(at, values) == pytest.approx(1 / (1 + np.exp(-(0.3 + machine.w[at] @ x + pairs))))
    loaded = quality.FactorisationMachine.load(machine.dump())
    assert loaded.score(at, values) == machine.score(at, values)


def test_quality_cases(spark):
    texts = ["a good sentence of words", "### %%% $$$ ***", None, "", "x" * 100_000, "a good sentence of words"]
    rows = [(i, t, n, 0.5, "en") for i, (t, n) in enumerate(zip(texts, [24, None, 0, -5, 100_000, 24], strict=True))] + [(None, "no id", None, 0.1, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score double, lang string")
    known = [(i, int(i != 1), 0) for i in range(6)] + [(1, 0, 0), (99, 1, 0), (3, None, 0), (None, 1, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, text int")
    found = quality.report(docs, labels).collect()
    assert len(found) == 8 and all(0 <= r.score <= 1 for r in found) and all(r.held_out for r in found if r.doc_id is None)
    assert found == quality.report(docs, labels).collect()  # same rows, same model
    assert {r.score for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in quality.report(docs, labels.where("quality = 0")).collect()} == {0}
    assert quality.report(docs.limit(0), labels).count() == 0
    # neither labels of held-out rows nor id, language and source move a score
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - quality, quality) AS quality")
    assert [r.score for r in quality.report(docs, flipped).collect()] == [r.score for r in found]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in found)


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before it kept, against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if number < 4:
            assert docs.columns == columns
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            judged = [i for i in before if i in labels]
            assert np.mean([(i in after) == (labels[i] == 1) for i in judged]) > 0.95
        elif name == "line_dedup":
            expected = {i: text for i, _, _, text in brute_lines([(i, r.text) for i, r in before.items()], 10)}
            assert {i: r.text for i, r in after.items()} == expected and all(r.n_chars == len(r.text) for r in rows)
        elif name == "simhash_near_dedup":
            prints = {i: brute_print(r.text) for i, r in before.items()}
            group = brute_groups(prints.values())
            lowest = {}
            for i, p in prints.items():
                lowest[group[p]] = min(i, lowest.get(group[p], i))
            assert set(after) == set(lowest.values())
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            dirty = {d for d, _ in brute_overlaps([(i, r.text) for i, r in before.items() if i % 10 == 0 or i not in after], items)}
            assert dirty == set(before) - set(after)
        else:
            coder = bpe.encoder()
            for i, r in after.items():
                ids = coder.encode(before[i].text)
                assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, rows))


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, clashing columns and empty tables go through all stages."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    fields = "doc_id long, text string, lang string, source string, n_chars long, hash string, fp int, ids int"
    odd = [(1, None, None, None, None, "x", 1, 1), (None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", 1, 1)] + [(3, "Twice the same words.\nHere", "en", "s", 26, "x", 1, 1)] * 2
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, fields)
        for _, stage in corpus_pipeline.STAGES[1:4]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [f.split()[0] for f in fields.split(", ")]
        assert sorted(r.doc_id for r in corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()) == ([1, 3] if rows else [])
        good = corpus_pipeline.classify(spark, spark.createDataFrame(rows, fields), str(tmp_path))
        assert good.columns == docs.columns and good.count() <= len(rows)
