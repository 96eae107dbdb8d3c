"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over f of ((sum v_if x_i)^2 - sum v_if^2 x_i^2) / 2): all pairwise
interactions at a rank of ``RANK``, in time linear in a document's distinct words.

Features of a whole text: words (ASCII lower case, cut at ASCII characters that are neither letters nor
digits) hashed into ``BUCKETS``, with logarithmic counts of unit length; statistics of its bytes, words and
lines; and numeric metadata columns. Id, language, source and labels are never inputs.

Training takes at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of their id, and never a
held-out one (crc32 of the id as text, modulo 5, is 0). Their features are gathered in one task, which fits
the model by Adam and returns it; its size is fixed. Everything else is one pass over the documents.

Defined cases: a null text is an empty one; empty texts are scored by their statistics. Null or
non-finite metadata has a feature of its own. A null id is held out. Null labels and labels without a document are
not used; of repeated rows of one id the one with the smallest text hash is used. Without labels of both classes the score is the
share of label 1 (0.5 without any). Of further columns only the named metadata are read. An empty table gives an empty table.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, RANK = 4096, 8
TRAIN_ROWS = 6_000
FOLDS = 5
THRESHOLD = 0.3
#: Passes over the sample, or as many as make STEPS steps.
EPOCHS, STEPS, BATCH, RATE, DECAY = 8, 600, 64, 0.01, 1e-4
KNOWN_WORDS = 200_000
_OTHER = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_CLASSES = np.zeros((256, 6))
for _c in range(256):
    _CLASSES[_c, 0] = 65 <= _c <= 90
    _CLASSES[_c, 1] = 97 <= _c <= 122
    _CLASSES[_c, 2] = 48 <= _c <= 57
    _CLASSES[_c, 3] = _c >= 128
    _CLASSES[_c, 4] = chr(_c) in " \t\n\r\x0b\x0c"
    _CLASSES[_c, 5] = chr(_c) in ".,;:?'\"-"
STATISTICS = 22


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = zlib.crc32(word) % BUCKETS
        return value


_words = _Words()


def features(text: str | None, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a document's features; statistics and metadata are not yet scaled."""
    raw = (text or "").encode()
    words = raw.translate(_OTHER).split()
    counts = np.bincount(np.fromiter(map(_words.__getitem__, words), np.int64, len(words)), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at])
    values /= max(1e-9, np.sqrt((values**2).sum()))
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, n_words = max(1, len(raw)), max(1, len(words))
    shares = byte @ _CLASSES / n
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    marks = np.sort(byte[[33, 35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126]])[::-1]
    lines = raw.count(b"\n") + 1
    statistics = np.array(
        [
            np.log1p(len(raw)), np.log1p(len(words)), *shares, 1 - shares.sum(), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
            len(at) / min(n_words, BUCKETS), np.log1p(lines), np.log1p(len(raw) / lines), *np.log1p(1000 * marks[:4] / n),
            np.log1p(100 * byte[[33, 63]].sum() / n_words), np.log1p(byte[124]), float(not words),
        ]
    )
    known = [np.nan if m is None else float(m) for m in metadata]
    extra = [x for m in known for x in ((np.log1p(abs(m)), 0.0) if np.isfinite(m) else (0.0, 1.0))]
    dense = np.concatenate([statistics, extra])
    return np.concatenate([at, BUCKETS + np.arange(len(dense))]), np.concatenate([values, dense])


class FactorisationMachine:
    """w0, weights w, factors v, and the scale of the features that are not words."""

    def __init__(self, size: int):
        self.base, self.w, self.v = 0.0, np.zeros(size), np.zeros((size, RANK))
        self.mean, self.spread = np.zeros(size - BUCKETS), np.ones(size - BUCKETS)

    def scaled(self, values: np.ndarray) -> np.ndarray:
        """The last features of a document are the dense ones."""
        k = len(self.mean)
        return np.concatenate([values[:-k], np.clip((values[-k:] - self.mean) / self.spread, -4, 4) / 4])

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        x = self.scaled(values)
        v = self.v[at]
        mixed = ((x @ v) ** 2 - (x**2) @ (v**2)).sum() / 2
        return float(1 / (1 + np.exp(-np.clip(self.base + self.w[at] @ x + mixed, -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> FactorisationMachine:
        share = labels.mean() if len(labels) else 0.5
        if len(np.unique(labels)) < 2:
            self.base = float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -6, 6))
            return self
        k = len(self.mean)
        dense = np.array([values[-k:] for _, values in rows])
        self.mean, self.spread = dense.mean(0), np.maximum(dense.std(0), 1e-6)
        x = np.zeros((len(rows), len(self.w)), np.float32)
        for i, (at, values) in enumerate(rows):
            x[i, at] = self.scaled(values)
        random = np.random.default_rng(seed)
        p = [np.array([np.log(share / (1 - share))]), self.w, random.normal(0, 0.05, self.v.shape)]
        m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(max(EPOCHS, -(-STEPS // -(-len(x) // BATCH)))):
            order = random.permutation(len(x))
            for start in range(0, len(x), BATCH):
                pick = order[start : start + BATCH]
                b, y = x[pick].astype(np.float64), labels[pick]
                inner = b @ p[2]
                square = b**2
                z = p[0] + b @ p[1] + (inner**2 - square @ p[2] ** 2).sum(1) / 2
                wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(pick)
                steps = [wrong.sum(keepdims=True), b.T @ wrong, b.T @ (wrong[:, None] * inner) - (square.T @ wrong)[:, None] * p[2]]
                t += 1
                for j, g in enumerate(steps):
                    g = g + DECAY * p[j] * (j > 0)
                    m[j] = 0.9 * m[j] + 0.1 * g
                    s[j] = 0.999 * s[j] + 0.001 * g**2
                    p[j] = p[j] - RATE * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)
        self.base, self.w, self.v = float(p[0][0]), p[1], p[2]
        return self

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, base=self.base, w=self.w, v=self.v, mean=self.mean, spread=self.spread)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> FactorisationMachine:
        held = np.load(io.BytesIO(data))
        found = cls(len(held["w"]))
        found.base, found.w, found.v, found.mean, found.spread = float(held["base"]), held["w"], held["v"], held["mean"], held["spread"]
        return found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), most: int = TRAIN_ROWS) -> bytes:
    """The model fitted on at most ``most`` labelled rows that are not held out."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    # the bound is what makes this broadcast safe
    chosen = usable.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__label")).orderBy(F.xxhash64("__id"), "__id", "__label").limit(most)
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select(
        "__id", "__label", F.xxhash64("text").alias("__hash"), "text", *[F.col(c).cast("double").alias(f"__m{i}") for i, c in enumerate(metadata)]
    )
    names = [f"__m{i}" for i in range(len(metadata))]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t, m) for t, m in zip(batch["text"], zip(*(batch[c] for c in names), strict=True) if names else [()] * len(batch), strict=True)]
            yield pd.DataFrame({"id": batch["__id"], "label": batch["__label"].astype("int32"), "hash": batch["__hash"], "at": [a.astype(np.int32) for a, _ in found], "values": [v for _, v in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    described = rows.mapInPandas(describe, f"id {kind}, label int, hash long, at array<int>, values array<double>")
    once = described.groupBy("id", "label").agg(F.min(F.struct("hash", "at", "values")).alias("r")).select("id", "label", "r.at", "r.values")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "label"])
        model = FactorisationMachine(BUCKETS + STATISTICS + 2 * len(names))
        model.fit(list(zip(map(np.asarray, group["at"]), map(np.asarray, group["values"]), strict=True)), (group["label"].to_numpy() == 1).astype(np.float64))
        return pd.DataFrame({"model": [model.dump()]})

    fitted = once.groupBy().applyInPandas(fit, "model binary").collect()
    return fitted[0].model if fitted else FactorisationMachine(BUCKETS + STATISTICS + 2 * len(names)).dump()


def score(docs: DataFrame, model: bytes, metadata: tuple[str, ...] = ("n_chars",)) -> Column:
    """The probability of label 1, as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        machine = FactorisationMachine.load(shared.value)
        for text, *known in batches:
            rows = zip(*known, strict=True) if known else [()] * len(text)
            yield pd.Series([machine.score(*features(t, m)) for t, m in zip(text, rows, strict=True)], dtype="float64")

    return scores("text", *[F.col(c).cast("double") for c in metadata])


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document whether it is held out, its score and the predicted label."""
    scored = docs.select("doc_id", score(docs, train(docs, labels)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that the classifier does not reject, all columns kept."""
    return docs.where(predicted(score(docs, train(docs, labels)), threshold) == 1)
