"""Toxicity: a convolutional text classifier over hashed word embeddings.

A text becomes its sequence of words. A word's embedding is the sum of some rows of one table: those of the hashes of the whole word and of
its beginnings and endings of a few bytes, so forms of one word are near each other, and two words share an embedding only
if all hashes meet. Filters of several widths run over the whole sequence, each filter keeps its
largest value (max pooling) after a ramp, and a logistic layer over these gives the score. Rows of the table that fewer than
``LEAST_DOCS`` training documents use are held at zero, so rare words are neutral instead of learnt by heart.

Training (numpy, Adagrad) takes every labelled row that is not held out (crc32 of the id as text, modulo 5, is 0), with its whole text.
The rows are dealt by the hash of their id over shards of about ``SHARD_ROWS`` rows and ``SHARD_CHARS`` code points. In each pass every shard is a
task that goes over its rows from the common model, and the parameters it changed come back as whole numbers. These are averaged
by Spark over the shards that changed them, so the next model does not depend on the order of tasks, and the driver holds
one model of fixed size. One shard alone makes all its passes in one task. As every filter passes its gradient to one window a text, a step
touches few rows of the table. Another fold of the
rows (modulo 5 is 1) is not trained on. It picks the pass after which its loss was lowest, and each language gets the
threshold of the best F1 on the fold's rows of that language, if ``LEAST_TOXIC`` of them are toxic; other languages take the
threshold of all rows, and 0.5 where that has none. Of several shards, thresholds are those of the best F1 among multiples of 1 / ``BINS``. The language is known to
the thresholds only, and no input of a score. Everything else is one pass over the documents. Long texts go in overlapping pieces everywhere.

Words: runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case.

Defined cases: a null text is an empty one; a text without words is scored by one zero vector. A null language is a language of its own.
A null id is held out. Null labels and labels without a document are not used; of repeated rows of one id and label the one with
the smallest text hash is used. Without labels of both classes the score is the share of label 1 (0.5 without any).
Repeated rows are scored each, alike. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS, SIZE = 1 << 17, 8
#: Bytes of the beginnings and endings of a word that are hashed besides the whole word.
HEADS, TAILS = (3, 4, 5, 6), (3, 4)
WIDTHS, FILTERS = (1, 2, 3), 12
#: Rows and code points of the training rows that one task takes.
SHARD_ROWS, SHARD_CHARS = 8_000, 32_000_000
#: Ids of the labelled rows are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Steps of the thresholds tried, and whole numbers to a unit of a parameter.
BINS, UNITS = 10_000, 1 << 36
LEAST_DOCS = 3
FOLDS, THRESHOLD = 5, 0.5
#: Toxic rows of the calibration fold that a language's own threshold takes.
LEAST_TOXIC = 10
#: Passes over the rows, or as many as make STEPS steps.
EPOCHS, STEPS, BATCH, RATE, DECAY = 6, 200, 64, 0.1, 1e-5
#: Passes over the rows of several shards, or as many as make STEPS steps in each.
SHARD_PASSES = 2
PIECE = 1 << 16
KNOWN_WORDS = 100_000
_CUT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def split(text: str | None) -> list[bytes]:
    """The words of a text."""
    return (text or "").encode().translate(_CUT).split()


def rows_of(word: bytes) -> list[int]:
    """Rows of the table for a word: the whole of it, its beginnings, its endings; row 0, which stays zero, where it is too short for one."""
    parts = [word, *(word[:n] if len(word) > n else None for n in HEADS), *(word[-n:] if len(word) > n else None for n in TAILS)]
    return [0 if part is None else 1 + xxhash.xxh64_intdigest(part, seed) % (BUCKETS - 1) for seed, part in enumerate(parts)]


class Vocabulary(dict):
    """Numbers of the words met so far, from 1 on, and the table's rows of each number."""

    def __init__(self):
        super().__init__()
        self.rows = np.zeros((1024, 1 + len(HEADS) + len(TAILS)), np.int32)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        if number >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[number] = rows_of(word)
        return number

    def numbers(self, text: str | None) -> np.ndarray:
        found = split(text)
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def log_odds(share: float) -> float:
    return float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1 - 1e-3)))


def passes(rows: int, least: int) -> int:
    return max(least, -(-STEPS // -(-rows // BATCH)))


def read(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The numbers of the words of each text, the table's rows of each number, and the texts that use each row."""
    known = Vocabulary()
    numbers = [known.numbers(t) for t in texts]
    used = np.zeros(BUCKETS, np.int32)
    for t in numbers:
        used[np.unique(known.rows[np.unique(t)])] += 1
    return numbers, known.rows, used


def pack(values: list[np.ndarray]) -> np.ndarray:
    """All values of a network's shape in rows of SIZE, the table first."""
    rest = np.concatenate([v.ravel() for v in values[1:]])
    return np.concatenate([values[0], np.pad(rest, (0, -len(rest) % SIZE)).reshape(-1, SIZE)])


def unpack(rows: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    rest, out, at = rows[BUCKETS:].ravel(), [rows[:BUCKETS].copy()], 0
    for v in like[1:]:
        out.append(rest[at : at + v.size].reshape(v.shape).copy())
        at += v.size
    return out


class Network:
    """The embedding table, the filters of each width with their biases, and the logistic layer."""

    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        self.table = np.zeros((BUCKETS, SIZE), np.float32)
        self.filters = [random.normal(0, 0.4 / np.sqrt(w), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = random.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.overall, self.thresholds = THRESHOLD, {}

    def _responses(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Of each width, what its filters say at each position; windows reach past the end into zeros, which the caller appends."""
        n = len(vectors) - max(WIDTHS) + 1
        return [sum(vectors[j : j + n] @ filters[j] for j in range(len(filters))) for filters in self.filters]

    def pooled(self, vectors: np.ndarray) -> np.ndarray:
        """The largest response of each filter over a whole text, given the embeddings of its words."""
        tail = max(WIDTHS) - 1
        padded = np.concatenate([vectors if len(vectors) else np.zeros((1, SIZE), np.float32), np.zeros((tail, SIZE), np.float32)])
        best = np.full(len(self.bias), -np.inf, np.float32)
        for at in range(0, len(padded) - tail, PIECE):
            best = np.maximum(best, np.concatenate([r.max(0) for r in self._responses(padded[at : at + PIECE + tail])]))
        return best

    def chance(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.base[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """The scores of texts; the embeddings of words are kept from text to text."""
        known, vectors = Vocabulary(), np.zeros((1, SIZE), np.float32)
        out = []
        for text in texts:
            if len(known) > KNOWN_WORDS:
                known, vectors = Vocabulary(), vectors[:1]
            numbers = known.numbers(text)
            if len(known) >= len(vectors):
                fresh = known.rows[len(vectors) : len(known) + 1]
                vectors = np.concatenate([vectors, self.table[fresh].sum(1)])
            out.append(self.chance(self.pooled(vectors[numbers])))
        return np.array(out, np.float64)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.filters, self.bias, self.out, self.base]

    def assign(self, values: list[np.ndarray]) -> None:
        self.table, *self.filters, self.bias, self.out, self.base = values

    def start(self, alive: np.ndarray, share: float, random: np.random.Generator) -> None:
        """Values before the first pass; ``alive`` flags the rows of the table that are learnt."""
        self.base[:] = log_odds(share)
        self.table = np.where(alive[:, None], random.normal(0, 0.05, self.table.shape), 0).astype(np.float32)
        self.state = [np.full_like(p, 1e-3) for p in self.parameters()]

    def _tops(self, texts: list[np.ndarray], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and filter the largest response, and the words of the first window that has it; texts go in lines of bounded length."""
        tail, count = max(WIDTHS) - 1, len(WIDTHS) * FILTERS
        pooled = np.full((len(texts), count), -np.inf, np.float32)
        words = np.zeros((len(texts), count, max(WIDTHS)), np.int64)
        lines, room = [[]], PIECE
        for i, text in enumerate(texts):
            for at in range(0, max(1, len(text)), PIECE):
                size = min(PIECE, max(1, len(text)) - at)
                if size > room:
                    lines, room = [*lines, []], PIECE
                lines[-1].append((i, at, size))
                room -= size
        for pieces in lines:
            # pieces of texts in one row with the words after them, zeros past the end; number 0 is no word
            sizes = np.array([size + tail for _, _, size in pieces])
            line = np.zeros(sizes.sum() + tail, np.int64)
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for begin, (i, at, size) in zip(begins, pieces, strict=True):
                part = texts[i][at : at + size + tail]
                line[begin : begin + len(part)] = part
            own = np.repeat(np.arange(len(pieces)), sizes)
            inside = np.arange(len(own)) - begins[own] < (sizes - tail)[own]
            rows = np.array([i for i, _, _ in pieces])
            tops, places = [], []
            for r in self._responses(self.table[slots[line]].sum(1)):
                r = np.where(inside[:, None], r[: len(inside)], -np.inf)
                top = np.maximum.reduceat(r, begins)
                at, column = np.nonzero(r == top[own])
                first = np.zeros(top.shape, np.int64)
                first[own[at[::-1]], column[::-1]] = at[::-1]
                tops.append(top)
                places.append(first)
            tops, places = np.concatenate(tops, axis=1), np.concatenate(places, axis=1)
            for row, top, place in zip(rows, tops, places, strict=True):
                better = top > pooled[row]
                pooled[row, better] = top[better]
                words[row, better] = line[place[better][:, None] + np.arange(max(WIDTHS))]
        return pooled, words

    def learn(self, numbers: list[np.ndarray], slots: np.ndarray, labels: np.ndarray, random: np.random.Generator) -> None:
        """One pass over texts, given as the numbers of their words and the table's rows of each number."""

        def step(k: int, p: np.ndarray, g: np.ndarray, rows: np.ndarray | slice = np.s_[:]) -> None:
            g = g + DECAY * p[rows]
            self.state[k][rows] += g * g
            p[rows] -= RATE * g / np.sqrt(self.state[k][rows])

        order = random.permutation(len(numbers))
        for start in range(0, len(order), BATCH):
            pick = order[start : start + BATCH]
            pooled, words = self._tops([numbers[i] for i in pick], slots)
            vectors = self.table[slots[words]].sum(3)
            raw = pooled + self.bias
            hidden = np.maximum(raw, 0)
            wrong = (1 / (1 + np.exp(-np.clip(hidden @ self.out + self.base, -30, 30))) - labels[pick]) / len(pick)
            back = (wrong[:, None] * self.out * (raw > 0)).astype(np.float32)
            where, grads, changes = [], [], []
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                g = back[:, own]
                change = np.zeros_like(self.filters[k])
                text, column = np.nonzero(g)
                for j in range(width):
                    change[j] = np.einsum("bfd,bf->df", vectors[:, own, j], g)
                    where.append(words[:, own, j][text, column])
                    grads.append(g[text, column][:, None] * self.filters[k][j].T[column])
                changes.append(change)
            for k, change in enumerate(changes):
                step(1 + k, self.filters[k], change)
            step(len(self.state) - 3, self.bias, back.sum(0))
            step(len(self.state) - 2, self.out, (hidden.T @ wrong).astype(np.float32))
            step(len(self.state) - 1, self.base, wrong.sum(keepdims=True).astype(np.float32))
            met, back_to = np.unique(np.concatenate(where), return_inverse=True)
            total = np.zeros((len(met), SIZE), np.float32)
            np.add.at(total, back_to, np.concatenate(grads))
            rows, back_to = np.unique(slots[met], return_inverse=True)
            table = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(table, back_to.ravel(), np.repeat(total, slots.shape[1], axis=0))
            if len(rows) and rows[0] == 0:
                rows, table = rows[1:], table[1:]
            step(0, self.table, table, rows)

    def scores_of(self, numbers: list[np.ndarray], slots: np.ndarray) -> np.ndarray:
        """As ``scores``, of texts that are read."""
        vectors = self.table[slots].sum(1)
        return np.array([self.chance(self.pooled(vectors[t])) for t in numbers], np.float64)

    def loss(self, scores: np.ndarray, labels: np.ndarray) -> float:
        """The sum over texts of the negative logarithm of what their labels are given."""
        found = np.clip(scores, 1e-6, 1 - 1e-6)
        return float(-np.sum(np.where(np.asarray(labels) == 1, np.log(found), np.log(1 - found))))

    def fit(self, texts: list[str | None], labels: np.ndarray, check: list[str | None] = (), check_labels: np.ndarray = (), share: float | None = None, seed: int = 7) -> Network:
        """Fits on texts; of all passes, the one that says most of the texts of ``check`` is kept. ``share`` is the true share of label 1."""
        mean = labels.mean() if len(labels) else 0.5
        share = mean if share is None else share
        if len(np.unique(labels)) < 2:
            self.base[:], self.out[:] = log_odds(share), 0
            return self
        random = np.random.default_rng(seed)
        numbers, slots, used = read(texts)
        alive = used >= LEAST_DOCS
        self.start(alive, mean, random)
        slots = np.where(alive[slots], slots, 0)
        best, kept = np.inf, None
        for _ in range(passes(len(texts), EPOCHS)):
            self.learn(numbers, slots, labels, random)
            if len(check):
                loss = self.loss(self.scores(check), check_labels)
                if loss < best:
                    best, kept = loss, [p.copy() for p in self.parameters()]
        if kept:
            self.assign(kept)
        self.base += log_odds(share) - log_odds(mean)
        return self

    def calibrate(self, scores: np.ndarray, labels: np.ndarray, groups: list[str | None], counts: np.ndarray | None = None) -> Network:
        """Thresholds of each group and of all rows; with ``counts``, scores are the lower ends of bins of as many rows."""

        def best(own: np.ndarray) -> float | None:
            order = np.argsort(-scores[own], kind="stable")
            rows = np.ones(len(own), np.int64) if counts is None else counts[own][order]
            ranked, right, flagged = scores[own][order], np.cumsum((labels[own][order] == 1) * rows), np.cumsum(rows)
            if not len(own) or right[-1] < LEAST_TOXIC:
                return None
            last = np.append(ranked[1:] != ranked[:-1], True)  # a threshold flags all rows of a score
            at = int(np.argmax(np.where(last, 2 * right / (flagged + right[-1]), 0)))
            return float((ranked[at] + ranked[at + 1]) / 2 if counts is None and at + 1 < len(ranked) else ranked[at])

        every = best(np.arange(len(scores)))
        self.overall = THRESHOLD if every is None else every
        self.thresholds = {}
        for group in sorted(set(groups), key=repr):
            found = best(np.array([i for i, g in enumerate(groups) if g == group], np.int64))
            if found is not None:
                self.thresholds[group] = found
        return self

    def dump(self) -> bytes:
        out = io.BytesIO()
        rows = np.flatnonzero(self.table.any(1))
        named = {f"filters{k}": f for k, f in enumerate(self.filters)}
        kept = [(g, t) for g, t in self.thresholds.items()]
        np.savez(out, rows=rows, table=self.table[rows], bias=self.bias, out=self.out, base=self.base, overall=self.overall, thresholds=np.array([t for _, t in kept]),
                 groups=np.array([g or "" for g, _ in kept], dtype=np.str_), named=np.array([g is not None for g, _ in kept], bool), **named)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        held, found = np.load(io.BytesIO(data)), cls()
        found.table[held["rows"]] = held["table"]
        found.filters = [held[f"filters{k}"] for k in range(len(WIDTHS))]
        found.bias, found.out, found.base, found.overall = held["bias"], held["out"], held["base"], float(held["overall"])
        found.thresholds = {str(g) if n else None: float(t) for g, n, t in zip(held["groups"], held["named"], held["thresholds"], strict=True)}
        return found


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(_fold(doc_id) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS, shard_chars: int = SHARD_CHARS) -> bytes:
    """The network fitted on, and its thresholds calibrated with, all labelled rows that are not held out."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    usable = usable.select(F.col("doc_id").alias("__id"), (F.col("toxic") == 1).cast("int").alias("__label"))
    counted = {r["__label"]: r["count"] for r in usable.groupBy("__label").count().collect()}
    toxic, all_ = counted.get(1, 0), sum(counted.values())
    ids = usable.distinct()
    rows = docs.join(F.broadcast(ids) if all_ <= BROADCAST_IDS else ids, F.col("doc_id") == F.col("__id")).select(
        F.col("__id").cast("string").alias("id"), F.col("__label").alias("label"), F.struct(F.xxhash64("text").alias("hash"), "lang", _fold(F.col("__id")).cast("int").alias("fold"), "text").alias("r")
    )
    once = stored(rows.groupBy("id", "label").agg(F.min("r").alias("r")).select("id", "label", "r.lang", "r.fold", "r.text"), "toxicity")
    n, chars = once.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    share = toxic / all_ if all_ else 0.5
    shards = max(-(-n // shard_rows), -(-chars // shard_chars))
    if shards > 1:
        return _train_shards(once, share, shards)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        texts, labelled, aside, langs = _arrays(group)
        model = Network().fit(list(texts[~aside]), labelled[~aside], list(texts[aside]), labelled[aside], share)
        model.calibrate(model.scores(texts[aside]), labelled[aside], langs)
        return pd.DataFrame({"model": [model.dump()]})

    fitted = once.groupBy().applyInPandas(fit, "model binary").collect()
    return fitted[0].model if fitted else Network().fit([], np.zeros(0)).dump()


def _arrays(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]:
    """Texts, labels and flags of the calibration fold of a group in the order of ids, and the languages of that fold."""
    group = group.sort_values(["id", "label"])
    aside = group["fold"].to_numpy() == 1
    return group["text"].to_numpy(object), group["label"].to_numpy().astype(np.float64), aside, [None if pd.isna(g) else g for g in group["lang"][aside]]


#: Rows of a shard's file that hold no text: the table's rows of each word, and the texts that use each row of the table.
SLOTS, USES = -1, -2


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of a shard as the numbers of their words, then its vocabulary."""
    known, used = Vocabulary(), np.zeros(BUCKETS, np.int32)
    for rows in batches:
        aside, numbers = rows["fold"].to_numpy() == 1, [known.numbers(t) for t in rows["text"]]
        for t in (t for t, a in zip(numbers, aside, strict=True) if not a):
            used[np.unique(known.rows[np.unique(t)])] += 1
        yield pd.DataFrame({"shard": rows["shard"], "label": rows["label"], "aside": aside, "lang": rows["lang"], "numbers": [t.astype(np.int32).tobytes() for t in numbers]})
    slots = known.rows[: len(known) + 1].tobytes()
    yield pd.DataFrame({"shard": [-1] * 2, "label": [SLOTS, USES], "aside": [False] * 2, "lang": [None] * 2, "numbers": [slots, used.tobytes()]})


class _Shard:
    """What ``_encode`` gave for a shard."""

    def __init__(self, batches: Iterator[pd.DataFrame]):
        every = pd.concat(list(batches))
        slots = every["numbers"][every["label"] == SLOTS].iloc[0]
        self.slots = np.frombuffer(slots, np.int32).reshape(-1, 1 + len(HEADS) + len(TAILS))
        rows = every[every["label"] >= 0]
        numbers = [np.frombuffer(t, np.int32).astype(np.int64) for t in rows["numbers"]]
        aside, labels = rows["aside"].to_numpy(bool), rows["label"].to_numpy(np.float64)
        self.learnt, self.checked = ([t for t, a in zip(numbers, aside, strict=True) if a == kind] for kind in (False, True))
        self.labels, self.check_labels = labels[~aside], labels[aside]
        self.langs = [None if pd.isna(g) else g for g in rows["lang"][aside]]
        self.number = int(rows["shard"].min()) if len(rows) else 0


def _train_shards(once: DataFrame, share: float, shards: int) -> bytes:
    """The network of rows of many tasks: in each pass all shards learn from the same values, and what they changed is averaged."""
    context = once.sparkSession.sparkContext
    dealt = once.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("id", "label")
    # texts are read once, and the kept rows stay where they are from pass to pass
    dealt = dealt.mapInPandas(_encode, "shard int, label int, aside boolean, lang string, numbers binary").persist(StorageLevel.DISK_ONLY)
    try:
        fitted = {(r.label, r.aside): r["count"] for r in dealt.where("label >= 0").groupBy("label", "aside").count().collect()}
        own = [fitted.get((k, False), 0) for k in (0, 1)]
        mean, checked = own[1] / max(1, sum(own)), sum(v for (_, aside), v in fitted.items() if aside)
        model = Network()
        if not all(own):
            model.fit([], np.zeros(0), share=share)
        else:

            def uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for rows in batches:
                    for used in (np.frombuffer(t, np.int32) for t in rows["numbers"]):
                        yield pd.DataFrame({"row": np.flatnonzero(used), "texts": used[used > 0]})

            found = dealt.where(F.col("label") == USES).select("numbers").mapInPandas(uses, "row int, texts int").groupBy("row").agg(F.sum("texts").alias("texts"))
            alive = np.zeros(BUCKETS, bool)
            alive[[r.row for r in found.where(F.col("texts") >= LEAST_DOCS).select("row").collect()]] = True
            alive[0] = False
            model.start(alive, mean, np.random.default_rng(7))
            _passes(dealt, model, alive, passes(max(1, sum(own) // shards), SHARD_PASSES), checked)
            model.base += log_odds(share) - log_odds(mean)
        shared = context.broadcast(model.parameters())

        def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shard, network = _Shard(batches), Network()
            network.assign(shared.value)
            floors = np.floor(network.scores_of(shard.checked, shard.slots) * BINS).astype(int)
            yield pd.DataFrame({"lang": pd.Series(shard.langs, dtype=object), "bin": floors, "label": shard.check_labels.astype(int)})

        counts = dealt.mapInPandas(bins, "lang string, bin int, label int").groupBy("lang", "bin", "label").count().toPandas()
        langs = [None if pd.isna(g) else g for g in counts["lang"]]
        model.calibrate(counts["bin"].to_numpy() / BINS, counts["label"].to_numpy(), langs, counts["count"].to_numpy())
        shared.destroy()
    finally:
        dealt.unpersist()
    return model.dump()


def _passes(dealt: DataFrame, model: Network, alive: np.ndarray, count: int, checked: int) -> None:
    """``count`` passes; leaves the values that had the lowest loss on the calibration fold, or the last ones where it is empty."""
    context = dealt.sparkSession.sparkContext
    names = [f"{kind}{k}" for kind in "ps" for k in range(SIZE)]
    schema = "row int, loss double, " + ", ".join(f"{name} long" for name in names)
    best, kept = np.inf, None
    for number in range(count + 1):
        shared = context.broadcast((model.parameters(), model.state, alive))

        def one_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shard, network = _Shard(batches), Network()
            values, state, alive = shared.value
            network.assign([v.copy() for v in values])
            loss = network.loss(network.scores_of(shard.checked, shard.slots), shard.check_labels) if number else 0.0
            out = pd.DataFrame({"row": [-1], "loss": [loss], **{name: [0] for name in names}})
            yield out
            if number < count and shard.learnt:
                network.state = [v.copy() for v in state]
                network.learn(shard.learnt, np.where(alive[shard.slots], shard.slots, 0), shard.labels, np.random.default_rng((number, shard.number)))
                moved = np.concatenate([pack(new).astype(np.float64) - pack(old) for new, old in ((network.parameters(), values), (network.state, state))], axis=1)
                rows = np.flatnonzero(moved.any(1))
                found = pd.DataFrame(np.rint(moved[rows] * UNITS).astype(np.int64), columns=names)
                yield found.assign(row=rows, loss=0.0)[out.columns]

        moved = dealt.mapInPandas(one_pass, schema)
        sums = moved.groupBy("row").agg(F.count(F.lit(1)).alias("shards"), F.sum("loss").alias("loss"), *[F.sum(name).alias(name) for name in names]).toArrow().to_pandas()
        shared.destroy()
        loss = float(sums["loss"][sums["row"] == -1].sum())
        if number and checked and loss < best:
            best, kept = loss, [p.copy() for p in model.parameters()]
        sums = sums[sums["row"] >= 0]
        means = sums[names].to_numpy(np.float64) / sums["shards"].to_numpy()[:, None] / UNITS
        for k, values in enumerate((model.parameters(), model.state)):
            rows = pack(values)
            rows[sums["row"].to_numpy()] += means[:, k * SIZE : (k + 1) * SIZE].astype(np.float32)
            new = unpack(rows, values)
            if k:
                model.state = new
            else:
                model.assign(new)
    if kept:
        model.assign(kept)


def score(docs: DataFrame, model: bytes) -> Column:
    """The probability of label 1, as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        network = Network.load(shared.value)
        for texts in batches:
            yield pd.Series(network.scores(texts), dtype="float64")

    return scores("text")


def thresholds(model: bytes, lang: Column) -> Column:
    """The calibrated threshold of a language."""
    known = Network.load(model)
    out = F.lit(known.overall)
    for group, value in known.thresholds.items():
        out = F.when(lang.eqNullSafe(F.lit(group)), F.lit(value)).otherwise(out)
    return out


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: held out or not, the score, the label predicted at 0.5, the threshold of its language, and the label at that."""
    model = train(docs, labels)
    scored = docs.select("doc_id", "lang", score(docs, model).alias("score"))
    limit = thresholds(model, F.col("lang"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        limit.alias("lang_threshold"),
        (F.col("score") >= limit).cast("int").alias("lang_predicted"),
    )
