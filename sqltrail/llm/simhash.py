"""SimHash near-dedup with the generalised pigeonhole principle.

Each text gets a 64-bit fingerprint: the majority of the bits of its shingles' hashes. Equal
fingerprints become one class. Classes whose fingerprints differ in at most ``distance`` bits are
linked, and components of linked classes are the groups.

Bits are grouped into partitions so that correlated bits stand together. If the thresholds T_i of m
partitions satisfy sum(T_i + 1) = distance + 1, two fingerprints within the distance are within T_i
on some partition i. Dynamic programming allocates the T_i (and so m) at the least estimated cost of
probes and candidates. The estimates come from a bounded sample (``SAMPLE`` fingerprints) and from
the number of classes; they decide the cost alone, never the result. Every class is put into the
index once for each partition with T_i >= 0 and probes all values within T_i; every candidate is
verified on all 64 bits.

Index entries and probes of a partition's value meet in one bucket. A bucket with more than
``BUCKET`` entries has its entries dealt over parts and its probes sent to each part, so no task
holds more than that; the list of such buckets has at most 1 / HOT_SHARE rows for each partition. Within a
bucket only links that join two groups not yet joined there leave the task, so a dense group of g
classes gives about g links, not g squared, while each pair of it is compared.

Defined cases: a null or empty text, or one without words, has the fingerprint zero and is linked
like any other. Fewer words than a shingle give one shingle of all words. Repeated rows have equal
fingerprints and so one group. Rows with a null ``doc_id`` take part; a group's id is its smallest
id that is not null, or null. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, stored
from .components import Forest, connected_components

BITS = 64
SAMPLE = 4_000
BUCKET = 50_000
HOT_SHARE = 1 / 10_000
#: Seconds for a probe row moved and for a candidate compared, as measured; only their ratio matters.
PROBE_COST, PAIR_COST = 3e-6, 4e-9
_BIT = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.int64)
_OFFSETS = (np.arange(8) * 256)[None, :]


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Bit i is set if it is set in over half the hashes; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: max(0, len(words) - width)].tolist()]
    ends = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], dtype="<u8")
    byte = hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS
    counts = np.bincount(byte.ravel(), minlength=2048).reshape(8, 256) @ _BIT
    bits = np.flatnonzero(2 * counts.ravel() > len(hashes))
    return int(sum(1 << int(i) for i in bits))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's bits as a signed long) and ``text_hash`` of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width, seed) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": found.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInPandas(run, f"doc_id {kind}, text_hash long, fp long")


# ------------------------------------------------------------------ partitions and thresholds


def _neighbours(width: int, t: int) -> int:
    """Values within t bits of a value of that width."""
    total, ways = 0, 1
    for i in range(t + 1):
        total += ways
        ways = ways * (width - i) // (i + 1)
    return total


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in groups of equal size, each grown by the bit that correlates most with those it has."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(0)
    norm = np.sqrt((bits**2).sum(0))
    near = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    free, groups = set(range(BITS)), []
    for p in range(parts):
        group = [min(free)]
        free.remove(group[0])
        for _ in range((BITS - p) // parts + ((BITS - p) % parts > 0) - 1):
            best = max(sorted(free), key=lambda b: near[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def _take(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each value, packed."""
    out = np.zeros_like(values)
    for i, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def plan(sample: np.ndarray, classes: int, distance: int) -> list[tuple[list[int], int]]:
    """Partitions (lists of bits) and their thresholds; those that are never probed are left out."""
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    half = max(1, len(sample) // 2)
    left, right = sample[:half], sample[half:][:half]
    for m in range(1, distance + 2):
        groups, cost = group_bits(sample, m), []
        for bits in groups:
            a, b = _take(left, bits), _take(right, bits)
            share = []
            for t in range(distance + 1):
                reach = _neighbours(len(bits), t)
                if reach > 2_000:
                    share.append(np.inf)
                    continue
                seen = np.mean([(np.bitwise_count(a ^ np.roll(b, s)) <= t).mean() for s in range(min(len(b), 256))]) if len(b) and len(a) == len(b) else 0
                share.append(classes * reach * PROBE_COST + classes**2 * max(seen, reach / 2.0 ** len(bits)) * PAIR_COST)
            cost.append([0.0, *share])
        # least[i][s]: the least cost of the first i partitions whose T + 1 sum to s
        least = [[0.0] + [np.inf] * (distance + 1)]
        chosen: list[list[int]] = []
        for c in cost:
            row, pick = [], []
            for s in range(distance + 2):
                options = [least[-1][s - x] + c[x] for x in range(s + 1)]
                x = int(np.argmin(options))
                row.append(options[x])
                pick.append(x)
            least.append(row)
            chosen.append(pick)
        if least[-1][distance + 1] < best[0]:
            s, found = distance + 1, []
            for bits, pick in zip(reversed(groups), reversed(chosen), strict=True):
                found.append((bits, pick[s] - 1))
                s -= pick[s]
            best = (least[-1][distance + 1], [(b, t) for b, t in reversed(found) if t >= 0])
    return best[1]


# ------------------------------------------------------------------ probe and verify


def _masks(bits: list[int], t: int) -> np.ndarray:
    """All packed words of that many bits with at most t ones, zero first."""
    masks = [0]
    level = [(0, -1)]
    for _ in range(t):
        level = [(mask | 1 << i, i) for mask, last in level for i in range(last + 1, len(bits))]
        masks += [mask for mask, _ in level]
    return np.array(masks, np.uint64)


def _entries(classes: DataFrame, parts: list[tuple[list[int], int]], probes: bool = True) -> DataFrame:
    """Rows ``part, value, fp, role``: 1 a probe, 2 an index entry and a probe of its own value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 5_000):
                fp = batch["fp"].to_numpy()[at : at + 5_000]
                for p, (bits, t) in enumerate(parts):
                    own, masks = _take(fp.view(np.uint64), bits), _masks(bits, t)
                    if t and probes:
                        value, who, role = (own[:, None] ^ masks[1:]).ravel(), np.repeat(fp, len(masks) - 1), 1
                        yield _frame(p, value, who, role)
                    yield _frame(p, own, fp, 2)

    return classes.select("fp").mapInPandas(run, "part int, value long, fp long, role byte")


def _frame(part: int, value: np.ndarray, fp: np.ndarray, role: int) -> pd.DataFrame:
    return pd.DataFrame({"part": np.full(len(fp), part, np.int32), "value": value.view(np.int64), "fp": fp, "role": np.full(len(fp), role, np.int8)})


class _Bucket:
    """The index entries of one bucket and the groups that its links have made so far."""

    def __init__(self, distance: int):
        self.distance, self.entries, self.held = distance, np.zeros(0, np.uint64), []
        self.forest = Forest(0)

    def add(self, fp: np.ndarray) -> None:
        self.held.append(fp)

    def probe(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of the probes that join groups of this bucket."""
        if self.held:
            self.entries, self.held = np.concatenate([self.entries, *self.held]), []
            self.forest = Forest(len(self.entries))
        a, b = [], []
        step = max(1, 2_000_000 // max(1, len(self.entries)))
        for at in range(0, len(fp) if len(self.entries) else 0, step):
            some = fp[at : at + step]
            rows, cols = np.nonzero(np.bitwise_count(some[:, None] ^ self.entries[None, :]) <= self.distance)
            rows, cols = self.forest.join(rows, cols)
            a.append(some[rows])
            b.append(self.entries[cols])
        if not a:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        a, b = np.concatenate(a), np.concatenate(b)
        return a[a != b], b[a != b]


def _small(fp: np.ndarray, starts: np.ndarray, entries: np.ndarray, probes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in many small buckets at once: every probe of a bucket against every entry of it."""
    pairs = entries * probes
    which = np.repeat(np.arange(len(starts)), pairs)
    nth = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    a = fp[starts[which] + nth % entries[which]]
    b = fp[starts[which] + entries[which] + nth // entries[which]]
    near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
    return a[near], b[near]


def _verify(entries: DataFrame, distance: int) -> DataFrame:
    """Links ``a, b`` found in buckets; rows come sorted by bucket, index entries before probes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, bucket = None, _Bucket(distance)
        for batch in batches:
            part, value, share = (batch[c].to_numpy() for c in ("part", "value", "share"))
            fp, role = batch["fp"].to_numpy().view(np.uint64), batch["role"].to_numpy()
            n = len(fp)
            if not n:
                continue
            new = np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0) | (np.diff(share) != 0)) + 1
            starts, ends = np.r_[0, new], np.r_[new, n]
            probes = np.add.reduceat(role.astype(np.int64), starts)
            held = ends - starts - probes
            # buckets that lie within this batch and are small need no state
            small = (starts > 0) & (ends < n) & (held <= 64) & (held * probes <= 4_096)
            out = [_small(fp, starts[pick], held[pick], probes[pick], distance) for pick in _portions(small, held * probes)]
            for i in np.flatnonzero(~small):
                s, e = starts[i], ends[i]
                if key != (now := (part[s], value[s], share[s])):
                    key, bucket = now, _Bucket(distance)
                bucket.add(fp[s : s + held[i]])
                if probes[i]:
                    out.append(bucket.probe(fp[s + held[i] : e]))
            if out:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return entries.mapInPandas(run, "a long, b long")


def _portions(chosen: np.ndarray, pairs: np.ndarray, most: int = 2_000_000) -> Iterator[np.ndarray]:
    """The chosen buckets that have pairs, in portions of bounded pairs."""
    chosen = np.flatnonzero(chosen & (pairs > 0))
    if len(chosen):
        portion = np.cumsum(pairs[chosen]) // most
        yield from np.split(chosen, np.flatnonzero(np.diff(portion)) + 1)


def links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """Links between fingerprints within the distance: all that components need, none that is not one."""
    sample = np.array([r.fp for r in classes.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    parts = plan(sample, classes.count(), distance)
    entries = _entries(classes, parts)
    sizes = _entries(classes, parts, probes=False).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.groupBy("part").agg(F.sum("n").alias("all"))
    # at most 1 / HOT_SHARE buckets of each partition are this large
    hot = sizes.join(F.broadcast(total), "part").where(F.col("n") > F.greatest(F.lit(BUCKET), F.col("all") * HOT_SHARE))
    hot = hot.select("part", "value", F.ceil(F.col("n") / BUCKET).cast("int").alias("shares"))
    dealt = entries.join(F.broadcast(hot), ["part", "value"], "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    # an entry lies in one share of its bucket, a probe goes to all
    entry = dealt.where("role = 2").select("part", "value", "fp", F.lit(0).cast("byte").alias("role"), F.pmod(F.xxhash64("fp"), "shares").cast("int").alias("share"))
    probe = dealt.select("part", "value", "fp", F.lit(1).cast("byte").alias("role"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    moved = entry.unionByName(probe).repartition("part", "value", "share").sortWithinPartitions("part", "value", "share", "role")
    return _verify(moved.select("part", "value", "fp", "role", "share"), distance)


def groups(classes: DataFrame, distance: int = 4) -> DataFrame:
    """``fp, component, component_id`` for every row of ``classes`` (``fp`` and ``first``, its smallest id)."""
    found = connected_components(links(classes, distance))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.select("fp", "component").join(lowest, "component").select("fp", "component", "component_id")


def report(docs: DataFrame, distance: int = 4) -> DataFrame:
    """Per row: its id, its fingerprint in hexadecimal and the smallest id of its group."""
    return assigned(docs, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def assigned(docs: DataFrame, distance: int = 4) -> DataFrame:
    """Per row ``doc_id, text_hash, fp, component, component_id``."""
    prints = stored(fingerprints(docs), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "simhash-classes")
    found = groups(classes, distance)
    return salted_join(prints, found, ["fp"], ["doc_id", "text_hash"], hot_keys(classes, ["fp"], "rows"), "inner").select("doc_id", "text_hash", "fp", "component", "component_id")


def deduplicate(docs: DataFrame, distance: int = 4) -> DataFrame:
    """One row of each group: of those with the group's id, the one with the smallest text hash.

    In a group without any id, that is the row with the smallest text hash of all. Columns are kept.
    """
    rows = assigned(docs, distance)
    rank = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")
    kept = rows.groupBy("component").agg(F.min(rank).alias("r")).select(F.col("r.doc_id").alias("__id"), F.col("r.text_hash").alias("__hash"))
    keyed = docs.withColumn("__text_hash", F.xxhash64("text"))
    joined = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    once = joined.dropDuplicates(["doc_id", "__text_hash"])
    return once.select(*docs.columns)
