"""Benchmark decontamination by spaced seeds.

A mask takes six of up to 18 token positions and ignores the others, so a hash over it survives substitutions
at the ignored places. The masks are pairs of three-token blocks (items of 15 tokens or more) or triples of
two-token blocks (shorter items), at every distance in blocks. A window that is cut into more blocks than it has
substitutions keeps enough whole ones, so every placement of the substitutions that ``IDENTITY`` allows in
min(``WINDOW``, item length) tokens leaves one mask untouched (other windows or a lower identity may miss some).
Benchmark items are hashed at every position under each mask;
documents likewise, whole. A document's hash first has to be in a bitmap of the benchmark's hashes, whose
size is bounded (``MAX_BITS``) and which only saves work: what passes meets the benchmark in an ordinary join,
so nothing depends on the bitmap's precision. A benchmark too large for one bitmap is scanned for in several passes, each for a share of the hashes. Each hash carries the tokens
around it. After the join those are compared along the diagonal, and a hit counts if some window of
``window`` tokens around it (or the whole item, if that is shorter) agrees in ``identity`` of its places.

Items may share a question's stem, and documents hold it that quote no item. A seed of more than ``SHARED`` items is therefore
joined on one more token: a window with no more substitutions than it may have agrees in some of its tokens that few of these items have
at that place, if it has more of such tokens than substitutions. Documents and items meet on (seed, place, token) of such tokens only, so a document
meets at most ``SHARED`` items for each token around it, and each pair is compared once. Items with fewer rare tokens in some
window (nearly the whole window is common to many items, and a document with it does overlap with many) are joined on the seed.

Hits are joined on the hash. A passage that a third of all documents quote is one hash with many document
rows and one benchmark row, as equal items are one class, and such hashes are salted.

Tokens: text in lower case (ASCII), cut at ASCII characters that are neither letters nor digits and at the
punctuation, symbols, separators and controls of Unicode. Each character of a script that is written without
spaces (Chinese, Japanese, Thai, ...) is a token. Items of fewer than ``MIN_TOKENS`` tokens are looked for
exactly, as a whole sequence of tokens anywhere in a document: one hash for the item, and one row for a document
that has it, with the number of its places. However short, such an item marks every document with its words.

Defined cases: null and empty texts have no tokens and are clean. Repeated documents are judged each (rows
of one ``doc_id`` are reported together), null ids are reported as null. Equal items (by tokens) are reported
under their smallest id. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, stored

#: Masks by number: the length of their blocks and where the blocks begin.
LONG = {g: (3, (0, 3 * g)) for g in range(1, 6)}
SHORT = {10 * a + b: (2, (0, 2 * a, 2 * (a + b))) for a, b in ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2))}
LONG_TOKENS, MIN_TOKENS = 15, 8
EXACT = {100 + n: (n, (0,)) for n in range(1, MIN_TOKENS)}
WINDOW, IDENTITY = 20, 0.8
MAX_BITS, BITS_EACH, LEAST_BITS = 1 << 27, 1024, 16
#: Items that may share a seed, or a token beside a shared seed, before other tokens are asked for.
SHARED = 32
KNOWN_WORDS = 200_000
_OTHER = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


#: Scripts without spaces between words, as ranges of code points.
_UNSPACED = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u2e80-\u2fdf\u3005-\u3007\u3021-\u30ff\u3105-\u312f\u31a0-\u31bf"
    "\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001aff0-\U0001b16f\U00020000-\U0003ffff]"
)


class _Spacing(dict):
    """By code point what stands for a character: a space, itself, or itself between spaces."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        cut = code >= 128 and (unicodedata.category(char)[0] in "PSZ" or unicodedata.category(char) == "Cc" or char == "\u200b")
        self[code] = value = " " if cut else f" {char} " if _UNSPACED.match(char) else char
        return value


_spacing = _Spacing()
#: What the spacing changes; beyond the first plane it is asked about every character.
_SPACED = re.compile("[" + "".join(f"\\U{c:08x}" for c in range(128, 0x10000) if _spacing[c] != chr(c)) + "\U00010000-\U0010ffff]")


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def split(text: str | None) -> list[bytes]:
    """The tokens of a text."""
    text = text or ""
    if not text.isascii() and _SPACED.search(text):
        text = text.translate(_spacing)
    return text.encode().translate(_OTHER).split()


def tokens(text: str | None) -> np.ndarray:
    """Hash of each token of a text."""
    words = split(text)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _mixed(parts: list[np.ndarray], number: int) -> np.ndarray:
    """One hash of the values at each place, in their order."""
    total = np.full(len(parts[0]), np.uint64(number))
    for part, odd in zip(parts, _ODD, strict=False):
        part = part * odd
        total = total * np.uint64(31) + (part ^ (part >> np.uint64(29)))
    total ^= total >> np.uint64(32)
    return total * _ODD[1]


def masks(n_tokens: int) -> dict[int, tuple[int, tuple[int, ...]]]:
    """The masks for an item of so many tokens."""
    if n_tokens < MIN_TOKENS:
        return {n: mask for n, mask in EXACT.items() if mask[0] == n_tokens}
    return SHORT if n_tokens < LONG_TOKENS else LONG


def seeds(token: np.ndarray, numbered: dict[int, tuple[int, tuple[int, ...]]]) -> Iterator[tuple[int, np.ndarray]]:
    """For each mask its number and the hash under it at each position where it fits."""
    blocks: dict[int, np.ndarray] = {}
    for number, (size, starts) in numbered.items():
        n = len(token) - size - starts[-1] + 1
        if n <= 0:
            continue
        if size not in blocks:
            blocks[size] = _mixed([token[i : len(token) - size + 1 + i] for i in range(size)], size)
        yield number, _mixed([blocks[size][at : at + n] for at in starts], number)


def _around(token: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """32 bits of each token from ``window`` before a position to ``window`` after it; 0 beyond the text."""
    short = (token >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    padded = np.concatenate([np.zeros(window, np.uint32), short, np.zeros(window, np.uint32)])
    return padded[at[:, None] + np.arange(2 * window)[None, :]]


_ITEM = "hash long, mask int, item_id long, item_at int, item_tokens int, item_around binary"
_PAIR = ["doc_id", "doc_at", "doc_last", "places", "around", "item_id", "item_at", "item_tokens", "item_around"]


def item_seeds(items: DataFrame, window: int) -> DataFrame:
    """Every seed of every item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"], strict=True):
                token = tokens(text)
                for number, found in seeds(token, masks(len(token))):
                    at = np.arange(len(found))
                    around = _around(token, at, window)
                    yield pd.DataFrame({"hash": found.view(np.int64), "mask": np.int32(number), "item_id": item, "item_at": at.astype(np.int32), "item_tokens": np.int32(len(token)),
                                        "item_around": [x.tobytes() for x in around]})

    return items.mapInPandas(run, _ITEM)


def item_classes(items: DataFrame) -> DataFrame:
    """One row for items of equal tokens: the smallest id and a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch["text"].map(lambda t: b" ".join(split(t)).decode("utf-8", "replace"))
            yield pd.DataFrame({"item_id": batch["item_id"], "text": words})

    return items.select(F.col("item_id").cast("long"), "text").mapInPandas(run, "item_id long, text string").groupBy("text").agg(F.min("item_id").alias("item_id"))


def bitmap(item_hashes: DataFrame) -> tuple[bytes, int]:
    """Bits of the hashes, each set at two places, and the binary logarithm of their number, at most that of ``MAX_BITS``."""
    n = item_hashes.count()
    power = min(MAX_BITS.bit_length() - 1, max(20, (BITS_EACH * n).bit_length()))
    shift = 64 - power
    places = F.array(F.shiftrightunsigned("hash", shift), F.shiftrightunsigned(F.shiftleft("hash", 20), shift))
    words = item_hashes.select(F.explode(places).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 31 AS INT)))").alias("bits"))
    bits = np.zeros(1 << (power - 5), np.uint32)
    held = words.toPandas()  # at most MAX_BITS / 32 rows
    bits[held["word"].to_numpy()] = held["bits"].to_numpy().astype(np.uint32)
    return bits.tobytes(), power


def _in_bitmap(hashes: np.ndarray, bits: np.ndarray, power: int) -> np.ndarray:
    shift = np.uint64(64 - power)

    def there(bit: np.ndarray) -> np.ndarray:
        return (bits[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1

    first = np.flatnonzero(there(hashes >> shift))
    return first[there((hashes[first] << np.uint64(20)) >> shift)]


def _agree(left: bytes, right: bytes, window: int, item_at: np.ndarray, item_tokens: np.ndarray, identity: float) -> np.ndarray:
    """For each hit the best share of equal tokens in a window over the hit's first token; below ``identity``: 0."""
    a = np.frombuffer(left, np.uint32).reshape(-1, 2 * window)
    b = np.frombuffer(right, np.uint32).reshape(-1, 2 * window)
    same = np.concatenate([np.zeros((len(a), 1), np.int32), np.cumsum((a == b) & (a != 0), axis=1, dtype=np.int32)], axis=1)
    size = np.minimum(window, item_tokens)
    # windows that lie within the item and hold the position: starts as offsets into the context
    low = np.maximum(window - size + 1, window - item_at)
    high = np.minimum(window, window - item_at + item_tokens - size)
    best = np.zeros(len(a))
    rows = np.arange(len(a))
    for start in range(window + 1):
        fits = (start >= low) & (start <= high)
        equal = same[rows, np.minimum(start + size, 2 * window)] - same[:, start]
        best = np.maximum(best, np.where(fits, equal / size, 0))
    return np.where(best >= identity - 1e-9, best, 0)


def _tokens_around(rows: DataFrame, column: str, keep: list[str], window: int) -> DataFrame:
    """The tokens around each seed as rows: ``place`` (from the context's start) and ``token``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            around = np.frombuffer(b"".join(batch[column]), np.int32).reshape(-1, 2 * window)
            row, place = np.nonzero(around)
            yield batch[keep].iloc[row].assign(place=place.astype(np.int32), token=around[row, place])

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return rows.select(*keep, column).mapInPandas(run, f"{fields}place int, token int")


def _pairs(hits: DataFrame, known: DataFrame, window: int, identity: float) -> DataFrame:
    """Seeds of documents and items to be compared: those of one hash or, where many items share it, of one more rare token."""
    shared = known.groupBy("hash").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") > SHARED).select("hash")
    if shared.isEmpty():
        return _by_hash(hits, known)
    shared = stored(shared, "shared-seeds")
    crowd = known.where(F.col("item_tokens") >= MIN_TOKENS).join(shared, "hash", "left_semi")
    tokens = stored(_tokens_around(crowd, "item_around", ["seed", "hash"], window), "shared-seed-tokens")
    place = ["hash", "place", "token"]
    rare = tokens.join(tokens.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= SHARED).drop("n"), place)
    held = crowd.join(rare.groupBy("seed").agg(F.collect_list("place").alias("rare")), "seed")
    # windows as in _agree: each has to hold more rare tokens than it may have substitutions
    size = F.least(F.lit(window), F.col("item_tokens"))
    low, high = F.greatest(window - size + 1, window - F.col("item_at")), F.least(F.lit(window), window - F.col("item_at") + F.col("item_tokens") - size)
    allowed = size - F.ceil(F.lit(identity) * size - F.lit(1e-9))
    enough = F.forall(F.sequence(low, high), lambda start: F.size(F.filter("rare", lambda at: (at >= start) & (at < start + size))) > allowed)
    apart = stored(held.where(enough).select("seed"), "rare-seeds")
    direct = _by_hash(hits, known.join(apart, "seed", "left_anti"))
    crowded = hits.join(shared, "hash", "left_semi")
    asked = stored(_tokens_around(crowded, "around", ["hit", "hash"], window), "shared-hit-tokens")
    asked = asked.join(rare.select(*place).distinct(), place, "left_semi")
    hot = hot_keys(stored(asked.groupBy(*place).agg(F.count(F.lit(1)).alias("n")), "shared-hit-counts"), place, "n")
    met = salted_join(asked, rare.join(apart, "seed", "left_semi"), place, ["hit"], hot, "inner").select("hit", "seed").distinct()
    met = stored(met, "rare-pairs")
    hot = hot_keys(stored(met.groupBy("seed").agg(F.count(F.lit(1)).alias("n")), "rare-pair-counts"), ["seed"], "n")
    through = salted_join(met, known.drop("hash", "mask"), ["seed"], ["hit"], hot, "inner").join(hits.drop("hash"), "hit")
    return direct.unionByName(through.select(*_PAIR))


def _by_hash(hits: DataFrame, known: DataFrame) -> DataFrame:
    counts = stored(hits.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "benchmark-hit-counts")
    return salted_join(hits, known, ["hash"], ["doc_id", "doc_at"], hot_keys(counts, ["hash"], "n"), "inner").select(*_PAIR)


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, identity: float = IDENTITY) -> DataFrame:
    """Per document and item class that overlap: hits that count, first and last token of the hits, best identity."""
    context = docs.sparkSession.sparkContext
    known = stored(item_seeds(item_classes(items), window).withColumn("seed", F.monotonically_increasing_id()), "benchmark-seeds")
    seeds_ = known.select("hash").distinct()
    passes = max(1, -(-seeds_.count() * LEAST_BITS // MAX_BITS))
    used = {r.mask for r in known.select("mask").distinct().collect()}
    numbered = {number: mask for number, mask in (EXACT | SHORT | LONG).items() if number in used}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame], shared, power: int, turn: int) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            rows, size = [], 0
            for doc, text in zip(batch["doc_id"].astype(object), batch["text"], strict=True):
                token = tokens(text)
                for number, found in seeds(token, numbered):
                    at = last = _in_bitmap(found, bits, power)
                    if passes > 1:
                        at = last = at[found[at].view(np.int64) % passes == turn]
                    places = np.ones(len(at), np.int64)
                    if number in EXACT and len(at):  # the places of an exact hash differ in nothing
                        _, first, group, places = np.unique(found[at], return_index=True, return_inverse=True, return_counts=True)
                        last = np.zeros(len(first), np.int64)
                        np.maximum.at(last, group, at)
                        at = at[first]
                    for i in range(0, len(at), 5_000):
                        some = at[i : i + 5_000]
                        rows.append((doc, found[some].view(np.int64), some, _around(token, some, window), last[i : i + 5_000], places[i : i + 5_000]))
                        size += len(some)
                        if size > 20_000:
                            yield _hits(rows)
                            rows, size = [], 0
            if rows:
                yield _hits(rows)

    def _hits(rows: list[tuple]) -> pd.DataFrame:
        counts = [len(r[1]) for r in rows]
        doc = pd.Series(np.repeat(np.array([r[0] for r in rows] + [None], object)[:-1], counts), dtype=object)
        doc = doc.where(doc.notna(), None)
        around = np.concatenate([r[3] for r in rows])
        return pd.DataFrame({"doc_id": doc, "hash": np.concatenate([r[1] for r in rows]), "doc_at": np.concatenate([r[2] for r in rows]).astype(np.int32),
                             "doc_last": np.concatenate([r[4] for r in rows]).astype(np.int32), "places": np.concatenate([r[5] for r in rows]), "around": [x.tobytes() for x in around]})

    found = None
    for turn in range(passes):
        flat, power = bitmap(seeds_.where(F.pmod("hash", F.lit(passes)) == turn))
        shared = context.broadcast(flat)
        one = docs.select("doc_id", "text").mapInPandas(lambda batches, s=shared, p=power, t=turn: scan(batches, s, p, t), f"doc_id {kind}, hash long, doc_at int, doc_last int, places long, around binary")
        one = stored(one.withColumn("hit", F.monotonically_increasing_id()), "benchmark-hits")
        found = one if found is None else found.unionByName(one.withColumn("hit", F.col("hit") + F.lit(turn << 58)))
    pairs = _pairs(found, known, window, identity)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            size = batch["item_tokens"].to_numpy()
            best = _agree(b"".join(batch["around"]), b"".join(batch["item_around"]), window, batch["item_at"].to_numpy(), size, identity)
            best = np.where((size < MIN_TOKENS) & (best < 1), 0, best)
            kept = batch[best > 0]
            yield pd.DataFrame({"doc_id": kept["doc_id"], "item_id": kept["item_id"], "doc_at": kept["doc_at"], "doc_last": kept["doc_last"], "places": kept["places"], "identity": best[best > 0]})

    checked = pairs.mapInPandas(verify, f"doc_id {kind}, item_id long, doc_at int, doc_last int, places long, identity double")
    return checked.groupBy("doc_id", "item_id").agg(
        F.sum("places").alias("n_hits"), F.min("doc_at").alias("first_token"), F.max("doc_last").alias("last_token"), F.max("identity").alias("identity")
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, identity: float = IDENTITY) -> DataFrame:
    """The rows whose document overlaps with no item; a null ``doc_id`` is matched as a value."""
    found = overlaps(docs, items, window, identity).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__found")), "left_anti")
