"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A text is cut into pieces by the tokenizer's pattern and each piece is merged on its own. Over the
byte positions of a piece stands a segment tree whose leaf i holds the rank of the pair made by the
token that starts at i and its right neighbour; the root gives the lowest rank and a walk down its
leftmost place. A merge changes two live leaves and clears one, each a logarithmic update, so a
piece of a million bytes costs n log n. Short pieces, which are nearly all, go through the same tree
many at a time, as columns of arrays; long ones go one by one.

The text is first cut at white space, where no piece of the pattern crosses; what lies between is
looked up in a bounded cache, so a frequent word is split and merged once for a while.

Defined cases: a null text is an empty one, with no tokens and an empty decoding. Repeated rows are
encoded each. Texts are whole, whatever their length. An empty table gives an empty table. Other columns are not read. Lone
surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
#: The Unicode property White_Space, which the pattern's ``\s`` means.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SHORT = 64
AT_ONCE = 3_000
CACHE_UNITS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class RankTree:
    """Segment tree over byte positions: the lowest pair rank and its leftmost position."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        low = [int(NONE)] * (2 * self.size)
        low[self.size : self.size + len(ranks)] = ranks
        for i in range(self.size - 1, 0, -1):
            low[i] = min(low[2 * i], low[2 * i + 1])
        self.low = low

    def put(self, i: int, rank: int) -> None:
        low, i = self.low, i + self.size
        low[i] = rank
        while i > 1:
            i >>= 1
            best = min(low[2 * i], low[2 * i + 1])
            if low[i] == best:
                return
            low[i] = best

    def leftmost(self) -> int:
        low, i = self.low, 1
        while i < self.size:
            i = 2 * i if low[2 * i] == low[1] else 2 * i + 1
        return i - self.size


class Encoder:
    """Encodes and decodes by a rank file; ``pattern`` splits the text before merging.

    ``cut``: no match of the pattern goes on after white space, but for a space that begins it; so texts may
    be cut there first. True of the usual byte-level patterns.
    """

    def __init__(self, path: str, pattern: str, cut: bool = True, cache_units: int = CACHE_UNITS):
        self.ranks = load_ranks(path)
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern)
        self.cut = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]") if cut else self.split
        self.singles = np.full(256, NONE, np.int32)
        for b in range(256):
            self.singles[b] = self.ranks.get(bytes([b]), NONE)
        self._pairs()
        self.cache: dict[str, tuple[int, ...]] = {}
        self.merged: dict[str, tuple[int, ...]] = {}
        self.cache_units = cache_units

    def _pairs(self) -> None:
        """Rank of the joined token for each pair of tokens that make one, ordered by the pair."""
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(2**62))
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int32, len(pairs))[order], NONE)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pair ranks, NONE where a pair makes no token or either side is missing (negative)."""
        key = (a << 32) | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], NONE)

    def _merge_short(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Pieces of at most ``size`` bytes (a power of two), each with its own tree, a merge of each at a time.

        The trees and lists are rows of flat arrays: node x of piece r is at ``r * 2 * size + x``.
        """
        n, wide = len(pieces), size + 1
        lengths = np.fromiter(map(len, pieces), np.int64, n)[:, None]
        flat = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(n, size)
        places = np.arange(wide)
        ids = np.full((n, wide), -1, np.int64)  # the token that starts here; the last column is no token
        ids[:, :size] = np.where(places[:size] < lengths, self.singles[flat], -1)
        after = np.where(places + 1 < lengths, places + 1, size)
        ahead = np.broadcast_to(places - 1, (n, wide)).copy()
        low = np.full((n, 2 * size), NONE, np.int64)
        some = np.nonzero(places[: size - 1] + 1 < lengths)
        low[some[0], some[1] + size] = self._rank(ids[some], ids[some[0], some[1] + 1])
        for i in range(size - 1, 0, -1):
            low[:, i] = np.minimum(low[:, 2 * i], low[:, 2 * i + 1])
        low, ids, after, ahead = low.ravel(), ids.ravel(), after.ravel(), ahead.ravel()
        levels = size.bit_length() - 1
        live = np.arange(n)
        while True:
            root = live * (2 * size)
            best = low[root + 1]
            going = best != NONE
            if not going.any():
                break
            live, root, best = live[going], root[going], best[going]
            node = np.ones(live.size, np.int64)
            for _ in range(levels):
                node += node
                node += low[root + node] != best
            i, base = node - size, live * wide
            j = after[base + i]
            k = after[base + j]
            ids[base + i], ids[base + j] = best, -1
            after[base + i] = k
            ahead[base + k] = i  # the last column takes what lies beyond the end
            p = ahead[base + i]
            left = np.maximum(p, 0)
            leaf = root + size
            low[leaf + j] = NONE
            low[leaf + i] = self._rank(best, ids[base + k])
            low[leaf + left] = np.where(p >= 0, self._rank(ids[base + left], best), low[leaf + left])
            nodes = [i + size, j + size, left + size]
            for _ in range(levels):
                for which in range(3):
                    nodes[which] >>= 1
                    at = root + nodes[which]
                    below = at + nodes[which]
                    low[at] = np.minimum(low[below], low[below + 1])
        kept = ids.reshape(n, wide)[:, :size] >= 0
        values, ends = ids.reshape(n, wide)[:, :size][kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(values[a:b]) for a, b in itertools.pairwise([0, *ends])]

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        ranks, none, longest = self.ranks, int(NONE), 2 * self.longest
        n = len(piece)
        after, ahead = list(range(1, n + 1)), list(range(-1, n))

        def rank(i: int) -> int:
            j = after[i]
            if j >= n or after[j] - i > longest:
                return none
            return ranks.get(piece[i : after[j]], none)

        tree = RankTree([rank(i) for i in range(n)])
        while tree.low[1] != none:
            i = tree.leftmost()
            j = after[i]
            after[i] = after[j]
            if after[j] < n:
                ahead[after[j]] = i
            tree.put(j, none)
            tree.put(i, rank(i))
            if i:
                tree.put(ahead[i], rank(ahead[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def merge(self, pieces: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The ids of each piece."""
        out: dict[bytes, tuple[int, ...]] = {}
        short: dict[int, list[bytes]] = {}
        for piece in pieces:
            if (rank := self.ranks.get(piece)) is not None:
                out[piece] = (rank,)
            elif len(piece) <= SHORT:
                short.setdefault(1 << (len(piece) - 1).bit_length(), []).append(piece)
            else:
                out[piece] = self._merge_long(piece)
        for size, group in short.items():
            for at in range(0, len(group), AT_ONCE):
                some = group[at : at + AT_ONCE]
                out.update(zip(some, self._merge_short(some, size), strict=True))
        return out

    def encode_batch(self, texts: list[str | None], at_once: int = 4_000_000) -> Iterator[list[int]]:
        """Ids of each text in order; at most about ``at_once`` characters are cut ahead (one text at least)."""
        held: list[list[str]] = []
        chars = 0
        for text in texts:
            held.append(self.cut.findall(text or ""))
            chars += len(text or "")
            if chars >= at_once:
                yield from self._ids(held)
                held, chars = [], 0
        yield from self._ids(held)

    def _ids(self, held: list[list[str]]) -> Iterator[list[int]]:
        new = set(itertools.chain.from_iterable(held)).difference(self.cache)
        if len(self.cache) + len(new) > self.cache_units:
            new = set(itertools.chain.from_iterable(held))
            self.cache.clear()
            self.merged.clear()
        if new:
            gc.disable()  # nothing made here is cyclic, and the collector would walk the whole cache
            parts = {unit: self.split.findall(unit) for unit in new}
            pieces = list(set(itertools.chain.from_iterable(parts.values())).difference(self.merged))
            raw = [p.encode() for p in pieces]
            ids = self.merge(raw)
            self.merged.update(zip(pieces, map(ids.__getitem__, raw), strict=True))
            known = self.merged
            self.cache.update(
                (u, known[p[0]] if len(p) == 1 else tuple(itertools.chain.from_iterable(map(known.__getitem__, p)))) for u, p in parts.items()
            )
            gc.enable()
        get = self.cache.__getitem__
        for units in held:
            yield list(itertools.chain.from_iterable(map(get, units)))

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_batch([text]))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder for each worker process and rank file."""
    key = (path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row its id and ``ids``, the token ids of the whole text. ``path``: a rank file on every executor."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path, pattern)
        for batch in batches:
            for some in _slices(batch):
                yield pd.DataFrame({"id": some["id"], "ids": pd.Series(list(coder.encode_batch(some["text"].tolist())), index=some.index, dtype=object)})

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row its id and ``decoded``, the bytes that its ids stand for."""
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path, pattern)
        for batch in batches:
            out = [coder.decode_bytes(() if ids is None else ids) for ids in batch["ids"]]
            yield pd.DataFrame({"id": batch["id"], "decoded": pd.Series(out, index=batch.index, dtype=object)})

    rows = encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    return rows.mapInPandas(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_column)


def _slices(batch: pd.DataFrame, most: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about ``most`` characters, so that ids of few texts are held at once."""
    sizes = batch["text"].str.len().fillna(0).cumsum() // most
    for _, part in batch.groupby(sizes, sort=False):
        yield part


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: number of tokens, SHA-256 of its ids as text and of the bytes decoded from them.

    Ids are not moved out of the task that makes them; ``encode`` and ``decode`` give them whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path, pattern)
        names = {rank: str(rank) for rank in coder.bytes}
        for batch in batches:
            rows = []
            for ids in coder.encode_batch(batch["text"].tolist()):
                written = " ".join(map(names.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(coder.decode_bytes(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=batch.index)
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
