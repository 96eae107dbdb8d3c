"""Prefix trie of conversations by vertical bitmaps.

Conversations are numbered by id and cut into shards of neighbours. Within a shard an index maps (position, turn) to the
bitset of the conversations that have the turn there. The trie grows depth first: the conversations of a node that go on are
split by the turn that the lowest of them has next, whose posting intersected with the node's bitset is a child, until
none is left. So there is one intersection for each child. Popcounts give the members, lowest bits the smallest ids, and the bitset
of the conversations that end at a depth the list of ends. Long conversations are cut into segments of equally many turns, and a segment's roots are
the nodes in which the one before it ended, so what a task holds is bounded by ``shard * segment`` turns without their texts.

A turn is known by 128 bits of its position, role and text, and a node by the exclusive or of these over its turns, and its depth; both
are the same in every shard, and can be made for a segment from the totals of earlier ones. Nodes of all shards are joined on
them: members and smallest ids are combined before the shuffle, ends of a node are read in the order of the shards by a running SHA-256
that holds no list. For sums over subtrees each node is owned by the shard of its smallest member, in which
all nodes above it stand too; a shard sums what it owns along its own preorder, and the shards' sums are added. What a later
segment holds is carried to the node in which the owner's conversation leaves the earlier one.

``rebuilt`` gives each conversation the first turns of the first one of its hundred, by joins on narrow rows; positions come from
ranges of sorted turns, so no task has to hold a conversation.

Defined cases: a null role or text is empty; a null ``turn`` comes first; turns with equal ``turn`` are ordered by the hash of their
role and text, and repeated rows are turns each. Rows without ``conv_id`` belong to no conversation and are left out. Very long texts
are hashed where they are read. An empty table has no root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sqltrail.plans.numbering import numbered

from .common import hot_keys, salted_join, stored

SHARD, SEGMENT = 512, 512
SHARED, HUNDRED = 6, 100
SEED = 0x7213


def narrow(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, a, b, chars``: 128 bits of role and text, and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(SEED), role, text).alias("b"), F.length(text).alias("chars")
    )


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def rebuilt(turns: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Stored conversations ``conv_id, length, shard, bit``, and turns ``conv_id, pos, length, shard, bit, x, y, chars`` after the exchange of first turns."""
    c = F.col
    own = numbered(stored(narrow(turns), "turns"), ["conv_id"], [c("turn"), c("a"), c("b")], lambda df: stored(df, "sorted-turns"), "pos").drop("turn")
    own = stored(own, "numbered-turns")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", shared_turns(c("conv_id"))).withColumn("base", c("conv_id") - c("conv_id") % HUNDRED)
    first = sizes.select(c("conv_id").alias("base"), c("n").alias("base_n"))
    sizes = sizes.join(first, "base", "left").withColumn("m", F.least(c("h").cast("long"), F.coalesce("base_n", F.lit(0))))
    sizes = sizes.withColumn("length", c("m") + F.greatest(c("n") - c("h"), F.lit(0))).drop("base_n")
    placed = numbered(sizes, [], [c("conv_id")], lambda df: stored(df, "sorted-conversations"))
    convs = placed.select("conv_id", "base", "n", "h", "m", "length", F.floor(c("number") / shard).alias("shard"), (c("number") % shard).cast("int").alias("bit"))
    convs = stored(convs, "conversations")
    facts = convs.select("conv_id", "h", "m", "length", "shard", "bit")
    kept = salted_join(own, facts, ["conv_id"], ["pos"], hot_keys(convs, ["conv_id"], "n"), "inner").where("pos >= h").withColumn("pos", c("pos") - c("h") + c("m"))
    heads = own.where(c("pos") < SHARED - 1).withColumnRenamed("conv_id", "base")
    taken = heads.join(convs.where("m > 0").drop("n"), "base").where("pos < m")
    names = ["conv_id", "pos", "length", "shard", "bit", "a", "b", "chars"]
    rows = kept.select(*names).unionByName(taken.select(*names))
    return convs.select("conv_id", "length", "shard", "bit"), rows.select(
        *names[:5], F.xxhash64("pos", "a", "b").alias("x"), F.xxhash64(F.lit(SEED), "pos", "a", "b").alias("y"), "chars"
    )


def segments(convs: DataFrame, rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """What each (shard, segment) reads: its conversations (``pos`` -1, with the node they come from) and their turns."""
    c = F.col
    rows = rows.withColumn("segment", F.floor(c("pos") / segment))
    totals = rows.where(c("length") > segment).groupBy("shard", "bit", "segment").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    earlier = W.partitionBy("shard", "bit").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("shard", "bit", "segment", F.bit_xor("x").over(earlier).alias("x"), F.bit_xor("y").over(earlier).alias("y"))
    last = F.greatest(F.lit(0), F.ceil(c("length") / segment) - 1)
    heads = convs.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).join(starts, ["shard", "bit", "segment"], "left")
    zero = F.lit(0).cast("long")
    heads = heads.select("shard", "segment", "bit", F.lit(-1).cast("long").alias("pos"), F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y"), zero.alias("chars"), "conv_id", "length")
    body = rows.select("shard", "segment", "bit", "pos", "x", "y", c("chars").cast("long"), zero.alias("conv_id"), zero.alias("length"))
    return heads.unionByName(body)


_GROWN = "shard long, segment long, kind int, pre long, size long, x long, y long, depth long, px long, py long, n long, conv_id long, bit int, chars long, ends string"


def grow(group: pd.DataFrame, turns_each: int = SEGMENT) -> pd.DataFrame:
    """Depth first over the bitmaps of one segment of a shard: rows of its nodes (kind 0) and of the conversations that leave it (kind 1)."""
    group = group.sort_values(["bit", "pos"], kind="stable")
    shard, segment = int(group["shard"].iloc[0]), int(group["segment"].iloc[0])
    begin, end = segment * turns_each, (segment + 1) * turns_each
    heads, turns = group[group["pos"] < 0], group[group["pos"] >= 0]
    ids, lengths = dict(zip(heads["bit"], heads["conv_id"], strict=True)), dict(zip(heads["bit"], heads["length"], strict=True))
    bits, spots = turns["bit"].to_numpy(), turns["pos"].to_numpy()
    # postings: the conversations that have a turn at a position; the hashes hold the position already
    keys, posting_of = np.unique(np.rec.fromarrays([spots, turns["x"].to_numpy(), turns["y"].to_numpy()]), return_inverse=True)
    postings = [0] * len(keys)
    for posting, bit in zip(posting_of.tolist(), bits.tolist(), strict=True):
        postings[posting] |= 1 << bit
    chars = np.zeros(len(keys), np.int64)
    chars[posting_of] = turns["chars"].to_numpy()
    first_of = {int(b): int(i) for b, i in zip(*np.unique(bits, return_index=True), strict=True)}
    next_of = posting_of.tolist()
    marks, chars = [(int(k[1]), int(k[2])) for k in keys], chars.tolist()
    ends_at: dict[int, int] = {}
    roots: dict[tuple[int, int], int] = {}
    for bit, x, y in zip(heads["bit"].tolist(), heads["x"].tolist(), heads["y"].tolist(), strict=True):
        ends_at[int(lengths[bit])] = ends_at.get(int(lengths[bit]), 0) | 1 << bit
        roots[x, y] = roots.get((x, y), 0) | 1 << bit
    nodes: list[tuple] = []
    parents: list[int] = []
    leaving: list[tuple[int, int]] = []

    def lowest(members: int) -> int:
        return (members & -members).bit_length() - 1

    def listed(members: int) -> Iterator[int]:
        while members:
            low = members & -members
            yield low.bit_length() - 1
            members ^= low

    stack = [(members, begin, x, y, 0, 0, 0, -1) for (x, y), members in sorted(roots.items())]
    while stack:
        members, depth, x, y, px, py, size, parent = stack.pop()
        place = -1
        ending = members & ends_at.get(depth, 0)
        if depth > begin or segment == 0:
            place = len(nodes)
            low = lowest(members)
            text = ",".join(str(ids[b]) for b in listed(ending)) if ending else None
            nodes.append((x, y, depth, px, py, members.bit_count(), ids[low], low, size, text))
            parents.append(parent)
        going = members & ~ending
        if depth == end:
            leaving += [(place, b) for b in listed(going)]
            continue
        while going:
            posting = next_of[first_of[lowest(going)] + depth - begin]
            child = members & postings[posting]
            going &= ~child
            u, v = marks[posting]
            stack.append((child, depth + 1, x ^ u, y ^ v, x, y, chars[posting], place))
    sizes = [1] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        if parents[i] >= 0:
            sizes[parents[i]] += sizes[i]
    names = ["x", "y", "depth", "px", "py", "n", "conv_id", "bit", "chars", "ends"]
    out = pd.DataFrame(nodes, columns=names).assign(kind=0, pre=range(len(nodes)), size=sizes)
    if leaving:
        gone = pd.DataFrame(leaving, columns=["pre", "bit"]).assign(kind=1, ends=None)
        for name in ("size", "x", "y", "depth", "px", "py", "n", "conv_id", "chars"):
            gone[name] = 0
        out = pd.concat([out, gone])
    return out.assign(shard=shard, segment=segment)[[f.split()[0] for f in _GROWN.split(", ")]]


def _ends(grown: DataFrame) -> DataFrame:
    """``x, y, depth, ends_sha256`` of nodes where conversations end: the shards' lists in order, through one running hash a node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, running = None, None
        for batch in batches:
            done = []
            for x, y, depth, ends in zip(batch["x"], batch["y"], batch["depth"], batch["ends"], strict=True):
                if now != (x, y, depth):
                    if now:
                        done.append((*now, running.hexdigest()))
                    now, running = (x, y, depth), hashlib.sha256(ends.encode())
                else:
                    running.update(b"," + ends.encode())
            if done:
                yield pd.DataFrame(done, columns=["x", "y", "depth", "ends_sha256"])
        if now:
            yield pd.DataFrame([(*now, running.hexdigest())], columns=["x", "y", "depth", "ends_sha256"])

    node = ["x", "y", "depth"]
    lists = grown.where("ends IS NOT NULL").select(*node, "shard", "ends")
    return lists.repartition(*node).sortWithinPartitions(*node, "shard").mapInPandas(run, "x long, y long, depth long, ends_sha256 string")


def _subtrees(grown: DataFrame, owned: DataFrame) -> DataFrame:
    """``x, y, depth, n_leaves, saved_tokens``: sums of what nodes of ``owned`` give, over their subtrees."""
    c = F.col
    place = ["shard", "segment"]
    # what later segments give, at the node in which the owner's conversation leaves this one
    late = owned.where("segment > 0").groupBy("shard", "bit", "segment").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    gone = grown.where("kind = 1").select(*place, "bit", "pre")
    both = gone.join(late, ["shard", "bit", "segment"], "full")
    later = W.partitionBy("shard", "bit").orderBy(F.desc("segment")).rowsBetween(W.unboundedPreceding, -1)
    carried = both.select(*place, "pre", F.sum("leaf").over(later).alias("leaf"), F.sum("saved").over(later).alias("saved")).where("pre IS NOT NULL AND leaf IS NOT NULL")
    zero = F.lit(0).cast("long")
    values = owned.select(*place, "pre", "leaf", "saved").unionByName(carried)
    values = values.select(*place, "pre", zero.alias("size"), zero.alias("x"), zero.alias("y"), zero.alias("depth"), "leaf", "saved")
    nodes = grown.where("kind = 0").select(*place, "pre", "size", "x", "y", "depth", zero.alias("leaf"), zero.alias("saved"))

    def total(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["size"] > 0]
        out = {name: own[name] for name in ("x", "y", "depth")}
        for name in ("leaf", "saved"):
            at = np.zeros(len(own) + 1, np.int64)
            np.add.at(at, group["pre"].to_numpy() + 1, group[name].to_numpy())
            at = np.cumsum(at)
            out[name] = at[(own["pre"] + own["size"]).to_numpy()] - at[own["pre"].to_numpy()]
        return pd.DataFrame(out)

    sums = nodes.unionByName(values).groupBy(*place).applyInPandas(total, "x long, y long, depth long, leaf long, saved long")
    return sums.groupBy("x", "y", "depth").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def report(turns: DataFrame, shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """Per node of the rebuilt conversations' trie: its smallest member, depth, parent, members, children, leaves and tokens saved below it, and its ends."""
    c = F.col
    node, above = ["x", "y", "depth"], ["px", "py", "depth"]
    convs, rows = rebuilt(turns, shard)
    grown = stored(segments(convs, rows, segment).groupBy("shard", "segment").applyInPandas(lambda group: grow(group, segment), _GROWN), "shard-tries")
    first = F.min(F.struct("conv_id", "shard", "segment", "pre", "bit"))
    merged = grown.where("kind = 0").groupBy(*node).agg(F.sum("n").alias("n_convs"), F.min("px").alias("px"), F.min("py").alias("py"), F.max("chars").alias("chars"), first.alias("o"))
    merged = stored(merged.select(*node, "px", "py", "n_convs", "chars", "o.*"), "trie-nodes")
    children = merged.where("depth > 0").groupBy("px", "py", "depth").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(c("px").alias("x"), c("py").alias("y"), (c("depth") - 1).alias("depth"), "n_children")
    merged = stored(merged.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    owned = merged.select("shard", "segment", "pre", "bit", (c("n_children") == 0).cast("long").alias("leaf"), ((c("n_convs") - 1) * c("chars")).alias("saved"))
    # a third of all nodes may hang on one parent
    parents = merged.where("n_children > 0").select(c("x").alias("px"), c("y").alias("py"), (c("depth") + 1).alias("depth"), c("conv_id").alias("parent_conv_id"), "n_children")
    hot = hot_keys(parents, above, "n_children")
    known = salted_join(merged.drop("shard", "segment", "pre", "bit", "chars"), parents.drop("n_children"), above, ["x", "y"], hot, "left")
    out = known.join(_subtrees(grown, owned), node).join(_ends(grown), node, "left")
    return out.select(
        "conv_id", "depth", F.when(c("depth") > 0, c("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


#: DuckDB SQL of the report; every prefix is a list of turns, so it suits small tables.
ORACLE = f"""WITH RECURSIVE
turns AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS digits FROM turns GROUP BY conv_id),
crc AS (SELECT conv_id, digits, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM sizes
  UNION ALL SELECT conv_id, digits, k + 1, xor(c0 >> 1, 3988292384 * (c0 & 1)) FROM (
    SELECT conv_id, digits, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substr(digits, CAST(k // 8 AS INTEGER) + 1, 1)) AS BIGINT)) ELSE c END AS c0
    FROM crc WHERE k < 8 * length(digits))),
heads AS (SELECT conv_id, xor(c, 4294967295) % {SHARED} AS h FROM crc WHERE k = 8 * length(digits)),
mixed AS (
  SELECT heads.conv_id, 0 AS own, p, r, t FROM heads JOIN turns ON turns.conv_id = heads.conv_id - heads.conv_id % {HUNDRED} AND p < h
  UNION ALL SELECT heads.conv_id, 1, p, r, t FROM heads JOIN turns ON turns.conv_id = heads.conv_id AND p >= h),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, list(struct_pack(r := r, t := t)) OVER w AS path, length(t) AS chars FROM mixed
  WINDOW w AS (PARTITION BY conv_id ORDER BY own, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]), 0 FROM heads),
ends AS (SELECT conv_id, max(depth) AS len FROM paths GROUP BY conv_id),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = depth), '') AS listed
  FROM paths JOIN ends USING (conv_id) GROUP BY depth, path),
up AS (SELECT n.*, a.path AS above, a.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN nodes a ON a.depth = n.depth - 1 AND a.path = list_slice(n.path, 1, n.depth - 1)),
children AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN children USING (depth, path))
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, n.parent_conv_id, n.n_convs, n.n_children,
  count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, CAST(sum((d.n_convs - 1) * d.chars) AS BIGINT) AS saved_tokens, sha256(n.listed) AS ends_sha256
FROM counted n JOIN counted d ON d.depth >= n.depth AND list_slice(d.path, 1, n.depth) = n.path
GROUP BY n.conv_id, n.depth, n.path, n.parent_conv_id, n.n_convs, n.n_children, n.listed"""
