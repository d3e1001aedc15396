"""The prefix trie of conversations, as balanced parentheses per shard.

A node is a distinct sequence of first turns.  Its identity is a running sum of position-dependent hashes of the turns, so that
it is found by window sums over ranges of (conversation, position), however long a conversation is.  Nodes at which some
conversation ends or paths part (branch nodes) form the compact trie; the turns between two of them are a chain whose nodes have the
members of the chain's lower end.

The distinct sequences, sorted by their paths of branch nodes, are dealt in ranges to shards.  Each shard writes its part of the
compact trie as balanced parentheses with range min-max blocks over the excess: ``findclose`` delimits a node's subtree, rank
counts leaf pairs in it, and cumulative arrays over the nodes in order give members and savings.  Only nodes on a shard's first and
last path (its spine) can go on in other shards: what a shard found below them, without its own complete subtrees' nodes, is merged by
node, and the merged spines go through the same pass in fewer shards, until one is left.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorframe.llm.common import Scratch

#: Rows (distinct sequences, or merged spine nodes) of a shard on average.
SHARD_ROWS = 1 << 12
_MASK = (1 << 31) - 1
_NODE = "struct<depth:bigint,key:binary,chars:bigint>"
_PASS = (f"spine boolean, path array<{_NODE}>, key binary, depth long, chars long, up binary, up_depth long, up_chars long, "
         "members long, conv_id long, children long, leaves long, saved long")
_NOT_ANY = np.iinfo(np.int64).max


class Parentheses:
    """A balanced sequence of parentheses (1 opens, 0 closes) with a tree of block minima over its excess."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int8)
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        n = -(-len(bits) // self.BLOCK)
        self.leaves = 1 << max(0, (n - 1).bit_length())
        padded = np.full(self.leaves * self.BLOCK, _NOT_ANY, np.int64)
        padded[:len(bits)] = self.excess
        self.blocks = padded.reshape(-1, self.BLOCK)
        tree = np.full(2 * self.leaves, _NOT_ANY, np.int64)
        tree[self.leaves:] = self.blocks.min(axis=1)
        level = self.leaves
        while level > 1:
            tree[level // 2:level] = np.minimum(tree[level:2 * level:2], tree[level + 1:2 * level:2])
            level //= 2
        self.tree = tree
        pairs = (self.bits[:-1] == 1) & (self.bits[1:] == 0) if len(bits) else np.zeros(0, bool)
        self._opens = np.concatenate([[0], np.cumsum(self.bits)])
        self._pairs = np.concatenate([[0], np.cumsum(pairs), [0]])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Opening parentheses before these places."""
        return self._opens[at]

    def leaf_pairs(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Pairs () between these places, both included."""
        return self._pairs[closes] - self._pairs[opens]

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The place that closes each of these opening parentheses: the first one after it with an excess one lower."""
        target = self.excess[opens] - 1
        block = opens // self.BLOCK
        found = np.full(len(opens), -1, np.int64)
        self._in_block(found, np.arange(len(opens)), block, target, opens % self.BLOCK)
        rest = np.flatnonzero(found < 0)
        node = block[rest] + self.leaves
        aim, going = target[rest], np.ones(len(rest), bool)
        while going.any():  # up, until the next block on the right holds the target
            right = going & (node % 2 == 0) & (self.tree[np.minimum(node + 1, len(self.tree) - 1)] <= aim)
            node[right] += 1
            going &= ~right
            node[going] //= 2
        while (inner := node < self.leaves).any():  # down, to the leftmost block that does
            left = self.tree[np.where(inner, 2 * node, 0)] <= aim
            node = np.where(inner, np.where(left, 2 * node, 2 * node + 1), node)
        self._in_block(found, rest, node - self.leaves, aim, np.full(len(rest), -1))
        return found

    def _in_block(self, found, rows, block, target, after):
        place = np.arange(self.BLOCK)
        for i in range(0, len(rows), 1 << 14):
            part = slice(i, i + (1 << 14))
            hit = (self.blocks[block[part]] <= target[part, None]) & (place > after[part, None])
            at = hit.argmax(axis=1)
            ok = hit[np.arange(len(at)), at]
            found[rows[part][ok]] = (block[part] * self.BLOCK + at)[ok]


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64), pa.int64())


class _Shard:
    """Rows in path order as the nodes of a trie in preorder, with their parentheses."""

    def __init__(self):
        self.nodes, self.parent, self.bits, self.opens = [], [], [], []
        self.own, self.path, self.paths, self.first = [], [], [], None

    def add(self, path: list[tuple], own: tuple):
        """A row: its path of (depth, key, chars), and (members, conv_id, children, leaves, saved) of its last node alone."""
        same = 0
        while same < min(len(path), len(self.path)) and self.nodes[self.path[same]] == path[same]:
            same += 1
        self._close(same)
        for node in path[same:]:
            self.parent.append(self.path[-1] if self.path else -1)
            self.path.append(len(self.nodes))
            self.nodes.append(node)
            self.opens.append(len(self.bits))
            self.bits.append(1)
            self.own.append((0, _NOT_ANY, 0, 0, 0))
        self.own[self.path[-1]] = own
        if self.first is None:
            self.first = list(self.path)

    def _close(self, depth: int):
        self.bits.extend([0] * (len(self.path) - depth))
        del self.path[depth:]

    def result(self, alone: bool) -> pa.RecordBatch:
        last = list(self.path)
        self._close(0)
        n = len(self.nodes)
        parent = np.array(self.parent, np.int64)
        depth, chars = (np.array([x[i] for x in self.nodes], np.int64) for i in (0, 2))
        members, conv, children, leaves, saved = np.array(self.own, np.int64).reshape(-1, 5).T
        spine = np.zeros(n, bool)
        if not alone:
            spine[self.first] = spine[last] = True
        shape = Parentheses(np.array(self.bits))
        opens = np.array(self.opens, np.int64)
        closes = shape.findclose(opens)
        here, end = np.arange(n), shape.rank(closes)  # the nodes of a subtree are here..end-1
        total = lambda v: (c := np.concatenate([[0], np.cumsum(v)]))[end] - c[here]
        # leaf pairs, but for nodes that have children elsewhere and those that may
        childless = np.concatenate([self.bits, [0]])[opens + 1] == 0
        beyond = childless & ((children > 0) | spine)
        n_leaves = shape.leaf_pairs(opens, closes) - total(beyond) + total(leaves)
        n_members = total(members)
        least = np.minimum.reduceat(np.append(conv, _NOT_ANY), np.stack([here, end], 1).ravel())[::2]
        up_chars = np.where(parent < 0, 0, chars[parent])
        whole = np.where(spine, 0, (n_members - 1) * (chars - up_chars))
        n_saved = total(whole + saved)
        inner = np.flatnonzero(parent >= 0)
        n_children = children + np.bincount(parent[inner[~spine[inner]]], minlength=n)
        # of a spine node, what is not below another spine node
        for value in (n_members, n_leaves, n_saved):
            of = inner[spine[inner]]
            below = value[of].copy()
            np.subtract.at(value, parent[of], below)
        paths = [None] * n
        for i in np.flatnonzero(spine):  # a parent stands before its children
            paths[i] = [*(paths[parent[i]] if parent[i] >= 0 else ()), self.nodes[i]]
        n_children = np.where(spine, n_children, children + np.bincount(parent[inner], minlength=n))
        key = [x[1] for x in self.nodes]
        node = pa.struct([("depth", pa.int64()), ("key", pa.binary()), ("chars", pa.int64())])
        as_rows = [None if p is None else [dict(zip(("depth", "key", "chars"), x)) for x in p] for p in paths]
        return pa.RecordBatch.from_arrays(
            [pa.array(spine), pa.array(as_rows, pa.list_(node)), pa.array(key, pa.binary()), _long(depth), _long(chars),
             pa.array([None if p < 0 else key[p] for p in self.parent], pa.binary()),
             _long(np.where(parent < 0, -1, depth[parent])), _long(up_chars), _long(n_members), _long(least),
             _long(n_children), _long(n_leaves), _long(n_saved)],
            names=["spine", "path", "key", "depth", "chars", "up", "up_depth", "up_chars", "members", "conv_id", "children",
                   "leaves", "saved"])


def _in_shards(rows: DataFrame, shards: int) -> DataFrame:
    """One pass: the rows' trie, complete nodes with their final figures, spine nodes with their parts."""
    alone = shards == 1

    def encode(batches):
        shard = _Shard()
        for batch in batches:
            paths = batch.column(0).to_pylist()
            own = zip(*(batch.column(i).to_pylist() for i in range(1, 6)))
            for path, values in zip(paths, own):
                shard.add([(x["depth"], x["key"], x["chars"]) for x in path], values)
        if shard.nodes:
            yield shard.result(alone)

    rows = rows.select("path", "members", "conv_id", "children", "leaves", "saved")
    dealt = rows.repartition(1) if alone else rows.repartitionByRange(shards, "path")
    return dealt.sortWithinPartitions("path").mapInArrow(encode, _PASS)


def compact_trie(rows: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The branch nodes of the trie whose distinct sequences are ``rows`` (path, members, conv_id)."""
    zero = F.lit(0).cast("long")
    rows = rows.withColumns({"children": zero, "leaves": zero, "saved": zero})
    parts, n = [], rows.count()
    while True:
        shards = max(1, -(-n // shard_rows))
        done = scratch.table(_in_shards(rows, shards), "pass")
        parts.append(done.filter("NOT spine"))
        if shards == 1:
            break
        rows = scratch.table(done.filter("spine").groupBy("path").agg(
            F.sum("members").alias("members"), F.min("conv_id").alias("conv_id"), F.sum("children").alias("children"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "spines")
        n = min(rows.count(), n // 2)  # each pass has fewer shards than the one before
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result.drop("spine", "path")


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """Running sums per key in order.  Rows lie in ranges of (key, order), so a long key is spread over many of them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.table(rows.withColumns({f"_{k}": v for k, v in sums.items()}), "unranged")
    rows = scratch.table(rows.repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    w = Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumns({k: F.sum(f"_{k}").over(w) for k in sums})
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy(key, "_range").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    offset = total.select(key, "_range", *[F.sum(f"_{k}").over(before).alias(f"_before_{k}") for k in sums])
    offset = offset.filter(F.col(f"_before_{next(iter(sums))}").isNotNull())  # of keys in several ranges only
    both = here.join(offset, [key, "_range"], "left")
    return both.withColumns({k: F.col(k) + F.coalesce(f"_before_{k}", F.lit(0)) for k in sums}).drop(
        "_range", *[f"_{k}" for k in sums], *[f"_before_{k}" for k in sums])


def turns_in_order(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, pos (from 1), c1, c2, size``: turns numbered by ``turn`` (null first; equal ones by role, then by the MD5 of
    their text), with two hashes of (role, text) and the text's code points.  Null role and text are empty; rows with a null
    conv_id belong to no conversation and are left out."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text.cast("binary")).alias("tie"),
        F.xxhash64(F.lit(1), role, text).alias("c1"), F.xxhash64(F.lit(2), role, text).alias("c2"),
        F.char_length(text).cast("long").alias("size"))
    numbered = running(rows, "conv_id", ["turn", "role", "tie"], {"pos": F.lit(1).cast("long")}, scratch)
    return scratch.table(numbered.drop("turn", "role", "tie"), "turns")


def shared_openings(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (conv_id, n_turns) and turns (conv_id, depth, c1, c2, size) in which each conversation c opens with the first
    crc32(c) % 6 turns of conversation c - c % 100, followed by its own turns after as many."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    opening = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("long")
    own = own.select("conv_id", "n", opening.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    meta = scratch.table(own.join(base, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n"), "meta")
    first = turns.filter("pos <= 5").withColumnRenamed("conv_id", "base")
    taken = meta.select("conv_id", "base", "h").join(first, "base").filter("pos <= h").select(
        "conv_id", F.col("pos").alias("depth"), "c1", "c2", "size")
    after = turns.join(meta.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "c1", "c2", "size")
    members = meta.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n_turns"))
    return members, taken.unionByName(after)


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))


_ROOT = hashlib.md5(b"0,0,0,0,0").digest()


def _id_hashes(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """SHA-256 per key of its conv_ids, ascending and comma-joined.  Ranges of (key, conv_id) are joined to pieces of text in
    many tasks; only these pieces, in order, are hashed one after another, without holding a key's ids."""

    def pieces(batches):
        key = ids = None
        rows = []

        def flush():
            if ids:
                rows.append((key, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key or len(ids) >= 8192:
                    flush()
                    key, ids = k, []
                ids.append(c)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*rows), (pa.binary(), pa.int64(), pa.string()))], names=["key", "first", "piece"])
                rows = []
        flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.binary(), pa.int64(), pa.string()))], names=["key", "first", "piece"])

    def hashes(batches):
        key = sha = None
        for batch in batches:
            rows = []
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if sha:
                        rows.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                                             names=["key", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])],
                                             names=["key", "ends_sha256"])

    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = (ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(pieces, "key binary, first long, piece string"))
    joined = scratch.table(joined, "pieces")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashes, "key binary, ends_sha256 string")


def prefix_trie(members: DataFrame, turns: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, depth from 1 without gaps, c1, c2, size), the textless root included.

    ``members`` (conv_id, n_turns) lists each conversation once, turnless ones too.  Columns: ``conv_id`` (smallest member),
    ``depth, parent_conv_id`` (null at the root), ``n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.  No members:
    no rows.  Turns are told apart by two 64-bit hashes, sequences by 124 bits of their sums.
    """
    spark = members.sparkSession
    bits = []
    for i in (1, 2):
        x = F.xxhash64(F.lit(i), "depth", "c1", "c2")
        bits += [x.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(x, 33)]
    names = ["s1", "s2", "s3", "s4"]
    rows = running(turns.withColumns(dict(zip(["x1", "x2", "x3", "x4"], bits))), "conv_id", ["depth"],
                   {**{s: F.col(f"x{s[1]}") for s in names}, "chars": F.col("size")}, scratch)
    rows = rows.join(members, "conv_id").select(
        "conv_id", "depth", "size", "chars", (F.col("depth") == F.col("n_turns")).alias("is_end"),
        _key(F.col("depth"), [F.col(s) for s in names]).alias("key"),
        _key(F.col("depth") - 1, [F.col(s) - F.col(f"x{s[1]}") for s in names]).alias("up"))
    rows = scratch.keep(rows, "rows")

    ended = rows.filter("is_end").select("key", "conv_id").unionByName(
        members.filter("n_turns = 0").select(F.lit(_ROOT).alias("key"), "conv_id"))
    ended = scratch.table(ended, "ended")
    nodes = rows.groupBy("key", "up").agg(F.max("is_end").alias("is_end"))
    nodes = scratch.table(nodes, "nodes")
    parting = nodes.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n")).filter("n > 1").select("key")
    branch = scratch.table(nodes.filter("is_end").select("key").unionByName(parting).distinct(), "branch")

    classes = scratch.table(ended.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("members")), "classes")
    steps = (rows.join(classes.select("conv_id"), "conv_id", "left_semi").join(branch, "key", "left_semi")
             .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "chars"))).alias("steps")))
    root = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(_ROOT).alias("key"), F.lit(0).cast("long").alias("chars")))
    paths = classes.join(steps, "conv_id", "left").select(
        F.concat(root, F.coalesce("steps", F.filter(root, lambda _: F.lit(False)))).alias("path"), "members", "conv_id")
    found = scratch.table(compact_trie(scratch.table(paths, "paths"), scratch, shard_rows), "compact")

    above = found.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv"))
    found = found.join(above, "up", "left")
    step = 4096  # chains are unrolled in two steps, as one may be very long
    spread = found.filter("depth > 0").withColumn("from", F.explode(F.sequence(
        F.col("up_depth") + 1, F.col("depth"), F.lit(step).cast("long")))).withColumn("at", F.explode(F.sequence(
            F.col("from"), F.least(F.col("depth"), F.col("from") + step - 1))))
    last = F.col("at") == F.col("depth")
    below_top = F.col("at") > F.col("up_depth") + 1
    of = rows.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "size", F.col("chars").alias("so_far"))
    inner = spread.join(of, (F.col("conv_id") == F.col("c")) & (F.col("at") == F.col("d"))).select(
        "conv_id", F.col("at").alias("depth"), F.when(below_top, F.col("conv_id")).otherwise(F.col("up_conv")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("members") - 1) * (F.col("so_far") - F.col("size") - F.col("up_chars"))).alias("saved_tokens"),
        F.when(last, F.col("key")).alias("key"))
    top = found.filter("depth = 0").select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "key")
    hashes = scratch.table(_id_hashes(ended, scratch), "hashes")
    nothing = hashlib.sha256(b"").hexdigest()
    return scratch.keep(inner.unionByName(top).join(hashes, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")), "trie")
