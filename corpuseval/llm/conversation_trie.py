"""Prefix trie of conversations: shared openings, what they save, and who ends where.

Turns (role, text) get dictionary ids by their digests. Texts are sorted only where turns of a conversation tie in number, and
none goes to the driver whole. Distinct id sequences, each with its number of members, are dealt in order to range shards. A shard
plants its sequences in a ternary search tree, the median first, so the tree is balanced; a traversal with an explicit stack then
sums members, children, leaves and savings from the leaves up. A node lies whole in one shard unless it is on the path of the
shard's first or last sequence down to the depth shared with the neighbouring shard. Such boundary nodes give partial sums under
the digest of their path. All sums add up over shards, because a node's own length and its place among its parent's children are
counted by the first shard that holds it, and a node is a leaf only where neither its shard nor the next one has a longer sequence.

Copies of a conversation are one sequence, so a group of any size is a count; its member ids are sorted by ranges, joined into
short pieces, and the pieces are hashed one after another, so no task holds the ids of a group. Turn ids, 12 bytes a turn, of
one conversation are held in one row.

Defined cases: rows without conv_id belong to no conversation and are left out; null role and text are empty; turns that tie
in number are ordered by role and text, null numbers first, and a repeated row is a turn of its own; an empty table has no
nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuseval.operators.keyed import lookup_join
from corpuseval.session import materialize, ship_package

SHARD_TURNS = 250_000  # turns of distinct sequences in a shard
RANGE_CHARS = 64  # leading characters of role and text by which tied turns are dealt to tasks
RANGE_IDS = 16  # leading ids by which sequences are dealt to shards, or more where many turns share them
SHARED_TURNS = 5  # the most that a conversation takes from its base
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, path binary, parent_path binary"
)
NODE_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("path", pa.binary()), ("parent_path", pa.binary())]
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _dictionary(turns: DataFrame, narrow: DataFrame) -> DataFrame:
    """digest, id: ids of turns that tie in number with another are in the order of (role, text), others in any and negative."""
    distinct = narrow.select("digest").distinct()
    other = (-1 - F.monotonically_increasing_id()).alias("id")
    numbers = narrow.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    ties = materialize(numbers.where("n > 1").select(F.col("conv_id").alias("tied_conv"), F.col("turn").alias("tied_turn")))
    if ties.isEmpty():
        return distinct.select("digest", other)
    same = (F.col("conv_id") == F.col("tied_conv")) & F.col("turn").eqNullSafe(F.col("tied_turn"))
    tied = materialize(narrow.join(ties, same, "left_semi").select("digest").distinct())
    texts = lookup_join(turns.select("digest", "role", "text"), tied, "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    # a key that sorts as (role, text) does, of bounded size, since samples of it go to the driver
    long = F.length("role") > RANGE_CHARS
    key = [F.substring("role", 1, RANGE_CHARS), long, F.when(~long, F.substring("text", 1, RANGE_CHARS))]
    ordered = texts.repartitionByRange(*key).sortWithinPartitions("role", "text")
    rest = distinct.join(tied, "digest", "left_anti").select("digest", other)
    return ordered.select("digest", F.monotonically_increasing_id().alias("id")).unionByName(rest)


def encode_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of id, n_chars in order): one row per conversation, with ids of a dictionary of all turns."""
    texts = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    name = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    turns = texts.withColumn("digest", name)
    narrow = materialize(turns.select("conv_id", "turn", "digest", F.length("text").alias("n_chars")))
    dictionary = materialize(_dictionary(turns, narrow))
    coded = lookup_join(narrow, dictionary, "digest")
    in_order = F.array_sort(F.collect_list(F.struct("turn", "id", "n_chars")))
    return coded.groupBy("conv_id").agg(in_order.alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["n_chars"].alias("n_chars"))).alias("turns")
    )


def rebuild(convs: DataFrame) -> DataFrame:
    """Conversation c becomes the first h turns of conversation c - c % 100 and its own after the first h; h = crc32(c) % 6."""
    base_id = F.col("conv_id") - F.col("conv_id") % 100
    bases = convs.where(F.col("conv_id") == base_id).select(
        F.col("conv_id").alias("base_id"), F.slice("turns", 1, SHARED_TURNS).alias("opening")
    )
    none = F.slice("turns", 1, 0)
    rows = convs.withColumn("base_id", base_id).join(bases, "base_id", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    own = F.slice("turns", h + 1, F.size("turns"))
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("opening", none), F.lit(1), h), own).alias("turns"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sequence, conv_id) to joined ids, a piece for each sequence in each batch."""
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        edges = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
        runs = list(zip(edges[:-1], edges[1:], strict=True)) if keys else []
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([keys[a] for a, _ in runs], pa.binary()),
                pa.array([ids[a] for a, _ in runs], pa.int64()),
                pa.array([",".join(map(str, ids[a:b])) for a, b in runs], pa.string()),
            ],
            names=["sequence", "first_id", "joined"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (sequence, first_id) to one digest for each sequence."""
    now, state = None, None
    for batch in batches:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            state.update(text.encode())
        yield _digest_batch(out)
    yield _digest_batch([] if now is None else [(now, state.hexdigest())])


def _digest_batch(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], names=["sequence", "ends"]
    )


def member_digests(members: DataFrame) -> DataFrame:
    """sequence, ends: SHA-256 of the members' ids, ascending and comma-joined."""
    pairs = members.select("sequence", "conv_id")
    pieces = (
        pairs.repartitionByRange("sequence", "conv_id")
        .sortWithinPartitions("sequence", "conv_id")
        .mapInArrow(_pieces, "sequence binary, first_id bigint, joined string")
    )
    together = pieces.repartition("sequence").sortWithinPartitions("sequence", "first_id").select("sequence", "joined")
    return together.mapInArrow(_digests, "sequence binary, ends string")


class TernaryTree:
    """Nodes as parallel lists; node 0 is the root, and 0 stands for no node. ``up`` is a node's parent in the trie."""

    def __init__(self) -> None:
        self.char, self.lower, self.equal, self.higher, self.up, self.depth = [0], [0], [0], [0], [0], [0]
        self.length = [0]
        self.ends: dict[int, int] = {}

    def _new(self, char: int, up: int, length: int) -> int:
        at = len(self.char)
        self.char.append(char)
        self.lower.append(0)
        self.equal.append(0)
        self.higher.append(0)
        self.up.append(up)
        self.depth.append(self.depth[up] + 1)
        self.length.append(length)
        return at

    def insert(self, ids: list[int], lengths: list[int], row: int) -> None:
        char, lower, higher = self.char, self.lower, self.higher
        node = 0
        for x, size in zip(ids, lengths, strict=True):
            at = self.equal[node]
            if not at:
                at = self.equal[node] = self._new(x, node, size)
            while char[at] != x:
                side = lower if x < char[at] else higher
                if not side[at]:
                    side[at] = self._new(x, node, size)
                at = side[at]
            node = at
        self.ends[node] = row

    def plant(self, sequences: list[list[int]], lengths: list[list[int]]) -> None:
        """Insert sorted sequences, the median of each range before its halves."""
        ranges = [(0, len(sequences))]
        while ranges:
            a, b = ranges.pop()
            if a < b:
                middle = (a + b) // 2
                self.insert(sequences[middle], lengths[middle], middle)
                ranges += [(a, middle), (middle + 1, b)]

    def walk(self) -> list[int]:
        """All nodes, each after its parent."""
        order, stack = [], [0]
        while stack:
            at = stack.pop()
            order.append(at)
            stack += [x for x in (self.lower[at], self.higher[at], self.equal[at]) if x]
        return order

    def path(self, ids: list[int], depth: int) -> list[int]:
        """The nodes of the first ``depth`` ids, the root first."""
        nodes = [0]
        for x in ids[:depth]:
            at = self.equal[nodes[-1]]
            while self.char[at] != x:
                at = self.lower[at] if x < self.char[at] else self.higher[at]
            nodes.append(at)
        return nodes


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard; those shared with a neighbour have a path and partial sums."""
    table = table.take(pc.sort_indices(table, sort_keys=[("place", "ascending")]))
    sequences, lengths = table["ids"].to_pylist(), table["lengths"].to_pylist()
    counts, least, ends = (table[c].to_pylist() for c in ("n", "least", "ends"))
    before, after = table["before"][0].as_py(), table["after"][0].as_py()
    tree = TernaryTree()
    tree.plant(sequences, lengths)
    size = len(tree.char)
    shared, paths = [False] * size, {}
    for ids, depth in ((sequences[0], before), (sequences[-1], after)):
        if depth >= 0:
            digest = hashlib.md5()
            for k, node in enumerate(tree.path(ids, depth)):
                if k:
                    digest.update(struct.pack("<q", ids[k - 1]))
                shared[node], paths[node] = True, digest.digest()
    known = set(tree.path(sequences[0], before)) if before >= 0 else set()  # counted by an earlier shard
    continued = set(tree.path(sequences[-1], after)) if after >= 0 else set()
    members, smallest, children = [0] * size, [2**63 - 1] * size, [0] * size
    below, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in reversed(tree.walk()):
        row = tree.ends.get(node)
        if row is not None:
            members[node] += counts[row]
            smallest[node] = min(smallest[node], least[row])
        if not below[node] and node not in continued:
            leaves[node] = 1
        saved[node] += (members[node] - (node not in known)) * tree.length[node]
        if node:
            up = tree.up[node]
            members[up] += members[node]
            smallest[up] = min(smallest[up], smallest[node])
            children[up] += node not in known
            below[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    whole = np.array([not x for x in shared])
    parent = [None if not k or shared[tree.up[k]] else smallest[tree.up[k]] for k in range(size)]
    if size and whole[0]:
        parent[0] = None
    columns = [smallest, tree.depth, parent, members, children, leaves, saved]
    texts = [ends[tree.ends[k]] if k in tree.ends else None for k in range(size)]
    above = [paths.get(tree.up[k]) if k else None for k in range(size)]
    arrays = [pa.array(c, pa.int64()) for c in columns]
    arrays += [pa.array(texts, pa.string()), pa.array([paths.get(k) for k in range(size)], pa.binary()), pa.array(above, pa.binary())]
    return pa.Table.from_arrays(arrays, schema=NODE_ARROW)


def _common(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share; -1 where one is null."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(a.isNull() | b.isNull(), -1).when(first > 0, first - 1).otherwise(F.size(a))


def _leading_ids(unique: DataFrame, longest: int, most: int) -> Column:
    """A start of ``ids`` that sequences of more than ``most`` turns in all don't share. Samples of it go to the driver."""
    k, size = RANGE_IDS, F.size("ids")
    while k < longest:
        start = F.slice("ids", 1, k)
        alike = unique.where(size >= k).groupBy(F.xxhash64(start)).agg(F.count("*").alias("n"), F.sum(size).alias("turns"))
        if alike.where((F.col("n") > 1) & (F.col("turns") > most)).isEmpty():
            return start
        k *= 8
    return F.col("ids")


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of conversations given as (conv_id, turns: array of id and n_chars); see RESULT for the columns."""
    ship_package(convs.sparkSession)
    ids, lengths = F.col("turns.id"), F.col("turns.n_chars")
    named = convs.select("conv_id", "turns", F.unhex(F.md5(F.array_join(ids.cast("array<string>"), ","))).alias("sequence"))
    members = materialize(named)
    grouped = members.groupBy("sequence").agg(
        F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("least")
    )
    unique = materialize(grouped.join(member_digests(members), "sequence").select(
        ids.alias("ids"), lengths.alias("lengths"), "n", "least", "ends"
    ))
    size = F.size("ids")
    total, longest = unique.agg(F.coalesce(F.sum(size + 1), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    shards = 1 + total // shard_turns
    dealt = materialize(
        unique.repartitionByRange(shards, _leading_ids(unique, longest, shard_turns)).sortWithinPartitions("ids")
        .withColumn("place", F.monotonically_increasing_id()).withColumn("shard", F.shiftright("place", 33))
    )
    # a row per shard: their number is the number of turns divided by shard_turns
    edges = dealt.groupBy("shard").agg(F.min_by("ids", "place").alias("low"), F.max_by("ids", "place").alias("high"))
    order = W.orderBy("shard")
    bounds = edges.select(
        "shard", _common(F.lag("high").over(order), F.col("low")).alias("before"),
        _common(F.col("high"), F.lead("low").over(order)).alias("after"),
    )
    nodes = materialize(dealt.join(bounds, "shard").groupBy("shard").applyInArrow(shard_nodes, NODE))
    merged = nodes.where("path is not null").groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_path").alias("parent_path"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    merged = materialize(merged)
    parents = merged.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent_conv_id"))
    inner = nodes.where("path is null")
    found = lookup_join(inner.where("parent_path is not null").drop("parent_conv_id"), parents, "parent_path")
    shared = merged.join(parents, "parent_path", "left")
    parts = [inner.where("parent_path is null"), found, shared]
    rows = parts[0].select(RESULT).unionByName(parts[1].select(RESULT)).unionByName(parts[2].select(RESULT))
    return rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node."""
    return prefix_trie(rebuild(materialize(encode_turns(conversations))), shard_turns)
