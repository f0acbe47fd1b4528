"""Prefix trie of conversations, built as burst tries over ranges of conversations.

A turn's id is a digest of its role and text; a conversation is the chain of its ids.
Chains are range partitioned by chain and conv_id, so that a shard holds neighbouring
chains and a group of equal ones may span shards. In a shard, suffixes lie in
containers under trie heads: a container of more than `CONTAINER` suffixes bursts by
the next turn id, the others are sorted and swept into nodes.

Only the nodes on a shard's border can have members elsewhere: the common
prefix of its first chain with the shard before, and of its last chain with the shard after.
A shard gives its part of those, at most two chains of nodes, and the parts are swept once
more; all other nodes are whole where they are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.operators.lineage import cut

WIDTH = 16  # bytes of a turn id
CONTAINER = 512  # suffixes that are sorted together
SHARD, LEAST_SHARD = 250_000, 10_000  # turns of a shard; smaller ones only up to the number of shuffle partitions
LETTERS = 1 << 16  # bytes of conv_ids that are hashed at a time
BATCH = 20_000  # rows that a task hands over at a time
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
MADE = "kind string, shard long, " + NODE + ", node binary, parent binary, text_bytes long, place long, ends binary"


def grafted(conversations: DataFrame, *, block: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, chain, sizes): every conversation with the first turns of its block's first one.

    The first h = crc32(conv_id) % `most` turns come from conversation c - c % `block`, the
    rest from c itself. `chain` joins the turn ids, `sizes` are the bytes of the texts.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    spelled = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    turns = rows.select("conv_id", F.struct("turn", "role", F.substring(F.unhex(F.sha2(spelled, 256)), 1, WIDTH).alias("id"), F.octet_length("text").alias("size")).alias("t"))
    own = cut(turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns")))
    first = F.slice("turns", 1, most - 1).alias("first")
    bases = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), first)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", h).join(bases, "base", "left")
    head = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    whole = F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    joined = joined.select("conv_id", whole.alias("turns"))
    chain = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    return joined.select("conv_id", chain.alias("chain"), F.transform("turns", lambda t: t["size"].cast("int")).alias("sizes"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two chains have in common at their start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * WIDTH] == b[: middle * WIDTH] else (low, middle - 1)
    return low


class Node:
    """A trie node while its subtree is being swept."""

    __slots__ = ("depth", "chain", "size", "least", "members", "children", "leaves", "saved", "ends", "border", "waiting")

    def __init__(self, depth: int, chain: bytes, size: int, border: bool):
        self.depth, self.chain, self.size, self.border = depth, chain, size, border
        self.least, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.waiting: list[tuple] = []  # finished children, which still lack this node's smallest member

    def add(self, least: int, members: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.members += members


Suffix = tuple[bytes, int, list]  # chain, conv_id, sizes


def burst(suffixes: list[Suffix], depth: int, limit: int, visit: Callable[[list[Suffix], int], None], opened: Callable[[Suffix, int], None], closed: Callable[[], None]) -> None:
    """Visit the containers of a burst trie in chain order; `opened` and `closed` tell when the walk enters and leaves a head below `depth`."""
    stack: list[tuple] = [("container", suffixes, depth)]
    while stack:
        kind, held, at = stack.pop()
        if kind == "leave":
            closed()
        elif kind == "head":
            opened(held[0], at)
            stack.append(("leave", None, at))
            stack.append(("container", held, at))
        elif len(held) <= limit:
            visit(sorted(held, key=lambda s: (s[0], s[1])), at)
        else:
            nexts: dict[bytes, list[Suffix]] = {}
            for suffix in held:
                nexts.setdefault(suffix[0][at * WIDTH : (at + 1) * WIDTH], []).append(suffix)
            ended = nexts.pop(b"", [])
            for turn in sorted(nexts, reverse=True):
                stack.append(("head", nexts[turn], at + 1))
            if ended:
                visit(sorted(ended, key=lambda s: (s[0], s[1])), at)


class Sweep:
    """Nodes of one shard, made from its containers in chain order."""

    def __init__(self, shard: int, first: bytes, last: bytes, before: int, after: int):
        self.shard, self.first, self.last, self.before, self.after = shard, first, last, before, after
        self.path: list[Node] = []
        self.done: list[tuple] = []  # whole nodes
        self.full: list[pa.RecordBatch] = []
        self.border: list[Node] = []

    def put(self, row: tuple, parent_least: int | None, above: bytes | None) -> None:
        least, depth, *rest = row
        self.done.append(("whole", self.shard, least, depth, parent_least, *rest, None, above, None, None, None))
        if len(self.done) >= BATCH:
            self.full.append(_batch(self.done, MADE))
            self.done = []

    def _is_border(self, depth: int, chain: bytes) -> bool:
        if depth <= self.before and chain.startswith(self.first[: depth * WIDTH]):
            return True
        return depth <= self.after and chain.startswith(self.last[: depth * WIDTH])

    def open(self, suffix: Suffix, depth: int) -> None:
        chain = suffix[0][: depth * WIDTH]
        self.path.append(Node(depth, chain, suffix[2][depth - 1] if depth else 0, self._is_border(depth, chain)))

    def close(self) -> None:
        node = self.path.pop()
        parent = self.path[-1] if self.path else None
        if parent is not None:
            parent.add(node.least, node.members)
        if node.border:
            self.border.append(node)
            for child in node.waiting:
                self.put(child, None, _key(node.chain))
            node.waiting = []
            return
        if not node.children:
            node.leaves = 1
        node.saved += (node.members - 1) * node.size
        for child in node.waiting:
            self.put(child, node.least, None)
        row = (node.least, node.depth, node.members, node.children, node.leaves, node.saved, _ends(node.ends))
        if parent is None:
            self.put(row, None, None)
        else:
            parent.children += 1
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.waiting.append(row)

    def container(self, suffixes: list[Suffix], depth: int) -> None:
        """Sweep sorted suffixes below the head at `depth`, which is open."""
        for suffix in suffixes:
            chain, conv = suffix[0], suffix[1]
            stay = depth + shared_turns(self.path[-1].chain[depth * WIDTH :], chain[depth * WIDTH :])
            while self.path[-1].depth > stay:
                self.close()
            for below in range(self.path[-1].depth + 1, len(chain) // WIDTH + 1):
                self.open(suffix, below)
            self.path[-1].ends.append(conv)
            self.path[-1].add(conv, 1)
        while self.path[-1].depth > depth:
            self.close()


def _ends(conv_ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(conv_ids))).encode()).hexdigest() if conv_ids else EMPTY


def _key(chain: bytes) -> bytes:
    """A node's name: how deep it lies and a digest of its turns."""
    return hashlib.sha256(chain).digest()[:WIDTH] + (len(chain) // WIDTH).to_bytes(4, "big")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = zip(*rows) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def sweep_shard(shard: int, suffixes: list[Suffix], before: int, after: int, limit: int = CONTAINER) -> list[pa.RecordBatch]:
    """Rows `MADE` of a shard: whole nodes, parts of border nodes, and the ends of border nodes in blocks of text."""
    sweep = Sweep(shard, min(s[0] for s in suffixes), max(s[0] for s in suffixes), before, after)
    sweep.open(suffixes[0], 0)
    burst(suffixes, 0, limit, sweep.container, sweep.open, sweep.close)
    while sweep.path:
        sweep.close()
    rows = sweep.done
    for node in sweep.border:
        key, above = _key(node.chain), _key(node.chain[:-WIDTH]) if node.depth else None
        rows.append(("part", shard, node.least, node.depth, None, node.members, node.children, node.leaves, node.saved, None, key, above, node.size, None, None))
        ends, size, begin = sorted(node.ends), 0, 0
        words = [str(e).encode() for e in ends]
        for k, word in enumerate(words):
            size += len(word) + 1
            if size > LETTERS or k + 1 == len(words):
                rows.append(("ends", shard, *[None] * 8, key, None, None, ends[begin], b",".join(words[begin : k + 1])))
                begin, size = k + 1, 0
    return [*sweep.full, _batch(rows, MADE)]


def _shards(chains: DataFrame) -> DataFrame:
    """`chains` with shard, and the turns that its first and last chain share with the neighbouring shards."""
    chains = cut(chains)
    turns = chains.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
    at_once = int(chains.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = max(1, turns // SHARD, min(at_once, turns // LEAST_SHARD))
    spread = cut(chains.repartitionByRange(number, "chain", "conv_id").withColumn("shard", F.spark_partition_id().cast("long")))
    # one line a shard: their number is that of partitions, not of rows
    ends = spread.groupBy("shard").agg(F.min("chain").alias("low"), F.max("chain").alias("high"))
    order = Window.orderBy("shard")
    ends = ends.select("shard", "low", "high", F.lag("high").over(order).alias("earlier"), F.lead("low").over(order).alias("later"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, low, high, earlier, later = (c.to_pylist() for c in batch.columns)
            common = lambda a, b: [-1 if y is None else shared_turns(x, y) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(common(low, earlier), pa.int64()), pa.array(common(high, later), pa.int64())], names=["shard", "before", "after"]
            )

    borders = cut(ends.mapInArrow(lengths, "shard long, before long, after long"))
    return spread.join(borders, "shard")


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Subtree figures of border nodes, whose parts are added up: a tree of at most two chains of nodes a shard."""
    nodes: dict[bytes, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            nodes[row["node"]] = [row[c] for c in ("depth", "parent", "text_bytes", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    for key in sorted(nodes, key=lambda k: -nodes[k][0]):  # the deepest first
        node = nodes[key]
        if not node[5]:
            node[6] = 1
        node[7] += (node[4] - 1) * node[2]
        if node[1] is not None:
            parent = nodes[node[1]]
            parent[5] += 1
            parent[6] += node[6]
            parent[7] += node[7]
    for key, (depth, parent, _, least, members, children, leaves, saved) in nodes.items():
        yield key, least, depth, None if parent is None else nodes[parent][3], members, children, leaves, saved


MERGED = "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _hash_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """SHA-256 of each border node's blocks of conv_ids, which come in order."""
    current, digest = None, hashlib.sha256()
    for batch in batches:
        for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if node != current:
                if current is not None:
                    yield current, digest.hexdigest()
                current, digest = node, hashlib.sha256(ends)
            else:
                digest.update(b"," + ends)
    if current is not None:
        yield current, digest.hexdigest()


def prefix_trie(chains: DataFrame, *, container: int = CONTAINER) -> DataFrame:
    """One row per node of the trie of `chains` (conv_id, chain, sizes), columns as in `NODE`."""

    def build(table: pa.Table) -> pa.Table:
        suffixes = list(zip(*(table.column(c).to_pylist() for c in ("chain", "conv_id", "sizes"))))
        shard, before, after = (table.column(c)[0].as_py() for c in ("shard", "before", "after"))
        return pa.Table.from_batches(sweep_shard(shard, suffixes, before, after, container))

    made = cut(_shards(chains).groupBy("shard").applyInArrow(build, MADE))
    names = [f.split()[0] for f in NODE.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _batch(list(_merge(batches)), MERGED)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _batch(list(_hash_ends(batches)), "node binary, ends_sha256 string")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = made.where("kind = 'part'").groupBy("node", "parent", "depth", "text_bytes").agg(F.min("conv_id").alias("conv_id"), *sums)
    border = cut(parts.coalesce(1).mapInArrow(merge, MERGED))
    blocks = made.where("kind = 'ends'").select("node", "place", "ends").repartition("node").sortWithinPartitions("node", "place")
    ended = blocks.mapInArrow(hashes, "node binary, ends_sha256 string")
    border_rows = border.join(ended, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    whole = made.where("kind = 'whole'")
    above = border.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    under = whole.where("parent is not null").drop("parent_conv_id").join(above, "parent").withColumnRenamed("above", "parent_conv_id")
    return whole.where("parent is null").select(*names).unionByName(under.select(*names)).unionByName(border_rows.select(*names))


def conversation_trie(conversations: DataFrame, *, container: int = CONTAINER) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (see `grafted`), one row each, columns as in `NODE`.

    Null roles and texts are empty; null turns come first; rows of one turn are ordered by role, then by turn
    id. Rows without conv_id take no part. Repeated rows are turns of their own. A conversation without rebuilt turns
    is a member of the root alone. Extra columns are ignored, an empty table gives no nodes. Texts of any length are hashed
    where they are read; a conversation's turn ids and sizes (20 bytes a turn) are one row.
    """
    return prefix_trie(grafted(conversations), container=container)
