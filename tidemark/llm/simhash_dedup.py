"""SimHash near-duplicates with BK-trees.

Equal fingerprints are folded first. Two fingerprints within r bits agree wholly in one of r + 1 blocks of bits, so each
goes to a shard by each block's bits; a shard takes the values of many blocks, about `TREE` fingerprints in all. Every
shard's fingerprints stand in a BK-tree: children are keyed by their Hamming distance to the parent, and a search follows
only edges whose key is within the radius of its own distance to the node, for many queries at once.

Trees are broadcast if they hold `BROADCAST_BYTES` at most in all (measured first), and then fingerprints are looked up
where they are. Beyond that each tree, of bounded size, is sent once to every task that looks fingerprints of its shard
up. A block value of more than `TREE` fingerprints is parted by the bits of the other blocks in the same way, and a shard
that is still large is cut into slices, each with a tree that all later slices search.

Of what a search finds one link per fingerprint to the least of its class there goes on, never all pairs.

`keep_one` drops near copies by content: five-word fingerprints near one another by these trees and what near_copies finds
beside them are tested on the sets of five-word shingles, and linked at a Jaccard similarity of 0.8 and more.

Defined cases: a null or empty text, or one of white space, has fingerprint zero, linked like any other. Repeated rows
are kept. Extra columns are dropped. Rows with a null doc_id get the class of their fingerprint like any other; the
least doc_id ignores nulls. Empty table, empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_copies
from .common import batch, dealt_join, documents, give_back, materialize, settled, slices
from .components import components

RADIUS = 2
SHINGLE = 3
TREE = 4096
BROADCAST_BYTES = 4 << 20
#: Fingerprints looked up at once, and pairs held before they are folded.
ASKED, HELD = 512, 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, stops)], "<u8", n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    counts, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """The key and fp (the 64 bits as a signed long) of every row of docs (key, text)."""
    arrow = pa.schema([(key, pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in slices(batches):
            yield batch(arrow, [b.column(key), np.array([simhash(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)])
        give_back()

    return docs.select(key, "text").mapInArrow(run, f"{key} long, fp long")


class BKTree:
    """A BK-tree of distinct 64-bit values, grown and searched a level at a time. A node's children have consecutive
    numbers in order of their edges."""

    def __init__(self, values: np.ndarray):
        todo, group = np.arange(len(values)), np.zeros(len(values), np.int64)
        items, edges, ups, n = [], [], [], 0
        up, edge = np.full(1, -1), np.zeros(1, np.uint8)
        while len(todo):
            head = np.append(True, group[1:] != group[:-1])
            items.append(todo[head])
            edges.append(edge)
            ups.append(up)
            own = np.cumsum(head) - 1 + n  # the node each member belongs under
            n += len(items[-1])
            rest = ~head
            far = np.bitwise_count(values[todo[rest]] ^ values[items[-1][own[rest] - n + len(items[-1])]])
            key = own[rest] * 65 + far
            by = np.argsort(key, kind="stable")
            todo, group = todo[rest][by], key[by]
            first = np.append(True, group[1:] != group[:-1])[: len(group)]
            up, edge = group[first] // 65, (group[first] % 65).astype(np.uint8)
        self._set(values[np.concatenate(items)] if items else values, np.concatenate(ups).astype(np.int32) if ups else np.empty(0, np.int32), np.concatenate(edges) if edges else np.empty(0, np.uint8))

    def _set(self, values, ups, edges):
        self.values, self.ups, self.edges = values, ups, edges
        self.child = np.full((len(values), 65), -1, np.int32)
        self.child[ups[1:], edges[1:]] = np.arange(1, len(values), dtype=np.int32)

    def pack(self) -> bytes:
        return self.values.astype("<u8").tobytes() + self.ups.astype("<i4").tobytes() + self.edges.tobytes()

    @classmethod
    def unpack(cls, blob: bytes) -> BKTree:
        n, tree = len(blob) // 13, cls.__new__(cls)
        tree._set(np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<i4", n, 8 * n), np.frombuffer(blob, "u1", n, 12 * n))
        return tree

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in asked, value of the tree) of the pairs at distance radius or less."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ask = np.arange(len(asked) if len(self.values) else 0)
        at = np.zeros(len(ask), np.int32)
        while len(ask):
            far = np.bitwise_count(self.values[at] ^ asked[ask]).astype(np.int64)
            hit = far <= radius
            found.append((ask[hit], self.values[at[hit]]))
            asks, nodes = [], []
            for shift in range(-radius, radius + 1):
                edge = far + shift
                child = self.child[at, np.clip(edge, 0, 64)]
                on = (child >= 0) & (edge >= 1) & (edge <= 64)
                asks.append(ask[on])
                nodes.append(child[on])
            ask, at = np.concatenate(asks), np.concatenate(nodes)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return tuple(map(np.concatenate, zip(*found)))


def folded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as links of each member to the least of its class."""
    names, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)], places[len(a) :]
    top = np.arange(len(names))
    while True:
        x, y = top[left], top[right]
        if (x == y).all():
            break
        least = np.minimum(x, y)
        np.minimum.at(top, x, least)
        np.minimum.at(top, y, least)
        while (top[top] != top).any():
            top = top[top]
    up = np.flatnonzero(top != np.arange(len(names)))
    return names[up], names[top[up]]


class Links:
    """What searches find, folded whenever much is held. direct: each fingerprint with the least near it, instead."""

    def __init__(self, radius: int, direct: bool):
        self.radius, self.direct, self.a, self.b, self.size = radius, direct, [], [], 0

    def search(self, tree: BKTree, asked: np.ndarray) -> None:
        for at in range(0, len(asked), ASKED):
            some = asked[at : at + ASKED]
            ask, value = tree.within(some, self.radius)
            a, b = some[ask].view(np.int64), value.view(np.int64)
            other = a != b
            a, b = a[other], b[other]
            if self.direct and len(a):
                by = np.lexsort((b, a))
                first = np.append(True, a[by][1:] != a[by][:-1])
                a, b = a[by][first], b[by][first]
            self.a.append(a)
            self.b.append(b)
            self.size += len(a)
            if self.size > HELD:
                self.fold()

    def fold(self) -> None:
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if self.direct else folded(a, b)
        self.a, self.b, self.size = [a], [b], 0

    def batches(self, schema: pa.Schema):
        if self.a:
            self.fold()
            for at in range(0, len(self.a[0]), 1 << 16):
                yield batch(schema, [self.a[0][at : at + (1 << 16)], self.b[0][at : at + (1 << 16)]])


def blocks_of(fp, bits: int, count: int) -> list:
    """The bits of `count` blocks of the lowest `bits` of fp."""
    edges = [bits * i // count for i in range(count + 1)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]


def routed(prints: DataFrame, radius: int, limit: int) -> DataFrame:
    """fp, shard: a row for each block of each fingerprint."""
    fp = F.col("fp")
    parts = [F.struct(F.lit(i).alias("block"), x.alias("bits")) for i, x in enumerate(blocks_of(fp, 64, radius + 1))]
    rows = prints.select("fp", F.explode(F.array(*parts)).alias("key"))
    shards = F.lit(max(1, -(-prints.count() * (radius + 1) // limit)))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > limit)
    sizes = materialize(sizes, "simhash-crowded")
    shard = lambda *key: F.pmod(F.xxhash64(*key), shards)
    if sizes.isEmpty():
        return rows.select("fp", shard("key").alias("shard"))
    met = dealt_join(rows, sizes, "key", "fp", "left")
    # the other blocks' bits, side by side, hold all differences of two that share this block
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    low = lambda n: F.lit((1 << n) - 1)
    rest = F.lit(0).cast("long")
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        above = F.shiftleft(F.shiftrightunsigned(fp, b), a) if b < 64 else F.lit(0).cast("long")
        rest = F.when(F.col("key.block") == i, above.bitwiseOR(fp.bitwiseAND(low(a)))).otherwise(rest)
    inner = [F.struct(F.lit(i).alias("block"), x.alias("bits")) for i, x in enumerate(blocks_of(F.col("rest"), 64 - 64 // (radius + 1), radius + 1))]
    few = met.where("size is null").select("fp", shard("key").alias("shard"))
    many = met.where("size is not null").select("fp", "key", rest.alias("rest")).select("fp", "key", F.explode(F.array(*inner)).alias("inner"))
    return few.unionByName(many.select("fp", shard("key", "inner").alias("shard")))


def sharded_links(prints: DataFrame, radius: int = RADIUS, limit: int = TREE, broadcast_bytes: int = BROADCAST_BYTES, direct: bool = False) -> DataFrame:
    """(a, b): links of the distinct fingerprints in prints (fp), folded by class within a shard; direct: pairs within the
    radius instead, one for each fingerprint and shard."""
    spark = prints.sparkSession
    if not 1 <= radius <= 6:
        raise ValueError("blocks serve a radius of 1 to 6")
    rows = materialize(routed(prints, radius, limit).distinct(), "simhash-routed")
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / (2 * limit)).cast("int").alias("slices"))
    rows = materialize(dealt_join(rows, sizes, "shard", "fp").select("fp", "shard", "slices", F.pmod(F.xxhash64("fp", "shard"), F.col("slices")).cast("int").alias("slice")), "simhash-shards")
    arrow, spec = pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long"
    trees_of = pa.schema([("shard", pa.int64()), ("slice", pa.int32()), ("slices", pa.int32()), ("tree", pa.binary())])

    def grow(table: pa.Table) -> pa.Table:
        tree = BKTree(np.sort(table.column("fp").to_numpy().view(np.uint64)))
        return pa.Table.from_batches([batch(trees_of, [[table.column(c)[0].as_py()] for c in ("shard", "slice", "slices")] + [[tree.pack()]])])

    trees = materialize(rows.groupBy("shard", "slice").applyInArrow(grow, "shard long, slice int, slices int, tree binary"), "simhash-trees")
    total = trees.agg(F.coalesce(F.sum(F.length("tree")), F.lit(0))).first()[0]
    if total <= broadcast_bytes:
        sent: dict[int, list[bytes]] = {}
        for r in trees.collect():
            sent.setdefault(r["shard"], []).append(r["tree"])
        forest = spark.sparkContext.broadcast(sent)

        def look_up(batches):
            found, grown = Links(radius, direct), {}
            for b in batches:
                fp, shard = b.column("fp").to_numpy().view(np.uint64), b.column("shard").to_numpy()
                for name in np.unique(shard).tolist():
                    if name not in grown:
                        if len(grown) > 64:
                            grown.clear()
                        grown[name] = [BKTree.unpack(t) for t in forest.value[name]]
                    for tree in grown[name]:
                        found.search(tree, fp[shard == name])
            yield from found.batches(arrow)
            give_back()

        return rows.select("fp", "shard").mapInArrow(look_up, spec)

    def meet(tree: pa.Table, asked: pa.Table) -> pa.Table:
        found = Links(radius, direct)
        for blob in tree.column("tree").to_pylist():
            found.search(BKTree.unpack(blob), asked.column("fp").to_numpy().view(np.uint64))
        return pa.Table.from_batches(list(found.batches(arrow)), arrow)

    ask = rows.select("fp", "shard", F.col("slice").alias("by"), F.explode(F.sequence(F.lit(0), "slice")).alias("of"))
    own = trees.select("shard", "tree", F.col("slice").alias("of"), F.explode(F.sequence(F.col("slice"), F.col("slices") - 1)).alias("by"))
    key = ["shard", "of", "by"]
    return own.groupBy(*key).cogroup(ask.groupBy(*key)).applyInArrow(lambda t, a: meet(t, a), spec)


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tree_limit: int = TREE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints = materialize(fingerprints(documents(docs), shingle).withColumn("node", F.col("fp")), "simhash-prints")
    least = prints.groupBy("node").agg(F.min("doc_id").alias("least"))
    joined = components(sharded_links(prints.select("fp").distinct(), radius, tree_limit, broadcast_bytes))
    found = named(prints, least, joined)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_prints(docs: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes of docs (text, node) whose five-word fingerprints are equal or near, at most a few a node."""
    prints = materialize(fingerprints(docs, near_copies.SHINGLE, "node").distinct(), "near-prints")
    first = prints.groupBy("fp").agg(F.min("node").alias("first"))
    equal = dealt_join(prints, first, "fp", "node").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = sharded_links(first.select("fp"), direct=True)
    for side in "ab":
        links = links.join(first.select(F.col("fp").alias(side), F.col("first").alias(f"node_{side}")), side)
    near = links.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return equal.unionByName(near).distinct()


def named(prints: DataFrame, least: DataFrame, joined: DataFrame) -> DataFrame:
    """prints and component_id: of each component of nodes the least document."""
    member = least.join(joined, "node")
    roots = member.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = dealt_join(member.select("node", "component"), roots, "component", "node").select("node", "component_id")
    names = least.join(linked, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return dealt_join(prints, names, "node", "doc_id")


def first_of_classes(docs: DataFrame) -> DataFrame:
    """kept_id_, kept_node_ and kept_times_ of the one row of each class that stays."""
    named_docs = near_copies.with_nodes(docs)
    rows = materialize(named_docs.groupBy("doc_id", "node").agg(F.count("*").alias("times")), "near-nodes")
    joined = near_copies.near_links(named_docs, guesses=settled(lambda: near_prints(named_docs), "near-guesses"))
    parts = dealt_join(rows, joined, "node", "doc_id", "left").select("doc_id", "node", "times", F.coalesce("component", "node").alias("part"))
    first = parts.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "times")).alias("first"))
    return first.select(F.col("first.doc_id").alias("kept_id_"), F.col("first.node").alias("kept_node_"), F.col("first.times").alias("kept_times_"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near copies: the one with the least doc_id (none: last), then the least digest
    of its text. All columns are kept. Texts that differ under one doc_id are documents of their own; rows that repeat
    both count once. Null and empty texts, and those without words, are one class. Empty table, empty result."""
    kept = settled(lambda: first_of_classes(docs), "near-kept")
    node = near_copies.node_of(F.coalesce(F.col("text").cast("string"), F.lit("")))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id_")) & (node == F.col("kept_node_"))
    out = docs.join(kept.hint("shuffle_hash"), mine, "left_semi")
    if kept.where("kept_times_ > 1").isEmpty():
        return out
    marked = out.withColumn("kept_node_", node)
    return marked.dropDuplicates(["doc_id", "kept_node_"]).select(*docs.columns)
