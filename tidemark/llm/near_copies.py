"""Near copies: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Of two sets that similar, each shares one of its first n - ceil(0.8 n) + 1 members with the other's, in any one order of
all members (prefix filter), so pairs that meet under none of these need no look, whatever the edit. The order has
members that a bounded sample finds common last, then goes by hash; the sample bears on the work, never on the result.
What can follow the first member two sets share bounds their similarity, so most pairs that meet are never listed.

1. Pairs that are likely from elsewhere (near fingerprints) are tested first, and linked texts joined to components.
   Prefixes go to tasks by member, as packed arrays. Up to `crowd` texts under one member give all their pairs; more
   give a star and a chain, and are written down.
2. Pairs of different components are tested on their whole sets, once sketches that bound the difference have ruled most
   out, and linked texts are joined.
3. In the crowds written down that hold several components, texts outside the main one meet the others again, with their
   sketches, in slices of bounded size: only pairs of different components that sizes, places and sketches allow are
   written down and tested, too. In a first pass these are each text's likeliest only, then all that are still apart.

So each pair of 0.8 and more is linked or lies in one component already, and each link is such a pair. A component may
hold texts less similar than that, joined by others between them.

Defined cases: ASCII letters count as small, words end at white space; a text of fewer than five words is one shingle, a
text without words has none and is like others without. Equal texts are folded first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, dealt_join, documents, give_back, materialize, partitions, release, settled, slices
from .components import components
from .suffix_dedup import dealt, unsqueeze

SHINGLE = 5
CROWD = 8
FLUSH = 1 << 19
#: Members of a crowd in one task; pairs looked at, and pairs of sketches held, at once.
SLICE, LOOK, HOLD = 1 << 14, 1 << 18, 1 << 14
#: The sample: texts, the least of them that make a shingle common, and the most shingles.
SAMPLE, COMMON, MOST_COMMON = 4000, 3, 50_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SKETCH_BITS, MAP_BITS = 2048, 1 << 23
SPEC = "to long, kind int, blob binary"
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64())])


def shingles(text: str) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(line[a:b], 42) for a, b in zip(starts, stops)], "<u8", n))


def prefix(members: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first members, one of which any set of similarity 0.8 shares; common is sorted."""
    most = len(members) - (4 * len(members) + 4) // 5 + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, members), len(common) - 1)
        members = members[np.argsort(np.where(common[at] == members, times[at], 0), kind="stable")]
    return members[:most]


def scout(batches, groups: int, common: np.ndarray, times: np.ndarray):
    held, size, seen = [], 0, set()

    def flush():
        tokens = np.concatenate([t for t, _, _ in held])
        lengths = [len(t) for t, _, _ in held]
        nodes = np.repeat(np.array([n for _, n, _ in held], "<i8"), lengths)
        sizes = np.repeat(np.array([s for _, _, s in held], "<u4"), lengths)
        places = np.concatenate([np.arange(n, dtype="<u4") for n in lengths])
        yield from dealt((tokens % np.uint64(groups)).astype(np.int64), 0, [tokens, nodes, sizes, places])

    for b in slices(batches):
        for text, node in zip(b.column("text").to_pylist(), b.column("node").to_pylist()):
            if node in seen:
                continue
            seen.add(node)
            members = shingles(text)
            if len(members):
                held.append((prefix(members, common, times), node, len(members)))
                size += len(held[-1][0])
            if size >= FLUSH:
                yield from flush()
                held, size, seen = [], 0, set()
    if held:
        yield from flush()
        held.clear()
    give_back()


def first_shared(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of sizes x and y whose first shared member has places i and j can have a similarity of 0.8."""
    x, i, y, j = (v.astype(np.int64) for v in (x, i, y, j))
    return 9 * np.minimum(x - i, y - j) >= 4 * (x + y)


def paired(a: np.ndarray, b: np.ndarray):
    a, b = np.minimum(a, b), np.maximum(a, b)
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.empty(0, bool)
    a, b = a[fresh], b[fresh]
    for at in range(0, len(a), 1 << 16):
        some = slice(at, at + (1 << 16))
        yield batch(PAIR, [a[some], b[some], pa.nulls(len(a[some]), pa.int64())])


def meet(batches, crowd: int):
    """Rows (a, b, null): pairs to test; (node, size and place, member): texts in a crowd."""
    got = [unsqueeze(blob, "<u8", "<i8", "<u4", "<u4") for b in batches for blob in b.column("blob").to_pylist()]
    if not got:
        return
    t, node, size, place = map(np.concatenate, zip(*got))
    got.clear()
    by = np.argsort(t, kind="stable")
    same = t[by][1:] == t[by][:-1]
    by = by[np.append(False, same) | np.append(same, False)]
    by = by[np.lexsort((node[by], size[by], t[by]))]
    t, node, size, place = t[by], node[by], size[by], place[by]
    fresh = np.append(True, (t[1:] != t[:-1]) | (node[1:] != node[:-1])) if len(t) else np.empty(0, bool)
    t, node, size, place = t[fresh], node[fresh], size[fresh], place[fresh]
    if not len(t):
        return
    heads = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    counts = np.diff(np.append(heads, len(t)))
    many = np.repeat(counts > crowd, counts)
    lows, highs = [], []
    for d in range(1, min(crowd, len(t))):
        at = np.flatnonzero((t[d:] == t[:-d]) & (~many[d:] | (d == 1)) & first_shared(size[d:], place[d:], size[:-d], place[:-d]))
        lows.append(node[at])
        highs.append(node[at + d])
    if many.any():
        centre = np.repeat(np.lexsort((node, t))[heads], counts)
        at = np.flatnonzero(many & (node != node[centre]) & first_shared(size, place, size[centre], place[centre]))
        lows.append(node[at])
        highs.append(node[centre[at]])
    if lows:
        yield from paired(np.concatenate(lows), np.concatenate(highs))
    at = np.flatnonzero(many)
    for i in range(0, len(at), 1 << 16):
        some = at[i : i + (1 << 16)]
        yield batch(PAIR, [node[some], (size[some].astype(np.int64) << 32) + place[some], t[some].view(np.int64)])
    give_back()


def turned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits sketches differ."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def spread(lows: np.ndarray, highs: np.ndarray):
    """(i, j) for each j from lows[i] to highs[i], up to a number at once or those of one i."""
    ends = np.cumsum(highs - lows)
    at = 0
    while at < len(lows):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + LOOK, "right")))
        n = highs[at:to] - lows[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, np.arange(len(i)) - np.repeat(ends[at:to] - n - base, n) + lows[i]
        at = to


def across(batches, best: bool):
    """Crowds' slices, sorted by name, members first, by size: pairs of an asking text and a member of another component
    whose sizes, places and sketches allow a similarity of 0.8. best: of these, for each asking text only the likeliest
    with a member of the crowd's main component and the likeliest with another."""
    carried, lows, highs, n = None, [], [], 0
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(c).to_numpy(zero_copy_only=False) for c in ("name", "node", "size", "place", "part", "stray")]
        columns.append(b.column("value").flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_BITS // 64))
        ask = b.column("ask").to_numpy(zero_copy_only=False)
        asking, members = [c[ask] for c in columns], [c[~ask] for c in columns]
        if carried is not None:
            members = [np.concatenate(x) for x in zip(carried, members)]
        # a slice's members come before all that ask, so those of the last one are kept for the next batch
        own = members[0] == columns[0][-1]
        carried = [c[own] for c in members]
        if not len(members[0]) or not len(asking[0]):
            continue
        name, node, size, place, part, stray, bits = members
        names, group = np.unique(name, return_inverse=True)
        key = (group.astype(np.int64) << 32) + size
        own = np.minimum(np.searchsorted(names, asking[0]), len(names) - 1)
        met = names[own] == asking[0]
        own, asking = own[met], [c[met] for c in asking]
        _, a_node, a_size, a_place, a_part, _, a_bits = asking
        start = own.astype(np.int64) << 32
        first = np.searchsorted(key, start + (4 * a_size.astype(np.int64) + 4) // 5)
        last = np.searchsorted(key, start + 5 * a_size.astype(np.int64) // 4, "right")
        for i, j in spread(first, last):
            ok = a_part[i] != part[j]
            if not best:  # both ask for one another
                ok &= ~stray[j] | (a_node[i] < node[j])
            ok &= first_shared(a_size[i], a_place[i], size[j], place[j])
            i, j = i[ok], j[ok]
            far = np.concatenate([turned(a_bits[i[k : k + HOLD]], bits[j[k : k + HOLD]]) for k in range(0, len(i), HOLD)]) if len(i) else np.empty(0, np.int64)
            both = a_size[i].astype(np.int64) + size[j]
            ok = 9 * far <= both
            i, j, far, both = i[ok], j[ok], far[ok], both[ok]
            if best and len(i):
                by = np.lexsort((node[j], far / both, stray[j], i))
                i, j = i[by], j[by]
                head = np.append(True, (i[1:] != i[:-1]) | (stray[j][1:] != stray[j][:-1]))
                i, j = i[head], j[head]
            lows.append(a_node[i])
            highs.append(node[j])
            n += len(i)
            if n >= FLUSH:
                yield from paired(np.concatenate(lows), np.concatenate(highs))
                lows, highs, n = [], [], 0
    if n:
        yield from paired(np.concatenate(lows), np.concatenate(highs))
    give_back()


def common_shingles(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts of a sample, sorted, and in how many."""
    every = max(1, docs.count() // sample)
    arrow = pa.schema([("token", pa.int64())])

    def run(batches):
        for b in slices(batches):
            found = [shingles(t) for t in b.column("text").to_pylist()]
            yield batch(arrow, [np.concatenate(found).view(np.int64)])

    tokens = docs.where(F.pmod("node", F.lit(every)) == 0).mapInArrow(run, "token long")
    rows = tokens.groupBy("token").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect()
    tokens, times = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    by = np.argsort(tokens)
    return tokens[by], times[by]


def sketch(members: np.ndarray) -> np.ndarray:
    """Bits that each member turns; two sets differ in at least so many members as their sketches in bits."""
    bits = np.bincount((members >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def long_sketch(members: np.ndarray) -> np.ndarray:
    """A sketch of at least as many bits as members: a fixed number is half turned by any large set, and tells none
    apart. One of twice as many bits is folded by turning each bit of its first half by that of the second."""
    n = SKETCH_BITS << (max(0, len(members) - 1) // SKETCH_BITS).bit_length()
    bits = np.bincount((members >> np.uint64(40)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def bitmap(nodes: DataFrame) -> np.ndarray:
    """A bit for each node, of a fixed number; some others' are set with them."""
    arrow = pa.schema([("bits", pa.binary())])

    def fold(batches):
        bits = np.zeros(MAP_BITS, bool)
        for b in batches:
            bits[b.column("node").to_numpy() % MAP_BITS] = True
        if bits.any():
            yield batch(arrow, [[zstandard.compress(np.packbits(bits).tobytes())]])

    def either(batches):
        bits = np.zeros(MAP_BITS // 8, np.uint8)
        for b in batches:
            for blob in b.column("bits").to_pylist():
                bits |= np.frombuffer(zstandard.decompress(blob), np.uint8)
        if bits.any():
            yield batch(arrow, [[zstandard.compress(bits.tobytes())]])

    found = np.zeros(MAP_BITS // 8, np.uint8)
    folded = nodes.mapInArrow(fold, "bits binary").repartition(8).mapInArrow(either, "bits binary")
    for row in folded.collect():  # eight maps at most
        found |= np.frombuffer(zstandard.decompress(row["bits"]), np.uint8)
    return np.unpackbits(found).astype(bool)


def of_nodes(docs: DataFrame, nodes: DataFrame, make) -> DataFrame:
    """node, n (members of its set), value (made of them) of some nodes. Others' texts are left out before they move."""
    wanted = np.packbits(bitmap(nodes))
    arrow = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("value", pa.list_(pa.int64()))])

    def run(batches):
        bits, seen = np.unpackbits(wanted).astype(bool), set()
        for b in slices(batches):
            rows, some = [], np.flatnonzero(bits[b.column("node").to_numpy() % MAP_BITS])
            for node, text in zip(b.column("node").take(pa.array(some)).to_pylist(), b.column("text").take(pa.array(some)).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    members = shingles(text)
                    rows.append((node, len(members), make(members)))
            if rows:
                yield batch(arrow, list(zip(*rows)))

    found = docs.select("text", "node").mapInArrow(run, "node long, n int, value array<long>")
    return materialize(found.join(nodes.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")


def beside(docs: DataFrame, pairs: DataFrame, make) -> DataFrame:
    """pairs with n_a, value_a, n_b, value_b; a node in very many pairs is dealt over several tasks."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").count()
    ends = materialize(ends.select("node", F.ceil(F.col("count") / 64).cast("int").alias("salts")), "near-ends")
    values = of_nodes(docs, ends.select("node"), make).join(ends, "node")
    values = values.select("node", "n", "value", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    out = pairs
    for side, other in (("a", "b"), ("b", "a")):
        out = out.join(ends.select(F.col("node").alias(side), F.col("salts").alias(f"salts_{side}")), side)
        out = out.withColumn(f"salt_{side}", F.pmod(F.xxhash64(other), F.col(f"salts_{side}")).cast("int")).drop(f"salts_{side}")
    for side in "ab":
        out = out.join(values.select(F.col("node").alias(side), F.col("salt").alias(f"salt_{side}"), F.col("n").alias(f"n_{side}"), F.col("value").alias(f"value_{side}")), [side, f"salt_{side}"])
    return out


def tested(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) of nodes, those of a similarity of 0.8 and more. Sketches rule most others out first."""
    both, turn = F.col("n_a") + F.col("n_b"), lambda x, y: x.bitwiseXOR(y)

    def folded(x, y):
        half = F.size(y)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), turn)).otherwise(F.col(x))

    # sizes that allow a similarity of 0.8 give sketches of one length or of twice that
    alike = 5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")
    turned = F.aggregate(F.zip_with(folded("value_a", "value_b"), folded("value_b", "value_a"), lambda x, y: F.bit_count(turn(x, y))), F.lit(0), lambda x, y: x + y)
    return similar(docs, settled(lambda: beside(docs, pairs, long_sketch).where(alike & (9 * turned <= both)).select("a", "b"), "near-likely"))


def similar(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) of nodes, those whose whole sets have a similarity of 0.8 and more."""
    shared = F.size(F.array_intersect("value_a", "value_b"))
    met = beside(docs, pairs, lambda members: members.view(np.int64))
    return met.where(9 * shared >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def node_of(text) -> Column:
    """The name of a text: equal texts have one, and texts without words."""
    return F.when(text.rlike(r"[^ \t\n\r\x0b\f]"), F.xxhash64(text)).otherwise(0)


def with_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, text, node."""
    return documents(docs).withColumn("node", node_of(F.col("text")))


def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that no component of joined (node, component) holds both of."""
    out = pairs
    for side, other in (("a", "b"), ("b", "a")):
        out = dealt_join(out, joined.select(F.col("node").alias(side), F.col("component").alias(f"part_{side}")), side, other, "left")
    return out.where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")


def mixed(crowds: DataFrame, joined: DataFrame) -> DataFrame:
    """crowds (token, node, size, place) with each node's component (part), those of several components only. Crowds of the
    same texts are one: of the members that two of its texts share the first has the least place in both."""
    rows = dealt_join(crowds, joined, "node", "token", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    rows = materialize(rows, "near-crowds")
    tokens = rows.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.bit_xor(F.xxhash64("node")).alias("texts"), F.count("*").alias("n"))
    tokens = tokens.where("low <> high").select("token", F.xxhash64("texts", "n").alias("crowd"))
    return dealt_join(rows, tokens, "token", "node").groupBy(F.col("crowd").alias("token"), "node", "size", "part").agg(F.min("place").alias("place"))


def asked(crowds: DataFrame, sketches: DataFrame, best: bool, n: int, limit: int) -> DataFrame:
    """Distinct pairs (a, b) that across finds. All texts outside a crowd's main component ask; the crowd's members are
    dealt over slices of about `limit`, and who asks goes to each."""
    parts = crowds.groupBy("token", "part").agg(F.count("*").alias("n"))
    mains = parts.groupBy("token").agg(F.max(F.struct("n", "part")).alias("main"), F.ceil(F.sum("n") / limit).cast("int").alias("slices"))
    rows = dealt_join(crowds, mains.select("token", F.col("main.part").alias("main"), "slices"), "token", "node")
    rows = rows.withColumn("stray", F.col("part") != F.col("main")).join(sketches, "node")
    own = F.array(F.struct(F.lit(False).alias("ask"), F.pmod(F.xxhash64("node", "token"), "slices").cast("int").alias("slice")))
    every = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct(F.lit(True).alias("ask"), s.alias("slice")))
    rows = rows.select("*", F.explode(F.when(F.col("stray"), F.concat(own, every)).otherwise(own)).alias("to"))
    rows = rows.select(F.xxhash64("token", "to.slice").alias("name"), "to.ask", "node", "size", "place", "part", "stray", "value")
    dealt = rows.repartition(n, "name").sortWithinPartitions("name", "ask", "size", "node")
    return dealt.mapInArrow(lambda b: across(b, best), "a long, b long, token long").select("a", "b").distinct()


def near_links(docs: DataFrame, crowd: int = CROWD, sample: int = SAMPLE, guesses: DataFrame | None = None, limit: int = SLICE) -> DataFrame:
    """(node, component) of the nodes of with_nodes(...) that have near copies. guesses: a stored table of pairs (a, b) of
    nodes to test first."""
    n = partitions(docs.sparkSession)
    common, times = common_shingles(docs, sample)
    none = docs.sparkSession.createDataFrame([], "a long, b long")
    links = none if guesses is None else settled(lambda: tested(docs, guesses), "near-links")
    joined = components(links)
    met = docs.select("text", "node").mapInArrow(lambda b: scout(b, 4 * n, common, times), SPEC)
    met = materialize(met.repartition(n, "to").mapInArrow(lambda b: meet(b, crowd), "a long, b long, token long"), "near-met")
    pairs = materialize(met.where("token is null").select("a", "b").distinct(), "near-pairs")
    links = settled(lambda: links.unionByName(tested(docs, materialize(apart(pairs, joined), "near-apart"))), "near-links")
    joined = components(links)
    crowds = met.where("token is not null").select("token", F.col("a").alias("node"), F.shiftright("b", 32).alias("size"), F.col("b").bitwiseAND(2**32 - 1).alias("place"))
    if crowds.isEmpty():
        return joined
    crowds = settled(lambda: mixed(crowds, joined), "near-mixed")
    release(met)
    if crowds.isEmpty():
        return joined
    sketches = of_nodes(docs, crowds.select("node").distinct(), sketch).select("node", "value")
    # the likeliest pairs first, as most texts that are left join their group by them
    best = materialize(asked(crowds, sketches, True, n, limit).join(pairs, ["a", "b"], "left_anti"), "near-best")
    links = settled(lambda: links.unionByName(tested(docs, best)), "near-links")
    joined = components(links)
    crowds = settled(lambda: mixed(crowds.drop("part"), joined), "near-mixed")
    if crowds.isEmpty():
        return joined
    more = asked(crowds, sketches, False, n, limit).join(pairs.unionByName(best), ["a", "b"], "left_anti")
    more = materialize(more, "near-across")
    if more.isEmpty():
        return joined
    return components(settled(lambda: links.unionByName(tested(docs, more)), "near-links"))
