"""Exact removal of repeated 100-byte strings with suffix arrays.

Windows (every 100-byte string of a document) are dealt in runs: neighbouring windows that have the same least hash of
a 32-byte gram. Equal windows have equal least grams, so all copies of a window carry the same routing value, wherever
they are, and a run whose value occurs nowhere else holds no repeated window.

1. scout: hashes of runs go to a task by routing value; runs alone with theirs are done. Equal runs are folded to
   their first place, in the task that reads them and again where they meet, so very common passages shrink first; a
   value that has one distinct run then is done, too.
2. fetch: the text of each distinct run that is left is cut from its document and sent to the shard of its value, a row
   a run: a blob for each document group and shard would be as many as the square of the partitions.
3. sort: a shard builds the suffix array of its runs (Larsson-Sadakane refinement in numpy), common prefixes of
   neighbours (Kasai, by irreducible positions) and so the groups of equal windows with their first place.
   A value with more than `hot_runs` distinct runs is cut into several shards; the first places of their windows
   meet in tasks by digest, an array from each task that sorted, and are merged by binary search.
4. apply: each document drops the bytes of its windows that start earlier elsewhere.

Else only blobs of packed arrays are shuffled between the steps; nothing of the corpus reaches the driver.

Documents go by a key in these steps: their doc_id, or, if texts differ under one doc_id or under none, numbers in order
of doc_id and a digest of the text.

Defined cases: a null or empty text has no bytes. Order is by doc_id, then digest, then start; rows that repeat a doc_id
(or have none) count as one document at that place if their texts are equal, else each text is a document of its own. A
null doc_id comes after all others. Extra columns are dropped. Empty table, empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import batch, documents, give_back, materialize, partitions, slices

SPAN = 100
GRAM = 32
CHUNK = 1 << 20
#: First places of hot windows that a task holds before they go out.
HOT_HELD = 1 << 20
#: Text that is sorted at once, with what exceeds it in its last shard. Some 50 bytes of memory go with each byte.
SHARD_BYTES = 1 << 20
HOT_RUNS = 4096
LAST = np.int64(2**63 - 1)
PLACE = np.dtype([("doc", "<i8"), ("start", "<u4"), ("windows", "<u4")])
U64 = np.uint64


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays column by column, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unsqueeze(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = len(raw) // sum(np.dtype(t).itemsize for t in types)
    out, at = [], 0
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def least_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mixed hash of the gram at each place, and for each window start the least among the window's grams."""
    h, base, width = TABLE[data], 0x9FB21C651E98DF25, 1
    while width < GRAM:
        h = h[:-width] * U64(base) + h[width:]
        base, width = base * base % 2**64, 2 * width
    h = grams = mix(h)
    need, width = SPAN - GRAM + 1, 1
    while 2 * width <= need:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = need - width
    return grams, np.minimum(h[:-rest], h[rest:]) if rest else h


def runs_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first window, windows) of the runs in concatenated documents; positions count in `data`.

    A run ends where the least gram changes or the first place of it leaves the window, so no two of its windows are equal.
    """
    whole = sizes >= SPAN
    starts, ends = starts[whole], (starts + sizes)[whole] - SPAN + 1
    if not len(starts):
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams, least = least_grams(data)
    cut = np.zeros(len(least) + 1, bool)
    cut[1:-1] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    cut[starts] = True
    inside = np.zeros(len(least) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    first = np.flatnonzero(cut & (np.cumsum(inside, dtype=np.int8) > 0))
    stop = np.minimum(np.append(first[1:], ends[-1]), ends[np.searchsorted(starts, first, "right") - 1])
    return least[first], first, stop - first


# -- suffix arrays -----------------------------------------------------------------------------------------------------


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a big-endian number; zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    x = padded[: len(data)].astype(U64)
    for i in range(1, 8):
        x = (x << U64(8)) | padded[i : i + len(data)]
    return x


def index_type(n: int) -> type:
    """Of places in n bytes and sums of two of them."""
    return np.int32 if n < 1 << 30 else np.int64


def suffix_array(data: np.ndarray, eights: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: sort by eight bytes, then refine the groups that aren't single by the rank h places on."""
    n = len(data)
    kind = index_type(n)
    order = np.argsort(eights, kind="stable").astype(kind)
    head = np.ones(n, bool)
    head[1:] = eights[order[1:]] != eights[order[:-1]]
    rank = np.empty(n + 1, kind)
    rank[n] = -1
    rank[order] = np.flatnonzero(head).astype(kind)[np.cumsum(head, dtype=kind) - 1]
    h = 8
    while True:
        alone = head & np.append(head[1:], True)
        at = np.flatnonzero(~alone).astype(kind)
        if not len(at):
            return order
        some = order[at]
        ahead = rank[np.minimum(some + kind(h), kind(n))] + kind(1)
        keys = rank[some].astype(np.int64)
        if h == 8:  # zeros after the end stand for shorter suffixes, which come first
            keys *= 2 * n + 20
            keys += np.where(some + kind(8) > n, kind(n) - some - kind(9), ahead) + kind(10)
        else:
            keys *= n + 2
            keys += ahead
        del ahead
        by = np.argsort(keys, kind="stable").astype(kind)
        some, keys = some[by], keys[by]
        order[at] = some
        fresh = np.ones(len(at), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        head[at] = fresh
        rank[some] = at[np.flatnonzero(fresh).astype(kind)[np.cumsum(fresh, dtype=kind) - 1]]
        h = min(2 * h, n)


def common_prefixes(data: np.ndarray, order: np.ndarray, eights: np.ndarray) -> np.ndarray:
    """Kasai: length that each suffix shares with the one before it in order.

    Going through the text, the shared length falls by one at most, and by exactly one unless the bytes before both
    suffixes differ; only the latter are compared, the others follow.
    """
    n = len(data)
    kind = index_type(n)
    before = np.empty(n, kind)
    before[order[1:]], before[order[0]] = order[:-1], -1
    prior = before - 1
    own = np.ones(n, bool)
    own[1:] = (prior[1:] < 0) | (data[:-1] != data[np.maximum(prior[1:], 0)])
    open_ = np.flatnonzero(own & (before >= 0)).astype(kind)
    shared = np.zeros(n, kind)
    left, right = open_.copy(), before[open_]
    del before, prior
    while len(open_):
        diff = eights[left] ^ eights[right]
        same = diff == 0
        part = np.zeros(len(diff), kind)
        for k in range(1, 9):
            part += (diff >> U64(64 - 8 * k)) == 0
        room = n - np.maximum(left, right)
        shared[open_] += np.minimum(part, room)
        on = same & (room > 8)
        open_, left, right = open_[on], left[on] + kind(8), right[on] + kind(8)
    places = np.arange(n, dtype=kind)
    shared += places
    shared[~own] = 0
    shared = np.maximum.accumulate(shared) - places
    shared[order[0]] = 0
    return shared[order]


def earliest(texts: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over all windows of some runs (of 100 bytes or more): number of the run, place in it, whether it starts earlier
    elsewhere, and whether it is the first of its group."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    eights = words8(data)
    order = suffix_array(data, eights)
    shared = common_prefixes(data, order, eights)
    del eights
    groups = np.cumsum(shared < SPAN, dtype=order.dtype)
    del shared
    edges = np.cumsum(sizes) - sizes
    inside = np.zeros(len(data) + 1, np.int8)  # windows of runs: all but the last 99 places of each
    inside[edges] += 1
    inside[edges + sizes - SPAN + 1] -= 1
    window = np.cumsum(inside[:-1], dtype=np.int8).view(bool)[order]
    order, groups = order[window], groups[window]
    run = np.repeat(np.arange(len(texts), dtype=order.dtype), sizes)[order]
    place = order - edges.astype(order.dtype)[run]
    ranks = np.unique(docs, return_inverse=True)[1].astype(np.int64)
    where = (ranks[run] << 33) + starts.astype(np.int64)[run] + place
    heads = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.empty(0, np.int64)
    least = np.minimum.reduceat(where, heads) if len(heads) else heads
    first = np.repeat(least, np.diff(np.append(heads, len(order))))
    later = where > first
    lead = np.zeros(len(order), bool)
    if len(heads):
        nth = np.flatnonzero(~later)
        lead[nth[np.append(True, groups[nth][1:] != groups[nth][:-1])]] = True
    return run, place, later, lead


# -- the steps ---------------------------------------------------------------------------------------------------------

BLOB = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
SPEC = "to long, kind int, blob binary"
RUN = pa.schema([("to", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("hot", pa.bool_()), ("text", pa.binary())])
RUN_SPEC = "to long, doc long, start long, hot boolean, text binary"
FOUND, WANTED, HOT = 0, 1, 2


def dealt(to: np.ndarray, kind: int, arrays: list[np.ndarray]):
    """One row for each receiver, with its share of the arrays."""
    if not len(to):
        return
    by = np.argsort(to, kind="stable")
    to = to[by]
    heads = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    ends = np.append(heads[1:], len(to))
    arrays = [a[by] for a in arrays]
    for at in range(0, len(heads), 256):
        some = list(zip(heads[at : at + 256].tolist(), ends[at : at + 256].tolist()))
        yield batch(BLOB, [to[heads[at : at + 256]].astype(np.int64), [kind] * len(some), [squeeze(*(a[i:j] for a in arrays)) for i, j in some]])


def receiver(docs: np.ndarray, groups: int) -> np.ndarray:
    """Group of each document, as Spark's pmod(xxhash64(doc_id), groups) has it."""
    p1, p2, p3, p4, p5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << U64(k)) | (x >> U64(64 - k))
    h = (U64(42) + p5 + U64(8)) ^ (turn(docs.view(U64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> U64(33))) * p2
    h = (h ^ (h >> U64(29))) * p3
    return (h ^ (h >> U64(32))).view(np.int64) % groups


def scout(batches, groups: int):
    """Runs of all texts of a task; runs that repeat an earlier one of the task are already decided."""
    values, hashes, docs, starts, counts, held = [], [], [], [], [], 0

    def flush():
        if not values:
            return
        v, h, d, s, c = map(np.concatenate, (values, hashes, docs, starts, counts))
        for x in (values, hashes, docs, starts, counts):
            x.clear()
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[back] > 1)
        by = again[np.lexsort((s[again], d[again], h[again]))]
        lead = np.append(True, h[by][1:] != h[by][:-1]) if len(by) else np.empty(0, bool)
        first = by[np.flatnonzero(lead)[np.cumsum(lead) - 1]] if len(by) else by
        decided = by[(d[by] != d[first]) | (s[by] != s[first])]
        keep = np.ones(len(h), bool)
        keep[by[~lead]] = False
        yield from dealt((mix(v[keep]) % U64(groups)).astype(np.int64), WANTED, [v[keep], h[keep], d[keep], s[keep], c[keep]])
        yield from dealt(receiver(d[decided], groups), FOUND, [d[decided], s[decided], c[decided]])

    digest = xxhash.xxh3_64_intdigest

    def take(parts):
        data = b"".join(p[2] for p in parts)
        sizes = np.fromiter((len(p[2]) for p in parts), np.int64, len(parts))
        edges = np.cumsum(sizes) - sizes
        value, first, n = runs_of(np.frombuffer(data, np.uint8), edges, sizes)
        if len(first):
            of = np.searchsorted(edges, first, "right") - 1
            values.append(value)
            hashes.append(np.fromiter([digest(data[a:b]) for a, b in zip(first.tolist(), (first + n + SPAN - 1).tolist())], U64, len(first)))
            docs.append(np.array([p[0] for p in parts], np.int64)[of])
            starts.append((first - edges[of] + np.array([p[1] for p in parts])[of]).astype(np.uint32))
            counts.append(n.astype(np.uint32))

    parts, size = [], 0
    for b in slices(batches):
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            for at in range(0, len(text) - SPAN + 1, CHUNK):
                piece = text[at : at + CHUNK + SPAN - 1]
                parts.append((doc, at, piece))
                size += len(piece)
                if size >= CHUNK:
                    take(parts)
                    held += size
                    parts, size = [], 0
                    if held >= 24 * CHUNK:
                        yield from flush()
                        held = 0
    if parts:
        take(parts)
    yield from flush()
    parts.clear()
    give_back()


def passed(blobs: list[tuple[int, bytes]]):
    """Rows of what others have found."""
    for at in range(0, len(blobs), 256):
        to, packed = zip(*blobs[at : at + 256])
        yield batch(BLOB, [to, [FOUND] * len(to), packed])


def meet(batches, groups: int, shards: int, hot_runs: int):
    """Runs by routing value: who has company, who is first."""
    got = []
    for b in batches:
        rows = list(zip(*(b.column(c).to_pylist() for c in ("kind", "to", "blob"))))
        yield from passed([(to, blob) for kind, to, blob in rows if kind == FOUND])
        got += [unsqueeze(blob, "<u8", "<u8", "<i8", "<u4", "<u4") for kind, _, blob in rows if kind == WANTED]
    if not got:
        return
    v, h, d, s, c = map(np.concatenate, zip(*got))
    by = np.argsort(v, kind="stable")
    sv = v[by]
    same = sv[1:] == sv[:-1]
    by = by[np.append(False, same) | np.append(same, False)]
    by = by[np.lexsort((s[by], d[by], h[by], v[by]))]
    v, h, d, s, c = v[by], h[by], d[by], s[by], c[by]
    lead = np.append(True, (h[1:] != h[:-1]) | (v[1:] != v[:-1])) if len(v) else np.empty(0, bool)
    first = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(v) else lead
    decided = (d != d[first]) | (s != s[first])
    yield from dealt(receiver(d[decided], groups), FOUND, [d[decided], s[decided], c[decided]])
    v, h, d, s, c = v[lead], h[lead], d[lead], s[lead], c[lead]
    if not len(v):
        return
    heads = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    distinct = np.repeat(np.diff(np.append(heads, len(v))), np.diff(np.append(heads, len(v))))
    some = distinct > 1  # no two windows of a run are equal
    v, h, d, s, c, distinct = v[some], h[some], d[some], s[some], c[some], distinct[some]
    hot = distinct > hot_runs
    salt = np.where(hot, h % np.maximum(1, -(-distinct // hot_runs)).astype(U64), U64(0)).astype(U64)
    shard = mix(v + salt * U64(0x9E3779B97F4A7C15)) % U64(shards)
    yield from dealt(receiver(d, groups), WANTED, [d, s, c, shard, hot.astype(np.uint8)])
    give_back()


def fetch(docs: pa.Table, wants: pa.Table, key_at: int, text_at: int):
    """Cut the wanted runs from their documents."""
    texts = dict(zip(docs.column(key_at).to_pylist(), docs.column(text_at).cast(pa.binary()).to_pylist()))
    made = []
    for blob in wants.column("blob").to_pylist():
        d, s, c, shard, hot = unsqueeze(blob, "<i8", "<u4", "<u4", "<u8", "u1")
        runs = [texts[doc][start : start + n + SPAN - 1] for doc, start, n in zip(d.tolist(), s.tolist(), c.tolist())]
        made.append(batch(RUN, [shard.view(np.int64), d, s.astype(np.int64), hot.astype(bool), runs]))
    return pa.Table.from_batches(made, RUN).combine_chunks()  # else each goes to Spark by itself


def stretches(docs: np.ndarray, places: np.ndarray):
    """Neighbouring windows as (doc, start, windows)."""
    by = np.lexsort((places, docs))
    docs, places = docs[by], places[by]
    heads = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (places[1:] != places[:-1] + 1))) if len(docs) else np.empty(0, np.int64)
    return docs[heads], places[heads].astype(np.uint32), np.diff(np.append(heads, len(docs))).astype(np.uint32)


def sort(batches, groups: int):
    """Suffix arrays over the shards of a task, a few at a time; a shard stays whole. Rows come sorted by shard."""
    held, size, last, gone, firsts, waiting = [], 0, None, [], [], 0

    def solve():
        nonlocal waiting
        d, s, hot = (np.concatenate([x[i] for x in held]) for i in range(3))
        texts = [t for x in held for t in x[3]]
        run, place, later, lead = earliest(texts, d, s)
        at = s[run] + place
        gone.append(stretches(d[run[later]], at[later]))
        first = lead & hot[run]
        if first.any():
            digests = b"".join([xxhash.xxh3_128_digest(texts[r][p : p + SPAN]) for r, p in zip(run[first].tolist(), place[first].tolist())])
            digests = np.frombuffer(digests, "<u8").reshape(-1, 2)
            firsts.append((digests[:, 0], digests[:, 1], d[run[first]], at[first]))
            waiting += len(digests)

    def send():
        nonlocal waiting
        a, b, d, p = map(np.concatenate, zip(*firsts))
        firsts.clear()
        waiting = 0
        by = np.lexsort((p, d, b, a))
        a, b, d, p = a[by], b[by], d[by], p[by]
        fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        gone.append(stretches(d[~fresh], p[~fresh]))
        yield from dealt((a[fresh] % U64(groups)).astype(np.int64), HOT, [a[fresh], b[fresh], d[fresh], p[fresh]])

    for b in batches:
        to, d, s, hot = (b.column(c).to_numpy(zero_copy_only=False) for c in ("to", "doc", "start", "hot"))
        texts = b.column("text").to_pylist()
        heads = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
        for i, j in zip(heads, [*heads[1:], len(to)]):
            if size >= SHARD_BYTES and to[i] != last:
                solve()
                held, size = [], 0
                if waiting >= HOT_HELD:
                    yield from send()
            held.append((d[i:j], s[i:j], hot[i:j], texts[i:j]))
            size += sum(map(len, texts[i:j]))
            last = to[i]
    if held:
        solve()
        held.clear()
    if firsts:
        yield from send()
    if gone:
        found = [np.concatenate(x) for x in zip(*gone)]
        yield from dealt(receiver(found[0], groups), FOUND, found)
    give_back()


def merge(batches, groups: int):
    """First places of hot windows from several shards: each sorted array is searched in the merged one. What a task
    finds goes out together."""
    held, last, gone, waiting = [], None, [], 0

    def solve():
        nonlocal waiting
        a, b = (np.concatenate([x[i] for x in held]) for i in range(2))
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        fresh = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        keys = np.empty(fresh.sum(), [("a", "<u8"), ("b", "<u8")])
        keys["a"], keys["b"] = a[fresh], b[fresh]
        if (keys["a"][1:] != keys["a"][:-1]).all():
            spots = [np.searchsorted(keys["a"], x[0]) for x in held]
        else:
            spots = [np.searchsorted(keys, np.rec.fromarrays(x[:2], keys.dtype)) for x in held]
        doc, place = np.full(len(keys), LAST), np.full(len(keys), LAST)
        for spot, (_, _, d, p) in zip(spots, held):
            better = (d < doc[spot]) | ((d == doc[spot]) & (p < place[spot]))
            doc[spot[better]], place[spot[better]] = d[better], p[better]
        for spot, (_, _, d, p) in zip(spots, held):
            later = (d != doc[spot]) | (p != place[spot])
            if later.any():
                gone.append((d[later], p[later]))
                waiting += int(later.sum())

    def send():
        nonlocal waiting
        found = stretches(*map(np.concatenate, zip(*gone)))
        gone.clear()
        waiting = 0
        yield from dealt(receiver(found[0], groups), FOUND, list(found))

    for b in batches:
        for to, blob in zip(b.column("to").to_pylist(), b.column("blob").to_pylist()):
            if held and to != last:
                solve()
                held = []
                if waiting >= HOT_HELD:
                    yield from send()
            held.append(unsqueeze(blob, "<u8", "<u8", "<i8", "<i8"))
            last = to
    if held:
        solve()
        held.clear()
    if gone:
        yield from send()
    give_back()


def spans_of(size: int, starts: np.ndarray, windows: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches of bytes under windows."""
    if not len(starts):
        return []
    by = np.argsort(starts, kind="stable")
    a, b = starts[by].astype(np.int64), (starts.astype(np.int64) + windows + SPAN - 1)[by]
    b = np.maximum.accumulate(b)
    head = np.append(True, a[1:] > b[:-1])
    return list(zip(a[head].tolist(), np.append(b[:-1][head[1:]], b[-1]).tolist()))


def keyed(docs: DataFrame) -> DataFrame:
    """docs and the column key: one number for each doc_id and text, in order of doc_id."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    last = F.coalesce(doc, F.lit(int(LAST)))
    names = docs.select(doc.alias("doc"), last.alias("last"), F.xxhash64(text, doc.isNull()).alias("digest"))
    if names.groupBy("last").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").isEmpty():
        return docs.withColumn("key", last)
    # ids of partitions in order, each in order
    numbers = names.distinct().orderBy(F.col("doc").asc_nulls_last(), "digest").select(F.col("last").alias("last_"), F.col("digest").alias("digest_"), F.monotonically_increasing_id().alias("key"))
    numbers = materialize(numbers, "suffix-keys")
    return materialize(docs.join(numbers, (last == F.col("last_")) & (F.xxhash64(text, doc.isNull()) == F.col("digest_"))).drop("last_", "digest_"), "suffix-keyed")


def repeated_spans(docs: DataFrame, hot_runs: int = HOT_RUNS) -> tuple[DataFrame, DataFrame]:
    """The documents by group (columns c0, c1, ..., key and to), and rows (to, kind, blob) of what each group's documents lose."""
    spark = docs.sparkSession
    n = partitions(spark)
    groups, shards = 2 * n, 16 * n
    names = docs.columns
    docs = keyed(docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"c{i}") for i, c in enumerate(names))))
    met = documents(docs.withColumn("doc_id", F.col("key"))).mapInArrow(lambda b: scout(b, groups), SPEC).repartition(n, "to").mapInArrow(lambda b: meet(b, groups, shards, hot_runs), SPEC)
    met = materialize(met, "suffix-runs")
    cast = {"doc_id": "long", "text": "string"}
    columns = [F.col(c).cast(cast[c]).alias(f"c{i}") if c in cast else F.col(f"c{i}") for i, c in enumerate(names)]
    text_at, key_at = names.index("text"), len(names)
    to = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("long")
    grouped = docs.select(*columns, "key", to.alias("to")).repartition(n, "to")
    cut = lambda a, b: fetch(a, b, key_at, text_at)
    texts = grouped.groupBy("to").cogroup(met.where(F.col("kind") == WANTED).groupBy("to")).applyInArrow(cut, RUN_SPEC)
    sorted_ = texts.repartition(n, "to").sortWithinPartitions("to").mapInArrow(lambda b: sort(b, groups), SPEC)
    sorted_ = materialize(sorted_, "suffix-sorted")
    hot = sorted_.where(F.col("kind") == HOT).repartition(n, "to").sortWithinPartitions("to").mapInArrow(lambda b: merge(b, groups), SPEC)
    found = met.where(F.col("kind") == FOUND).unionByName(sorted_.where(F.col("kind") == FOUND)).unionByName(hot)
    return grouped, found


def lost(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    got = [unsqueeze(x, "<i8", "<u4", "<u4") for x in table.column("blob").to_pylist()]
    if not got:
        return {}
    d, s, c = map(np.concatenate, zip(*got))
    by = np.argsort(d, kind="stable")
    d, s, c = d[by], s[by], c[by]
    heads = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else []
    ends = np.append(heads[1:], len(d)) if len(d) else []
    return {int(d[i]): (s[i:j], c[i:j]) for i, j in zip(heads, ends)}


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    grouped, found = repeated_spans(documents(docs), hot_runs)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        gone, rows = lost(right), []
        for doc, text, key in zip(left.column(0).to_pylist(), left.column(1).cast(pa.binary()).to_pylist(), left.column(2).to_pylist()):
            spans = spans_of(len(text), *gone.get(key, ((), ())))
            kept = kept_bytes(text, spans)
            rows.append((doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_batches([batch(arrow, list(zip(*rows)) if rows else [[]] * len(arrow))], arrow)

    return grouped.groupBy("to").cogroup(found.groupBy("to")).applyInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """docs with the repeated bytes cut from text, and n_chars, if there is one, the new length. A character of several
    bytes that loses one goes whole. Null texts stay null; other columns and all rows are kept."""
    grouped, found = repeated_spans(docs, hot_runs)
    names = docs.columns
    text_at, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        gone = lost(right)
        texts = left.column(text_at).to_pylist()
        sizes = left.column(size_at).to_pylist() if size_at >= 0 else []
        for i, key in enumerate(left.column(len(names)).to_pylist()):
            where = gone.get(key)
            if where and texts[i]:
                text = texts[i].encode()
                texts[i] = kept_bytes(text, spans_of(len(text), *where)).decode("utf-8", "ignore")
                if size_at >= 0:
                    sizes[i] = len(texts[i])
        made = {text_at: pa.array(texts, pa.string())} | ({size_at: pa.array(sizes, left.column(size_at).type)} if size_at >= 0 else {})
        columns = [made.get(i, left.column(i)) for i in range(len(names))]
        return pa.Table.from_arrays(columns, [f"c{i}" for i in range(len(names))])

    spec = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(grouped.schema.fields[:-2])])
    out = grouped.groupBy("to").cogroup(found.groupBy("to")).applyInArrow(apply, spec)
    return out.select(*(F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(docs.schema.fields)))
