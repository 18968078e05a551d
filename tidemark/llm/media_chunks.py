"""Media columns in content-defined chunks.

A payload is stored as a gray image (binary PGM, 24 samples a line, 8 bits a sample). The stored bytes are cut where a
rolling gear hash of the last 32 bytes has its top bits zero, so equal stretches give equal chunks wherever they stand.
Digests of all chunks are joined to find each chunk's owner (the first place it occurs); only owners' bytes enter the
store. A medium is the ordered list of its digests; media with equal lists are rebuilt once, from the store, each chunk
and the whole checked against their digests, and read back.

Documents are read twice: for their lists, written once, and for the bytes. Bytes move once by digest, and once more only
for media of several chunks. Chunk bytes are compressed in the worker. A chunk that more than `hot` distinct lists name is
copied to several tasks that share its lists; one that occurs in very many places, and a list of very many rows, are
dealt over several tasks.

Defined cases: a null or empty text is a payload of 576 bytes of value 255. Repeated rows give repeated results; equal
texts give equal values. Extra columns are dropped. Empty table, empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, documents, materialize, skewed_join, slices

UNIT = 576
WIDTH = 24
LEAST, MASK_BITS, MOST = 4096, 13, 65536
HOT = 1000
#: A chunk that occurs more often than this is looked up by several tasks.
COMMON = 100_000
GEAR = np.random.default_rng(29).integers(0, 1 << 32, 256, dtype=np.uint32)
PARTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"


def encode_media(data: bytes) -> bytes:
    """The stored form of a payload: data padded with 255 to a positive multiple of 576, as a PGM."""
    size = max(1, -(-len(data) // UNIT)) * UNIT
    return b"P5\n%d %d\n255\n" % (WIDTH, size // WIDTH) + data.ljust(size, b"\xff")


def decode_media(stored: bytes) -> bytes:
    kind, shape, top, samples = stored.split(b"\n", 3)
    width, height = map(int, shape.split())
    if kind != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not the stored form")
    return samples


def cuts(stored: bytes, least: int = LEAST, bits: int = MASK_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks."""
    n = len(stored)
    if n <= least:
        return [n]
    h, width = GEAR[np.frombuffer(stored, np.uint8)], 1
    while width < 32:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    spots = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends, at = [], 0
    while at < n:
        k = np.searchsorted(spots, at + least)
        end = min(int(spots[k]) if k < len(spots) else n, at + most, n)
        ends.append(end)
        at = end
    return ends


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    stored = encode_media(data)
    ends = cuts(stored)
    return [(hashlib.sha256(c).digest(), c) for c in (stored[a:b] for a, b in zip([0, *ends], ends))]


def feature(samples: bytes) -> str:
    """Mean, deviation and a 16-bin histogram of the samples."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    return f"{x.mean():.4f} {x.std():.4f} " + ",".join(map(str, bins.tolist()))


def describe(stored: bytes, n_bytes: int, n_chunks: int) -> tuple:
    samples = decode_media(stored)
    return n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples), n_chunks


def lists(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, list (name of the medium), digests (its chunks in order)."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("list", pa.binary()), ("digests", pa.list_(pa.binary()))])

    def run(batches):
        for b in slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            made = [[d for d, _ in chunks(t)] for t in texts]
            names = [hashlib.sha256(b"".join(m) + len(t).to_bytes(8, "little")).digest() for m, t in zip(made, texts)]
            yield batch(arrow, [b.column("doc_id"), [len(t) for t in texts], names, made])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, list binary, digests array<binary>")


def chunk_rows(docs: DataFrame) -> DataFrame:
    """digest, src, seq, bytes: every chunk with its place; of equal chunks in a batch the first place only."""
    arrow = pa.schema([("digest", pa.binary()), ("src", pa.int64()), ("seq", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        for b in slices(batches, rows=4096, most=16 << 20):
            first: dict[bytes, tuple] = {}
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                for seq, (digest, data) in enumerate(chunks(text)):
                    place = (-(2**63) if doc is None else doc, seq)
                    if digest not in first or place < first[digest][:2]:
                        first[digest] = (*place, data)
            rows = [(d, src, seq, zstandard.compress(data, 3)) for d, (src, seq, data) in first.items()]
            for at in range(0, len(rows), 512):
                yield batch(arrow, list(zip(*rows[at : at + 512])))

    return documents(docs).mapInArrow(run, "digest binary, src long, seq int, bytes binary")


def store_and_rebuild(docs: DataFrame, hot: int = HOT, common: int = COMMON) -> DataFrame:
    listed = materialize(lists(docs), "media-lists")
    place = F.coalesce("doc_id", F.lit(-(2**63)))
    uses = listed.select(place.alias("src"), F.posexplode("digests").alias("seq", "digest"))
    owners = uses.groupBy("digest").agg(F.min(F.struct("src", "seq")).alias("own"), F.count("*").alias("uses"))
    media = listed.groupBy("list").agg(F.min("n_bytes").alias("n_bytes"), F.min("digests").alias("digests"))
    named = media.select("list", "n_bytes", F.size("digests").alias("n_chunks"), F.posexplode("digests").alias("at", "digest"))
    named_by = named.groupBy("digest").agg(F.count("*").alias("lists"))
    light = owners.join(named_by, "digest")
    # the store: one row of bytes for each digest, found by a join of digests
    # (compared by order, as equality would become a key of the join and part it from the next one's)
    rows, keys = chunk_rows(docs), ["digest"]
    often = owners.where(F.col("uses") > common).select("digest")
    if not often.isEmpty():  # at most one digest of `common` places
        often = materialize(often, "media-common").select("digest", F.lit(True).alias("often"))
        few = F.broadcast(often) if often.count() < 100_000 else often
        rows = rows.join(few, "digest", "left").withColumn("part", F.when(F.col("often"), F.pmod(F.xxhash64("src"), F.lit(64))).otherwise(0).cast("int")).drop("often")
        light = light.withColumn("part", F.explode(F.when(F.col("uses") > common, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))))
        keys = ["digest", "part"]
    store = rows.join(light.hint("shuffle_hash"), keys).where(F.struct("src", "seq") <= F.col("own")).select("digest", "bytes", "lists")
    few = store.where(F.col("lists") <= hot)
    asked = named.join(named_by, "digest")
    plain = few.join(asked.where(F.col("lists") <= hot).drop("lists").hint("shuffle_hash"), "digest")
    salts = F.ceil(F.col("lists") / hot).cast("int")
    copies = store.where(F.col("lists") > hot).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    salted = asked.where(F.col("lists") > hot).withColumn("salt", F.pmod(F.xxhash64("list"), salts).cast("int")).drop("lists")
    common = copies.join(salted, ["digest", "salt"]).drop("salt")
    pieces = plain.select("list", "n_bytes", "n_chunks", "at", "digest", "bytes").unionByName(common.select("list", "n_bytes", "n_chunks", "at", "digest", "bytes"))

    out = pa.schema([("list", pa.binary())] + [(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]]) for f in PARTS.split(", ")])

    def checked(digest: bytes, data: bytes) -> bytes:
        data = zstandard.decompress(data)
        if hashlib.sha256(data).digest() != digest:
            raise ValueError("a chunk differs from its digest")
        return data

    def whole(batches):
        """Media of one chunk need no gathering."""
        for b in slices(batches, column="bytes"):
            rows = [(r["list"], *describe(checked(r["digest"], r["bytes"]), r["n_bytes"], 1)) for r in b.to_pylist()]
            yield batch(out, list(zip(*rows)))

    def gathered(table: pa.Table) -> pa.Table:
        got = {r["at"]: r for r in table.to_pylist()}
        first = got[0]
        stored = b"".join(checked(got[i]["digest"], got[i]["bytes"]) for i in range(first["n_chunks"]))
        row = (first["list"], *describe(stored, first["n_bytes"], first["n_chunks"]))
        return pa.Table.from_batches([batch(out, [[x] for x in row])])

    spec = "list binary, " + PARTS
    one = pieces.where("n_chunks = 1").mapInArrow(whole, spec)
    many = pieces.where("n_chunks > 1").groupBy("list").applyInArrow(gathered, spec)
    built = one.unionByName(many).dropDuplicates(["list"])
    columns = ["doc_id", *(f.split()[0] for f in PARTS.split(", "))]
    return skewed_join(listed.select("doc_id", "list"), built, "list", "doc_id").select(*columns)
