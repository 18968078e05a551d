"""Packing along a space-filling curve.

Each document's token ids are hashed into a vector, which is projected to a few dimensions and placed on a Hilbert
curve. Documents are range-sorted by their place, so neighbours on the curve are neighbours in the output, and their
tokens are laid end to end and cut into sequences. Only the end of the last sequence is padded.

The tokens are written once to the shared folder. The sort and the running offsets work on (key, doc, length) alone;
the tokens are then moved once, to meet their offsets. A third of all rows may have one key: the range sort goes by
(key, digest of the ids, row), which splits equal keys over partitions.

Defined cases: a null or empty text is one end token. Repeated rows, same doc_id included, are packed as often as they
occur; they share doc_id and are told apart by `copy` (0 for the first). Extra columns are dropped. Empty table, empty
result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytelevel import ByteLevel
from .common import batch, documents, materialize, partitions, slices

SEQUENCE = 1024
END = 0
HASHED = 256
DIMENSIONS = 4
BITS = 10


def projection(vocabulary: int, dimensions: int = DIMENSIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each token id in the hashed vector, and the projection of that vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, HASHED, vocabulary), rng.choice([-1.0, 1.0], vocabulary), rng.standard_normal((HASHED, dimensions))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with `bits` bits a dimension (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ t)
            x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(vectors: np.ndarray, plane: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of hashed vectors: unit length, projected, and squashed to the grid by a fixed sigmoid."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    spots = (vectors / np.where(length == 0, 1, length)) @ plane
    return hilbert(np.clip((1 << bits) / (1 + np.exp(-1.7 * spots)), 0, (1 << bits) - 1), bits)


def narrow(ids: bytes, vocabulary: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if vocabulary <= 1 << 16 else ids


_CODECS: dict = {}


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n, key, ids (two bytes each where the vocabulary allows) of every document; ids end with the end token."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        if path not in _CODECS:
            codec = ByteLevel(path)
            _CODECS[path] = codec, *projection(codec.size)
        codec, bucket, sign, plane = _CODECS[path]
        end = np.array([END], "<u4").tobytes()
        for b in slices(batches):
            ids = [codec.ids(t) + end for t in b.column("text").to_pylist()]
            vectors = np.zeros((len(ids), HASHED))
            for i, x in enumerate(ids):
                tokens = np.frombuffer(x, "<u4")
                vectors[i] = np.bincount(bucket[tokens], sign[tokens], HASHED)
            yield batch(arrow, [b.column("doc_id"), [len(x) // 4 for x in ids], curve_keys(vectors, plane), [narrow(x, codec.size) for x in ids]])

    return documents(docs).mapInArrow(run, "doc_id long, n long, key long, ids binary")


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, copy (and ids with keep_ids)."""
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, path), "packing-tokens")
    tokens = tokens.select("*", F.xxhash64("ids").alias("digest"))
    # equal rows are told apart by number; the group is one document's copies under one id
    light = tokens.select("doc_id", "n", "key", "digest").groupBy("doc_id", "n", "key", "digest").count()
    light = light.repartitionByRange(partitions(spark), "key", "digest", "doc_id").sortWithinPartitions("key", "digest", "doc_id")
    light = materialize(light.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "packing-order")
    sums = light.groupBy("part").agg(F.sum(F.col("n") * F.col("count")).alias("total"))
    # one row per partition, so this window is small whatever the input
    base = sums.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    inside = F.sum(F.col("n") * F.col("count")).over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") * F.col("count")
    placed = light.withColumn("inside", inside).join(F.broadcast(base), "part").select("doc_id", "digest", "n", "count", (F.col("inside") + F.col("base")).alias("first"))
    # the small side is hashed, so the tokens needn't be sorted
    met = tokens.select("doc_id", "digest", "ids").join(placed.hint("shuffle_hash"), [tokens["doc_id"].eqNullSafe(placed["doc_id"]), tokens["digest"] == placed["digest"]]).select(tokens["doc_id"], tokens["digest"], "ids", "n", "count", "first")
    single = met.where("count = 1").select("*", F.lit(0).alias("copy"))
    again = met.where("count > 1").withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("first")) - 1)
    rows = single.unionByName(again).withColumn("first", F.col("first") + F.col("n") * F.col("copy"))

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("copy", pa.int32())]
    arrow = pa.schema(fields + [("ids", pa.binary())] * keep_ids)

    def cut(batches):
        for b in slices(batches, column="ids"):
            out = []
            for doc, ids, n, copy, first in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "n", "copy", "first"))):
                ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4").tobytes()
                for number in range(first // sequence, (first + n - 1) // sequence + 1):
                    start, stop = max(number * sequence - first, 0), min((number + 1) * sequence - first, n)
                    part = ids[4 * start : 4 * stop]
                    out.append((doc, start, stop - start, zlib.crc32(part), n, number, first + start - number * sequence, copy, *([part] * keep_ids)))
            yield batch(arrow, list(zip(*out)))

    spec = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, copy int" + ", ids binary" * keep_ids
    return rows.select("doc_id", "ids", "n", "copy", "first").mapInArrow(cut, spec)
