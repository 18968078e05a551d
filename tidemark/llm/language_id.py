"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A three-letter string is bound from the vectors of its letters, rotated by
their place, as their product; a text is the bundle (sum) of its strings; a language is the bundle of its texts, each
weighted to unit length. A text gets the language whose prototype has the largest cosine with it.

Prototypes are summed where the texts are read, then over a few tasks; the driver gets a bounded number of vectors.
All labelled rows of the learning folds take part.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is everything if no row has a label. A
null doc_id counts as the empty text for its fold. Ties between languages go to the first in order of name. Repeated
rows are predicted alike; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, slices

DIMENSIONS = 1024
SYMBOLS = 1024
SEED = 11
FOLDS, HELD_OUT = 4, 2
REDUCERS = 16


class Profiles:
    def __init__(self, dimensions: int = DIMENSIONS, remember: int = 40_000):
        rng = np.random.default_rng(SEED)
        self.letters = rng.choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))
        self.symbol = np.zeros(0x110000, np.uint32)
        letter = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
        self.symbol[letter] = 1 + np.flatnonzero(letter) % (SYMBOLS - 1)
        self.remember, self.dimensions = remember, dimensions
        self.codes, self.bound = np.empty(0, np.int64), np.empty((0, dimensions), np.float32)

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, three-letter string, count), by text; white space and signs are one blank. Texts without a letter have none."""
        points = np.frombuffer("\0".join(["", *texts, ""]).lower().replace("i̇", "i").encode("utf-32-le", "surrogatepass"), np.uint32)
        # a text's own zeros are no border
        sizes = [len(t.lower().replace("i̇", "i")) for t in texts]
        ends = np.cumsum(np.array(sizes, np.int64) + 1)
        sign = self.symbol[points]
        border = np.zeros(len(points), bool)
        border[0] = True
        border[ends] = True
        keep = (sign != 0) | border
        keep[1:] |= sign[:-1] != 0
        kept = np.flatnonzero(keep)
        sign, where = sign[kept].astype(np.int64), kept
        if len(sign) < 3:
            return (np.empty(0, np.int64),) * 3
        code = (sign[:-2] * SYMBOLS + sign[1:-1]) * SYMBOLS + sign[2:]
        middle = where[1:-1]
        of = np.searchsorted(ends, middle)  # the text that the middle letter is in
        real = (sign[1:-1] != 0) | ((sign[:-2] != 0) & (sign[2:] != 0) & ~border[middle])
        both, count = np.unique((of[real] << 32) | code[real], return_counts=True)
        return both >> 32, both & 0xFFFFFFFF, count

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Rows of bound vectors for sorted distinct codes."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new):
            if len(self.codes) + len(new) > self.remember:
                self.codes, self.bound, new = np.empty(0, np.int64), np.empty((0, self.dimensions), np.float32), codes
            parts = [np.roll(self.letters[(new >> shift) & (SYMBOLS - 1)], turn, axis=1) for shift, turn in ((20, 2), (10, 1), (0, 0))]
            made = (parts[0] * parts[1] * parts[2]).astype(np.float32)
            both = np.concatenate([self.codes, new])
            by = np.argsort(both)
            self.codes, self.bound = both[by], np.concatenate([self.bound, made])[by]
        return self.bound[np.searchsorted(self.codes, codes)]

    def bundles(self, texts: list[str]) -> np.ndarray:
        """A row for each text."""
        of, code, count = self.grams(texts)
        known, at = np.unique(code, return_inverse=True)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for first in range(0, len(known), 8192):  # bounds the dense counts
            here = (at >= first) & (at < first + 8192)
            counts = np.zeros((len(texts), min(8192, len(known) - first)), np.float32)
            counts[of[here], at[here] - first] = np.sqrt(count[here])
            out += counts @ self.vectors(known[first : first + 8192])
        return out


_PROFILES: dict = {}


def profiles(dimensions: int) -> Profiles:
    if dimensions not in _PROFILES:
        _PROFILES[dimensions] = Profiles(dimensions)
    return _PROFILES[dimensions]


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, held_out."""
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), (number % FOLDS == HELD_OUT).alias("held_out"))


def fit(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and unit prototypes, less their mean direction, from labelled (text, lang) rows."""
    arrow = pa.schema([("lang", pa.string()), ("bundle", pa.binary())])

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        own = profiles(dimensions)
        for b in slices(batches, rows=256, most=2 << 20):
            made = own.bundles(b.column("text").to_pylist())
            size = np.linalg.norm(made, axis=1, keepdims=True)
            made /= np.where(size == 0, 1, size)
            langs = np.array(b.column("lang").to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + made[langs == lang].sum(axis=0, dtype=np.float64)
        yield batch(arrow, [list(sums), [v.tobytes() for v in sums.values()]])

    def total(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, blob in zip(b.column("lang").to_pylist(), b.column("bundle").to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(blob)
        yield batch(arrow, [list(sums), [v.tobytes() for v in sums.values()]])

    spec = "lang string, bundle binary"
    got = docs.where("lang is not null").select("text", "lang").mapInArrow(add, spec).repartition(REDUCERS).mapInArrow(total, spec).collect()
    sums: dict[str, np.ndarray] = {}
    for lang, blob in sorted(map(tuple, got)):
        sums[lang] = sums.get(lang, 0) + np.frombuffer(bytes(blob))
    langs = sorted(k for k, v in sums.items() if v.any())
    if not langs:
        return [], np.empty((0, dimensions))
    made = np.stack([sums[k] for k in langs])
    return langs, made / np.linalg.norm(made, axis=1, keepdims=True)


class Judge:
    """Predictions for batches of texts."""

    def __init__(self, langs: list[str], prototypes: np.ndarray, dimensions: int):
        self.langs, self.prototypes, self.own = langs, prototypes, profiles(dimensions)
        # what all languages share tells none of them apart
        aims = prototypes - (prototypes.mean(axis=0) if len(langs) > 1 else 0)
        self.aims = aims / np.maximum(np.linalg.norm(aims, axis=1, keepdims=True), 1e-12)

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        made = self.own.bundles(texts).astype(np.float64)
        size = np.linalg.norm(made, axis=1)
        unit = made / np.where(size > 0, size, 1)[:, None]
        best = (unit @ self.aims.T).argmax(axis=1)
        score = np.clip((unit * self.prototypes[best]).sum(axis=1), 0, 1)
        return [self.langs[i] if n > 0 else "und" for i, n in zip(best, size)], np.where(size > 0, score, 0.0)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score. docs: doc_id, text, held_out."""
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        judge = Judge(langs, prototypes, dimensions)
        for b in slices(batches, rows=256, most=2 << 20):
            yield batch(arrow, [b.column("doc_id"), b.column("held_out"), *judge(b.column("text").to_pylist())])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def filter_known(docs: DataFrame, langs: list[str], prototypes: np.ndarray, least: float, dimensions: int = DIMENSIONS) -> DataFrame:
    """The rows of docs, as they are, whose text has a learned language with a score of `least` or more."""
    at = docs.columns.index("text")

    def run(batches):
        judge = Judge(langs, prototypes, dimensions)
        for whole in batches:
            for b in slices([whole.rename_columns([f"c{i}" if i != at else "text" for i in range(whole.num_columns)])], rows=256, most=2 << 20):
                pred, score = judge([t or "" for t in b.column(at).to_pylist()])
                keep = pa.array((np.array(pred, object) != "und") & (score >= least))
                yield pa.RecordBatch.from_arrays(b.filter(keep).columns, whole.schema.names)

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, predict all."""
    docs = folded(docs)
    langs, prototypes = fit(docs.where("not held_out"), dimensions)
    return predict(docs, langs, prototypes, dimensions)
