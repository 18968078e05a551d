"""Token counts by the whole-token shortcut.

Before any text is read, the driver proves for each string of the vocabulary whether it is one pre-token and encodes
alone as that one token. A pre-token among the proven ones counts one; only the others are merged. The proven set is
bounded by the vocabulary (about 50,000 strings), so it is broadcast.

Defined cases: a null or empty text has 0 bytes and 0 tokens. A special string inside a text counts one token, as the
library does. Repeated rows give repeated results; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .bytelevel import PLAIN, Chunked, byte_alphabet
from .common import batch, documents, slices

RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens, in the vocabulary's byte alphabet, that are proven to encode alone as one token."""
    tok = Tokenizer.from_file(path)
    letters = byte_alphabet()
    proven = []
    for token, number in tok.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(letters[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        parts = tok.pre_tokenizer.pre_tokenize_str(text)
        if len(parts) == 1 and parts[0][0] == token and [t.id for t in tok.model.tokenize(token)] == [number]:
            proven.append(token)
    return frozenset(proven)


class Counter:
    def __init__(self, path: str, whole: frozenset[str], most: int = 400_000):
        self.tok, self.whole, self.most = Tokenizer.from_file(path), whole, most
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.merged: dict[str, int] = {}
        self.chunks = Chunked(self._chunk, most)
        self.direct = self.merges = 0

    def _pretoken(self, token: str) -> int:
        if token in self.whole:
            self.direct += 1
            return 1
        got = self.merged.get(token)
        if got is None:
            self.merges += 1
            if len(self.merged) >= self.most:
                self.merged.clear()
            got = len(self.tok.model.tokenize(token))
            if len(token) < 200:
                self.merged[token] = got
        return got

    def _shown(self, text: str) -> str:
        return text.replace(" ", "Ġ").replace("\n", "Ċ") if text.isascii() else "".join(map(self.shown.__getitem__, text.encode()))

    def _chunk(self, chunk: str) -> int:
        m = PLAIN.fullmatch(chunk)
        if m:
            return sum(self._pretoken(self._shown(g)) for g in m.groups() if g)
        if any(s in chunk for s in self.special):
            parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", chunk)
            return sum(1 if p in self.special else self._chunk(p) for p in parts if p)
        return sum(self._pretoken(t) for t, _ in self.tok.pre_tokenizer.pre_tokenize_str(chunk))

    def count(self, text: str) -> int:
        return sum(self.chunks.values(text))


_COUNTERS: dict = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    docs = documents(docs)
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path, whole.value)
        counter = _COUNTERS[path]
        for b in slices(batches):
            n = [counter.count(t) for t in b.column("text").to_pylist()]
            yield batch(arrow, [b.column("doc_id"), pc.binary_length(b.column("text")), n, [x > limit for x in n]])

    return docs.mapInArrow(run, RESULT)
