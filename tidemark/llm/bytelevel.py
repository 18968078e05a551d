"""Byte-level BPE over cached chunks.

With the byte-level pre-tokenizer no pre-token holds a non-space followed by a space, and what a run of white space
becomes depends only on that run and whether something follows. So a text may be cut before any space that follows a
non-space, and each chunk tokenized alone. Chunks repeat, so each worker remembers a bounded number of them.
"""

from __future__ import annotations

import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: A chunk whose pre-tokens are its groups.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)?(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)?)?")
CUT = re.compile(r"(?<=\S)(?= )")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        table[chr(256 + n)] = b
    return table


class Chunked:
    """Maps chunks of text to a value and sums or joins the values over a whole text."""

    def __init__(self, value, most: int = 300_000):
        self.value, self.most = value, most
        self.spaced: dict = {}  # word -> value of " " + word
        self.other: dict = {}

    def _other(self, chunk: str):
        got = self.other.get(chunk)
        if got is None:
            if len(self.other) >= self.most:
                self.other.clear()
            got = self.value(chunk)
            if len(chunk) < 200:
                self.other[chunk] = got
        return got

    def values(self, text: str) -> list:
        if not text:
            return []
        words = text.split(" ")
        first, words = words[0], words[1:]
        cache = self.spaced
        try:
            return [self._other(first), *[cache[w] for w in words]] if first and not first[-1].isspace() else self._slow(text)
        except KeyError:
            pass
        if len(cache) >= self.most:
            cache.clear()
        for w in words:
            if w not in cache:
                if not w or w[-1].isspace():
                    return self._slow(text)
                cache[w] = self.value(" " + w)
        out = [self._other(first), *[cache[w] for w in words]]
        for w in words:
            if len(w) > 200:
                cache.pop(w, None)
        return out

    def _slow(self, text: str) -> list:
        """Texts with runs of white space."""
        return [self._other(chunk) for chunk in CUT.split(text)]


#: Letters and signs on whose classes every edition of Unicode in use agrees; other texts go to the library itself.
STABLE = re.compile(r"[^\x00-\u024f\u2010-\u203a]")


class ByteLevel:
    """Ids of a byte-level tokenizer.json whose ids follow the order of its merges; equal to the library's own."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        if any(spec["model"]["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("the ids of this vocabulary don't follow its merges")
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.core = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)._core_bpe
        self.special = set(special)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if STABLE.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return bytes(self.core.encode_to_tiktoken_buffer(text, self.special))
