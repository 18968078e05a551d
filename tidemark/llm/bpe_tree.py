"""BPE encoding by tree concatenation, and decoding.

A text that is longer than a leaf is halved until leaves remain; halves are encoded on their own (those of very long
texts in different Spark tasks) and joined: a window around the join is encoded again and grows until its ends agree
exactly with what both sides have there. White space is a hard border of this vocabulary, so on texts the unit of a
window is the word. Where a join falls into a word without white space that is longer than a leaf, the unit is the cell:
what the library's pattern takes at once (letters, a digit, marks). If both cells at the join are one run of letters, the
unit is the token: agreement of the tokens at both ends of the window proves every adjacent pair of the joined sequence,
and so the whole. Only a run of other letters or marks that is longer than a leaf by itself is encoded again as one.

Defined cases: a null or empty text has no ids and decodes to the empty string. Equal rows give equal rows. Extra
columns are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import batch, documents, partitions, slices

LEAF_CHARS = 8192
SEGMENT_CHARS = 1 << 16
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SPACES = str.maketrans("\n\t\r", "   ")
WORD = re.compile(r"([A-Za-z]+)([.,;:!?]+)")


class Long:
    """A stretch without white space as cells, each with its characters and ids."""

    __slots__ = ("cells",)

    def __init__(self, cells: list[tuple[str, bytes]]):
        self.cells = cells

    def ids(self) -> bytes:
        return b"".join([ids for _, ids in self.cells])

    def pack(self) -> bytes:
        return np.array([(len(t), len(ids) // 4) for t, ids in self.cells], "<u4").tobytes()

    @classmethod
    def unpack(cls, blob: bytes, text: str, ids: bytes) -> Long:
        cells, at, start = [], 0, 0
        for size, count in np.frombuffer(blob, "<u4").reshape(-1, 2).tolist():
            cells.append((text[at : at + size], ids[start : start + 4 * count]))
            at, start = at + size, start + 4 * count
        return cls(cells)


class Piece:
    """A stretch of text as words between single spaces, and the ids of each word; first and last are the cells of the
    outer words, if they are long."""

    __slots__ = ("words", "ids", "first", "last")

    def __init__(self, words: list[str], ids: list[bytes], first: Long | None = None, last: Long | None = None):
        self.words, self.ids, self.first, self.last = words, ids, first, last


class TreeEncoder:
    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, remember: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.inner = BPE(model["vocab"], merges, unk_token=model["unk_token"]) if self.suffix else self.tok.model
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.leaf, self.remember = max(4, leaf_chars), remember
        self.known: dict[str, bytes] = {"": b""}
        self.joined_chars = 0  # characters that joins encode again
        self.surface = [(self.tok.id_to_token(i) or "").removesuffix(self.suffix or "\0") for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.table = None
        if spec["decoder"] is None:
            size = self.tok.get_vocab_size(with_added_tokens=True)
            self.table = [(self.tok.id_to_token(i) or "").encode() for i in range(size)]

    # -- tokens of one long pre-token ------------------------------------------------------------------------------

    def _run(self, text: str, last: bool) -> list[tuple[int, str]]:
        found = (self.tok.model if last else self.inner).tokenize(text)
        return [(t.id, t.value.removesuffix(self.suffix) if last and n == len(found) - 1 and self.suffix else t.value) for n, t in enumerate(found)]

    def tree(self, text: str, last: bool = True) -> list[tuple[int, str]]:
        """(id, surface) of a pre-token; last: it ends with the pre-token's end."""
        if len(text) <= self.leaf:
            return self._run(text, last)
        half = len(text) // 2
        left, right = self.tree(text[:half], False), self.tree(text[half:], last)
        k = 2
        while True:
            whole_l, whole_r = k >= len(left), k >= len(right)
            window = self._run("".join(s for _, s in left[-k:]) + "".join(s for _, s in right[:k]), last and whole_r)
            if (whole_l or window[0] == left[-k]) and (whole_r or window[-1] == right[k - 1]):
                return left[:-k] + window + right[k:]
            k *= 2

    # -- cells of a long word --------------------------------------------------------------------------------------

    def cells(self, text: str) -> Long:
        """What the library's pattern takes at once, with its ids; characters it drops are cells without ids."""
        made = self.tok.encode(text, add_special_tokens=False)
        out: list[tuple[str, bytes]] = []
        at, held, last = 0, [], None
        spans: list[list[int]] = []
        for i, word, (a, b) in zip(made.ids, made.word_ids, made.offsets):
            if word != last or word is None or not spans:
                spans.append([a, b])
                held.append([])
                last = word
            spans[-1][1] = max(b, spans[-1][1])
            held[-1].append(i)
        for (a, b), ids in zip(spans, held):
            if a < at:  # characters that don't part: one cell for all
                return Long([(text, np.array(made.ids, "<u4").tobytes())])
            if a > at:  # white space, or marks that the letter before them took in
                if out and not text[at:a].isspace():
                    out[-1] = (out[-1][0] + text[at:a], out[-1][1])
                else:
                    out.append((text[at:a], b""))
            out.append((text[a:b], np.array(ids, "<u4").tobytes()))
            at = b
        if at < len(text):
            if out and not text[at:].isspace():
                out[-1] = (out[-1][0] + text[at:], out[-1][1])
            else:
                out.append((text[at:], b""))
        return Long(out)

    def letters(self, left: bytes, right: bytes) -> bytes:
        """Ids of one run of ASCII letters from those of its two parts."""
        a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        k = 4
        while True:
            whole_l, whole_r = k >= len(a), k >= len(b)
            text = "".join([self.surface[i] for i in [*a[-k:].tolist(), *b[:k].tolist()]])
            self.joined_chars += len(text)
            window = np.array([t.id for t in (self.tok.model if whole_r else self.inner).tokenize(text)], "<u4")
            # the left end's last token was encoded as the end of a word, so it never proves anything
            if (whole_l or window[0] == a[-k]) and (whole_r or window[-1] == b[k - 1]):
                return np.concatenate([a[:-k], window, b[k:]]).astype("<u4").tobytes()
            k *= 2

    def join_long(self, left: Long, right: Long) -> Long:
        (a, a_ids), (b, b_ids) = left.cells[-1], right.cells[0]
        plain = lambda x: len(x) > 2 and x.isascii() and x.isalpha()
        reach = max(map(len, self.special), default=0)
        # a special string may reach over several cells
        near = "".join([t for t, _ in left.cells[-reach:]])[-reach:] + "".join([t for t, _ in right.cells[:reach]])[:reach]
        special = any(x in near for x in self.special)
        if len(a) + len(b) > self.leaf and plain(a) and plain(b) and not special:
            return Long(left.cells[:-1] + [(a + b, self.letters(a_ids, b_ids))] + right.cells[1:])
        k = reach + 1 if special else 2
        while True:
            whole_l, whole_r = k >= len(left.cells), k >= len(right.cells)
            text = "".join([t for t, _ in left.cells[-k:] + right.cells[:k]])
            self.joined_chars += len(text)
            window = self.cells(text)
            if (whole_l or window.cells[0] == left.cells[-k]) and (whole_r or window.cells[-1] == right.cells[k - 1]):
                return Long(left.cells[:-k] + window.cells + right.cells[k:])
            k *= 2

    # -- words -----------------------------------------------------------------------------------------------------

    def word(self, word: str) -> bytes:
        if len(word) <= self.leaf:
            return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        out: list[int] = []
        for part in self.split.split(word):
            if part in self.special:
                out.append(self.tok.token_to_id(part))
            elif part:
                shown = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                for token, _ in self.tok.pre_tokenizer.pre_tokenize_str(shown):
                    out += [i for i, _ in self.tree(token)]
        return np.array(out, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        known = self.known
        if len(known) > self.remember:
            known.clear()
            known[""] = b""
        new = [w for w in dict.fromkeys(words) if w not in known]
        parts = {}
        for w in new:
            m = WORD.fullmatch(w) if len(w) < 200 else None
            parts[w] = (m[1].lower(), m[2]) if m else (w.lower(),) if w.isascii() and w.isalpha() else (w,)
        need = [p for p in dict.fromkeys(p for x in parts.values() for p in x) if p not in known]
        short = [p for p in need if len(p) <= self.leaf]
        for p, e in zip(short, self.tok.encode_batch_fast(short, add_special_tokens=False)):
            known[p] = np.array(e.ids, "<u4").tobytes()
        for p in need:
            if len(p) > self.leaf:
                known[p] = self.word(p)
        for w, x in parts.items():
            if w not in known:
                known[w] = b"".join([known[p] for p in x])

    def _leaf(self, text: str) -> Piece:
        words = text.split(" ")
        first = self.cells(words[0]) if len(words[0]) > self.leaf // 2 else None
        last = first if len(words) == 1 else self.cells(words[-1]) if len(words[-1]) > self.leaf // 2 else None
        short = words[first is not None : len(words) - (last is not None and len(words) > 1)]
        try:
            ids = [self.known[w] for w in short]
        except KeyError:
            self.learn(short)
            ids = [self.known[w] for w in short]
            for w in short:
                if len(w) > 200:
                    self.known.pop(w, None)
        if first:
            ids.insert(0, first.ids())
        if last and len(words) > 1:
            ids.append(last.ids())
        return Piece(words, ids, first, last)

    def piece(self, text: str) -> Piece:
        """text: with single spaces for the white space that str.translate maps."""
        if len(text) <= self.leaf:
            return self._leaf(text)
        half = len(text) // 2
        return self.join(self.piece(text[:half]), self.piece(text[half:]))

    def join(self, left: Piece, right: Piece) -> Piece:
        seam = left.words[-1] + right.words[0]
        words = left.words[:-1] + [seam] + right.words[1:]
        if len(seam) > self.leaf:
            whole = self.join_long(left.last or self.cells(left.words[-1]), right.first or self.cells(right.words[0])) if left.words[-1] and right.words[0] else None
            middle = whole.ids() if whole else left.ids[-1] + right.ids[0]
            whole = whole or left.last or right.first
            return Piece(words, left.ids[:-1] + [middle] + right.ids[1:], whole if len(left.words) == 1 else left.first, whole if len(right.words) == 1 else right.last)
        first, last = (None if len(left.words) == 1 else left.first), (None if len(right.words) == 1 else right.last)
        k = 2
        while True:
            whole = k >= len(left.words) and k >= len(right.words)
            window = " ".join(left.words[-k:]) + " ".join(right.words[:k])
            head, tail = b"".join(left.ids[-k:-1]), b"".join(right.ids[1:k])
            # words further out than the seam's neighbours are not encoded again if they are long
            if len(window) > 4 * self.leaf:
                return Piece(words, left.ids[:-1] + [self.word(seam)] + right.ids[1:], first, last)
            self.joined_chars += len(window)
            again = np.array(self.tok.encode(window, add_special_tokens=False).ids, "<u4").tobytes()
            if len(again) >= len(head) + len(tail) and again.startswith(head) and again.endswith(tail):
                return Piece(words, left.ids[:-1] + [again[len(head) : len(again) - len(tail)]] + right.ids[1:], first, last)
            if whole:
                return Piece([window], [again])
            k *= 2

    def encode(self, text: str) -> bytes:
        return b"".join(self.piece(text.translate(SPACES)).ids)

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.table is None:
            return self.tok.decode(numbers, skip_special_tokens=False).encode()
        return b" ".join([self.table[i] for i in numbers])


_ENCODERS: dict = {}


def encoder(path: str, leaf_chars: int) -> TreeEncoder:
    """One per worker process, kept between tasks."""
    key = (path, leaf_chars)
    if key not in _ENCODERS:
        _ENCODERS[key] = TreeEncoder(path, leaf_chars)
    return _ENCODERS[key]


def _digests(enc: TreeEncoder, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()


def encode_documents(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS, segment_chars: int = SEGMENT_CHARS, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids themselves.

    A text of up to segment_chars is encoded where it is read. Longer ones are cut into segments that are dealt over
    all tasks, encoded there, and joined per text; what is gathered for a join is one text.
    """
    docs = documents(docs)
    result = RESULT + (", ids binary" if keep_ids else "")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * keep_ids)
    pieces = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("segment", pa.int32()), ("text", pa.string()), ("counts", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("ids", pa.binary())])

    def rows(doc_ids, all_ids, enc):
        out = [_digests(enc, ids) for ids in all_ids]
        return batch(arrow, [doc_ids, *([x[i] for x in out] for i in range(3)), *([all_ids] * keep_ids)])

    def short(batches):
        enc = encoder(path, leaf_chars)
        for b in slices(batches):
            yield rows(b.column("doc_id"), [enc.encode(t) for t in b.column("text").to_pylist()], enc)

    def cut(batches):
        for b in slices(batches, rows=1):
            (text,), (doc,), (uid,) = (b.column(c).to_pylist() for c in ("text", "doc_id", "uid"))
            for n, at in enumerate(range(0, len(text), segment_chars)):
                yield batch(pieces, [[uid], [doc], [n], [text[at : at + segment_chars].translate(SPACES)], [b""], [None], [None], [b""]])

    def segments(batches):
        enc = encoder(path, leaf_chars)
        for b in slices(batches, rows=16):
            got = [enc.piece(t) for t in b.column("text").to_pylist()]
            counts = [np.array([len(x) // 4 for x in p.ids], "<u4").tobytes() for p in got]
            yield batch(pieces, [b.column("uid"), b.column("doc_id"), b.column("segment"), [" ".join(p.words) for p in got], counts, [p.first and p.first.pack() for p in got], [p.last and p.last.pack() for p in got], [b"".join(p.ids) for p in got]])

    def joined(table: pa.Table) -> pa.Table:
        enc = encoder(path, leaf_chars)
        held: dict[int, list] = {}
        for r in table.to_pylist():
            ends = np.cumsum(np.frombuffer(r["counts"], "<u4")) * 4
            ids, start = [], 0
            for end in ends.tolist():
                ids.append(r["ids"][start:end])
                start = end
            words = r["text"].split(" ")
            cells = [Long.unpack(r[c], words[i], ids[i]) if r[c] is not None else None for c, i in (("first", 0), ("last", -1))]
            held.setdefault(r["segment"], []).append(Piece(words, ids, *cells))
        copies = len(held[0])  # rows that are repeated as a whole
        line = [held[n][0] for n in sorted(held)]
        while len(line) > 1:
            line = [enc.join(*line[i : i + 2]) if i + 1 < len(line) else line[i] for i in range(0, len(line), 2)]
        return pa.Table.from_batches([rows([table.column("doc_id")[0].as_py()] * copies, [b"".join(line[0].ids)] * copies, enc)])

    size = F.char_length("text")
    brief = docs.where(size <= segment_chars).mapInArrow(short, result)
    spec = "uid long, doc_id long, segment int, text string, counts binary, first binary, last binary, ids binary"
    long = docs.where(size > segment_chars).withColumn("uid", F.xxhash64("doc_id", "text")).mapInArrow(cut, spec)
    long = long.repartition(partitions(docs.sparkSession), "uid", "segment").mapInArrow(segments, spec)
    return brief.unionByName(long.groupBy("uid").applyInArrow(joined, result))
