"""Encoding of whole texts with a public tokenizer file, inside Arrow tasks.

A byte-level BPE encodes each pre-token on its own.  A task finds the pre-tokens of many
texts at once by character classes, tells them apart by 64-bit hashes, and has the library
encode each distinct one once; the ids kept for a hash are gathered for every occurrence.
(Two different pre-tokens among a task's few million share a hash with a chance of 1e-6.)
Texts with characters outside the classes, or with an English contraction, which the
vocabulary's pattern cuts in its own way, are encoded whole by the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: The file's name among the public tokenizers; a path is taken as it is.
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Distinct pre-tokens kept by a task; beyond it starts anew (bounds its memory, at about
#: 40 bytes each).
KEPT_WORDS = 2_000_000
#: Characters of text encoded in one go.
SLICE_CHARS = 1_000_000

# Characters that the classes below tell apart as the vocabulary's pattern does.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u024f\u2013\u2014\u2018\u2019\u201c\u201d\u2026]")
_CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")
_SPACE, _LETTER, _DIGIT, _SIGN, _BOUND = range(5)
_CLASS = np.full(0x2030, _SIGN, dtype=np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[0] = _BOUND
_CLASS[48:58] = _DIGIT
_CLASS[[c for c in range(0x250) if chr(c).isalpha()]] = _LETTER

_BASE = 0x9E3779B97F4A7C1B
_VALUE = np.random.RandomState(77).randint(0, 2**63, len(_CLASS), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Encoder:
    """``encode`` gives the library's ids (no special tokens added) of each text."""

    def __init__(self, name: str = DEFAULT_TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)     # what is kept here takes its place
        self.newline = self._whole(["\n"])[0]
        self.by_words = (len(self.newline) == 1 and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
                         and self.tokenizer.normalizer is None)
        self.up = self.down = np.ones(1, dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        """Kept words: hashes in ascending order, where their ids begin, and how many."""
        self.hashes = np.empty(0, dtype=np.uint64)
        self.begin = self.count = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype="<u4")

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of pre-tokens.  Words of letters go many to a text, parted by line feeds, whose
        own id then marks the bounds; the others go one by one."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha() or w[0] == " " and w[1:].isalpha()]
        alone = sorted(set(range(len(words))).difference(plain))
        for at in range(0, len(plain), 2000):
            part = plain[at:at + 2000]
            found = self._whole(["\n".join([words[i] for i in part])])[0]
            cuts = np.flatnonzero(found == self.newline[0])
            if len(cuts) != len(part) - 1:
                alone += part
                continue
            for i, a, b in zip(part, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(found)]):
                out[i] = found[a:b]
        for i, ids in zip(alone, self._whole([words[i] for i in alone])):
            out[i] = ids
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Keep the ids of words under their (ascending, new) hashes."""
        ids = self._words(words)
        count = np.array([len(x) for x in ids], dtype=np.int64)
        at = np.searchsorted(self.hashes, hashes)
        self.begin = np.insert(self.begin, at, len(self.ids) + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.ids = np.concatenate([self.ids, *ids])

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\0" + "\0".join(texts) + "\0"
        chars = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        n = len(chars)
        if n > len(self.up):
            size = 1 << n.bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)
        kind = _CLASS[chars]
        space = kind == _SPACE
        start = np.empty(n, dtype=bool)
        start[0] = True
        # after a character that is no white space, a new class; after white space, unless a
        # single space that goes with what follows
        start[1:] = np.where(space[:-1], ~space[1:] & (chars[:-1] != 32), kind[1:] != kind[:-1])
        start[kind == _BOUND] = True
        # the last of several white spaces before something else is on its own, or goes with it
        start[1:-1] |= space[1:-1] & space[:-2] & ~space[2:] & (kind[2:] != _BOUND)
        at = np.flatnonzero(start)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[chars] * self.up[:n], out=sums[1:])
        end = np.append(at[1:], n)
        hashes = (sums[end] - sums[at]) * self.down[at]
        known, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, known)
        new = np.ones(len(known), dtype=bool)
        inside = place < len(self.hashes)
        new[inside] = self.hashes[place[inside]] != known[inside]
        if new.any():
            spans = at[first[new]], end[first[new]]
            self._learn(known[new], [joined[i:j] for i, j in zip(*(x.tolist() for x in spans))])
            place = np.searchsorted(self.hashes, known)
        begin, count = self.begin[place][which], self.count[place][which]
        bounds = kind[at] == _BOUND
        count[bounds] = 0
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(begin - (ends - count), count) + np.arange(ends[-1])]
        cuts = ends[bounds]
        return [ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        out: list = [np.empty(0, dtype="<u4")] * len(texts)
        if len(self.hashes) > KEPT_WORDS:
            self._forget()
        plain = [bool(x) and self.by_words and "<|" not in x and not ("'" in x and _CONTRACTION.search(x)) and not _OTHER.search(x)
                 for x in texts]
        whole = [i for i, x in enumerate(texts) if x and not plain[i]]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        parts = [i for i, yes in enumerate(plain) if yes]
        if parts:
            for i, ids in zip(parts, self._by_words([texts[i] for i in parts])):
                out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The task process's encoder (a process serves many tasks)."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def encoded(batches: Iterable, name: str, text: str = "text") -> Iterator[tuple]:
    """Slices of Arrow batches with the ids of each row's text: (slice, ids)."""
    enc = encoder(name)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        begin, chars, part = 0, 0, []
        for row, scalar in enumerate(texts):
            value = scalar.as_py()
            part.append(value)
            chars += len(value) if value else 0
            if chars >= SLICE_CHARS or row + 1 == batch.num_rows:
                yield batch.slice(begin, len(part)), enc.encode(part)
                begin, chars, part = row + 1, 0, []
