"""Encoding of whole texts with a public tokenizer, one encoder call per distinct piece of a word.

Both vocabularies split a text before every run of ASCII white space, and never merge across such a
place, so the ids of a text are the ids of its words in order; a bounded cache of words replaces most of the
encoder's work. Words of letters known to be plain are split further, by the pattern of the vocabulary's own
pre-tokenizer, and their pieces go to its merge model; all other words are encoded whole. Texts with other white space, or with the
string of a special token, for which neither need hold, are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import CACHES, only

#: White space on which this module splits: it is such for Python, for the pre-tokenizers and for Unicode.
_SPACE = " \t\n\r\x0b\x0c"
#: Unicode white space beyond it; texts that hold any are encoded whole.
_OTHER_SPACE = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
_SPACED_WORD = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_WORD = re.compile(f"[^{_SPACE}]+")
#: Words of these characters are normalised by lower case alone: ASCII and the letters of Latin-1.
_PLAIN = re.compile(f"[{_SPACE}!-~À-ÖØ-öø-ÿ]+")
# The patterns by which the pre-tokenizers of the two vocabularies split, for plain words: these have no other letters and numbers.
_L, _N = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
_SPLITS = {
    True: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"),
    False: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"),
}
#: Longer words are not held in the caches, so that these are bounded in characters too.
LONGEST = 64

_encoders: dict[str, "WordEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()


class _Cache(dict):
    """Ids of strings in two generations: what is used again moves to the younger one, the older one is dropped when that is full.

    With ``marks``, a string enters only when it, or another of the same mark, has been asked for before: most words of a corpus occur once.
    """

    def __init__(self, make, keep: int, marks: int = 0):
        self.make, self.keep, self.older = make, keep, {}
        self.marks, self.marked = bytearray(marks), 0

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
            if self.marks and not self.marks[at := hash(key) % len(self.marks)]:
                self.marks[at] = 1
                self.marked += 1
                return ids
        if len(key) <= LONGEST:
            self[key] = ids
        return ids

    def age(self) -> None:
        if len(self) > self.keep:
            self.older.clear()
            self.older.update(self)
            self.clear()
        if self.marked > len(self.marks) // 2:
            self.marks, self.marked = bytearray(len(self.marks)), 0


def encoder(name: str) -> "WordEncoder":
    """The process's encoder of the vocabulary file ``name`` (a path, or a name known to the public_tokenizers module)."""
    if name not in _encoders:
        _encoders[name] = WordEncoder(name)
        CACHES.extend(_encoders[name].caches)
    e = _encoders[name]
    only(*e.caches)
    return e


class WordEncoder:
    """Ids of texts as numpy arrays; ``keep`` bounds the words, and the pieces, held in each of the two generations of their cache."""

    def __init__(self, name: str, keep: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = name
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        normalizer = self.tokenizer.normalizer
        self.dropped_space = normalizer is not None  # then white space leaves no ids and case is dropped, else it joins the next word
        self.units = (_WORD if self.dropped_space else _SPACED_WORD).findall
        self.split = _SPLITS[self.dropped_space].findall
        self.words, self.pieces = _Cache(self._word, keep, 1 << 22), _Cache(self._piece, keep)
        self.caches = [self.words, self.words.older, self.pieces, self.pieces.older]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[-1] > " ":
            letters = piece if piece[0] > " " else _LETTERS[32] + piece[1:]
        else:
            letters = "".join([_LETTERS[b] for b in piece.encode()])
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if not (word.isascii() and word.isprintable() or _PLAIN.fullmatch(word)):
            return self._whole(word)
        if self.dropped_space:
            word = word.lower()
        letters = word[1:] if word[0] == " " else word
        if letters.isalpha():  # then the pattern leaves it whole
            return self.pieces[word]
        if letters[:-1].isalpha() and not letters[-1].isalnum():  # letters and one sign
            return self.pieces[word[:-1]] + self.pieces[word[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split(word)))

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts whose white space leaves none: each distinct word is looked up once."""
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        found = list(map(self.words.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        word = coded.indices.to_numpy()
        n, first = sizes[word], (np.cumsum(sizes) - sizes)[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[parts.offsets.to_numpy()]
        return [ids[i:j] for i, j in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit integers; a null text has none."""
        self.words.age()
        self.pieces.age()
        get, units = self.words.__getitem__, self.units
        out: list = []
        plain: list[int] = []
        for t in texts:
            if not t:
                raw = b""
            elif not t.isascii() and _OTHER_SPACE.search(t) or any(s in t for s in self.special):
                raw = self._whole(t)
            elif self.dropped_space:
                raw = b""
                plain.append(len(out))
            else:
                raw = b"".join(map(get, units(t)))
            out.append(np.frombuffer(raw, dtype="<u4"))
        if plain:
            for i, ids in zip(plain, self._by_words([texts[i] for i in plain])):
                out[i] = ids
        return out
