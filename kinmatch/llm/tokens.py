"""Exact, memoised use of a word-splitting tokenizer of the tokenizers library.

The tokenizer's pre-tokenizer never lets a piece cross white space, so a text's ids are
the ids of its words one after another, and a word of Latin-1 letters followed by ASCII marks is
the letters' ids, then the marks'. Letters beyond Latin-1 may turn into a letter and a combining
mark when they are normalised, and such a mark belongs to the marks behind it; words that hold one are asked
for as a whole. Each worker keeps the ids of the words it has met as
little-endian bytes and asks the library only for new ones; both caches are emptied when
full, so memory stays bounded on any vocabulary.
"""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers

TOKENIZER_FILE = public_tokenizers.path("word_bpe_49k.json")
#: The id that ends a document.
END_ID = 1
END_BYTES = END_ID.to_bytes(4, "little")
#: Words that a worker remembers, in each of two generations.
CACHE_WORDS = 200_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # str.split() parts words there, the tokenizer does not
_SPACE = re.compile(r"[ \n\t\r]+")
_TAIL = re.compile(r"[!-/:-@\[-`{-~]+\Z")
MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_loaded: dict[str, WordEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.older: dict[str, bytes] = {}

    def _ask(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, core: str) -> bytes:
        """Ids of one piece of lower-case Latin-1 letters, which normalising leaves alone."""
        piece = core if core.isascii() else "".join([BYTE_LETTERS[b] for b in core.encode()])
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(piece)])

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            if max(word) >= "\u0100":
                got = self._ask(word)
            elif word.isalpha():
                got = self._letters(word) if word.islower() else self._ask(word)
            elif word[-1] in MARKS and word[:-1].isalpha():
                got = self[word[:-1]] + self[word[-1]]
            else:
                tail = _TAIL.search(word)
                if tail and word[: tail.start()].isalpha():
                    got = self[word[: tail.start()]] + self[tail.group()]
                else:
                    got = self._ask(word)
        self[word] = got
        return got

    def forget(self) -> None:
        """Give up the words met; a worker outlives its tasks."""
        self.clear()
        self.older.clear()

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, then END_ID."""
        if not text:
            return END_BYTES
        if len(self) > CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        lower = text.lower()
        if any(s in lower for s in self.special):
            return self._ask(text) + END_BYTES
        try:
            text.encode("latin-1")
            text = lower  # one character at a time in Latin-1, as the tokenizer does
        except UnicodeEncodeError:
            pass
        words = [w for w in _SPACE.split(text) if w] if _ODD_SPACE.search(text) else text.split()
        return b"".join([self[w] for w in words]) + END_BYTES


def encoder(path: str = TOKENIZER_FILE) -> WordEncoder:
    """This process's encoder for a tokenizer file."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
