"""Token ids of whole texts by a tokenizer file, with the ids of words kept from text to text.

A text is the concatenation of its words' ids where the tokenizer never joins across the cut: before a single space between
two other characters (byte-level files), or at any ASCII white space (files that drop white space). New words go to the
tokenizers library once; a worker keeps two generations of at most ``keep`` words, which decides memory and time but no ids.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import regex

KEEP = 550_000
LONGEST = 48
TOUCHING = re.compile(r"\s\s|^\s|\s$")
CONTROL = re.compile("[\x1c-\x1f]")
SPACE = re.compile(r"[\x20\x09-\x0d]+")
SINGLE = re.compile(r"(?<=\S) (?=\S)")
# The pre-token patterns of the two tokenizer files.
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Words(dict):
    """Word -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode, keep: int = KEEP):
        super().__init__()
        self.encode, self.keep, self.old = encode, keep, {}

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= LONGEST:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordTokenizer:
    def __init__(self, path: str, byte_level: bool, keep: int = KEEP):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.byte_level = byte_level
        self.model = self.tokenizer.model
        self.pattern = BYTE_LEVEL if byte_level else WORD_LEVEL
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {b: letters.pre_tokenize_str(chr(b))[0][0] for b in range(128)}  # the letter that stands for each byte
        for lead in range(0xC2, 0xD0):
            for tail in range(0x80, 0xC0):
                both = letters.pre_tokenize_str(bytes((lead, tail)).decode())[0][0]
                self.shown[lead], self.shown[tail] = both[0], both[1]
        self.as_letters = {k: v for k, v in self.shown.items()}
        self.pieces = Words(self.piece, keep)
        self.lead = " " if byte_level else ""
        self.words = Words(self.word, keep)

    def piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.shown[32])
        else:
            shown = piece.encode().decode("latin-1").translate(self.as_letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def word(self, word: str) -> bytes:
        """Most words are letters, perhaps with a mark behind: these are one or two pieces."""
        w = word if self.byte_level else word.lower()
        if w and len(w) <= LONGEST and (w.isascii() or max(w) < "ɐ"):
            if w.isalpha():
                return self.pieces[self.lead + w]
            if w[-1] in ".,;:" and w[:-1].isalpha():
                return self.pieces[self.lead + w[:-1]] + self.pieces[w[-1]]
        return self.plain(self.lead + word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        """Latin words go piece by piece; all others as they are."""
        if not text or max(text) >= "ɐ" or len(text) > 4096:
            return self.whole(text) if text else b""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text if self.byte_level else text.lower())))

    def encode(self, text: str | None) -> bytes:
        """Ids of the text; null and empty have none."""
        if not text:
            return b""
        if not self.byte_level:
            # str.split also parts at four controls that the file keeps
            parts = SPACE.split(text) if CONTROL.search(text) else text.split()
            return b"".join(map(self.words.__getitem__, parts))
        parts = SINGLE.split(text) if TOUCHING.search(text) else text.split(" ")
        return self.plain(parts[0]) + b"".join(map(self.words.__getitem__, parts[1:]))


@lru_cache(maxsize=4)
def word_tokenizer(path: str, byte_level: bool, keep: int = KEEP) -> WordTokenizer:
    """One for each worker and file; the path must be readable on every executor."""
    return WordTokenizer(path, byte_level, keep)
