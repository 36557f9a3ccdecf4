"""Whole-text encoding with a public tokenizer file, with each task's words remembered."""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

#: Characters that every Unicode version calls letters; the rest of what is split here is ASCII.
LETTERS = "A-Za-zÀ-ÖØ-öø-ž"
#: How the byte-level pre-tokenizer splits a text, for texts of those letters and ASCII.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
#: Bytes that an encoder remembers of pieces and of words, about; later ones are encoded each time.
PIECE_BYTES, WORD_BYTES = 160 << 20, 24 << 20

#: What is not known here to be split alike by the library: such pieces go to it whole.
_UNKNOWN = re.compile(rf"[^\t\n\r -~{LETTERS}]")
_UNUSUAL = re.compile(rf"[^\n -~{LETTERS}]")
_SPACE_BEFORE_WORD = re.compile(rf" (?=[!-~{LETTERS}])")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next past 255."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class _Memo(dict):
    """Remembers the first results up to about ``most`` bytes. Frequent keys are among them, and nothing is ever moved about."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.left = make, most

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        cost = 220 + 2 * len(key) + len(found)
        if cost <= self.left:
            self.left -= cost
            self[key] = found
        return found


class Encoder:
    """encode(text) -> the ids as little-endian unsigned 32-bit bytes, without special tokens added.

    A byte-level BPE encodes each pre-token by itself, and one always starts at a space that a letter, digit or sign
    follows, so pieces between such places are encoded once and remembered. Pieces of known characters are split here
    and the library's model encodes each pre-token; pieces with any other character go to the library whole, since
    what is a letter or white space beyond ASCII depends on its Unicode version. So do texts that hold one of the
    file's added tokens, and all texts where the tokenizer is of another make.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        before = made.get("pre_tokenizer") or {}
        self.by_word = (
            made.get("normalizer") is None and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
            and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        )
        self.added = [t["content"] for t in made.get("added_tokens", [])]
        self.model, self.split, self.letters = self.tokenizer.model, re.compile(PATTERN, re.A), dict(enumerate(_byte_letters()))
        #: Pre-tokens that start with a space, and pieces of several of them, both without that space; pieces that start with a line's end.
        self.pieces = _Memo(lambda piece: self._piece(piece if piece[:1] == "\n" else " " + piece), PIECE_BYTES)
        self.words = _Memo(self._word, WORD_BYTES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        mapped = (word if word.isascii() else word.encode("utf-8").decode("latin-1")).translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece[1:].isalpha() and piece[0] == " " and piece.isascii():
            return self._word(piece)  # one pre-token
        if _UNKNOWN.search(piece):
            return self._whole(piece)
        parts = self.split.findall(piece)
        if len(parts) == 1:
            return self._word(piece)
        return b"".join([self.pieces[part[1:]] if part[0] == " " and part[1:2] > " " else self.words[part] for part in parts])

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.by_word or any(t in text for t in self.added):
            return self._whole(text)
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or _UNUSUAL.search(text):
            first, *rest = _SPACE_BEFORE_WORD.split(text)
            return self._piece(first) + b"".join([self._piece(" " + p) if p[:1] == "\n" else self.pieces[p] for p in rest])
        # every space and line's end stands by itself, so a pre-token starts at each
        first, *rest = text.replace("\n", " \n").split(" ")
        return self._piece(first) + b"".join(map(self.pieces.__getitem__, rest))


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
