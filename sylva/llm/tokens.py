"""Whole texts to token ids by a given tokenizer file.

A text is cut at ASCII white space and each distinct piece is encoded once a worker. That equals encoding the whole
text for tokenizers whose normaliser and pre-tokeniser never join across white space, as the word BPE's.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Distinct pieces kept by a worker; others are encoded again.
KEPT_PIECES = 700_000
#: With this normaliser a Latin word of precomposed letters is only lower-cased.
WORD_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the others follow from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder(dict):
    """piece bytes -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.marks: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        #: A piece of Latin letters and at most one mark after them needs neither normaliser nor pre-tokeniser but lower case.
        self.latin = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+)([.,;:!?]?)")
        self.by_word = json.loads(self.tokenizer.to_str())["normalizer"] == WORD_NORMALISER

    def whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def mark(self, text: str) -> bytes:
        if text not in self.marks:
            self.marks[text] = self.whole(text)
        return self.marks[text]

    def __missing__(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace")
        found = self.by_word and self.latin.fullmatch(text)
        if found:
            word, mark = found.groups()
            plain = word.lower()
            if mark or plain != word:
                ids = self[plain.encode()] + (self.mark(mark) if mark else b"")
            else:
                coded = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
                ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(coded)])
        else:
            ids = self.whole(text)
        if len(self) < KEPT_PIECES and len(piece) < 200:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
