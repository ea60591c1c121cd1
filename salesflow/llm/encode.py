"""Whole-text encoding with the tokenizers library, each distinct word once per Python worker.

A vocabulary whose normalizer and pre-tokenizer are one of the two forms below never merges across words, so a text of
plain Latin characters is cut into words by its pattern, each distinct word goes through the library's byte
map and BPE model once, and ids are joined. Any other text (other characters, or an added token's string
in it), and any text under a vocabulary of another form, goes whole to the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Words that a worker remembers (about 200 MB); later ones are encoded again each time.
MAX_WORDS = 900_000

_ENCODERS: dict[tuple[str, int], "PieceEncoder"] = {}
#: Characters whose classes, lower case and NFC form are alike in Python and in the library.
_PLAIN = re.compile("[\t\n\x20-\x7e\xa1-\xff]*").fullmatch
#: The word patterns that the two vocabulary files define, with the letters (L) and
#: numbers (N) among plain characters written out.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_BYTE_WORDS = rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"
_LOWER_WORDS = rf"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^\s{_L}{_N}]+"
#: The (normalizer, pre-tokenizer) of a vocabulary file for which each pattern stands.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_BYTE_FORM = (None, _BYTE_LEVEL | {"use_regex": True})
_LOWER_FORM = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        _BYTE_LEVEL | {"use_regex": False},
    ]},
)


class Words(dict):
    """Ids of words; a missing word is encoded, and remembered while there is room."""

    def __init__(self, model, byte_map: dict[int, str], most: int):
        super().__init__()
        self.model, self.byte_map, self.most = model, byte_map, most

    def __missing__(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.byte_map)
        ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        if len(self) < self.most:
            self[word] = ids
        return ids


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as the library does without special tokens around a text."""

    def __init__(self, path: str, most: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        form = (told.get("normalizer"), told.get("pre_tokenizer"))
        plain = told.get("truncation") is None and told.get("padding") is None and told["model"].get("type") == "BPE" and not told["model"].get("dropout")
        self.lower = form == _LOWER_FORM
        words = _LOWER_WORDS if self.lower else _BYTE_WORDS if form == _BYTE_FORM else None
        self.cut = re.compile(words).findall if words and plain else None
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added), re.IGNORECASE).search if added else lambda text: None
        self.largest_id = max(self.library.get_vocab().values(), default=0)
        # the byte map of both vocabularies: visible Latin-1 stays, the rest follows from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.words = Words(self.library.model, {b: chr(256 + i) for i, b in enumerate(hidden)}, most)

    def whole(self, text: str) -> bytes:
        """Ids of one text by the library alone."""
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, without an end id."""
        if not self.cut or not _PLAIN(text) or self.added(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, self.cut(text.lower() if self.lower else text)))


def encoder(path: str, most: int = MAX_WORDS) -> PieceEncoder:
    """The worker's encoder for a vocabulary file, which remembers `most` words; it lives as long as the worker, so also while
    the worker runs tasks of other steps."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = PieceEncoder(path, most)
    return _ENCODERS[path, most]
