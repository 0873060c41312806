"""Exact byte-level BPE encoding that lets the library encode each distinct piece once.

The tokenizer's own splitting rule puts a boundary before every single space (or
line feed) that stands between two characters that are not white space: no token
pattern has white space inside, and a lone space belongs to what follows it.  So a
text's ids are the ids of its pieces in order, and a piece's ids don't depend on
its neighbours.  Texts with other white space are cut only where that proof
holds; texts with special strings go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

_WHITE = re.compile(r"[\s\x1c-\x1f\x85\xa0]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A run of letters, then perhaps signs (no apostrophe): two pre-tokens that the splitting rule always parts.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_path(name_or_path: str) -> str:
    """A vocabulary's file: a path as it is, or a bare name among the public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class _Pieces(dict):
    """Ids of pieces as bytes, asked of the library when first seen.

    A key is a piece without its leading space; \\x02 before it marks a text's
    first piece, which has no space, and one that begins with a line feed has
    none either.
    """

    def __init__(self, whole, model):
        self.whole, self.tokenize = whole, model.tokenize
        self.letters = _byte_letters()
        self.marks = {"": b"", "\n": whole("\n").tobytes()}

    def __missing__(self, key: str) -> bytes:
        first = key[0]
        m = _SIMPLE.fullmatch(key, 1 if first in "\x02\n" else 0)
        if m:
            core = m[1] if m[1].isascii() else "".join([self.letters[b] for b in m[1].encode()])
            if first not in "\x02\n":
                core = self.letters[32] + core
            if m[2] not in self.marks:
                self.marks[m[2]] = self.whole(m[2]).tobytes()
            ids = array("I", [t.id for t in self.tokenize(core)]).tobytes() + self.marks[m[2]]
            if first == "\n":
                ids = self.marks["\n"] + ids
        else:
            ids = self.whole(key[1:] if first == "\x02" else key if first == "\n" else " " + key).tobytes()
        self[key] = ids
        return ids


class Encoder:
    """encode_many(texts) equals the library's encode(text, add_special_tokens=False).ids of each."""

    def __init__(self, path: str, max_pieces: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        #: The special strings as they are cut out of a text before all else, the longest at a place; None if any takes white space or only whole words with it.
        plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens", []))
        self.special_rule = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if plain and self.special else None
        #: Pieces are cut only under the rule for which the proof holds.
        self.by_piece = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")
        self.max_pieces = max_pieces
        self.pieces = _Pieces(self.whole, self.library.model)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _keys(self, text: str) -> tuple[list[str] | None, bool]:
        """The pieces' keys, and whether all may be kept; \\x03 marks a piece with white space inside. None: the text isn't cut."""
        if not self.by_piece or any(s in text for s in self.special) or "\x02" in text or "\x03" in text:
            return None, False
        flat = text.replace("\n", " ")
        if flat.isprintable() and "  " not in flat and text[:1].strip() and text[-1:].strip():  # all white space is lone spaces and line feeds, none at the ends
            keys = text.replace("\n", " \n").split(" ")
            keys[0] = "\x02" + keys[0]
            return keys, True
        parts = _CUT.split(text) if text else []
        return [f"\x03{' ' if i else ''}{p}" if _WHITE.search(p) or not p else p if i else "\x02" + p for i, p in enumerate(parts)], False

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        keys, kept = self._keys(text)
        if keys is None:
            return self.whole(text).tobytes()
        get = self.pieces.__getitem__
        if not kept:
            return b"".join([self.whole(k[1:]).tobytes() if k[0] == "\x03" else get(k) for k in keys])
        return b"".join(map(get, keys))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > self.max_pieces:
            self.pieces.clear()
            self.pieces.marks = {k: v for k, v in self.pieces.marks.items() if len(k) < 2}
        return [self.encode(t) for t in texts]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(tokenizer_path(path))
