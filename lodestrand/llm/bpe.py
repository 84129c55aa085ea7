"""Byte-level BPE ids of whole texts, with a cache of space-delimited units.

The pre-tokenizer's pattern never spans a place where white space follows other characters, so a text may be cut at
every single space between two non-blank characters without changing its ids.  Units repeat far more than texts do.
"""

from __future__ import annotations

import base64
import re
from array import array

import tiktoken

#: Fixed value: the pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANK_BEFORE_SPACE = re.compile(r"\s\x20")
CACHE_UNITS = 300_000
LONG_TEXT = 4_000_000


class UnitEncoder:
    """``encode`` gives the ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, ranks: bytes, tokenizer_json: str, special: tuple[str, ...] = ("<|endoftext|>",)):
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.bpe = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.json, self.full, self.special = tokenizer_json, None, special
        self.units: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.with_special(text)
        if text.endswith(" ") or BLANK_BEFORE_SPACE.search(text):
            return self.plain(text)
        head, *units = text.split(" ")
        known = self.units
        if len(known) > CACHE_UNITS:
            known.clear()
        if len(text) > LONG_TEXT:  # its units are not remembered
            known = {}
        new = set(units).difference(known)
        for u in new:
            known[u] = self.plain(" " + u)
        return self.plain(head) + b"".join([known[u] for u in units])

    def with_special(self, text: str) -> bytes:
        """The library reads the strings of special tokens as those tokens."""
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_str(self.json)
        return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()
