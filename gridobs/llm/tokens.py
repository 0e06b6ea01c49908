"""Byte-level BPE token ids of whole texts.

The ids are those of the public tokenizer file by the tokenizers library with ``add_special_tokens=False``: none is added, and the string of a
special token in a text is that token. tiktoken runs the same vocabulary and merge ranks about four times as fast, and a test compares the two; its pattern engine overflows its stack on blank runs
of some hundred thousand characters, so texts with a run of ``LONG_BLANK`` or more are left to tokenizers. The ids are the same either way.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import public_tokenizers
import tiktoken
import tokenizers

LONG_BLANK = 50_000
_LONG_BLANK = re.compile(rf"\s{{{LONG_BLANK}}}")
DEFAULT = "byte_bpe_50k.json"


def _byte_of() -> dict[str, int]:
    """The letter that byte-level BPE files use for each byte: itself if printable, else the next letter from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE file of the tokenizers library; made once in each Python worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=4)
def _plain(path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(path)


def encode(text: str | None, path: str) -> list[int]:
    if not text:
        return []
    if len(text) >= LONG_BLANK and _LONG_BLANK.search(text):
        return _plain(path).encode(text, add_special_tokens=False).ids
    bpe = byte_bpe(path)
    return bpe.encode(text, allowed_special="all") if any(s in text for s in bpe.special_tokens_set) else bpe.encode_ordinary(text)
