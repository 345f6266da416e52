"""Token ids of a byte-level BPE vocabulary file.

The vocabulary and its ranks come from the tokenizer file itself; merging runs in a faster library.
tests/llm compares the ids with those of the tokenizer file's own library.
"""

from __future__ import annotations

import json
from functools import lru_cache

#: Fixed value: the pre-tokenisation pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable ones for themselves, the rest from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoding(path: str):
    """An encoder for the tokenizer file at ``path``; strings of its special tokens give their ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {
        bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special
    }
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(path: str, text: str) -> list[int]:
    return encoding(path).encode(text, allowed_special="all")
