"""Token ids of a byte-level BPE given as a tokenizer JSON file.

The vocabulary and its merge order are read from the JSON; encoding uses the faster library, whose ids are the same for the same vocabulary (tested).
Texts that it refuses (runs of about a million white-space characters) are encoded by `tokenizers`. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import functools
import json

import numpy as np

#: Fixed value: the pattern that cuts text before merging, for vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 2
DEFAULT_FILE = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def library(path: str):
    """The file as the slower library reads it, with strings of special tokens as ordinary text."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> array of ids (uint32)."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    coder = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        try:
            return coder.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the pattern's stack is full
            return np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def document_ids(text: str | None, path: str, end: int = END) -> np.ndarray:
    """A document's ids, with its end; a null text is empty."""
    ids = encoder(path)(text or "")
    return np.append(ids, np.uint32(end)).astype("<u4")
