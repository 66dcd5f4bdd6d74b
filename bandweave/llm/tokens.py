"""Vocabularies of public tokenizers, and ids of whole texts by the library that reads them."""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Callable

import numpy as np


def rank_file(path: str) -> dict[bytes, int]:
    """Ranks by token of a `.tiktoken` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_letters() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def json_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a byte-level BPE `.json` file whose ids follow its order of merges; others are refused."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    special = {x["content"] for x in made.get("added_tokens", ())}
    letters = byte_letters()
    ids = {bytes(letters[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
    order = [ids["".join(m if isinstance(m, list) else m.split(" ")).translate(_to_latin()).encode("latin-1")] for m in made["model"]["merges"]]
    if sorted(order) != order:
        raise ValueError("ids of this vocabulary don't follow its merges")
    return ids


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens of a `.json` file; those that take in white space or need whole words are refused."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as file:
        found = json.load(file).get("added_tokens", ())
    if any(x.get(k) for x in found for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens of this vocabulary aren't plain strings")
    return {x["content"]: x["id"] for x in found}


@functools.cache
def _to_latin() -> dict[int, str]:
    return {ord(c): chr(b) for c, b in byte_letters().items()}


@functools.cache
def library_encoder(path: str, added: bool = False) -> Callable[[str], np.ndarray]:
    """Encoder of whole texts for the byte-level vocabulary in a `.json` or `.tiktoken` file.

    With `added`, the added tokens of a `.json` file are found in texts, as the tokenizers library does by default; otherwise
    no string is special.
    """
    import public_tokenizers
    import tiktoken

    ranks = json_ranks(path) if path.endswith(".json") else rank_file(path)
    made = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path) if added else {})
    if added:
        return lambda text: np.array(made.encode(text, allowed_special="all"), dtype="<u4")
    return lambda text: np.array(made.encode_ordinary(text), dtype="<u4")


def piece_finder() -> Callable[[str], list[str]]:
    """Pieces of a text by the public pattern, with white space as Unicode defines it."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
