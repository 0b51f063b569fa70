"""A byte-level BPE vocabulary from a rank file, and texts cut where no token can reach across."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Mapping
from functools import lru_cache

import tiktoken

#: Texts longer than this are not remembered; so many are remembered by a task at most.
LONGEST_KEPT, MOST_KEPT = 48, 200_000

_space_after_space = re.compile(r"\s ")
_safe_space = re.compile(r"(?<=\S) ")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 token and rank a line), without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The token-byte table: the bytes of every id."""
    with open(path, "rb") as lines:
        return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}


def space_led(text: str) -> list[str]:
    """The text cut before every space that follows something else than white space; all parts but
    the first have lost that space.  The pattern's matches never cross such a place.  A space that
    begins the text is no such place: behind another text or space it may be one token with that."""
    if text.startswith(" ") or _space_after_space.search(text):
        return _safe_space.split(text)
    return text.split(" ")


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file, with their ids."""
    with open(path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


class PartIds(dict):
    """Ids, as little-endian 32-bit integers, of a part that a space leads; remembered.  Special
    tokens cut a text before its parts are made."""

    def __init__(self, path: str, pattern: str, special_tokens: Mapping[str, int] | None = None):
        super().__init__()
        self.encode = encoding(path, pattern).encode_ordinary
        self.special = {t: array("I", [i]).tobytes() for t, i in (special_tokens or {}).items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self.encode(" " + part)).tobytes()
        if len(part) <= LONGEST_KEPT:
            self[part] = ids
        return ids

    def of_text(self, text: str | None) -> bytes:
        """The ids of a whole text; none for null."""
        if not text:
            return b""
        if self.cut and self.cut.search(text):
            return b"".join(self.special[t] if t in self.special else self._of_plain(t)
                            for t in self.cut.split(text) if t)
        return self._of_plain(text)

    def _of_plain(self, text: str) -> bytes:
        if len(self) > MOST_KEPT:
            self.clear()
        first, *rest = space_led(text)
        ids = [array("I", self.encode(first)).tobytes()]
        ids.extend(map(self.__getitem__, rest))
        return b"".join(ids)
