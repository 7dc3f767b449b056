"""Pre-tokens and public vocabularies."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from functools import lru_cache
from itertools import islice

import regex

LONG = 1 << 20  # characters: longer texts are cut into pre-tokens bit by bit


@lru_cache(4)
def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def pre_tokens(text: str, pattern: str) -> Iterator[list[str]]:
    """All matches in order, in lists that stay small however long the text is."""
    if len(text) <= LONG:
        yield compiled(pattern).findall(text)
        return
    found = compiled(pattern).finditer(text)
    while some := [m.group() for m in islice(found, 1 << 16)]:
        yield some


#: Characters: longer pre-tokens (encoded data, code without spaces) are not kept, so that entries bound a cache's bytes.
KEPT = 256


class Recent:
    """A bounded cache of two generations: what wasn't asked for while the younger one filled up goes."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def missing(self, keys: set[str]) -> set[str]:
        """Those of the keys that hold has to make, if it is called with them next."""
        if len(self.young) + len(keys) > self.size:
            self.old, self.young = self.young, {}
        return keys.difference(self.young).difference(self.old)

    def hold(self, keys: Iterable[str], make: Callable[[str], Any]) -> dict[str, Any]:
        """A dictionary with all keys: the younger generation, or one of these keys alone if some are too long to keep."""
        keys = set(keys)
        if len(self.young) + len(keys) > self.size:
            self.old, self.young = self.young, {}
        young = self.young
        passing: dict[str, Any] = {}
        for k in keys:
            if k not in young:
                value = self.old.get(k)
                if value is None:
                    value = make(k)
                if len(k) > KEPT:
                    passing[k] = value
                else:
                    young[k] = value
        return {k: passing[k] if k in passing else young[k] for k in keys} if passing else young


@lru_cache(4)
def ranks_of(file: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, file.splitlines()))}


def read_vocabulary(path: str) -> bytes:
    """The file, read on the driver; its size doesn't depend on the data, so it may be broadcast."""
    with open(path, "rb") as f:
        return f.read()
