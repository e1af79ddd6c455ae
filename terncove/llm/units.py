"""Cutting texts where every byte-level BPE tokenisation of this family has a token boundary.

A position between a character that is no white space and one that is white space always ends a pre-token: no
alternative of the splitting pattern lets white space follow anything else. Texts cut there tokenise piece by piece.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable

# The Unicode property White_Space.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
SYNC = re.compile(f"(?<=[^{WHITE_SPACE}])(?=[{WHITE_SPACE}])")

#: Long runs without a boundary would be poor cache keys; they are encoded directly.
LONGEST_KEY = 64


class Memo(dict):
    """A dictionary of bounded size: when it is full the older half (two generations) is forgotten."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit // 2, {}

    def recall(self, key):
        """The value of ``key`` if the older generation has it; it moves to the newer one."""
        if (value := self.old.get(key)) is not None:
            self[key] = value
        return value

    def lacking(self, keys: Iterable) -> list:
        """Those of ``keys`` that neither generation has; what the older one has moves to the newer one."""
        unknown, old = [k for k in keys if k not in self], self.old
        known = [k for k in unknown if k in old]
        self.update(zip(known, map(old.__getitem__, known), strict=True))
        return [k for k in unknown if k not in old] if known else unknown

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


_HELD: dict[str, object] = {}


def held(key: str, make):
    """A worker's lasting state under ``key``. A worker serves many stages; it keeps the state of one operator at a time."""
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Drop the state that earlier stages left in this worker."""
    if _HELD:
        _HELD.clear()
        gc.collect()
