"""Range bounds and the prefix-to-range rewrite (no Spark in here)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Included:
    at: Any


@dataclass(frozen=True)
class Excluded:
    at: Any


class _Unbounded:
    def __repr__(self) -> str:
        return "Unbounded"


Unbounded = _Unbounded()
Bound = Included | Excluded | _Unbounded


def prefix_range(prefix: bytes) -> tuple[Bound, Bound]:
    """The half-open key range of a byte prefix.

    The end is the least key above everything with the prefix: trailing FF bytes go and
    the last byte left is raised by one.  A prefix of FF bytes alone, or none, has no end.
    """
    head = prefix.rstrip(b"\xff")
    end = Excluded(head[:-1] + bytes([head[-1] + 1])) if head else Unbounded
    return Included(prefix), end


def text_prefix_range(prefix: str) -> tuple[Bound, Bound]:
    """The same for string keys, whose order is that of their code points."""
    head = prefix
    while head:
        raised = ord(head[-1]) + 1
        if raised == 0xD800:  # surrogates are no characters
            raised = 0xE000
        if raised <= 0x10FFFF:
            return Included(prefix), Excluded(head[:-1] + chr(raised))
        head = head[:-1]
    return Included(prefix), Unbounded
