"""Splitting text into parts that a byte-level BPE encodes independently, with a bounded cache of their ids.

A space that stands between two other characters always begins a new piece of the tokenizer, and a line feed between
two others is a piece of its own. So " word" and "\\nWord" are encoded once per task and then looked up. Texts in which
white space meets white space, or stands at an end, are encoded as a whole.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterable

ODD = re.compile(r"^\s|\s\s|\s\Z")
CACHED = 300_000  # parts kept per generation and task
LONGEST = 64  # characters of a part that is kept: so a cache's bytes are bounded too


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


def parts_of(text: str) -> list[str] | None:
    """Parts of a text, or None if it can only be encoded whole. The first part is written as if a line feed came first."""
    if ODD.search(text):
        return None
    return ("\n" + text.replace("\n", " \n")).split(" ")


def real(part: str) -> str:
    return part if part[:1] == "\n" else " " + part


class PartCache(dict):
    """part -> ids as little-endian unsigned 32-bit bytes, made on first use by `encode` (string -> bytes).

    It has two generations of at most `limit` parts: when the young one is full it becomes the old one, from which parts
    that are used again come back. So frequent parts stay and memory is bounded.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int = CACHED):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.old: dict[str, bytes] = {}
        self.marks = {m: encode(m) for m in ".,!?;:"}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            if len(part) > 2 and part[-1] in self.marks and part[-2].isalpha():  # the mark is a piece of its own
                ids = self[part[:-1]] + self.marks[part[-1]]
            else:
                ids = self.encode(real(part))
        if len(part) > LONGEST:
            return ids
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def ids(self, texts: Iterable[str | None], special: tuple[str, ...] = ()) -> list[bytes]:
        """Ids of each text; null counts as empty. Texts with a special token's string are encoded whole."""
        out = []
        for text in texts:
            parts = None if not text or any(s in text for s in special) else parts_of(text)
            out.append(b"".join(map(self.__getitem__, parts))[4:] if parts else self.encode(text) if text else b"")
        return out
