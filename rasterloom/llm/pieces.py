"""Chunks of a text that SentencePiece encodes apart, and a bounded memo for them.

The model writes a space as U+2581 and puts one before the text. If no piece has U+2581 after another character, no merge
crosses the place before a space that follows a non-space; and none crosses a line feed that has no piece. A text then
falls into chunks whose encodings, joined, are the text's encoding, and a chunk that occurs again needs no second one.
"""

from __future__ import annotations

import re

SPACE = "\u2581"
_CHUNKS = re.compile(r" +[^ \n]*|\n[^ \n]*")


def chunks(text: str) -> list[str]:
    """The chunks in order. One that starts with a line feed stands for itself; any other has one more space before it."""
    if not text:
        return []
    parts = text.replace("\n", " \n").split(" ")
    if "" not in parts:
        return parts
    return [x if x[0] == "\n" else x[1:] for x in _CHUNKS.findall(" " + text)]


def separable(pieces) -> bool:
    return not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)


class Memo(dict):
    """key -> compute(key) for some 2 * most keys: when it is full, what wasn't asked for since the last time goes."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.compute(key)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = got
        return got
