"""Words of a text as UTF-8 bytes, without a Python loop over characters.

``ALNUM``: lower-cased A-Z; words are runs of characters other than the ASCII
ones that are no digit or letter (so every non-ASCII character is part of a
word).  White-space words are ``bytes.split()`` of the lower-cased bytes.
"""

from __future__ import annotations

import numpy as np

#: Maps A-Z to a-z and every ASCII byte outside 0-9, a-z to a space; same length.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def alnum_bytes(text: str | None) -> bytes:
    """The text in UTF-8, normalised byte by byte (offsets stay the same)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM)


def alnum_words(text: str | None) -> list[bytes]:
    return alnum_bytes(text).split()


def space_words(text: str | None) -> list[bytes]:
    """Lower-cased A-Z, split at runs of space and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_spans(norm: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets [start, end) of the words of a normalised text."""
    a = np.frombuffer(b" " + norm + b" ", np.uint8) != 32
    edge = np.flatnonzero(a[1:] != a[:-1])
    return edge[::2], edge[1::2]


def char_offsets(text: str, at: np.ndarray) -> np.ndarray:
    """Character offsets of byte offsets in the UTF-8 form of ``text``."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]
