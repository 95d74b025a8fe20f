"""Token ids by a public tokenizer file, with nothing remembered between texts.

The word-level BPE file lower-cases, drops white space and never joins across
it, so the ids of a text are those of its white-space chunks in order.  A text
of plain characters is split by the file's own pattern and its pieces are merged
by the fast BPE library, which merges bytes by rank.  The file marks a piece's
last byte; here a line feed (white space, so in no piece) ends each piece, and
the pairs (byte, line feed), which stand for the marked bytes, have the first
ranks.  Every later rank is the file's merge of that place.  Both merge the
lowest rank first, and a string is the result of one merge only, so the ids
are the same.  Any other chunk goes through the file's own library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Path of the tokenizer file; the library finds it next to its own files.
DEFAULT_FILE = "word_bpe_49k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


# The file's split pattern over the plain characters (letters and numbers up to U+024F).
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\\x09-\\x0d \x85\xa0"
PIECES = re.compile(f"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")

#: The same for texts of the first 256 characters: their classes fit a small table.
SHORT_PIECES = re.compile(PIECES.pattern.replace("\u024f", "\xff"))

#: Texts with other characters (or the file's special strings) are handled chunk by chunk.
_ODD = re.compile("[\x1c-\x1f\x85\u0130\u0250-\u200f\u2028-\u202f\u205f-\u20ab\u20ad-\U0010ffff]|<\\|").search


def _short(text: str) -> bool:
    """True when all characters are among the first 256."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def ODD(text: str) -> bool:
    if _short(text):
        return any(x in text for x in ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "<|"))
    return _ODD(text) is not None


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


END = "\n"


class Encoder:
    """text -> its ids as little-endian unsigned 16-bit numbers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this file need more than 16 bits")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        byte = {letter: bytes([b]) for b, letter in _byte_letters().items()}

        def raw(token: str) -> bytes:
            marked = token.endswith(suffix)
            body = b"".join(map(byte.__getitem__, token.removesuffix(suffix) if marked else token))
            return body + END.encode() if marked else body

        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if len(set(merged)) != len(merged):
            raise ValueError("a token of this file is made by two merges")
        tokens = [letter + suffix for letter in byte] + merged
        ranks = {raw(t): i for i, t in enumerate(tokens)}
        alone = [x for x in byte.values() if x not in ranks]
        ids = [vocab[t] for t in tokens] + [vocab[_byte_letters()[x[0]]] for x in alone]
        ranks |= {x: len(tokens) + i for i, x in enumerate(alone)}
        self.ids = np.array(ids, "<u2")
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        pieces = (SHORT_PIECES if _short(text) else PIECES).findall(text.lower())
        if not pieces:
            return b""
        places = array("I", self.merge.encode_ordinary(END.join(pieces) + END))
        return self.ids[np.frombuffer(places, np.uintc)].tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def encode(self, text: str) -> bytes:
        if not ODD(text):
            return self._plain(text)
        if re.search("[\x1c-\x1f]", text):  # Python splits here, the file does not
            return self._whole(text)
        return b"".join(self._whole(c) if ODD(c) else self._plain(c) for c in text.split())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
