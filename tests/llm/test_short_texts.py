"""Texts of the first 256 characters take a short way to their pieces: the same ids."""

import random

from prlens.llm import tokens

CHARS = [chr(i) for i in range(256)] + ["'s", "'re", "'LL", "<|", "<|endoftext|>", "word ", "ÀÉ"]


def test_short_way_finds_the_same_pieces():
    rng = random.Random(3)
    texts = ["".join(rng.choice(CHARS) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += [c + tail for c in map(chr, range(0x300)) for tail in ("", "'s a", "ab1")]
    for t in texts:
        assert tokens.ODD(t) == bool(tokens._ODD(t)), repr(t)
        if tokens._short(t):
            assert tokens.SHORT_PIECES.findall(t.lower()) == tokens.PIECES.findall(t.lower()), repr(t)


def test_short_way_gives_the_library_ids():
    e = tokens.encoder(tokens.default_path())
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choice(CHARS) for _ in range(rng.randrange(40)))
        assert e.encode(t) == e._whole(t), repr(t)
