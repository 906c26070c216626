"""Splitting texts for byte-level BPE so that the work on repeated pieces is done once.

A text is cut at single spaces between two non-space characters. The published split pattern
never matches across such a place (a space always opens the next match), so each piece can be
split and merged by itself, and a bounded cache of pieces serves most of a corpus.
"""

from __future__ import annotations

import public_tokenizers
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Pieces kept by a worker's cache before it starts anew.
CACHE_ENTRIES = 300_000


def words_of(pieces: list[str]) -> list[list[str]]:
    """PATTERN's matches of each piece; ASCII letters, with a space before them or not, are one match."""
    return [[p] if p.isascii() and (p[1:] if p[:1] == " " else p).isalpha() else PATTERN.findall(p) for p in pieces]


class Memo:
    """Values of pieces, made for all new ones of a batch at once and kept up to a bound."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        self.make, self.entries, self.plain, self.spaced = make, entries, {}, {}

    def split(self, texts: list[str]) -> list[tuple[list[str], list[str]]]:
        """(plain, spaced) of each text: it is the plain strings followed by " " + x for each x of
        spaced, and PATTERN can split these one by one. After this, both dictionaries hold all of
        them. A text with a space next to other white space, over which the pattern looks, is
        split by the pattern as a whole.
        """
        if len(self.plain) + len(self.spaced) > self.entries:
            self.plain, self.spaced = {}, {}
        parts = [t.split(" ") for t in texts]
        first, rest = [p[0] for p in parts], [p[1:] for p in parts]
        spaced = set().union(*rest).difference(self.spaced)
        bad = {x for x in (*spaced, *first) if not x or len(x.strip()) < len(x)}
        out = [([f] if f else [], r) for f, r in zip(first, rest, strict=True)]
        if bad:
            for i, p in enumerate(parts):
                if not bad.isdisjoint(p):
                    out[i] = (PATTERN.findall(texts[i]), [])
            spaced -= bad
        plain = set().union(*(p for p, _ in out)).difference(self.plain)
        if plain or spaced:
            names = [*plain, *(" " + x for x in spaced)]
            values = self.make(names)
            self.plain.update(zip(plain, values, strict=False))
            self.spaced.update(zip(spaced, values[len(plain) :], strict=True))
        return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by the published rule:
    printable Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
