"""Folding of whole texts with a map back to places, and search for whole words in them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache


class _Pieces(dict):
    """What a character becomes, worked out once; there are no more than Unicode has."""

    def __missing__(self, c: str) -> str:
        self[c] = c.lower() if c.isascii() else "".join(d.lower() for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn")
        return self[c]


_PIECES = _Pieces()
#: Search patterns that a worker remembers; ``re`` keeps only 512, and texts share more values than that.
PATTERNS = 1 << 14


def folded(text: str) -> tuple[str, Sequence[int]]:
    """Lower case without marks, and for each of its characters the place it came from.

    One character may become none or several, so places are kept; plain ASCII needs no map.
    """
    if text.isascii():
        return text.lower(), range(len(text))
    pieces = [_PIECES[c] for c in text]
    return "".join(pieces), [i for i, p in enumerate(pieces) for _ in p]


def in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole(text: str, start: int, end: int) -> bool:
    """Whether the edges of a match that are letters or digits end a word there."""
    cut_left = start > 0 and text[start].isalnum() and in_word(text[start - 1])
    cut_right = end < len(text) and text[end - 1].isalnum() and in_word(text[end])
    return not (cut_left or cut_right)


@lru_cache(PATTERNS)
def pattern_of(value: str, exact: bool) -> re.Pattern | None:
    """Search pattern of a value: any white space where it has some; None for a blank value."""
    words = (value if exact else folded(value)[0]).split()
    return re.compile(r"\s+".join(map(re.escape, words))) if words else None


class Searched:
    """A text to search for many values."""

    def __init__(self, text: str):
        self.text = text
        self.flat, self.places = folded(text)

    def places_of(self, value: str, exact: bool) -> Iterator[tuple[int, int]]:
        """Whole-word matches, leftmost first, none overlapping another."""
        pattern = pattern_of(value, exact)
        if pattern is None:
            return
        for m in pattern.finditer(self.text if exact else self.flat):
            start, end = m.span() if exact else (self.places[m.start()], self.places[m.end() - 1] + 1)
            if whole(self.text, start, end):
                yield start, end


_WORDS = re.compile(r"[^\W_]+")


def keys_of_text(text: str | None) -> list[str]:
    """The distinct folded words and pairs of neighbouring words of a text."""
    words = _WORDS.findall(folded(text or "")[0])
    return list(dict.fromkeys(words) | dict.fromkeys(map(" ".join, zip(words, words[1:]))))


def key_of_value(value: str | None) -> str | None:
    """The key under which a text that holds ``value`` lists it: its longest pair of words, or its word.

    Edges of words inside a value need not be edges of words in the text only where the value
    begins or ends within a word; whole-word matching rules that out.
    """
    words = _WORDS.findall(folded(value or "")[0])
    pairs = list(map(" ".join, zip(words, words[1:]))) or words
    return max(pairs, key=len) if pairs else None
