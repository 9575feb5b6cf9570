"""Terms of texts: maximal runs of wanted bytes, with only A-Z lower-cased, for whole texts of any length."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

# Bytes of text whose terms are held at a time.
PIECE = 1 << 20


class Terms:
    """Finder of maximal runs of the bytes of a class, given without its brackets.

    All bytes of characters beyond ASCII must be in the class or none, so that runs of
    bytes are runs of characters.
    """

    def __init__(self, signs: str):
        self._runs = re.compile(f"[{signs}]+".encode("latin-1"))
        self._gap = re.compile(f"[^{signs}]".encode("latin-1"))

    def _pieces(self, data: bytes) -> Iterator[bytes]:
        start = 0
        while len(data) - start > PIECE:
            gap = self._gap.search(data, start + PIECE)
            if not gap:
                break
            yield data[start : gap.start()]
            start = gap.end()
        yield data[start:] if start else data

    def count(self, text: bytes | None) -> Counter[bytes]:
        """How often each term occurs; nothing for a null text."""
        found: Counter[bytes] = Counter()
        for piece in self._pieces((text or b"").lower()):  # of bytes, lower() changes A-Z only
            found.update(self._runs.findall(piece))
        return found


# Letters and digits; letters only. Everything beyond ASCII counts as a letter.
WORDS_AND_NUMBERS = Terms("0-9a-z\x80-\xff")
WORDS = Terms("a-z\x80-\xff")
