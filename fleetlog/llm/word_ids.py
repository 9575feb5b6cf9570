"""Token ids of whole texts by a word-level vocabulary file, one library call per new word.

White space is dropped by these vocabularies and nothing in them looks across it:
normalisation never composes over white space, the pre-tokenizer never matches it,
merges stay inside a pre-token. So the ids of a text are those of its words, and
words repeat. Each task keeps bounded tables of the words and pre-tokens it has met.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

# Pre-tokens and words kept per Python worker; a table is emptied when it is full.
CACHE_WORDS = 700_000
# str.split() takes these for white space, the vocabularies do not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
# Texts of Latin letters: the same composed or not, lower case is taken letter by letter.
_PLAIN = re.compile(r"[\t-\r -~\x85\xa0-\u012f\u0131-\u017f]*")
# Fixed value: the vocabulary's pattern for pre-tokens, over such texts in lower case.
_LETTER, _NUMBER = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0100-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_CUT = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{_LETTER}{_NUMBER}]+")
WORD_END = "</w>"
# Pre-tokens that are sent to the library in one text.
_JOINED = 200


class WordEncoder:
    """Ids of texts as the tokenizers library gives them, without special tokens around."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.limit = cache_words
        vocab = self.library.get_vocab(with_added_tokens=True)
        top = max(vocab.values(), default=0)
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.ends_word = np.zeros(top + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Ids of pre-tokens, many in one text; each one's ids end with a word-end token."""
        groups = [pieces[i : i + _JOINED] for i in range(0, len(pieces), _JOINED)]
        for group, data in zip(groups, self._library([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.ends_word[np.frombuffer(data, self.dtype)]) + 1
            if len(ends) != len(group):
                self.pieces.update(zip(group, self._library(group)))
                continue
            at = [0, *(ends * self.dtype.itemsize).tolist()]
            self.pieces.update((p, data[a:b]) for p, a, b in zip(group, at, at[1:]))

    def _room(self, table: dict[str, bytes], parts: list[list[str]]) -> list[str]:
        """Parts that are not in the table; it is emptied first if they would overfill it."""
        new = set().union(*parts).difference(table)
        if len(table) + len(new) > self.limit:
            table.clear()
            new = set().union(*parts)
        return list(new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as `dtype`."""
        cuts: list[tuple[dict | None, list[str]]] = []
        for t in texts:
            if _PLAIN.fullmatch(t) and "<|" not in t:
                cuts.append((self.pieces, _CUT.findall(t.lower())))
            elif _SEPARATORS.search(t):
                cuts.append((None, self._library([t])))
            else:
                cuts.append((self.known, t.split()))
        self._learn_pieces(self._room(self.pieces, [c for table, c in cuts if table is self.pieces]))
        words = self._room(self.known, [c for table, c in cuts if table is self.known])
        self.known.update(zip(words, self._library(words)))
        return [c[0] if table is None else b"".join(map(table.__getitem__, c)) for table, c in cuts]


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker."""
    return WordEncoder(path)
