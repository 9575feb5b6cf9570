"""Token counts by a compiled finite-state transducer.

The tokenizer (normalised text, pre-tokens, byte-pair merges) is compiled into one
deterministic transducer over code points. Its transitions carry the number of tokens
by which the count of the text so far changes; a sum over the path is the count.

* Pre-tokens: the state says whether a run of letters or of other signs is open, or an
  apostrophe that may still become a contraction.
* Merges: the tokens of a prefix end in one certain token, and two tokens may stand
  side by side if merging their joined text gives just the two back. So the last token
  of a longer prefix follows from the last tokens at the places where a token may still
  begin: those within the longest suffix that begins some token. The suffix, those
  last tokens and the counts there (relative to now) are the state. There are finitely
  many, far fewer than words.
* The last letter of a word is spelled as a word end. A state knows by how much the
  count changes if the word ends now.

States are made when a text first needs them and kept in a dense table, emptied when
full. Texts are laid end to end and cut into chunks that all run in step, one column
after the other. What a chunk does is a map from states to states: white space leads
to the start state whatever came before, so the map of a chunk with white space is
constant after it, and only its head, up to the white space, needs to be run from where
the chunk before ended. The maps of chunks without any white space are made for the
states that can occur, in a few rounds for all chunks, and composed by a prefix scan.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fleetlog.llm.frames import steps, texts_of
from fleetlog.llm.piece_bpe import byte_characters

# Entries of the transition table per Python worker (4 bytes each); it starts afresh when full.
TABLE_ENTRIES = 24_000_000
CHUNK = 256
# Rounds in which the maps of chunks are made for all states that the maps before them lead to.
GUESSES = 8
# Different signs that the table tells apart at a time.
MAX_SYMBOLS = 4096
WORD_END = "</w>"
# Added to the last byte of a word; symbols are characters below 512.
_END = 256
SPACE, LETTER, NUMBER, OTHER = range(4)
# Fixed value: contractions that are a pre-token of their own.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@cache
def character_classes() -> np.ndarray:
    """Class of each code point."""
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        table[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return table


# The settings of a tokenizer file that the transducer stands for.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MODEL = {"type": "BPE", "end_of_word_suffix": WORD_END}


def read_settings(path: str) -> dict:
    """A tokenizer file; a ValueError for one that counts in another way than the transducer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    steps_ = before.get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    spelled = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    other = {k for k, v in model.items() if k not in ("vocab", "merges", *MODEL) and v}
    wrong = [name for name, ok in {
        "normalizer": spec.get("normalizer") == NORMALIZER,
        "pre_tokenizer": len(steps_) == 2 and steps_[0] == split and spelled.items() <= steps_[1].items(),
        "model": all(model.get(k) == v for k, v in MODEL.items()) and not other,
        "added_tokens": not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
        "truncation": not spec.get("truncation"),
        "vocab (a byte is missing)": all(c + end in model["vocab"] for c in byte_characters() for end in ("", WORD_END)),
    }.items() if not ok]
    if wrong:
        raise ValueError(f"{path}: not the settings that tokens can be counted for: {', '.join(wrong)}")
    return spec


class TableFull(Exception):
    """A batch of texts needs more states than the table may hold."""


class WordCounts:
    """The part for byte-pair merges: feed a word symbol by symbol."""

    def __init__(self, vocab: dict[str, int], merges: list):
        byte_of = {c: b for b, c in enumerate(byte_characters())}

        def symbols(token: str) -> str:
            end = token.endswith(WORD_END) and token != WORD_END
            body = [byte_of[c] for c in (token[: -len(WORD_END)] if end else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + _END * end)

        self.tokens = {symbols(t) for t in vocab}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        self.ranks = {(symbols(a), symbols(b)): r for r, (a, b) in enumerate(pairs)}
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}
        self.side_by_side: dict[tuple, bool] = {}
        # suffix, last token at each place within it, count there relative to now
        self.start = ("", (None,), (0,))

    def merge(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            rank, k = min((self.ranks.get(pair, len(self.ranks)), k) for k, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, before: str | None, token: str) -> bool:
        """Whether the token may follow the one before (None: a word's beginning)."""
        known = self.side_by_side.get((before, token))
        if known is None:
            known = self.merge((before or "") + token) == ([before] if before else []) + [token]
            self.side_by_side[before, token] = known
        return known

    def _last(self, state: tuple, symbol: str) -> tuple[int, str]:
        suffix, last, _ = state
        text = suffix + symbol
        for j in range(len(text)):
            if text[j:] in self.tokens and self.fits(last[j], text[j:]):
                return j, text[j:]
        raise ValueError(f"the vocabulary cannot spell {text!r}")

    def feed(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """State after one more byte inside a word, and the change of the count."""
        suffix, last, counts = state
        j, token = self._last(state, chr(byte))
        change = counts[j] + 1
        text, drop = suffix + chr(byte), 0
        while text[drop:] not in self.prefixes:
            drop += 1
        return (text[drop:], (*last, token)[drop:], (*(c - change for c in counts[drop:]), 0)), change

    def finish(self, state: tuple, byte: int) -> int:
        """Change of the count by a word's last byte."""
        return state[2][self._last(state, chr(byte + _END))[0]] + 1


class Transducer:
    """Lazily compiled transitions of a word-level BPE tokenizer file."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        spec = read_settings(path)
        self.words = WordCounts(spec["model"]["vocab"], spec["model"]["merges"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kinds = character_classes()
        self.entries = entries
        self._no_symbols()
        self._reset()

    # -- states ---------------------------------------------------------------

    def _reset(self) -> None:
        self.numbers = {("start",): 0}
        self.states: list[tuple] = [("start",)]
        self.words.side_by_side.clear()
        self.table = np.full((1024, self.width), -1, np.int32)

    def _open(self, kind: int, state: tuple, point: int) -> tuple[tuple, int]:
        """One more code point of a run; the new state holds what ending the word here would add."""
        *inner, end = chr(point).encode()
        total = 0
        for byte in inner:
            state, change = self.words.feed(state, byte)
            total += change
        if_end = self.words.finish(state, end)
        state, change = self.words.feed(state, end)
        return ("run", kind, state, if_end - change), total + change

    def _piece(self, text: str) -> int:
        state, count = ("run", OTHER, self.words.start, 0), 0
        for c in text:
            state, change = self._open(OTHER, state[2], ord(c))
            count += change
        return count + state[3]

    def _begin(self, point: int) -> tuple[tuple, int]:
        kind = self.kinds[point]
        if kind == SPACE:
            return ("start",), 0
        if kind == NUMBER:
            return ("start",), self._piece(chr(point))
        if point == ord("'"):
            return ("quote", "'"), 0
        return self._open(int(kind), self.words.start, point)

    def step(self, state: tuple, point: int) -> tuple[tuple, int]:
        """Next state and change of the token count."""
        kind = self.kinds[point]
        if state[0] == "start":
            return self._begin(point)
        if state[0] == "run":
            _, run, word, if_end = state
            if kind == run:
                return self._open(run, word, point)
            after, count = self._begin(point)
            return after, count + if_end
        text = state[1] + chr(point)  # an apostrophe, perhaps with the first letter of a contraction
        if text in CONTRACTIONS:
            return ("start",), self._piece(text)
        if any(c.startswith(text) for c in CONTRACTIONS):
            return ("quote", text), 0
        if state[1] == "'" and kind == OTHER:
            opened, count = self._open(OTHER, self.words.start, ord("'"))
            after, change = self._open(OTHER, opened[2], point)
            return after, count + change
        count, after = self._piece("'"), ("start",)
        for c in text[1:]:
            after, change = self.step(after, ord(c))
            count += change
        return after, count

    # -- table ----------------------------------------------------------------

    def _fill(self, number: int, symbol: int) -> None:
        state, count = self.step(self.states[number], self.points[symbol])
        to = self.numbers.setdefault(state, len(self.states))
        if to == len(self.states):
            if to * self.width > self.entries:
                raise TableFull
            self.states.append(state)
            if to == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        if not -128 <= count <= 127:
            raise OverflowError("change of the count does not fit the table")
        self.table[number, symbol] = to << 8 | (count & 255)

    def _advance(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Table entries for pairs of state and symbol, made where they are missing."""
        found = self.table.ravel()[states * self.width + symbols]
        if found.min(initial=0) < 0:
            lanes = np.flatnonzero(found < 0)
            for key in np.unique(states[lanes] * self.width + symbols[lanes]):
                self._fill(int(key // self.width), int(key % self.width))
            found = self.table.ravel()[states * self.width + symbols]
        return found

    def _no_symbols(self) -> None:
        self.symbol = np.zeros(0x110000, np.int32)  # 0: not met; 1: all white space
        self.symbol[self.kinds == SPACE] = 1
        self.points = [-1, 0x20]  # code point of each symbol
        self.width = 64

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        out = self.symbol[points]
        if out.all():
            return out
        new = np.unique(points[out == 0])
        if len(self.points) + len(new) > MAX_SYMBOLS:
            self._no_symbols()
            self._reset()
            new = np.unique(points[self.symbol[points] == 0])
            if len(self.points) + len(new) > MAX_SYMBOLS:
                raise TableFull
        self.symbol[new] = np.arange(len(self.points), len(self.points) + len(new))
        self.points.extend(new.tolist())
        if len(self.points) > self.width:
            while self.width < len(self.points):
                self.width *= 2
            self._reset()
        return self.symbol[points]

    # -- texts ----------------------------------------------------------------

    def _plain(self, text: str) -> tuple[str, int]:
        """Normalised text, and the number of special tokens taken out of it."""
        special = 0
        if self.special and self.special.search(text):
            text, special = self.special.subn(" ", text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower(), special

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        plain = [self._plain(t) for t in texts]
        joined = " ".join(t for t, _ in plain) + " "
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t, _ in plain])[:-1]])
        try:
            changes = self._run(self._symbols(points))
        except TableFull:
            return self._afresh(texts)
        totals = np.add.reduceat(changes, starts, dtype=np.int64)
        return totals + np.array([s for _, s in plain])

    def _afresh(self, texts: list[str]) -> np.ndarray:
        """With an empty table: each half of the texts, or one text step by step without the table."""
        self._reset()
        if len(texts) > 1:
            half = len(texts) // 2
            return np.concatenate([self.counts(texts[:half]), self.counts(texts[half:])])
        text, total = self._plain(texts[0])
        state: tuple = ("start",)
        for c in text + " ":
            state, change = self.step(state, ord(c))
            total += change
        return np.array([total])

    def _run(self, symbols: np.ndarray) -> np.ndarray:
        """Change of the count at each place of a text that ends with white space."""
        n = len(symbols)
        lanes = -(-n // CHUNK)
        grid = np.ones(lanes * CHUNK, np.int64)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
        changes = np.zeros((CHUNK, lanes), np.int8)
        blank = grid == 1
        head = np.where(blank.any(axis=0), blank.argmax(axis=0), CHUNK)
        head[0] = 0  # the first chunk begins in the start state
        # constant part of every chunk's map: from the start state, after the first white space
        state = np.zeros(lanes, np.int64)
        for k in range(CHUNK):
            column = np.where(k < head, 1, grid[k])
            found = self._advance(state, column)
            state = found >> 8
            changes[k] = (found & 255).astype(np.uint8).view(np.int8)
        # heads, from where the chunk before ends, up to the white space that closes a word
        passes = head == CHUNK
        at = np.arange(1, lanes)
        now = self._beginnings(grid, state, passes)[1:]
        for k in range(CHUNK):
            going = k <= head[at]
            at, now = at[going], now[going]
            if not len(at):
                break
            found = self._advance(now, grid[k, at])
            now = found >> 8
            changes[k, at] = (found & 255).astype(np.uint8).view(np.int8)
        return changes.T.ravel()[:n]

    def _beginnings(self, grid: np.ndarray, ends: np.ndarray, passes: np.ndarray) -> np.ndarray:
        """State at the beginning of each chunk. ends: states at the ends of chunks with white space.

        The maps of chunks without are known in part: pairs (chunk, state) as one number, in
        order, and the state after the chunk. The first pairs have the start state, the next
        ones the states to which those before lead, for all chunks at once, until nothing
        is new. After `GUESSES` such rounds only states that do occur are followed.
        """
        lanes = len(passes)
        begin = np.concatenate([[0], ends[:-1]])
        inner = np.flatnonzero(passes)
        heir = np.concatenate([[False], passes[:-1]])  # the chunk before passes states on
        pairs, after = np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = inner << 32 | np.where(heir[inner], 0, begin[inner])
        first = new[~heir[inner]]
        rounds = 0
        while len(new):
            at, states = new >> 32, new & 0xFFFFFFFF
            for k in range(CHUNK):
                states = self._advance(states, grid[k, at]) >> 8
            order = np.argsort(np.concatenate([pairs, new]), kind="stable")
            pairs, after = np.concatenate([pairs, new])[order], np.concatenate([after, states])[order]
            ahead = (pairs >> 32) + 1 << 32 | after
            ahead = ahead[passes[ahead >> 32]]  # the last chunk of all has white space
            new, rounds = np.setdiff1d(ahead, pairs), rounds + 1
            if len(new) and rounds < GUESSES:
                continue
            known = _composed(pairs, after, first)
            begin[(pairs[known] >> 32) + 1] = after[known]
            new = np.intersect1d(new, (pairs[known] >> 32) + 1 << 32 | after[known])
        return begin


def _composed(pairs: np.ndarray, after: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the pairs that are reached from the first ones.

    A scan: maps of 1, 2, 4, ... chunks are composed from two of half as many.
    """
    ahead = (pairs >> 32) + 1 << 32 | after
    place = np.minimum(np.searchsorted(pairs, ahead), len(pairs) - 1)
    leap = np.where(pairs[place] == ahead, place, -1)  # -1: the next map is not known there, or has no need to be
    reached = np.searchsorted(pairs, first)
    while True:
        more = leap[reached]
        more = np.union1d(reached, more[more >= 0])
        if len(more) == len(reached):
            return reached
        reached, leap = more, np.where(leap >= 0, leap[leap], -1)


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. Null texts count as empty, ids may be null or repeat.

    A tokenizer file with other settings than the transducer's is a ValueError.
    """
    read_settings(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = transducer(tokenizer)
        for batch in steps(batches):
            tokens = count.counts(batch.column("text").to_pylist())
            sizes = pc.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, pa.array(tokens, pa.int64()), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
