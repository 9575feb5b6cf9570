"""Plain versions of the corpus operators, for small inputs only."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

WEIGHTS, MODULUS = (1, 40503, 65599), 4294967291


def spaced(text):
    return (text or "").encode().split()


def line_chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [sum(h[i - b] * w for b, w in enumerate(WEIGHTS) if i >= b) % MODULUS for i in range(len(h))]
    n, out, start = len(lines), [], 0
    for i in range(n):
        if i == n - 1 or (1 <= i <= n - 3 and r[i] < r[i - 1] and r[i] < r[i + 1]):
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def dedup_lines(docs):
    """{(id, text): text left}, rows as (id, text)."""
    first, out = {}, {}
    for key in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d)):
        kept = []
        for no, chunk in enumerate(line_chunks(key[1])):
            body = "\n".join(chunk)
            if len(chunk) > 1 and body.strip():
                if first.setdefault(body, (key, no)) != (key, no):
                    continue
            kept += chunk
        out[key] = "\n".join(kept)
    return out


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(docs, width, percent):
    """[(id, set size, component)] for rows (id, text), in order."""
    sets = [shingle_set(t, width) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {}
    for (i, _), x in zip(docs, label):
        if i is not None:
            low[x] = min(low.get(x, i), i)
    return [(i, len(s), low.get(x)) for (i, _), s, x in zip(docs, sets, label)]


def removed_bytes(texts, length):
    """One list of booleans per text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def left_characters(text, gone):
    """The text without characters all of whose bytes are gone."""
    out, at = "", 0
    for c in text:
        n = len(c.encode())
        if not all(gone[at : at + n]):
            out += c
        at += n
    return out


def quality_features(text):
    words = spaced(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if spaced(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), copies, len(inside)


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))


def corpus(seed=1, n=60):
    """Rows (doc_id, text): prose, exact and near copies, shared passages, junk, and odd texts."""
    rng = random.Random(seed)
    passage = " ".join(word(rng) for _ in range(60))
    rows = []
    for i in range(n):
        lines = [" ".join(word(rng) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 9))]
        if i % 7 == 3:
            lines.insert(rng.randint(0, len(lines)), passage)
        text = "\n".join(lines)
        if i % 5 == 4:
            text = rows[-1][1]
        if i % 6 == 5:
            words = rows[-2][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if i % 11 == 10:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text))
    odd = [None, "", " \n\n ", "x", "é" * 500, "aaaa " * 2000, "one two three\nfour five\n" * 3, "<|endoftext|> it's 'll 123 \x1c x"]
    rows += [(n + k, t) for k, t in enumerate(odd)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, None)]
    return rows
