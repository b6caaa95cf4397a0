"""Functions over plain strings that Arrow UDFs apply to batches."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from . import classes as C

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())
_WORD = re.compile(f"[^{C.PY_NOT_WORD}]+")
_CUT = re.compile(r"[.!?](?=[ \t])")
_RUN = re.compile(f"[^{C.PY_NOT_WORD}]|\\.")
_LIST = re.compile(C.LIST_LINE, re.S)
_ENTITY, _IDENTIFIER = re.compile(C.ENTITY_SIGNAL), re.compile(C.IDENTIFIER_SIGNAL)
_QUOTED = [re.compile(p) for p in C.QUOTED_SIGNALS]
_DIGIT = re.compile("[0-9]")
_STOP, _SHORT, _LEANING = frozenset(C.STOPWORDS), frozenset(C.ABBREVIATIONS), frozenset(C.ANAPHORA)


def token_counts(texts: list[str | None]) -> np.ndarray:
    """Estimated tokens of each text: all code points of the batch are looked up at once.

    A run of n word characters is ceil(n / 4) tokens, one of n dense characters ceil(2 n / 3), any
    other character that isn't a space one; a text that isn't empty has one at least.  Null counts 0.
    """
    filled = [t or "" for t in texts]
    length = np.fromiter(map(len, filled), np.int64, len(filled))
    points = np.frombuffer("".join(filled).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(len(filled), np.int64)
    kind = np.where(points < 0x10000, C.KIND[np.minimum(points, 0xFFFF)], 1)
    ends = np.cumsum(length)
    fresh = np.ones(len(points), bool)
    fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
    fresh[(ends - length)[length > 0]] = True
    start = np.flatnonzero(fresh)
    n, k = np.diff(np.append(start, len(points))), kind[start]
    tokens = np.select([k == 1, k == 2, k == 3], [(n + 3) // 4, (2 * n + 2) // 3, np.zeros_like(n)], n)
    sums = np.concatenate([[0], np.cumsum(tokens)])
    at = np.searchsorted(start, np.stack([ends - length, ends]))
    return np.maximum(sums[at[1]] - sums[at[0]], length > 0)


def ascii_lower(text: str) -> str:
    return text.translate(_LOWER)


def words(text: str) -> list[str]:
    return _WORD.findall(ascii_lower(text))


def _abbreviated(line: str, dot: int) -> bool:
    """Whether the word before a full stop is an abbreviation or an initial."""
    at = dot
    while at and _RUN.fullmatch(line[at - 1]):
        at -= 1
    word = line[at:dot].lstrip(".")
    return ascii_lower(word) in _SHORT or (len(word) == 1 and word in _UPPER)


def segment(text: str) -> list[tuple[str, bool]]:
    """Sentences and whether each is a line of a list."""
    out: list[tuple[str, bool]] = []
    for line in text.split("\n"):
        line = line.strip(C.SPACE_CHARS)
        if not line:
            continue
        if _LIST.match(line) or len(line) <= C.WHOLE_LINE:
            out.append((line, bool(_LIST.match(line))))
            continue
        at = 0
        for cut in _CUT.finditer(line):
            if cut[0] == "." and _abbreviated(line, cut.start()):
                continue
            out.append((line[at : cut.end()].strip(C.SPACE_CHARS), False))
            at = cut.end()
        out.append((line[at:].strip(C.SPACE_CHARS), False))
    return [s for s in out if s[0]]


def shingles(found: list[str]) -> frozenset[str]:
    if len(found) < 3:
        return frozenset([" ".join(found)] if found else [])
    return frozenset(map(" ".join, zip(found, found[1:], found[2:])))


def score(text: str, found: list[str], first_or_last: bool, counts: Counter, total: int) -> int:
    """Rarity of a sentence's terms in thousandths a word, with fixed boosts for what it holds."""
    if not found:
        return 0
    rarity = sum((max(1, total) // counts[w]).bit_length() for w in found if w not in _STOP)
    lowered = ascii_lower(text)
    signals = (
        (bool(_DIGIT.search(text)), C.DIGIT),
        (bool(_ENTITY.search(text)), C.ENTITY),
        (any(q.search(text) for q in _QUOTED), C.QUOTED),
        (bool(_IDENTIFIER.search(text)), C.IDENTIFIER),
        (first_or_last, C.POSITION),
        (any(m in lowered for m in C.CONSTRAINTS), C.IMPERATIVE),
        (lowered.startswith(tuple(C.FILLERS)), -C.FILLER),
    )
    return rarity * C.SCALE // len(found) + sum(weight for holds, weight in signals if holds)


def scored(sentences: list[tuple[str, bool]]) -> list[dict]:
    """Of each sentence of a span: text, list_item, tokens, score, words."""
    found = [words(t) for t, _ in sentences]
    counts = Counter(w for x in found for w in x if w not in _STOP)
    total, last = sum(counts.values()), len(sentences) - 1
    tokens = token_counts([t for t, _ in sentences]).tolist()
    return [{"text": t, "list_item": item, "tokens": tokens[i], "score": score(t, found[i], i in (0, last), counts, total), "words": found[i]} for i, (t, item) in enumerate(sentences)]


def select(sentences: list[tuple[str, bool]], ratio_millis: int) -> list[int]:
    """Indices of the sentences to keep: prohibitions, then by score until the budget is met."""
    rows = scored(sentences)
    sets = [shingles(r["words"]) for r in rows]
    digits = [sorted(w for w in r["words"] if _DIGIT.search(w)) for r in rows]
    budget, used, kept = ratio_millis * sum(r["tokens"] for r in rows), 0, set()
    by_shingle: dict[str, list[int]] = {}  # kept sentences by shingle: only those that share one can be redundant with it

    def keep(i: int) -> None:
        nonlocal used
        kept.add(i)
        used += rows[i]["tokens"]
        for s in sets[i]:
            by_shingle.setdefault(s, []).append(i)

    def redundant(i: int) -> bool:
        shared = Counter(k for s in sets[i] for k in by_shingle.get(s, ()))
        return any(n * 100 > C.REDUNDANT_PERCENT * (len(sets[i]) + len(sets[k]) - n) and digits[i] == digits[k] for k, n in shared.items())

    for i, r in enumerate(rows):
        if any(m in ascii_lower(r["text"]) for m in C.PROHIBITIONS):
            keep(i)
    ranked = sorted(range(len(rows)), key=lambda i: (-rows[i]["score"], i))
    for i in ranked:
        if used * 1000 >= budget:
            break
        if i in kept or (not rows[i]["list_item"] and redundant(i)):
            continue
        keep(i)
        if i and i - 1 not in kept and rows[i]["words"] and rows[i]["words"][0] in _LEANING:
            keep(i - 1)
    return sorted(kept or ranked[:1])


def structural(text: str) -> bool:
    return any(m in text for m in C.STRUCTURAL_MARKERS)


def mostly_ascii(text: str) -> bool:
    return len(text.encode("ascii", "ignore")) * 100 >= len(text) * C.ASCII_PERCENT


def compress_text(text: str, ratio_millis: int) -> tuple[str, int, int]:
    """The compressed text, tokens before and after; the text itself where compression doesn't apply or gain."""
    before = int(token_counts([text])[0])
    if structural(text) or before < C.LEAST_TOKENS or not mostly_ascii(text):
        return text, before, before
    sentences = segment(text)
    if len(sentences) < C.LEAST_SENTENCES:
        return text, before, before
    short = " ".join(sentences[i][0] for i in select(sentences, ratio_millis))
    after = int(token_counts([short])[0])
    return (short, before, after) if after < before else (text, before, before)


def first_last(text: str, ratio_millis: int) -> str:
    """Baseline: sentences taken from the front and the back in turn until the budget is met."""
    sentences = [t for t, _ in segment(text)]
    tokens = token_counts(sentences).tolist()
    order = sorted(range(len(sentences)), key=lambda i: min(2 * i, 2 * (len(sentences) - 1 - i) + 1))
    budget, used, kept = ratio_millis * sum(tokens), 0, []
    for i in order:
        if used * 1000 >= budget:
            break
        kept.append(i)
        used += tokens[i]
    return " ".join(sentences[i] for i in sorted(kept))
