"""Text functions over whole batches, for use inside Python workers.

The texts of a batch are laid end to end as code points, so that NumPy looks at all of them at once: one look costs about
a nanosecond a character, a look by Java's regular expressions fifty or more. Results equal those of ``text``: what NumPy
only suspects is decided by regular expressions, text by text. Classes are those of this Python's Unicode tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np

from varak.functions.text import LETTERS, REPAIR_SIGNS

#: Characters that are laid end to end at a time; bounds memory for long texts, a longer one comes alone.
CHUNK = 1 << 20
#: Lies before and after each text: a code that no character has.
_GAP = 0x110000
_WORD, _SPACE, _DIGIT, _MARK, _ASCII = 1, 2, 4, 8, 16
MARKS = ".,;:!?"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Bits of each code point."""
    kinds = np.zeros(_GAP + 1, np.uint8)
    for i in range(_GAP):
        c = chr(i)
        kinds[i] = (_WORD if c.isalnum() else 0) | (_SPACE if c.isspace() else 0) | (_DIGIT if c.isdecimal() else 0)
    kinds[ord("_")] |= _WORD
    kinds[[ord(c) for c in MARKS]] |= _MARK
    kinds[[*range(65, 91), *range(97, 123)]] |= _ASCII
    return kinds


@lru_cache(maxsize=1)
def _cleaned() -> np.ndarray:
    """What clean_text() makes of each code point; ``İ``, which becomes two, stays."""
    to = np.full(_GAP + 1, 32, np.uint32)
    for i in range(0x180):
        if re.match(f"[{LETTERS}]", chr(i)):
            to[i] = i if chr(i) == "İ" else ord(chr(i).lower())
    return to


_NUMBER, _CHAIN, _REPEAT = re.compile(r"\([^)]*\d[^)]*\)"), re.compile(r"\w\s*-\s*\w+\s*-\s*\w"), re.compile(r"(\w+)(?:\1\s*){3}")
_BRACKET, _SHORTENED = re.compile(r"\d\s*\]\s*,\s*\d"), re.compile(r"(?:^|\W)[A-Z][a-z]*\.\s+[A-Z][a-z]*\.")
_SULTAN = re.compile(r"Sultan\s+[IVX]+\.\s*\n")


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with a gap before each text and one at the end, and the places of the gaps."""
    codes = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    gaps = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=gaps[1:])
    codes[gaps] = _GAP
    return codes, gaps


def _run(found: np.ndarray, n: int) -> np.ndarray:
    """Places where n in a row are true."""
    if n == 1:
        return found
    half = _run(found, n // 2)
    pair = half[: len(half) - n // 2] & half[n // 2 :]
    return pair[:-1] & found[n - 1 :] if n % 2 else pair


def _four_alike(codes: np.ndarray, word: np.ndarray, longest: int) -> np.ndarray:
    """Places in texts without white space near which a chunk of word characters may follow itself three times.

    Four such chunks of n characters hold four neighbouring multiples of n, which have one character, and the places
    after three of these agree too.
    """
    found = []
    for n in range(1, longest // 2 + 1):
        some = codes[::n]
        at = np.flatnonzero(_run(some[1:] == some[:-1], 3)) * n
        at = at[word[at]]
        if n > 1:
            at = at[at + 2 * n + 1 < len(codes)]
            at = at[(codes[at + 1] == codes[at + n + 1]) & (codes[at + 1] == codes[at + 2 * n + 1])]
        found.append(at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _signs(texts: list[str]) -> dict[str, np.ndarray]:
    codes, gaps = _codes(texts)
    kinds = _classes()[codes]
    word, space, mark = (kinds & _WORD) != 0, (kinds & _SPACE) != 0, (kinds & _MARK) != 0
    digit = (kinds & _DIGIT) != 0

    def rows(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(gaps, places, "right") - 1

    def flag(places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        out[rows(places)] = True
        return out

    def settle(suspects: np.ndarray, sign: re.Pattern) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        for i in np.flatnonzero(suspects):
            out[i] = sign.search(texts[i]) is not None
        return out

    digits = np.flatnonzero(digit)
    with_digit = flag(digits)
    hyphens = np.bincount(rows(np.flatnonzero(codes == ord("-"))), minlength=len(texts))
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(word[:-1] & ~word[1:]) + 1
    short = starts[(ends - starts <= 2) & space[ends]]
    solid = np.flatnonzero(~space)
    dense = np.zeros(len(codes), bool)
    dense[short] = True
    trail = short
    at = short
    for _ in range(2):  # the word after this one, and the one after that
        after = solid[np.searchsorted(solid, at + 1 + word[at + 1])]
        trail, at = trail[dense[after]], after[dense[after]]
    longest = int((ends - starts).max()) if len(starts) else 0
    alike = solid[_four_alike(codes[solid], word[solid], longest)]
    return {
        "bracketed_number": settle(flag(np.flatnonzero(codes == ord("]"))) & with_digit, _BRACKET),
        "digit_inside_word": flag(digits[word[digits - 1] & word[digits + 1]]),
        "very_long_word": flag(np.flatnonzero(_run((kinds & _ASCII) != 0, 20))) if longest >= 20 else np.zeros(len(texts), bool),
        "repeated_chunk": settle(flag(alike), _REPEAT),
        "number_in_parentheses": settle(flag(np.flatnonzero(codes == ord("("))) & with_digit, _NUMBER),
        "hyphen_chain": settle(hyphens >= 2, _CHAIN),
        "short_words": flag(trail),
        "abbreviations": settle(flag(np.flatnonzero((codes[:-1] == ord(".")) & space[1:])), _SHORTENED),
        "sultan_number": settle(flag(np.flatnonzero(codes == ord("\n"))), _SULTAN),
        "blank_before_mark": flag(np.flatnonzero(space[:-1] & mark[1:])),
        "no_blank_after_mark": flag(np.flatnonzero(mark[:-1] & ~space[1:] & (codes[1:] != _GAP))),
    }


def signs(texts: list[str]) -> dict[str, np.ndarray]:
    """Each repair sign of each text, and needs_correction, which is any of them."""
    parts = [_signs(texts[a:b]) for a, b in chunks(texts)]
    found = {name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, bool) for name in REPAIR_SIGNS}
    return {**found, "needs_correction": np.logical_or.reduce(list(found.values()))}


def clean(texts: list[str]) -> list[str]:
    """clean_text() of each text."""
    out = []
    for a, b in chunks(texts):
        codes, gaps = _codes(texts[a:b])
        laid = _cleaned()[codes].tobytes().decode("utf-32-le")
        out += [" ".join(laid[i + 1 : j].split()).replace("İ", "i̇") for i, j in zip(gaps.tolist(), gaps[1:].tolist())]
    return out


_FOREIGN = re.compile(rf"[^{LETTERS}\s\d{MARKS}()\-]")


def post_process(text: str) -> str:
    text = _FOREIGN.sub("", text)
    for m in MARKS:
        if m in text:
            text = text.replace(m, m + " ")
    return " ".join(text.split())


def cleanliness(a: str, b: str) -> float | None:
    if a == b:
        return 1.0 if a else None
    return sum(map(eq, a, b)) / max(len(a), len(b))


_ENDS = re.compile("[.!?]+")


def report_counts(text: str) -> tuple[int, int, int, int]:
    """Words, characters, pieces between runs of marks, and words of the pieces."""
    pieces = [p for p in _ENDS.split(text) if p]
    return len(text.split()), len(text), len(pieces), sum(len(p.split()) for p in pieces)
