"""String similarity scores from 0 to 100 for batches of pairs.

``ratio`` is 100 * 2 * LCS / (len a + len b) rounded half to even, with LCS the longest common
subsequence. ``partial`` is the best ratio of the shorter string against equally long
windows of the longer one that start where a common block lines them up. ``token_sort`` is
the ratio after lower-casing, dropping what is not an ASCII letter or digit, and sorting the words.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np

WORD_BITS = 64
NOT_WORD = re.compile(r"\W+")


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel longest common subsequence (Allison and Dix 1986, Hyyro 2004)."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_at_least(a: str, b: str, need: int) -> int:
    """The LCS when it reaches ``need``, else 0; gives up as soon as too many characters of the shorter string are unmatched.

    With that many common characters, character j of one string has no partner beyond
    position j plus the unmatched characters of the other, so only that band counts.
    """
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, spare, lead = full, len(b) - need, len(a) - need
    for j, ch in enumerate(b, start=1):
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
        if j % WORD_BITS == 0:
            band = j + lead
            if j - (band - (row & ((1 << band) - 1)).bit_count()) > spare:
                return 0
    common = len(a) - row.bit_count()
    return common if common >= need else 0


def _codes(texts: Sequence[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, dtype=np.int32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.int32)
    return out


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """LCS of each pair; pairs whose first string fits a machine word run together."""
    lengths = np.array([len(x) for x in a], dtype=np.int64)
    out = np.zeros(len(lengths), dtype=np.int64)
    short = np.flatnonzero(lengths <= WORD_BITS)
    for i in np.flatnonzero(lengths > WORD_BITS):
        out[i] = lcs_length(a[i], b[i])
    if len(short):
        left = _codes([a[i] for i in short], WORD_BITS, -1)
        texts = [b[i] for i in short]
        right = _codes(texts, max(max(map(len, texts)), 1), -2)
        row = np.full(len(short), np.iinfo(np.uint64).max, dtype=np.uint64)
        for j in range(right.shape[1]):
            hits = np.packbits(left == right[:, j : j + 1], axis=1, bitorder="little").view("<u8")[:, 0]
            hit = row & hits
            row = (row + hit) | (row - hit)
        out[short] = WORD_BITS - np.bitwise_count(row).astype(np.int64)
    return out


def ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], dtype=float)
    common = lcs_lengths(a, b)
    return np.rint(100.0 * np.divide(2.0 * common, total, out=np.zeros_like(total), where=total > 0)).astype(int)


def _partial(a: str, b: str) -> int:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0
    blocks = SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()
    windows = {long[max(0, m.b - m.a) : max(0, m.b - m.a) + len(short)] for m in blocks}
    if short in windows:
        return 100
    tries = sorted(windows)
    common = lcs_lengths([short] * len(tries), tries)
    best = max(2.0 * c / (len(short) + len(w)) for c, w in zip(common, tries))
    return 100 if best > 0.995 else int(np.rint(100.0 * best))


def partial_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return np.array([_partial(x, y) for x, y in zip(a, b)], dtype=int)


def sorted_words(text: str) -> str:
    ascii_text = text.encode("ascii", "ignore").decode()
    return " ".join(sorted(NOT_WORD.sub(" ", ascii_text).lower().split()))


def token_sort_ratios(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    return ratios([sorted_words(x) for x in a], [sorted_words(y) for y in b])


SCORERS = {"ratio": ratios, "partial": partial_ratios, "token_sort": token_sort_ratios}


def best_scores(a: Sequence[str], b: Sequence[str], scorers: Sequence[str] = tuple(SCORERS)) -> np.ndarray:
    return np.max([SCORERS[s](a, b) for s in scorers], axis=0)
