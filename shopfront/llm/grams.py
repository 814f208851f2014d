"""Character n-grams of texts as numpy arrays, for the two n-gram classifiers.

A text becomes its letters, lower-cased, with each run of other characters (and
both ends) as one boundary; n-grams are hashed to 64 bits.  Long texts go
through in slices that carry n-1 characters over, so memory is bounded and
every n-gram counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 18
_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> lower-cased letter, 0 for anything else."""
    global _fold
    if _fold is None:
        points = range(0x110000)
        _fold = np.fromiter((ord(chr(p).lower()[0]) if chr(p).isalpha() else 0 for p in points), "<u4", 0x110000)
    return _fold


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_slices(text: str | None, n: int) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, slice by slice; nothing if it has no letter."""
    carry = np.zeros(1, "<u4")
    seen = given = False
    text = text or ""
    for at in range(0, len(text), SLICE):
        codes = fold_table()[np.frombuffer(text[at:at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")]
        codes = np.concatenate([carry, codes, np.zeros(int(at + SLICE >= len(text)), "<u4")])
        fresh = len(carry)
        keep = np.ones(len(codes), bool)
        keep[fresh:] = (codes[fresh:] != 0) | (codes[fresh - 1:-1] != 0)
        codes = codes[keep]
        seen = seen or bool(codes.any())
        if not seen:
            continue
        if len(codes) >= n:
            h = np.zeros(len(codes) - n + 1, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i:len(codes) - n + 1 + i]
            given = True
            yield mix(h)
        elif at + SLICE >= len(text) and not given:  # shorter than one n-gram: it is one, all in the carry
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in codes:
                    h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c)
            yield mix(np.array([h], np.uint64))
        carry = codes[-(n - 1):] if n > 1 else codes[:0]
