"""Text canonicalisation shared by the operators: NFKC, lower case, words, folded text, 64-bit word sketches.

*Words* are the maximal runs of letters and digits of the NFKC lower-case text without apostrophes; the *folded*
text is what remains when everything but letters and digits is removed. Both take whole texts of any length.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_RUN = re.compile(r"[^\W_]+")
_GAP = re.compile(r"[\W_]+")
_APOSTROPHES = dict.fromkeys(map(ord, "'’‘ʼ"))
#: What each ASCII byte becomes: letters lower case, digits themselves, everything else a blank.
_ASCII = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))


def normal(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def words(text: str | None) -> list[str]:
    """The words of a text in order; their concatenation is its folded text."""
    if not text:
        return []
    if text.isascii():
        return text.encode("ascii").translate(_ASCII, b"'").decode("ascii").split()
    return _RUN.findall(normal(text).translate(_APOSTROPHES))


def folded(text: str | None) -> str:
    return _GAP.sub("", normal(text)) if text else ""


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words seen in this batch or worker; emptied before it grows without bound."""

    LIMIT = 2_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def parity_sketch(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each set of distinct word hashes the XOR of one bit per word.

    Two sets whose symmetric difference has d words have sketches that differ in at most d bits, so a bound on the
    difference becomes a bound on ``popcount(a ^ b)`` that never rejects a pair within the bound.
    """
    bits = np.uint64(1) << (hashes >> np.uint64(58))
    return np.bitwise_xor.reduceat(bits, starts) if len(bits) else np.empty(0, np.uint64)
