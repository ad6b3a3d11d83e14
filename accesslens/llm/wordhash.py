"""Words of many texts as 64-bit hashes, found with numpy on the raw bytes."""

from __future__ import annotations

import numpy as np

#: Bytes tokenised at once; a longer text is cut where a word ends.
PIECE = 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


HELD: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-casing of A to Z, which bytes are blank, and a random number per (offset in the word mod 64, byte); made once a process."""
    if "made" not in HELD:
        HELD["made"] = tables()
    return HELD["made"]


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return lower, blank, np.random.default_rng(2024).integers(0, 2**64, 64 * 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_words(data: np.ndarray, of_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a byte array in lower case, with their starts and ends.

    ``of_word``: which of the 256 bytes words consist of; all but the blank ones unless given.
    """
    lower, blank, random = constants()
    inside = ~blank[data] if of_word is None else of_word[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    at = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    offset = np.arange(len(at)) - np.repeat(first, lengths)
    values = random[((offset & 63) << 8) | lower[data[at]]]
    longest = int(lengths.max())
    if longest > 64:
        powers = np.cumprod(np.full((longest >> 6) + 1, ODD, np.uint64)) * np.uint64(3)
        far = offset >= 64
        values[far] *= powers[offset[far] >> 6]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64)), starts, ends


def pieces(text: bytes, most: int = PIECE) -> list[bytes]:
    """``text`` in parts of about ``most`` bytes that end where a word ends."""
    if len(text) <= most:
        return [text]
    found, lo = [], 0
    blanks = b" \t\n\x0b\x0c\r"
    while lo < len(text):
        hi = min(lo + most, len(text))
        while hi < len(text) and text[hi] not in blanks:
            hi += 1
        found.append(text[lo:hi])
        lo = hi
    return found


def batches(texts: list[bytes], most: int = PIECE):
    """Ranges of ``texts`` of about ``most`` bytes together."""
    lo = 0
    while lo < len(texts):
        hi, held = lo, 0
        while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= most):
            held += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts in a row, and how many each has."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        found = np.concatenate([hash_words(np.frombuffer(p, np.uint8))[0] for p in pieces(texts[0])])
        return found, np.array([len(found)])
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    found, starts, _ = hash_words(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return found, np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The distinct shingles of one text, sorted; the whole sequence is one if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(width, len(words))
    m = len(words) - n + 1
    total = np.full(m, n, np.uint64)
    factor = ODD
    for k in range(n):
        total += words[k : k + m] * factor
        factor = np.uint64((int(factor) * 0x2545F4914F6CDD1D + 2) & (2**64 - 1)) | np.uint64(1)
    return np.unique(mixed(total))
