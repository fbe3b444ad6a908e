"""Words and shingles of whole texts as 64-bit hashes, computed with numpy inside Python tasks."""

from __future__ import annotations

import numpy as np

#: White space of the shingle and size contracts: space and the bytes 9 to 13.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The Spark and DuckDB form of one word.
WORD = "[^\\x20\\x09-\\x0D]+"

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, PIECE + 1)
_INVERSES = _powers(_BASE_INVERSE, PIECE + 1)


def bounds(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of word bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = is_word[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_NOT_SPACE = ~_IS_SPACE


def _run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte runs from prefix sums modulo 2**64, mixed with the run's length."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWERS[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64))


#: Letters and digits; characters beyond ASCII count as letters.
ALNUM = np.ones(256, bool)
ALNUM[list(range(0x00, 0x30)) + list(range(0x3A, 0x41)) + list(range(0x5B, 0x61)) + list(range(0x7B, 0x80))] = False


def word_hashes(text: str | None, lower: bool = True, prefixes: tuple[int, ...] = (), is_word: np.ndarray = _NOT_SPACE) -> np.ndarray:
    """64-bit hashes of the words of a whole text, in order: runs of bytes of is_word, between white space if not given.

    With prefixes, also the hashes of each word's first so many bytes, one block after another.
    A null text has no words.
    """
    if not text:
        return np.zeros(0, np.uint64)
    whole = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out: list[list[np.ndarray]] = [[] for _ in range(1 + len(prefixes))]
    at = 0
    while at < len(whole):
        end = min(len(whole), at + PIECE)
        if end < len(whole):  # cut behind the last white space; a longer word is hashed by itself
            blank = np.flatnonzero(~is_word[whole[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:
                after = np.flatnonzero(~is_word[whole[end:]])
                end = end + int(after[0]) if len(after) else len(whole)
                out[0].append(_long_word(whole[at:end]))
                for k, size in enumerate(prefixes):
                    out[k + 1].append(_run_hashes(_LOWER[whole[at : at + size]], np.array([0]), np.array([size])))
                at = end
                continue
        data = _LOWER[whole[at:end]] if lower else whole[at:end]
        starts, ends = bounds(data, is_word)
        if len(starts):
            out[0].append(_run_hashes(data, starts, ends))
            for k, size in enumerate(prefixes):
                out[k + 1].append(_run_hashes(data, starts, np.minimum(ends, starts + size)))
        at = end
    flat = [x for block in out for x in block]
    return np.concatenate(flat) if flat else np.zeros(0, np.uint64)


def _long_word(data: np.ndarray) -> np.ndarray:
    """The hash of one word of over PIECE bytes, folded piece by piece."""
    data = _LOWER[data]
    total = np.uint64(len(data))
    with np.errstate(over="ignore"):
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            total = mix(np.array([total + (_BYTE[piece] * _POWERS[: len(piece)]).sum(dtype=np.uint64)], np.uint64))[0]
    return np.array([total], np.uint64)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles; of the whole word sequence if that is shorter; else empty."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total = mix(total + words[i : n - k + 1 + i])
    return np.unique(total)
