"""Words as exact numbers, vectorised 64-bit hashes of words, and hashes of runs of n words."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once, masks of the first 0 to 8 of them, and fixed odd multipliers of the two families.
_LANE = 8
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LANE_FACTOR = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bytes of the longest word that is hashed by lanes; longer ones are hashed by BLAKE2.
_LONGEST = 128
#: Bytes split into words at once; a longer text is split in parts cut between words.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(raw: bytes) -> list[bytes]:
    """The text in parts of about PIECE bytes that cut no word."""
    out, at = [], 0
    while len(raw) - at > PIECE:
        cut = _SPACE.search(raw, at + PIECE)
        if cut is None:
            break
        out.append(raw[at : cut.start()])
        at = cut.start()
    out.append(raw[at:] if at else raw)
    return out


class Lexicon(dict):
    """Number of each word (a run without 0x20 and 0x09 to 0x0D), in order of first use. Equal numbers are equal words."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def numbers(self, raw: bytes, lower: bool = False) -> np.ndarray:
        """The words of a text by number; `lower` folds A-Z first."""
        parts = []
        for piece in pieces(raw):
            words = (piece.translate(_LOWER) if lower else piece).split()
            parts.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


class Words:
    """The words of some texts (runs without 0x20 and 0x09 to 0x0D) in one buffer; `lower` folds A-Z first."""

    def __init__(self, texts: list[bytes], lower: bool) -> None:
        joined = b" ".join(texts)
        self.raw = (joined.translate(_LOWER) if lower else joined) + bytes(_LANE)
        buf = np.frombuffer(self.raw, np.uint8)[: len(joined)]
        inside = np.concatenate(([False], ~_IS_SPACE[buf], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, np.int64)
        #: number of words of each text
        self.counts = np.diff(np.append(np.searchsorted(self.starts, begin), len(self.starts)))

    def lanes(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Eight bytes from each place, zero after `left` of them."""
        every = np.ndarray((len(self.raw) - _LANE + 1,), "<u8", self.raw, 0, (1,))
        return every[at] & _MASKS[np.minimum(left, _LANE)]

    def hashes(self, which: int = 0) -> np.ndarray:
        """64-bit hash of each word; `which` picks one of two families."""
        size = self.ends - self.starts
        out = size.astype(np.uint64) * _LANE_FACTOR[which]
        long = size > _LONGEST
        at = np.flatnonzero(~long)
        for k in range(0, _LONGEST, _LANE):
            at = at[size[at] > k] if k else at
            if not len(at):
                break
            h = (out[at] ^ self.lanes(self.starts[at] + k, size[at] - k)) * _LANE_FACTOR[which]
            out[at] = h ^ (h >> np.uint64(29))
        out = mix(out)
        for i in np.flatnonzero(long).tolist():
            out[i] = int.from_bytes(blake2b(self.raw[self.starts[i] : self.ends[i]], digest_size=8, key=bytes([which])).digest(), "little")
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether word a[i] is word b[i], byte by byte."""
        size = self.ends[a] - self.starts[a]
        same = size == self.ends[b] - self.starts[b]
        at = np.flatnonzero(same & (size <= _LONGEST))
        for k in range(0, _LONGEST, _LANE):
            at = at[size[at] > k]
            if not len(at):
                break
            same[at] = self.lanes(self.starts[a[at]] + k, size[at] - k) == self.lanes(self.starts[b[at]] + k, size[at] - k)
            at = at[same[at]]
        for i in np.flatnonzero(same & (size > _LONGEST)).tolist():
            same[i] = self.raw[self.starts[a[i]] : self.ends[a[i]]] == self.raw[self.starts[b[i]] : self.ends[b[i]]]
        return same


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and the number of words of each text."""
    words = Words(texts, lower)
    return words.hashes(), words.counts


#: Fixed odd multipliers of the two families.
_RUN = (0xD6E8FEB86659FD93, 0xA5A3564E1B873593)


def run_hashes(words: np.ndarray, starts: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of the n words from each of `starts`; `which` picks one of two families."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(n):
        out += words[starts + k] * np.uint64(pow(_RUN[which], k, 1 << 64))
    return mix(out + np.uint64(n))
