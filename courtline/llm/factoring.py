"""Relative Lempel-Ziv factoring of word sequences against a reference block held as a suffix array."""

from __future__ import annotations

import numpy as np


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; a suffix that begins another comes first."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while n and rank[order[-1]] < n - 1 and k < 2 * n:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        found = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], found[1:] != found[:-1])))
        k *= 2
    return order


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of first words that both have."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        apart = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if (first := int(apart.argmax())) or apart[0]:
            return at + first
        at, step = at + step, step * 4
    return n


class Block:
    """A reference block: the words (numbers) of some texts, which no match crosses."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.begin = np.concatenate(([0], ends[:-1]))
        self.words = np.concatenate([np.append(t, -1 - k) for k, t in enumerate(texts)]).astype(np.int64)
        self.order = suffix_array(self.words)
        self.heads = self.words[self.order]

    def longest(self, body: np.ndarray) -> tuple[int, int]:
        """Words of the longest match of a prefix of `body`, and where in its text of the block it begins."""
        lo, hi = int(np.searchsorted(self.heads, body[0])), int(np.searchsorted(self.heads, body[0], "right"))
        best, at = 0, -1
        while lo < hi:  # the longest matches stand beside the place of `body` in the order
            middle = (lo + hi) // 2
            start = int(self.order[middle])
            n = common(self.words[start:], body)
            if n > best:
                best, at = n, start
            if n == len(body):
                break
            if self.words[start + n] < body[n]:
                lo = middle + 1
            else:
                hi = middle
        return best, at - int(self.begin[np.searchsorted(self.begin, at, "right") - 1]) if best else -1

    def factors(self, body: np.ndarray, least: int) -> tuple[list[tuple[int, int, int]], list[int]]:
        """Factors (start, words, start in the block) from the left, and starts of runs of `least` words that the block lacks.

        A factor is the longest match of `least` words or more. The next is sought from the first run of `least` words
        across the last one's end, so every run of `least` words that the block has lies in a factor.
        """
        out, missing, i = [], [], 0
        while i + least <= len(body):
            n, at = self.longest(body[i:])
            if n >= least:
                out.append((i, n, at))
                i += n - least + 1
            else:
                missing.append(i)
                i += 1
        return out, missing
