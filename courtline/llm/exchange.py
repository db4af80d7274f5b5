"""Questions about every run of words of a corpus, asked chunk by chunk and answered bucket by bucket.

A chunk is a fixed group of rows (by a hash of id and text), a bucket a fixed group of hashes. A chunk sends each bucket
one row with its distinct hashes, so a run that a third of all rows share reaches its bucket once a chunk; the
bucket's answers go back in the same order, and the chunk works out the same distinct hashes again to read them. Hashes
cross the network as packed arrays, never as rows, and no group grows with the commonest hash. Equal hashes are
candidates only: the operators compare the words before they act on one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.llm.batches import partitions
from courtline.llm.hashing import Words, run_hashes

#: Text bytes of a chunk, of the input that a bucket stands for, and of a partition of chunks.
CHUNK_BYTES, BUCKET_BYTES, PARTITION_BYTES = 4 << 20, 8 << 20, 16 << 20


def plan(docs: DataFrame, text: str) -> tuple[int, int, int]:
    """Number of chunks, of buckets and of partitions, in proportion to the text and no fewer than the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    least = partitions(docs.sparkSession)
    return max(2 * least, total // CHUNK_BYTES), max(least, total // BUCKET_BYTES), max(least, total // PARTITION_BYTES)


def chunk_of(doc_id: str, text: str, chunks: int) -> Column:
    """Rows without an id, and rows that share one, are dealt out by their texts."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text).cast("string")), F.lit(chunks)).cast("int"), F.lit(0))


def chunked(docs: DataFrame, doc_id: str, text: str, chunks: int, parts: int) -> DataFrame:
    """(chunk, doc, text) with a null id kept as null, dealt out by chunk once for all that use it."""
    rows = docs.select(chunk_of(doc_id, text, chunks).alias("chunk"), F.col(doc_id).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.repartition(parts, "chunk")


class Runs:
    """All runs of `n` words of some texts, text by text: their first words, hashes and owners.

    With `whole`, a text of fewer words, but not none, has one run, all of it. The hashes find and order runs; `equal` compares
    their words.
    """

    def __init__(self, texts: list[bytes], n: int, lower: bool, whole: bool, bits: int = 64) -> None:
        self.n, self.words = n, Words(texts, lower)
        own = self.words.counts
        #: first word of each text
        self.begin = np.cumsum(own) - own
        short = (own < n) & (own > 0) & whole
        self.counts = np.where(short, 1, np.maximum(own - n + 1, 0))
        self.owner = np.repeat(np.arange(len(own)), self.counts)
        self.starts = np.arange(len(self.owner)) + np.repeat(self.begin - (np.cumsum(self.counts) - self.counts), self.counts)
        self.length = np.minimum(own, n)[self.owner]
        #: fewer bits than 64 are for tests of collisions
        self.first = self.hashes(0) >> np.uint64(64 - bits)

    def hashes(self, which: int) -> np.ndarray:
        words = self.words.hashes(which)
        if len(self.length) and self.length.min() < self.n:
            out = np.zeros(len(self.starts), np.uint64)
            for length in np.unique(self.length).tolist():
                at = self.length == length
                out[at] = run_hashes(words, self.starts[at], length, which)
            return out
        return run_hashes(words, self.starts, self.n, which)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether run a[i] has the words of run b[i]."""
        same = self.length[a] == self.length[b]
        for k in range(self.n):
            i = np.flatnonzero(same & (self.length[a] > k))
            same[i] = self.words.equal(self.starts[a[i]] + k, self.starts[b[i]] + k)
        return same


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)


class Distinct:
    """The distinct keys of a chunk, dealt to buckets; within a bucket in the order of their first use."""

    def __init__(self, keys: np.ndarray, buckets: int) -> None:
        keys, at, back = np.unique(keys, return_index=True, return_inverse=True)
        bucket = bucket_of(keys, buckets)
        order = np.lexsort((at, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        #: of each distinct key: itself, its first use; of each use: its distinct key
        self.keys, self.at, self.of = keys[order], at[order], place[back]
        own = bucket[order]
        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        #: buckets in use, and the range of distinct keys of each
        self.buckets, self.lo, self.hi = own[cut], cut, np.append(cut[1:], len(own))[: len(cut)]

    def ranges(self):
        return zip(self.buckets.tolist(), self.lo.tolist(), self.hi.tolist(), strict=True)


def short(keys: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unshort(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
