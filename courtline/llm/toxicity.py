"""Toxicity by nearest labelled examples: exact cosine of weighted TF-IDF vectors over all terms, calibrated weighted votes."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.batches import binary_lists, give_back, kept_for, map_texts, slices

#: Labelled rows used at most, neighbours, queries that are searched for at once, texts whose terms are counted at once, texts kept in a memo.
MAX_LABELLED, NEIGHBOURS, QUERIES, TEXTS, MEMO = 12_000, 16, 256, 64, 4_000
#: A term in one of so many rows, and in so many rows, is common: it stands in the dense part of the index.
COMMON_SHARE, COMMON_ROWS = 16, 64
#: Rows of a block, groups of like rows that blocks are cut from, and blocks that are looked at first.
BLOCK, GROUPS, FIRST = 64, 48, 6
#: Postings that are weighted at once.
PIECE = 1 << 18
PREFIX = 4
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words in ASCII lower case: runs of letters, digits and bytes above 0x7F."""
    return raw.translate(_FOLD).split() if raw else []


def prefix_term(word: bytes) -> bytes:
    return b"^" + word.decode("utf-8", "replace")[:PREFIX].encode()


class Vocabulary:
    """Numbers of the terms, words and prefixes alike."""

    def __init__(self, terms: dict[bytes, int]) -> None:
        self.terms = terms

    def __getstate__(self) -> dict:
        """One string of all names and their numbers: a worker makes a dictionary only if it looks words up, and only one."""
        names, numbers = self._listed()
        return {"names": b" ".join(names), "numbers": numbers}

    def _listed(self) -> tuple[list[bytes], np.ndarray]:
        if "names" in self.__dict__:
            return self.names.split(), self.numbers
        return list(self.terms), np.fromiter(self.terms.values(), np.int32, len(self.terms))

    def __len__(self) -> int:
        return len(self.numbers) if "numbers" in self.__dict__ else len(self.terms)

    @cached_property
    def terms(self) -> dict[bytes, int]:
        names, numbers = self._listed()
        return dict(zip(names, numbers.tolist(), strict=True))

    @cached_property
    def tables(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, dict[bytes, int]]:
        """Place of each word that is a term, its term and that of its prefix by place (-1: no prefix), and the prefix terms by their bytes."""
        names, numbers = self._listed()
        starts = np.fromiter((t.startswith(b"^") for t in names), bool, len(names))
        heads = {t[1:]: n for t, n in zip(compress(names, starts), numbers[starts].tolist(), strict=True)}
        words = list(compress(names, ~starts))
        prefixes = np.fromiter((heads.get(prefix_term(w)[1:], -1) if len(w) > PREFIX else -1 for w in words), np.int32, len(words))
        return {w: k for k, w in enumerate(words)}, numbers[~starts], prefixes, heads

    def counts(self, raw: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text in order, and their counts."""
        return self.counts_of([raw])[0]

    def counts_of(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The known terms of each text in order, and their counts."""
        return [pair for lo in range(0, len(texts), TEXTS) for pair in self._counted(texts[lo : lo + TEXTS])]

    def _counted(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """All words of some texts are looked up together; a key is the number of a text and that of a term."""
        places, terms, prefixes, heads = self.tables
        words = [words_of(t) for t in texts]
        base = np.arange(len(texts) + 1) * max(len(self), 1)
        owner = np.repeat(base[:-1], np.fromiter(map(len, words), np.int64, len(words)))
        every = list(chain.from_iterable(words))
        at = np.fromiter(map(places.get, every, repeat(-1)), np.int64, len(every))
        new, at = at < 0, at[at >= 0]
        other = [heads.get(w[:PREFIX] if w[:PREFIX].isascii() else prefix_term(w)[1:], -1) if len(w) > PREFIX else -1 for w in compress(every, new.tolist())]
        known, prefix, other = owner[~new], prefixes[at], np.array(other, np.int64)
        keys = np.concatenate((known + terms[at], known[prefix >= 0] + prefix[prefix >= 0], owner[new][other >= 0] + other[other >= 0]))
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        count, keys = np.diff(first, append=len(keys)).astype(np.int32), keys[first]
        ends = np.searchsorted(keys, base).tolist()
        return [((keys[a:b] - lo).astype(np.int32), count[a:b]) for a, b, lo in zip(ends, ends[1:], base.tolist(), strict=False)]


def _pair(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    order = sorted(counts)
    return np.array(order, np.int32), np.array([counts[t] for t in order], np.int32)


def _groups(rows: np.ndarray, rounds: int = 4) -> np.ndarray:
    """The group of each row: nearest of GROUPS centres by the dot product, from evenly spaced rows on."""
    norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]
    first = np.linspace(0, len(rows) - 1, min(GROUPS, len(rows))).astype(int)
    centres = rows[first] / norm[first]
    for _ in range(rounds):
        group = (rows @ centres.T).argmax(1)  # a row's length changes nothing here
        for g in range(len(centres)):
            if (own := group == g).any():
                mean = (rows[own] / norm[own]).mean(0)
                centres[g] = mean / max(float(np.sqrt(mean @ mean)), 1e-9)
    return group


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin there and have that many."""
    ends = np.cumsum(size)
    out = np.repeat(begin - ends + size, size)
    out += np.arange(len(out))
    return out


class Index:
    """Block-max inverted index of the unit vectors of the labelled rows, by all of their terms.

    Like rows stand in one block. Postings of rare terms are added up; the weights of common terms are a dense matrix, of which
    each block keeps the maximum of every term. A block whose bound (its best sum of rare terms, and its maxima times the
    query) is under the k-th best score is skipped.
    """

    def __init__(self, terms: dict[bytes, int], idf: np.ndarray, rows: list[tuple[int, int, dict[int, int] | tuple[np.ndarray, np.ndarray]]]) -> None:
        """rows: (id, label, {term number: count}, or the numbers in order and the counts); those without a term are only counted."""
        self.words, self.idf = Vocabulary(terms), np.asarray(idf, float)
        pairs = [(i, y, _pair(c) if isinstance(c, dict) else c) for i, y, c in sorted(rows, key=lambda r: r[0])]
        full = [r for r in pairs if len(r[2][0])]
        self.ids = np.array([r[0] for r in full], np.int64)
        self.labels = np.array([r[1] for r in full], np.float64)
        empty = [r[1] for r in pairs if not len(r[2][0])]
        self.empty_rate = (sum(empty) + 0.5) / (len(empty) + 1.0) if empty else None
        self.rate = (sum(r[1] for r in pairs) + 0.5) / (len(pairs) + 1.0)
        self.size = np.array([len(r[2][0]) for r in full], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.term = np.concatenate([r[2][0] for r in full]) if full else np.zeros(0, np.int32)
        self.count = np.concatenate([r[2][1] for r in full]) if full else np.zeros(0, np.int32)
        self.norm = np.array([math.sqrt(float(raw @ raw)) for raw in (self._raw(*r[2]) for r in full)])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "search"}  # each worker makes its own

    def _raw(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (1 + np.log(count)) * self.idf[term]

    def vector(self, counts: dict[int, int]) -> list[tuple[int, float]]:
        term, count = _pair(counts)
        raw = self._raw(term, count)
        norm = math.sqrt(float(raw @ raw)) or 1.0
        return list(zip(term.tolist(), (raw / norm).tolist(), strict=True))

    @cached_property
    def search(self) -> tuple[np.ndarray, ...]:
        """Column of each term in the dense part (-1: none), the dense part and its maxima by block, where postings begin, the
        postings (the place as an int32 and the weight as a float32, of which 8 bytes are read at once), and the row that stands
        in each place: places are dealt to groups of like rows, the last block is filled up."""
        n, freq = len(self.ids), np.bincount(self.term, minlength=len(self.idf))
        common = np.flatnonzero((freq * COMMON_SHARE >= n) & (freq >= COMMON_ROWS))
        column = np.full(len(self.idf), -1, np.int32)
        column[common] = np.arange(len(common))
        row = np.repeat(np.arange(n, dtype=np.int32), self.size)
        weight, dense = np.empty(len(row), np.float32), np.zeros((n + -n % BLOCK, len(common)), np.float32)
        for lo in range(0, len(row), PIECE):  # a worker has no room for all postings in double precision
            own = slice(lo, lo + PIECE)
            weight[own] = self._raw(self.term[own], self.count[own]) / self.norm[row[own]]
            at = column[self.term[own]]
            dense[row[own][at >= 0], at[at >= 0]] = weight[own][at >= 0]
        order = np.argsort(_groups(dense[:n]), kind="stable")
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        dense[:n] = dense[order]
        rare = np.flatnonzero(column[self.term] < 0).astype(np.int32 if len(row) < 1 << 31 else np.int64)
        rare = rare[np.argsort(self.term[rare], kind="stable")]
        freq[common] = 0
        postings = np.empty(len(rare), np.int64)
        postings.view(np.int32)[::2], postings.view(np.float32)[1::2] = place[row[rare]], weight[rare]
        return column, dense, dense.reshape(len(dense) // BLOCK, BLOCK, len(common)).max(1), np.concatenate(([0], np.cumsum(freq))), postings, order

    def nearest(self, counts: dict[int, int], k: int = NEIGHBOURS) -> list[tuple[float, int, float]]:
        return self.nearest_of([_pair(counts)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, leave: list[int] | None = None) -> list[list[tuple[float, int, float]]]:
        """The exact k rows of highest cosine of each query, as (cosine, id, label); ties by id. `leave`: row numbers that don't count.

        The rows of blocks that may hold one of the k are scored in single precision, and those that may be among the k by its
        error bound are scored again in double precision. Rows of cosine 0 are no neighbours.
        """
        if not queries or not len(self.ids):
            return [[] for _ in queries]
        column, _, most, begin, _, order = self.search
        cut = np.cumsum([0, *(len(q[0]) for q in queries)])
        term, owner = np.concatenate([q[0] for q in queries]), np.repeat(np.arange(len(queries)), np.diff(cut))
        raw = self._raw(term, np.concatenate([q[1] for q in queries]))
        norm = np.sqrt(np.bincount(owner, raw * raw, minlength=len(queries)))
        unit, at = raw / np.where(norm > 0, norm, 1)[owner], column[term]
        asked = np.zeros((len(queries), most.shape[1]), np.float32)
        asked[owner[at >= 0], at[at >= 0]] = unit[at >= 0]
        few = np.flatnonzero(at < 0)
        first, size, part = begin[term[few]], begin[term[few] + 1] - begin[term[few]], unit[few]
        ends = np.searchsorted(few, cut).tolist()
        lists = [(first[a:b], size[a:b], part[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        bound, whole = asked @ most.T, np.zeros(len(self.idf))
        place = np.argsort(order)[leave] if leave is not None else None
        out: list[list[tuple[float, int, float]]] = [[] for _ in queries]
        like = np.argsort(bound.argmax(1), kind="stable")  # queries that want the same blocks go together
        for own in np.split(like, range(QUERIES, len(like), QUERIES)):
            scores, least = self._scores([lists[i] for i in own], asked[own], bound[own], k, None if leave is None else place[own])
            for i, score, floor in zip(own.tolist(), scores, least.tolist(), strict=True):
                terms = term[cut[i] : cut[i + 1]]
                whole[terms] = unit[cut[i] : cut[i + 1]] * self.idf[terms]
                out[i] = self._exact(whole, len(terms), score, floor, k)
                whole[terms] = 0
        return out

    def _scores(self, lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], asked: np.ndarray, bound: np.ndarray, k: int, leave: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines by place (those of skipped blocks are 0), and a bound of the k-th best of each query. lists: where the postings of
        each query's rare terms begin, their number, and the query's weight of the term."""
        _, dense, most, _, postings, _ = self.search
        n, n_blocks, every = len(dense), len(most), np.arange(len(lists))
        rare = np.zeros((len(lists), n), np.float32)
        for j, (first, size, unit) in enumerate(lists):
            if len(size):
                own = postings[_ranges(first, size)]
                rare[j] = np.bincount(own.view(np.int32)[::2], np.repeat(unit, size) * own.view(np.float32)[1::2], minlength=n)
        bound = (bound + rare.reshape(len(lists), n_blocks, BLOCK).max(2)) * (1 + 1e-4) + 1e-7
        scores = np.zeros_like(rare)

        def look(wanted: np.ndarray) -> None:
            edges = np.flatnonzero(np.diff(np.concatenate(([False], wanted, [False])).astype(np.int8))) * BLOCK
            for lo, hi in edges.reshape(-1, 2).tolist():
                scores[:, lo:hi] = asked @ dense[lo:hi].T + rare[:, lo:hi]
            if leave is not None:
                scores[every, leave] = 0

        top = np.argpartition(-bound, min(FIRST, n_blocks) - 1, axis=1)[:, :FIRST]
        first = np.zeros(n_blocks, bool)
        first[top] = True
        look(first)
        seen = np.take_along_axis(scores.reshape(len(lists), n_blocks, BLOCK), top[:, :, None], 1).reshape(len(lists), -1)
        least = (np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else np.zeros(len(lists))) * (1 - 1e-4)
        look((bound >= least[:, None]).any(0) & ~first)
        return scores, least

    def _exact(self, whole: np.ndarray, n_terms: int, score: np.ndarray, floor: float, k: int) -> list[tuple[float, int, float]]:
        """whole: by term, the query's weight times the IDF."""
        near = np.flatnonzero(score >= floor if floor > 0 else score > 0)
        if len(near) > k:
            # all summands are positive: the relative error is at most the number of terms times that of one operation
            near = near[score[near] >= np.partition(score[near], -k)[-k] * (1 - 2.4e-7 * (n_terms + 8)) - 2e-9]
        if not len(near):
            return []
        near = np.sort(self.search[-1][near])
        size = self.size[near]
        where = _ranges(self.begin[near], size)
        products = whole[self.term[where]]
        products *= 1 + np.log(self.count[where])
        exact = np.round(np.add.reduceat(products, np.cumsum(size) - size) / self.norm[near], 9)
        best = np.lexsort((self.ids[near], -exact))[:k]
        return list(zip(exact[best].tolist(), self.ids[near[best]].tolist(), self.labels[near[best]].tolist(), strict=True))

    def vote(self, found: list[tuple[float, int, float]]) -> float:
        """Labels weighted by nearness, 1 / (distance + 0.1), with one neutral vote at the base rate."""
        weights = [s / (1 - s + 0.1) for s, _, _ in found]
        return (sum(w * y for w, (_, _, y) in zip(weights, found, strict=True)) + 0.1 * self.rate) / (sum(weights) + 0.1)

    def left_out(self, rows: list[int]) -> list[float]:
        """The vote on each of those rows by the others."""
        own = [(self.term[b : b + n], self.count[b : b + n]) for b, n in zip(self.begin[rows].tolist(), self.size[rows].tolist(), strict=True)]
        return [self.vote(found) for found in self.nearest_of(own, leave=rows)]

    def calibrate(self, votes: np.ndarray) -> tuple[float, float]:
        """Fits score = logistic(a + b * vote) on leave-one-out votes of the labelled rows (Newton, small ridge)."""
        if not len(votes):
            return 0.0, 0.0
        x, y = votes - 0.5, self.labels
        y = (y * len(y) + 0.5) / (len(y) + 1)  # no infinite odds
        design, w = np.stack([np.ones_like(x), x], 1), np.array([0.0, 6.0])
        prior = w.copy()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            hessian = (design * (p * (1 - p))[:, None]).T @ design + np.eye(2)
            step = np.linalg.solve(hessian, design.T @ (y - p) - (w - prior))
            w = w + np.clip(step, -2, 2)
            if abs(step).max() < 1e-9:
                break
        return float(w[0]), float(w[1])

    def score(self, texts: list[bytes | None], odds: tuple[float, float], memo: dict) -> list[tuple[float, list[tuple[float, int, float]]]]:
        keys = [hashlib.blake2b(t or b"", digest_size=16).digest() for t in texts]
        if len(memo) > MEMO:
            memo.clear()
        todo = {k: t for k, t in zip(keys, texts, strict=True) if k not in memo}
        counts = dict(zip(todo, self.words.counts_of([*todo.values()]), strict=True))
        some = [k for k, c in counts.items() if len(c[0])]
        done = dict.fromkeys(counts, ((self.rate if self.empty_rate is None else self.empty_rate), []))
        for k, found in zip(some, self.nearest_of([counts[k] for k in some]), strict=True):
            at = odds[0] + odds[1] * (self.vote(found) - 0.5)
            done[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, at)))), found
        memo.update(done)
        return [memo[k] for k in keys]


def _vectors(rows: DataFrame, used: dict[int, int]) -> tuple[dict[bytes, int], list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]]:
    """All terms of the rows (i, t), numbered, and (id, label, (terms, counts)) of each row in `used`."""

    def make():
        def step(texts, _):
            counts = [Counter(words_of(t)) for t in texts]
            return {"words": [b" ".join(c) for c in counts], "n": [np.array([*c.values()], np.int32).tobytes() for c in counts]}

        return step

    got: dict[int, tuple[bytes, bytes]] = {}
    for r in map_texts(rows, "t", "words binary, n binary", make, ["i"]).toLocalIterator():
        if r.i in used:  # of rows that share an id, one
            own = (bytes(r.words), bytes(r.n))
            got[r.i] = min(got.get(r.i, own), own)
    terms: dict[bytes, int] = {}
    prefix: dict[int, int] = {}  # of a word's number
    out = []
    for i in sorted(got):
        names, n = got.pop(i)
        own = []
        for word in names.split():
            if (t := terms.get(word)) is None:
                t = terms[word] = len(terms)
                if len(word) > PREFIX:
                    prefix[t] = terms.setdefault(prefix_term(word), len(terms))
            own.append(t)
        times = np.frombuffer(n, np.int32)
        long = [k for k, t in enumerate(own) if t in prefix]
        every = np.array(own + [prefix[own[k]] for k in long], np.int32)
        term, back = np.unique(every, return_inverse=True)
        out.append((i, used[i], (term, np.bincount(back, np.concatenate((times, times[long])), minlength=len(term)).astype(np.int32))))
    return terms, out


def _document_frequencies(docs: DataFrame, text: str, terms: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Number of texts in `docs`, and of those with each term."""
    words = docs.sparkSession.sparkContext.broadcast(Vocabulary(terms))

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for(__name__)
        have, n = np.zeros(len(words.value), np.int64), 0
        for batch in batches:
            for part in slices(batch, "t"):
                texts = [raw for raw in binary_lists(part.column("t")) if raw]
                n += len(texts)
                for term, _ in words.value.counts_of(texts):
                    have[term] += 1
        some = np.flatnonzero(have)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(have[some], n), pa.int64())})

    got = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(tally, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    words.unpersist()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(len(terms), np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int = MAX_LABELLED) -> Index:
    """The index over a sample of at most `max_rows` labelled rows, chosen by a hash of the id.

    Of equal texts only that with the smallest id is used. All terms of the sample count: the weight of a term is its IDF over all
    of `docs`, times sqrt(1 + chi-square) of its association with the label over the sample.
    """
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg(F.max("y").alias("y"))
    chosen = known.withColumn("h", F.xxhash64("i")).orderBy("h", "i").limit(max_rows).select("i", "y")
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "i")
    ids = rows.select("i", "y", F.xxhash64("t").alias("x"), F.octet_length("t").alias("n")).collect()
    first: dict[tuple, tuple[int, int]] = {}
    for r in sorted(ids, key=lambda r: r.i):
        first.setdefault((r.x, r.n), (r.i, r.y))
    used = {i: y for i, y in first.values()}
    if not used:
        return Index({}, np.zeros(0), [])
    terms, vectors = _vectors(rows, used)
    n, have = _document_frequencies(docs, text, terms)
    both = [np.zeros(len(terms)), np.zeros(len(terms))]
    for _, y, (term, _) in vectors:
        both[y > 0][term] += 1
    n1 = sum(y > 0 for _, y, _ in vectors)
    n0, total, sample = len(vectors) - n1, both[0] + both[1], len(vectors)
    excess = both[1] * n0 - both[0] * n1
    chi2 = sample * excess * excess / (max(n0, 1) * max(n1, 1) * total * (sample - total + 0.5))
    out = Index(terms, (1 + np.log((1 + n) / (1 + have))) * np.sqrt(1 + chi2), vectors)
    del vectors
    give_back()
    return out


def calibrated(spark, index: Index):
    """The index as a broadcast, and a and b of Index.calibrate."""
    model, n = spark.sparkContext.broadcast(index), len(index.ids)

    def votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for(__name__)
        for batch in batches:
            row = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_pydict({"id": pa.array(row, pa.int64()), "vote": pa.array(model.value.left_out(row), pa.float64())})

    got = spark.range(0, n, 1, max(1, min(24, n // 64))).mapInArrow(votes, "id bigint, vote double").collect() if n else []
    odds = index.calibrate(np.array([r.vote for r in sorted(got, key=lambda r: r.id)]))
    del index, got
    give_back()
    return model, odds


def score_toxicity(docs: DataFrame, train: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", keep: list[str] | None = None, max_rows: int = MAX_LABELLED) -> DataFrame:
    """score (0 to 1) and evidence, the nearest labelled rows as (doc_id, cosine, label), of every whole text of `docs`.

    Fits on `labels` joined to the texts of `train`, on a bounded sample. Null and empty texts, and those without a known
    term, get the rate of label 1 among labelled rows without one, and no evidence. With no labelled rows all scores are 0.5.
    """
    model, odds = calibrated(docs.sparkSession, fit(train, labels, doc_id, text, label, max_rows))

    def make():
        memo: dict = {}

        def step(texts, _):
            rows = model.value.score(texts, odds, memo)
            found = [x for r in rows for x in r[1]]
            columns = (pa.array([x[1] for x in found], pa.int64()), pa.array([x[0] for x in found], pa.float64()), pa.array([int(x[2]) for x in found], pa.int32()))
            ends = np.cumsum([0, *(len(r[1]) for r in rows)])
            evidence = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["doc_id", "cosine", "label"]))
            return {"score": [r[0] for r in rows], "evidence": evidence}

        return step

    return map_texts(docs, text, "score double, evidence array<struct<doc_id:bigint,cosine:double,label:int>>", make, keep or [doc_id])
