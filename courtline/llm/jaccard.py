"""Exact Jaccard similarity join of documents on word n-grams, and the groups that its links make.

Rare-first prefix filtering: a document's n-grams are ordered by document frequency, rarest first, and two sets of
similarity t or more share an n-gram among their first n - ceil(t * n) + 1. N-grams of one document only are left out, so
a document without near copies joins nothing. Each row of the index carries its n-gram's place, what that allows a partner's size to
be, and a histogram of the n-grams after it: length, positional and suffix filters are conditions of the join,
before any text moves. What passes is verified once a pair, by the words of both texts; hashes only find candidates.

Equal sets are one class; only the classes' first documents are joined. In groups with a common n-gram, members are first
held against one member (a star); pairs within a component need no further look, and only pairs across components are
joined in full. So a group of near copies takes as many pairs as it has members, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema as spark_schema

from courtline.llm.batches import binary_lists, drop, kept_for, map_texts, written
from courtline.llm.components import connected_components
from courtline.llm.exchange import Distinct, Runs, chunk_of, chunked, pack_bits, plan, short, unpack_bits, unshort
from courtline.llm.hashing import mix

SHINGLE, PERCENT = 5, 75
#: Star rounds go on while the join across components would compare more pairs than this many times the prefix rows.
_FULL_FROM, _MOST_ROUNDS = 1000, 4
#: Bytes of each hash that the count travels with, beside the bucket. N-grams that agree in them are counted together, which
#: may only make them look commoner, alike in every document; the order stays one order and the join loses nothing.
_KEY = 5
#: Ranges of hashes in the histogram of the suffix filter, each counted up to 255 in a byte of one number.
_RANGES = 8
_I, _L, _B = pa.int32(), pa.int64(), pa.binary()
_ASKED = pa.schema({"chunk": _I, "bucket": _I, "hashes": _B, "times": _B})
_ANSWERED = pa.schema({"chunk": _I, "bucket": _I, "found": _B, "times": _B, "doc": _L, "digest": _B})
_SETS = pa.schema({"doc": _L, "size": _I, "words": _B, "prefix": pa.list_(pa.struct({"gram": _L, "pos": _I, "rest": _L}))})


def _need(size: np.ndarray | int, percent: int):
    """ceil(percent / 100 * size)"""
    return (percent * size + 99) // 100


def tokens(runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, token and run of each distinct n-gram of each text, by text, then hash.

    A token is the n-gram's hash. N-grams of one text that differ but have one hash are numbered, and all but the first get a token
    made of hash and number, so that a text has a token for each n-gram and two texts share at least as many tokens as n-grams.
    """
    order = np.lexsort((runs.first, runs.owner))
    token, text = runs.first[order], runs.owner[order]
    alike = np.flatnonzero((token[1:] == token[:-1]) & (text[1:] == text[:-1]))
    equal = runs.equal(order[alike], order[alike + 1])
    new = np.ones(len(order), bool)
    new[alike + 1] = ~equal
    collided = alike[~equal]
    if len(collided):
        token, new = _numbered(runs, order, token, text, new)
    return text[new], token[new], order[new]


def _numbered(runs: Runs, order: np.ndarray, token: np.ndarray, text: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    group = np.cumsum(np.concatenate(([True], (token[1:] != token[:-1]) | (text[1:] != text[:-1]))))
    token, new = token.copy(), new.copy()
    for g in np.unique(group[1:][new[1:] & (group[1:] == group[:-1])]).tolist():
        lo, hi = np.searchsorted(group, [g, g + 1])
        known: list[int] = []
        for i in range(lo, hi):
            new[i] = not (known and runs.equal(np.full(len(known), order[i]), order[known]).any())
            if new[i]:
                if known:
                    token[i] = mix(token[lo : lo + 1] + np.uint64(len(known)))[0]
                known.append(i)
    return token, new


def set_keys(texts: list[bytes], n: int) -> tuple[np.ndarray, list[bytes]]:
    """Size of each text's n-gram set, and a 128-bit digest of it, of 128 bits a n-gram."""
    runs = Runs(texts, n, lower=True, whole=True)
    text, token, run = tokens(runs)
    second = runs.hashes(1)[run]
    ends = np.cumsum(size := np.bincount(text, minlength=len(texts)))
    return size, [blake2b(token[e - k : e].tobytes() + second[e - k : e].tobytes(), digest_size=16).digest() for e, k in zip(ends.tolist(), size.tolist(), strict=True)]


def classes_of(docs: DataFrame, doc_id: str, text: str, n: int, chunks: int) -> DataFrame:
    """(doc, chunk, size, digest) of each row; equal n-gram sets have equal sizes and digests."""

    def make():
        def step(texts, _):
            size, digest = set_keys([t or b"" for t in texts], n)
            return {"size": size, "digest": digest}

        return step

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc"), chunk_of(doc_id, text, chunks).alias("chunk"), F.col(text).cast("string").alias("text"))
    return map_texts(rows, "text", "size int, digest binary", make, ["doc", "chunk"])


def _chosen(table: pa.Table, chosen: pa.Table, n: int) -> tuple[list[int], list[bytes]]:
    """Ids and texts of the chunk's rows that stand for a class, by id."""
    wanted = {(d, x) for d, x in zip(chosen.column("doc").to_pylist(), chosen.column("digest").to_pylist(), strict=True) if d is not None}
    texts, candidates = binary_lists(table.column("text").combine_chunks()), {d for d, _ in wanted}
    picked = sorted((i, texts[k] or b"") for k, i in enumerate(table.column("doc").to_pylist()) if i in candidates)
    if len({i for i, _ in picked}) != len(picked):  # rows that share an id: those whose set was chosen, once
        _, digests = set_keys([t for _, t in picked], n)
        once = {(i, x): t for (i, t), x in reversed(list(zip(picked, digests, strict=True)))}
        picked = sorted((i, t) for (i, x), t in once.items() if (i, x) in wanted)
    return [i for i, _ in picked], [t for _, t in picked]


def _ask(n: int, buckets: int, bits: int):
    def ask(key: tuple, table: pa.Table, chosen: pa.Table) -> pa.Table:
        kept_for(__name__)
        _, texts = _chosen(table, chosen, n)
        _, token, _ = tokens(Runs(texts, n, lower=True, whole=True, bits=bits))
        distinct = Distinct(token, buckets)
        times = np.bincount(distinct.of, minlength=len(distinct.keys)).astype(np.uint32)
        rows = [(key[0].as_py(), b, short(distinct.keys[lo:hi], _KEY), times[lo:hi].tobytes()) for b, lo, hi in distinct.ranges()]
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ASKED)], schema=_ASKED)

    return ask


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """For each chunk which of its n-grams two or more documents have, and how many do."""
    hashes = [unshort(x, _KEY) for x in table.column("hashes").to_pylist()]
    times = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("times").to_pylist()]).astype(np.int64)
    _, back = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(back, times)[back].astype(np.int64)
    at, rows = 0, []
    for own, chunk in zip(hashes, table.column("chunk").to_pylist(), strict=True):
        mine = total[at : at + len(own)]
        if (hit := mine > 1).any():
            rows.append((chunk, key[0].as_py(), pack_bits(hit), mine[hit].tobytes(), None, None))
        at += len(own)
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ANSWERED)], schema=_ANSWERED)


def _rests(token: np.ndarray, upto: int) -> np.ndarray:
    """For each of the first `upto` places, how many tokens of each range come after it, a byte each."""
    inside = (token >> np.uint64(61)).astype(np.int64)[:, None] == np.arange(_RANGES)
    after = inside.sum(0) - np.cumsum(inside[:upto], 0)
    return (np.minimum(after, 255).astype(np.uint64) << (np.uint64(8) * np.arange(_RANGES, dtype=np.uint64))).sum(1, dtype=np.uint64)


def _prefixes(n: int, buckets: int, percent: int, bits: int):
    def prefixes(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        is_answer = answers.column("doc").is_null()
        ids, texts = _chosen(table, answers.filter(pc.invert(is_answer)), n)
        text, token, _ = tokens(Runs(texts, n, lower=True, whole=True, bits=bits))
        own = answers.filter(is_answer)
        by_bucket = dict(zip(own.column("bucket").to_pylist(), zip(own.column("found").to_pylist(), own.column("times").to_pylist(), strict=True), strict=True))
        distinct = Distinct(token, buckets)
        times = np.ones(len(distinct.keys), np.int64)
        for bucket, lo, hi in distinct.ranges():
            if got := by_bucket.get(bucket):
                times[lo:hi][unpack_bits(got[0], hi - lo)] = np.frombuffer(got[1], np.int64)
        times = times[distinct.of]
        order = np.lexsort((token, times, text))  # rarest first; ties by the hash, alike everywhere
        token, times = token[order], times[order]
        size = np.bincount(text, minlength=len(ids))
        begin = np.cumsum(size) - size
        pos = np.arange(len(token)) - np.repeat(begin, size)
        longest = size - _need(size, percent) + 1
        used = np.flatnonzero((pos < np.repeat(longest, size)) & (times > 1))
        cut = np.searchsorted(used, np.append(begin, len(token)))
        some = [d for d in range(len(ids)) if cut[d + 1] > cut[d]]
        rest = [_rests(token[begin[d] : begin[d] + size[d]], int(longest[d]))[pos[used[cut[d] : cut[d + 1]]]] for d in some]
        prefix = pa.StructArray.from_arrays(
            [pa.array(token[used].view(np.int64)), pa.array(pos[used], _I), pa.array((np.concatenate(rest) if rest else np.zeros(0, np.uint64)).view(np.int64))], ["gram", "pos", "rest"]
        )
        offsets = pa.array([*(int(cut[d]) for d in some), len(used)], pa.int32())
        words = [b" ".join(texts[d].lower().split()) for d in some]
        return pa.table([pa.array([ids[d] for d in some], _L), pa.array(size[some], _I), pa.array(words, _B), pa.ListArray.from_arrays(offsets, prefix)], schema=_SETS)

    return prefixes


def shingles(words: bytes, n: int) -> set[tuple[bytes, ...]]:
    own = words.split()
    return set(zip(*(own[k:] for k in range(n)), strict=False)) if len(own) >= n else {tuple(own)} if own else set()


def verified(pairs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose n-gram sets have 100 * |A & B| >= percent * |A | B|, by their words."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), strict=True):
                if left != last:
                    last, own = left, shingles(left, n)
                other = shingles(right, n)
                both = len(own & other)
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    left, right = sets.select(F.col("doc").alias("a"), F.col("words").alias("wa")), sets.select(F.col("doc").alias("b"), F.col("words").alias("wb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "wa", "wb").mapInArrow(verify, "a bigint, b bigint")


_ROW = ("doc", "size", "most", "pos", "rest")


def _as(side: str) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in _ROW]


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length, positional and suffix filters for the rows x and y of one n-gram, the set of x being no larger.

    `most` is the size that a partner may have at most if the n-gram at `pos` is the first that both share: what follows it
    must make up the overlap, size - pos >= percent / (100 + percent) * (size + partner). The n-grams after it then differ by
    at most (100 - percent) / (100 + percent) * (size + partner) - pos - partner's pos, and by no less than their histograms do.
    """
    a, b = ({c: F.col(f"{s}_{c}") for c in _ROW} for s in (x, y))
    apart = sum((F.abs(F.shiftrightunsigned(a["rest"], 8 * k).bitwiseAND(255) - F.shiftrightunsigned(b["rest"], 8 * k).bitwiseAND(255)) for k in range(_RANGES)), F.lit(0))
    fits = (a["size"] <= b["size"]) & (b["size"] <= a["most"]) & (a["size"] <= b["most"]) & (100 * a["size"] >= percent * b["size"])
    return fits & ((100 + percent) * (apart + a["pos"] + b["pos"]) <= (100 - percent) * (a["size"] + b["size"]))


def _linked(percent: int) -> Column:
    return _may_link("a", "b", percent) | _may_link("b", "a", percent)


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of each group's least document with its other documents; rows: the n-gram and _ROW."""
    centre = rows.groupBy("gram").agg(F.min(F.struct(*_ROW)).alias("c"), F.count("*").alias("n")).where("n > 1").select("gram", "c.*").select("gram", *_as("a"))
    return rows.select("gram", *_as("b")).join(centre, "gram").where("b_doc <> a_doc").where(_linked(percent)).select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")).distinct()


def _either_way(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select("b", "a")).distinct()


def links_between(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all links of the join on `sets` (see _SETS).

    Only the smaller set of a pair must hold the n-gram so early that its partner may be as large as itself: these are the
    index rows, and the join across components compares them with all rows of their n-gram.
    """
    most = F.floor((F.col("size") - F.col("p.pos")) * (100 + percent) / percent).cast("bigint") - F.col("size")
    rows = sets.select("doc", "size", F.explode("prefix").alias("p")).select(F.col("p.gram").alias("gram"), "doc", F.col("size").cast("bigint").alias("size"), most.alias("most"), "p.pos", "p.rest")
    rows = written(rows, "prefix")
    pairs = written(_stars(rows, percent), "pairs")
    links = written(verified(pairs, sets, n, percent), "links")
    tried, n_rows = pairs, rows.count()
    for turn in range(_MOST_ROUNDS):
        comps = connected_components(links)
        placed = rows.join(comps, F.col("doc") == F.col("node"), "left").select("gram", *_ROW, F.coalesce("component", "doc").alias("comp"))
        each = placed.groupBy("gram", "comp").agg(F.count("*").alias("n"), F.sum((F.col("most") >= F.col("size")).cast("bigint")).alias("i"))
        groups = each.groupBy("gram").agg(F.max(F.struct("n", "comp")).alias("big"), F.sum("n").alias("n"), F.sum("i").alias("i"), F.sum(F.col("n") * F.col("i")).alias("own"), F.count("*").alias("comps"))
        groups = written(groups.where("comps > 1 AND i > 0").select("gram", F.col("big.comp").alias("big"), (F.col("n") * F.col("i") - F.col("own")).alias("left")), "groups")
        compared = groups.agg(F.sum("left")).first()[0] or 0
        if not compared:
            break
        open_rows = placed.join(groups.select("gram", "big"), "gram")
        other = open_rows.select("gram", *_as("b"), F.col("comp").alias("b_comp"))
        if compared <= _FULL_FROM * n_rows or turn == _MOST_ROUNDS - 1:
            index = open_rows.where("most >= size").select("gram", *_as("a"), F.col("comp").alias("a_comp"))
            new = index.join(other, "gram").where("b_comp <> a_comp AND (a_size < b_size OR b_doc < a_doc)").where(_may_link("a", "b", percent))
            new = new.select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")).distinct().join(_either_way(tried), ["a", "b"], "left_anti")
            links = links.union(written(verified(new, sets, n, percent), "links"))
            break
        # a star around one member of each group's smaller components, tried against all others
        centre = open_rows.where("comp <> big").groupBy("gram").agg(F.min(F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), *_ROW, "comp")).alias("c"))
        centre = centre.select("gram", "c.*").select("gram", *_as("a"), F.col("comp").alias("a_comp"))
        new = other.join(centre, "gram").where("b_comp <> a_comp").where(_linked(percent)).select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")).distinct()
        pairs = written(new.join(_either_way(tried), ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(pairs)
        links = links.union(written(verified(pairs, sets, n, percent), "links"))
    drop(rows)
    return links


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, percent: int = PERCENT, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of each row.

    Two documents link when 100 * |A & B| >= percent * |A | B|, A and B their sets of n-word shingles of the text with A-Z
    lower-cased; a text of fewer words is one shingle; null texts and those without words have no shingles and no links.
    Shingles are compared by their words; only equal sets are known by a 128-bit digest. Ids are integers; rows with a null id
    link with nothing and get a null component; rows with one id are one document with the links of them all. Other columns
    are not looked at. A text of any length is handled by one task. `hash_bits` under 64 is for tests of collisions.
    """
    chunks, buckets, parts = plan(docs, text)
    keys = written(classes_of(docs, doc_id, text, n, chunks), "classes")
    kinds = keys.where("size > 0 AND doc IS NOT NULL").groupBy("size", "digest").agg(F.min(F.struct("doc", "chunk")).alias("f"))
    kinds = written(kinds.select("size", "digest", F.col("f.doc").alias("first"), "f.chunk"), "kinds")
    chosen = kinds.select("chunk", F.col("first").alias("doc"), "digest")
    table = chunked(docs, doc_id, text, chunks, parts).groupBy("chunk")
    asked = table.cogroup(chosen.groupBy("chunk")).applyInArrow(_ask(n, buckets, hash_bits), spark_schema(_ASKED)).repartition(parts, "bucket")
    answered = asked.groupBy("bucket").applyInArrow(_answer, spark_schema(_ANSWERED))
    side = answered.unionByName(chosen, allowMissingColumns=True)
    sets = written(table.cogroup(side.groupBy("chunk")).applyInArrow(_prefixes(n, buckets, percent, hash_bits), spark_schema(_SETS)), "sets")
    links = links_between(sets, n, percent)
    comps = connected_components(links.union(_shared_ids(keys, kinds)))
    drop(sets)
    named = kinds.join(comps, F.col("first") == F.col("node"), "left").select("size", "digest", F.coalesce("component", "first").alias("comp"))
    out = keys.join(named, ["size", "digest"], "left")
    return out.select(F.col("doc").alias(doc_id), F.col("size").cast("bigint").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("comp", "doc")).alias("component_id"))


def _shared_ids(keys: DataFrame, kinds: DataFrame) -> DataFrame:
    """Edges from an id that stands in several rows to the first id of each of its classes."""
    known = keys.where("size > 0 AND doc IS NOT NULL")
    repeated = known.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    return known.join(repeated, "doc", "left_semi").join(kinds.drop("chunk"), ["size", "digest"]).where("doc <> first").select(F.col("doc").alias("a"), F.col("first").alias("b"))
