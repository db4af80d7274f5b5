"""Substring dedup by relative Lempel-Ziv factoring of each document against earlier documents as reference blocks.

Every document is a reference block, indexed by its seeds, the runs of 13 words; the index is spread over buckets (see
exchange) and names the earliest block of each seed's hash. A stretch of seeds of one block goes there as words, and the
block's suffix array factors it: the longest match from the left, then the next from the first seed across its end. Factors
of a seed or more are the duplicate spans. The words decide: a seed that its block turns out not to have (its hash
collided) is looked for by its words in every chunk that has the hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema as spark_schema

from courtline.llm.batches import binary_lists, kept_for
from courtline.llm.exchange import Distinct, Runs, bucket_of, chunked, pack_bits, plan, short, unpack_bits, unshort
from courtline.llm.factoring import Block
from courtline.llm.hashing import Lexicon, pieces

SEED = 13
#: Stands for a null id: after every other, and earlier than none.
_LAST = np.iinfo(np.int64).max
#: Bytes of a seed's hash that travel beside its bucket.
_KEY = 6

_I, _L, _B = pa.int32(), pa.int64(), pa.binary()
#: Keys are never null, so that no plan adds a filter below an exchange that another plan uses too.
_CHUNK, _BUCKET = pa.field("chunk", _I, False), pa.field("bucket", _I, False)
_ASKED = pa.schema([_CHUNK, _BUCKET, ("hashes", _B), ("docs", _B), ("counts", _B)])
_ANSWERED = pa.schema([_CHUNK, _BUCKET, ("found", _B), ("sources", _B), ("homes", _B), ("times", _B)])
_STRETCHES = pa.schema({"home": _I, "chunk": _I, "sources": pa.list_(_L), "bodies": pa.list_(_B), "uses": pa.list_(_B)})
_FOUND = pa.schema([_CHUNK, *{"rows": _B, "starts": _B, "words": _B, "sources": _B, "ats": _B}.items()])
_FACTORED = _FOUND.append(pa.field("missing", pa.list_(pa.struct({"row": _I, "start": _I, "words": _B}))))
_MISSING = pa.schema([_BUCKET, ("key", _L), _CHUNK, ("row", _I), ("start", _I), ("words", _B)])
_HELD = pa.schema([_CHUNK, ("keys", _B)])
_SPELLED = pa.schema({"words": _B, "doc": _L})
_FACTORS = pa.list_(pa.struct({"start": _I, "words": _I, "source": _L, "source_start": _I}))
_OUT = pa.schema({"doc": _L, "n_words": _L, "n_removed": _L, "kept_text": pa.string(), "factors": _FACTORS})


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _ordered(table: pa.Table) -> tuple[np.ndarray, list[bytes], list[int]]:
    """Ids (null as the last), texts and places in the table, by id, then text: alike wherever a chunk is read."""
    ids = table.column("doc").fill_null(_LAST).to_numpy()
    texts = [t or b"" for t in binary_lists(table.column("text").combine_chunks())]
    order = np.argsort(ids, kind="stable").tolist()
    if len(np.unique(ids)) < len(ids):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order], order


def _rle(*values: np.ndarray) -> list[np.ndarray]:
    """Values without the repeats of neighbours (equal in all of them), and how often each stands there."""
    new = np.zeros(len(values[0]), bool)
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    new[:1] = True
    cut = np.flatnonzero(new)
    return [*(v[cut] for v in values), np.diff(np.append(cut, len(new))).astype(np.int32)]


def _ask(seed: int, buckets: int, bits: int):
    def ask(key: tuple, table: pa.Table) -> pa.Table:
        """One row a bucket: the chunk's distinct seeds, and the first document of each."""
        kept_for(__name__)
        ids, texts, _ = _ordered(table)
        runs = Runs(texts, seed, lower=False, whole=False, bits=bits)
        distinct = Distinct(runs.first, buckets)
        owner, rows = ids[runs.owner][distinct.at], []
        for bucket, lo, hi in distinct.ranges():
            docs, counts = _rle(owner[lo:hi])
            rows.append((key[0].as_py(), bucket, short(distinct.keys[lo:hi], _KEY), docs.tobytes(), counts.tobytes()))
        return _rows(_ASKED, rows)

    return ask


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """For each chunk which of its hashes begin in an earlier document, and the first such document of each, with its chunk."""
    hashes = [unshort(x, _KEY) for x in table.column("hashes").to_pylist()]
    chunks = table.column("chunk").to_pylist()
    docs = [np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.int32)) for d, c in zip(table.column("docs").to_pylist(), table.column("counts").to_pylist(), strict=True)]
    h, d = np.concatenate(hashes), np.concatenate(docs)
    home = np.repeat(np.array(chunks, np.int32), [len(x) for x in hashes])
    order = np.lexsort((home, d, h))
    group = np.cumsum(np.concatenate(([0], h[order][1:] != h[order][:-1])))
    begin = np.searchsorted(group, np.arange(group[-1] + 1))
    least, at_home = np.empty(len(h), np.int64), np.empty(len(h), np.int32)
    least[order], at_home[order] = d[order][begin][group], home[order][begin][group]
    found, at, rows = least < d, 0, []
    for own, chunk in zip(hashes, chunks, strict=True):
        hit = found[at : at + len(own)]
        if hit.any():
            rows.append((chunk, key[0].as_py(), pack_bits(hit), *(x.tobytes() for x in _rle(least[at : at + len(own)][hit], at_home[at : at + len(own)][hit]))))
        at += len(own)
    return _rows(_ANSWERED, rows)


def _words(raw: bytes) -> list[bytes]:
    return [w for piece in pieces(raw) for w in piece.split()]


def _stretches(seed: int, buckets: int, bits: int):
    def stretches(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """The chunk's stretches of seeds of one earlier document, as words, for the chunk that holds it."""
        ids, texts, _ = _ordered(table)
        runs = Runs(texts, seed, lower=False, whole=False, bits=bits)
        distinct = Distinct(runs.first, buckets)
        least = ids[runs.owner][distinct.at]
        homes = np.full(len(distinct.keys), key[0].as_py(), np.int32)
        got = dict(zip(answers.column("bucket").to_pylist(), zip(*(answers.column(c).to_pylist() for c in ("found", "sources", "homes", "times")), strict=True), strict=True))
        for bucket, lo, hi in distinct.ranges():
            if bucket in got:
                found, sources, where, times = got[bucket]
                hit = unpack_bits(found, hi - lo)
                times = np.frombuffer(times, np.int32)
                least[lo:hi][hit] = np.repeat(np.frombuffer(sources, np.int64), times)
                homes[lo:hi][hit] = np.repeat(np.frombuffer(where, np.int32), times)
        source, home = least[distinct.of], homes[distinct.of]
        seen = source < ids[runs.owner]
        goes_on = seen[1:] & seen[:-1] & (runs.owner[1:] == runs.owner[:-1]) & (source[1:] == source[:-1]) & (home[1:] == home[:-1])
        first = np.flatnonzero(seen & ~np.concatenate(([False], goes_on)))
        last = np.flatnonzero(seen & ~np.append(goes_on, False))
        uses: dict[tuple[int, int, bytes], list[tuple[int, int]]] = defaultdict(list)
        row, words = -1, []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if runs.owner[a] != row:
                row = int(runs.owner[a])
                words = _words(texts[row])
            start = int(runs.starts[a] - runs.begin[row])
            uses[int(home[a]), int(source[a]), b" ".join(words[start : start + b - a + seed])].append((row, start))
        out: dict[int, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))
        for (where, doc, body), at in uses.items():
            for column, value in zip(out[where], (doc, body, np.array(at, np.int32).tobytes()), strict=True):
                column.append(value)
        return _rows(_STRETCHES, [(where, key[0].as_py(), *columns) for where, columns in out.items()])

    return stretches


def _factor(seed: int, bits: int):
    def factor(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        """Factors of the stretches that other chunks sent against this chunk's documents."""
        if not asked.num_rows or not table.num_rows:
            return _rows(_FACTORED, [])
        ids, texts, _ = _ordered(table)
        rows, lexicon, blocks = [], Lexicon(), {}
        todo = [(r["chunk"], *x) for r in asked.to_pylist() for x in zip(r["sources"], r["bodies"], r["uses"], strict=True)]
        for doc in {x[1] for x in todo}:
            lo, hi = np.searchsorted(ids, [doc, doc + 1])
            blocks[doc] = Block([lexicon.numbers(t) for t in texts[lo:hi]])
        out: dict[int, list] = defaultdict(list)
        lacking: dict[int, list] = defaultdict(list)
        for chunk, doc, body, uses in todo:
            factors, missing = blocks[doc].factors(lexicon.numbers(body).astype(np.int64), seed)
            words = _words(body) if missing else []
            for row, start in np.frombuffer(uses, np.int32).reshape(-1, 2).tolist():
                out[chunk] += [(row, start + a, n, doc, at) for a, n, at in factors]
                lacking[chunk] += [{"row": row, "start": start + a, "words": b" ".join(words[a : a + seed])} for a in missing]
        for chunk in out.keys() | lacking.keys():
            columns = list(zip(*out[chunk], strict=True)) or [()] * 5
            kinds = (np.int32, np.int32, np.int32, np.int64, np.int32)
            rows.append((chunk, *(np.array(c, t).tobytes() for c, t in zip(columns, kinds, strict=True)), lacking[chunk]))
        return _rows(_FACTORED, rows)

    return factor


def _missing(seed: int, buckets: int, bits: int):
    def missing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Seeds that the block named for their hash lacks."""
        for batch in batches:
            rows = []
            for chunk, own in zip(batch.column("chunk").to_pylist(), batch.column("missing").to_pylist(), strict=True):
                for x in own:
                    key = Runs([x["words"]], seed, lower=False, whole=False, bits=bits).first
                    rows.append((int(bucket_of(key, buckets)[0]), int(unshort(short(key, _KEY), _KEY)[0]), chunk, x["row"], x["start"], x["words"]))
            yield from _rows(_MISSING, rows).to_batches()

    return missing


def _holders(key: tuple, asked: pa.Table, missing: pa.Table) -> pa.Table:
    """The chunks that have the hash of a missing seed."""
    if not missing.num_rows or not asked.num_rows:
        return _rows(_HELD, [])
    wanted, rows = np.unique(missing.column("key").to_numpy().astype(np.uint64)), []
    for chunk, hashes in zip(asked.column("chunk").to_pylist(), asked.column("hashes").to_pylist(), strict=True):
        if len(own := np.intersect1d(wanted, unshort(hashes, _KEY))):
            rows.append((chunk, own.tobytes()))
    return _rows(_HELD, rows)


def _spelled(seed: int, bits: int):
    def spelled(key: tuple, table: pa.Table, hints: pa.Table) -> pa.Table:
        """The chunk's seeds of those hashes by their words, each with its first document."""
        if not hints.num_rows or not table.num_rows:
            return _rows(_SPELLED, [])
        ids, texts, _ = _ordered(table)
        runs = Runs(texts, seed, lower=False, whole=False, bits=bits)
        wanted = np.concatenate([np.frombuffer(x, np.uint64) for x in hints.column("keys").to_pylist()])
        first: dict[bytes, int] = {}
        row, words = -1, []
        for a in np.flatnonzero(np.isin(unshort(short(runs.first, _KEY), _KEY), wanted)).tolist():
            if runs.owner[a] != row:
                row = int(runs.owner[a])
                words = _words(texts[row])
            start = int(runs.starts[a] - runs.begin[row])
            first.setdefault(b" ".join(words[start : start + seed]), int(ids[row]))
        return _rows(_SPELLED, [*first.items()])

    return spelled


def _finish(seed: int):
    def finish(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts, order = _ordered(table)
        kinds = {"rows": np.int32, "starts": np.int32, "words": np.int32, "sources": np.int64, "ats": np.int32}
        columns = [[v for x in found.column(c).to_pylist() for v in np.frombuffer(x, t).tolist()] for c, t in kinds.items()]
        factors: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for row, start, words, source, at in zip(*columns, strict=True):
            if source < ids[row]:
                factors[row].append((start, words, source, at))
        out = []
        for i, text, own in zip(table.take(pa.array(order, pa.int64())).column("doc").to_pylist(), texts, factors, strict=True):
            words = _words(text)
            kept = words
            if own:
                own.sort()
                gone = np.zeros(len(words), bool)
                for start, n, _, _ in own:
                    gone[start : start + n] = True
                kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            shown = [{"start": a, "words": n, "source": s, "source_start": None if at < 0 else at} for a, n, s, at in own]
            out.append((i, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), shown))
        return _rows(_OUT, out)

    return finish


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the kept words joined by one space) and factors (start, words, source, source_start).

    A word goes if it lies in a run of `seed` words that also starts in a document with a smaller id; runs are judged
    on the input, by their words. Each factor is a run of words of its source, the earliest document of its seeds, from
    word source_start on (null for a seed that was found after a collision); neighbours overlap where seeds cross
    the end of one. Ids are integers. A null text has no words; a null id comes after all others and is no source of another
    null; rows with the same id never remove each other's words; other columns are not looked at. A text of any length is
    handled by one task, in some 60 bytes of memory a byte of text. `hash_bits` under 64 is for tests of collisions.
    """
    chunks, buckets, parts = plan(docs, text)
    table = chunked(docs, doc_id, text, chunks, parts)
    rows = table.groupBy("chunk")
    asked = rows.applyInArrow(_ask(seed, buckets, hash_bits), spark_schema(_ASKED)).repartition(parts, "bucket")
    answered = asked.groupBy("bucket").applyInArrow(_answer, spark_schema(_ANSWERED))
    stretches = rows.cogroup(answered.groupBy("chunk")).applyInArrow(_stretches(seed, buckets, hash_bits), spark_schema(_STRETCHES))
    factored = rows.cogroup(stretches.groupBy("home")).applyInArrow(_factor(seed, hash_bits), spark_schema(_FACTORED)).repartition(parts, "chunk")
    # collisions: none of these tables has a row unless two different seeds have one hash. Joins would shuffle what is shuffled already
    missing = factored.mapInArrow(_missing(seed, buckets, hash_bits), spark_schema(_MISSING))
    holders = asked.groupBy("bucket").cogroup(missing.groupBy("bucket")).applyInArrow(_holders, spark_schema(_HELD))
    spelled = rows.cogroup(holders.groupBy("chunk")).applyInArrow(_spelled(seed, hash_bits), spark_schema(_SPELLED))
    earliest = spelled.groupBy("words").agg(F.min("doc").alias("source"))
    solved = missing.join(earliest, "words").select("chunk", "row", "start", "source")
    found = factored.unionByName(_as_found(solved, seed), allowMissingColumns=True)  # all columns, as `missing` reads them: one exchange
    made = rows.cogroup(found.groupBy("chunk")).applyInArrow(_finish(seed), spark_schema(_OUT))
    return made.select(F.col("doc").alias(doc_id), "n_words", "n_removed", "kept_text", "factors")


def _as_found(solved: DataFrame, seed: int) -> DataFrame:
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(x["chunk"], *(np.array([v], t).tobytes() for v, t in ((x["row"], np.int32), (x["start"], np.int32), (seed, np.int32), (x["source"], np.int64), (-1, np.int32)))) for x in batch.to_pylist()]
            yield from _rows(_FOUND, rows).to_batches()

    return solved.mapInArrow(pack, spark_schema(_FOUND))
