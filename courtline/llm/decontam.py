"""Benchmark decontamination: an Aho-Corasick automaton over the word windows of test items, one scan of each text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.batches import drop, kept_for, map_texts, written

WINDOW = 13
#: Pairs of a window and an item in one automaton (60 MB at most or so); a larger benchmark is scanned in several passes.
SHARD_WINDOWS = 20_000

_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
#: Lower-cases A-Z and turns every other byte that no word holds into a space; UTF-8 bytes above 0x7F stay.
NORMAL = bytes(32 if (b + 32 if 0x41 <= b <= 0x5A else b) in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def normal_words(raw: bytes | None) -> list[bytes]:
    return raw.translate(NORMAL).split() if raw else []


def windows(words: list[bytes], n: int = WINDOW) -> Iterator[tuple[bytes, int]]:
    """Runs of n words, each with its length in words; fewer words than n, but not none, are one window."""
    for i in range(max(len(words) - n + 1, min(len(words), 1))):
        part = words[i : i + n]
        yield b" " + b" ".join(part) + b" ", len(part)


def automaton(shard: dict[bytes, tuple[int, set[str]]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for pattern, (n, items) in shard.items():
        made.add_word(pattern.decode("latin-1"), (n, tuple(sorted(items))))
    if shard:
        made.make_automaton()
    return made


def word_offsets(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word, in code points of the original text."""
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    point = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return point[np.flatnonzero(edge == 1)], point[np.flatnonzero(edge == -1)]


def scan(found: ahocorasick.Automaton, raw: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, the merged word ranges [start, end) inside windows, and the items they come from."""
    words = normal_words(raw)
    if not words or not len(found):
        return len(words), [], set()
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = list(found.iter(text))
    if not hits:
        return len(words), [], set()
    spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(spaces, [e for e, _ in hits])
    items = set().union(*(own for _, (_, own) in hits))
    return len(words), merged([(int(e) - n, int(e)) for e, (_, (n, _)) in zip(ends, hits, strict=True)]), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def shards(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[dict[bytes, tuple[int, set[str]]]]:
    """The benchmark's windows in automata of at most `limit` pairs of a window and an item that has it.

    Rows stream to the driver; a long item, and a window that many items share, are divided as well.
    """
    own: dict[bytes, tuple[int, set[str]]] = {}
    pairs = 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    for row in rows.toLocalIterator():
        for pattern, n in windows(normal_words(row.t.encode())):
            items = own.setdefault(pattern, (n, set()))[1]
            pairs += row.i not in items
            items.add(row.i)
            if pairs >= limit:
                yield own
                own, pairs = {}, 0
    yield own


def automaton_of_worker(name: str, model) -> ahocorasick.Automaton:
    """The automaton that this Python worker built last: it lasts over the tasks that a worker runs, until another operator has it."""
    kept = kept_for(__name__)
    if name not in kept:
        kept.clear()
        kept[name] = automaton(model.value)
    return kept[name]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, shard_windows: int = SHARD_WINDOWS
) -> DataFrame:
    """Which words of each text lie inside an occurrence of a benchmark window.

    Returns the columns `keep` (default: the id), n_words, n_hit, n_items, items (ids as sorted strings),
    spans (hit runs, in code points of the original text, end exclusive) and contaminated.
    Null and empty texts have no words and no hits; items without an id or text are ignored; items with the same
    id count as one; rows with the same document id are judged one by one; an empty benchmark hits nothing.
    """
    spark, keep = docs.sparkSession, keep or [doc_id]
    outputs = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, spans array<struct<start:int,end:int>>, contaminated boolean"
    carried, last = None, docs
    todo = shards(benchmark, item_id, item_text, shard_windows)
    shard = next(todo)
    while True:
        model, after = spark.sparkContext.broadcast(shard), next(todo, None)
        more = "__ranges array<struct<lo:int,hi:int>>, __items array<string>"

        def make(model=model, name=uuid.uuid4().hex, first=carried is None):
            found = automaton_of_worker(name, model)

            def step(texts, part):
                rows = [scan(found, t) for t in texts]
                if not first:
                    before = zip(part.column("__ranges").to_pylist(), part.column("__items").to_pylist(), strict=True)
                    rows = [(n, merged(r + [(x["lo"], x["hi"]) for x in b]), i | set(own)) for (n, r, i), (b, own) in zip(rows, before, strict=True)]
                spans = []
                for (_, ranges, _), raw in zip(rows, texts, strict=True):
                    if ranges:
                        starts, ends = word_offsets(raw)
                        ranges = [{"start": int(starts[lo]), "end": int(ends[hi - 1])} for lo, hi in ranges]
                    spans.append(ranges)
                hits = [sum(hi - lo for lo, hi in r) for _, r, _ in rows]
                return {
                    "n_words": [n for n, _, _ in rows],
                    "n_hit": hits,
                    "n_items": [len(i) for _, _, i in rows],
                    "items": [sorted(i) for _, _, i in rows],
                    "spans": spans,
                    "contaminated": [h > 0 and 20 * h >= n for h, (n, _, _) in zip(hits, rows, strict=True)],
                    "__ranges": [[{"lo": lo, "hi": hi} for lo, hi in r] for _, r, _ in rows],
                    "__items": [sorted(i) for _, _, i in rows],
                }

            return step

        also = () if carried is None else ("__ranges", "__items")
        if after is None:
            return map_texts(last, text, outputs, make, keep, also)
        # several automata: what the earlier ones found travels with the rows, one written table a pass
        last = written(map_texts(last, text, more, make, [*dict.fromkeys([*keep, text])], also), "decontam")
        if carried is not None:
            drop(carried)
        carried, shard = last, after
