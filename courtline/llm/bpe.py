"""BPE encoding with a priority queue of merge ranks over a linked symbol list, and decoding from vocabulary strings."""

from __future__ import annotations

import heapq
import json
import unicodedata

import regex
from pyspark.sql import DataFrame

from courtline.llm.batches import kept_for, map_texts

#: Entries of the younger half of each cache. When it is full it becomes the older half, whose entries come back when asked for.
CACHE = 300_000
#: Longer keys are not kept, so that a cache is bounded in bytes too.
LONGEST_KEY = 256


class Cache:
    """A dictionary in two halves: what was not asked for while the younger half filled up is forgotten."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        """The value of a key that the younger half does not have, from the older one; None if that lacks it too."""
        if (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(key) > LONGEST_KEY:
            return
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[key] = value


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


def merge_word(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Applies the lowest-ranked merge, leftmost first, until none is left.

    Symbols form a doubly linked list (after, before); the queue holds (rank, position, length of the pair), and an
    entry is stale if its left symbol is gone or the pair there is no longer the one that was pushed.
    """
    n = len(symbols)
    symbols, after, before = symbols[:], [*range(1, n), -1], [*range(-1, n - 1)]
    queue = [(r, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get(pair)) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, pair = heapq.heappop(queue)
        j = after[i]
        if j < 0 or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue
        symbols[i], symbols[j] = pair[0] + pair[1], ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        after[j] = -1
        if (k := before[i]) >= 0 and (r := ranks.get((symbols[k], symbols[i]))) is not None:
            heapq.heappush(queue, (r, k, (symbols[k], symbols[i])))
        if (k := after[i]) >= 0 and (r := ranks.get((symbols[i], symbols[k]))) is not None:
            heapq.heappush(queue, (r, i, (symbols[i], symbols[k])))
    out, i = [], 0
    while i >= 0:
        out.append(symbols[i])
        i = after[i]
    return out


class WordBpe:
    """A BPE vocabulary with a word-end suffix, read from a tokenizers JSON file.

    Normalisation is NFC and lower case; words match the file's pre-tokenisation pattern; white space is dropped;
    added tokens are cut out of the raw text first, the leftmost and longest ones.
    """

    def __init__(self, definition: str) -> None:
        known = json.loads(definition)
        self.suffix = known["model"]["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = known["model"]["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(known["model"]["merges"])}
        self.added = {t["content"]: t["id"] for t in known["added_tokens"]}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.added.items()}
        pattern = next(p["pattern"]["Regex"] for p in known["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.letters = byte_letters()
        self.words, self.chunks = Cache(), Cache()

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        for word in self.word.findall(text.lower()):
            known = self.words.young.get(word)
            if known is None:
                known = self.words.get(word)
            if known is None:
                symbols = [self.letters[b] for b in word.encode()]
                symbols[-1] += self.suffix
                known = tuple(self.ids[s] for s in merge_word([s for s in symbols if s in self.ids], self.ranks) if s in self.ids)
                self.words.put(word, known)
            out.extend(known)
        return out

    def encode(self, text: str) -> list[int]:
        if not self.special or "<" not in text:
            return self._plain(text)
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by a space, as for a file without a decoder; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def both(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal joined by a space, and the decoded text.

        No word crosses white space, so each run without it is encoded on its own, and most are in the cache.
        """
        if not text.isprintable() and regex.search(r"[\x1c-\x1f]", text):  # white space to str.split only
            ids = self.encode(text)
            return len(ids), " ".join(map(str, ids)), self.decode(ids)
        chunks = text.split()
        got = [*map(self.chunks.young.get, chunks)]
        if None in got:
            got = [self._chunk(chunk) if g is None else g for chunk, g in zip(chunks, got, strict=True)]
        got = [*filter(None, got)]  # a chunk without ids is an empty tuple
        return sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])

    def _chunk(self, chunk: str) -> tuple:
        known = self.chunks.young.get(chunk)  # it may have come since, in the same text
        if known is None:
            known = self.chunks.get(chunk)
        if known is None:
            own = self.encode(chunk)
            known = (len(own), " ".join(map(str, own)), self.decode(own)) if own else ()
            self.chunks.put(chunk, known)
        return known


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def model_of_worker(definition: str) -> WordBpe:
    """The model of this Python worker: its caches last over the tasks that a worker runs, until another operator has it."""
    kept = kept_for(__name__)
    if definition not in kept:
        kept.clear()
        kept[definition] = WordBpe(definition)
    return kept[definition]


def bpe_round_trip(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes each whole text and decodes the ids again: n_tokens, ids (decimal, joined by a space) and decoded.

    `vocabulary` is the path of a tokenizers JSON file on the driver; its content (a few MB) is broadcast.
    A null text counts as empty: no ids, an empty decoded text. Rows are independent, so repeated rows get equal values.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_definition(vocabulary))

    def make():
        bpe = model_of_worker(model.value)

        def step(texts, _):
            rows = [bpe.both((t or b"").decode("utf-8", "replace")) for t in texts]
            return {"n_tokens": [r[0] for r in rows], "ids": [r[1] for r in rows], "decoded": [r[2] for r in rows]}

        return step

    return map_texts(docs, text, "n_tokens bigint, ids string, decoded string", make, keep or ["doc_id"])
