"""Language identification by prediction by partial matching: exact code lengths under frozen per-language byte trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.batches import map_texts

#: Bytes of context at most.
ORDER = 4
#: Training documents over all languages, dealt evenly; of a longer text so many bytes are learned, from a place chosen by a hash.
MAX_DOCS, MAX_BYTES = 2_000, 32_768
UNKNOWN = "und"
#: Bytes that are scored at once.
PIECE = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(buf: np.ndarray, size: int) -> np.ndarray:
    """The last `size` bytes up to each position, as an integer; bytes before the start count as 0."""
    key = buf.astype(np.uint64)
    out = key.copy()
    for k in range(1, size):
        out[k:] |= key[:-k] << np.uint64(8 * k)
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in ASCII lower case, each after ORDER zero bytes, and where each begins (its zeros included)."""
    pad = bytes(ORDER)
    return np.frombuffer(pad + pad.join(t.lower() for t in texts), np.uint8), np.cumsum([0] + [len(t) + ORDER for t in texts])


class Tree:
    """Context tree of one language: counts of each symbol after each context of 0 to ORDER bytes.

    Escapes by method C: after a context with total T and q distinct symbols, a seen symbol has probability
    count / (T + q) and the escape q / (T + q); unseen contexts cost nothing; below order 0 all bytes are equal.
    """

    def __init__(self, texts: list[bytes]) -> None:
        buf, starts = joined(texts)
        own = np.ones(len(buf), bool)
        for s in starts[:-1]:
            own[s : s + ORDER] = False
        self.symbols, self.bits, self.contexts, self.escapes = [], [], [], []
        for k in range(ORDER + 1):
            key, count = np.unique(grams(buf, k + 1)[own], return_counts=True)
            context, first, q = np.unique(key >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(count, first) if len(key) else count
            self.symbols.append(key)
            self.bits.append(np.log2(np.repeat(total + q, q) / count))
            self.contexts.append(context)
            self.escapes.append(np.log2((total + q) / q))

    def cost(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each (k + 1)-gram after the bytes before it."""
        if k < 0:
            return np.full(len(keys), 8.0)
        if not len(self.symbols[k]):
            return np.full(len(keys), 8.0)
        at = np.minimum(np.searchsorted(self.symbols[k], keys), len(self.symbols[k]) - 1)
        seen = self.symbols[k][at] == keys
        out = np.where(seen, self.bits[k][at], 0.0)
        rest = np.flatnonzero(~seen)
        if len(rest):
            context = keys[rest] >> np.uint64(8)
            c = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            short = keys[rest] & np.uint64((1 << (8 * k)) - 1) if k else keys[rest]
            out[rest] = np.where(self.contexts[k][c] == context, self.escapes[k][c], 0.0) + self.cost(short, k - 1)
        return out


class Model:
    """The trees of all languages, with one hash table from each known (ORDER + 1)-gram to its bits in every language."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.langs = sorted(texts)
        self.trees = [Tree(texts[x]) for x in self.langs]
        known = np.unique(np.concatenate([t.symbols[ORDER] for t in self.trees])) if self.trees else np.zeros(0, np.uint64)
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(len(known), 1) * 3)))))
        size = 1 << (64 - int(self.shift))
        self.known, self.rows = known, np.full(size, -1, np.int32)
        self.bits = np.stack([t.cost(known) for t in self.trees], 1) if self.trees else np.zeros((0, 1))
        rest, slot = np.arange(len(known), dtype=np.int32), (known * _MIX) >> self.shift
        while len(rest):
            free = np.flatnonzero(self.rows[slot] < 0)
            where, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.rows[where] = rest[put]
            left = np.ones(len(rest), bool)
            left[put] = False
            rest, slot = rest[left], (slot[left] + np.uint64(1)) & np.uint64(size - 1)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each (ORDER + 1)-gram's last byte, a column for each language."""
        if not len(self.known):
            return np.stack([t.cost(keys) for t in self.trees], 1)
        slot, mask = (keys * _MIX) >> self.shift, np.uint64(len(self.rows) - 1)
        row = self.rows[slot]
        out = self.bits[row]
        todo = np.flatnonzero((row < 0) | (self.known[row] != keys))
        slot = slot[todo]
        unknown = []
        while len(todo):
            row = self.rows[slot]
            unknown.append(todo[row < 0])
            hit = (row >= 0) & (self.known[row] == keys[todo])
            out[todo[hit]] = self.bits[row[hit]]
            go = (row >= 0) & ~hit
            todo, slot = todo[go], (slot[go] + np.uint64(1)) & mask
        rest = np.concatenate(unknown) if unknown else np.zeros(0, int)
        if len(rest):
            some, back = np.unique(keys[rest], return_inverse=True)
            out[rest] = np.stack([t.cost(some) for t in self.trees], 1)[back]
        return out

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float, list[float]]]:
        """Language, its probability under equal priors, and the code length in bits by language."""
        good = [i for i, t in enumerate(texts) if t and has_letter(t)]
        out: list[tuple[str, float, list[float]]] = [(UNKNOWN, 0.0, [])] * len(texts)
        if not good or not self.langs:
            return out
        buf, starts = joined([texts[i] for i in good])
        total = np.zeros((len(good), len(self.langs)))
        for lo in range(ORDER, len(buf), PIECE):  # a long text takes a few times its size, not dozens
            at = np.arange(lo, min(lo + PIECE, len(buf)))
            who = np.searchsorted(starts, at, side="right") - 1
            own = at - starts[who] >= ORDER
            who = who[own]
            if not len(who):
                continue
            bits = self.costs(grams(buf[lo - ORDER : lo + PIECE], ORDER + 1)[ORDER:][own])
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            total[who[first]] += np.add.reduceat(bits, first, axis=0)
        best = total.argmin(1)
        odds = np.exp2(np.clip(total.min(1, keepdims=True) - total, -1000, 0))
        for i, b, p, t in zip(good, best, 1 / odds.sum(1), total, strict=True):
            out[i] = self.langs[b], float(p), t.tolist()
        return out


def has_letter(raw: bytes) -> bool:
    low = raw.translate(None, _NOT_ASCII_LETTERS)
    return bool(low) or (not raw.isascii() and any(c.isalpha() for c in raw.decode("utf-8", "replace")))


_NOT_ASCII_LETTERS = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127)


def training_sample(docs: DataFrame, doc_id: str, text: str, lang: str, max_docs: int, max_bytes: int) -> dict[str, list[bytes]]:
    """At most about `max_docs` documents, the same number of each language and one at least, chosen by a hash of the id.

    Of a text of more than `max_bytes` bytes so many are learned, from a place chosen by a hash; any part may be the one.
    """
    place = F.pmod(F.xxhash64(F.col(doc_id), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    whole = docs.select(F.col(doc_id).alias("i"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"), place.alias("h"))
    usable = whole.where("l IS NOT NULL AND octet_length(t) >= 1").withColumn("t", F.expr(f"substring(CAST(t AS binary), CAST(1 + pmod(xxhash64(i, 11), greatest(octet_length(t) - {max_bytes}, 0) + 1) AS int), {max_bytes})"))
    counts = {r.l: (r.n, r.h) for r in usable.groupBy("l").agg(F.count("*").alias("n"), F.min("h").alias("h")).orderBy(F.desc("n"), "l").limit(max_docs).collect()}
    if not counts:
        return {}
    share = max(1, max_docs // len(counts))
    wanted = F.coalesce(*[F.when(F.col("l") == x, F.lit(max(h, min(1.0, 1.2 * share / n)))) for x, (n, h) in counts.items()], F.lit(-1.0))
    rows = usable.where(F.col("h") <= wanted).orderBy(F.col("h") / F.greatest(wanted, F.lit(1e-12)), "h", "i").limit(3 * max_docs).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.h, r.i is not None, r.i)):
        if len(out.setdefault(r.l, [])) < share:
            out[r.l].append(bytes(r.t).decode("utf-8", "ignore").encode())
    return out


def identify_languages(
    docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """lang_pred, score (probability of that language under equal priors) and bits (code length by language, sorted names).

    Fits on a bounded sample of `train` (see training_sample) and scores every whole text of `docs`. Texts that are null
    or have no letter get `und` and 0, as do all texts if nothing can be learned; equal code lengths go to the first
    language by name; repeated rows get equal results.
    """
    model = docs.sparkSession.sparkContext.broadcast(Model(training_sample(train, doc_id, text, lang, max_docs, max_bytes)))

    def make():
        def step(texts, _):
            rows = model.value.predict(texts)
            return {"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "bits": [r[2] for r in rows]}

        return step

    return map_texts(docs, text, "lang_pred string, score double, bits array<double>", make, keep or [doc_id])
