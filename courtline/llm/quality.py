"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened for vectorised traversal."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.batches import map_texts
from courtline.llm.hashing import word_hashes

#: Labelled rows used at most, trees, depth, bins of a feature, shrinkage, least rows in a leaf.
MAX_LABELLED, TREES, DEPTH, BINS, RATE, LEAST_ROWS = 12_000, 80, 4, 64, 0.1, 20

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "symbol": b"#$%&*@^~+=_\\`",
    "bar": b"|/<>{}[]()",
    "quote": b"'\"-",
    "high": bytes(range(128, 256)),
}
_KIND = np.full(256, len(_CLASSES), np.uint8)
for _n, _bytes in enumerate(_CLASSES.values()):
    _KIND[list(_bytes)] = _n
FEATURES = [
    *(f"share_{k}" for k in _CLASSES), "log_bytes", "log_words", "word_length", "word_length_sd", "long_words", "distinct_words", "repeated_words", "commonest_word",
    "log_lines", "line_words", "distinct_lines", "short_lines", "commonest_line", "upper_words", "symbol_words", "stops_per_word", "deflated", "entropy",
]


def _per_doc(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def _groups(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the count of the commonest key of each run."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if len(k) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((at, [len(k)])))
    most = np.zeros(len(counts))
    np.maximum.at(most, d[at], sizes)
    return np.bincount(d[at], minlength=len(counts)).astype(float), most


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """A row of FEATURES for each whole text; null and empty texts get zeros in shares and counts."""
    texts = [t or b"" for t in texts]
    n = len(texts)
    if not n:
        return np.zeros((0, len(FEATURES)))
    out = np.zeros((n, len(FEATURES)))
    sizes = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    kind = _KIND[buf]
    doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
    table = np.bincount(doc * 16 + kind, minlength=n * 16).reshape(n, 16)[:, : len(_CLASSES)]
    some = np.maximum(sizes, 1)
    out[:, : len(_CLASSES)] = table / some[:, None]
    col = len(_CLASSES)
    hashes, words = word_hashes(texts, lower=True)
    inside = np.concatenate(([False], ~np.isin(kind, (3, 4)), [False])) if len(buf) else np.zeros(2, bool)
    # words end at white space or at the end of a text
    bounds = np.zeros(len(buf) + 1, bool)
    bounds[np.cumsum(sizes)] = True
    bounds[0] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | bounds[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | bounds[1:])) + 1
    length = (ends - starts).astype(float)
    w = np.maximum(words, 1)
    mean = _per_doc(length, words) / w
    shout = np.concatenate(([0], np.cumsum(np.isin(kind, (1,)))))
    marks = np.concatenate(([0], np.cumsum(np.isin(kind, (7, 8, 9)))))
    uppers, symbols = shout[ends] - shout[starts], marks[ends] - marks[starts]
    same = np.concatenate((hashes[1:] == hashes[:-1], [False])) if len(hashes) else np.zeros(0, bool)
    distinct, commonest = _groups(hashes, words)
    out[:, col + 0], out[:, col + 1] = np.log1p(sizes), np.log1p(words)
    out[:, col + 2] = mean
    out[:, col + 3] = np.sqrt(np.maximum(_per_doc(length**2, words) / w - mean**2, 0))
    out[:, col + 4] = _per_doc(length > 12, words) / w
    out[:, col + 5], out[:, col + 6], out[:, col + 7] = distinct / w, _per_doc(same, words) / w, commonest / w
    lines = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in lines])
    keys = np.array([hash_line(x) for own in lines for x in own], np.uint64)
    own, most = _groups(keys, n_lines)
    short = np.array([len(x) < 20 for own_lines in lines for x in own_lines], float)
    out[:, col + 8], out[:, col + 9] = np.log1p(n_lines), words / n_lines
    out[:, col + 10], out[:, col + 11], out[:, col + 12] = own / n_lines, _per_doc(short, n_lines) / n_lines, most / n_lines
    out[:, col + 13], out[:, col + 14] = _per_doc(uppers * 2 > length, words) / w, _per_doc(symbols > 0, words) / w
    out[:, col + 15] = table[:, 5] / w
    out[:, col + 16] = np.array([len(zlib.compress(t, 1)) for t in texts]) / some
    share = np.where(table > 0, out[:, : len(_CLASSES)], 1.0)
    out[:, col + 17] = -(share * np.log2(share)).sum(1)
    return out


def hash_line(line: bytes) -> int:
    return zlib.crc32(line) | (len(line) & 0xFFFFFFFF) << 32


class Forest:
    """Boosted trees of fixed depth in flat arrays: node i of a tree has the children 2i + 1 and 2i + 2."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic loss, second-order gains over histograms of quantile bins; a node that can't be split passes all rows left."""
        nodes = 2**DEPTH - 1
        self.feature, self.cut, self.leaf = np.zeros((TREES, nodes), np.int64), np.full((TREES, nodes), np.inf), np.zeros((TREES, nodes + 1))
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        self.bias = float(np.log(rate / (1 - rate)))
        if not len(y) or y.min() == y.max():
            return
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)  # x <= cut[b] goes to b or less
        f_count = x.shape[1]
        flat = binned + np.arange(f_count) * BINS
        margin = np.full(len(y), self.bias)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for depth in range(DEPTH):
                first, width = 2**depth - 1, 2**depth
                key = (flat + ((node - first) * f_count * BINS)[:, None]).ravel()
                shape = (width, f_count, BINS)
                hg, hh, hn = (np.bincount(key, np.repeat(v, f_count), width * f_count * BINS).reshape(shape).cumsum(2) for v in (g, h, np.ones(len(y))))
                tg, th, tn = hg[:, :, -1:], hh[:, :, -1:], hn[:, :, -1:]
                gain = hg**2 / (hh + 1) + (tg - hg) ** 2 / (th - hh + 1) - tg**2 / (th + 1)
                gain[(hn < LEAST_ROWS) | (tn - hn < LEAST_ROWS)] = -1
                best = gain.reshape(width, -1).argmax(1)
                for k in range(width):
                    f, b = divmod(int(best[k]), BINS)
                    if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                        self.feature[t, first + k], self.cut[t, first + k] = f, cuts[f][b]
                f, c = self.feature[t, node], self.cut[t, node]
                node = 2 * node + 1 + (x[np.arange(len(y)), f] > c)
            own = node - nodes
            sums, weights = np.bincount(own, g, nodes + 1), np.bincount(own, h, nodes + 1)
            self.leaf[t] = -RATE * sums / (weights + 1)
            margin += self.leaf[t, own]

    def score(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.bias), np.arange(len(x))
        for t in range(TREES):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            margin += self.leaf[t, node - self.feature.shape[1]]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int = MAX_LABELLED) -> Forest:
    """Trees from the statistics of at most `max_rows` labelled rows, chosen by a hash of the id; only numbers reach the driver."""
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg(F.max("y").alias("y"))
    chosen = known.withColumn("h", F.xxhash64("i")).orderBy("h", "i").limit(max_rows).select("i", "y")
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "i")

    def make():
        return lambda texts, _: {"x": [r.tobytes() for r in statistics(texts)]}

    got = sorted((r.i, r.y, bytes(r.x)) for r in map_texts(rows, "t", "x binary", make, ["i", "y"]).collect())
    x = np.frombuffer(b"".join(r[2] for r in got)).reshape(-1, len(FEATURES))
    return Forest(x, np.array([float(r[1] > 0) for r in got]))


def score_quality(docs: DataFrame, train: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None, max_rows: int = MAX_LABELLED) -> DataFrame:
    """score (0 to 1) and features (as in FEATURES) of every whole text of `docs`.

    Fits on `labels` joined to the texts of `train`. Null and empty texts have zero statistics and are scored like any
    other; without labelled rows, or with one class only, every score is the rate of label 1. Repeated rows get equal scores.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(train, labels, doc_id, text, label, max_rows))

    def make():
        def step(texts, _):
            x = statistics(texts)
            return {"score": model.value.score(x), "features": list(x)}

        return step

    return map_texts(docs, text, "score double, features array<double>", make, keep or [doc_id])
