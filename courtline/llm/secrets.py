"""Secret scans: three base patterns, and guess-cost scoring of the values that stand in a credential context."""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from courtline.llm.batches import map_texts

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: What a value follows to count as a credential beside the base pattern's names.
CONTEXT = re.compile(
    rb"""(?<![A-Za-z])(pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|(?:api|access|private|auth)[_ -]?key|credentials?|auth|login)["']?\x20*(?:[:=]|\x20is\x20)\x20*["']?([^\s"'`,;<>]{4,})""",
    re.IGNORECASE,
)
_CUES = (b"pass", b"pwd", b"pin", b"secret", b"token", b"key", b"credential", b"auth", b"login")
#: log10 of the guesses from which a credential-context value is reported.
STRONG = 8.0

# Words that guessers try first, most frequent first. The words of a public vocabulary follow in RANKS.
COMMON = (
    "password 123456 qwerty letmein welcome admin login dragon monkey master sunshine princess football shadow michael "
    "superman batman trustno iloveyou secret hello freedom whatever ninja mustang access flower summer winter spring autumn "
    "love god money test guest user root changeme default orange purple silver golden happy lucky star angel baby computer "
    "internet server system service token key house river mountain horse battery staple correct"
).split()
#: A vocabulary whose words stand in the order in which they were merged, about by frequency.
WORDS = "word_bpe_49k.json"


def _ranked() -> dict[str, int]:
    """Rank of each word: the common ones, then the whole words of the vocabulary."""
    with open(public_tokenizers.path(WORDS), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = (t[:-4] for t in sorted(vocabulary, key=vocabulary.get) if t.endswith("</w>"))
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *(w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha())]))}


RANKS = _ranked()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4301$5@7!", "aeolssati")
#: What compounds are joined with.
SEPARATORS = "-_."
LONGEST_WORD = max(map(len, RANKS))


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch on the keyboard; row r is shifted by half a key against the row above."""
    place = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {c: {d for d, (u, v) in place.items() if d != c and abs(u - x) <= 1 and abs(v - y) <= 1} for c, (x, y) in place.items()}


NEAR = _neighbours()
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


@lru_cache(maxsize=20_000)
def guess_cost(value: str) -> tuple[float, tuple[tuple[str, int, int], ...]]:
    """log10 of the guesses that the cheapest segmentation of `value` takes, and its parts (kind, start, end).

    Dynamic programming over end positions: best[j] is the least, over parts i..j, of best[i] + the part's cost. Brute-force
    spans and walks carry their best start along, so that whole values of any length can be costed. Parts
    are dictionary words (rank, times 2 for capitals, times 2 for look-alike digits), separators of compounds (one of three), dates (days of 200 years), repeats of
    a block (its brute-force guesses times the repetitions), keyboard walks (starts times turns) and brute-force spans.
    Each part after the first doubles the guesses, as a guesser must also choose the structure; ties go to the
    earliest start and the kinds in this order. An empty value costs 0.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    brute = [math.log10(_alphabet(c)) for c in value]
    total = [0.0]
    for x in brute:
        total.append(total[-1] + x)
    more = math.log10(2)
    dates: dict[int, list[int]] = {}  # starts by end
    for i in range(n):
        if value[i].isdigit():
            m = DATE.match(value, i)
            ends = {m.end()} if m else set()
            if value[i : i + 2] in ("19", "20") and len(value[i : i + 4]) == 4 and value[i : i + 4].isdigit():
                ends.add(i + 4)
            for e in ends:
                dates.setdefault(e, []).append(i)
    turn, start = math.log10(2.5), math.log10(47)
    costs = np.zeros(n + 1)  # of best, for the repeats
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    brute_from, brute_cost = 0, 0.0  # the cheapest segmentation that ends in a brute-force span
    walk_at, walk_from, walk_base = 0, -1, math.inf  # first position of the run of neighbouring keys, and the best start in it
    period = [0] * 9  # how many characters up to here equal the one so many before
    for j in range(1, n + 1):
        last = j - 1
        lead = best[last][0] + (more if last else 0)
        if last == 0 or lead < brute_cost - 1e-12:
            brute_from, brute_cost = last, lead
        brute_cost += brute[last]
        options = [(brute_cost, brute_from, 4, "brute")]
        for i in range(max(0, j - LONGEST_WORD), j - 2):
            for form, extra in ((low[i:j], 0), (plain[i:j], 1)):
                if rank := RANKS.get(form):
                    options.append((best[i][0] + (more if i else 0) + math.log10(2 * rank) + more * (extra + (value[i:j] != low[i:j])), i, 0, "word"))
        if value[last] in SEPARATORS:
            options.append((lead + math.log10(len(SEPARATORS)), last, 0, "separator"))
        for i in dates.get(j, ()):
            options.append((best[i][0] + (more if i else 0) + math.log10(200 if j - i == 4 else 73_000), i, 1, "date"))
        for p in range(1, min(8, j - 1) + 1):
            period[p] = period[p] + 1 if value[last] == value[last - p] else 0
            if period[p] >= p and (times := np.arange(max(2, -(-3 // p)), (period[p] + p) // p + 1)).size:
                first = j - p * times
                whole = costs[first] + np.where(first > 0, more, 0.0) + np.log10(times)
                r = len(times) - 1 - int(whole[::-1].argmin())
                i = int(first[r])
                options.append((float(whole[r]) + total[i + p] - total[i], i, 2, "repeat"))
        if last and low[last] not in NEAR.get(low[last - 1], ()):
            walk_at, walk_from, walk_base = last, -1, math.inf
        if (i := j - 3) >= walk_at:
            base = best[i][0] + (more if i else 0) - i * turn
            if base < walk_base - 1e-12:
                walk_from, walk_base = i, base
            options.append((walk_base + start + last * turn, walk_from, 3, "walk"))
        top = (math.inf, 0, "")
        for cost, i, _, kind in sorted(options, key=lambda x: (x[1], x[2], x[0])):
            if cost < top[0] - 1e-12:
                top = (cost, i, kind)
        best.append(top)
        costs[j] = top[0]
    parts, j = [], n
    while j:
        _, i, kind = best[j]
        parts.append((kind, i, j))
        j = i
    return best[n][0], tuple(reversed(parts))


_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def hex_runs(raw: bytes, least: int) -> list[tuple[int, int]]:
    """Maximal runs of [0-9a-f] of `least` bytes or more; every run ends where a left-to-right scan would end it."""
    inside = _HEX[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def base_spans(raw: bytes, low: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the whole matches of the base patterns, matches with too short values dropped."""
    out = []
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]]
    out += [(lo, hi, "hex") for lo, hi in hex_runs(raw, LEAST["hex"])]
    return out


def guess_spans(raw: bytes, low: bytes, strong: float) -> list[tuple[int, int, str, float]]:
    """Byte spans of credential-context values whose cheapest segmentation takes 10 ** `strong` guesses or more."""
    out = []
    if any(k in low for k in _CUES):
        for m in CONTEXT.finditer(raw):
            value = m[2].rstrip(b".:!?)]}").decode("utf-8", "replace")
            if len(value) >= 4:
                cost, _ = guess_cost(value)
                if cost >= strong:
                    out.append((m.start(2), m.start(2) + len(m[2].rstrip(b".:!?)]}")), "guess", cost))
    return out


def scan_text(raw: bytes | None, strong: float = STRONG) -> list[tuple[str, int, int, float | None]]:
    """All spans as (kind, start, end, log10 guesses) in code points, by start, then kind as in KINDS, then end."""
    if not raw:
        return []
    low = raw.lower()
    found = [(a, b, k, None) for a, b, k in base_spans(raw, low)] + guess_spans(raw, low, strong)
    if not found:
        return []
    if raw.isascii():
        at = None
    else:
        at = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    out = []
    for a, b, kind, cost in found:
        if kind == "assign":
            value = ASSIGN.match(raw, a)[2].decode()
            cost = guess_cost(value)[0]
        out.append((kind, a, b, cost) if at is None else (kind, int(at[a]), int(at[b]), cost))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, strong: float = STRONG) -> DataFrame:
    """Secrets in each whole text, as `found`: array of (kind, start, end, guesses) in code points, end exclusive.

    `guesses` is log10 of the guess cost of a whole assigned or context value, of any length (null for keys).
    The kind guess is a value in a credential context that costs 10 ** `strong` guesses or more; it may overlap base
    spans. Null and empty texts have none; rows are independent, so repeated rows get equal results.
    """

    def make():
        def step(texts, _):
            return {"found": [[{"kind": k, "start": a, "end": b, "guesses": c} for k, a, b, c in scan_text(t, strong)] for t in texts]}

        return step

    return map_texts(docs, text, "found array<struct<kind:string,start:int,end:int,guesses:double>>", make, keep or ["doc_id"])


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]", strong: float = STRONG) -> DataFrame:
    """`docs` with every secret span of the text, overlapping ones merged, replaced by `mark`; other columns as they are."""

    def make():
        def step(texts, _):
            out = []
            for raw in texts:
                spans = scan_text(raw, strong)
                if not spans:
                    out.append(raw)
                    continue
                whole, parts, at = raw.decode("utf-8", "replace"), [], 0
                for _, a, b, _ in spans:
                    if a >= at:
                        parts += [whole[at:a], mark]
                    at = max(at, b)
                out.append("".join([*parts, whole[at:]]).encode())
            return {"__clean": [x if x is None else x.decode("utf-8", "replace") for x in out]}

        return step

    names = docs.columns
    made = map_texts(docs, text, "__clean string", make, names)
    return made.select(*[made["__clean"].alias(c) if c == text else made[f"`{c}`"] for c in names])
