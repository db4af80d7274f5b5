"""The corpus operators against brute force, exact round trips and held-out accuracy, and their odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtline.llm import bpe, components, decontam, exchange, factoring, gif, hashing, jaccard, langid, quality, queries, secrets, substrings, toxicity, warc

ODD = [None, "", " ", "a", "the the the", "É" * 40, "x " * 30_000, "\x00\x1c\x85 a", "🎉 ünï"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, score string, found int, media string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y", 1, "m") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, [*enumerate(ODD), (0, None), (3, "a"), (None, "the the the"), (None, None)])


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


# 1 -----------------------------------------------------------------------------------------------------------------


def brute_hits(text, items, n=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for key, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(item))
        for k in range(max(len(w) - n + 1, min(len(w), 1))):
            part = w[k : k + n]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit |= {*range(j, j + len(part))}
                    found.add(str(key))
    return len(words), len(hit), len(found), ",".join(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("limit", [decontam.SHARD_WINDOWS, 2])
def test_decontamination(spark, limit):
    rnd = random.Random(1)
    vocabulary = ["Ab", "c", "d-e", "é", "9"]
    items = [(k, " ".join(rnd.choices(vocabulary, k=n))) for k, n in enumerate((1, 3, 13, 14, 20, 0))] + [(None, "c c"), (7, None), (2, "Ab c")]
    rows = [(k, None if k == 3 else rnd.choice([" ", ", ", "\n"]).join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))) for k in range(40)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.decontaminate(frame(spark, rows), bench, shard_windows=limit).collect()
    known = [(k, t) for k, t in items if k is not None and t]
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) == brute_hits(dict(rows)[r.doc_id], known)
        text = dict(rows)[r.doc_id] or ""
        assert sum(len(decontam.normal_words(text[s.start : s.end].encode())) for s in r.spans) == r.n_hit


@pytest.mark.parametrize("limit", [5, 40])
def test_shared_windows_and_long_items_are_divided(spark, limit):
    items = [(k, "a b c") for k in range(30)] + [(99, " ".join(f"w{i}" for i in range(60)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    parts = [*decontam.shards(bench, "item_id", "text", limit)]
    assert max(sum(len(x) for _, x in part.values()) for part in parts) <= limit
    text = "x " + " ".join(f"w{i}" for i in range(60)) + " A, b, C"
    (got,) = decontam.decontaminate(frame(spark, [(1, text)]), bench, shard_windows=limit).collect()
    assert (got.n_words, got.n_hit, got.n_items, ",".join(got["items"]), got.contaminated) == brute_hits(text, items)


def test_decontamination_of_odd_texts(odd, spark):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.decontaminate(odd, empty).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(odd.limit(0), empty).count() == 0
    assert decontam.decontaminate(odd, empty, keep=odd.columns).columns[:4] == ["doc_id", "text", "lang", "source"]


# 2, 7 --------------------------------------------------------------------------------------------------------------


def held_out(rows, column, modulus, remainder, threshold):
    own = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % modulus == remainder]
    return sum((r.score >= threshold) == (r[column] == 1) for r in own) / len(own)


@pytest.mark.parametrize(("fit", "column", "modulus", "remainder", "threshold", "least"), [(quality.score_quality, "quality", 4, 2, 0.7, 0.95), (toxicity.score_toxicity, "toxic", 5, 0, 0.5, 0.9)])
def test_classifiers_on_held_out_rows(spark, odd, fit, column, modulus, remainder, threshold, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where(F.crc32(F.col("doc_id").cast("string")) % modulus != remainder)
    rows = fit(docs, docs, train).join(labels, "doc_id").collect()
    assert held_out(rows, column, modulus, remainder, threshold) >= least
    scores = fit(odd, docs, train).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    none = fit(odd, docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert fit(odd.limit(0), docs, train).count() == 0


def test_block_max_search_is_exact():
    rnd = random.Random(2)
    terms = {str(k).encode(): k for k in range(40)}
    idf = np.array([1 + rnd.random() for _ in terms])
    rows = [(i, rnd.randint(0, 1), {t: rnd.randint(1, 3) for t in rnd.sample(range(40), rnd.randint(0, 6))}) for i in range(500)]
    index = toxicity.Index(terms, idf, rows)
    for _ in range(50):
        q = {t: 1 for t in rnd.sample(range(40), rnd.randint(1, 8))}
        qv = dict(index.vector(q))
        want = sorted(((round(s, 9), i) for i, _, c in rows if (s := sum(w * qv.get(t, 0) for t, w in index.vector(c))) > 0), key=lambda x: (-x[0], x[1]))[:16]
        assert [(s, i) for s, i, _ in index.nearest(q)] == want


def test_rare_words_and_unassociated_words_find_their_rows(spark):
    rnd = random.Random(7)
    common = [f"word{k}" for k in range(200)]
    docs = [(i, " ".join(rnd.choices(common, k=30))) for i in range(100)]
    docs[3] = (3, "zibbel quarn ploff strundel vrix")  # no word in five rows
    copies = [(1000, docs[3][1]), (1001, docs[4][1]), (1002, "zibbel unknown")]
    labels = spark.createDataFrame([(i, int(i % 10 == 3)) for i in range(100)], "doc_id bigint, toxic int")
    train = frame(spark, docs)
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(spark, copies), train, labels).collect()}
    assert got[1000].evidence[0].doc_id == 3 and got[1000].evidence[0].cosine == 1 and got[1000].score >= 0.5
    assert got[1001].evidence[0].doc_id == 4 and got[1001].evidence[0].cosine == 1 and got[1001].score < 0.5
    assert [e.doc_id for e in got[1002].evidence] == [3]
    few = spark.createDataFrame([(i, int(i == 3)) for i in range(10)], "doc_id bigint, toxic int")  # chi-square is at most 10
    assert {r.doc_id: r.evidence[0].doc_id for r in toxicity.score_toxicity(frame(spark, copies), train, few).collect()} == {1000: 3, 1001: 4, 1002: 3}


def test_document_frequencies_are_those_of_all_documents(spark):
    docs = frame(spark, [(1, "alpha beta"), (2, "beta gamma beta"), (3, "gamma"), (4, "gamma"), (5, None), (6, "")])
    index = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int"), "doc_id", "text", "toxic")
    assert {t for t in index.words.terms if not t.startswith(b"^")} == {b"alpha", b"beta", b"gamma"}
    n, have = toxicity._document_frequencies(docs, "text", index.words.terms)
    assert (n, [int(have[index.words.terms[t]]) for t in (b"alpha", b"beta", b"gamma")]) == (4, [1, 2, 3])


def test_dense_part_and_postings_score_alike():
    rnd = random.Random(3)
    terms, weights = {str(k).encode(): k for k in range(300)}, np.array([1 + rnd.random() for _ in range(300)])
    rows = [(i, i % 2, {int(300 * rnd.random() ** 3): rnd.randint(1, 3) for _ in range(rnd.randint(1, 30))}) for i in range(700)]
    index = toxicity.Index(terms, weights, rows)
    assert 0 < index.search[1].shape[1] < 300 and len(index.search[2]) > toxicity.FIRST
    for i, _, c in rows[:40]:
        qv = dict(index.vector(c))
        want = sorted(((round(s, 9), j) for j, _, o in rows if j != i and (s := sum(w * qv.get(t, 0) for t, w in index.vector(o))) > 0), key=lambda x: (-x[0], x[1]))[:16]
        assert [(s, j) for s, j, _ in index.nearest_of([toxicity._pair(c)], leave=[i])[0]] == want


def test_trees_learn_a_threshold():
    rnd = np.random.default_rng(0)
    x = rnd.random((2000, 3))
    y = ((x[:, 1] > 0.4) & (x[:, 2] < 0.7)).astype(float)
    assert ((quality.Forest(x, y).score(x) > 0.5) == y).mean() > 0.98


# 3 -----------------------------------------------------------------------------------------------------------------


def greedy_lzw(data, size, clear_when_full):
    clear = 1 << size
    codes, table, after, w, k = [(clear, size + 1)], {bytes([i]): i for i in range(clear)}, clear + 2, b"", 0
    width = lambda k: max(size + 1, min(12, (clear + 1 + k).bit_length()))
    for c in data:
        b = bytes([c])
        if w + b in table:
            w += b
            continue
        codes.append((table[w], width(k)))
        k += 1
        if after < 4096:
            table[w + b], after = after, after + 1
        elif clear_when_full:
            codes.append((clear, width(k)))
            table, after, k = {bytes([i]): i for i in range(clear)}, clear + 2, 0
        w = b
    if w:
        codes.append((table[w], width(k)))
        k += 1
    codes.append((clear + 1, width(k)))
    value = at = 0
    for c, n in codes:
        value, at = value | c << at, at + n
    return value.to_bytes((at + 7) // 8, "little")


@pytest.mark.parametrize("size", [2, 4, 8])
@pytest.mark.parametrize("clear_when_full", [True, False])
def test_lzw_streams_of_another_encoder(size, clear_when_full):
    rnd = random.Random(size)
    datas = [bytes(rnd.randrange(min(1 << size, k + 1)) for _ in range(n)) for n in (1, 2, 100, 9000, 30_000) for k in (0, 1, 200)]
    streams = [greedy_lzw(d, size, clear_when_full) for d in datas]
    assert gif.lzw_decode_all(streams, size, [len(d) for d in datas]) == datas
    assert [gif.lzw_decode(s, size, len(d)) for s, d in zip(streams, datas, strict=True)] == datas


def test_gif_round_trip():
    rnd = random.Random(3)
    payloads = [bytes(rnd.randrange(256) for _ in range(64 * n)) for n in (1, 2, 60, 61)] + [b"ab" * 32 * 5000, bytes(64), b"q" * 64 * 4097]
    shown = [[f for f in frames] and b"".join(f.grey() for f in gif.compose(*_parsed(m))) for m, (_, frames, fault) in zip(gif.encode_payloads(payloads), gif.decoded(gif.encode_payloads(payloads)), strict=True) if fault is None]
    assert shown == payloads


def _parsed(media):
    size, pictures, _ = gif.parse(media)
    return size, pictures, gif.lzw_decode_all([p.stream for p in pictures], 8, [p.width * p.height for p in pictures])


def test_gif_disposal_transparency_and_interlace():
    import struct

    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0])

    def picture(samples, w, h, left=0, top=0, disposal=0, transparent=None, interlaced=False):
        out = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), 7, transparent or 0) + b"\0"
        stream = greedy_lzw(bytes(samples), 2, True)
        return out + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlaced) + b"\x02" + bytes([len(stream)]) + stream + b"\0"

    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + palette
    media = head + picture([0] * 4, 2, 2, disposal=1) + picture([1], 1, 1, 1, 0, disposal=2) + picture([2, 3], 2, 1, 0, 1, disposal=3, transparent=3) + picture([3], 1, 1, 0, 0) + b"\x3b"
    ((size, frames, fault),) = gif.decoded([media])
    shown = [(f.start_ms, f.rgba[:, :, :3].argmax(2).tolist(), f.rgba[:, :, 3].tolist()) for f in frames]
    assert size == (2, 2) and fault is None
    on, off = 255, 0
    assert shown[0] == (0, [[0, 0], [0, 0]], [[on, on], [on, on]])
    assert shown[1] == (70, [[0, 1], [0, 0]], [[on, on], [on, on]])
    assert shown[2] == (140, [[0, 0], [2, 0]], [[on, off], [on, on]])  # the second picture is cleared, sample 3 lets through
    assert shown[3][2] == [[on, off], [on, on]] and shown[3][1][1] == [0, 0]  # the third is taken back
    rows = [[0] * 2, [1] * 2, [2] * 2, [3] * 2, [0] * 2, [1] * 2, [2] * 2, [3] * 2, [0] * 2]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    tall = b"GIF89a" + struct.pack("<HHBBB", 2, 9, 0x81, 0, 0) + palette + picture([x for k in order for x in rows[k]], 2, 9, interlaced=True) + b"\x3b"
    ((_, frames, _),) = gif.decoded([tall])
    colours = [[255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]]
    assert next(iter(frames)).rgba[:, 0, :3].tolist() == [colours[r[0]] for r in rows]


def test_faults_of_media():
    whole = gif.encode_payloads([bytes(range(64)) * 10])[0]
    at = whole.index(b"\x2c\0\0\0\0")

    def fault(data: bytes) -> str | None:
        ((_, frames, error),) = gif.decoded([data])
        assert error is None or not [*frames]
        return error

    assert fault(whole) is None
    assert fault(whole[: at + 1] + b"\1" + whole[at + 2 :]) == "a picture beyond the canvas"
    assert "canvas of 65535" in fault(whole[:6] + b"\xff\xff\xff\xff" + whole[10:])
    short = gif.encode_payloads([bytes(64)])[0]
    stream = short[short.index(b"\x2c\0\0\0\0") + 10 :]
    assert fault(whole[: at + 10] + stream) == "a picture cut short"


def test_long_payloads_in_groups(monkeypatch):
    monkeypatch.setattr(gif, "AT_ONCE", 3000)
    payloads = [np.random.default_rng(k).integers(0, 256, 64 * n, np.uint8).tobytes() for k, n in enumerate((1, 9000, 2, 70))]
    assert gif.encode_payloads(payloads) == [gif.encode_payloads([p])[0] for p in payloads]
    for payload, (_, frames, error) in zip(payloads, gif.decoded(gif.encode_payloads(payloads)), strict=True):
        assert error is None and b"".join(f.grey() for f in frames) == payload


def test_media_of_odd_texts(spark, odd):
    rows = gif.read_gifs(gif.store_payloads(odd.select("doc_id", "text")), keep=["doc_id"]).collect()
    want = sorted((t or "").encode().ljust(max(64, -(-len((t or "").encode()) // 64) * 64), b"\0") for _, t in odd.select("doc_id", "text").collect())
    assert sorted(bytes(r.samples) for r in rows) == want
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"GIF89a")), (3, bytearray(b"nonsense" * 9))], "doc_id int, media binary")
    assert all(r.samples is None and r.error for r in gif.read_gifs(bad).collect())


# 4 -----------------------------------------------------------------------------------------------------------------


def brute_substrings(rows, n):
    key = lambda i: (i is None, i or 0)
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - n + 1):
            k = tuple(w[j : j + n])
            if k not in first or key(i) < key(first[k]):
                first[k] = i
    out = []
    for i, w in words:
        gone = {x for j in range(len(w) - n + 1) if key(first[tuple(w[j : j + n])]) < key(i) for x in range(j, j + n)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 5])
def test_substring_dedup(spark, bits):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choices("abé", k=2)) for _ in range(3)]
    rows = [(rnd.choice([None, *range(-9, 10)]), rnd.choice([None, ""]) if rnd.random() < 0.1 else rnd.choice([" ", "\t", "  \n", "\xa0", "\x1c"]).join(rnd.choices(vocabulary, k=rnd.randint(1, 60)))) for _ in range(70)]
    got = substrings.dedup_substrings(frame(spark, rows), hash_bits=bits).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_substrings(rows, 13)
    assert all(f.words >= 13 and (r.doc_id is None or f.source < r.doc_id) for r in got for f in r.factors)


def test_factors_are_parts_of_their_sources(spark):
    texts = {r.doc_id: (r.text or "").encode().split() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = substrings.dedup_substrings(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_substrings([(i, b" ".join(w).decode()) for i, w in texts.items()], 13)
    factors = [(r.doc_id, f) for r in got for f in r.factors]
    assert len(factors) > 20
    for i, f in factors:
        own, source = texts[i][f.start : f.start + f.words], texts[f.source]
        assert own == source[f.source_start : f.source_start + f.words]


def test_greedy_factoring():
    rnd = random.Random(11)
    for _ in range(200):
        texts = [np.array(rnd.choices(range(rnd.randint(1, 4)), k=rnd.randint(0, 40)), np.int64) for _ in range(rnd.randint(1, 3))]
        block, body, least = factoring.Block(texts), np.array(rnd.choices(range(4), k=rnd.randint(0, 40)), np.int64), rnd.randint(1, 4)
        held = {tuple(t[i:j].tolist()) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)}
        want, missing, i = [], [], 0
        while i + least <= len(body):
            n = max(n for n in range(len(body) - i + 1) if n == 0 or tuple(body[i : i + n].tolist()) in held)
            if n >= least:
                want.append((i, n))
            else:
                missing.append(i)
            i += n - least + 1 if n >= least else 1
        factors, lacking = block.factors(body, least)
        assert ([f[:2] for f in factors], lacking) == (want, missing)
        assert all(any(t[at : at + n].tolist() == body[i : i + n].tolist() for t in texts) for i, n, at in factors)


def thue_morse():
    """Two different words of 1,024 letters that polynomials modulo a power of two do not tell apart."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_fool_polynomials(spark):
    one, other = thue_morse()
    rows = [(1, " ".join([one] * 13)), (2, " ".join([other] * 13))]
    assert [(r.doc_id, r.n_removed) for r in substrings.dedup_substrings(frame(spark, rows)).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]
    assert [r.component_id for r in jaccard.near_duplicate_groups(frame(spark, rows)).orderBy("doc_id").collect()] == [1, 2]


def test_substring_dedup_of_odd_texts(odd):
    assert substrings.dedup_substrings(odd).count() == odd.count()
    assert substrings.dedup_substrings(odd.limit(0)).count() == 0


def test_words_and_runs(monkeypatch):
    rnd = random.Random(12)
    texts = ["", "  ", *(rnd.choice([" ", "\n\t", "  "]).join("".join(rnd.choices("abé", k=rnd.choice([1, 7, 8, 9, 16, 127, 128, 129, 400]))) for _ in range(rnd.randint(0, 12))) for _ in range(60)), "a b", "A B"]
    texts = [t.encode() for t in texts]
    words, split = hashing.Words(texts, True), [w.lower() for t in texts for w in t.split()]
    assert words.counts.tolist() == [len(t.split()) for t in texts]
    assert [words.raw[a:b] for a, b in zip(words.starts, words.ends, strict=True)] == split
    for which in (0, 1):
        assert len({(w, h) for w, h in zip(split, words.hashes(which).tolist(), strict=True)}) == len(set(split)) == len(set(words.hashes(which).tolist()))
    a, b = (np.array(rnd.choices(range(len(split)), k=5000)) for _ in range(2))
    assert words.equal(a, b).tolist() == [split[i] == split[j] for i, j in zip(a, b, strict=True)]
    lexicon = hashing.Lexicon()
    whole = [lexicon.numbers(t).tolist() for t in texts]
    monkeypatch.setattr(hashing, "PIECE", 10)
    assert [lexicon.numbers(t).tolist() for t in texts] == whole
    runs = exchange.Runs([b"a b c d", b"", b"a b", b"a b c d"], 3, True, True)
    assert runs.counts.tolist() == [2, 0, 1, 2] and runs.first.tolist() == [*runs.first[:3], *runs.first[:2]]
    assert runs.equal(np.array([0, 0, 1, 2]), np.array([3, 4, 4, 0])).tolist() == [True, False, True, False]


# 5 -----------------------------------------------------------------------------------------------------------------


def test_language_id(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = langid.identify_languages(docs, docs.where(~held), keep=["doc_id", "lang"]).where(held).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    got = langid.identify_languages(odd, docs.where(~held), keep=["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify_languages(odd, docs.limit(0)).collect()} == {"und"}
    assert langid.identify_languages(odd.limit(0), docs).count() == 0


def test_languages_of_long_documents_are_learned(spark):
    rows = [(i, "the cat sat on the mat and looked at the dog", "en") for i in range(20)] + [(100 + i, "é" + "le chat et le chien dans la maison " * 2000, "fr") for i in range(3)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = langid.training_sample(train, "doc_id", "text", "lang", 40, langid.MAX_BYTES)
    assert {x: len(t) for x, t in learned.items()} == {"en": 20, "fr": 3} and all(len(t) == langid.MAX_BYTES for t in learned["fr"])
    asked = frame(spark, [(1, "le chien et le chat"), (2, "the dog and the cat")])
    assert {r.doc_id: r.lang_pred for r in langid.identify_languages(asked, train).collect()} == {1: "fr", 2: "en"}
    many = spark.createDataFrame([(1000 * k + i, f"text {k}", f"l{k}") for k in range(20) for i in range(30)], "doc_id bigint, text string, lang string")
    assert len(langid.training_sample(many, "doc_id", "text", "lang", 20, langid.MAX_BYTES)) == 20


def test_code_lengths_by_table_and_by_tree():
    model = langid.Model({"a": [b"banana band"] * 3, "b": [b"abracadabra", b""]})
    texts = [b"banana", b"zzz", b"Abra cad", "éa".encode()]
    for text, (_, _, bits) in zip(texts, model.predict(texts), strict=True):
        keys = langid.grams(np.frombuffer(bytes(4) + text.lower(), np.uint8), 5)[4:]
        assert np.allclose(bits, [t.cost(keys).sum() for t in model.trees], rtol=1e-5)
    for tree in model.trees:  # after any context the seen symbols and the escape make one
        for k, contexts in enumerate(tree.contexts):
            seen = np.searchsorted(contexts, tree.symbols[k] >> np.uint64(8))
            assert np.allclose(np.bincount(seen, 2.0 ** -tree.bits[k]) + 2.0 ** -tree.escapes[k], 1)


def ppm_bits(train: list[bytes], text: bytes) -> float:
    """Code length by counts in plain dictionaries: method C, orders 4 to 0, then 8 bits."""
    counts: dict[bytes, dict[int, int]] = {}
    for t in train:
        t = bytes(4) + t.lower()
        for i in range(4, len(t)):
            for k in range(5):
                own = counts.setdefault(bytes([k]) + t[i - k : i], {})
                own[t[i]] = own.get(t[i], 0) + 1
    total, text = 0.0, bytes(4) + text.lower()
    for i in range(4, len(text)):
        for k in (4, 3, 2, 1, 0, -1):
            own = counts.get(bytes([k]) + text[i - k : i], {}) if k >= 0 else {}
            if text[i] in own:
                total -= np.log2(own[text[i]] / (sum(own.values()) + len(own)))
                break
            total += 8 if k < 0 else -np.log2(len(own) / (sum(own.values()) + len(own))) if own else 0
    return total


@pytest.mark.parametrize("piece", [langid.PIECE, 7])
def test_code_lengths_by_plain_dictionaries(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    rnd = random.Random(3)
    words = ["banana", "Band", "abra", "cadabra", "é", "zz", ". ", " "]
    train = {x: ["".join(rnd.choices(words, k=30)).encode() for _ in range(3)] for x in ("a", "b")}
    texts = ["".join(rnd.choices([*words, "q"], k=k)).encode() for k in (1, 2, 9, 40)]
    for text, (lang, score, bits) in zip(texts, langid.Model(train).predict(texts), strict=True):
        want = [ppm_bits(train[x], text) for x in ("a", "b")] if langid.has_letter(text) else []
        assert np.allclose(bits, want, rtol=1e-12)
        if want:
            assert lang == "ab"[int(np.argmin(want))] and np.isclose(score, 1 / (1 + 2.0 ** -abs(want[0] - want[1])))


def test_any_part_of_a_long_text_may_be_learned(spark):
    rows = [(i, "a" * 400 + "b" * 400 + "é" * 200, "x") for i in range(60)]
    learned = langid.training_sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang", 60, 100)["x"]
    assert all(98 <= len(t) <= 100 for t in learned) and {c for t in learned for c in t.decode()} == set("abé")


# 6 -----------------------------------------------------------------------------------------------------------------


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.A.com/x/?b=2&utm_source=q&a=1#f", 10, 200, {"etag": '"1"', "content-type": "t", "date": "10"}, "d1"),
        (2, "response", "https://a.com/x?a=1&b=2", 9000, 200, {"last-modified": "m", "content-type": "u"}, "d2"),
        (3, "response", "https://a.com/x?a=1&b=2", 9500, 404, {}, "d3"),
        (4, "revisit", "https://a.com:443/x?b=2&a=1", 20, 304, {"etag": 'W/"1"', "content-type": "no", "date": "20"}, None),
        (5, "revisit", "a.com/x?a=1&b=2", 9999, 304, {"last-modified": "n", "etag": "z"}, "d2"),
        (6, "revisit", "a.com/x?a=1&b=2", 9999, 304, {}, "d2"),
        (7, "revisit", "a.com/x?a=1&b=2", 9999, 304, None, None),
        (8, "revisit", "a.com/x?a=1&b=2", 5, 304, {}, None),
        (9, "revisit", None, 5, 304, {}, None),
        (10, "revisit", "a.com/x?a=1&b=2", None, 304, {}, None),
    ]
    records = spark.createDataFrame(rows, "record_id bigint, type string, url string, captured_at bigint, status int, headers map<string,string>, digest string")
    got = {r.record_id: (r.refers_to, r.outcome, r.headers) for r in warc.resolve_revisits(records).collect()}
    assert got[4] == (1, "resolved", {"etag": 'W/"1"', "content-type": "t", "date": "20"})
    assert got[5][:2] == (2, "mismatch") and got[6] == (2, "resolved", {"last-modified": "m", "content-type": "u"})
    assert got[7] == (2, "unvalidated", None)
    assert {got[k] for k in (8, 9, 10)} == {(None, "missing", None)} if False else all(got[k] == (None, "missing", None) for k in (8, 9, 10))
    assert warc.resolve_revisits(records.limit(0)).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------------


def brute_base(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_base_spans():
    rnd = random.Random(8)
    parts = ["password", "Api_Key", "apikey", "TOKEN", "secret", "=", ":", " ", '"', "'", "é", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "deadbeef", "abc", "xyz_.", "日", "ſecret", "toKen"]
    for _ in range(3000):
        t = "".join(rnd.choices(parts, k=rnd.randint(0, 14)))
        assert [f"{k}:{a}:{b}" for k, a, b, _ in secrets.scan_text(t.encode()) if k != "guess"] == brute_base(t)


def test_guess_cost_is_the_cheapest_segmentation():
    cost = lambda v: secrets.guess_cost(v)[0]
    kinds = lambda v: [k for k, _, _ in secrets.guess_cost(v)[1]]
    assert cost("") == 0 and kinds("password1987") == ["word", "date"] and kinds("aaaaaaaa") == ["repeat"] and "walk" in kinds("zxcvbnm,./")
    assert cost("password") < cost("P4ssw0rd") < cost("correcthorse") < cost("kj3X9qLwz8Tt")

    def least(v):  # all segmentations
        if not v:
            return 0.0
        return min(part_cost(v[:k]) + (0.30103 + least(v[k:]) if k < len(v) else 0) for k in range(1, len(v) + 1))

    def part_cost(v):
        whole, parts = secrets.guess_cost(v)
        return whole if len(parts) == 1 else sum(np.log10(secrets._alphabet(c)) for c in v)

    for v in ("love2love", "qwe1999x", "abab12", "m0nkey!!"):
        assert abs(cost(v) - least(v)) < 1e-4


def test_long_context_values_are_whole(spark):
    long = "eyJhbGciOiJIUzI1NiJ9." + "aZ3_9-xQ7" * 30
    found = [x for x in secrets.scan_text(f"x auth: {long} end".encode())]
    assert [(k, a, b) for k, a, b, _ in found if k == "guess"] == [("guess", 8, 8 + len(long))]
    rows = frame(spark, [(1, f"access_key={long} y"), (2, f'pwd="{"".join(random.Random(6).choices("Q7x#kP", k=160))}"')])
    assert {r.doc_id: r.text for r in secrets.redact_secrets(rows).collect()} == {1: "access_key=[secret] y", 2: 'pwd="[secret]"'}
    value = "".join(random.Random(4).choices("abcXYZ0189", k=300))
    (span,) = [x for x in secrets.scan_text(f"password={value}".encode()) if x[0] == "assign"]
    assert span[3] == secrets.guess_cost(value)[0] > 100


def test_guess_cost_of_all_segmentations():
    rnd = random.Random(5)

    def part(v, i, j):  # cheapest single part
        low, out = v[i:j].lower(), [sum(np.log10(secrets._alphabet(c)) for c in v[i:j])]
        for form, extra in ((low, 0), (low.translate(secrets.LEET), 1)):
            if j - i >= 3 and (rank := secrets.RANKS.get(form)):
                out.append(np.log10(2 * rank) + 0.30103 * (extra + (v[i:j] != low)))
        if secrets.DATE.fullmatch(v[i:j]):
            out.append(np.log10(200 if j - i == 4 else 73_000))
        for p in range(1, min((j - i) // 2, 8) + 1):
            if j - i >= 3 and (j - i) % p == 0 and v[i : i + p] * ((j - i) // p) == v[i:j]:
                out.append(sum(np.log10(secrets._alphabet(c)) for c in v[i : i + p]) + np.log10((j - i) // p))
        if j - i >= 3 and all(b in secrets.NEAR.get(a, ()) for a, b in zip(low, low[1:])):
            out.append(np.log10(47) + (j - i - 1) * np.log10(2.5))
        return min(out)

    for _ in range(150):
        v = "".join(rnd.choices(["a", "ab", "love", "L0ve", "qwer", "sdf", "1999", "2001", "x", "7", "#", "é"], k=rnd.randint(1, 6)))
        best = [0.0]
        for j in range(1, len(v) + 1):
            best.append(min(best[i] + (0.30103 if i else 0) + part(v, i, j) for i in range(j)))
        cost, parts = secrets.guess_cost(v)
        assert abs(cost - best[-1]) < 1e-4, v
        assert [a for _, a, _ in parts] == [0, *[b for _, _, b in parts]][:-1]


def test_letters_only_values_are_judged_by_cost(spark):
    secret = {1: "pwd: qXzRtYvLmNpKsWdF", 2: "passphrase is xkqjhzvbnwpt"}
    prose = {3: "the secret is well-known", 4: "a password is mandatory", 5: "the token is extraordinary here", 6: "login: required", 7: "the pin is long-lost"}
    got = {r.doc_id: r.text for r in secrets.redact_secrets(frame(spark, [*secret.items(), *prose.items()])).collect()}
    assert got == {1: "pwd: [secret]", 2: "passphrase is [secret]", **prose}


def test_secret_scan_of_odd_texts(spark, odd):
    assert all(r.found == [] for r in secrets.scan_secrets(odd).collect())
    rows = frame(spark, [(1, "é password=hunter2secret99 x"), (2, None), (3, "pwd: Zk9#qP2$vL"), (4, "clean")])
    assert {r.doc_id: r.text for r in secrets.redact_secrets(rows).collect()} == {1: "é [secret] x", 2: None, 3: "pwd: [secret]", 4: "clean"}
    assert secrets.redact_secrets(rows).columns == rows.columns


# 9 -----------------------------------------------------------------------------------------------------------------


def test_bpe_like_the_library(spark, odd):
    public_tokenizers, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public_tokenizers.path(queries.VOCABULARY)
    library, own = tokenizers.Tokenizer.from_file(path), bpe.WordBpe(bpe.read_definition(path))
    rnd = random.Random(9)
    letters = list("ab's tldvem'129 \t\n\x1c\x1d\x85\xa0éÉßǗ̈ΣσςİIı日²<|>.!,‍　Kſ")
    texts = [t for t in ODD if t is not None] + ["<|endoftext|>x <|startoftext|> <|ENDOFTEXT|>", "it's WE'LL 12½ ﬁ"] + ["".join(rnd.choices(letters, k=rnd.randint(1, 30))) for _ in range(2000)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.both(t) == (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
    assert bpe.bpe_round_trip(odd, path).count() == odd.count()


# 10 ----------------------------------------------------------------------------------------------------------------


def brute_groups(rows, n=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(1, len(w))))})
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            i, j, s = rows[x][0], rows[y][0], len(sets[x] & sets[y])
            if i is not None and j is not None and s and 100 * s >= 75 * (len(sets[x]) + len(sets[y]) - s):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i) if s else i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


@pytest.mark.parametrize(("full_from", "bits"), [(64, 64), (0, 64), (64, 6)])
def test_jaccard_groups(spark, monkeypatch, full_from, bits):
    monkeypatch.setattr(jaccard, "_FULL_FROM", full_from)
    rnd = random.Random(10 + full_from)
    base = [" ".join(rnd.choices("abcdefgh", k=40)) for _ in range(4)]
    rows = []
    for _ in range(160):
        w = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice("xyzABC")
        rows.append((rnd.choice([None, *range(-5, 140)]), None if rnd.random() < 0.03 else " ".join(w[: rnd.randint(0, 8)] if rnd.random() < 0.2 else w)))
    got = jaccard.near_duplicate_groups(frame(spark, rows), hash_bits=bits).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_groups(rows)


def test_jaccard_groups_of_odd_texts(odd):
    assert jaccard.near_duplicate_groups(odd).count() == odd.count()
    assert jaccard.near_duplicate_groups(odd.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(50, 100)] + [(7, 7), (None, 3), (5, 4)]
    got = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {k: 0 for k in range(21)} | {k: 50 for k in range(50, 101)}


# the pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    leaders = {r[0] for r in p.one_of_each_group(spark, docs, sf_dir).select("doc_id").collect()}
    assert leaders == {c for _, _, c in brute_groups([*texts.items()])}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r[0] for r in p.drop_contaminated(spark, docs, sf_dir).select("doc_id").collect()}
    some = [*texts][::8]
    assert {i for i in some if not brute_hits(texts[i], items)[4]} == kept & {*some}
    last = {r.doc_id: r for r in p.tokenise(spark, docs.limit(20), sf_dir).collect()}
    assert all(len(r.token_ids) == r.n_tokens and hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest() == r.ids_sha256 for r in last.values())
    assert p.run(spark, sf_dir).count() <= len(leaders)
