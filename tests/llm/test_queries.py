"""Every corpus query over whole tables: by its SQL in DuckDB, or by brute force in plain Python."""

import glob
import hashlib
import os
import re
import zlib

import duckdb
import pytest
from test_llm import brute_base

from courtline.llm import gif, queries, sql

NAMES = queries.queries()


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows(spark, sf_dir, name):
    return NAMES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", [*sql.oracle_sql()])
def test_sql_gives_the_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want, df = con.sql(sql.oracle_sql()[name]), NAMES[name](spark, sf_dir)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_media(spark, sf_dir, texts):
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op3_gif_media")}
    assert got.keys() == texts.keys()
    seen = {}
    for i, text in texts.items():
        raw, r = text.encode(), got[i]
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert seen.setdefault(text, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    some = [*texts][::20]
    for i, media in zip(some, gif.encode_payloads([texts[i].encode().ljust(max(64, -(-len(texts[i].encode()) // 64) * 64), b"\0") for i in some]), strict=True):
        assert (got[i].media_bytes, got[i].media_sha256) == (len(media), sha(media))


def test_secrets(spark, sf_dir, texts):
    for r in rows(spark, sf_dir, "op8_secret_scan"):
        want = brute_base(texts[r.doc_id])
        kinds = [s.split(":")[0] for s in want]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*(kinds.count(k) for k in ("assign", "access", "hex")), sha(",".join(want)))
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess")] == want


def test_tokens(spark, sf_dir, texts):
    public_tokenizers, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op9_bpe_round_trip")}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize(("name", "modulus", "left", "threshold"), [("op2_quality_classifier", 4, 2, 0.7), ("op7_toxicity", 5, 0, 0.5), ("op5_language_id", 5, 0, None)])
def test_predictions(spark, sf_dir, texts, name, modulus, left, threshold):
    got = {r.doc_id: r for r in rows(spark, sf_dir, name)}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == left) and 0 <= r.score <= 1
        if threshold is not None:
            assert r.predicted == int(r.score >= threshold)
        else:
            assert (r.lang_pred == "und") == (re.search(r"[^\W\d_]", texts[i]) is None)


def test_labels_of_the_held_out_fold_teach_nothing(spark, sf_dir, tmp_path):
    """Scores stay as they are when the labels of held-out rows are turned round."""
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr("*" if t == "documents" else "doc_id", *([] if t == "documents" else ["IF(crc32(CAST(doc_id AS string)) % 4 = 2, 1 - quality, quality) AS quality", "IF(crc32(CAST(doc_id AS string)) % 5 = 0, 1 - toxic, toxic) AS toxic"])).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("op2_quality_classifier", "op7_toxicity"):
        turned = {r.doc_id: r.score for r in NAMES[name](spark, str(tmp_path)).collect()}
        assert turned == {r.doc_id: r.score for r in rows(spark, sf_dir, name)}
