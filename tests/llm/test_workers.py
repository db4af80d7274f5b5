"""What Python workers keep over their tasks."""

import gc
import pickle
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from courtline.llm import bpe, decontam, secrets, toxicity
from courtline.llm.queries import VOCABULARY


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(1, "a plain text"), (2, None)], "doc_id bigint, text string")


def in_process(monkeypatch, df, make):
    """Runs the Python step that `make` maps over `df` here, as a worker would."""
    taken = []
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, run, schema: taken.append(run) or self)
        make(df)
    return list(taken[0](iter([pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "__text": ["a plain text"]})])))


def test_a_worker_forgets_what_it_kept_for_another_operator(spark, texts, monkeypatch):
    held = weakref.ref(bpe.model_of_worker(bpe.read_definition(public_tokenizers.path(VOCABULARY))))
    gc.collect()
    assert held() is not None
    assert in_process(monkeypatch, texts, lambda df: bpe.bpe_round_trip(df, public_tokenizers.path(VOCABULARY)))
    assert held() is not None  # its own tasks find it again
    assert in_process(monkeypatch, texts, secrets.scan_secrets)
    gc.collect()
    assert held() is None
    model = spark.sparkContext.broadcast({b"a b": (2, {"x"})})
    first = decontam.automaton_of_worker("first", model)
    assert decontam.automaton_of_worker("first", model) is first
    in_process(monkeypatch, texts, secrets.scan_secrets)
    assert decontam.automaton_of_worker("first", model) is not first


def test_workers_make_no_dictionary_of_terms_that_they_do_not_ask_for():
    terms = {b"alpha": 0, b"^alph": 1, "straße".encode(): 2, "^stra".encode(): 3, b"of": 4}
    index = toxicity.Index(terms, np.ones(5), [(1, 1, {0: 2, 1: 2}), (2, 0, {4: 1})])
    sent = pickle.loads(pickle.dumps(index))
    assert sent.left_out([0, 1]) == index.left_out([0, 1])
    assert "terms" not in sent.words.__dict__ and "tables" not in sent.words.__dict__
    for text in (b"alpha of alphabet", "Straße straw of".encode(), b"", None):
        for got, want in zip(sent.words.counts(text), index.words.counts(text), strict=True):
            assert got.tolist() == want.tolist()
    assert "terms" not in sent.words.__dict__ and sent.words.terms == terms and len(sent.words) == 5
    assert pickle.loads(pickle.dumps(sent)).words.terms == terms
    assert len(pickle.loads(pickle.dumps(toxicity.Vocabulary({})))) == 0
