import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casework.llm import queries, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PROOF = token_counts.prove(MODEL)
LIBRARY = token_counts._library(PROOF.model)
ODD = ["", " ", "   ", "a", "a ", " a", "\n", "a\n\nb c\n", "\tx  y", "<s> </s> <unk> <0x0A>", "▁", "a▁b ▁", "café é 　﻿", "\U0001f600\U0001f600 x\x00y", "x" * 5000, "ab" * 3000 + " tail", " " * 400 + "z", "\r\n \r", "naïve ß ÿ × ÷   \u0085"]


def test_odd_texts_count_as_the_library_does():
    counting = token_counts.Counting(PROOF)
    assert PROOF.safe and len(PROOF.whole) > 10_000 and "\n" in PROOF.lone
    for t in ODD:
        assert counting(t) == len(LIBRARY.encode(t)), repr(t)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tabeinrst.,é0<>/"), st.characters(codec="utf-8")), max_size=80))
def test_any_text_counts_as_the_library_does(t):
    assert token_counts.Counting(PROOF)(t) == len(LIBRARY.encode(t))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" ▁ab\n", max_size=60), st.integers(1, 9))
def test_slices_end_before_spaces(t, size):
    parts = list(token_counts.slices(t, size))
    assert "".join(parts) == t
    assert all(p[0] in " ▁" for p in parts[1:]) and all(p[-1] not in " ▁" for p in parts[:-1])


def test_long_text_in_slices(monkeypatch):
    text = " ".join(ODD * 40)
    whole = token_counts.Counting(PROOF)(text)
    assert whole == len(LIBRARY.encode(text))
    monkeypatch.setattr(token_counts.slices, "__defaults__", (100,))
    monkeypatch.setattr(token_counts, "KEPT", 10)
    assert token_counts.Counting(PROOF)(text) == whole


def test_unprovable_model_is_counted_whole():
    counting = token_counts.Counting(token_counts.Proof(PROOF.model, frozenset(), "", False))
    assert [counting(t) for t in ODD] == [len(LIBRARY.encode(t)) for t in ODD]


@pytest.mark.parametrize("n", [0, 3])
def test_rows(spark, n):
    rows = [(None, "a b", 1), (4, None, 2), (4, "a b", 3)][:n]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    assert sorted(map(repr, map(tuple, token_counts.count_tokens(docs, MODEL).collect()))) == sorted(map(repr, [(None, 3, 2), (4, 0, 0), (4, 3, 2)][:n]))


def test_query_equals_the_library(spark, sf_dir):
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        n = len(LIBRARY.encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    assert sorted(map(tuple, queries.op11_token_counts(spark, sf_dir).collect())) == sorted(want)
