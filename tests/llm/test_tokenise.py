from __future__ import annotations

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lanternfish.llm import tokenise as T

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

LIBRARY = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True
OWN = T.encoder(*T.vocabulary_path())


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@given(st.text(max_size=60))
def test_any_text(text):
    assert OWN.encode([text])[0].tolist() == library(text)


def test_hard_words():
    r = random.Random(4)
    texts = ["".join(r.choice("etaoinshrdlu '\t\n09é山🙂<|endoftext|>") for _ in range(r.randint(1, 80))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a" * 20_000, " " * 5000, "ab" * 9000, "🙂" * 2000]
    assert [x.tolist() for x in OWN.encode(texts)] == [library(t) for t in texts]


def test_verification_is_needed_and_suffices():
    words = list({w for t in ("unbelievable hypothesization of Thorrkbury",) for w in OWN.words.findall(t)})
    words += ["".join(random.Random(i).choices("abcdefghijklmnop", k=9)) for i in range(500)]
    proposed = [OWN.propose(w.encode()) for w in words]
    exact = [OWN.exact(w.encode()) for w in words]
    assert proposed != exact and OWN.encode_words(words) == exact


def test_table(spark, cluttered):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "Hello world"), (5, "x" * 100_000)]
    df = cluttered(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.ids for r in T.document_ids(df).collect()}
    assert got == {i: library(t) if t else [] for i, t in rows}
    assert {r.doc_id: r.n for r in T.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), to="n").collect()} == {k: len(v) for k, v in got.items()}
    assert T.document_ids(df.limit(0)).count() == 0
    assert T.document_ids(df).schema["ids"].dataType.simpleString() == "array<int>"
