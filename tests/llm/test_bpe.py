import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathomlens.llm.bpe import Encoder, MergeAutomaton, bpe_decode, bpe_encode, op9_bpe_encode_decode

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def encoder():
    with open(FILE, encoding="utf-8") as f:
        return Encoder(f.read())


def merged(word, merges):
    """The merges applied one after another, left to right."""
    parts = list(word)
    for a, b in merges:
        out = []
        for p in parts:
            if out and out[-1] == a and p == b:
                out[-1] = a + b
            else:
                out.append(p)
        parts = out
    return parts


def test_automaton_accepts_what_merges_make():
    rnd = random.Random(1)
    for _ in range(60):
        labels, merges = list("abc"), []
        for _ in range(rnd.randint(1, 14)):
            a, b = rnd.choice(labels), rnd.choice(labels)
            if a + b not in labels:
                merges.append((a, b))
                labels.append(a + b)
        automaton = MergeAutomaton(list("abc"), merges)
        for _ in range(80):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
            assert [automaton.label[t] for t in automaton.path(word)] == merged(word, merges), (word, merges)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(max_codepoint=0x52F, exclude_categories=["Cs", "Cn"]), max_size=12), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "don't we'll", "ΑΣ σΣ", "e\u0301", "aaaa", "  ", "中文", "😀", "ﬁ"])), max_size=6).map("".join))
def test_same_as_library(library, encoder, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = encoder.encode([text])
    assert got.to_pylist()[0] == want
    assert encoder.decode(got).to_pylist()[0] == library.decode(want, skip_special_tokens=False)


def test_odd_rows(spark, odd_docs, no_docs, library):
    out = bpe_decode(bpe_encode(odd_docs, FILE), FILE)
    assert out.columns == [*odd_docs.columns, "ids", "decoded"]
    for row in out.collect():
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == want and row.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe_decode(bpe_encode(no_docs, FILE), FILE).count() == 0
    nulls = bpe_decode(spark.createDataFrame([(None,), ([],), ([320, 49407],)], "ids array<int>"), FILE).collect()
    assert [r.decoded for r in nulls][:2] == [None, ""]


def test_query(spark, tmp_path, odd_docs, library):
    odd_docs.where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in op9_bpe_encode_decode(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), h(" ".join(map(str, ids))), h(library.decode(ids, skip_special_tokens=False)))
