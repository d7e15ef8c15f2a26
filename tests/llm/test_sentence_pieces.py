import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomlens.llm import sentence_pieces
from fathomlens.llm.sentence_pieces import CharacterMap, Pieces, op12_sentencepiece_encode_decode, piece_decode, piece_encode

FILE = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=FILE)
STRANGE = ["word", "Ünï", " ", "  ", "   ", "\n", "\t", "<s>", "</s>", "▁", "12", ".", "中文", "ing", "😀", "ꙮ", "<0x0A>", "\x00", "�", "é", "xxxxxxxxxxxx", "　", "½"]


def blob():
    with open(FILE, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def own():
    return Pieces(blob())


texts = st.lists(st.one_of(st.sampled_from(STRANGE), st.text(st.characters(exclude_categories=["Cs"]), max_size=4)), max_size=20).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4))
def test_same_ids_and_spans_as_the_library(own, some):
    for text, (ids, begins, ends) in zip(some, own.encode(some), strict=True):
        assert ids.tolist() == LIBRARY.encode(text, add_eos=True)
        spans = [(p.begin, p.end) for p in LIBRARY.encode(text, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == [*spans, (len(text.encode()),) * 2]
        assert own.decode(ids) == LIBRARY.decode(ids.tolist())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=20))
def test_decodes_any_ids(own, ids):
    assert own.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_long_words_and_parts(own, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "PART", 50)
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 30)
    rnd = random.Random(3)
    for _ in range(60):
        text = "".join(rnd.choice([*STRANGE, "ab" * 60, " the", " of"]) for _ in range(120))
        assert own.encode([text])[0][0].tolist() == LIBRARY.encode(text, add_eos=True)


def test_without_byte_pieces():
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(blob())
    for p in model.pieces:
        if p.type == 6:
            p.type, p.piece = 1, f"no{p.piece}"
    model.trainer_spec.byte_fallback = False
    own, library = Pieces(model.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ("", "a", "ꙮꙮ b \n\nꙮ", "x\n", "😀\n😀 <s>"):
        assert own.encode([text])[0][0].tolist() == library.encode(text, add_eos=True)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "identity"])
def test_character_maps_of_the_library(rule):
    """The longest prefixes of compiled maps, with the source place of each character, as the library's normaliser gives them."""
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=False)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(blob())
    shape = sentencepiece_model_pb2.ModelProto()
    shape.ParseFromString(library.serialized_model_proto())
    rnd = random.Random(5)
    odd = [*STRANGE, "ｶﾞ", "ﬁ", "Ⅷ", "ǅ", "가", "ſ", "̈́", "​", "\x07", "Å", "ẞ", "㍿"]
    for squeeze in (False, True):
        shape.normalizer_spec.remove_extra_whitespaces = squeeze
        shape.normalizer_spec.add_dummy_prefix = True
        shape.normalizer_spec.escape_whitespaces = True
        model.normalizer_spec.CopyFrom(shape.normalizer_spec)
        own, library = Pieces(model.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        for _ in range(300):
            text = "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 12)))
            ids, begins, ends = own.encode([text], end=False)[0]
            pieces = library.encode(text, return_type="proto").pieces
            assert ids.tolist() == [p.id for p in pieces], text
            assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == [(p.begin, p.end) for p in pieces], text
            assert own.decode(ids) == library.decode(ids.tolist()), text


def test_map_without_rules():
    assert list(CharacterMap(b"").spans("aé")) == [("a", 0, 1), ("é", 1, 3)]


def test_odd_rows(spark, odd_docs, no_docs):
    out = piece_decode(piece_encode(odd_docs.withColumn("ENDS", odd_docs.lang), FILE), FILE)
    assert out.columns == [*odd_docs.columns, "ids", "begins", "ends", "decoded"]
    rows = out.collect()
    assert len(rows) == 13
    for r in rows:
        assert r.ids == LIBRARY.encode(r.text or "", add_eos=True) and r.decoded == LIBRARY.decode(r.ids)
        assert r.begins[-1] == r.ends[-1] == len((r.text or "").encode())
    assert piece_decode(piece_encode(no_docs, FILE), FILE).count() == 0
    nulls = piece_decode(spark.createDataFrame([(None,), ([],), ([320, 2],)], "ids array<int>"), FILE).collect()
    assert [r.decoded for r in nulls][:2] == [None, ""]
    assert piece_encode(odd_docs.where("doc_id = 3"), FILE, end=False).first().ids == []


def test_query(spark, tmp_path, odd_docs):
    odd_docs.where("doc_id is not null").write.parquet(str(tmp_path / "documents.parquet"))
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = op12_sentencepiece_encode_decode(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(found) == 11
    for r in found:
        ids = LIBRARY.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), h(" ".join(map(str, ids))), h(LIBRARY.decode(ids)))
