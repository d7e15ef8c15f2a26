import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathomlens.llm.token_counts import count_tokens, op6_token_counts, pieces

FILE = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=FILE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "Ünï", " ", " ", "  ", "\n", "\t", "<s>", "▁", "12", ".", "中文", "ing"]), max_size=60).map("".join))
def test_pieces_keep_the_count(text):
    parts = list(pieces(text, 8))
    assert sum(len(x) for x in MODEL.encode(parts)) == len(MODEL.encode(text))


def test_odd_rows(odd_docs, no_docs):
    out = count_tokens(odd_docs, FILE)
    assert sorted(out.columns) == sorted([*odd_docs.columns, "n_bytes", "over_limit"])
    for r in out.collect():
        assert (r.n_tokens, r.n_bytes) == (len(MODEL.encode(r.text or "")), len((r.text or "").encode()))
        assert r.over_limit == (r.n_tokens > 4096)
    assert count_tokens(no_docs, FILE).count() == 0


def test_other_library(odd_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    for r in count_tokens(odd_docs.where("doc_id < 6"), path).collect():
        assert r.n_tokens == len(model.encode(r.text or "", add_special_tokens=False).ids)


def test_query(spark, tmp_path, odd_docs):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert op6_token_counts(spark, str(tmp_path)).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
