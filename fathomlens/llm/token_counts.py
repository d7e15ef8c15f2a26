"""Operator 6: token counts by batch encoding that returns lengths only.

Each Arrow batch is cut into pieces of text, long texts at places where no token can
span, and the pieces are packed into calls of about BATCH_BYTES, so that one call holds
many short texts or part of a long one. Only the lengths leave the call."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_slices, tidy

BATCH_BYTES = 1 << 19
PIECE = 1 << 16
_SINGLE_SPACE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
_loaded: dict[str, tuple[Callable[[list[str]], list[int]], bool]] = {}


def _counter(name: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(texts -> token counts, whether a text may be cut at a single space) for a tokenizer file.

    Cutting is safe where every word starts with a mark that stands for the space
    before it and no token has that mark after another character: dropping the space at the cut
    leaves the mark that the library puts before every text."""
    if name not in _loaded:
        path = SparkFiles.get(name)
        if name.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
            bare = model.encode(["a b", "a", "b"], out_type=str)
            safe = not any("▁" in p.lstrip("▁") for p in pieces) and bare[0] == bare[1] + bare[2]
            _loaded[name] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], safe
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[name] = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)], False
    return _loaded[name]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """Parts of about `most` characters whose token counts add up to the text's.

    The cut is at a single space (not beside the mark that stands for it), and the space is dropped. A
    text without such a place stays whole."""
    at = 0
    while len(text) - at > most:
        cut = _SINGLE_SPACE.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def count_tokens(docs: DataFrame, tokenizer_file: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """`docs` with n_bytes, n_tokens (long) and over_limit (n_tokens > limit).

    No special tokens are added; a null or empty text counts 0. Columns of these names
    are replaced, all others and repeated rows stay."""
    docs.sparkSession.sparkContext.addFile(tokenizer_file)
    name = tokenizer_file.rsplit("/", 1)[-1]
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    at = docs.columns.index(text_col)

    def run(batches):
        count, safe = _counter(name)
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            waiting, rows, held = [], [], 0

            def flush():
                np.add.at(totals, rows, count(waiting))
                waiting.clear()
                rows.clear()

            for lo, hi in text_slices(batch.column(at)):
                for row, text in enumerate(batch.column(at).slice(lo, hi - lo).to_pylist(), lo):
                    for piece in (pieces(text) if safe else [text]) if text else ():
                        waiting.append(piece)
                        rows.append(row)
                        held += len(piece)
                        if held >= BATCH_BYTES:
                            flush()
                            held = 0
            if waiting:
                flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(totals)], [*batch.schema.names, "n_tokens"])

    counted = docs.mapInArrow(tidy(run), docs.select("*", F.lit(0).cast("long").alias("n_tokens")).schema)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return counted.select(*docs.columns, size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    if tokenizer_file is None:
        import public_tokenizers

        tokenizer_file = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_file).drop("text")
