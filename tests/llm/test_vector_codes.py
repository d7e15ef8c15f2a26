import math
import random

import pytest

from fathomlens.llm.vector_codes import cuts, digest, label_errors, op11_vector_code_compression, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, error string, size string"


def plain(rows, entries=16, rounds=6, parts=8):
    """(code, error) of each kept row and the codebooks, part by part, with plain integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label, *_ in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    at = cuts(len(kept[0][1]), parts)
    pieces = [[r[1][a:b] for r in kept] for a, b in zip(at, at[1:])]  # noqa: B905
    books = [[list(x) for x in p[:entries]] for p in pieces]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in zip(pieces, books, strict=True):
            owner = [near(x, book)[1] for x in p]
            for e in range(len(book)):
                own = [x for x, o in zip(p, owner, strict=True) if o == e]
                if own:
                    book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    best = [[near(x, book) for x in p] for p, book in zip(pieces, books, strict=True)]
    return [(r[0], [b[i][1] for b in best], sum(b[i][0] for b in best), r[2]) for i, r in enumerate(kept)], books


@pytest.mark.parametrize("n", [1, 5, 400])
def test_same_as_plain(spark, n):
    rnd = random.Random(n)
    rows = [(i // 2 if i < 9 else i, [rnd.choice([rnd.gauss(0, 0.3), -0.25, 0.5]) for _ in range(19)], rnd.choice([1, 2, None]), "x", "y") for i in range(n)]
    rows += [(-1, None, 1, "x", "y"), (-2, [float("nan")] * 19, 1, "x", "y"), (-3, [None] + [0.5] * 18, 1, "x", "y"), (-4, [float("-inf")] * 19, 2, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    coded, books = vector_codes(df)
    rows = [tuple(r) for r in df.collect()]  # as float32
    want, entries = plain(rows)
    got = label_errors(coded).collect()
    assert sorted(map(repr, ((r.vec_id, r.codes, r.error, r.label) for r in got))) == sorted(map(repr, want))
    assert [p.tolist() for p in books[19].parts] == entries
    assert {(r.label, r.label_error) for r in got} == {(k, sum(w[2] for w in want if w[3] == k)) for k in {w[3] for w in want}}


def test_odd_vectors(spark):
    rows = [(1, [], 1, "", ""), (2, [], None, "", ""), (3, [1e30] * 8, 1, "", ""), (3, [1e30] * 8, 1, "", ""), (None, [-1e30] * 8, 1, "", ""), (4, [0.1, 0.2], None, "", "")]
    coded, books = vector_codes(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r["size"], r.vec_id or 0, r.codes, r.error) for r in label_errors(coded).collect())
    assert got == [(0, 1, [0] * 8, 0), (0, 2, [0] * 8, 0), (2, 4, [0] * 8, 0), (8, 0, [2] * 8, 0), (8, 3, [0] * 8, 0), (8, 3, [0] * 8, 0)]
    assert sorted(books) == [0, 2, 8] and len(digest(books)) == 64
    none, books = vector_codes(spark.createDataFrame([], SCHEMA))
    assert label_errors(none).count() == 0 and not books


def test_query(spark):
    got = op11_vector_code_compression(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert all(len(r.code) == 16 for r in got.collect())
