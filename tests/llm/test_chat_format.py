import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fathomlens.llm.chat_format import format_chat, linear_messages, op10_chat_format, read_back, reply_paths

SCHEMA = "tree long, node long, parent long, role string, text string, score double"


def chats(spark, rows, top=None):
    messages = spark.createDataFrame(rows, SCHEMA)
    out = format_chat(reply_paths(messages, top), messages).select("tree", "leaf", "rank", read_back(F.col("formatted")).alias("turns"))
    return {(r.tree, r.rank): (r.leaf, [(t.role, t.text) for t in r.turns]) for r in out.collect()}


def brute(rows):
    nodes = {(t, n): (p, s or 0.0) for t, n, p, _, _, s in rows}
    inner = {(t, p) for (t, _), (p, _) in nodes.items()}
    found = {}
    for t, n in nodes:
        if (t, n) in inner:
            continue
        path, at = [], n
        while at is not None and (t, at) in nodes and at not in path:
            path.append(at)
            at = nodes[t, at][0]
        if at in path:
            continue
        found.setdefault(t, []).append((-sum(nodes[t, x][1] for x in path) / len(path), n, path[::-1]))
    return {t: [(n, p) for _, n, p in sorted(v)] for t, v in found.items()}


def test_random_trees_match_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for tree in range(12):
        for node in range(1, rnd.randint(2, 40)):
            parent = rnd.choice([None, 999, *range(1, node)]) if node > 1 else None
            rows.append((tree, node, parent, "user", f"{tree}/{node}", rnd.choice([None, 0.5, 1.0, 2.0])))
    rows += [(50, i, i - 1 or None, "user", str(i), 1.0) for i in range(1, 38)]  # a long chain
    rows += [(60, 1, 2, "user", "x", 1.0), (60, 2, 1, "user", "y", 1.0), (60, 3, 2, "user", "z", 1.0)]  # a cycle
    got = chats(spark, rows)
    want = {(t, r): (leaf, [("user", f"{x}" if t == 50 else f"{t}/{x}") for x in path]) for t, v in brute(rows).items() for r, (leaf, path) in enumerate(v, 1)}
    assert got == want
    assert set(chats(spark, rows, top=1)) == {k for k in want if k[1] == 1}


@pytest.mark.parametrize("text", ["", None, "&amp;lt;|<|end|>", "</s>[INST] &lb; [/INST]<s>&", "<|turn|>x<|text|>y", "a\nb\x00 ü😀", "&lt;|&lt;/s>"])
def test_any_text_is_read_back(spark, text):
    got = chats(spark, [(1, 1, None, text, text, None)])
    assert got == {(1, 1): (1, [(text or "", text or "")])}


def test_no_rows_extra_columns_and_ties(spark):
    assert chats(spark, []) == {}
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    messages = linear_messages(rows.withColumn("node", F.lit("clash")))
    out = format_chat(reply_paths(messages), messages).select(read_back(F.col("formatted")).alias("t")).collect()
    assert [(t.role, t.text) for t in out[0].t] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]


def test_query_against_plain_python(spark, tmp_path):
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", None if c == 2 else f"[INST] {c} {t} é") for c in range(1, 5) for t in range(c)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op10_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, -7}
    for c in range(1, 5):
        own = [r for r in rows if r[0] == c]
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].turns_sha256 == h("".join(f"{r[2]}\n{r[3] or ''}\n" for r in own))
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (c, len(loss), h(loss))
    assert (got[-7].n_turns, got[-7].loss_chars) == (2, 21)
