"""The template tree against a plain recursive version of the same rules."""

import math
import random
from collections import defaultdict

from fathomlens.llm.url_filter import FANOUT, PRIOR, RARE, REJECT, SIMILAR, STEPS, STRENGTH, judge_urls, templates


def smooth(bad, labelled, prior):
    return (bad + STRENGTH * prior) / (labelled + STRENGTH)


def share(bad, labelled):
    return (bad + 0.5) / (labelled + 1)


def spread(s, n):
    return s * (1 - s) / n


def branches(kids):
    """name of each child segment's branch, with the branch's (bad, labelled); kids: segment -> [n, bad, good]."""
    n_all, bad_all, labelled_all = (sum(f(k) for k in kids.values()) for f in (lambda k: k[0], lambda k: k[1], lambda k: k[1] + k[2]))
    named, sums = {}, defaultdict(lambda: [0, 0])
    for segment, (n, bad, good) in kids.items():
        own, others = bad + good, labelled_all - bad - good
        name = segment
        if len(kids) > FANOUT and n < RARE * n_all:
            s, beside = share(bad, own), share(bad_all - bad, others)
            apart = own > 0 and (others == 0 or abs(s - beside) > SIMILAR * math.sqrt(spread(s, own) + spread(beside, max(others, 1))))
            name = f"*{math.floor(s * STEPS + 0.5) / STEPS:.2f}" if apart else "*"
        named[segment] = name
        sums[name][0] += bad
        sums[name][1] += own
    order = sorted((share(*v), name) for name, v in sums.items() if v[1])
    groups = []
    for s, name in order:
        if groups and s - groups[-1][-1][0] <= SIMILAR * math.sqrt(spread(s, sums[name][1]) + spread(groups[-1][-1][0], sums[groups[-1][-1][1]][1])):
            groups[-1].append((s, name))
        else:
            groups.append([(s, name)])
    out = {name: (name, 0, 0) for name in sums}
    for group in groups:
        names = sorted(name for _, name in group)
        label = names[0] if len(names) == 1 else "{" + "|".join(names) + "}"
        for name in names:
            out[name] = (label, sum(sums[x][0] for x in names), sum(sums[x][1] for x in names))
    return {segment: out[name] for segment, name in named.items()}


def tree(shapes, level=0, template="", prior=PRIOR):
    """(shape, template, purity) of the shapes of one node: (segments, n, bad, good)."""
    if len(shapes) == 1:
        (s, _, bad, good) = shapes[0]
        return [(s, template + "".join("/" + x for x in s[level:]), smooth(bad, bad + good, prior))]
    bad_all, labelled_all = sum(x[2] for x in shapes), sum(x[2] + x[3] for x in shapes)
    ending, going = [x for x in shapes if len(x[0]) <= level], [x for x in shapes if len(x[0]) > level]
    end_bad, end_labelled = sum(x[2] for x in ending), sum(x[2] + x[3] for x in ending)
    out = [(x[0], template, smooth(end_bad, end_labelled, smooth(bad_all - end_bad, labelled_all - end_labelled, prior))) for x in ending]
    kids = defaultdict(lambda: [0, 0, 0])
    for s, n, bad, good in going:
        for i, x in enumerate((n, bad, good)):
            kids[s[level]][i] += x
    nodes = defaultdict(list)
    for x in going:
        nodes[branches(kids)[x[0][level]]].append(x)
    for (name, bad, labelled), own in nodes.items():
        out += tree(own, level + 1, f"{template}/{name}", smooth(bad_all - bad, labelled_all - labelled, prior))
    return out


def random_shapes(rnd, most):
    shapes = {}
    for _ in range(most):
        path = [rnd.choice("abcdef")]
        if rnd.random() < 0.8:
            path.append(f"s{int(rnd.paretovariate(0.5)) % 60}")
        if rnd.random() < 0.5:
            path += rnd.choices("xyz", k=rnd.randint(0, 4))
        n = rnd.choice([1, 1, 2, 5, 40])
        known = rnd.randint(0, n)
        bad = known if path[0] == "a" or path[-1] == "z" else rnd.choice([0, 0, known // 2])
        shapes[tuple(path)] = (list(path), n, bad, known - bad)
    return list(shapes.values())


def test_templates_and_purity_match_the_plain_tree(spark):
    rnd = random.Random(4)
    hosts = {f"h{i}": random_shapes(rnd, m) for i, m in enumerate((1, 2, 5, 30, 120))}
    rows = [(h, *x) for h, shapes in hosts.items() for x in shapes]
    got = {(r.host, tuple(r.shape)): (r.template, round(r.purity, 9)) for r in templates(spark.createDataFrame(rows, "host string, shape array<string>, n long, bad long, good long")).collect()}
    want = {(h, tuple(s)): (t, round(p, 9)) for h, shapes in hosts.items() for s, t, p in tree(shapes)}
    assert got == want
    assert any("*" in t for t, _ in want.values()) and any("{" in t for t, _ in want.values())


def test_the_tree_decides_within_a_host(spark):
    """A page without label is judged by its section, not its host, and long paths keep their sections."""
    rows = [(i, f"http://h.net/p/q/r/{s}/page-{i}") for i, s in enumerate(["spam"] * 30 + ["docs"] * 30)]
    labels = [(i, int(i < 30)) for i in range(60) if i % 3]
    rows += [(100, "http://h.net/p/q/r/spam/other-77"), (101, "http://h.net/p/q/r/docs/other-78"), (102, "http://h.net/p/q/r/" + "x/" * 300), (103, None), (104, ""), (105, "no scheme/a/b")]
    rows += [(106, rows[0][1]), (106, rows[0][1])]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, verdict string")
    out = judge_urls(pages, [], labels=spark.createDataFrame(labels, "page_id long, bad int")).collect()
    got = {r.page_id: r.verdict for r in out}
    assert len(out) == len(rows)
    assert [got[i] for i in (0, 100, 106)] == ["block"] * 3 and [got[i] for i in (30, 101, 103, 104, 105)] == ["allow"] * 5
    assert all(0 <= r.purity <= 1 for r in out) and REJECT > PRIOR
    assert {r.verdict for r in judge_urls(pages, []).collect()} == {"allow"}  # without labels nothing is rejected


def test_long_common_paths_are_passed_over_at_once(spark, monkeypatch):
    """Two paths of 700 segments that differ at the end take two rounds, not 700."""
    from fathomlens.llm import url_filter

    written = []
    monkeypatch.setattr(url_filter, "cut", lambda df, cut=url_filter.cut: written.append(1) or cut(df))
    long = [f"s{i}" for i in range(699)]
    rows = [("h", [*long, "a"], 3, 3, 0), ("h", [*long, "b"], 2, 0, 2), ("h", long, 1, 0, 0), ("g", ["x"], 1, 1, 0), ("g", [], 1, 0, 1)]
    got = {(r.host, tuple(r.shape)): (r.template, round(r.purity, 9)) for r in templates(spark.createDataFrame(rows, "host string, shape array<string>, n long, bad long, good long")).collect()}
    want = {(h, tuple(s)): (t, round(p, 9)) for h in "hg" for s, t, p in tree([r[1:] for r in rows if r[0] == h])}
    assert got == want and len(written) < 16


def test_pages_are_labelled_by_their_text(spark):
    """Sections of a host whose pages say nothing go, those with prose stay, and no word of a host decides."""
    from fathomlens.llm.quality import fit
    from fathomlens.llm.url_filter import content_labels

    rnd = random.Random(6)
    words = [f"{a}{b}" for a in ("ta", "lo", "mi", "ren", "sha") for b in ("ver", "ling", "don", "per", "cot")]
    prose = lambda: " ".join(rnd.choice(words) for _ in range(80)) + "."
    junk = lambda: " ".join(["buy"] * 40 + ["###", "777"] * 15)
    docs = spark.createDataFrame([(i, prose() if i % 2 else junk()) for i in range(160)], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int"))
    page = lambda text: f"<html><nav>menu</nav><article><p>{text}</p></article></html>"
    rows = [(i, f"http://adult.net/docs/page-{i}x{i}", page(prose())) for i in range(20)] + [(100 + i, f"http://adult.net/shop/page-{i}x{i}", page(junk())) for i in range(20)]
    rows += [(200, "http://adult.net/shop/other", None), (201, "http://adult.net/docs/other", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = content_labels(pages, model)
    assert {r.page_id: r.bad for r in labels.collect()} == {r[0]: int(r[0] >= 100) for r in rows[:40]}
    got = {r.page_id: r.verdict for r in judge_urls(pages, [], labels=labels).collect()}
    assert {got[i] for i in (*range(20), 201)} == {"allow"} and {got[i] for i in (*range(100, 120), 200)} == {"block"}
