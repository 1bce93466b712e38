import re
from collections import defaultdict

from tagweave.llm.mixing import emitted, mix_report
from tests.llm.conftest import ODD

WEIGHTS = (5, 2, 1)


def targets(sizes):
    """Shares by weight, the excess over three times the source reshared until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


def check(rows, got):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want, taken, most = targets(sizes), defaultdict(int), defaultdict(int)
    by_source = {r["doc_id"]: s for (_, _, s), r in zip(sorted(rows), sorted(got, key=lambda r: r["doc_id"]))}
    for r in got:
        s = by_source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * (1 + want[s])
        assert r["size"] * 3 >= r["taken"] >= 0 and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * most[s] + 0.02 * want[s], (s, taken[s], want[s])


def test_targets_and_taken_words(spark, documents):
    rows = [(i, "w " * (1 + i * 7 % 90), ("é", "b", "a", "c", None, "b")[i % 6]) for i in range(900)]
    rows += [(1000 + i, "x y", "tiny") for i in range(3)] + [(2000 + i, "w " * 50, "b") for i in range(2000)]
    first = mix_report(documents(rows)).collect()
    check(rows, first)
    again = mix_report(documents(rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_odd_rows(spark, documents):
    got = mix_report(documents(ODD)).collect()
    assert len(got) == len(ODD) and sum(r["taken"] for r in got) >= 0
    assert mix_report(documents([])).collect() == []
    empty = mix_report(documents([(1, ""), (2, None)])).collect()
    assert [(r["target"], r["taken"]) for r in empty] == [(0.0, 0)] * 2


def test_emitted_rows_are_copies(spark, documents):
    docs = documents([(i, "w " * 20, "ab"[i % 10 == 0]) for i in range(200)])
    out = emitted(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {r["doc_id"]: r["taken"] // 20 for r in mix_report(docs).collect() if r["taken"]}
    assert counts == want
