import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tagweave.llm import jaccard_join as J
from tagweave.llm import linking
from tests.llm.conftest import ODD


def brute(rows, n, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(i)] = min(ids.get(root(i), doc_id), doc_id)
    return sorted(((rows[i][0], len(sets[i]), ids.get(root(i))) for i in range(len(rows))), key=str)


def result(docs, *options):
    return sorted((tuple(r) for r in J.near_groups(docs, *options).collect()), key=str)


def corpus(seed):
    """Short and long documents, chains of near copies around the threshold, and shared passages."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rnd.choice(words) for _ in range(60)]
    rows, base = [], []
    for i in range(260):
        kind = rnd.random()
        if kind < 0.35 or not base:
            text = [rnd.choice(words) for _ in range(rnd.choice((1, 3, 6, 9, 11, 14, 40, 120)))]
            if rnd.random() < 0.3:
                text += shared
        else:
            text = list(rnd.choice(base))
            for _ in range(rnd.choice((0, 1, 1, 2, 3))):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            if rnd.random() < 0.3:
                text.append(rnd.choice(words))
        base.append(text)
        joined = " ".join(text)
        rows.append((i * 3 % 257 + 5, joined.upper() if rnd.random() < 0.1 else joined))
    return list({r[0]: r for r in rows}.values())


@pytest.mark.parametrize("options", [(4, 85, 100), (5, 80, 100), (1, 90, 100)])
def test_groups_are_those_of_all_pairs(spark, documents, options, monkeypatch):
    rows = corpus(options[0])
    want = brute(rows, *options)
    assert result(documents(rows), *options) == want
    if options[0] == 4:
        monkeypatch.setattr(linking, "SIDE", 3)  # many cells
        monkeypatch.setattr(linking, "CELL_ROWS", 10)
        monkeypatch.setattr(linking, "ROUNDS", 1)
        monkeypatch.setattr(linking, "TRIES", 1)
        monkeypatch.setattr(linking, "BROADCAST_IDS", 0)
        assert result(documents(rows).repartition(5), *options) == want


@pytest.mark.parametrize("light", [0, 8, 16])
def test_any_boundary_gives_the_same(spark, documents, light, monkeypatch):
    rows = corpus(11)
    monkeypatch.setattr(J, "boundary", lambda *a: light)
    assert result(documents(rows), 2, 85, 100) == brute(rows, 2, 85, 100)


def test_odd_rows(spark, documents):
    rows = [*ODD, (None, "no id here"), (8, "NO id here"), (7, " \r")]
    assert result(documents(rows), 4, 85, 100) == brute(rows, 4, 85, 100)
    assert result(documents([])) == []


def test_one_id_with_unlike_texts_links_nothing(spark, documents, monkeypatch):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(1, words[0]), (1, words[1]), (1, words[1]), (2, words[1] + " x"), (3, words[0] + " y"), (1, words[2])]
    rows += [(None, words[3]), (None, words[3]), (None, words[3] + " z"), (None, words[4]), (4, words[4] + " z")]
    assert result(documents(rows)) == brute(rows, 5, 80, 100)
    rows = [(9, text) for _, text in rows[:6]] + [(5, words[2] + " x"), (6, words[0] + " y")]
    for light in (0, 24):
        monkeypatch.setattr(J, "boundary", lambda *a: light)
        assert result(documents(rows), 1, 80, 100) == brute(rows, 1, 80, 100)


def test_any_bigint_is_an_id(spark, documents):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    top, low = 2**63 - 1, -(2**63)
    rows = [(top, words[0]), (top - 1, words[0] + " x"), (1 << 62, words[1]), (top - 2, ""), (low, words[2]), (0, words[2] + " x")]
    rows += [(top - 3, words[3]), (None, words[3]), (-1, "")]
    assert result(documents(rows)) == brute(rows, 5, 80, 100)


def test_boundary_follows_cost():
    assert J.boundary({5: 10}, 85, 100) >= 5
    assert 8 <= J.boundary({s: 100 for s in range(1, 49)}, 85, 100) < J.LIGHT_LIMIT
    assert J.boundary({}, 85, 100) == 0


def test_required_and_prefix():
    for a in range(1, 60):
        for b in J.partner_sizes(a, 85, 100):
            c = J.required(a, b, 85, 100)
            assert 100 * c >= 85 * (a + b - c) and 100 * (c - 1) < 85 * (a + b - c + 1)
            assert a - c + 1 <= J.prefix_size(a, 85, 100)
            assert J.needed(a, 85, 100) <= 1 + min(J.more(a, 85, 100), J.more(b, 85, 100))


def test_lists_of_the_same_sets_are_one(spark):
    """Copies share many shingles; their lists are one. A class that shares one shingle with others meets none."""
    shared = {1: range(20), 2: range(20), 3: range(50, 70), 4: range(50, 70), 5: range(50, 70), 6: [7]}
    rows = [(node, 100, 20, list(tokens)) for node, tokens in shared.items()]
    listed = spark.createDataFrame(rows, "node BIGINT, n BIGINT, rare INT, prefix ARRAY<BIGINT>")
    lists = {}
    for r in J._meeting(listed, 80, 100).collect():
        lists.setdefault((r["key"], r["weight"]), []).append(r["node"])
    # In two size classes each, without two of the shingles.
    assert sorted((sorted(v), k[1]) for k, v in lists.items()) == [([1, 2], 36), ([3, 4, 5], 36)]


def test_sketches_deny_no_similar_pair():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) << np.uint64(40) for _ in range(60)]
    sets += [np.arange(200_000, dtype=np.uint64) << np.uint64(40), np.arange(200_010, dtype=np.uint64) << np.uint64(40)]
    batch = pa.record_batch({"node": list(range(len(sets))), "shingles": [s.tobytes() for s in sets]})
    (out,) = linking._sketches(iter([batch]))
    ns, marks = out.column(1).to_numpy(), np.stack([np.frombuffer(m.as_py(), np.uint8) for m in out.column(2)])
    allowed = linking.sketch_likeness(60, 100)
    for i, a in enumerate(sets):
        may = allowed(int(ns[i]), marks[i], ns, marks) >= 0
        for j, b in enumerate(sets):
            same = len(np.intersect1d(a, b))
            assert may[j] or 100 * same < 60 * (len(a) + len(b) - same)


def test_stars_of_long_paths(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (2000, 2000)] + [(5000, 5000 + i) for i in range(1, 200)]
    got = dict(map(tuple, linking.stars(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()))
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and 2000 not in got and got[5199] == 5000
