import random

import numpy as np
import pytest

from tagweave.llm import linking
from tagweave.llm import minhash_dedup as M
from tests.llm.conftest import ODD
from tests.llm.test_jaccard_join import brute, corpus


def result(docs, *options):
    rows = M.near_groups(docs, *options).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return sorted((tuple(r)[:3] for r in rows), key=str)


@pytest.mark.parametrize("options", [(3, 85, 100)])
def test_groups_are_those_of_all_pairs(spark, documents, options, monkeypatch):
    rows = corpus(options[0] + 20)
    want = brute(rows, *options)
    assert result(documents(rows), *options) == want
    if options[0] == 3:
        for name, value in {"SIDE": 3, "CELL_ROWS": 10, "ROUNDS": 1, "TRIES": 1, "BROADCAST_IDS": 0}.items():
            monkeypatch.setattr(linking, name, value)
        assert result(documents(rows).repartition(5), *options) == want


def test_a_family_of_a_third_of_all_rows(spark, documents):
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(300):
        text = list(base) if i % 3 == 0 else [f"u{rnd.randrange(10**6)}" for _ in range(60)]
        for _ in range(rnd.choice((1, 2, 3, 4)) if i % 3 == 0 else 0):
            text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    assert result(documents(rows), 3, 85, 100) == brute(rows, 3, 85, 100)


def test_odd_rows(spark, documents):
    rows = [*ODD, (None, "no id here"), (8, "NO id here"), (7, " \r"), (2**63 - 1, "far away id here now"), (-5, "far away id here now")]
    got = M.near_groups(documents(rows), 4, 85, 100).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute(rows, 4, 85, 100)
    assert {r["doc_id"] for r in got if r["kept"]} == {1, 2, 3, 4, 5, 6, 7, 8, -5}
    assert M.near_groups(documents([])).collect() == []
    out = M.deduplicated(documents(rows), 4, 85, 100)
    assert out.columns == documents([]).columns
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 8, -5]))


def test_minima_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    for shared in (200, 600, 900):
        a, b = rng.integers(0, 1 << 62, (2, 1000)).astype(np.uint64)
        b[:shared] = a[:shared]
        least = M.minima(np.concatenate([np.unique(a), np.unique(b)]), np.array([0, 1000]))
        agree, want = np.mean(least[:, 0] == least[:, 1]), shared / (2000 - shared)
        assert abs(agree - want) < 4.5 * (want * (1 - want) / M.MINIMA) ** 0.5
    test = M.signature_likeness(85, 100)
    mark = np.concatenate([least[:, 0].astype(np.uint16).view(np.uint8), np.full(linking.BUCKETS, 2, np.uint8)])
    assert test(1000, mark, np.array([1000, 100]), np.stack([mark, mark])).tolist() == [1.0, -1.0]
