import zlib

import numpy as np
import pyarrow as pa

from tagweave.llm import quality_model as Q
from tests.llm.conftest import ODD


def test_features_are_counted_by_document():
    texts = ["ab cd", "", None, "xyz", "ab cd"]
    value = np.random.default_rng(0).normal(size=Q.ROWS)
    total, count = Q._sums(pa.array(texts), value)
    words, grams = [3, 0, 0, 1, 3], [4 + 3 + 2, 0, 0, 2 + 1, 9]
    assert count.tolist() == [w + g for w, g in zip(words, grams)] and abs(total[0] - total[4]) < 1e-9 and total[1] == 0
    alone = Q._sums(pa.array(texts[3:4]), value)[0]
    assert abs(alone[0] - total[3]) < 1e-9
    for (rows, share), t, c in zip(Q.sparse_features(pa.array(texts)), total, count):
        assert abs((value[rows] * share).sum() * max(1, c) - t) < 1e-9


def test_held_out_accuracy_and_folds(spark, documents, labels):
    rng = np.random.default_rng(2)
    words = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30))
    rows = [(i, words() if i % 3 else words().replace(" ", "% ")) for i in range(600)]
    marks = [(i, int(i % 3 > 0), 0) for i in range(600)]
    got = {r["doc_id"]: r for r in Q.scored(documents(rows), labels(marks)).collect()}
    for i in range(600):
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    out = [i for i in range(600) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 3 > 0) for i in out]) > 0.97
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in marks]
    again = {r["doc_id"]: r["score"] for r in Q.scored(documents(rows), labels(flipped)).collect()}
    assert all(got[i]["score"] == again[i] for i in got)  # held-out labels are never seen


def test_a_repeated_id_is_learned_from_once(spark, documents, labels, monkeypatch):
    rows = [(i, f"some words of document {i}") for i in range(40)]
    marks = labels([(i, i % 2, 0) for i in range(40)])
    seen = []
    monkeypatch.setattr(Q, "train", lambda examples, marked: seen.append((len(examples), marked)) or (np.zeros(Q.ROWS), 0.0))
    Q.fit(documents(rows), marks)
    Q.fit(documents(rows + [(1, f"again {i}") for i in range(3000)] + rows[:9]), marks)
    assert seen[0] == seen[1] and seen[0][0] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40))


def test_odd_rows(spark, documents, labels):
    got = Q.scored(documents(ODD), labels([(6, 1, 0), (6, 0, 0), (4, None, 0), (None, 1, 0)])).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    plain = Q.scored(documents(ODD), labels([])).collect()
    assert len(plain) == len(ODD) and Q.scored(documents([]), labels([])).collect() == []
