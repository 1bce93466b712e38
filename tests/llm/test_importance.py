import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagweave.llm.importance import feature_buckets, ranked, resampled
from tests.llm.conftest import ODD


def runs(text, grams):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, grams, buckets, percent, least):
    """Plain loops over all runs; rows are (doc_id, text)."""
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t, grams)[1])
    s, t = count(r[1] for r in rows), count(target)
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc_id, text in rows:
        words, features = runs(text, grams)
        gains = []
        for f in features:
            b = zlib.crc32(f.encode()) % buckets
            gains.append(math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))))
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features), weight, score, len(words)])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in out]


TEXTS = [
    "The quick brown fox, the LAZY dog; the end." * 3, "éÉ wörd ñ 日本 x1 2y " * 9, "a b c d e f g h i j k l m n o p q r s t u v",
    "a\x00b \x7f c`d{e}@[f]:g/h", "", None,
]


@given(st.lists(st.text(st.sampled_from("aB1 é-.日\x00`{")), max_size=6), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_buckets_are_those_of_all_runs(texts, grams):
    rows, buckets, n_words = feature_buckets(pa.array(texts, pa.string()), grams, 97)
    want = Counter((i, zlib.crc32(f.encode()) % 97) for i, t in enumerate(texts) for f in runs(t, grams)[1])
    assert Counter(zip(rows.tolist(), buckets.tolist())) == want
    assert n_words.tolist() == [len(runs(t, 1)[0]) for t in texts]


@pytest.mark.parametrize("grams", [1, 2])
def test_ranks_against_plain_loops(spark, documents, grams):
    rows = [(i, TEXTS[i % 6] and TEXTS[i % 6] + f" tail {i % 11}") for i in range(150)] + ODD
    rows += [(7000, TEXTS[0])] * 30  # one id and text many times
    target = ["the quick dog", "wörd x1 tail", None]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id BIGINT, text STRING")
    got = ranked(documents(rows).repartition(5), benchmark, grams, 40, 100).collect()
    want = brute(rows, target, grams, 100, 40, 20)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    drawn = resampled(documents(rows).withColumnRenamed("n", "score"), benchmark, grams, 40, 100)
    assert drawn.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert Counter(r["doc_id"] for r in drawn.collect()) == Counter(r[0] for r in want if r[4] is not None)


def test_empty_tables(spark, documents):
    empty = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert ranked(documents([]), empty).collect() == []
    r = ranked(documents([(1, "w " * 30)]), empty, percent=100).collect()
    assert [(x["n_features"], x["rank"]) for x in r] == [(30, 1)]
