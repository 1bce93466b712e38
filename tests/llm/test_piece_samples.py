import gc
import weakref
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tagweave.llm import piece_samples as P
from tagweave.llm.piece_samples import Sampler, codes_of, sampled, uniform
from tagweave.llm.queries import TOKENIZERS
from tagweave.llm.words import constants
from tests.llm.conftest import ODD

PATH = f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def sampler():
    return Sampler(open(PATH, "rb").read(), k=3)


def segmentations(v, codes):
    """All piece sequences of a short text with their log weights."""
    if not len(codes):
        return [((), 0.0)]
    out = []
    for k in range(1, min(len(codes), v.longest) + 1):
        from tagweave.llm.piece_samples import _Hashes

        where, piece = v.find(_Hashes(codes)(np.array([0]), np.array([k])))
        if len(where):
            out += [((int(v.ids[piece[0]]), *rest), v.logs[piece[0]] + w) for rest, w in segmentations(v, codes[k:])]
    return out


def test_round_trip_and_distinct(sampler):
    texts = ["", "a", "▁x y", "\n\n", "日本語 ру́с \ud800", "x" * 3000, "  two  spaces ", "Hello, wörld!\nNew line\t\x00", "\U0001f600"]
    for text, found in zip(texts, sampler.sample(list(range(len(texts))), texts)):
        assert all(sampler.vocabulary.decode(s.ids) == text for s in found), text
        assert len({tuple(s.ids.tolist()) for s in found}) == len(found)
        assert [s.value for s in found] == sorted((s.value for s in found), reverse=True)


def test_decoding_agrees_with_the_library(sampler):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = ["Some plain text, with wörds and 123 numbers.", "new\nline"]
    for text, found in zip(texts, sampler.sample([1, 2], texts)):
        assert all(sp.decode(s.ids.tolist()) == text for s in found)
        assert sampler.vocabulary.decode(np.array(sp.encode(text))) == text


def test_sampling_follows_the_lattice(sampler):
    v, text, n = sampler.vocabulary, "ao th", 6000
    every = segmentations(v, codes_of(text))
    weight = {ids: np.exp(w) for ids, w in every}
    total = sum(weight.values())
    chance = {ids: w / total for ids, w in weight.items()}
    first, second, kept = Counter(), Counter(), Counter()
    for found in sampler.sample(list(range(n)), [text] * n):
        ids = [tuple(s.ids.tolist()) for s in found]
        first[ids[0]] += 1
        second[ids[1]] += 1
        for s, i in zip(found, ids):
            assert abs(np.exp(s.log) - chance[i]) < 1e-4
            kept[i] += np.exp(s.log - s.log_inclusion)
    for ids, p in chance.items():
        follows = sum(chance[o] * p / (1 - chance[o]) for o in chance if o != ids)
        assert abs(first[ids] / n - p) < 4 * np.sqrt(p * (1 - p) / n) + 2e-3
        assert abs(second[ids] / n - follows) < 4 * np.sqrt(follows * (1 - follows) / n) + 2e-3
    # inclusion scores make sums unbiased
    assert abs(sum(kept.values()) / n - 1) < 0.05


def test_samples_depend_on_key_and_text_only(sampler):
    texts = ["the quick brown fox jumps", "over it all", "the quick brown fox jumps"]
    a = list(sampler.sample([7, 8, 9], texts))
    b = list(sampler.sample([9, 7], [texts[2], texts[0]]))
    ids = lambda f: [s.ids.tolist() for s in f]
    assert ids(a[0]) == ids(b[1]) and ids(a[2]) == ids(b[0])


def test_table(spark, documents):
    got = sampled(documents([*ODD, (9, "word and word " * 3000)]), PATH).collect()
    assert all(r["round_trip"] for r in got)
    counts = Counter((r["doc_id"], r["nr"]) for r in got)
    assert counts[(1, 0)] == 1 and (1, 1) not in counts and counts[(4, 0)] == 2 and counts[(9, 1)] == 1
    assert all(r["log_inclusion"] <= 1e-9 for r in got)
    assert sampled(documents([]), PATH).collect() == []


def uniform_one(key, counter):
    """The same number without arrays."""
    mask = (1 << 64) - 1
    v = (key + counter * int(constants(2, 31)[0])) & mask
    v = ((v ^ (v >> 30)) * 0xBF58476D1CE4E5B9) & mask
    v = ((v ^ (v >> 27)) * 0x94D049BB133111EB) & mask
    return (((v ^ (v >> 31)) >> 11) + 0.5) / (1 << 53)


def test_single_numbers_are_those_of_arrays():
    keys = np.array([0, 5, (1 << 64) - 3], np.uint64)
    for counter in (0, 7, 1 << 62):
        many = uniform(keys, np.full(3, counter))
        assert many.tolist() == [uniform_one(int(k), counter) for k in keys] and ((many > 0) & (many < 1)).all()


def test_kept_words_and_slices_change_nothing(monkeypatch):
    from tagweave.llm import piece_samples

    model = open(PATH, "rb").read()
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(1, 12)))) for _ in range(60)]
    texts = ["", *(" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(50)), "日本 \U0001f600", "", "a"]
    keys = list(range(len(texts)))
    flat = lambda found: [[(s.ids.tolist(), round(s.log, 6), round(s.log_inclusion, 4)) for s in f] for f in found]
    whole = flat(Sampler(model, k=4).sample(keys, texts))
    assert any(len(f) == 4 for f in whole) and len(whole[0]) == len(whole[-2]) == 1
    for kept, chars in ((0, 300), (50, 300), (1 << 20, 300), (50, 1)):
        monkeypatch.setattr(piece_samples, "KEPT_ROWS", kept)
        monkeypatch.setattr(piece_samples, "SLICE_CHARS", chars)
        sampler = Sampler(model, k=4)
        for _ in range(2):
            assert flat(sampler.sample(keys, texts)) == whole


def test_long_text_without_a_space(sampler):
    text = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 30_000)))
    (found,) = sampler.sample([1], [text])
    assert len(found) == 3 and all(sampler.vocabulary.decode(s.ids) == text for s in found)


def test_lattices_end_with_their_task(monkeypatch):
    """Worker processes are used again, by other operators too; what one task keeps must not stay with them."""
    made = []

    class Watched(P.Lattices):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(weakref.ref(self))

    monkeypatch.setattr(P, "Lattices", Watched)
    model = SimpleNamespace(value=open(PATH, "rb").read())
    batch = pa.record_batch({"doc_id": [1, 2], "text": ["some words of a text", "words"]})
    run = P._task(model, 2, 29)
    assert sum(b.num_rows for b in run(iter([batch]))) == 4
    gc.collect()
    assert len(made) == 1 and made[0]() is None


def test_splits_share_a_task(spark):
    """Each task builds lattices of its own, so many small splits go through fewer tasks, but never too few."""
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    many = sampled(docs.repartition(9 * cores), PATH)
    assert many.rdd.getNumPartitions() == 3 * cores
    assert sampled(docs.repartition(2 * cores), PATH).rdd.getNumPartitions() == 2 * cores
    assert many.select("doc_id").distinct().count() == 400


def test_lattices_do_not_depend_on_words_beside(monkeypatch, sampler):
    """Words filled together, whatever their lengths, have the lattices they have alone."""
    texts = ["a", "words", "x" * 70, "ab" * 300, "wörter 日本 of", "some more words here"]
    flat = lambda found: [[(s.ids.tolist(), s.log) for s in one] for one in found]
    keys = list(range(len(texts)))
    whole = flat(sampler.sample(keys, texts))
    for strip in (1, 40):
        monkeypatch.setattr(P, "_STRIP", strip)
        assert flat(Sampler(open(PATH, "rb").read(), k=3).sample(keys, texts)) == whole
