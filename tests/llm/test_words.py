import re

import numpy as np
import pyarrow as pa

from tagweave.llm.words import shingles, slices, text_bytes, word_slices


def sets(texts, n, lower=True):
    out = []
    for w in word_slices(pa.array(texts, pa.string()), lower):
        for i in range(w.last - w.first):
            out.append(set(shingles(w.hashes[w.bounds[i] : w.bounds[i + 1]], n).tolist()))
    return out


def test_words_are_those_of_the_pattern():
    texts = ["one two\tone", None, "", " \r\n", "é\x0b Two TWO", "last"] * 3
    for lower in (False, True):
        hashes, words = {}, {}
        for w in word_slices(pa.array(texts), lower):
            for i in range(w.first, w.last):
                got = w.hashes[w.bounds[i - w.first] : w.bounds[i - w.first + 1]].tolist()
                want = re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
                want = [x.lower() for x in want] if lower else want
                assert len(got) == len(want)
                for g, x in zip(got, want):
                    assert hashes.setdefault(x, g) == g and words.setdefault(g, x) == x


def test_shingles_of_short_texts_and_equal_runs():
    a, b, c, d = sets(["a b c d e", "A b c D e f", "a b", ""], 4)
    assert len(a) == 2 and a < b and len(c) == 1 and not c & a and not d


def test_slices_cover_all_rows_and_cut_columns():
    column = pa.array(["x" * n for n in (5, 0, 100, 3, 3)]).slice(1)
    raw, at = text_bytes(column)
    assert at[-1] - at[0] == 106
    assert list(slices(at, 10)) == [(0, 1), (1, 2), (2, 4)]
    assert len(raw) >= 106 and np.all(np.diff(at) >= 0)
