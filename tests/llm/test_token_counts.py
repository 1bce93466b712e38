import pytest
from tokenizers import Tokenizer

from tagweave.llm import token_counts as T
from tagweave.llm.queries import TOKENIZERS
from tests.llm.conftest import ODD

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
TEXTS = [
    "", "Hello world", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "x²³ ½ 12_3 __ I'll don't", "tab\t\tnew\n\n line  ",
    "\x1c\x1d a\x85b\xa0c", "日本語 text ру́сский", "\U0001f600 emoji", "naïve Ångström", "w" * 3000, "1234567 " * 50, "\ufeffx",
]


@pytest.fixture(scope="module")
def counter():
    source = open(PATH, encoding="utf-8").read()
    return T.TokenCounter(source, T.whole_tokens(source))


def test_same_as_the_library(counter):
    lib = Tokenizer.from_file(PATH)
    for text in TEXTS:
        assert counter.count(text) == len(lib.encode(text, add_special_tokens=False).ids), text


def test_long_texts_are_cut_where_it_does_not_matter(counter, monkeypatch):
    text = "Some words, and 12 numbers: don't cut  here or\nthere. Wörter auch " * 20
    whole = counter.count(text)
    monkeypatch.setattr(T, "PIECE_CHARS", 10)
    assert len(list(counter.pieces(text))) > 50 and counter.count(text) == whole
    counter.kept = 5
    assert counter.count(text) == whole


def test_table(spark, documents):
    lib = Tokenizer.from_file(PATH)
    rows = [*ODD, (9, "word " * 2000)]
    got = sorted(T.token_counts(documents(rows), PATH).collect(), key=str)
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert sorted([tuple(r[:3]) for r in got], key=str) == sorted(want, key=str)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert T.token_counts(documents([]), PATH).collect() == []
