"""Exact token counts of a byte-level BPE vocabulary, with a shortcut for whole tokens.

Beforehand, every string of the vocabulary is encoded alone; those that come out as one token need no
merging wherever they stand as a pre-token, because merges never cross pre-tokens. Texts are cut into
pre-tokens by the vocabulary's pattern; whole tokens count one and only the rest is merged, its
counts kept in a bounded table. Texts with characters beyond the Latin blocks, where Unicode versions
may differ, are cut by the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagweave.llm.jobs import prepare

LIMIT = 1024
#: The pattern of byte-level pre-tokenizers, written for characters below U+0250 in Python's classes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
#: Merged pre-tokens remembered by a task.
KEPT = 300_000
#: Texts are pre-tokenized in pieces of about this many characters.
PIECE_CHARS = 1 << 20


def special_strings(source: str) -> list[str]:
    added = json.loads(source)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that match by context are not supported")
    return sorted((t["content"] for t in added), key=len, reverse=True)


def whole_tokens(source: str) -> frozenset[str]:
    """Vocabulary strings, as pre-tokens are spelled, that the tokenizer gives back as one token."""
    tok = Tokenizer.from_str(source)
    model = tok.model
    return frozenset(s for s in tok.get_vocab(with_added_tokens=False) if len(model.tokenize(s)) == 1)


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, others from U+0100 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TokenCounter(dict):
    """Token counts of pre-tokens: whole tokens and those merged lately."""

    def __init__(self, source: str, whole: frozenset[str], kept: int = KEPT):
        super().__init__()
        tok = Tokenizer.from_str(source)
        settings = json.loads(source)["pre_tokenizer"]
        if settings["type"] != "ByteLevel" or settings["add_prefix_space"] or not settings["use_regex"]:
            raise ValueError("only byte-level pre-tokenizers without prefix space are supported")
        self.model, self.cut = tok.model, tok.pre_tokenizer.pre_tokenize_str
        self.whole, self.kept = whole, kept
        self.letters = byte_letters()
        self.find = re.compile(PATTERN).findall
        special = special_strings(source)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def merged(self, spelled: str) -> int:
        return 1 if spelled in self.whole else len(self.model.tokenize(spelled))

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.kept:
            self.clear()
        n = self.merged("".join(map(self.letters.__getitem__, piece.encode())))
        if len(piece) < 64:
            self[piece] = n
        return n

    def pieces(self, text: str) -> Iterator[str]:
        """Parts that can be cut alone: they end before a single space between other characters."""
        start = 0
        while len(text) - start > PIECE_CHARS:
            found = _CUT.search(text, start + PIECE_CHARS)
            if not found:
                break
            yield text[start : found.start() + 1]
            start = found.start() + 1
        yield text[start:]

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        for piece in (p for part in parts for p in self.pieces(part)):
            if _BEYOND_LATIN.search(piece):
                total += sum(self.merged(p) for p, _ in self.cut(piece))
            else:
                total += sum(map(self.__getitem__, self.find(piece)))
        return total


#: Characters where Python's classes might differ from the tokenizer's.
_BEYOND_LATIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\u024f]")
_CUT = re.compile(r"\w \w")


@cache
def _counter(source: str, whole: frozenset[str]) -> TokenCounter:
    return TokenCounter(source, whole)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    ``path`` is a tokenizers .json file with a byte-level BPE model, read on the driver. Special
    strings inside a text count as the library's default has it: one token each. No begin or end
    tokens are added. Null and empty texts have 0 bytes and 0 tokens; other columns are ignored and
    rows that repeat are counted alike.
    """
    spark = prepare(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        source = f.read()
    shared = spark.sparkContext.broadcast((source, whole_tokens(source)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*shared.value)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        text.alias("text"),
    )
    counted = rows.mapInArrow(run, "doc_id BIGINT, n_bytes BIGINT, n_tokens BIGINT")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
