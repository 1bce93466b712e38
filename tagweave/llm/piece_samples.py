"""Sampled segmentations of texts into SentencePiece pieces, without replacement, and their decoding.

Every text has a lattice: nodes between characters, edges for the vocabulary's pieces, and byte pieces
for characters outside it. Pieces never cross the beginning of a word, so the lattice of a text is the
chain of its words' lattices. A forward pass over the distinct new words of a slice gives the probability
of each piece that ends at a node; drawing backwards from each word's end gives exact samples.

Top-k without replacement: give every segmentation its log probability plus a Gumbel variate; the k
largest are a sample without replacement. They are found by an A-star search from the top: a state is
a set of segmentations with a common beginning (of the search, word by word), its priority the largest
perturbed value in it, which is Gumbel-distributed around the log of the set's mass and, for all sets
but the best, truncated at its parent's. Following the best child is an ordinary draw, so only the k
states that are popped are ever expanded. All random numbers are hashes of the row's key.

A BPE vocabulary has ranks, not probabilities; pieces get the Zipf weight 1 / (rank + 1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.jobs import prepare
from tagweave.llm.words import constants, mix

SAMPLES = 2
SEED = 29
SLICE_CHARS = 1 << 19
#: Nodes of words whose lattices a task keeps from slice to slice, at about 200 bytes each.
KEPT_ROWS = 1 << 19
_STRIP = 1 << 15
#: Input splits of one task at most, which share its lattices.
SPLITS = 3
SPACE = "▁"
_SPACE = ord(SPACE)
_LITERAL = 0x110000  # a space sign that stands in the text itself, outside the vocabulary
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K1, _K3 = constants(2, 31)
_SLOT_BITS = 20
FAR = -100.0


def uniform(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from keys and counters."""
    bits = mix(key + counter.astype(_U) * _K1) >> _U(11)
    return (bits.astype(np.float64) + 0.5) / (1 << 53)


class _Hashes:
    """Hashes of any range of a code point array."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        power, inverse = np.full(n + 1, _BASE, _U), np.full(n + 1, _INVERSE, _U)
        power[0] = inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(mix(codes.astype(_U) + _K3) * np.multiply.accumulate(power)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _finish(self.sums[end] - self.sums[start], self.inverse[start])


def _finish(sums: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Range hash from the difference of sums, its upper bits mixed."""
    x = sums * inverse
    x ^= x >> _U(29)
    x *= _K1
    return x


class Vocabulary:
    """Pieces of a SentencePiece model by hash, with log weights and bytes for decoding."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [(sp.id_to_piece(i), i) for i in range(sp.get_piece_size())]
        usable = [(p, i) for p, i in pieces if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        order = sorted(usable, key=lambda x: (-sp.get_score(x[1]), x[1]))
        total = np.log(sum(1 / (r + 2) for r in range(len(order))))
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.longest = max(len(p) for p, _ in order)
        if any(SPACE in p.lstrip(SPACE) for p, _ in order):
            raise ValueError("pieces across the beginning of a word are not supported")
        codes = np.frombuffer("".join(p for p, _ in order).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) for p, _ in order])
        starts = ends - [len(p) for p, _ in order]
        hashes = _Hashes(codes)(starts, ends)
        at = np.argsort(hashes)
        self.hashes = hashes[at]
        self.ids = np.array([i for _, i in order], np.int32)[at]
        self.logs = np.array([-np.log(r + 2) - total for r in range(len(order))])[at]
        self.byte_log = -2 * np.log(len(order))
        # the first piece of each range of hashes, and the most pieces that one range has
        spots = (self.hashes >> _U(64 - _SLOT_BITS)).astype(np.int64)
        self.slot = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.slot[spots[::-1]] = np.arange(len(spots), dtype=np.int32)[::-1]
        self.taken = self.slot >= 0
        self.run = int(np.bincount(spots).max())
        single = [ord(p) for p, _ in order if len(p) == 1]
        self.known = np.zeros(0x110001, bool)
        self.known[single] = True
        self.bytes = [p.replace(SPACE, " ").encode() for p, _ in pieces]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are pieces, and the pieces' numbers in hash order."""
        ranges = (hashes >> _U(64 - _SLOT_BITS)).view(np.int64)
        maybe = np.flatnonzero(self.taken[ranges])
        spot, wanted = self.slot[ranges[maybe]], hashes[maybe]
        place, piece = [], []
        for _ in range(self.run):
            hit = self.hashes[spot] == wanted
            place.append(maybe[hit])
            piece.append(spot[hit])
            more = ~hit & (spot + 1 < len(self.hashes))
            maybe, spot, wanted = maybe[more], spot[more] + 1, wanted[more]
        return np.concatenate(place), np.concatenate(piece)

    def decode(self, ids: np.ndarray) -> str:
        """The text of pieces; the space put before the first word is taken away."""
        return self.spelled(ids).decode("utf-8", "surrogatepass")

    def spelled(self, ids: np.ndarray) -> bytes:
        """The same in UTF-8."""
        pieces = ids.tolist()
        found = itemgetter(*pieces)(self.bytes) if len(pieces) > 1 else [self.bytes[i] for i in pieces]
        return b"".join(found)[1:]


def codes_of(text: str) -> np.ndarray:
    """Code points with spaces as the space sign and one before the first; nothing for an empty text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(raw):
        return raw
    out = np.empty(len(raw) + 1, np.int64)
    out[0] = _SPACE
    out[1:] = np.where(raw == _SPACE, _LITERAL, np.where(raw == 32, _SPACE, raw))
    return out


def _utf8_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F).astype(np.int64) + ((codes > 0x7FF) & (codes != _LITERAL)) + (codes == _LITERAL) + (
        (codes > 0xFFFF) & (codes != _LITERAL)
    )


@lru_cache(maxsize=1)
def _vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary for all tasks of a worker process."""
    return Vocabulary(model)


class Lattices:
    """Backward transition probabilities of all nodes of distinct words, kept for the slices to come.

    Node e of a word is row ``base + e``. Column L - 1 is the piece of L characters that ends there.
    Words are kept until KEPT_ROWS nodes are; words beyond live for one slice.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.width = -(-vocabulary.longest // 8) * 8  # draws count in eights
        self.kept = 0
        self.hashes, self.bases = np.zeros(0, _U), np.zeros(0, np.int64)
        self.log = np.zeros((0, self.width), np.float32)
        self.cumulative, self.ids = self.log.copy(), np.zeros((0, self.width), np.int32)

    def words(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Base of each word, for use until the next call."""
        ranges = _Hashes(codes)
        hashes = ranges(start, end)
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            spot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[spot] == hashes, self.bases[spot], out)
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        new, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
        begin = start[missing][first]
        size = end[missing][first] - begin
        order = np.argsort(-size, kind="stable")
        ends = self.kept + np.cumsum(size + 1)
        base = ends - size - 1
        self._room(int(ends[-1]))
        self._build(ranges, codes, begin[order], size[order], base[order])
        out[missing] = base[which]
        n = int(np.searchsorted(ends, KEPT_ROWS, side="right"))
        if n:
            self.kept = int(ends[n - 1])
            hashes, bases = np.append(self.hashes, new[:n]), np.append(self.bases, base[:n])
            order = np.argsort(hashes)
            self.hashes, self.bases = hashes[order], bases[order]
        return out

    def _room(self, rows: int) -> None:
        """Rows up to ``rows`` exist, and those after the kept ones are blank."""
        if rows > len(self.log) or len(self.log) > 2 * max(rows, KEPT_ROWS):
            size = max(rows, min(2 * len(self.log), KEPT_ROWS))
            for name in ("log", "cumulative", "ids"):
                old = getattr(self, name)
                new = np.empty((size, self.width), old.dtype)
                new[: self.kept] = old[: self.kept]
                setattr(self, name, new)
        self.log[self.kept : rows] = -np.inf
        self.cumulative[self.kept : rows] = 2.0
        self.ids[self.kept : rows] = -1

    def _build(self, hashes: _Hashes, codes: np.ndarray, start: np.ndarray, size: np.ndarray, base: np.ndarray) -> None:
        """Fill the rows of some words, the longest first, about _STRIP rows at a time."""
        ends, low = np.cumsum(size), 0
        while low < len(size):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] - size[low] + _STRIP, side="right")))
            self._fill(hashes, codes, start[low:high], size[low:high], base[low:high])
            low = high

    def _fill(self, hashes: _Hashes, codes: np.ndarray, start: np.ndarray, size: np.ndarray, base: np.ndarray) -> None:
        """Nodes e of all words are one level, its pieces in rows by length; words long enough for it come first."""
        word = np.repeat(np.arange(len(size)), size)
        place = 1 + np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        row, stop = base[word] + place, start[word] + place
        active = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="right")  # words with size >= e
        cells = active * np.minimum(np.arange(len(active)), self.width)
        first = np.cumsum(cells) - cells
        log = np.full(int(cells.sum()), -np.inf, np.float32)
        spot, step = first[place] + word, active[place]
        unknown = np.flatnonzero(~self.vocabulary.known[codes[stop - 1]])
        log[spot[unknown]] = self.vocabulary.byte_log * _utf8_length(codes[stop[unknown] - 1])
        for k in range(1, min(self.width, int(size[0])) + 1):
            if k > 1:
                long = np.flatnonzero(place >= k)
                row, stop, place, spot, step = (x[long] for x in (row, stop, place, spot, step))
            where, piece = self.vocabulary.find(hashes(stop - k, stop))
            self.ids[row[where], k - 1] = self.vocabulary.ids[piece]
            log[spot[where] + (k - 1) * step[where]] = self.vocabulary.logs[piece]
        # log masses of the nodes before a level, the last one first
        mass, at = np.zeros((2 * self.width, len(size))), 2 * self.width - 1
        for e in range(1, len(active)):
            n, columns = int(active[e]), min(self.width, e)
            weights = log[first[e] : first[e] + cells[e]].reshape(columns, n) + mass[at : at + columns, :n]
            top = weights.max(axis=0)
            weights -= top
            share = np.exp(weights.astype(np.float32))
            total = share.sum(axis=0, dtype=np.float64)
            norm = np.log(total)
            if not at:
                mass[self.width :] = mass[: self.width]
                at = self.width
            at -= 1
            mass[at, :n] = top + norm
            weights -= norm
            rows = base[:n] + e
            self.log[rows, :columns] = weights.T
            sums = np.cumsum(share, axis=0, dtype=np.float32)
            # rounding must not let a draw pass the last piece that is possible
            self.cumulative[rows, :columns] = np.where(sums >= sums[-1], 2.0, sums / total).T

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Size of the piece drawn at each node: one more than the sums that ``u`` has reached."""
        reached = (self.cumulative.take(node, axis=0) <= u[:, None]).view(_U)
        eights = reached[:, 0].copy()
        for column in range(1, reached.shape[1]):
            eights += reached[:, column]
        return 1 + ((eights * _U(0x0101010101010101)) >> _U(56)).view(np.int64)


@dataclass
class Draws:
    """One segmentation of every word of a slice: words forward, pieces of a word backward."""

    word: np.ndarray  # number of the word in the slice
    node: np.ndarray  # row of the lattice at the piece's end
    size: np.ndarray  # characters of the piece
    start: np.ndarray  # first character
    log: np.ndarray
    first: np.ndarray  # first step of each word
    ids: np.ndarray | None = None  # piece ids in text order, bytes one by one
    spot: np.ndarray | None = None  # where each word's ids begin


@dataclass
class Paths:
    """One segmentation of each text of a slice, or none, in the order of the search."""

    steps: list  # word, node, size, start and log of every piece
    first: np.ndarray  # first step of each text, and the end
    rest: np.ndarray  # perturbed value of what leaves the path at each step
    value: np.ndarray
    parts: list  # for each text its ids in text order: (first word, last word, draw) or (word, word + 1, ids)
    turned: np.ndarray  # the step where the text's path left another
    taken: np.ndarray  # by text, the sizes taken at that step before

    def tops(self) -> tuple[np.ndarray, np.ndarray]:
        """The largest rest of each text and its first step; -inf for a text without a path."""
        some = np.flatnonzero(np.diff(self.first))
        most, at = np.full(len(self.value), -np.inf), np.zeros(len(self.value), np.int64)
        if len(some):
            most[some] = np.maximum.reduceat(self.rest, self.first[some])
            of = np.repeat(np.arange(len(self.value)), np.diff(self.first))
            hit = np.flatnonzero(self.rest == most[of])[::-1]
            at[of[hit]] = hit
        return most, at


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of some ranges, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


@dataclass
class Sample:
    ids: np.ndarray
    log: float
    value: float
    log_inclusion: float


class Sampler:
    def __init__(self, model: bytes, k: int = SAMPLES, seed: int = SEED):
        self.vocabulary, self.k, self.seed = _vocabulary(model), k, _U(seed)
        self.lattices = Lattices(self.vocabulary)

    def words(self, codes: np.ndarray) -> np.ndarray:
        """Beginnings of words: a run of spaces starts one, characters outside the vocabulary are one."""
        space, unknown = codes == _SPACE, ~self.vocabulary.known[codes]
        begins = np.ones(len(codes), bool)
        begins[1:] = (space[1:] & ~space[:-1]) | unknown[1:] | unknown[:-1]
        return np.flatnonzero(begins)

    def sample(self, keys: list[int], texts: list[str]) -> Iterator[list[Sample]]:
        """Samples of each text, the best perturbed value first."""
        at = 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= SLICE_CHARS):
                chars += len(texts[stop])
                stop += 1
            yield from self._slice(keys[at:stop], texts[at:stop])
            at = stop

    def _slice(self, keys: list[int], texts: list[str]) -> Iterator[list[Sample]]:
        parts = [codes_of(t) for t in texts]
        bounds = np.cumsum([0] + [len(p) for p in parts])
        codes = np.concatenate(parts)
        if not len(codes):
            yield from ([Sample(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] for _ in texts)
            return
        begins = self.words(codes)
        begins = np.union1d(begins, bounds[:-1][np.diff(bounds) > 0])
        ends = np.append(begins[1:], len(codes))
        lattice = self.lattices
        base = lattice.words(codes, begins, ends)
        word_at = np.searchsorted(begins, bounds)
        key = mix(np.array(keys, np.int64).view(_U) ^ mix(np.array([self.seed])))
        owner = np.repeat(np.arange(len(texts)), np.diff(word_at))
        number = np.arange(len(begins)) - word_at[owner]
        word_key = mix(key[owner] + number.astype(_U) * _K3)
        draws = [self._draw(lattice, codes, base, begins, ends, word_key, d) for d in range(self.k)]
        some = np.flatnonzero(np.diff(word_at))  # texts with words
        found = dict(zip(some.tolist(), self._search(codes, base, begins, key[some], draws, word_at[some], word_at[some + 1])))
        for i in range(len(texts)):
            yield found.get(i) or [Sample(np.zeros(0, np.int32), 0.0, 0.0, 0.0)]

    def _draw(self, lattice: Lattices, codes, base, begins, ends, key, d: int) -> Draws:
        left = ends - begins
        active = np.arange(len(base))
        out, counts = [], np.zeros(len(base), np.int64)
        while len(active):
            step = len(out)
            node = base[active] + left[active]
            bits = mix(key[active] + np.array([step * 64 + d], _U) * _K1) >> _U(40)
            size = lattice.draw(node, bits.astype(np.float32) * np.float32(2.0**-24))
            out.append((active, node, size))
            left[active] -= size
            counts[active] = step + 1
            active = active[left[active] > 0]
        first = np.concatenate([[0], np.cumsum(counts)])
        word = np.repeat(np.arange(len(base)), counts)
        node, size = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
        for step, (active, nodes, sizes) in enumerate(out):
            at = first[active] + step
            node[at], size[at] = nodes, sizes
        draws = Draws(word, node, size, (begins - base)[word] + node - size, lattice.log[node, size - 1], first)
        first = draws.first
        back = np.repeat(first[:-1] + first[1:] - 1, np.diff(first)) - np.arange(len(word))
        draws.ids, counts = self._ids(lattice, codes, draws.node[back], draws.size[back], draws.start[back])
        draws.spot = np.concatenate([[0], np.cumsum(counts)])[first]
        return draws

    def _search(self, codes, base, begins, key, draws, lo, hi) -> list[list[Sample]]:
        """The search in all texts at once; words ``lo`` to ``hi`` are those of a text."""
        n, one = len(lo), draws[0]
        steps = [one.word, one.node, one.size, one.start, one.log]
        first = np.append(one.first[lo], one.first[hi[-1]])
        value = -np.log(-np.log(uniform(key, np.full(n, 1 << 60))))
        parts = [[(a, b, 0)] for a, b in zip(lo.tolist(), hi.tolist())]
        of = np.repeat(np.arange(n), np.diff(first))
        rest = _rests(one.log, first[of], value[of], key[of], 0)
        paths = [Paths(steps, first, rest, value, parts, np.full(n, -1), np.zeros((n, self.lattices.width), bool))]
        while True:
            tops = [p.tops() for p in paths]
            values = np.stack([most for most, _ in tops])
            source = values.argmax(axis=0)  # of equal values the earliest path
            value = values.max(axis=0)
            if len(paths) == self.k or not np.isfinite(value).any():
                break
            at = np.stack([at for _, at in tops])[source, np.arange(n)]
            paths.append(self._leave(codes, base, begins, key, paths, source, at, value, hi, draws[len(paths)]))
        sums = []
        for p in paths:
            total = np.concatenate([[0.0], np.cumsum(p.steps[4], dtype=np.float64)])[p.first]
            sums.append(np.diff(total))
        logs = np.stack(sums)
        with np.errstate(over="ignore"):
            gap = logs - value
            inclusion = np.where(gap > -30, np.log(-np.expm1(-np.exp(np.clip(gap, -31, 700)))), gap)
        inclusion[:, value == -np.inf] = 0.0
        out = []
        for i in range(n):
            mine = [(turn, p) for turn, p in enumerate(paths) if p.parts[i]]
            samples = []
            for turn, p in mine:
                ids = [draws[x].ids[draws[x].spot[a] : draws[x].spot[b]] if isinstance(x, int) else x for a, b, x in p.parts[i]]
                samples.append(Sample(np.concatenate(ids), float(logs[turn, i]), float(p.value[i]), float(inclusion[turn, i])))
            out.append(samples)
        return out

    def _leave(self, codes, base, begins, key, paths: list[Paths], source, at, value, hi, draw: Draws) -> Paths:
        """For each text the best path among those that leave path ``source`` at its step ``at``."""
        lattice, turn, n = self.lattices, len(paths), len(value)
        live = np.flatnonzero(np.isfinite(value))
        source, at, seed = source[live], at[live], key[live]
        offset = np.cumsum([0] + [len(p.rest) for p in paths])
        bank = [np.concatenate([p.steps[j] for p in paths]) for j in range(5)]
        begin = np.stack([p.first[:-1] for p in paths])[source, live]  # of the text in its parent
        there = offset[source] + at
        step = at - begin
        word, node, size = (bank[j][there] for j in range(3))
        taken = np.stack([p.taken[live] for p in paths])[source, np.arange(len(live))]
        taken &= (np.stack([p.turned[live] for p in paths])[source, np.arange(len(live))] == step)[:, None]
        taken[np.arange(len(live)), size - 1] = True
        chance = np.where(taken, 0.0, np.exp(lattice.log[node].astype(np.float64)))
        sums = np.cumsum(chance, axis=1)
        counter = lambda c: np.full(len(live), c, _U)
        u = uniform(seed, counter((1 << 61) + turn))
        end = bank[3][there] + size
        size = 1 + np.count_nonzero(sums <= (u * sums[:, -1])[:, None], axis=1)
        left = sums[:, -1] - chance[np.arange(len(live)), size - 1]
        own, active, start = [(np.arange(len(live)), node, size, end - size)], np.arange(len(live)), end - size
        counts = np.ones(len(live), np.int64)
        while True:  # the rest of the word is an ordinary draw
            active = active[start[active] > begins[word[active]]]
            if not len(active):
                break
            node = base[word[active]] + start[active] - begins[word[active]]
            u = uniform(seed[active], counter((1 << 62) + turn * (1 << 32) + len(own))[: len(active)])
            size = lattice.draw(node, u.astype(np.float32))
            start[active] -= size
            counts[active] += 1
            own.append((active, node, size, start[active]))
        after = draw.first[word + 1]
        size_after = draw.first[hi[live]] - after
        sizes = step + counts + size_after
        ends = np.cumsum(sizes)
        head, tail = _ranges(ends - sizes, step), _ranges(ends - size_after, size_after)
        parent, following = _ranges(there - step, step), _ranges(after, size_after)
        steps = []
        for old, more in zip(bank, (draw.word, draw.node, draw.size, draw.start, draw.log)):
            new = np.empty(int(ends[-1]), old.dtype)
            new[head], new[tail] = old[parent], more[following]
            steps.append(new)
        for turned, (which, *own_steps) in enumerate(own):
            spot = (ends - sizes + step)[which] + turned
            steps[0][spot] = word[which]
            for j, x in enumerate(own_steps, 1):
                steps[j][spot] = x
            steps[4][spot] = lattice.log[own_steps[0], own_steps[1] - 1]
        of = np.repeat(np.arange(len(live)), sizes)
        rest = _rests(steps[4], (ends - sizes)[of], value[live][of], seed[of], turn)
        rest[_ranges(ends - sizes, step + 1)] = -np.inf
        total = np.concatenate([[0.0], np.cumsum(steps[4], dtype=np.float64)])
        more = np.flatnonzero(left > 1e-12)
        spot = (ends - sizes + step)[more]
        mass = total[spot] - total[(ends - sizes)[more]] + np.log(left[more])
        noise = np.log(-np.log(uniform(seed[more], counter((1 << 59) + turn)[: len(more)])))
        rest[spot] = -np.logaddexp(-value[live][more], noise - mass)
        for i, p in enumerate(paths):
            p.rest[at[source == i]] = -np.inf
        # ids of the words that changed, from their first piece
        pieces = np.bincount(of[steps[0] == word[of]], minlength=len(live))
        back = np.repeat(ends - size_after - 1, pieces) - _ranges(np.zeros(len(live), np.int64), pieces)
        ids, lengths = self._ids(lattice, codes, steps[1][back], steps[2][back], steps[3][back])
        cuts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(pieces)])].tolist()
        parts: list = [[] for _ in range(n)]
        for j, (i, p, w) in enumerate(zip(live.tolist(), source.tolist(), word.tolist())):
            before = [(a, min(b, w), x) for a, b, x in paths[p].parts[i] if a < w]
            parts[i] = [*before, (w, w + 1, ids[cuts[j] : cuts[j + 1]]), (w + 1, int(hi[i]), turn)]
        first = np.zeros(n + 1, np.int64)
        first[live + 1] = sizes
        turned, took = np.full(n, -1), np.zeros((n, lattice.width), bool)
        turned[live], took[live] = step, taken
        return Paths(steps, np.cumsum(first), rest, value, parts, turned, took)

    def _ids(self, lattice, codes, node, size, start) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, characters outside the vocabulary byte by byte, and how many each piece has."""
        ids = lattice.ids[node, size - 1]
        counts = np.ones(len(ids), np.int64)
        outside = np.flatnonzero(ids < 0)
        if not len(outside):
            return ids, counts
        chars, which = np.unique(codes[start[outside]], return_inverse=True)
        spelled = [SPACE.encode() if c == _LITERAL else chr(c).encode("utf-8", "surrogatepass") for c in chars.tolist()]
        counts[outside] = np.array([len(s) for s in spelled])[which]
        out = np.repeat(ids, counts)
        flat = b"".join([spelled[w] for w in which.tolist()])
        out[np.repeat(ids < 0, counts)] = self.vocabulary.byte_ids[np.frombuffer(flat, np.uint8)]
        return out, counts


def _rests(log: np.ndarray, first: np.ndarray, value: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
    """Perturbed value of all that leaves a path at each step; ``first`` is where its text's path begins.

    Variates lie between -3.7 and 37.5, so steps whose mass is 42 below another's, or below the path's
    value, cannot come first; past a log mass of FAR they are computed only for texts that need them.
    """
    sums = np.concatenate([[0.0], np.cumsum(log, dtype=np.float64)])
    before = sums[:-1] - sums[first]
    out, most = np.full(len(log), -np.inf), np.full(len(log) + 1, -np.inf)

    def fill(at: np.ndarray) -> np.ndarray:
        here = lambda x: x[at] if len(x) > 1 else x
        with np.errstate(divide="ignore"):
            mass = before[at] + np.log(-np.expm1(np.minimum(log[at].astype(np.float64), 0.0)))
            noise = np.log(-np.log(uniform(here(key), at - first[at] + (turn + 1) * (1 << 32))))
            out[at] = -np.logaddexp(-here(value), noise - mass)
        return mass

    near = np.flatnonzero(before > FAR)
    np.maximum.at(most, first[near], fill(near))
    poor = np.flatnonzero((before <= FAR) & (most[first] < FAR + 46))
    if len(poor):
        fill(poor)
    return out


SCHEMA = (
    "doc_id BIGINT, nr INT, ids ARRAY<INT>, log_prob DOUBLE, value DOUBLE, log_inclusion DOUBLE, round_trip BOOLEAN"
)


def _task(model: Broadcast, k: int, seed: int):
    """Samples of a task's texts. Its lattices end with it: worker processes go on to other work, at memory of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model.value, k, seed)
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(0).fill_null(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows, chars = [], 0
            for i, found in enumerate(sampler.sample(keys, texts)):
                text = texts[i].encode("utf-8", "surrogatepass")
                rows += [(ids[i], nr, s, sampler.vocabulary.spelled(s.ids) == text) for nr, s in enumerate(found)]
                chars += len(texts[i])
                if chars > 4 * SLICE_CHARS:
                    yield _sample_rows(rows)
                    rows, chars = [], 0
            if rows:
                yield _sample_rows(rows)

    return run


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows in tasks of up to SPLITS splits, without a shuffle; two tasks a core stay."""
    splits, cores = rows.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(2 * cores, -(-splits // SPLITS)))


def sampled(docs: DataFrame, path: str, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Up to ``k`` distinct segmentations of every whole text, one row each.

    doc_id; nr from 0, by falling perturbed value; piece ids; log probability; perturbed value;
    log of the chance that the segmentation exceeds the threshold (the next value), its inclusion
    score; whether decoding the ids gives the text back. Samples depend on doc_id (null: 0), text and
    seed alone. An empty or null text has one segmentation without pieces, a text with fewer than k
    segmentations gives them all, with inclusion log 0. Other columns are ignored; rows that repeat
    give equal rows. ``path`` is a SentencePiece model with byte pieces, read on the driver.
    """
    spark = prepare(docs.sparkSession)
    with open(path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _gathered(rows).mapInArrow(_task(model, k, seed), SCHEMA)


def _sample_rows(rows: list[tuple]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(r[2].ids) for r in rows]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[2].ids for r in rows]).astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), ids,
         *(pa.array([getattr(r[2], n) for r in rows], pa.float64()) for n in ("log", "value", "log_inclusion")),
         pa.array([r[3] for r in rows], pa.bool_())],
        ["doc_id", "nr", "ids", "log_prob", "value", "log_inclusion", "round_trip"],
    )
