"""Periodic runs of words, found over a grammar.

Re-Pair names recurring pairs of the words of a text until no pair recurs. A run lies whole in the smallest part of the
derivation that holds it, and crosses the boundary of that part's two halves. So it is enough to look at each rule's
boundary once, in its first occurrence, and at the boundaries that are left in the start sequence; what a rule holds is then
moved to all places where the rule stands, and of the intervals with one period the maximal ones stay. Texts of a batch are
worked on together; words are numbered for each text, so that rules never mix texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, groups, utf8, words_of

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
Plant = Callable[[str, int], tuple[int, int] | None]


class Grammar(NamedTuple):
    """Occurrences of rules (number, where it starts, length of the left half, length), and where the rest's symbols start."""

    rule: np.ndarray
    start: np.ndarray
    left: np.ndarray
    length: np.ndarray
    top: np.ndarray


class Runs(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - first, n)


def chosen_pairs(priority: np.ndarray) -> np.ndarray:
    """Positions that beat both neighbours; of equal neighbours (a word that repeats) every second one. Zeros never win."""
    if not len(priority):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, priority[1:] != priority[:-1]))
    value = priority[starts]
    ends = np.append(starts[1:], len(priority))
    best = (value > 0) & (value > np.append(0, value[:-1])) & (value > np.append(value[1:], 0))
    return _spread(np.zeros(best.sum(), np.int64), (ends - starts + 1)[best] // 2) * 2 + np.repeat(starts[best], (ends - starts + 1)[best] // 2)


def re_pair(symbols: np.ndarray, doc: np.ndarray) -> Grammar:
    """Rules for pairs of ``symbols`` that recur; the symbols of a text (``doc``, ascending) are its own.

    In each round a pair is replaced wherever it is more frequent than the pairs that it overlaps.
    """
    size = int(symbols.max()) + 1 if len(symbols) else 0
    length = np.ones(size, np.int64)
    s, at = symbols.astype(np.int64), np.arange(len(symbols))
    found: list[tuple[np.ndarray, ...]] = []
    top = []
    while len(s):
        often = np.bincount(s, minlength=size) > 1
        both = np.flatnonzero(often[s[:-1]] & often[s[1:]])
        pairs, of, n = np.unique(s[both] * size + s[both + 1], return_inverse=True, return_counts=True)
        again = n[of] > 1
        priority = np.zeros(len(s) - 1, np.int64)
        priority[both[again]] = (n[of] * len(pairs) + of)[again]
        picked = chosen_pairs(priority)
        if not len(picked):
            top.append(at)
            break
        pair, rule = np.unique(priority[picked] % len(pairs), return_inverse=True)
        left, right = np.divmod(pairs[pair], size)
        halves = length[left]
        length = np.append(length, halves + length[right])
        found.append((rule + size, at[picked], halves[rule]))
        s[picked] = rule + size
        size += len(pair)
        stays = np.ones(len(s), bool)
        stays[picked + 1] = False
        s, at, doc = s[stays], at[stays], doc[stays]
        active = np.zeros(int(doc[-1]) + 1, bool)
        active[doc[np.searchsorted(at, found[-1][1])]] = True
        active = active[doc]
        top.append(at[~active])
        s, at, doc = s[active], at[active], doc[active]
    rule, start, halves = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
    return Grammar(rule, start, halves, length[rule], np.sort(np.concatenate(top or [np.zeros(0, np.int64)])))


class Blocks:
    """Names of the recurring blocks of 2^k symbols, by their first position; -1 for a block that stands once in its text."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        self.names: list[np.ndarray] = []
        self.order: list[np.ndarray] = []  # name * n + position, ascending
        at, keys = np.arange(n), symbols.astype(np.int64)
        k = 0
        while True:
            order = np.argsort(keys, kind="stable")
            at, keys = at[order], keys[order]
            new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
            number = np.cumsum(new) - 1
            again = (np.bincount(number) > 1)[number] if len(number) else new
            at, number = at[again], number[again]
            if not len(at):
                return
            names = np.full(n, -1, np.int32)
            names[at] = number
            self.names.append(names)
            self.order.append(number * n + at)
            at = np.sort(at)
            other = at + (1 << k)
            at = at[other < n]
            at = at[names[at + (1 << k)] >= 0]
            keys = names[at].astype(np.int64) * n + names[at + (1 << k)]
            k += 1

    def _name(self, k: int, at: np.ndarray) -> np.ndarray:
        inside = (at >= 0) & (at < self.n)
        return np.where(inside, self.names[k][np.where(inside, at, 0)], -1)

    def after(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many symbols agree from u and v on."""
        total = np.zeros(len(u), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a = self._name(k, u + total)
            total += np.where((a >= 0) & (a == self._name(k, v + total)), 1 << k, 0)
        return total

    def before(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many symbols agree just before u and v."""
        total = np.zeros(len(u), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a = self._name(k, u - total - (1 << k))
            total += np.where((a >= 0) & (a == self._name(k, v - total - (1 << k))), 1 << k, 0)
        return total

    def recur(self, k: int, at: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number in ``at``, distance) of blocks of 2^k that stand again 2^k to 2^(k+1) - 1 symbols later (or earlier)."""
        name = self._name(k, at)
        numbers = np.flatnonzero(name >= 0)
        here = at[numbers]
        place = name[numbers].astype(np.int64) * self.n + here
        near, far = 1 << k, (2 << k) - 1
        if right:  # places of the next name begin at the next multiple of n
            lo, hi = place + np.minimum(near, self.n - here), place + np.minimum(far, self.n - 1 - here)
        else:
            lo, hi = place - np.minimum(far, here), place - np.minimum(near, here + 1)
        order = self.order[k]
        lo, hi = np.searchsorted(order, lo), np.searchsorted(order, hi, "right")
        n = np.maximum(hi - lo, 0)
        return np.repeat(numbers, n), np.abs(order[_spread(lo, n)] - np.repeat(place, n))


def _crossing(blocks: Blocks, boundary: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, Runs]:
    """Runs over a boundary (numbers of the boundaries, runs), within low to high.

    A run of period q has two periods on one side of the boundary at least. So the block of 2^k <= q symbols beside the boundary
    recurs at a distance of q on that side.
    """
    found = []
    for k in range(len(blocks.names)):
        width = 1 << k
        fits = np.flatnonzero(high - low >= max(LEAST_LENGTH, LEAST_EXPONENT * width))
        if not len(fits):
            break
        own, period = blocks.recur(k, boundary[fits], True)
        found.append((fits[own], boundary[fits[own]], period))
        own, period = blocks.recur(k, boundary[fits] - width, False)
        found.append((fits[own], boundary[fits[own]] - period, period))
    if not found:
        none = np.zeros(0, np.int64)
        return none, Runs(none, none, none)
    own, u, period = (np.concatenate(c) for c in zip(*found, strict=True))
    v = u + period
    start = u - np.minimum(blocks.before(u, v), u - low[own])
    end = v + np.minimum(blocks.after(u, v), high[own] - v)
    good = (start >= low[own]) & (end <= high[own]) & (end - start >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period))
    return own[good], Runs(start[good], end[good], period[good])


def _maximal(doc_of: np.ndarray, runs: Runs) -> Runs:
    """Without intervals that lie in another of the same text and period, and each interval with its least period only."""
    start, end, period = runs
    if not len(start):
        return runs
    order = np.lexsort((-end, start, period, doc_of[start]))
    start, end, period = start[order], end[order], period[order]
    doc = doc_of[start]
    new = np.append(True, (period[1:] != period[:-1]) | (doc[1:] != doc[:-1]))
    group = np.cumsum(new) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(group + end)
    keep = np.append(True, group[1:] + end[1:] > reach[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))
    return Runs(start[first], end[first], period[first])


def find_runs(symbols: np.ndarray, doc: np.ndarray) -> Runs:
    """All runs of texts written one after the other: maximal, least periods, in the order of start and end.

    ``symbols`` are small numbers that no two texts (``doc``, ascending) share.
    """
    grammar = re_pair(symbols, doc)
    blocks = Blocks(symbols)
    if not blocks.names:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none)
    edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(edges[1:], len(doc))
    top = grammar.top[~np.isin(grammar.top, edges)]
    own = np.searchsorted(edges, top, "right") - 1
    _, of_top = _crossing(blocks, top, edges[own], ends[own])
    order = np.argsort(grammar.rule, kind="stable")
    rule, start, left, length = (x[order] for x in grammar[:4])
    first = np.flatnonzero(np.append(True, rule[1:] != rule[:-1])[: len(rule)])
    n = np.diff(np.append(first, len(rule)))
    own, inside = _crossing(blocks, start[first] + left[first], start[first], start[first] + length[first])
    moved = np.repeat(np.arange(len(own)), n[own])
    shift = start[_spread(first[own], n[own])] - start[first[own]][moved]
    parts = [np.concatenate([a, b[moved] + s]) for a, b, s in zip(of_top, inside, (shift, shift, 0), strict=True)]
    return _maximal(doc, Runs(*parts))


def numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, text numbers): equal numbers for equal words of one text."""
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    codes = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
    own = codes.indices.to_numpy().astype(np.int64) + doc * max(1, len(codes.dictionary))
    return np.unique(own, return_inverse=True)[1], doc


def digest_row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs; start, length, period and thousandths of the exponent of the greatest run; digests of all runs and of the text without repeats."""
    runs = sorted((start, end - start, period) for start, end, period in runs)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    listing = "".join(f"{a},{n},{q}\n" for a, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    if runs:
        keep = np.ones(len(words), bool)
        for a, n, q in runs:
            keep[a + q : a + n] = False
        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    milli = 1000 * best[1] // best[2] if runs else None
    return len(runs), *best, milli, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def tail_repeats(doc_id: str, n: int) -> tuple[int, int] | None:
    """The repeats that the query writes into a tenth of the texts: words from a on repeat with period p."""
    h = zlib.crc32(doc_id.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def periodic_runs(docs: DataFrame, plant: Plant | None = None) -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    A run is a maximal stretch of words with smallest period q that is max(6, 4q) words long or longer. The collapsed text keeps
    the first period of each run. ``plant(doc_id, n)`` may give (a, p): word i >= a then stands for word a + (i - a) % p. Null,
    empty and blank texts have no words and no runs; a row without an id is never planted. Repeated rows give equal rows. A long text is
    worked on alone, with about 100 bytes a word. Other columns, whatever their names, don't matter. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Batches) -> Batches:
        for batch in groups(batches, "text"):
            texts = [words_of(t) for t in utf8(batch.column("text"))]
            if plant is not None:
                for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    if doc_id is not None and (found := plant(str(doc_id), len(texts[k]))):
                        a, p = found
                        own = texts[k]
                        texts[k] = own[:a] + [own[a + i % p] for i in range(len(own) - a)]
            symbols, doc = numbered(texts)
            starts = np.append(0, np.cumsum([len(w) for w in texts]))
            found = find_runs(symbols, doc)
            at = starts[doc[found.start]]
            spans = list(zip((found.start - at).tolist(), (found.end - at).tolist(), found.period.tolist(), strict=True))
            cuts = np.searchsorted(found.start, starts).tolist()
            rows = [digest_row(w, spans[a:b]) for w, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
