"""Repeated passages: windows of words that also stand in a document with a smaller id, found by recompression.

A word is named by its hash. A round of recompression deals the names into left and right ones and gives each left name
that is followed by a right one a common name with it. Names are hashes of what they stand for, so every task of every
round gives equal strings equal names, and no table of names travels. In two rounds a symbol spans one to four words
and depends on at most ``REACH`` words on either side: inside of equal windows the symbols are the same. Of the symbols that a
window holds together with their reach, the one with the least name stands for the window. Only windows whose symbol is
shared between documents are compared, by 128 bits of hash (the symbol's and their own).
Equal neighbours are never paired, so a run of one word stays a row of equal symbols: the name of a run is that of its
symbol with its reach, wherever a window lies in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast
from .common import Batches, slices, stored, utf8

WINDOW = 13
REACH = 3
LONGEST_SYMBOL = 4
GROUP_WORDS = 300_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_GAP = re.compile(rb"([\x20\x09-\x0D]+)")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (multiply and shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


_WEIGHTS = _odd(REACH * 2 + LONGEST_SYMBOL, 0x9E3779B97F4A7C15)
_WINDOW_WEIGHTS = _odd(WINDOW, 0xC2B2AE3D27D4EB4F)


def paired(names: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: names and sizes of the symbols after pairing left with right names."""
    side = (mix(names + np.uint64(seed)) & np.uint64(1)).astype(bool)  # right
    joins = np.zeros(len(names), bool)  # with the symbol before
    joins[1:] = ~side[:-1] & side[1:]
    starts = np.flatnonzero(~joins)
    both = np.zeros(len(starts), bool)
    both[:-1] = joins[np.minimum(starts[:-1] + 1, len(names) - 1)]
    if len(starts):
        both[-1] = starts[-1] + 1 < len(names) and joins[starts[-1] + 1]
    after = np.minimum(starts + 1, len(names) - 1)
    first = mix(names[starts] * np.uint64(0x9FB21C651E98DF25) + np.uint64(seed))
    out = np.where(both, mix(first + names[after]), first)
    return out, sizes[starts] + np.where(both, sizes[after], 0)


def window_symbols(x: np.ndarray) -> np.ndarray:
    """For each start of a window in the word hashes ``x`` the name of its symbol with its reach."""
    n = len(x) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    names, sizes = paired(x, np.ones(len(x), np.int64), 0x1F83D9AB)
    names, sizes = paired(names, sizes, 0x5BE0CD19)
    at = np.cumsum(sizes) - sizes
    inside = (at >= REACH) & (at + sizes + REACH <= len(x))
    names, at, sizes = names[inside], at[inside], sizes[inside]
    for k in range(2 * REACH + LONGEST_SYMBOL):
        reach = k < sizes + 2 * REACH
        place = np.minimum(at - REACH + k, len(x) - 1)
        names = names + np.where(reach, x[place] * _WEIGHTS[k], np.uint64(0))
    names = mix(names)
    by_size = []  # names at their starts, of symbols of at most 1, 2, 3, 4 words
    full, span = np.full(len(x), _NONE), np.zeros(len(x), np.int8)
    full[at], span[at] = names, sizes
    for size in range(1, LONGEST_SYMBOL + 1):
        by_size.append(np.where(span <= size, full, _NONE))
    room = WINDOW - 2 * REACH
    out = np.full(n, _NONE)
    for k in range(room):
        longest = min(LONGEST_SYMBOL, room - k)
        np.minimum(out, by_size[longest - 1][REACH + k : REACH + k + n], out=out)
    return out


def window_hashes(x: np.ndarray) -> np.ndarray:
    n = len(x) - WINDOW + 1
    out = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        out += mix(x[k : k + n] + _WINDOW_WEIGHTS[k])
    return mix(out)


def _groups(batches: Batches) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(id, text hash) of documents, the hashes of their words, and the number of words of each."""

    def out():
        return ids, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.array(counts, np.int64)

    ids: list = []
    words: list[bytes] = []
    counts: list[int] = []
    for batch in slices(batches):
        for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), utf8(batch.column("text")), strict=True):
            own = text.split() if text else []
            if len(own) < WINDOW or doc is None:
                continue
            ids.append((doc, key))
            words += own
            counts.append(len(own))
            if len(words) >= GROUP_WORDS:
                yield out()
                ids, words, counts = [], [], []
    if words:
        yield out()


def _runs(counts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one symbol in one document: document's number, first window in the group, size, symbol.

    Documents are parsed as one row of words. What a window takes from its symbol and its reach lies inside of it, so
    neighbours in the row don't matter; windows over an end are left out.
    """
    symbols = window_symbols(x)
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    inside = np.arange(len(symbols)) + WINDOW <= ends[doc[: len(symbols)]]
    at = np.flatnonzero(inside)
    own, of = symbols[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return of[first], at[first], np.diff(first, append=len(at)), own[first]


def _count_symbols(batches: Batches) -> Batches:
    for _, x, counts in _groups(batches):
        doc, _, _, symbol = _runs(counts, x)
        order = np.lexsort((doc, symbol))
        s, d = symbol[order], doc[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = s[1:] != s[:-1]
        other = fresh.copy()
        other[1:] |= d[1:] != d[:-1]
        first = np.flatnonzero(fresh)
        docs = np.add.reduceat(other.astype(np.int32), first) if len(first) else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(s[first].view(np.int64)), pa.array(docs, pa.int32())], ["symbol", "docs"])


def _symbol_windows(batches: Batches) -> Batches:
    names = ["symbol", "doc_id", "text_hash", "first", "windows"]
    for ids, x, counts in _groups(batches):
        doc, at, size, symbol = _runs(counts, x)
        starts = np.cumsum(counts) - counts
        own, text = (np.array(c, np.int64) for c in zip(*ids, strict=True))
        take = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        windows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(window_hashes(x)[take].view(np.int64)))
        first = pa.array((at - starts[doc]).astype(np.int32))
        for k in range(0, len(at), 20_000):
            columns = [pa.array(symbol.view(np.int64)), pa.array(own[doc]), pa.array(text[doc]), first, windows]
            yield pa.RecordBatch.from_arrays([c.slice(k, 20_000) for c in columns], names)


def with_text_hash(docs: DataFrame) -> DataFrame:
    """Adds ``text_hash``; with doc_id it tells rows apart, and equal rows fare alike."""
    return docs.withColumn("text_hash", F.xxhash64("text"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of the documents whose whole text, by 128 bits of hash, stands under a smaller doc_id."""
    whole = with_text_hash(docs.where("doc_id is not null and text is not null")).select("doc_id", "text_hash", F.unhex(F.md5("text")).alias("whole"))
    whole = stored(whole, "whole-texts")
    least = whole.groupBy("whole").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = stored(least.select("whole", "least"), "copied-texts")  # as in repeated_windows, to let a large group be split
    return whole.join(least, "whole").where("doc_id > least").select("doc_id", "text_hash").distinct()


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, starts): first words of the windows that also start in a document with a smaller doc_id.

    ``starts`` is null for an exact copy of a document with a smaller id, all of whose windows do. Such copies take no part
    in the comparison: what they hold, the other one holds too.
    """
    copies = stored(exact_copies(docs), "exact-copies")
    few = fits_broadcast(docs.sparkSession, copies.count(), 2)
    narrow = with_text_hash(docs.select("doc_id", "text")).join(F.broadcast(copies) if few else copies, ["doc_id", "text_hash"], "left_anti")
    counts = narrow.mapInArrow(_count_symbols, "symbol long, docs int").groupBy("symbol").agg(F.sum("docs").alias("docs"))
    shared = stored(counts.where("docs > 1").select("symbol"), "shared-symbols")
    small = fits_broadcast(docs.sparkSession, shared.count(), 1)
    held = narrow.mapInArrow(_symbol_windows, "symbol long, doc_id long, text_hash long, first int, windows array<long>")
    held = stored(held.join(F.broadcast(shared) if small else shared, "symbol"), "shared-windows")
    each = held.select("symbol", "doc_id", "text_hash", "first", F.posexplode("windows").alias("k", "window"))
    least = each.groupBy("symbol", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    # Stored, so that both sides of the join are dealt out anew and adaptive execution can split a common window.
    least = stored(least.where("least < most").select("symbol", "window", "least"), "common-windows")
    found = each.join(least, ["symbol", "window"]).where("doc_id > least")
    starts = found.groupBy("doc_id", "text_hash").agg(F.collect_list((F.col("first") + F.col("k")).cast("int")).alias("starts"))
    return stored(starts.unionByName(copies.withColumn("starts", F.lit(None).cast("array<int>"))), "repeated-windows")


def removed_words(n: int, starts: list[int]) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    at = np.unique(np.array(starts, np.int64))
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return np.cumsum(edge[:n]) > 0


def without_words(text: bytes, gone: np.ndarray) -> bytes:
    """The text without some of its words and the gaps behind them."""
    parts = _GAP.split(text)
    lead = b"" if parts[0] else parts[1] if len(parts) > 1 else b""
    parts = parts if parts[0] else parts[2:]
    words, gaps = parts[0::2], parts[1::2]
    gaps = [*gaps, b""][: len(words)]
    return lead + b"".join(w + g for w, g, x in zip(words, gaps, [*gone.tolist(), False], strict=False) if w and not x)


def dedup(docs: DataFrame, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """The columns of ``keep``, n_words, n_removed and kept_sha256 of every row of ``docs`` (doc_id, text).

    A word goes if a window of 13 words covers it that also starts in a document with a smaller doc_id. kept_sha256 is of
    the kept words joined by one space; ``with_text`` adds ``kept``, the text without the removed words. A null text has
    no words. A row without doc_id neither loses words nor makes others lose them; rows with the same doc_id don't act
    on each other. An empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    removed = repeated_windows(docs)
    names = [f"k{i}" for i in range(len(keep))]
    narrow = with_text_hash(docs).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], F.col("doc_id").alias("d"), "text_hash", F.col("text").alias("t"))
    size = removed.agg(F.count("*"), F.coalesce(F.sum(F.size("starts")), F.lit(0))).head()
    small = fits_broadcast(docs.sparkSession, size[0] + size[1] // 4, 2)
    removed = removed.withColumnRenamed("doc_id", "d").withColumn("found", F.lit(True))
    joined = narrow.join(F.broadcast(removed) if small else removed, ["d", "text_hash"], "left").select(*names, "t", "found", "starts")
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in joined.select(*names).schema)
    schema += "n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            rows = []
            for text, found, starts in zip(utf8(batch.column("t")), batch.column("found").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = text.split() if text else []
                kept = text
                n = len(words)
                if found and n >= WINDOW:
                    gone = np.ones(n, bool) if starts is None else removed_words(n, starts)
                    words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                    kept = without_words(text, gone) if with_text else None
                rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.string()]
            out = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            if with_text:
                out.append(pa.array(columns[3], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], *out], [x.split()[0] for x in schema.split(", ")])

    out = joined.mapInArrow(run, schema)
    rest = ["n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], *rest)
