"""Byte-pair encoding of many words at once over an index of pair positions, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, slices

KEPT_WORDS = 700_000
LONGEST_KEPT = 48
_NEVER = np.int64(1 << 40)


class PairIndex:
    """Applies merges to all words of a table at once.

    The symbols of all words stand in one array, linked to the next and the one before. For each rank the index has the
    positions where its pair begins. Active ranks are taken in ascending order from a heap; a merge rewrites all positions
    of its pair and puts the pairs that come up with their neighbours into the lists of their ranks.
    """

    def __init__(self, merges: list[tuple[int, int, int]], size: int):
        """``merges``: (left id, right id, merged id) in order of rank, all ids below ``size``."""
        left, right, merged = (np.array(c, np.int64) for c in zip(*merges, strict=True)) if merges else [np.zeros(0, np.int64)] * 3
        born = np.full(size, -1, np.int64)
        born[merged[::-1]] = np.arange(len(merged))[::-1]
        if (born[left] >= np.arange(len(left))).any() or (born[right] >= np.arange(len(right))).any():
            raise ValueError("a merge uses a token that a later one makes")
        self.size, self.left, self.right, self.merged = size, left, right, merged
        keys = left * size + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; a large number if it has none."""
        if not len(self.keys):
            return np.full(len(a), _NEVER)
        wanted = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], _NEVER)

    def encode(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that stand one behind the other, and how many each has."""
        n = len(symbols)
        ids = symbols.astype(np.int64)
        word = np.repeat(np.arange(len(sizes)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes[sizes > 0]) - 1
        after[ends] = -1
        before[np.append(0, ends[:-1] + 1)[: len(ends)]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[after[at] >= 0]
            rank = self.ranks(ids[at], ids[after[at]])
            some = rank < _NEVER
            at, rank = at[some], rank[some]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, own in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(heap, r)

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists) if len(lists) > 1 else lists[0])
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (ids[at] == a) & (after[at] >= 0)]
            at = at[ids[after[at]] == b]
            if a == b and len(at) > 1:
                at = self._not_overlapping(at, after)
            if not len(at):
                continue
            gone = after[at]
            ids[at] = self.merged[r]
            alive[gone] = False
            next_ = after[gone]
            after[at] = next_
            linked = next_ >= 0
            before[next_[linked]] = at[linked]
            prev = before[at]
            add(np.concatenate([at, prev[prev >= 0]]))
        return ids[alive], np.bincount(word[alive], minlength=len(sizes))

    @staticmethod
    def _not_overlapping(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of positions whose pairs may share a symbol, every other one of a row, from its left end."""
        chained = np.zeros(len(at), bool)
        chained[1:] = after[at[:-1]] == at[1:]
        start = np.flatnonzero(~chained)
        place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        return at[place % 2 == 0]


class WordBpe:
    """Encodes and decodes by a vocabulary file with word ends (lower case, words cut by a pattern)."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        self.normalize, self.cut = tool.normalizer.normalize_str, tool.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        size = max(self.vocab.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.index = PairIndex([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs], size)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t.encode() for t, i in self.vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.digits = {i: b"%d" % i for i in self.token}
        self.inner, self.last = self.char_ids(""), self.char_ids(self.suffix)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: Pieces of a part in plain ASCII, after it is in lower case.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
        self.kept = kept
        self.ids_of: dict[str, bytes] = {}
        self.tokens_of: dict[str, bytes] = {}

    def char_ids(self, suffix: str) -> np.ndarray:
        """At each code point the id of the character with ``suffix``; -1 without one and at the end, for all later ones."""
        found = {ord(t[0]): i for t, i in self.vocab.items() if len(t) == 1 + len(suffix) and t.endswith(suffix)}
        out = np.full(max(found, default=0) + 2, -1, np.int64)
        out[list(found)] = list(found.values())
        return out

    def pieces_of(self, parts: list[str]) -> list[list[str]]:
        """Pieces of each part, in the characters that stand for bytes. A line end only parts them."""
        out = [self.pieces.findall(x.lower()) if x.isascii() and x.replace("\n", " ").isprintable() else None for x in parts]
        others = [n for n, own in enumerate(out) if own is None]
        for k in range(0, len(others), 1000):
            at = others[k : k + 1000]
            texts = [parts[n] for n in at]
            if any("\0" in x for x in texts):
                found = [[p for p, _ in self.cut(self.normalize(x))] for x in texts]
            else:
                found = self.cut_all(texts)
            for n, own in zip(at, found, strict=True):
                out[n] = own
        return out

    def cut_all(self, parts: list[str]) -> list[list[str]]:
        """Pieces of parts without zero characters, which stand between the parts while they are normalized; no piece holds a line end."""
        text = self.normalize("\0".join(parts))
        sizes = [len(x) + 1 for x in text.split("\0")]
        found = self.cut(text.replace("\0", "\n"))
        starts = np.fromiter((a for _, (a, _) in found), np.int64, len(found))
        cuts = np.searchsorted(starts, np.cumsum(sizes)).tolist()
        pieces = [p for p, _ in found]
        return [pieces[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def learn(self, parts: list[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """For each part its ids as decimal text, and its tokens, each joined by spaces."""
        words = [x for x in parts if x.isascii() and x.isalpha()]
        rest = [x for x in parts if not (x.isascii() and x.isalpha())]
        special = [x for x in rest if "<" in x and self.split_added.search(x)] if self.split_added is not None else []
        if special:
            rest = list(set(rest).difference(special))
        rows: list[list[str | int]] = self.pieces_of(rest)
        for x in special:
            row: list[str | int] = []
            for y in self.split_added.split(x):
                row += [self.added[y]] if y in self.added else self.pieces_of([y])[0] if y else []
            rows.append(row)
        lower = [x.lower() for x in words]
        pieces = list({*lower, *(p for row in rows for p in row if p.__class__ is str)})
        out = []
        for own, single, kept in zip(self.encode_pieces(pieces), (self.digits, self.token), (self.ids_of, self.tokens_of), strict=True):
            table = {**single, **dict(zip(pieces, own, strict=True))}
            found = dict(zip(words, map(table.__getitem__, lower), strict=True))
            found.update(zip([*rest, *special], [b" ".join([y for p in row if (y := table[p])]) for row in rows], strict=True))
            if len(kept) < self.kept:
                kept.update([(k, v) for k, v in found.items() if len(k) <= LONGEST_KEPT])
            out.append(found)
        return out[0], out[1]

    def encode_pieces(self, pieces: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids and tokens of each piece; a character without a token is left out, as the vocabulary has no token for it."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        chars = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(sizes[sizes > 0]) - 1
        flat = self.inner[np.minimum(chars, len(self.inner) - 1)]
        flat[ends] = self.last[np.minimum(chars[ends], len(self.last) - 1)]
        if (flat < 0).any():
            word = np.repeat(np.arange(len(sizes)), sizes)
            sizes = np.bincount(word[flat >= 0], minlength=len(sizes))
            flat = flat[flat >= 0]
        ids, sizes = self.index.encode(flat, sizes)
        stops = np.cumsum(sizes)
        spans = list(zip((stops - sizes).tolist(), stops.tolist(), strict=True))
        found = ids.tolist()
        texts = (list(map(table.__getitem__, found)) for table in (self.digits, self.token))
        joined = [[own[a] if b - a == 1 else b" ".join(own[a:b]) for a, b in spans] for own in texts]
        return joined[0], joined[1]

    def texts(self, texts: list[str], group_chars: int = 8_000_000) -> list[tuple[int, bytes, bytes]]:
        """Number of tokens, ids as decimal text, and decoded text of each text."""
        out = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and size < group_chars:
                size += len(texts[end])
                end += 1
            out += self._group(texts[at:end])
            at = end
        return out

    def _group(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        split = [x.split(" ") for x in texts]
        parts = set(chain.from_iterable(split))
        known = parts.intersection(self.ids_of)
        tables = [{p: kept[p] for p in known} for kept in (self.ids_of, self.tokens_of)]
        for table, new in zip(tables, self.learn(list(parts.difference(known))), strict=True):
            table.update(new)
        ids_of, tokens_of = (table.__getitem__ for table in tables)
        out = []
        for own in split:
            ids = b" ".join(filter(None, map(ids_of, own)))
            out.append((ids.count(b" ") + 1 if ids else 0, ids, b" ".join(filter(None, map(tokens_of, own)))))
        return out


_TOOLS: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _TOOLS:
        _TOOLS[path] = WordBpe(path)
    return _TOOLS[path]


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs`` (doc_id, text); ``with_ids`` adds ids and decoded.

    Ids are those that the tokenizers library makes of the whole text by the vocabulary file, without special tokens added;
    decoded is what it makes of the ids, with special tokens. Null and empty texts have no ids. Repeated rows stay. An
    empty table gives no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Batches) -> Batches:
        tool = word_bpe(path)
        for batch in slices(batches):
            found = tool.texts([x or "" for x in batch.column("text").to_pylist()])
            columns = [pa.array([n for n, _, _ in found], pa.int64())]
            for k in (1, 2):
                columns.append(pa.array([hashlib.sha256(x[k]).hexdigest() for x in found], pa.string()))
            if with_ids:
                columns += [pa.array([x[k].decode() for x in found], pa.string()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
