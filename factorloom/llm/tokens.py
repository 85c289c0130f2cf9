"""Subword ids of many texts at the price of their distinct words.

A space that follows a character other than white space starts a new piece in the byte-level pattern, so what stands
between such spaces is encoded alone. Each distinct part is encoded once by the tokenizers library and kept in a table
of bounded size that lives as long as the Python worker. A text where a space follows white space is encoded whole.
"""

from __future__ import annotations

import gc
import os
from bisect import bisect_right
from itertools import accumulate, chain
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

ID = np.dtype("<u4")
KEPT_PARTS = 900_000
LONGEST_PART = 48
#: The pattern of the byte-level pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte: visible ones for themselves, the others from 256 on.
BYTE_CHARS = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}
#: Marks that are a piece of their own behind letters.
ENDS = ",.;:!?|"
#: Begins a part that stands behind a line end.
LINE = "\0"
_ENCODERS: dict[tuple, PartEncoder] = {}


def encoder(path: str, kept: int = KEPT_PARTS, plain: bool = False) -> PartEncoder:
    """The encoder of this worker for the vocabulary file at ``path``, which every machine has."""
    if (path, kept, plain) not in _ENCODERS:
        _ENCODERS[path, kept, plain] = PartEncoder(path, kept, plain)
    return _ENCODERS[path, kept, plain]


class PartEncoder:
    """``encode`` gives what ``encode_batch(texts, add_special_tokens=False)`` gives, as little-endian uint32 bytes.

    With ``plain`` the strings of special tokens are ordinary text.

    A new part is cut into the pieces of the byte-level pattern, and each new piece goes once through the library's BPE
    model. A part with an added token, and a text that can't be cut, go through the whole tokenizer; so do all texts if the
    vocabulary has a normalizer or an added token that looks like words.
    """

    def __init__(self, path: str, kept: int = KEPT_PARTS, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model_only = Tokenizer(self.tokenizer.model)  # one model for both, which takes most of their memory
        self.all_added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether pieces may go to the model alone: no normalizer, and no added token that parts aren't searched for.
        like_words = [x for x in self.all_added if x.split() != [x] or all(c.isalpha() or c in ENDS for c in x)]
        self.direct = self.tokenizer.normalizer is None and not like_words
        self.pieces = regex.compile(PIECES)
        self.kept = kept
        self.after_space: dict[str, bytes] = {}
        self.at_start: dict[str, bytes] = {}
        self.after_line: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Through the whole tokenizer."""
        return [np.array(x.ids, ID).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece of the byte-level pattern, none of which holds an added token or a zero character."""
        out: list[bytes] = []
        tokenize = self.model_only.model.tokenize
        for k in range(0, len(pieces), 1000):
            mapped = "\0".join(pieces[k : k + 1000]).encode().decode("latin-1").translate(BYTE_CHARS)
            found = map(tokenize, mapped.split(BYTE_CHARS[0]))
            out += [pack(f"<{len(tokens)}I", *[x.id for x in tokens]) for tokens in found]
        return out

    def of_parts(self, parts: set[str]) -> dict[str, bytes | None]:
        """Ids of each part behind a space; none for a part after which a space wouldn't start a piece."""
        letters = list(filter(str.isalpha, parts))
        found: dict[str, bytes | None] = dict(zip(letters, self.of_pieces([" " + x for x in letters]), strict=True))
        ended, others, odd = [], [], []
        for x in parts.difference(letters):
            if x[:-1].isalpha() and x[-1] in ENDS:
                ended.append(x)
            elif not x or x[-1].isspace():
                found[x] = None
            elif "\0" in x or any(t in x for t in self.all_added):
                odd.append(x)
            else:
                others.append(x)
        known = self.after_space
        new = list({x[:-1] for x in ended if x[:-1] not in found and x[:-1] not in known})
        found.update(zip(new, self.of_pieces([" " + x for x in new]), strict=True))
        marks = dict(zip(ENDS, self.of_pieces(list(ENDS)), strict=True))
        found.update([(x, (found.get(x[:-1]) or known[x[:-1]]) + marks[x[-1]]) for x in ended])
        found.update(zip(odd, self.whole([" " + x for x in odd]), strict=True))
        cut = [self.pieces.findall(" " + x) for x in others]
        # A piece that begins with the space is a part by itself.
        table = {p: found.get(p[1:]) or known.get(p[1:]) if p[0] == " " else None for p in {p for c in cut for p in c}}
        pieces = [p for p, ids in table.items() if ids is None]
        table.update(zip(pieces, self.of_pieces(pieces), strict=True))
        found.update([(x, b"".join([table[p] for p in c])) for x, c in zip(others, cut, strict=True)])
        return found

    def first_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of the parts that begin the texts, with no space before them."""
        known = self.at_start
        new = {x for x in parts if x not in known}
        letters = [x for x in new if x.isalpha()]
        found = dict(zip(letters, self.of_pieces(letters), strict=True))
        rest = list(new.difference(letters))
        found.update(zip(rest, self.whole(rest), strict=True))
        if len(known) < self.kept // 10:
            known.update([(k, v) for k, v in found.items() if len(k) <= LONGEST_PART])
        return [known[x] if x in known else found[x] for x in parts]

    def learn(self, parts: set[str]) -> dict[str, bytes | None]:
        """Ids of parts that aren't kept yet; they are kept from now on while there is room."""
        found = self.of_parts(parts)
        if len(self.after_space) < self.kept:
            self.after_space.update([(k, v) for k, v in found.items() if v is not None and len(k) <= LONGEST_PART])
        return found

    def encode(self, texts: list[str], group_chars: int = 6_000_000) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        collects = gc.isenabled()
        gc.disable()  # millions of strings in lists, without cycles
        try:
            for text in texts:
                group.append(text)
                size += len(text)
                if size >= group_chars:
                    out += self._group(group)
                    group, size = [], 0
            return out + self._group(group)
        finally:
            if collects:
                gc.enable()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What ``encode`` gives for a column of texts (null: empty), as the ids of all texts one behind the other, and how many each has.

        Parts are cut and numbered by Arrow, so that each distinct one is looked up once and its ids are copied by numpy.
        """
        texts = pc.fill_null(texts, "")
        if not len(texts) or not self.direct:
            return self._joined(self.whole(texts.to_pylist()))
        zero = pc.match_substring(texts, LINE)
        split = pc.split_pattern(self.marked(pc.if_else(zero, "", texts)), " ")
        starts = split.offsets.to_numpy().astype(np.int64)
        starts, parts = starts - starts[0], split.flatten()
        first = starts[:-1]
        coded = parts.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        inner = np.ones(len(at), bool)
        inner[first] = False
        behind = np.zeros(len(coded.dictionary), bool)  # stands behind a space somewhere
        behind[at[inner]] = True
        collects = gc.isenabled()
        gc.disable()
        try:
            distinct = coded.dictionary.filter(pa.array(behind))
            words = distinct.to_numpy(zero_copy_only=False).tolist()
            ids: list[bytes | None] = list(map(self.after_space.get, words))
            lines = np.flatnonzero(pc.starts_with(distinct, LINE).to_numpy(zero_copy_only=False)).tolist()
            for n, x in zip(lines, self.line_parts([words[n] for n in lines]), strict=True):
                ids[n] = x
            new = [n for n, x in enumerate(ids) if x is None]
            found = self.learn({words[n] for n in new}.difference([words[n] for n in lines]))
            odd = np.zeros(len(words) + len(first), bool)  # no ids of its own
            for n in new:
                ids[n] = x = found.get(words[n])
                if x is None:
                    ids[n], odd[n] = b"", True
            firsts = parts.take(pa.array(first)).to_numpy(zero_copy_only=False).tolist()
            ids += self.first_parts(firsts)
            odd[len(words) :] = [x[-1:].isspace() for x in firsts]
            odd[len(words) :] &= np.diff(starts) > 1
            at = (np.cumsum(behind) - 1)[at]
            at[first] = len(words) + np.arange(len(first))
            table, each = self._joined(ids)
        finally:
            if collects:
                gc.enable()
        took = each[at]
        flat = table[np.repeat((np.cumsum(each) - each)[at] - (np.cumsum(took) - took), took) + np.arange(int(took.sum()))]
        sizes = np.add.reduceat(took, first)
        whole = np.union1d(np.searchsorted(starts, np.flatnonzero(odd[at]), "right") - 1, np.flatnonzero(zero.to_numpy(zero_copy_only=False)))
        if len(whole):
            own = np.split(flat, np.cumsum(sizes)[:-1])
            for n, x in zip(whole.tolist(), self.whole(texts.take(pa.array(whole)).to_pylist()), strict=True):
                own[n] = np.frombuffer(x, ID)
            flat, sizes = np.concatenate(own), np.fromiter(map(len, own), np.int64, len(own))
        return flat, sizes

    def marked(self, texts: pa.Array) -> pa.Array:
        """The texts, which have no zero character, with a space and LINE for each line end, so that words behind line ends are parts.

        Not those where white space stands beside a line end, which then isn't a piece of its own, nor those with added tokens.
        """
        left = pc.match_substring_regex(texts, r"[\s\x0b]\n|\n[\s\x0b]")
        for token in self.all_added:
            left = pc.or_(left, pc.match_substring(texts, token))
        return pc.if_else(left, texts, pc.replace_substring(texts, "\n", f" {LINE}"))

    def line_parts(self, parts: list[str]) -> list[bytes | None]:
        """Ids of distinct parts that begin with LINE, the line end's with them; none where a space behind wouldn't start a piece."""
        known = self.after_line
        new = [x for x in parts if x not in known and not x[-1].isspace()]
        cut = [self.pieces.findall("\n" + x[1:]) for x in new]
        pieces = list({p for c in cut for p in c})
        table = dict(zip(pieces, self.of_pieces(pieces), strict=True))
        found = {x: b"".join([table[p] for p in c]) for x, c in zip(new, cut, strict=True)}
        if len(known) < self.kept // 10:
            known.update([(k, v) for k, v in found.items() if len(k) <= LONGEST_PART])
        return [known.get(x) or found.get(x) for x in parts]

    @staticmethod
    def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(ids), ID), np.fromiter(map(len, ids), np.int64, len(ids)) // ID.itemsize

    def _group(self, texts: list[str]) -> list[bytes]:
        if not self.direct:
            return self.whole(texts)
        split = [x.split(" ") for x in texts]
        ends = list(accumulate(map(len, split)))
        starts = [0, *ends][:-1]
        parts = list(chain.from_iterable(split))
        ids: list[bytes | None] = list(map(self.after_space.get, parts))
        for at, first in zip(starts, self.first_parts([own[0] for own in split]), strict=True):
            ids[at] = first
        new = [at for at, x in enumerate(ids) if x is None]
        found = self.learn({parts[at] for at in new})
        odd = {n for n, own in enumerate(split) if len(own) > 1 and own[0][-1:].isspace()}
        for at in new:
            ids[at] = x = found[parts[at]]
            if x is None:  # a part without ids of its own
                ids[at] = b""
                odd.add(bisect_right(ends, at))
        out = [b"".join(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
        for n, x in zip(odd, self.whole([texts[n] for n in odd]), strict=True):
            out[n] = x
        return out
