"""Tokens of two tokenizers over the same bytes: groups between common ends, overlaps, and how usual each overlap is.

A batch of texts is two Arrow lists of ids. Flattened, with parent indices, byte lengths are summed up inside each text; a hash
join on (text, end) finds the ends that both sides share. Each stretch between neighbouring ends of either side lies in one
token of each side, so these stretches are the overlaps. Pairs of ids are counted by batch and task, and Spark adds them up.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import fits_broadcast, fresh_path
from .common import Batches, groups, slices, stored
from .tokens import BYTE_CHARS, ID, LONGEST_PART, encoder

#: Parts that each of the two encoders of a worker remembers, and id pairs that a task counts before it passes them on.
KEPT_PARTS = 300_000
KEPT_PAIRS = 2_000_000
SPACE = "▁"
_PIECES: dict[tuple, PieceEncoder] = {}


class PieceEncoder:
    """Ids of a sentencepiece model as little-endian uint32 bytes; parts between single spaces are encoded once each."""

    def __init__(self, path: str, kept: int = KEPT_PARTS):
        from sentencepiece import SentencePieceProcessor

        self.tool = SentencePieceProcessor(model_file=path)
        self.names = [self.tool.id_to_piece(i) for i in range(self.tool.vocab_size())]
        #: Whether no piece goes on over a space, and a text gets one before it: then parts can be encoded alone.
        self.by_parts = not any(SPACE in p.lstrip(SPACE) for p in self.names) and self.names[self.tool.encode("a")[0]].startswith(SPACE)
        self.kept = kept
        self.known: dict[str, bytes] = {}

    def token_bytes(self) -> list[bytes]:
        """What each id stands for."""
        odd = {f"<0x{b:02X}>": bytes([b]) for b in range(256)}
        return [odd[p] if p in odd else p.replace(SPACE, " ").encode() for p in self.names]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, ID).tobytes() for x in self.tool.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [x.split(" ") if self.by_parts and SPACE not in x else [""] for x in texts]
        known = self.known
        found: dict[str, bytes] = {}
        new = list({p for own in split for p in own if p not in known})
        found.update(zip(new, self.whole(new), strict=True))
        if len(known) < self.kept:
            known.update([(k, v) for k, v in found.items() if 0 < len(k) <= LONGEST_PART])
        out = [b"" if "" in own else b"".join([known[p] if p in known else found[p] for p in own]) for own in split]
        odd = [n for n, own in enumerate(split) if "" in own]
        for n, ids in zip(odd, self.whole([texts[n] for n in odd]), strict=True):
            out[n] = ids
        return out


def pieces(path: str, kept: int = KEPT_PARTS) -> PieceEncoder:
    """The encoder of this worker."""
    if (path, kept) not in _PIECES:
        _PIECES[path, kept] = PieceEncoder(path, kept)
    return _PIECES[path, kept]


def byte_level_bytes(tokenizer) -> list[bytes]:
    """What each id of a byte-level vocabulary stands for; an added token stands for its own text."""
    of_char = {c: b for b, c in BYTE_CHARS.items()}
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [added[i] if i in added else bytes(of_char[c] for c in name) for i, name in enumerate(names)]


class Side(NamedTuple):
    """The tokens of a batch of texts by one tokenizer: flat ids, text of each, end in its text, all in bytes."""

    ids: np.ndarray
    doc: pa.Array
    end: pa.Array
    starts: np.ndarray

    @classmethod
    def of(cls, ids: list[bytes], lengths: pa.Array) -> Side:
        starts = np.append(0, np.cumsum([len(x) // ID.itemsize for x in ids]))
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.frombuffer(b"".join(ids), ID)))
        flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
        total = pc.cumulative_sum(lengths.take(flat))
        before = pa.array(np.append(0, total.to_numpy())[starts[:-1]])
        return cls(flat.to_numpy(), doc, pc.subtract(total, before.take(doc)), starts)


def spells(ids: list[bytes], table: pa.Array, texts: list[bytes]) -> list[bool]:
    """Whether the tokens of each text join to it."""
    flat = table.take(pa.array(np.frombuffer(b"".join(ids), ID)))
    if not len(flat):
        return [not t for t in texts]
    ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    at = ends[np.append(0, np.cumsum([len(x) // ID.itemsize for x in ids]))].tolist()
    data = memoryview(flat.buffers()[2]).cast("B")
    return [data[a:b] == t for a, b, t in zip(at[:-1], at[1:], texts, strict=True)]


class Aligned(NamedTuple):
    """Of a batch: groups and digest of each text, and of each overlap its text and its two ids."""

    n_groups: np.ndarray
    digests: list[str]
    doc: np.ndarray
    a: np.ndarray
    b: np.ndarray


def align(a: Side, b: Side, labels: pa.Array) -> Aligned:
    """Groups and overlaps of texts that both sides spell alike.

    ``labels`` holds each number with a comma, then each with a bar, then each with a semicolon.
    """
    n_docs, n_labels = len(a.starts) - 1, len(labels) // 3
    left = pa.table({"doc": a.doc, "end": a.end, "i": np.arange(len(a.ids))})
    right = pa.table({"doc": b.doc, "end": b.end, "j": np.arange(len(b.ids))})
    both = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
    last_a, last_b = np.sort(both["i"].to_numpy()), np.sort(both["j"].to_numpy())
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    n_groups = np.bincount(a.doc.to_numpy()[last_a], minlength=n_docs)
    # Each group is written as its ids of one side, then of the other.
    codes = np.empty(len(a.ids) + len(b.ids), np.int64)
    code_a, code_b = a.ids.astype(np.int64), b.ids.astype(np.int64)
    code_a[last_a] += n_labels
    code_b[last_b] += 2 * n_labels
    codes[np.arange(len(a.ids)) + np.repeat(last_b + 1 - n_b, n_a)] = code_a
    codes[np.arange(len(b.ids)) + np.repeat(last_a + 1, n_b)] = code_b
    line = labels.take(pa.array(codes))
    digests = [""] * n_docs
    if len(codes):
        at = np.frombuffer(line.buffers()[1], np.int32)[line.offset : line.offset + len(line) + 1][a.starts + b.starts].tolist()
        data = memoryview(line.buffers()[2]).cast("B")
        digests = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]
    # Ends in the texts written one after the other; both sides agree on them.
    sizes = np.zeros(n_docs + 1, np.int64)
    full = np.flatnonzero(np.diff(a.starts))
    sizes[full + 1] = a.end.to_numpy()[a.starts[full + 1] - 1]
    base = np.cumsum(sizes)
    ends_a, ends_b = base[a.doc.to_numpy()] + a.end.to_numpy(), base[b.doc.to_numpy()] + b.end.to_numpy()
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])[: len(ends)]]
    i, j = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return Aligned(n_groups, digests, a.doc.to_numpy()[i], a.ids[i], b.ids[j])


ROWS = "row long, {doc}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair long, docs long"


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("docs", "sum")]).rename_columns(["pair", "docs"])


def aligned_rows(docs: DataFrame, byte_level: str, piece_model: str, kept_parts: int, kept_pairs: int) -> DataFrame:
    """A row for each text, with the id pairs of its overlaps in ``links``, and rows (pair, docs) with counts of a task's texts.

    A pair is id of A * size of B's vocabulary + id of B.
    """
    doc = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    schema = ROWS.format(doc=doc)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Batches) -> Batches:
        first, second = encoder(byte_level, kept_parts, plain=True), pieces(piece_model, kept_parts)
        bytes_a, bytes_b = (pa.array(x, pa.binary()) for x in (byte_level_bytes(first.tokenizer), second.token_bytes()))
        lengths = [pc.binary_length(x).cast(pa.int64()) for x in (bytes_a, bytes_b)]
        labels = pa.array([f"{i}{c}" for c in ",|;" for i in range(max(len(bytes_a), len(bytes_b)))], pa.string())
        size, kind = len(bytes_b), np.dtype("<u4") if len(bytes_a) * len(bytes_b) <= 1 << 32 else np.dtype("<u8")
        row = TaskContext.get().partitionId() << 33
        counts: list[pa.Table] = []
        waiting = 0

        def counted(table: pa.Table) -> Batches:
            for part in table.to_batches(max_chunksize=100_000):
                none = [pa.nulls(part.num_rows, f.type) for f in arrow][:8]
                yield pa.RecordBatch.from_arrays([*none, part.column("pair"), part.column("docs")], schema=arrow)

        for batch in groups(batches, "text", size=2_000_000):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids_a, ids_b = first.encode([f" {x}" if x else "" for x in texts]), second.encode(texts)
            spelled = [b" " + x.encode() if x else b"" for x in texts]
            good = [x and y for x, y in zip(spells(ids_a, bytes_a, spelled), spells(ids_b, bytes_b, spelled), strict=True)]
            if not all(good):
                ids_a, ids_b = ([x if ok else b"" for x, ok in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
            a, b = Side.of(ids_a, lengths[0]), Side.of(ids_b, lengths[1])
            found = align(a, b, labels)
            pair = found.a.astype(np.int64) * size + found.b
            n_links = np.bincount(found.doc, minlength=len(texts))
            cuts = np.append(0, np.cumsum(n_links))
            ends = pa.py_buffer((cuts * kind.itemsize).astype(np.int32))
            links = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, ends, pa.py_buffer(pair.astype(kind))])
            numbers = [np.diff(a.starts), np.diff(b.starts), found.n_groups, n_links]
            none = pa.nulls(len(texts), pa.int64())
            columns = [pa.array(np.arange(row, row + len(texts))), batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in numbers]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.digests, pa.string()), links, none, none], schema=arrow)
            row += len(texts)
            held = pa.table({"doc": found.doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([])
            held = held.group_by("pair", use_threads=False).aggregate([("doc", "count")]).rename_columns(["pair", "docs"])
            counts.append(held)
            waiting += held.num_rows
            if waiting > kept_pairs:
                counts = [_added(counts)]
                waiting = counts[0].num_rows
                if waiting > kept_pairs // 2:
                    yield from counted(counts.pop())
                    waiting = 0
        if counts:
            yield from counted(_added(counts))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(rows: DataFrame, size: int) -> DataFrame:
    """(pair, docs, best), stored: how many texts hold each pair, and whether no pair of the same id of A is in more."""
    counts = rows.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / size))
    return stored(counts.withColumn("best", F.max("docs").over(of_a) == F.col("docs")), "pairs")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, cuts between texts) of the links of a batch."""
    links = batch.column("links").to_pylist()
    n = batch.column("n_links").to_numpy()
    total = int(n.sum())
    held = b"".join(links)
    kind = np.dtype("<u8") if total and len(held) > 4 * total else np.dtype("<u4")
    return np.frombuffer(held, kind).astype(np.int64), np.append(0, np.cumsum(n))


def _sums_by_table(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """n_best and count_sum by a table of all pairs, which a count has shown to be small."""
    table = counts.orderBy("pair").toArrow()
    sent = texts.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "docs", "best")))
    keep = [c for c in texts.columns if c != "links"]

    def run(batches: Batches) -> Batches:
        pairs, docs, best = sent.value
        for batch in slices(batches):
            own, cuts = _ids(batch)
            new, of = np.unique(own, return_inverse=True)
            at = np.searchsorted(pairs, new)
            sums = [np.append(0, np.cumsum(x[at][of]))[cuts] for x in (best.astype(np.int64), docs)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(np.diff(x)) for x in sums]], [*keep, "n_best", "count_sum"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "links")
    return texts.mapInArrow(run, f"{kinds}, n_best long, count_sum long")


def _sums_by_join(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join with the pairs of each text."""

    def distinct(batches: Batches) -> Batches:
        for batch in groups(batches, "links"):
            own, cuts = _ids(batch)
            for row, a, b in zip(batch.column("row").to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                pair, n = np.unique(own[a:b], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), row, np.int64)), pa.array(pair), pa.array(n, pa.int64())], ["row", "pair", "k"])

    held = texts.select("row", "n_links", "links").mapInArrow(distinct, "row long, pair long, k long").join(counts, "pair")
    sums = held.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("docs")).alias("count_sum"))
    out = texts.drop("links").join(stored(sums, "link_sums"), "row", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def align_documents(docs: DataFrame, byte_level: str, piece_model: str, kept_parts: int = KEPT_PARTS, kept_pairs: int = KEPT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A is the byte-level vocabulary of the tokenizers library in ``byte_level``, B the sentencepiece model ``piece_model``. Both
    spell a space and the text; special tokens in a text are ordinary text. A text that is null or empty, or that one of the
    two doesn't spell (such as one with U+2581), has no tokens: zeros and an empty string. Repeated rows count as documents of
    their own. Long texts are encoded whole, alone in their batch. Other columns, whatever their names, don't matter. An empty
    table gives no rows. The counts of id pairs, whose number is bounded by the vocabularies, go to all tasks if a count shows
    that they fit ``spark.factorloom.broadcastBytes``, else texts are joined with them.
    """
    from sentencepiece import SentencePieceProcessor

    spark = docs.sparkSession
    size = SentencePieceProcessor(model_file=piece_model).vocab_size()
    path = fresh_path(spark, "aligned")
    found = aligned_rows(docs, byte_level, piece_model, kept_parts, kept_pairs)
    found.write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(found.schema).parquet(path)
    counts = pair_counts(rows, size)
    texts = rows.where("row is not null").drop("pair", "docs")
    sums = _sums_by_table if fits_broadcast(spark, counts.count(), 1) else _sums_by_join
    return sums(texts, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
