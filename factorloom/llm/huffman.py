"""Token ids in files: canonical Huffman codes of bounded length, in blocks that are read alone."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import Batches, groups, slices, stored
from .tokens import ID, encoder

LONGEST_CODE = 16
#: A block closes at so many ids, after a whole document; a checkpoint stands at every so many ids.
BLOCK_IDS = 1 << 17
CHECKPOINT_IDS = 64
#: Rows of ``blocks``: number of ids, documents and their sizes, bits at checkpoints as differences, and the code bits.
BLOCK = "part int, block int, n_ids long, doc_ids array<long>, sizes array<long>, steps binary, bits binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits for the ids with a count (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes of more than {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(float)
    # Each level holds the single ids and pairs of the level below, in order of weight; pairs stand for what they hold.
    levels = []
    packages = np.zeros(0)
    for _ in range(longest):
        merged = np.concatenate([weights, packages])
        place = np.argsort(merged, kind="stable")
        levels.append(place < len(weights))
        merged = merged[place]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(weights) - 2
    for single in reversed(levels):
        singles = int(single[:take].sum())
        lengths[order[:singles]] += 1
        take = 2 * (take - singles)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint32)
    if len(order):
        own = lengths[order].astype(np.int64)
        longest = int(own.max())
        spans = np.left_shift(np.int64(1), longest - own)
        codes[order] = (np.cumsum(spans) - spans) >> (longest - own)
    return codes


@dataclass
class Coder:
    """Both directions of one code, which is fixed by ``lengths``."""

    lengths: np.ndarray

    def __post_init__(self):
        self.codes = canonical_codes(self.lengths)
        self.width = int(self.lengths.max(initial=1))
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        times = np.left_shift(1, self.width - self.lengths[order].astype(np.int64))
        size = 1 << self.width
        self.id_at = np.zeros(size, np.uint32)
        self.bits_at = np.ones(size, np.int64)
        filled = np.repeat(order, times)
        self.id_at[: len(filled)] = filled
        self.bits_at[: len(filled)] = self.lengths[filled]

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The code bits (most significant first) and the bits between checkpoints as uint16."""
        size = self.lengths[ids].astype(np.int64)
        end = np.cumsum(size)
        start = end - size
        marks = start[::CHECKPOINT_IDS]
        steps = np.diff(marks, append=end[-1] if len(end) else 0).astype("<u2")
        # Each code lies in one or two words of 32 bits; codes in a word have no bit in common, so they can be added.
        word = start >> 5
        placed = self.codes[ids].astype(np.uint64) << (64 - (start & 31) - size).astype(np.uint64)
        out = np.zeros(int(word[-1]) + 3 if len(word) else 2, np.uint64)
        if len(word):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            at = word[first]
            out[at] += np.add.reduceat(placed >> np.uint64(32), first)
            out[at + 1] += np.add.reduceat(placed & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes(), steps.tobytes()

    def decode(self, bits: bytes, steps: bytes, n_ids: int) -> np.ndarray:
        """All stretches between checkpoints of a block at once: in each turn every stretch gives its next id."""
        steps_ = np.frombuffer(steps, "<u2").astype(np.int64)
        at = np.cumsum(steps_) - steps_
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        out = np.zeros((len(at), CHECKPOINT_IDS), ID)
        last = n_ids - (len(at) - 1) * CHECKPOINT_IDS
        for k in range(CHECKPOINT_IDS):
            if k == last:
                at = at[:-1]
            if not len(at):
                break
            shift = (64 - self.width - (at & 31)).astype(np.uint64)
            window = ((pairs[at >> 5] >> shift) & np.uint64((1 << self.width) - 1)).astype(np.int64)
            out[: len(at), k] = self.id_at[window]
            at = at + self.bits_at[window]
        return out.ravel()[:n_ids]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, parts: int) -> DataFrame:
    """(part, block, doc_ids, sizes, ids) in ascending order of doc_id over and within parts: blocks of whole documents.

    A block closes at BLOCK_IDS ids; ``sizes`` has each document's, and ``ids`` all of them as little-endian uint16 or uint32.
    """

    def run(batches: Batches) -> Batches:
        tool = encoder(tokenizer)
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        sizes: list[int] = []
        part, block, n = None, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal block, n
            values = [[part], [block], [docs], [sizes], [_narrow(np.concatenate(held))]]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)
            for x in (held, docs, sizes):
                x.clear()
            block, n = block + 1, 0
            return out

        for batch in groups(batches, "text"):
            flat, own = tool.encode_column(batch.column("text"))
            flat, own = np.insert(flat, np.cumsum(own), end_id), own + 1
            part = batch.column("part")[0].as_py()  # the same in all rows of a task
            at = start = 0
            for doc, size in zip(batch.column("doc_id").to_pylist(), own.tolist(), strict=True):
                if n >= BLOCK_IDS:
                    held.append(flat[start:at])
                    start = at
                    yield close()
                docs.append(doc)
                sizes.append(size)
                n, at = n + size, at + size
            held.append(flat[start:])
        if docs:
            yield close()

    names, kinds = ["part", "block", "doc_ids", "sizes", "ids"], [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    return ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, "part int, block int, doc_ids array<long>, sizes array<long>, ids binary")


def _narrow(ids: np.ndarray) -> bytes:
    """A first byte with the width of an id, then the ids."""
    if ids.max(initial=0) < 1 << 16:
        return b"\2" + ids.astype("<u2").tobytes()
    return b"\4" + ids.tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u2" if x[0] == 2 else "<u4", offset=1).astype(ID)


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id stands in the whole table; a task sends one row per id that it has seen."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, 20):
            rows = batch.column("ids").to_pylist()
            for width in {x[0] for x in rows}:
                ids = np.frombuffer(b"".join([x[1:] for x in rows if x[0] == width]), f"<u{width}")
                total += np.bincount(ids, minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


def write_ids(tokens: DataFrame, path: str, vocabulary: int) -> None:
    """Write the ids of (part, block, doc_ids, sizes, ids), a block of whole documents in each row.

    The folder has two Parquet tables. ``code``: the length of each id's code, which fixes the canonical code.
    ``blocks``: one row per block, numbered by (part, block), each with whole documents and checkpoints of bit offsets.
    """
    lengths = code_lengths(id_counts(tokens, vocabulary))
    spark = tokens.sparkSession
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").write.parquet(f"{path}/code")

    def run(batches: Batches) -> Batches:
        coder = Coder(lengths)
        for batch in slices(batches, 1):
            ids = _wide(batch.column("ids")[0].as_py())
            bits, steps = coder.encode(ids)
            columns = {c: batch.column(c) for c in ("part", "block", "doc_ids", "sizes")}
            columns |= {"n_ids": pa.array([len(ids)], pa.int64()), "steps": pa.array([steps], pa.binary()), "bits": pa.array([bits], pa.binary())}
            names = [c.split()[0] for c in BLOCK.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    tokens.mapInArrow(run, BLOCK).write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, doc_id, place, n_tokens, ids_crc32) of every document in the files, by decoding every block."""
    row = spark.read.parquet(f"{path}/code").head()
    lengths = np.frombuffer(bytes(row["lengths"]), np.uint8)

    def run(batches: Batches) -> Batches:
        coder = Coder(lengths)
        for batch in slices(batches, 20):
            out: list[tuple] = []
            for b in batch.to_pylist():
                ids = coder.decode(b["bits"], b["steps"], b["n_ids"])
                start = 0
                for place, (doc, size) in enumerate(zip(b["doc_ids"], b["sizes"], strict=True)):
                    out.append((b["part"], b["block"], place, doc, start, size, zlib.crc32(ids[start : start + size].tobytes())))
                    start += size
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "block", "place", "doc_id", "in_block", "n_tokens", "ids_crc32"])

    schema = "part int, block int, place int, doc_id long, in_block long, n_tokens long, ids_crc32 long"
    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, schema)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, before): ids before each block. Parts are summed apart, so the windows run over one row per part
    and over the blocks of one part."""
    from pyspark.sql import Window

    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "n_ids")
    in_part = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    return blocks.withColumn("in_part", in_part).join(before, "part").select("part", "block", (F.col("in_part") + F.col("parts_before")).alias("before"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int = 1 << 16, parts: int | None = None, path: str | None = None) -> DataFrame:
    """Write the ids of all documents in ascending order of doc_id, read the files back, and describe what they hold.

    doc_id, start, n_tokens and ids_crc32 of every row. Null and empty texts have their end id alone. Rows without id come
    first; repeated ids stand next to each other, in any order. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = parts or max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = path or fresh_path(spark, "token-ids")
    write_ids(stored(tokenized(docs, tokenizer, end_id, parts), "tokens"), path, vocabulary)
    rows = read_ids(spark, path).join(block_starts(spark, path), ["part", "block"])
    return rows.select("doc_id", (F.col("before") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")
