"""Packing of token ids into windows by the sum-of-squares rule.

Texts are encoded where they are read. What fills whole windows is done with then; of the rest only length and checksum go on,
to groups of a hundred thousand documents, in which the rule places them. So a task holds numbers, never ids. Windows that stay
open are poured together, which cuts a few rests; these texts alone are encoded again for the checksums of their pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import fits_broadcast, settings
from .common import Batches, groups, stored
from .tokens import ID, KEPT_PARTS, encoder

WINDOW = 2048
#: Documents that are packed together, about, and windows that may be open before they are poured.
GROUP_DOCS, MOST_OPEN = 100_000, 8192
#: Text that is encoded at once; the parts and ids of its words take some thirty times as much.
GROUP_BYTES = 1_000_000
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
Piece = tuple[int, int, int]  # document's number, start, length


class SquaresPacker:
    """Online packing: ``put`` places a piece into the level that leaves the least sum of squared level counts.

    ``counts[h]`` is the number of open windows filled to ``h``. Moving one window from ``h`` to ``h + n`` changes the
    sum of squares by ``2 (counts[h + n] - counts[h]) + 2``; opening one changes it by ``2 counts[n] + 1``; a full
    window leaves the array. Ties go to the fullest window, so that windows close.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def put(self, doc: int, start: int, length: int) -> list[Piece] | None:
        """Place a piece of 1 to ``window`` tokens; returns a window when it is full."""
        room = self.window - length
        counts = self.counts
        best, change = 0, (2 * counts[length] + 1 if room else 0)
        if room:
            gain = counts[length:] - counts[: room + 1]
            gain[room] = -counts[room]  # a full window counts no more
            gain = np.where(counts[: room + 1] > 0, 2 * gain + 2, np.iinfo(np.int64).max)
            gain[room] -= counts[room] > 0
            gain[0] = np.iinfo(np.int64).max
            at = room - int(np.argmin(gain[::-1]))
            if gain[at] <= change:
                best = at
        held = self.open[best].pop() if best else []
        if best:
            counts[best] -= 1
            self.n_open -= 1
        held.append((doc, start, length))
        level = best + length
        if level == self.window:
            return held
        counts[level] += 1
        self.open[level].append(held)
        self.n_open += 1
        return None

    def close(self) -> Iterator[list[Piece]]:
        """Pour what is in the open windows into whole ones, cutting at their ends; the last one may stay short. None is open then."""
        held: list[Piece] = []
        fill = 0
        for level in range(self.window - 1, 0, -1):
            for pieces in self.open[level]:
                for doc, start, length in pieces:
                    while length:
                        took = min(length, self.window - fill)
                        held.append((doc, start, took))
                        start, length, fill = start + took, length - took, fill + took
                        if fill == self.window:
                            yield held
                            held, fill = [], 0
        if held:
            yield held
        self.counts[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.n_open = 0


def encoded_rows(narrow: DataFrame, kept: list[str], tokenizer: str, end_id: int, window: int, kept_parts: int) -> DataFrame:
    """Of each text a row for every whole window and one for the rest, which has no sequence yet."""
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.select("_h1", "_h2", *kept).schema)
    schema = f"_row long, {head}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    end = np.array([end_id], ID).tobytes()
    size = window * ID.itemsize

    def run(batches: Batches) -> Batches:
        first = TaskContext.get().partitionId() << 33
        encode = encoder(tokenizer, kept_parts).encode
        row = sequence = first
        for batch in groups(batches, "_text", size=GROUP_BYTES):
            at, starts, lengths, sums, totals, sequences = [], [], [], [], [], []
            for n, ids in enumerate(encode([x or "" for x in batch.column("_text").to_pylist()])):
                ids += end
                for cut in range(0, len(ids), size):
                    part = ids[cut : cut + size]
                    at.append(n)
                    starts.append(cut // ID.itemsize)
                    lengths.append(len(part) // ID.itemsize)
                    sums.append(zlib.crc32(part))
                    totals.append(len(ids) // ID.itemsize)
                    sequences.append(sequence if len(part) == size else None)
                    sequence += 1
            own = batch.take(pa.array(at, pa.int64()))
            found = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals, sequences)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(at, np.int64) + row), *[own.column(c) for c in ("_h1", "_h2", *kept)], *found], schema=arrow)
            row += batch.num_rows

    return narrow.mapInArrow(run, schema)


def place_rests(window: int, most_open: int):
    """Of a group of rests: a row per piece with its sequence and offset; a piece that was cut has no checksum."""

    def run(key: tuple, rests: pa.Table) -> pa.Table:
        rests = rests.sort_by("_row").combine_chunks()
        packer = SquaresPacker(window)
        at, starts, lengths, sequences, offsets = [], [], [], [], []
        sequence = (1 << 62) + (key[0].as_py() << 32)

        def emit(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for n, start, length in pieces:
                at.append(n)
                starts.append(start)
                lengths.append(length)
                sequences.append(sequence)
                offsets.append(offset)
                offset += length
            sequence += 1

        for n, (start, length) in enumerate(zip(rests["start"].to_pylist(), rests["length"].to_pylist(), strict=True)):
            if full := packer.put(n, start, length):
                emit(full)
            if packer.n_open > most_open:
                for pieces in packer.close():
                    emit(pieces)
        for pieces in packer.close():
            emit(pieces)
        out = rests.take(pa.array(at, pa.int64()))
        whole = pc.equal(out["length"], pa.array(lengths, pa.int64()))
        placed = {
            "start": pa.array(starts, pa.int64()),
            "length": pa.array(lengths, pa.int64()),
            "ids_crc32": pc.if_else(whole, out["ids_crc32"], pa.scalar(None, pa.int64())),
            "sequence_id": pa.array(sequences, pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
        }
        return pa.table({c: placed.get(c, out[c] if c in out.column_names else None) for c in [*rests.column_names, "offset"] if c != "_group"})

    return run


def piece_sums(narrow: DataFrame, pieces: DataFrame, tokenizer: str, end_id: int, kept_parts: int, keep_ids: bool) -> DataFrame:
    """(_h1, _h2, start, length, _crc[, ids]) of the pieces (_h1, _h2, start, length), whose texts are encoded for it."""
    wanted = stored(pieces.groupBy("_h1", "_h2").agg(F.collect_set(F.struct("start", "length")).alias("_cuts")), "cuts")
    if fits_broadcast(narrow.sparkSession, wanted.count(), 8):
        wanted = F.broadcast(wanted)
    schema = "_h1 long, _h2 long, start long, length long, _crc long" + (", ids array<int>" if keep_ids else "")
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    end = np.array([end_id], ID).tobytes()

    def run(batches: Batches) -> Batches:
        encode = encoder(tokenizer, kept_parts).encode
        for batch in groups(batches, "_text", size=GROUP_BYTES):
            rows = []
            texts = encode([x or "" for x in batch.column("_text").to_pylist()])
            for h1, h2, cuts, ids in zip(*(batch.column(c).to_pylist() for c in ("_h1", "_h2", "_cuts")), texts, strict=True):
                flat = np.frombuffer(ids + end, ID)
                for cut in cuts:
                    part = flat[cut["start"] : cut["start"] + cut["length"]]
                    rows.append((h1, h2, cut["start"], cut["length"], zlib.crc32(part.tobytes()), *([part.tolist()] if keep_ids else [])))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    texts = narrow.join(wanted, ["_h1", "_h2"]).select("_h1", "_h2", "_cuts", "_text")
    with settings(narrow.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        return stored(texts.mapInArrow(run, schema).distinct(), "sums")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = WINDOW,
    keep_ids: bool = False,
    keep: list[str] | None = None,
    kept_parts: int = KEPT_PARTS,
    group_docs: int = GROUP_DOCS,
    most_open: int = MOST_OPEN,
) -> DataFrame:
    """One row per piece of a document, with its place in a window of ``window`` tokens.

    Documents of ``window`` tokens or more give whole windows, and a rest. Rests are packed in groups of about ``group_docs``
    documents. When a group ends, or more than ``most_open`` windows are open in it, its open windows are poured together; so one
    window for each pouring may be short. ``keep`` names the columns that go along (doc_id); ``keep_ids`` adds the ids of the
    piece. ``kept_parts`` bounds what the tokenizer remembers in a worker (about 250 bytes each): more is faster.
    Null and empty texts have their end id alone. Long texts are encoded whole, alone in their batch. Repeated rows are packed as
    often as they stand. An empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    kept = [f"_k{i}" for i in range(len(keep))]
    both = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    narrow = docs.select(*[h.alias(f"_h{i + 1}") for i, h in enumerate(both)], *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.col("text").alias("_text"))
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        rows = stored(encoded_rows(narrow, kept, tokenizer, end_id, window, kept_parts), "encoded")
    whole = rows.where("sequence_id is not null").withColumn("offset", F.lit(0).cast("long"))
    rests = rows.where("sequence_id is null")
    n_groups = max(1, -(-rests.count() // group_docs))
    grouped = rests.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(n_groups)))
    placed = stored(grouped.groupBy("_group").applyInArrow(place_rests(window, most_open), whole.schema), "placed")
    names = [x.split()[0] for x in PIECES.split(", ")]
    out = [F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)]
    if keep_ids:
        every = stored(whole.unionByName(placed), "pieces")
        sums = piece_sums(narrow, every, tokenizer, end_id, kept_parts, True)
        found = every.join(sums, ["_h1", "_h2", "start", "length"])
        return found.withColumn("ids_crc32", F.col("_crc")).select(*out, *names, "ids")
    cut = placed.where("ids_crc32 is null")
    sums = piece_sums(narrow, cut, tokenizer, end_id, kept_parts, False)
    if fits_broadcast(docs.sparkSession, sums.count(), 5):
        sums = F.broadcast(sums)
    mended = cut.join(sums, ["_h1", "_h2", "start", "length"]).withColumn("ids_crc32", F.col("_crc"))
    done = whole.unionByName(placed.where("ids_crc32 is not null"))
    return done.select(*out, *names).unionByName(mended.select(*out, *names))
