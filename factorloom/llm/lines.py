"""Lines that many documents share stay in one document: hashes in ranges, streamed in order, and bitmaps of kept lines.

Each long line gives a row (128-bit hash of its key, document, text, position). The rows are range-partitioned by hash and
document and sorted inside, so that a task meets the documents of a key one after the other, the one that keeps the line
first, and holds one Arrow batch. A key with very many rows lies in many ranges: what a batch can't decide, because a key
goes on beyond it, is written with the key and is settled by one row for each such piece.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_limit, fits_broadcast
from .common import Batches, groups, slices, stored, utf8

BLANKS = b" \t\n\x0b\x0c\r"
_LATER_BYTES = bytes(range(0x80, 0xC0))  # of a character in UTF-8, behind its first one
#: Stands for a document without id.
NO_ID = -(1 << 63)


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """The line without blanks at its ends, in lower case (A to Z); none if it has too few characters."""
    key = line.strip(BLANKS)
    if len(key) < least_chars or len(key) < 4 * least_chars and len(key.translate(None, _LATER_BYTES)) < least_chars:
        return None
    return key.lower()


def line_rows(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc, tag, line) of each long line of the rows (doc, tag, text); copies of a row in a batch count once."""

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            seen, own, tags, at, hashes = set(), [], [], [], []
            for doc, tag, text in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), utf8(batch.column("text")), strict=True):
                if not text or len(text) < least_chars or (doc, tag) in seen:
                    continue
                seen.add((doc, tag))
                for k, line in enumerate(text.split(b"\n")):
                    if (key := line_key(line, least_chars)) is not None:
                        hashes.append(xxhash.xxh3_128_digest(key))
                        own.append(doc)
                        tags.append(tag)
                        at.append(k)
            h = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            columns = [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(own, pa.int64()), pa.array(tags, pa.int64()), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc", "tag", "line"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc long, tag long, line int")


def stream_firsts(least_docs: int):
    """Over rows in the order of key, document from the greatest on, and line: what goes, and what only later batches can tell.

    Rows (doc, tag, line) without h1 are lines that go. Rows with h1 and without n are lines of a key that reaches an end of
    its batch. Rows with n hold, for a piece of such a key, how many documents begin in it, and the greatest one.
    """

    def run(batches: Batches) -> Batches:
        before = None  # key and document of the last row
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc"))
            new_key = np.ones(size, bool)
            new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_key.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            starts = np.flatnonzero(new_key)
            of = np.cumsum(new_key) - 1
            if before is not None and before == (h1[0], h2[0], doc[0]):
                new_doc[0] = False
            n_docs = np.add.reduceat((new_doc & (doc != NO_ID)).astype(np.int64), starts)
            first = doc[starts]
            edge = np.zeros(len(starts), bool)
            edge[[0, -1]] = True
            goes = np.flatnonzero(~edge[of] & (n_docs[of] >= least_docs) & (doc < first[of]))
            asks = np.flatnonzero(edge[of])
            ends = np.flatnonzero(edge)
            before = (h1[-1], h2[-1], doc[-1])
            lines = batch.take(pa.array(np.concatenate([goes, asks])))
            none = pa.nulls(len(goes), pa.int64())
            blank = pa.nulls(len(ends), pa.int64())
            columns = [
                pa.concat_arrays([lines.column("doc"), pa.array(first[ends])]),
                pa.concat_arrays([lines.column("tag"), blank]),
                pa.concat_arrays([lines.column("line"), blank.cast(pa.int32())]),
                pa.concat_arrays([none, pa.array(h1[asks]), pa.array(h1[starts[ends]])]),
                pa.concat_arrays([none, pa.array(h2[asks]), pa.array(h2[starts[ends]])]),
                pa.concat_arrays([pa.nulls(len(goes) + len(asks), pa.int64()), pa.array(n_docs[ends])]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "tag", "line", "h1", "h2", "n"])

    return run


def dropped_lines(rows: DataFrame, least_docs: int) -> DataFrame:
    """(doc, tag, line) of the lines that go, from stored rows of ``line_rows``."""
    ordered = rows.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", F.desc("doc"), "tag", "line")
    found = stored(ordered.mapInArrow(stream_firsts(least_docs), "doc long, tag long, line int, h1 long, h2 long, n long"), "lines")
    pieces = found.where("n is not null").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc").alias("first"))
    shared = stored(pieces.where(F.col("docs") >= least_docs).drop("docs"), "shared_lines")
    if fits_broadcast(rows.sparkSession, shared.count(), 3):
        shared = F.broadcast(shared)
    open_lines = found.where("h1 is not null and n is null").join(shared, ["h1", "h2"]).where("doc < first")
    return found.where("h1 is null").select("doc", "tag", "line").unionByName(open_lines.select("doc", "tag", "line"))


def pack_bits(batches: Batches) -> Batches:
    """Compressed bitmaps: bit i says whether line i stays; lines beyond the last bit stay."""
    for batch in batches:
        out = []
        for gone in batch.column("gone").to_pylist():
            bits = np.ones((max(gone) + 8) // 8 * 8, bool)
            bits[gone] = False
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(out, pa.binary())], ["doc", "tag", "keep"])


def keep_bitmaps(rows: DataFrame, least_docs: int) -> DataFrame:
    """(doc, tag, keep), stored: a compressed bitmap for each text that loses lines."""
    gone = dropped_lines(rows, least_docs).groupBy("doc", "tag").agg(F.collect_set("line").alias("gone"))
    return stored(gone.mapInArrow(pack_bits, "doc long, tag long, keep binary"), "bitmaps")


def kept_lines(lines: list[bytes], keep: bytes | None) -> list[bytes]:
    """The lines that a bitmap keeps."""
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)]
    return [x for x, bit in zip(lines, bits.tolist(), strict=False) if bit] + lines[len(bits) :]


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, with_text: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row; ``with_text`` adds ``kept``, the text that is left.

    A line's key has at least ``least_chars`` code points. A key that ``least_docs`` ids or more hold loses its lines in all
    rows but those of the greatest id that holds it. Null and empty texts are one empty line. Rows without an id count for
    no key and never keep a shared line (an id of -2^63 counts as none). Repeated rows count as one document and get the
    same result each. Long texts are split whole; a task holds some megabytes of them, or one text. Other columns, whatever
    their names, don't matter. An empty table gives no rows. Keys are compared by 128 bits.
    """
    spark = docs.sparkSession
    narrow = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    bitmaps = keep_bitmaps(stored(line_rows(narrow.select("doc", "tag", "text"), least_chars), "line_rows"), least_docs)
    size = bitmaps.agg(F.count("*"), F.coalesce(F.sum(F.length("keep")), F.lit(0))).first()
    if 2 * (size[1] + 40 * size[0]) <= broadcast_limit(spark):
        bitmaps = F.broadcast(bitmaps)

    def run(batches: Batches) -> Batches:
        for batch in groups(batches, "text"):
            counts, dropped, digests, texts = [], [], [], []
            for text, keep in zip(utf8(batch.column("text")), batch.column("keep").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                kept = kept_lines(lines, keep)
                joined = b"\n".join(kept)
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
                digests.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    texts.append(joined)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string" + (", kept string" if with_text else "")
    return narrow.join(bitmaps, ["doc", "tag"], "left").select("doc_id", "text", "keep").mapInArrow(run, schema)
