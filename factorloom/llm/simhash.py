"""Near-copies by fingerprints of shingles and covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fits_broadcast
from .common import Batches, slices, stored, utf8
from .graph import components

BITS = 64
SEED = 42
#: Buckets of up to so many fingerprints are linked inside a task, larger ones by keys.
SMALL_BUCKET = 128


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words of a text in lower case (A to Z), joined by one space, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; zero without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 4096):
        some = hashes[part : part + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """The columns of ``keep`` and ``fp``, the fingerprint as a signed long."""
    names = [f"k{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "t")

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            found = np.array([fingerprint(shingle_hashes(t, width)) for t in utf8(batch.column("t"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], pa.array(found.view(np.int64))], [*names, "fp"])

    out = narrow.mapInArrow(run, f"{schema}, fp long")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "fp")


def covering_masks(radius: int, bits: list[int] | None = None) -> list[int]:
    """2^(radius+1) - 1 masks over ``bits`` such that any ``radius`` of them lie outside of one mask.

    Bit i carries a vector m(i) of radius + 1 bits, dealt in turn over the vectors other than zero. Mask v keeps bit i
    if the scalar product of m(i) and v is odd. For ``radius`` bits there is always a v at right angles to all of their
    vectors, so two fingerprints that differ in these bits alone agree under mask v.
    """
    bits = list(range(BITS)) if bits is None else bits
    size = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((1 + i % size) & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions (greater, less) of the edges of a spanning forest of a symmetric table of who is near whom."""
    root = np.arange(len(near))
    a, b = [], []
    for i in range(1, len(near)):
        for r in set(root[:i][near[i, :i]].tolist()):
            if root[i] != r:
                a.append(i)
                b.append(int(np.flatnonzero(near[i, :i] & (root[:i] == r))[0]))
                root[: i + 1][root[: i + 1] == r] = root[i]
    return a, b


def _link_small(radius: int):
    """Edges of a spanning forest of each bucket, from all comparisons inside it; the bucket's size is bounded."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            a, b = [], []
            for own in batch.column("fps").to_pylist():
                x = np.array(sorted(own), np.int64)
                u = x.view(np.uint64)
                i, j = _forest(np.bitwise_count(u[:, None] ^ u[None, :]) <= radius)
                a += x[i].tolist()
                b += x[j].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_links(fps: DataFrame, radius: int = 2, small: int = SMALL_BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that connect all pairs within ``radius`` (0 to 2) bits.

    A fingerprint goes to one bucket per mask. Buckets of up to ``small`` are compared inside a task. In a larger bucket
    each fingerprint is keyed by every choice of two bits outside of the mask, cleared, and is linked to the least one
    with the same key; that is exact, and it needs no pairs of a bucket.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the radius must be 0, 1 or 2")
    masks = covering_masks(radius)
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = stored(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    few = sizes.where(F.col("n") <= small).select("t", "key")
    lists = keyed.join(few, ["t", "key"]).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    edges = lists.mapInArrow(_link_small(radius), "a long, b long").distinct()
    many = sizes.where(F.col("n") > small).select("t", "key")
    if not many.isEmpty():
        edges = edges.unionByName(_link_large(keyed.join(many, ["t", "key"]), masks, radius))
    return edges


def _link_large(keyed: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Edges inside of large buckets (fp, t, key): fingerprints that agree but for ``radius`` bits outside of the mask."""
    choices = []
    for t, m in enumerate(masks):
        outside = [i for i in range(BITS) if not m >> i & 1]
        holes = [_signed(~sum(1 << i for i in c) & (2**64 - 1)) for c in combinations(outside, radius)]
        choices.append(F.when(F.col("t") == t, F.array(*map(F.lit, holes))))
    hot = keyed.select("fp", "t", F.posexplode(F.coalesce(*choices)).alias("c", "hole"))
    hot = hot.select("fp", "t", "c", F.col("fp").bitwiseAND(F.col("hole")).alias("cleared"))
    least = hot.groupBy("t", "c", "cleared").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("own"))
    return least.where(F.size("own") > 1).select("a", F.explode("own").alias("b")).where("a <> b").distinct()


def component_ids(own: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the rows (fp, least), one for each fp: a name and the least id of what ``edges`` (a, b) connect."""
    linked = stored(components(edges), "linked")
    # Stored, so that the join below has an exchange on either side, and adaptive execution can split a large component.
    group = stored(linked.join(own, linked["node"] == own["fp"]).groupBy("root").agg(F.min("least").alias("component_id")), "groups")
    of_linked = linked.join(group, "root").select(F.col("node").alias("fp"), "root", "component_id")
    alone = own.join(of_linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return of_linked.unionByName(alone)


def near_components(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, root, component_id) of the rows (doc_id, fp): the least doc_id reachable over fingerprints within ``radius`` bits.

    Rows are first brought to one per fingerprint, so groups of copies cost as much as one text.
    """
    own = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    return component_ids(own, near_links(own.select("fp"), radius))


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row.

    A text without words (null, empty, blank) has fingerprint zero and is linked like any other; one of fewer than
    ``width`` words is one shingle. Repeated rows stay, in one component. A row without id gets the least id of its
    component, null if there is none. An empty table gives no rows.
    """
    rows = stored(with_fingerprints(docs, ["doc_id"], width=width), "simhash")
    out = rows.join(stored(near_components(rows, radius), "components"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every component (see ``near_duplicates``) one row with the least doc_id stays.

    Rows without id go if their component has a row with one; else one of the component's rows stays. Texts without words (null,
    empty, blank) are linked like any others. Of rows that repeat the least id one stays. An empty table gives no rows.
    """
    names = docs.columns
    keep = [f"k{i}" for i in range(len(names))]
    own_id, text = keep[names.index("doc_id")], keep[names.index("text")]
    marked = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, keep, strict=True)]).withColumn("uid", F.xxhash64(*keep))
    rows = stored(with_fingerprints(marked, [own_id, "uid"], text, width).withColumnRenamed(own_id, "doc_id"), "simhash")
    linked = rows.join(stored(near_components(rows, radius), "components"), "fp").where("doc_id <=> component_id")
    copies = linked.groupBy("root", "doc_id", "uid").agg(F.count("*").alias("n"))
    first = stored(linked.groupBy("root").agg(F.min("uid").alias("uid")), "firsts")
    kept = stored(copies.join(first, ["root", "uid"]).drop("root"), "kept")
    several = not kept.where("n > 1").isEmpty()
    if fits_broadcast(docs.sparkSession, kept.count(), 3):
        kept = F.broadcast(kept)
    chosen = marked.join(kept, "uid").where(F.col("doc_id").eqNullSafe(F.col(own_id)))
    if several:
        chosen = chosen.where("n = 1").unionByName(chosen.where("n > 1").dropDuplicates(["doc_id", "uid"]))
    return chosen.select(*[F.col(k).alias(c) for c, k in zip(names, keep, strict=True)])
