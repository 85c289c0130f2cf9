"""A quality classifier: regularised quadratic discriminant over statistics of a text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, sigmoid, slices, stored, utf8

LOGGED = ["n_words", "word_chars", "longest", "n_lines", "words_a_line"]
SHARES = [
    "distinct",
    "distinct_pairs",
    "top_word",
    "same_next",
    "same_line",
    "upper",
    "digit",
    "symbol",
    "mark",
    "other_bytes",
    "short",
]
NAMES = LOGGED + SHARES
SHARE_FLOOR = 0.005
LEARNED = "features array<double>"


def _bytes_in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


UPPER, DIGIT = _bytes_in(bytes(range(65, 91))), _bytes_in(bytes(range(48, 58)))
MARK = _bytes_in(b".,;:!?'\"-()")
SYMBOL = _bytes_in(bytes(range(33, 127))) & ~_bytes_in(bytes(range(65, 91)) + bytes(range(97, 123))) & ~DIGIT & ~MARK
OTHER = _bytes_in(bytes(range(128, 256)))
INK = ~_bytes_in(bytes([9, 10, 11, 12, 13, 32]))


def statistics(text: bytes | None) -> np.ndarray:
    """The transformed statistics of a whole text: logs of sizes, log odds of shares. A text without words has zero sizes and shares."""
    text = text or b""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    ink = max(1, int(counts[INK].sum()))
    often = Counter(words)
    sizes = np.fromiter(map(len, often), np.int64, len(often))
    times = np.fromiter(often.values(), np.int64, len(often))
    some = max(1, n)
    pairs = len(set(zip(words, words[1:], strict=False))) if n > 1 else 0
    logged = [n, ink / some, sizes.max(initial=0), len(lines), n / max(1, len(lines))]
    shares = [
        len(often) / some,
        pairs / max(1, n - 1),
        times.max(initial=0) / some,
        sum(map(eq, words, words[1:])) / some,
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0,
        *(counts[x].sum() / ink for x in (UPPER, DIGIT, SYMBOL, MARK, OTHER)),
        times[sizes <= 3].sum() / some,
    ]
    p = np.array(shares, float)
    return np.concatenate([np.log1p(np.array(logged, float)), np.log((p + SHARE_FLOOR) / (1 - p + SHARE_FLOOR))])


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of ``keep`` and ``features``."""
    names = [f"k{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "t")

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            rows = [statistics(x) for x in utf8(batch.column("t"))]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES)
            features = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], features], [*names, "features"])

    out = narrow.mapInArrow(run, f"{schema}, {LEARNED}")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "features")


@dataclass
class Discriminant:
    """Class means and cached Cholesky factors; ``prior`` is log P(1) - log P(0)."""

    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse lower factors
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """P(class 1), from the difference of Mahalanobis log densities; 0.5 where a class was never seen."""
        if not self.factors:
            return np.full(len(x), 0.5)
        logs = []
        for mean, inverse in zip(self.means, self.factors, strict=True):
            z = (x - mean) @ inverse.T
            logs.append(np.log(np.diag(inverse)).sum() - 0.5 * (z * z).sum(1))
        return sigmoid(logs[1] - logs[0] + self.prior)


def fit(labelled: DataFrame, label: str, shrink: float = 0.1, towards_pooled: float = 0.05) -> Discriminant:
    """Fit to all labelled rows by one aggregation: counts, sums and sums of products for each class.

    A class covariance is mixed with the covariance of both (``towards_pooled``) and then with its own diagonal
    (``shrink``). Rows whose label is not 0 or 1 are left out.
    """
    d = len(NAMES)
    x = [F.element_at("features", i + 1) for i in range(d)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    rows = labelled.where(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"), *sums, *products)
    found = {r["y"]: r for r in rows.collect()}
    if len(found) < 2:
        return Discriminant([], [], 0.0)
    means, covariances, sizes = [], [], []
    for y in (0, 1):
        r = found[y]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        means.append(mean)
        covariances.append(second - np.outer(mean, mean))
        sizes.append(r["n"])
    pooled = sum(n * c for n, c in zip(sizes, covariances, strict=True)) / sum(sizes)
    factors = []
    for c in covariances:
        c = (1 - towards_pooled) * c + towards_pooled * pooled
        c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + 1e-6 * np.eye(d)
        factors.append(np.linalg.inv(np.linalg.cholesky(c)))
    return Discriminant(means, factors, float(np.log(sizes[1] / sizes[0])))


def scored(features: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and ``score``."""
    names = [f"k{i}" for i in range(len(keep))]
    narrow = features.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], F.col("features").alias("x"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "x")

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], pa.array(model.scores(x))], [*names, "score"])

    out = narrow.mapInArrow(run, f"{schema}, score double")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "score")


def classify(docs: DataFrame, labels: DataFrame, label: str, learn, keep: list[str] | None = None) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), learning from the rows where ``learn`` holds and a label is known.

    Statistics are worked out once and stored. Null and empty texts count as texts without words. Repeated rows are each
    scored, and each learned from. With fewer than two classes of labels every score is 0.5.
    """
    keep = ["doc_id"] if keep is None else keep
    features = stored(with_statistics(docs, keep), "quality-statistics")
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y")).where("_y is not null")
    model = fit(features.where(learn).join(known, features["doc_id"] == known["_id"]), "_y")
    return scored(features, model, keep)
