"""A toxicity classifier from weak supervision: voters, a label model of them, and a linear classifier on its labels."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, sigmoid, slices, stored, summed, utf8

#: Lexicon voters: so many groups of words, and of beginnings of words, are found in the labelled rows.
WORD_VOTERS, PREFIX_VOTERS = 24, 12
TERMS_A_VOTER = 16
PREFIXES = (4, 5)
LEAST_DOCS, LEAST_LOG_ODDS = 4, 3.0
#: Words of abuse that make a voter of their own, whatever the labels say.
ABUSE = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns".split()
PATTERNS = ["abuse", "loud_marks", "capitals"]
N_VOTERS = WORD_VOTERS + PREFIX_VOTERS + len(PATTERNS)
#: Inputs of the linear classifier: each voter, hits by number and by share, and a constant.
N_INPUTS = N_VOTERS + 3
_STRIP = b".,;:!?\"'()[]|*#$%&-_"


def terms(text: bytes | None) -> set[bytes]:
    """Distinct lower-cased words without outer punctuation."""
    out = {w.strip(_STRIP) for w in set((text or b"").lower().split())}
    out.discard(b"")
    return out


def prefixes(words: set[bytes]) -> set[bytes]:
    """Beginnings of 4 and 5 characters of longer words, marked by a star."""
    out = set()
    for w in words:
        s = w.decode("utf-8", "replace")
        out.update(s[:k].encode() + b"*" for k in PREFIXES if len(s) > k)
    return out


def term_counts(labelled: DataFrame, text: str, label: str, flush: int = 150_000) -> DataFrame:
    """In how many labelled texts of either class each term stands; summed in tasks first."""

    def run(batches: Batches) -> Batches:
        def out() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            rows = [pa.array(keys, pa.binary()), *[pa.array([s[k] for k in keys], pa.int64()) for s in seen]]
            return pa.RecordBatch.from_arrays(rows, ["term", "n0", "n1"])

        seen = (Counter(), Counter())
        for batch in slices(batches):
            for t, y in zip(utf8(batch.column("t")), batch.column("y").to_pylist(), strict=True):
                found = terms(t)
                seen[y].update(found)
                seen[y].update(prefixes(found))
                if len(seen[0]) + len(seen[1]) > flush:
                    yield out()
                    seen = (Counter(), Counter())
        yield out()

    narrow = labelled.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"))
    return narrow.mapInArrow(run, "term binary, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def mine_lexicon(labelled: DataFrame, text: str, label: str) -> list[list[bytes]]:
    """The terms most bound to class 1, dealt in order of weight to the voters. At most 16 for each of 36 voters."""
    sizes = {r["y"]: r["n"] for r in labelled.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return [[] for _ in range(WORD_VOTERS + PREFIX_VOTERS)]
    odds = F.log((F.col("n1") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("n0") + 0.5) / (sizes[0] + 1.0))
    found = stored(
        term_counts(labelled, text, label).where(F.col("n1") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS), "toxic-terms"
    )
    is_prefix = F.expr("right(cast(term as string), 1) = '*'")
    out: list[list[bytes]] = []
    for part, voters in ((~is_prefix, WORD_VOTERS), (is_prefix, PREFIX_VOTERS)):
        top = found.where(part).orderBy(F.desc(F.col("odds") * F.log1p("n1")), "term").limit(voters * TERMS_A_VOTER).collect()
        own = [bytes(r["term"]) for r in top]
        out += [own[k * TERMS_A_VOTER : (k + 1) * TERMS_A_VOTER] for k in range(voters)]
    return out


@dataclass
class Voters:
    """Which voters fire for a text; ``lexicon`` has the terms of each."""

    lexicon: list[list[bytes]]
    of: dict[bytes, int] = field(init=False)

    def __post_init__(self):
        self.of = {t: k for k, own in enumerate(self.lexicon) for t in own}
        self.abuse = {w.encode() for w in ABUSE}

    def votes(self, text: bytes | None) -> tuple[np.ndarray, float, float]:
        """Votes, the number of terms hit, and their share in the text."""
        text = text or b""
        fired = np.zeros(N_VOTERS, bool)
        words = terms(text)
        hit = self.of.keys() & words | self.of.keys() & prefixes(words)
        for t in hit:
            fired[self.of[t]] = True
        base = WORD_VOTERS + PREFIX_VOTERS
        abuse = words & self.abuse
        fired[base] = bool(abuse)
        fired[base + 1] = text.count(b"!!") > 2
        capitals = text.translate(None, _NOT_CAPITAL)
        fired[base + 2] = 2 * len(capitals) > len(text)
        hits = len(hit | abuse)
        return fired, float(hits), hits / (len(words) + 20.0)


_NOT_CAPITAL = bytes(set(range(256)) - set(range(65, 91)))


@dataclass
class LabelModel:
    """P(voter fires | class), weights against counting correlated voters twice, and the share of class 1."""

    rates: np.ndarray  # 2 x voters
    weights: np.ndarray
    share: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        r = np.clip(self.rates, 1e-4, 1 - 1e-4)
        yes, no = np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0]))
        logit = np.log(self.share / (1 - self.share)) + (votes * yes + ~votes * no) @ self.weights
        return sigmoid(logit)


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes, inputs of the classifier, and labels (-1: none)."""
    x = batch.column("inputs").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, N_INPUTS)
    return x[:, :N_VOTERS] > 0, x, batch.column("y").to_numpy(zero_copy_only=False)


def fit_label_model(votes: DataFrame, rounds: int = 4, unlabelled: float = 0.1) -> LabelModel:
    """Expectation and maximization over all rows of ``votes``; where a label is known it takes the posterior's place,
    and rows without one weigh ``unlabelled``.

    A round sums, over the whole table and for each class, how often each voter and each pair of voters fires. Pairs give
    the correlations within a class; a voter's evidence is divided by one plus its positive correlations with others.
    """
    j = N_VOTERS
    model = LabelModel(np.vstack([np.full(j, 0.02), np.full(j, 0.3)]), np.ones(j), 0.1)
    for _ in range(rounds):

        def part(batch: pa.RecordBatch, model=model) -> np.ndarray:
            v, _, y = _unpack(batch)
            p = np.where(y >= 0, y, model.posterior(v))
            w = np.stack([1 - p, p]) * np.where(y >= 0, 1.0, unlabelled)
            v = v.astype(float)
            return np.concatenate([w.sum(1), *[((v * k[:, None]).T @ v).ravel() for k in w]])

        total = summed(votes, 2 + 2 * j * j, part)
        sizes = total[:2]
        pairs = total[2:].reshape(2, j, j)
        rates = (np.einsum("cii->ci", pairs) + 0.02) / (sizes[:, None] + 0.5)
        weights = np.ones(j)
        overlap = np.zeros((j, j))
        for c in (0, 1):
            n = sizes[c] + 1e-9
            m = np.diag(pairs[c]) / n
            spread = np.sqrt(np.maximum(m * (1 - m), 1e-9))
            overlap = np.maximum(overlap, (pairs[c] / n - np.outer(m, m)) / np.outer(spread, spread))
        np.fill_diagonal(overlap, 0)
        weights = 1 / (1 + np.clip(np.where(overlap > 0.2, overlap, 0), 0, 1).sum(1))
        model = LabelModel(rates, weights, float(np.clip(sizes[1] / max(sizes.sum(), 1), 0.001, 0.999)))
    return model


def fit_linear(votes: DataFrame, labels: LabelModel, rounds: int = 8, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression on the posterior labels of all rows, by Newton's steps over sums of the whole table."""
    d = N_INPUTS
    w = np.zeros(d)
    for _ in range(rounds):

        def part(batch: pa.RecordBatch, w=w) -> np.ndarray:
            v, x, _ = _unpack(batch)
            target, p = labels.posterior(v), sigmoid(x @ w)
            return np.concatenate([x.T @ (target - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel(), [len(x)]])

        total = summed(votes, d + d * d + 1, part)
        if not total[-1]:
            break
        pull = ridge * total[-1] / 100 + 1.0
        step = np.linalg.solve(total[d:-1].reshape(d, d) + pull * np.eye(d), total[:d] - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    return w


def cast_votes(docs: DataFrame, voters: Voters, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of ``keep`` and ``inputs``: votes as 0 and 1, then numbers of hits and a constant."""
    names = [f"k{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "t")

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            x = np.zeros((batch.num_rows, N_INPUTS), np.float32)
            for row, t in zip(x, utf8(batch.column("t")), strict=True):
                row[:N_VOTERS], hits, share = voters.votes(t)
                row[N_VOTERS:] = np.log1p(hits), 10 * share, 1
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * N_INPUTS
            inputs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], inputs], [*names, "inputs"])

    out = narrow.mapInArrow(run, f"{schema}, inputs array<float>")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "inputs")


def for_terms(doc_id: str):
    """Whether a labelled row is one of the two thirds from which terms are taken."""
    return F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(3)) < 2


def classify(docs: DataFrame, labels: DataFrame, label: str, learn, keep: list[str] | None = None, most_labelled: int = 40_000) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text): the columns of ``keep`` and ``score``.

    Lexicons come from two thirds of the labelled rows where ``learn`` holds (by a hash of the id), and from
    ``most_labelled`` of them at most, those with the least hashes. The label model and
    the classifier take all other rows where ``learn`` holds, so that a term met by chance is found out. Null and empty texts get the score of a text without hits. Repeated rows are each scored and each
    learned from. Without labels of both classes the lexicons are empty and only the fixed voters speak.
    """
    keep = ["doc_id"] if keep is None else keep
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_y in (0, 1)")
    mined = known.withColumnRenamed("_id", "doc_id").where(learn).where(for_terms("doc_id"))
    mined = mined.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most_labelled).withColumnRenamed("doc_id", "_id")
    # At most ``most_labelled`` ids and labels are broadcast, so that no text is moved.
    labelled = docs.join(F.broadcast(mined), docs["doc_id"] == mined["_id"]).select(F.col("text").alias("_t"), "_y")
    voters = Voters(mine_lexicon(labelled, "_t", "_y"))
    votes = stored(cast_votes(docs, voters, keep), "toxic-votes")
    own = known.groupBy("_id").agg(F.avg("_y").alias("_y"))
    learned = votes.where(learn).join(known.where(for_terms("_id")), F.col("doc_id") == F.col("_id"), "left_anti")
    train = stored(learned.join(own, learned["doc_id"] == own["_id"], "left").select("inputs", F.coalesce("_y", F.lit(-1.0)).alias("y")), "toxic-train")
    model = fit_label_model(train)
    weights = fit_linear(train, model)
    names = [f"k{i}" for i in range(len(keep))]
    narrow = votes.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)], "inputs", F.lit(-1.0).alias("y"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name not in ("inputs", "y"))

    def run(batches: Batches) -> Batches:
        for batch in slices(batches):
            score = sigmoid(_unpack(batch)[1] @ weights)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in names], pa.array(score)], [*names, "score"])

    out = narrow.mapInArrow(run, f"{schema}, score double")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "score")
