"""One of each group of near-duplicates against brute force, and joins with a hub that adaptive execution splits."""

import numpy as np
import pytest
import xxhash

from factorloom.llm import graph, simhash
from factorloom.llm.common import stored
from factorloom.session import fresh_path, settings


def fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def variants():
    """Families of texts with a word changed in some, of several lengths; ids in no order of families."""
    r = np.random.default_rng(11)
    texts = []
    for size in (40, 90, 300, 900):
        base = [f"w{k}" for k in r.integers(0, 5000, size)]
        for changed in [0, 0, 1, 1, 1, 2, 2, 3, 8] * 3:
            own = list(base)
            for k in r.choice(size, changed, replace=False):
                own[k] = f"x{r.integers(10**6)}"
            texts.append(" ".join(own))
    texts += ["one two", "One  two", "one two three", "", None, " \n", *[" ".join(f"u{k}" for k in r.integers(0, 5000, 60)) for _ in range(20)]]
    return list(zip(r.permutation(len(texts)).tolist(), texts, strict=True))


def groups_of(rows):
    """Indices of rows in one component."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = root[a], root[b]
                root = [new if x == old else x for x in root]
    return [[i for i, x in enumerate(root) if x == g] for g in sorted(set(root))]


def test_one_of_each_equals_brute_force(spark):
    rows = variants()
    groups = groups_of(rows)
    assert max(map(len, groups)) > 5 and sum(len(g) > 1 for g in groups) > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in simhash.one_of_each(docs).collect()]
    assert sorted(kept) == sorted(min(rows[i] for i in g) if len({rows[i][0] for i in g}) == len(g) else None for g in groups)


@pytest.mark.parametrize("limit", ["1", "100000000"])
def test_one_of_each_with_repeats_and_nulls(spark, limit):
    a, b = "a b c d e f g", "something else altogether here"
    rows = [(7, a, None), (7, a, None), (None, a, "x"), (9, a, "y"), (None, b, None), (None, b, None), (3, None, "n"), (4, "", "n"), (7, "third text of id seven", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n string")
    with settings(spark, spark__factorloom__broadcastBytes=limit):
        kept = sorted((tuple(r) for r in simhash.one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(7, a, None), (None, b, None), (3, None, "n"), (7, "third text of id seven", None)], key=repr)


def test_a_hub_is_split(spark):
    """A star of 10^6 edges: the join that brings the least neighbour to a node's edges splits the hub's partition."""
    edges = stored(spark.range(1, 1_000_001).selectExpr("id AS a", "0L AS b"), "star")
    small = {
        "spark__sql__autoBroadcastJoinThreshold": "-1",
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": "1m",
        "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "1m",
        "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
    }
    with settings(spark, **small):
        step = graph._stars(edges, True, fresh_path(spark, "least"))
        assert step.count() == 1_000_000  # all hang on the least node already
        plan = step._jdf.queryExecution()
        plan.toRdd().count()
        assert "skew=true" in plan.executedPlan().toString()
