"""Exact choices of cells: against plain sorting of digests, and how often the cells are read."""

import hashlib
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import masks


def plain(rows, percent, seed):
    """The cells of each stratum with the least digests, and the number that the percentage asks for."""
    out = set()
    for s in {r[0] for r in rows}:
        own = sorted((hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest(), i, j) for t, i, j, v in rows if t == s and v)
        out |= {(i, j) for _, i, j in own[: floor(len(own) * percent / 100)]}
    return out


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "part int, row_id long, col_id int, value double").repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    made = {(int(r.integers(0, 400)), int(r.integers(0, 60))) for _ in range(9000)}
    return [(i % 5 if i < 380 else 9, i, j, float((i + j) % 7)) for i, j in sorted(made)]


@pytest.mark.parametrize("percent", [0, 0.01, 3, 50, 99.5, 100])
@pytest.mark.parametrize(("aside", "at_once"), [(512, 100_000), (0, 0), (16**4, 1)])
def test_masks_equal_sorted_digests(spark, rows, percent, aside, at_once, monkeypatch):
    monkeypatch.setattr(masks, "_ASIDE", aside)
    monkeypatch.setattr(masks, "_SORT_AT_ONCE", at_once)
    cells = cells_of(spark, rows)
    assert {tuple(r) for r in masks.mask_cells(cells, percent, 7, "part").collect()} == plain(rows, percent, 7)
    alone = [(0, *r[1:]) for r in rows]
    assert {tuple(r) for r in masks.mask_cells(cells, percent, 7).collect()} == plain(alone, percent, 7)


def test_large_matrix_is_read_twice(spark):
    """Digests near the quota's end are kept aside while cells are counted, so only the choice reads the cells again."""
    n = 200_000
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    cells = spark.range(n).selectExpr("id AS row_id", "cast(id % 11 AS int) AS col_id", "1D AS value").mapInArrow(count, "row_id long, col_id int, value double")
    assert masks.mask_cells(cells, 10, 42).count() == n // 10
    assert read.value == 2 * n


def test_repeated_coordinates_share_a_digest(spark):
    cells = spark.range(5000).selectExpr("id % 40 AS row_id", "3 AS col_id", "1D AS value")
    found = masks.mask_cells(cells, 50, 1).groupBy("row_id").agg(F.count("*").alias("n")).collect()
    assert len(found) == 20 and {r["n"] for r in found} == {125}
