"""Small matrices as NumPy arrays and as cells."""

import numpy as np

# The 7 × 5 sample matrix; its last column is empty.
SAMPLE = np.array(
    [
        [0, 1, 0, 1, 0],
        [1, 1, 0, 1, 0],
        [0, 0, 1, 1, 0],
        [1, 0, 1, 1, 0],
        [0, 1, 0, 1, 0],
        [1, 1, 0, 1, 0],
        [0, 0, 1, 1, 0],
    ],
    dtype=float,
)


def low_rank(n=60, d=9, k=3, noise=0.3, seed=5, density=0.6, offset=2.0):
    rng = np.random.default_rng(seed)
    dense = rng.normal(size=(n, k)) @ rng.normal(size=(k, d)) * 3 + noise * rng.normal(size=(n, d)) + offset
    return np.where(rng.random((n, d)) < density, dense, 0.0)


def to_cells(spark, dense):
    rows, cols = np.nonzero(dense)
    data = [(int(r), int(c), float(dense[r, c])) for r, c in zip(rows, cols)]
    return spark.createDataFrame(data, "row_id long, col_id int, value double")


def to_array(df, n_rows, n_cols):
    dense = np.zeros((n_rows, n_cols))
    for row in df.select("row_id", "col_id", "value").collect():
        dense[row[0], row[1]] = row[2]
    return dense


def factor_array(df, prefix="c"):
    columns = sorted((c for c in df.columns if c.startswith(prefix + "_")), key=lambda c: int(c[2:]))
    rows = sorted(df.select("col_id", *columns).collect())
    return np.array([list(r)[1:] for r in rows])


def factor_frame(spark, dense, prefix="c"):
    rows = [(j, *map(float, dense[j])) for j in range(dense.shape[0])]
    names = ", ".join(f"{prefix}_{j} double" for j in range(dense.shape[1]))
    return spark.createDataFrame(rows, f"col_id int, {names}")
