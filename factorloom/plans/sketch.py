"""Randomized subspace iteration on the centred matrix ``Yc = Y - m``.

One pass over the cells gives ``P = Ycᵀ(Yc·F)`` for a D×s table ``F``. Everything else is s×s:
``ZᵀZ = Fᵀ·P`` for ``Z = Yc·F``, and with ``T`` making ``Z·T`` orthonormal, ``B = (P·T)ᵀ`` has the Gram matrix
``Tᵀ(PᵀP)T``. No table of N or D rows reaches the driver.
"""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cells import Shape, col_spine
from ..functions.exprs import names
from ..functions.gram import gram
from ..functions.rowmath import multiply
from ..functions.small import eigen_desc, inverse_sqrt, whitener
from ..operators.products import orient, width_of
from ..operators.starts import random_factor
from ..operators.stats import centered_sq, column_profile
from ..session import cut_lineage
from ..sinks.tables import RunStats
from .layout import RowLayout


@dataclass
class Profile:
    """The matrix as seen by columns: ``table(col_id, n, avg, m2, m)`` on all columns."""

    shape: Shape
    table: DataFrame
    top_row: int = -1


def profile_columns(
    cells: DataFrame, n_rows: int | None = None, n_cols: int | None = None
) -> Profile:
    """One pass over the cells: sizes, column means and second moments."""
    spark = cells.sparkSession
    stored = cut_lineage(column_profile(cells))
    top = stored.agg(F.max("top_row"), F.max("col_id"), F.sum("n")).first()
    n_rows = n_rows if n_rows is not None else (top[0] if top[0] is not None else -1) + 1
    n_cols = n_cols if n_cols is not None else (top[1] if top[1] is not None else -1) + 1
    table = (
        col_spine(spark, n_cols)
        .join(stored, "col_id", "left")
        .selectExpr(
            "col_id",
            "coalesce(n, 0L) AS n",
            "coalesce(avg, 0D) AS avg",
            "coalesce(m2, 0D) AS m2",
            f"coalesce(total, 0D) / {max(int(n_rows), 1)}D AS m",
        )
    )
    return Profile(Shape(n_rows, n_cols, top[2] or 0), table, top[0] if top[0] is not None else -1)


@dataclass
class Sketch:
    """Singular values and right vectors of the sketched matrix.

    ``state`` holds ``(col_id, m, f_*, y_*)`` of the last pass; ``transform`` is ``T``.
    """

    state: DataFrame
    transform: np.ndarray
    values: np.ndarray
    rotation: np.ndarray
    width: int
    next_shift: np.ndarray  # m·P·T

    def right_vectors(self, k: int) -> DataFrame:
        """``(col_id, c_0 …)``: the first ``k`` right singular vectors."""
        scale = self.transform @ self.rotation[:, :k] * inverse_sqrt(self.values**2)[:k]
        ys = names("y", self.width)
        return orient(multiply(self.state, ["col_id"], ys, scale, names("c", k)))


def one_pass(
    layout: RowLayout,
    cells: DataFrame,
    state: DataFrame,
    weights: np.ndarray,
    shift: np.ndarray,
    hold: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``state(col_id, m, f_*, …)`` with ``y_* = Ycᵀ(Yc·f·weights)`` added, its lineage cut; and the scores.

    ``shift`` is ``m·f·weights``. The scores are kept for later use in the round only with ``hold``.
    """
    inner, width = weights.shape
    fs, ys = names("f", width), names("y", width)
    if inner == width and np.array_equal(weights, np.eye(width)):
        factor = state.select("col_id", *fs)
    else:
        factor = multiply(state, ["col_id"], names("f", inner), weights, fs)
    with layout.planning():
        scores = layout.scores(cells, factor, width, shift, hold)
        crossed = layout.cross(cells, scores, width)
        result = cut_lineage(state.join(crossed, "col_id", "left").na.fill(0.0, ys))
    if not hold:
        layout.end_round()
    return result, scores


def sketch_step(
    layout: RowLayout,
    state: DataFrame,
    width: int,
    shift: np.ndarray,
    cells: DataFrame | None = None,
) -> Sketch:
    """One iteration from ``state(col_id, m, f_*)``; ``shift`` is ``m·F``."""
    cells = layout.cells if cells is None else cells
    passed, _ = one_pass(layout, cells, state, np.eye(width), shift)
    fs, ys = names("f", width), names("y", width)
    full = gram(passed, [*fs, *ys, "m"])
    transform = whitener(full[:width, width:-1])
    squares, rotation = eigen_desc(transform.T @ full[width:-1, width:-1] @ transform)
    next_shift = full[-1, width:-1] @ transform
    return Sketch(passed, transform, np.sqrt(squares), rotation, width, next_shift)


def next_start(sketch: Sketch) -> DataFrame:
    """``Bᵀ`` as the next ``F``."""
    ys, fs = names("y", sketch.width), names("f", sketch.width)
    return multiply(sketch.state, ["col_id", "m"], ys, sketch.transform, fs)


def mean_product(state: DataFrame, width: int) -> np.ndarray:
    """``m·F``, a vector of ``width`` numbers."""
    row = state.selectExpr(
        *[f"coalesce(sum(m * {f}), 0D) AS {f}" for f in names("f", width)]
    ).first()
    return np.array(list(row), dtype=float)


def start_state(
    profile: Profile, width: int, seed: int | str, dist: str, start: DataFrame | None
) -> DataFrame:
    """``(col_id, m, f_*)`` from a given D×s table ``(col_id, c_*)`` or from the seed."""
    if start is None:
        return random_factor(profile.table, width, seed, dist, "f", ("col_id", "m"))
    if width_of(start, "c") != width:
        raise ValueError(f"the start must have {width} columns")
    picked = start.select("col_id", *[F.col(f"c_{j}").alias(f"f_{j}") for j in range(width)])
    return (
        profile.table.select("col_id", "m")
        .join(picked, "col_id", "left")
        .na.fill(0.0, names("f", width))
    )


@dataclass
class Iterated:
    """Result of an iteration: the value, its history and seconds by round, and whether it settled."""

    value: float
    history: list[float]
    converged: bool
    round_sec: list[float]
    prepare_sec: float = 0.0

    def run_stats(self, app: str, shape: Shape, k: int, dataset: str = "") -> RunStats:
        return RunStats(
            app, dataset, shape.n_rows, shape.n_cols, k,
            prepare_sec=self.prepare_sec, round_sec=self.round_sec, errors=self.history,
        )


def _iterate(rounds: int, precision: int, step, prepare_sec: float = 0.0) -> Iterated:
    """Repeat ``step`` until its value, rounded to ``precision`` decimals, comes twice."""
    history: list[float] = []
    seconds: list[float] = []
    for _ in range(rounds):
        began = time.monotonic()
        value = round(step(), precision)
        seconds.append(time.monotonic() - began)
        repeated = bool(history) and history[-1] == value
        history.append(value)
        if repeated:
            return Iterated(value, history, True, seconds, prepare_sec)
    return Iterated(history[-1], history, False, seconds, prepare_sec)


def kth_singular_value(
    cells: DataFrame,
    k: int,
    subsample: int = 10,
    q: int = 10,
    precision: int = 6,
    n_rows: int | None = None,
    n_cols: int | None = None,
    seed: int | str = 0,
    dist: str = "normal",
    start: DataFrame | None = None,
    layout: RowLayout | None = None,
    profile: Profile | None = None,
) -> Iterated:
    """The ``k``-th singular value of the centred matrix, by at most ``q`` passes."""
    began = time.monotonic()
    profile = profile or profile_columns(cells, n_rows, n_cols)
    if not 1 <= k <= profile.shape.n_cols:
        raise ValueError(f"k must be between 1 and {profile.shape.n_cols}")
    width = min(k + subsample, profile.shape.n_cols)
    if q < 1:
        raise ValueError("q must be at least 1")
    own = layout is None
    layout = layout or RowLayout(cells, profile.shape, width)
    state = start_state(profile, width, seed, dist, start)
    held = {"state": state, "shift": mean_product(state, width)}

    def step() -> float:
        sketch = sketch_step(layout, held["state"], width, held["shift"])
        held["state"], held["shift"] = next_start(sketch), sketch.next_shift
        return float(sketch.values[k - 1])

    try:
        return _iterate(q, precision, step, time.monotonic() - began)
    finally:
        if own:
            layout.close()


def residual_spectral_norm(
    cells: DataFrame,
    basis: DataFrame,
    subsample: int = 10,
    q: int = 50,
    precision: int = 6,
    n_rows: int | None = None,
    n_cols: int | None = None,
    seed: int | str = 0,
    dist: str = "normal",
    start: DataFrame | None = None,
    layout: RowLayout | None = None,
    profile: Profile | None = None,
) -> Iterated:
    """Largest singular value of ``Yc(I - VVᵀ)`` for an orthonormal ``basis(col_id, c_*)``.

    ``I - VVᵀ`` is applied to the D×s side only: to the start before a pass and to the result after it.
    """
    began = time.monotonic()
    profile = profile or profile_columns(cells, n_rows, n_cols)
    width = min(1 + subsample, profile.shape.n_cols)
    if q < 1:
        raise ValueError("q must be at least 1")
    own = layout is None
    k = width_of(basis, "c")
    layout = layout or RowLayout(cells, profile.shape, max(width, k))
    vs, fs, ys = names("v", k), names("f", width), names("y", width)
    directions = basis.select("col_id", *[F.col(f"c_{j}").alias(v) for j, v in enumerate(vs)])
    state = cut_lineage(
        start_state(profile, width, seed, dist, start)
        .join(directions, "col_id", "left")
        .na.fill(0.0, vs)
    )
    held = {"state": state, "full": gram(state, [*vs, *fs, "m"]), "weights": np.eye(width)}

    def step() -> float:
        # With F = f·weights the pass runs on F - V(VᵀF) = [f v]·[weights; -VᵀF].
        full, weights = held["full"], held["weights"]
        v_f = full[:k, k : k + width] @ weights
        both = np.vstack([weights, -v_f])
        clean = multiply(held["state"], ["col_id", "m", *vs], [*fs, *vs], both, fs)
        shift = full[-1, [*range(k, k + width), *range(k)]] @ both
        passed, _ = one_pass(layout, layout.cells, clean, np.eye(width), shift)
        full = gram(passed, [*vs, *fs, *ys, "m"])
        at_y = k + width
        transform = whitener(full[k:at_y, at_y:-1])
        # B is P·T without its part in V; VᵀV is taken as it is.
        v_y = full[:k, at_y:-1] @ transform
        squares = transform.T @ full[at_y:-1, at_y:-1] @ transform
        squares = squares - 2.0 * v_y.T @ v_y + v_y.T @ full[:k, :k] @ v_y
        held["state"] = passed.selectExpr(
            "col_id", "m", *vs, *[f"{y} AS {f}" for y, f in zip(ys, fs)]
        )
        pick = [*range(k), *range(at_y, at_y + width + 1)]
        held["full"], held["weights"] = full[np.ix_(pick, pick)], transform
        return float(np.sqrt(eigen_desc(squares)[0][0]))

    try:
        return _iterate(q, precision, step, time.monotonic() - began)
    finally:
        if own:
            layout.close()


@dataclass
class ReconError:
    error: float
    residual: Iterated
    sigma: float
    prepare_sec: float = 0.0

    def run_stats(self, shape: Shape, k: int, dataset: str = "") -> RunStats:
        """Rounds of the residual norm; what came before them, the singular value too, is preparation."""
        run = self.residual.run_stats("recon_error", shape, k, dataset)
        run.prepare_sec += self.prepare_sec
        return run


def recon_error(
    cells: DataFrame,
    basis: DataFrame,
    sigma_next: float | None = None,
    subsample: int = 10,
    q: int = 50,
    precision: int = 6,
    n_rows: int | None = None,
    n_cols: int | None = None,
    seed: int | str = 0,
    dist: str = "normal",
) -> ReconError:
    """``(‖Yc - Yc·V·Vᵀ‖₂ - σ_{k+1}) / σ_{k+1}``: how far the basis is from the best one of its size.

    Where ``σ_{k+1}`` is 0 (the matrix has rank k, or the basis all columns) the error is 0 for a residual of 0 and
    infinite otherwise. Both count as 0 below 1e-7 of the largest singular value.
    """
    began = time.monotonic()
    k = width_of(basis, "c")
    profile = profile_columns(cells, n_rows, n_cols)
    with RowLayout(cells, profile.shape, max(k + 1 + subsample, 1 + subsample)) as layout:
        common = dict(
            subsample=subsample, q=q, precision=precision, seed=seed, dist=dist,
            layout=layout, profile=profile,
        )
        if sigma_next is None:
            sigma_next = kth_singular_value(cells, k + 1, **common).value if k < profile.shape.n_cols else 0.0
        prepare = time.monotonic() - began
        residual = residual_spectral_norm(cells, basis, **common)
        nothing = 1e-7 * total_norm(profile) ** 0.5
    if sigma_next <= nothing:
        return ReconError(0.0 if residual.value <= nothing else float("inf"), residual, sigma_next, prepare)
    return ReconError((residual.value - sigma_next) / sigma_next, residual, sigma_next, prepare)


def total_norm(profile: Profile) -> float:
    """``‖Yc‖²_F`` from the column profile."""
    return float(
        profile.table.selectExpr(f"coalesce(sum({centered_sq(profile.shape.n_rows)}), 0D)").first()[0]
    )


def cap_components(k: int, n_cols: int) -> int:
    """``k`` components of a model; all columns are lowered to one less with a warning, more are refused."""
    if k < 1:
        raise ValueError("at least one component is needed")
    if k > max(n_cols, 1):
        raise ValueError(f"{k} components are more than the {n_cols} columns")
    if k == n_cols and k > 1:
        warnings.warn(f"{k} components of {n_cols} columns: {k - 1} are fitted", stacklevel=3)
        return k - 1
    return k


def warm_start(sketch: Sketch, k: int, n_rows: int) -> tuple[DataFrame, float]:
    """Loadings ``V_k·√(λ - ss)`` and variance ``ss``, the mean ``λ`` of the extra directions."""
    if sketch.width <= k:
        raise ValueError("a warm start needs subsample >= 1")
    latent = sketch.values**2 / max(n_rows - 1, 1)
    variance = float(latent[k:].mean())
    scale = np.sqrt(np.maximum(latent[:k] - variance, 0.0))
    vectors = sketch.right_vectors(k)
    cs = names("c", k)
    return multiply(vectors, ["col_id"], cs, np.diag(scale), cs), variance
