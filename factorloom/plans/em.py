"""Probabilistic PCA by expectation and maximization (Tipping & Bishop 1999).

A round reads the cells once. With ``M = C·Sx``, ``Sx = (CᵀC + ss·I)⁻¹``, ``X = Yc·M`` and ``P = YcᵀX`` (D×k, the
only result of the pass) the rest follows from k×k matrices:

    XᵀX  = MᵀP  = Sx·(CᵀP)
    W    = (XᵀX + N·ss·Sx)⁻¹,   C' = P·W
    tr(XᵀX' · C'ᵀC'),  Σ x·(C'ᵀy) = tr(Wᵀ·PᵀP)

so the variance needs no second pass, and latent rows are never kept on complete data.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cells import measure
from ..functions.exprs import names
from ..functions.gram import gram
from ..functions.hashing import digest, word
from ..functions.rowmath import change, multiply
from ..functions.small import inverse, symmetric
from ..operators.masks import masked_cells
from ..operators.missing import impute_missing, rounded
from ..operators.products import (
    factor_times_small,
    orthonormal_basis,
    project_rows,
    width_of,
)
from ..operators.starts import FIXED_VARIANCE, uniform_scalar
from ..operators.stats import centered_sq
from ..session import cut_lineage
from ..sinks.tables import RunStats, write_factor_round
from .layout import RowLayout
from .resume import SavedRound, last_round, save_round
from .sketch import (
    Profile,
    cap_components,
    mean_product,
    one_pass,
    profile_columns,
    sketch_step,
    start_state,
    warm_start,
)


@dataclass
class Small:
    """What a round needs beside its table, all of size k.

    The loadings are ``C = f·weights`` for the ``f_*`` columns of the table: products of D-sized tables with
    k×k matrices are put off and combined on the k×k side.
    """

    weights: np.ndarray
    gram: np.ndarray  # CᵀC
    shift: np.ndarray  # m·C
    variance: float
    norm2: float


@dataclass
class Round:
    """One finished round: ``table(col_id, m, f_* = of the old C, y_* = P)`` and the new small matrices."""

    table: DataFrame
    before: Small
    small: Small
    scores: DataFrame  # X - x̄, kept only while a round needs it

    @property
    def width(self) -> int:
        return self.small.gram.shape[0]

    def state(self) -> DataFrame:
        """``(col_id, m, f_*)`` for the next round."""
        return self.table.selectExpr(
            "col_id", "m", *[f"y_{j} AS f_{j}" for j in range(self.width)]
        )

    def change(self) -> float:
        """``max|C - C'| / (ε + max|C'|)``."""
        fs, ys = names("f", self.width), names("y", self.width)
        moved, size = change(self.table, fs, self.before.weights, ys, self.small.weights)
        return float(moved / (np.finfo(float).eps + size))


def em_step(
    layout: RowLayout,
    cells: DataFrame,
    state: DataFrame,
    small: Small,
    hold: bool = False,
) -> Round:
    """One round from ``state(col_id, m, f_*)``; ``hold`` keeps the scores."""
    n_rows, n_cols = layout.shape.n_rows, layout.shape.n_cols
    width = small.gram.shape[0]
    sx = inverse(symmetric(small.gram + small.variance * np.eye(width)))
    fs, ys = names("f", width), names("y", width)
    # The pass multiplies with M = C·Sx.
    passed, scores = one_pass(layout, cells, state, small.weights @ sx, small.shift @ sx, hold)
    full = gram(passed, [*fs, *ys, "m"])
    c_p = small.weights.T @ full[:width, width:-1]
    p_p, m_p = full[width:-1, width:-1], full[-1, width:-1]
    xtx = symmetric(sx @ c_p) + n_rows * small.variance * sx
    weights = inverse(symmetric(xtx))
    new_gram = symmetric(weights.T @ p_p @ weights)
    fitted = float(np.trace(weights.T @ p_p))
    spread = float(np.trace(xtx @ new_gram))
    variance = (small.norm2 + spread - 2.0 * fitted) / (float(n_rows) * n_cols)
    # Rounding may take an exact fit a little below zero; more than that is a wrong input.
    if variance * float(n_rows) * n_cols < -1e-6 * (small.norm2 + abs(spread)):
        raise ValueError(f"the variance came out as {variance}: the cells don't fit the sizes or norm given")
    after = Small(weights, new_gram, m_p @ weights, max(float(variance), 0.0), small.norm2)
    return Round(passed, small, after, scores)


def first_small(
    profile: Profile, state: DataFrame, width: int, variance: float, norm2: float | None = None
) -> Small:
    """``CᵀC``, ``m·C`` and, where it is not given, ``‖Yc‖²`` of the start, in one job over D rows."""
    columns = [*names("f", width), "m"]
    if norm2 is None:
        squares = f"{centered_sq(profile.shape.n_rows)} AS sq"
        state = state.join(profile.table.selectExpr("col_id", squares, "1D AS one"), "col_id")
        columns += ["sq", "one"]
    full = gram(state, columns)
    if norm2 is None:
        norm2 = float(full[-2, -1])
    return Small(np.eye(width), full[:width, :width], full[width, :width], variance, norm2)


class PPCA:
    """Estimator: ``PPCA(k).fit(cells)`` gives a ``PPCAModel``.

    k            number of components; D is lowered to D - 1 with a warning, more is refused
    max_iter     most rounds
    tol          stop when the change of the loadings falls below; None never stops early, a negative
                 value stands for 0.05
    seed         of the start matrix and of first fills
    start_dist   'normal', 'uniform' or 'fixed' start
    variance     start variance; by default drawn from the seed, or the fixed one with 'fixed'
    sketch       warm start by one randomized pass
    subsample    extra directions of the sketch
    handle_missing  impute masked cells; otherwise they count as zeros
    mean_over    'rows' or 'observed': what the first column means of a masked matrix divide by
    rounding     'none' or 'ceil' for imputed values
    write_basis  path for the orthonormal basis of each round
    state_path   path for the state after each round; a fit goes on from the last complete round that it finds there
    """

    def __init__(
        self,
        k: int,
        max_iter: int = 50,
        tol: float | None = None,
        seed: int | str = 0,
        start_dist: str = "normal",
        variance: float | None = None,
        sketch: bool = False,
        subsample: int = 10,
        handle_missing: bool = True,
        mean_over: str = "rows",
        rounding: str = "none",
        write_basis: str | None = None,
        state_path: str | None = None,
        partitions: int | None = None,
        hot_over: int | None = None,
    ):
        if max_iter < 1:
            raise ValueError("max_iter must be at least 1")
        if sketch and subsample < 1:
            raise ValueError("a sketch needs subsample >= 1")
        if mean_over not in ("rows", "observed"):
            raise ValueError("mean_over must be 'rows' or 'observed'")
        if rounding not in ("none", "ceil"):
            raise ValueError("rounding must be 'none' or 'ceil'")
        self.k = k
        self.max_iter = max_iter
        self.tol = 0.05 if tol is not None and tol < 0 else tol
        self.seed = seed
        self.start_dist = start_dist
        self.variance = variance
        self.sketch = sketch
        self.subsample = subsample
        self.handle_missing = handle_missing
        self.mean_over = mean_over
        self.rounding = rounding
        self.write_basis = write_basis
        self.state_path = state_path
        self.partitions = partitions
        self.hot_over = hot_over

    def _start_variance(self) -> float:
        if self.variance is not None:
            return self.variance
        return FIXED_VARIANCE if self.start_dist == "fixed" else uniform_scalar(self.seed)

    def fit(
        self,
        cells: DataFrame,
        mask: DataFrame | None = None,
        n_rows: int | None = None,
        n_cols: int | None = None,
        start: DataFrame | None = None,
        dataset: str = "",
    ) -> PPCAModel:
        """Fit to ``cells``; ``mask(row_id, col_id)`` lists missing cells.

        A coordinate may be stored once; repeats raise a ValueError (``dedupe_cells`` takes them out).
        ``n_rows`` and ``n_cols`` default to the largest ids plus 1; pass them when trailing rows or
        columns may be empty. Cells of columns beyond ``n_cols`` are left out, of rows beyond ``n_rows`` refused. ``start(col_id, c_*)`` replaces the seeded start matrix.
        """
        began = time.monotonic()
        stats = RunStats("ppca", dataset)
        if n_cols is not None:
            cells = cells.filter(F.col("col_id") < n_cols)
        missing, n_missing = None, 0
        if mask is None:
            profile = profile_columns(cells, n_rows, n_cols)
            shape = profile.shape
        else:
            # The means are over observed cells, so columns are profiled where the mask has been taken out.
            shape = measure(cells, n_rows, n_cols)
            mask = cut_lineage(mask.select("row_id", "col_id").distinct())
            if self.handle_missing:
                missing = masked_cells(mask, shape.n_rows, shape.n_cols)
                n_missing = missing.count()
        k = cap_components(self.k, shape.n_cols)
        if start is not None and width_of(start, "c") != k:
            raise ValueError(f"the start has {width_of(start, 'c')} columns for {k} components")
        width = k + self.subsample if self.sketch else k
        layout = RowLayout(
            cells, shape, width, extra=missing, extra_count=n_missing,
            partitions=self.partitions, hot_over=self.hot_over, mask=mask,
        )
        stats.n_rows, stats.n_cols, stats.n_components = shape.n_rows, shape.n_cols, k
        with layout:
            layout.refuse_repeats()
            if mask is not None:
                profile = profile_columns(layout.cells, shape.n_rows, shape.n_cols)
            if n_rows is not None and profile.top_row >= n_rows:
                raise ValueError(f"row {profile.top_row} lies outside of n_rows = {n_rows}")
            if n_missing:
                gaps = Gaps(layout, profile, missing, self)
                model = self._rounds(layout, gaps.profile, k, start, stats, began, gaps)
            else:
                model = self._rounds(layout, profile, k, start, stats, began, None)
        return model

    def _begin(self, layout, profile, k, start, stats, began, gaps) -> tuple[DataFrame, Small]:
        """The start of the first round."""
        norm2 = None if gaps is None else gaps.norm2()
        stats.prepare_sec = time.monotonic() - began
        variance = self._start_variance()
        if self.sketch:
            began = time.monotonic()
            wide = min(k + self.subsample, profile.shape.n_cols)
            base = start_state(profile, wide, self.seed, self.start_dist, None)
            cells = layout.cells if gaps is None else gaps.all_cells()
            found = sketch_step(layout, base, wide, mean_product(base, wide), cells)
            start, variance = warm_start(found, k, profile.shape.n_rows)
            stats.sketch_sec = time.monotonic() - began
        state = start_state(profile, k, self.seed, self.start_dist, start)
        return state, first_small(profile, state, k, variance, norm2)

    def _take_up(self, saved: SavedRound, profile, k, gaps) -> tuple[DataFrame, Small]:
        """What a saved round ended with."""
        if saved.width != k:
            raise ValueError(f"the saved fit has {saved.width} components, not {k}")
        if (saved.missing is None) != (gaps is None):
            raise ValueError("the saved fit and this one differ in whether cells are missing")
        n_cols = saved.state.count()
        if n_cols != profile.shape.n_cols:
            raise ValueError(f"the saved fit has {n_cols} columns, not {profile.shape.n_cols}")
        if gaps is not None:
            gaps.restore(saved.missing)
        return saved.state, Small(saved.weights, saved.gram, saved.shift, saved.variance, saved.norm2)

    def _rounds(self, layout, profile, k, start, stats, began, gaps) -> PPCAModel:
        saved = last_round(layout.spark, self.state_path) if self.state_path else None
        history: list[tuple[int, str, float]] = []
        if saved is not None:
            state, small = self._take_up(saved, profile, k, gaps)
            history = saved.history
            stats.errors += [value for _, metric, value in history if metric == "delta"]
            stats.prepare_sec = time.monotonic() - began
        else:
            state, small = self._begin(layout, profile, k, start, stats, began, gaps)
        first = 0 if saved is None else saved.round_no + 1
        if history and self.tol is not None and history[-1][2] < self.tol:
            first = self.max_iter  # it had ended
        for round_no in range(first, self.max_iter):
            began = time.monotonic()
            if gaps is None:
                done = em_step(layout, layout.cells, state, small)
                state, small = done.state(), done.small
            else:
                done, state, small = gaps.round(state, small)
            history.append((round_no, "variance", small.variance))
            delta = done.change()
            history.append((round_no, "delta", delta))
            if self.write_basis:
                basis = orthonormal_basis(_loadings(state, small), small.gram)
                write_factor_round(basis, self.write_basis, round_no)
            if self.state_path:
                save_round(self.state_path, round_no, state, None if gaps is None else gaps.values(), small, history)
            stats.round_sec.append(time.monotonic() - began)
            stats.errors.append(delta)
            if self.tol is not None and delta < self.tol:
                break
        return PPCAModel(
            factor=_loadings(state, small),
            mean=state.select("col_id", "m"),
            variance=small.variance,
            gram=small.gram,
            mean_product=small.shift,
            shape=profile.shape,
            history=history,
            stats=stats,
            missing=None if gaps is None else gaps.values(),
        )


def _loadings(state: DataFrame, small: Small) -> DataFrame:
    """``(col_id, c_*)``."""
    width = small.gram.shape[0]
    return multiply(state, ["col_id"], names("f", width), small.weights, names("c", width))


class Gaps:
    """The missing cells of a fit: their current values, and what they add to means and norms."""

    def __init__(self, layout: RowLayout, observed: Profile, missing: DataFrame, options: PPCA):
        self.layout = layout
        self.options = options
        shape = layout.shape
        lost = missing.groupBy("col_id").agg(F.count("*").alias("n_lost"))
        over = f"{max(shape.n_rows, 1)}D"
        if options.mean_over == "observed":
            over = f"nullif({over} - coalesce(n_lost, 0), 0D)"
        # First means, over all rows or over those where the column is not missing.
        self.columns = cut_lineage(
            observed.table.join(lost, "col_id", "left").selectExpr(
                "col_id", "n", "avg", "m2", "m AS m_rows", f"coalesce(n * avg / {over}, 0D) AS m_first"
            )
        )
        first = self.columns.selectExpr("col_id", "m_first")
        guess = F.pmod(word(digest(options.seed, "row_id", "col_id"), 0), F.lit(5)).cast("double")
        with layout.planning():
            filled = layout.with_factor(layout.place(missing), first).withColumn(
                "value", F.when(F.col("m_first") != 0, F.col("m_first")).otherwise(guess)
            )
            self._store(filled)
        self.profile = Profile(shape, self.table.select("col_id", "n", "avg", "m2", "m"))

    def _store(self, cells: DataFrame) -> None:
        """Keep the new values, and the column table with the means they give."""
        layout = self.layout
        kept = cut_lineage(cells.select(*layout.keys, "col_id", "value"))
        # Placed again like the observed cells, so that both go through a pass where they lie.
        self.cells = kept.repartition(layout.partitions, layout.keys[0])
        added = kept.groupBy("col_id").agg(
            F.count("*").alias("g_n"),
            F.avg("value").alias("g_avg"),
            (F.var_pop("value") * F.count("*")).alias("g_m2"),
        )
        n_rows = max(layout.shape.n_rows, 1)
        self.table = cut_lineage(
            self.columns.join(added, "col_id", "left")
            .na.fill({"g_n": 0, "g_avg": 0.0, "g_m2": 0.0})
            .withColumn("m", F.expr(f"m_rows + g_n * g_avg / {n_rows}D"))
        )

    def restore(self, values: DataFrame) -> None:
        """Take up the values of a saved round; they belong to the same missing cells."""
        with self.layout.planning():
            self._store(self.layout.place(values))

    def values(self) -> DataFrame:
        return self.cells.select("row_id", "col_id", "value")

    def all_cells(self) -> list[DataFrame]:
        """Observed and missing cells, each placed by the layout."""
        return [self.layout.cells, self.cells]

    def _squares(self) -> str:
        """SQL text: what a row of ``table`` adds to ``‖Yc‖²`` with the present values and means."""
        n_rows = self.layout.shape.n_rows
        return (
            "m2 + n * (avg - m) * (avg - m) + g_m2 + g_n * (g_avg - m) * (g_avg - m)"
            f" + ({int(n_rows)}D - n - g_n) * m * m"
        )

    def norm2(self) -> float:
        return float(self.table.selectExpr(f"coalesce(sum({self._squares()}), 0D)").first()[0])

    def round(self, state: DataFrame, small: Small) -> tuple[Round, DataFrame, Small]:
        """An EM round on all cells, then new values for the missing ones and new means."""
        layout = self.layout
        done = em_step(layout, self.all_cells(), state, small, hold=True)
        k = done.width
        new = multiply(
            done.table, ["col_id", "m"], names("y", k), done.small.weights, names("c", k)
        )
        terms = " + ".join(f"x_{j} * c_{j}" for j in range(k))
        value = rounded(F.expr(f"m + {terms}"), self.options.rounding)
        with layout.planning():
            located = layout.with_factor(self.cells, new).join(done.scores, layout.keys)
            self._store(located.select(*layout.keys, "col_id", value.alias("value")))
        layout.end_round()
        state = (
            done.state().drop("m").join(self.table.selectExpr("col_id", "m", f"{self._squares()} AS sq"), "col_id")
        )
        fs = names("f", k)
        sums = state.selectExpr(
            "coalesce(sum(sq), 0D)", *[f"coalesce(sum(m * {f}), 0D)" for f in fs]
        ).first()
        after = replace(
            done.small, shift=np.array(sums[1:]) @ done.small.weights, norm2=float(sums[0])
        )
        return done, state.select("col_id", "m", *fs), after


@dataclass
class PPCAModel:
    """Fitted loadings ``factor(col_id, c_*)``, ``mean(col_id, m)`` and noise variance."""

    factor: DataFrame
    mean: DataFrame
    variance: float
    gram: np.ndarray
    mean_product: np.ndarray
    shape: tuple
    history: list[tuple[int, str, float]] = field(default_factory=list)
    stats: RunStats | None = None
    missing: DataFrame | None = None

    @property
    def k(self) -> int:
        return self.gram.shape[0]

    def basis(self) -> DataFrame:
        """Orthonormal principal directions ``(col_id, c_*)``."""
        return orthonormal_basis(self.factor, self.gram)

    def history_frame(self) -> DataFrame:
        """``(round, metric, value)``."""
        return self.factor.sparkSession.createDataFrame(
            self.history, "round int, metric string, value double"
        )

    def transform(
        self,
        cells: DataFrame,
        n_components: int | None = None,
        center: bool = False,
        spine: DataFrame | None = None,
    ) -> DataFrame:
        """``Y·C`` (or ``(Y - m)·C``) of the first components, by ``row_id``.

        Missing cells take part with their imputed values when ``cells`` contains them:
        ``model.completed(observed)`` adds them.
        """
        k = self.k if n_components is None else n_components
        if not 1 <= k <= self.k:
            raise ValueError(f"n_components must be between 1 and {self.k}")
        factor = self.factor.select("col_id", *names("c", k))
        shift = self.mean_product[:k] if center else None
        return project_rows(cells, factor, self.shape.n_cols, spine, shift)

    def completed(self, observed: DataFrame) -> DataFrame:
        """Observed cells and the imputed values of the fit."""
        if self.missing is None:
            return observed
        return observed.select("row_id", "col_id", "value").unionByName(self.missing)

    def latent(self, cells: DataFrame, spine: DataFrame | None = None) -> DataFrame:
        """Posterior means ``(y - m)·C·Sx``."""
        sx = inverse(symmetric(self.gram + self.variance * np.eye(self.k)))
        moving = factor_times_small(self.factor, sx)
        return project_rows(cells, moving, self.shape.n_cols, spine, self.mean_product @ sx)

    def impute(self, cells: DataFrame, mask: DataFrame, rounding: str = "none") -> DataFrame:
        """Values at the coordinates of ``mask``, from the latent row of the given ``cells``."""
        spine = mask.select("row_id").distinct()
        scores = self.latent(cells, spine)
        return impute_missing(
            mask, scores, self.factor, self.mean, self.shape.n_cols, None, rounding
        )


__all__ = ["Gaps", "PPCA", "PPCAModel", "Round", "Small", "em_step", "first_small"]
