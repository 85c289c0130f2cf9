"""Cells laid out once for many rounds over the same matrix.

Cells of one row share a partition, sorted by row, so the products of a round need no exchange of
cells: ``Y·M`` groups rows where they lie, and ``Yᵀ(Y·M)`` joins the result back in place. Per round
only the per-column partial sums travel.

Three things keep this true at any size:

* a factor that is small enough (its row count is known) is sent to all executors; a larger one is
  *routed*: each tile lists the columns it uses once, and a round sends each tile only those factor rows;
* routed tiles are cut both ways, into row blocks × column blocks. A column is used by one tile of each row block, a row by
  one of each column block, so a round moves at most ``row blocks × columns`` factor rows and column sums, and ``column
  blocks × rows`` partial scores there and back. ``column_blocks`` takes the cut that moves least: about √tiles blocks
  either way where rows and columns are as many, one column block where rows are far more;
* rows with more than ``hot_over`` cells are spread over several tiles; their partial scores are
  added up in a table of at most ``cells / hot_over`` rows and sent back;
* the layout is persisted in memory and on disk, and a lost executor's part is rebuilt from its source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cells import Shape, measure
from ..functions.exprs import names, sums_of_products, with_numbers
from ..operators.joins import HOT_CELLS, hot_keys

Cells = DataFrame | Sequence[DataFrame]
from ..session import broadcast_limit, cut_lineage, fits_broadcast, settings

CELL_BYTES = 32
PARTITION_BYTES = 256 * 1024 * 1024
TILES_PER_PARTITION = 8


def partition_count(df: DataFrame, nnz: int) -> int:
    wanted = -(-nnz * CELL_BYTES // PARTITION_BYTES)
    return max(df.sparkSession.sparkContext.defaultParallelism, wanted)


def column_blocks(tiles: int, shape: Shape) -> int:
    """Into how many column blocks ``tiles`` are cut, so that a round moves the fewest rows.

    With ``b`` column blocks there are ``tiles / b`` row blocks: at most ``tiles / b · D`` factor rows and as many column sums travel
    (never more than cells), and, unless b is 1, ``b · N`` partial scores there and back.
    """
    def moved(b: int) -> float:
        return 2 * min(shape.nnz, tiles // b * shape.n_cols) + (2 * min(shape.nnz, b * shape.n_rows) if b > 1 else 0)

    return min((1 << e for e in range(max(1, tiles).bit_length())), key=moved)


def tables(cells: Cells) -> list[DataFrame]:
    return [cells] if isinstance(cells, DataFrame) else list(cells)


class RowLayout:
    """Persisted cells, placed by row, for factors of up to ``width`` components; without those that ``mask`` lists."""

    def __init__(
        self,
        cells: DataFrame,
        shape: Shape,
        width: int,
        extra: DataFrame | None = None,
        extra_count: int = 0,
        partitions: int | None = None,
        hot_over: int | None = None,
        blocks: int | None = None,
        mask: DataFrame | None = None,
    ):
        self.spark = cells.sparkSession
        self.shape = shape
        self.partitions = partitions or partition_count(cells, shape.nnz + extra_count)
        self.routed = not fits_broadcast(self.spark, shape.n_cols, width)
        self.tiles = self.partitions * TILES_PER_PARTITION
        wanted = Shape(shape.n_rows, shape.n_cols, shape.nnz + extra_count)
        self.blocks = (blocks or column_blocks(self.tiles, wanted)) if self.routed else 1
        self.hot = self._hot_rows(cells, extra, width, shape.nnz + extra_count, hot_over)
        self.tiled = self.routed or self.hot is not None
        self.keys = ["tile", "row_id"] if self.tiled else ["row_id"]
        placed = self.place(cells.selectExpr("row_id", "col_id", "coalesce(value, 0D) AS value"))
        if mask is not None:
            # Masked coordinates are placed alike, so taking them out moves no cell again. (An anti-join would be pushed below the placing.)
            hidden = self.place(mask.selectExpr("row_id", "cast(col_id AS int) AS col_id", "0D AS value"))
            hidden = hidden.withColumn("_hidden", F.lit(True)).drop("value")
            placed = placed.join(hidden, [*self.keys, "col_id"], "left").filter(F.col("_hidden").isNull()).select(*placed.columns)
        with settings(self.spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
            self.cells = placed.sortWithinPartitions(*self.keys).persist(StorageLevel.MEMORY_AND_DISK)
        self._extra = extra
        self._routes: DataFrame | None = None
        self._held: list[DataFrame] = []

    def _hot_rows(self, cells, extra, width, nnz, hot_over) -> DataFrame | None:
        """``(row_id, spread)`` of rows to be split, or None where no row can be that long.

        The bound grows with the matrix so that the scores of all hot rows stay below the
        broadcast limit.
        """
        over = hot_over or max(HOT_CELLS, -(-nnz * 16 * (width + 2) // broadcast_limit(self.spark)))
        if nnz <= over or self.shape.n_cols <= over:  # a row stores a column once
            return None
        ids = cells.select("row_id")
        if extra is not None:
            ids = ids.union(extra.select("row_id"))
        return hot_keys(ids, "row_id", over)

    def place(self, cells: DataFrame) -> DataFrame:
        """Partition a cell table the way the layout is partitioned."""
        if not self.tiled:
            return cells.repartition(self.partitions, "row_id")
        rows = max(1, self.tiles // self.blocks)
        tile = f"pmod(xxhash64(row_id), {rows})"
        if self.hot is not None:
            # A hot row takes ``spread`` row blocks in turn, by column.
            cells = cells.join(F.broadcast(self.hot), "row_id", "left")
            tile = f"pmod({tile} + coalesce(pmod(xxhash64(col_id), spread), 0), {rows})"
        if self.blocks > 1:
            tile = f"{tile} * {self.blocks} + pmod(hash(col_id), {self.blocks})"
        return cells.selectExpr(
            "row_id", "col_id", "value", f"cast({tile} AS int) AS tile"
        ).repartition(self.partitions, "tile")

    def with_factor(self, cells: DataFrame, factor: DataFrame) -> DataFrame:
        """``cells`` of this layout joined with a per-column table, cells staying where they are."""
        if not self.routed:
            return cells.join(F.broadcast(factor), "col_id")
        sent = self.routes.join(factor, "col_id").repartition(self.partitions, "tile")
        return cells.join(sent, ["tile", "col_id"])

    def refuse_repeats(self) -> None:
        """Raise where a coordinate is stored twice; cells of a row lie together, so that moves nothing."""
        twice = self.cells.groupBy(*self.keys, "col_id").agg(F.count("*").alias("n")).filter("n > 1").head()
        if twice is not None:
            raise ValueError(f"cell ({twice['row_id']}, {twice['col_id']}) is stored {twice['n']} times")

    @property
    def routes(self) -> DataFrame:
        """Which columns each tile uses, missing cells included; found once."""
        if self._routes is None:
            used = self.cells.select("tile", "col_id")
            if self._extra is not None:
                used = used.unionByName(self.place(self._extra).select("tile", "col_id"))
            self._routes = used.distinct().persist(StorageLevel.MEMORY_AND_DISK)
        return self._routes

    def scores(
        self,
        cells: Cells,
        factor: DataFrame,
        width: int,
        shift: Sequence[float],
        hold: bool = False,
    ) -> DataFrame:
        """``(keys, x_0 …)``: centred scores ``y·f - shift`` of rows with cells, in place.

        ``cells`` may be several tables placed by this layout. Each goes through the pass alone, and the scores of
        a row are added up where they lie; a union of the tables would lose their placing.
        """
        xs = names("x", width)
        # Without nulls the generated code is short enough to be compiled for wide factors.
        factor = factor.selectExpr("col_id", *[f"coalesce({f}, 0D) AS {f}" for f in names("f", width)])
        sums = sums_of_products("value", names("f", width), xs)
        first, *others = tables(cells)
        part = self.with_factor(first, factor).groupBy(*self.keys).agg(*map(F.expr, sums))
        for other in others:
            more = self.with_factor(other, factor).groupBy(*self.keys).agg(*map(F.expr, sums))
            more = more.select(*self.keys, *[F.col(x).alias(f"more_{x}") for x in xs])
            part = part.join(more, self.keys, "full").selectExpr(
                *self.keys, *[f"coalesce({x}, 0D) + coalesce(more_{x}, 0D) AS {x}" for x in xs]
            )
        moved = [f"coalesce({x}, 0D) - _s[{j}] AS {x}" for j, x in enumerate(xs)]
        if self.blocks > 1:
            # A row lies in one tile of each column block: its parts are added up, and the sums go back to these tiles.
            total = part.groupBy("row_id").agg(F.collect_list("tile").alias("tiles"), *[F.sum(x).alias(x) for x in xs])
            part = total.select(F.explode("tiles").alias("tile"), "row_id", *xs).repartition(self.partitions, "tile")
        elif self.hot is not None:
            part = self._keep(part)
            total = (
                part.join(F.broadcast(self.hot), "row_id", "left_semi")
                .groupBy("row_id")
                .agg(*[F.sum(x).alias(f"t{x}") for x in xs])
            )
            part = part.join(F.broadcast(total), "row_id", "left")
            moved = [f"coalesce(t{x}, {x}, 0D) - _s[{j}] AS {x}" for j, x in enumerate(xs)]
        centered = with_numbers(part, "_s", shift).selectExpr(*self.keys, *moved)
        return self._keep(centered) if hold else centered

    def cross(self, cells: Cells, scores: DataFrame, width: int) -> DataFrame:
        """``(col_id, y_0 …)``: ``Σ v·x`` by column, summed inside each task first, for each table of cells."""
        ys = names("y", width)
        sums = sums_of_products("value", names("x", width), ys)
        found = [c.join(scores, self.keys).groupBy("col_id").agg(*map(F.expr, sums)) for c in tables(cells)]
        if len(found) == 1:
            return found[0]
        total = found[0]
        for other in found[1:]:
            total = total.unionByName(other)
        return total.groupBy("col_id").agg(*[F.sum(y).alias(y) for y in ys])

    def planning(self):
        """Settings for plans over this layout.

        Partial sums from all its partitions meet in as many partitions (adaptive execution merges
        small ones). Tables placed by tile count as placed for joins on the tile and another key.
        """
        present = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = {"spark__sql__shuffle__partitions": str(max(present, self.partitions))}
        if self.tiled:
            wanted["spark__sql__requireAllClusterKeysForCoPartition"] = "false"
        return settings(self.spark, **wanted)

    def _keep(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._held.append(df)
        return df

    def end_round(self) -> None:
        """Give up what only the last round used."""
        for df in self._held:
            df.unpersist()
        self._held.clear()

    def close(self) -> None:
        self.end_round()
        if self._routes is not None:
            self._routes.unpersist()
            self._routes = None
        self.cells.unpersist()

    def __enter__(self) -> RowLayout:
        return self

    def __exit__(self, *_exc) -> None:
        self.close()


def routed_scores(cells: DataFrame, factor: DataFrame, width: int, n_cols: int) -> DataFrame:
    """``(row_id, x_0 …)``: ``y·f`` for one factor ``(col_id, f_*)`` that is too large for a broadcast; worked out now.

    The cells are placed by row once. Each tile lists its columns, the factor rows that it uses travel to it, and scores are
    added up in place.
    """
    with RowLayout(cells, measure(cells, None, n_cols), width, blocks=1) as layout, layout.planning():
        scores = layout.scores(layout.cells, factor, width, [0.0] * width).drop("tile")
        if layout.hot is not None:
            scores = scores.dropDuplicates(["row_id"])  # a hot row has its sums in each of its tiles
        return cut_lineage(scores)
