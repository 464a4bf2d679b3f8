"""Pairs of points of a series, as tiles of two blocks that a numpy kernel takes at once.

A series is cut into blocks of consecutive points, and every two of its blocks are a tile: one long series is spread over many tasks and no
task holds more than two blocks at a time. Where only pairs within a reach are wanted, a long series is cut into cells as wide as the
reach instead, dense cells into several blocks, and a tile is two blocks of the same or of neighbouring cells: pairs out of reach are
mostly never met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BLOCK = 1024
#: A cell is this much wider than the reach, and coordinates are at most so many reaches from 0, so that rounding loses no pair.
SLACK, FARTHEST = 1e-6, 1e9


def dimensions(points: DataFrame) -> list[str]:
    return sorted((c for c in points.columns if c[0] == "p" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def _packed(rows: DataFrame, keys: list[str], columns: list[str], carried: list[str] = ()) -> DataFrame:
    """One row a block: a struct ``_own`` of arrays, t and each coordinate, in time order."""
    keys = ["series_id", *keys]
    # a long series' blocks go to many tasks, also where its rows come in one
    out = rows.repartition(*keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", *columns))).alias("_own"), *(F.first(c).alias(c) for c in carried))
    return out.withColumn("_own", F.struct(*(F.col(f"_own.{c}").alias(c) for c in ("t", *columns))))


def _named(rows: DataFrame, columns: list[str], carried: list[str]) -> DataFrame:
    """The columns of a tile from its two blocks ``_a`` and ``_b``."""
    return rows.select("series_id", *carried, *(F.col(f"_{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("t", *columns)))


def _all_pairs(blocks: DataFrame, columns: list[str], carried: list[str]) -> DataFrame:
    """All tiles of series whose last block is ``_last``. Each block is dealt to the tiles that it is in."""
    dealt = blocks.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    tile = [F.least("_x", "_with").alias("_i"), F.greatest("_x", "_with").alias("_j")]
    dealt = dealt.select("series_id", *tile, "_x", "_own", *carried).repartition("series_id", "_i", "_j")
    both = dealt.groupBy("series_id", "_i", "_j").agg(F.sort_array(F.collect_list(F.struct("_x", "_own"))).alias("_both"), *(F.first(c).alias(c) for c in carried))
    first, second = F.get("_both._own", F.lit(0)), F.get("_both._own", F.lit(1))
    both = both.filter((F.col("_i") == F.col("_j")) | (F.size("_both") == 2))  # a stretch of a series may have no points
    return _named(both.select("series_id", *carried, first.alias("_a"), second.alias("_b")), columns, carried)


def _near_pairs(blocks: DataFrame, columns: list[str], carried: list[str], block: int, reach: str) -> DataFrame:
    """The tiles of neighbouring cells."""
    rows = blocks.select("series_id", *carried, F.inline(F.arrays_zip(*(F.col(f"_own.{c}").alias(c) for c in ("t", *columns)))))
    rows = rows.toDF("series_id", *carried, "t", *columns)
    grid = columns[:2]
    cells = [f"_c{j}" for j in range(len(grid))]
    rows = rows.withColumns({c: F.floor(F.col(p) / (F.col(reach) * (1 + SLACK))) for c, p in zip(cells, grid, strict=True)})
    dense = rows.groupBy("series_id", *cells).agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
    dense = dense.select("series_id", *cells, F.ceil(F.col("_n") / block).alias("_pieces"))
    rows = rows.join(dense, ["series_id", *cells], "left").withColumn("_x", F.pmod(F.xxhash64("t"), F.coalesce("_pieces", F.lit(1))))
    blocks = _packed(rows, [*cells, "_x"], columns, carried)
    # every two neighbouring cells once: the cell itself and those that come after it
    steps = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)] if len(grid) == 2 else [(0,), (1,)]
    step = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"s{j}") for j, v in enumerate(s))) for s in steps)))
    beside = [(F.col(c) + F.col(f"_s.s{j}")).alias(c) for j, c in enumerate(cells)]
    a = blocks.withColumn("_s", step).select("series_id", *beside, "_s", F.col("_x").alias("_xa"), *carried, F.col("_own").alias("_a"))
    b = blocks.select("series_id", *cells, F.col("_x").alias("_xb"), F.col("_own").alias("_b"))
    own = F.greatest(*(F.abs(f"_s.s{j}") for j in range(len(grid))), F.lit(0)) == 0
    found = a.join(b, ["series_id", *cells]).filter(~own | (F.col("_xa") <= F.col("_xb")))
    return _named(found.withColumn("_b", F.when(~own | (F.col("_xa") < F.col("_xb")), F.col("_b"))), columns, carried)


def tiles(points: DataFrame, limits: DataFrame | None = None, reach: str | None = None, block: int = BLOCK, longest: int | None = None) -> DataFrame:
    """Tiles (series_id, a_t, a_p0.., b_t, b_p0.., columns of ``limits``) of points (series_id, t, p0..); ``b`` is null where a block meets itself.

    Every pair of points of a series stands in exactly one tile, or with ``reach`` at least every pair that is not farther apart than that
    in any coordinate: ``reach`` names a column of ``limits`` (series_id, ...). Series without a row in ``limits`` are left out. Cells are
    only used for series of over ``block`` points that are over four reaches wide; others are cheaper whole.

    Points are packed into blocks by one shuffle; what follows moves a row a block. What is known of a whole series (its last block, its
    range) comes from a window over its blocks.
    """
    columns = dimensions(points)
    carried = [] if limits is None else [c for c in limits.columns if c != "series_id"]
    blocks = _packed(points.select("series_id", "t", *columns).withColumn("_x", F.floor(F.col("t") / block)), ["_x"], columns)
    series = Window.partitionBy("series_id")
    blocks = blocks.withColumn("_last", F.max("_x").over(series))
    if limits is not None:
        blocks = blocks.join(limits, "series_id")
    if reach is None or longest is not None and longest <= block:
        return _all_pairs(blocks, columns, carried)
    axes, r = columns[:2], F.col(reach)
    low, high = ([f(g(f"_own.{c}")).over(series) for c in axes] for f, g in ((F.min, F.array_min), (F.max, F.array_max)))
    far = F.greatest(*(F.greatest(-a, b) for a, b in zip(low, high, strict=True)), F.lit(0.0))
    wide = F.greatest(*(b - a for a, b in zip(low, high, strict=True)), F.lit(0.0))
    blocks = blocks.withColumns({"_n": F.sum(F.size("_own.t")).over(series), "_far": far, "_wide": wide})
    cut = (F.col("_n") > block) & (r > 0) & (r < float("inf")) & (F.col("_far") < r * FARTHEST) & (F.col("_wide") > 4 * r)
    blocks = blocks.withColumn("_cut", F.coalesce(cut, F.lit(False)))
    return _all_pairs(blocks.filter(~F.col("_cut")), columns, carried).unionByName(_near_pairs(blocks.filter("_cut"), columns, carried, block, reach))


def met(tile_rows: DataFrame) -> DataFrame:
    """(series_id, pairs): how many pairs of points the tiles of a series hold."""
    a, b = F.size("a_t").cast("long"), F.size("b_t").cast("long")
    return tile_rows.groupBy("series_id").agg(F.sum(F.when(F.col("b_t").isNull(), a * (a - 1) / 2).otherwise(a * b)).cast("long").alias("pairs"))


@dataclass
class Tile:
    """Two blocks: times and coordinates (a row each) of both, and the limits of their series."""

    ta: np.ndarray
    a: list[np.ndarray]
    tb: np.ndarray
    b: list[np.ndarray]
    same: bool
    limits: dict

    def gaps(self, j: int) -> np.ndarray:
        """Differences in coordinate j, without sign."""
        return np.abs(self.a[j][:, None] - self.b[j][None, :])

    def distances(self, metric: str, width: int | None = None) -> np.ndarray:
        """Distances by the first ``width`` coordinates, terms added in their order."""
        width = len(self.a) if width is None else width
        if metric not in ("chebyshev", "cityblock", "manhattan", "euclidean", "sqeuclidean"):
            raise ValueError(f"unknown metric {metric}")
        out = None
        for j in range(width):
            gap = self.gaps(j)
            if metric in ("euclidean", "sqeuclidean"):
                gap *= gap
            if out is None:
                out = gap
            elif metric == "chebyshev":
                np.maximum(out, gap, out=out)
            else:
                out += gap
        return np.sqrt(out) if metric == "euclidean" else out

    def once(self, theiler: int = 0) -> np.ndarray | slice:
        """Which pairs count: each once, and more than ``theiler`` apart in time."""
        if not self.same and not theiler:
            return np.s_[:, :]
        late = self.tb[None, :] - self.ta[:, None]
        return late > theiler if self.same else np.abs(late) > theiler


def check_metric(metric: str) -> None:
    if metric not in ("chebyshev", "cityblock", "manhattan", "euclidean", "sqeuclidean"):
        raise ValueError(f"unknown metric {metric}")


def _slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(column.values), np.asarray(column.offsets), ~np.asarray(column.is_null())


def each(tile_rows: DataFrame, kernel: Callable[[Tile], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """The rows that ``kernel`` makes of each tile: columns of one length by name, as in ``schema`` (without series_id, which comes first)."""
    columns = [c[2:] for c in tile_rows.columns if c.startswith("a_p")]
    limits = [c for c in tile_rows.columns if c != "series_id" and c[:2] not in ("a_", "b_")]
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = {c: _slices(batch.column(c)) for c in batch.schema.names if c[:2] in ("a_", "b_")}
            held = {c: (_slices(batch.column(c)) if pa.types.is_list(batch.schema.field(c).type) else batch.column(c).to_pylist()) for c in limits}
            cut = lambda c, i: side[c][0][side[c][1][i] : side[c][1][i + 1]]
            found, size = [], 0
            for i in range(batch.num_rows):
                ta, a = cut("a_t", i), [cut(f"a_{c}", i) for c in columns]
                same = not side["b_t"][2][i]
                tb, b = (ta, a) if same else (cut("b_t", i), [cut(f"b_{c}", i) for c in columns])
                own = {c: (v[0][v[1][i] : v[1][i + 1]] if isinstance(v, tuple) else v[i]) for c, v in held.items()}
                rows = kernel(Tile(ta, a, tb, b, same, own))
                found.append((i, [np.asarray(rows[n]) for n in names]))
                size += len(found[-1][1][0])
                if size > 1 << 20:  # results go on before they pile up
                    yield _rows(batch, found, names, types)
                    found, size = [], 0
            yield _rows(batch, found, names, types)

    kind = tile_rows.schema["series_id"].dataType.simpleString()
    return tile_rows.mapInArrow(one, f"series_id {kind}, {schema}")


def _rows(batch: pa.RecordBatch, found: list, names: list, types: list) -> pa.RecordBatch:
    """What the kernel made of some tiles, each row with the series of its tile."""
    tile = np.repeat([i for i, _ in found], [len(rows[0]) for _, rows in found]).astype(np.int64)
    columns = [pa.array(np.concatenate([rows[j] for _, rows in found]), kind) if found else pa.array([], kind) for j, kind in enumerate(types)]
    return pa.RecordBatch.from_arrays([batch.column("series_id").take(pa.array(tile)), *columns], names=["series_id", *names])
