"""Box-counting multifractals of two-dimensional measures field(field_id, y, x, mass)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEAR_ONE = 1e-8 + 1e-5


def checked(field: DataFrame) -> DataFrame:
    """``field`` whose evaluation fails at a mass that is negative, null or not finite."""
    m = F.col("mass").cast("double")
    bad = m.isNull() | F.isnan(m) | (m < 0) | (m == float("inf"))
    return field.withColumn("mass", F.when(bad, F.raise_error(F.lit("masses must be finite and not negative"))).otherwise(m))


def default_boxes(side: int) -> list[int]:
    """Powers of two from 2 to half of a field's shorter side."""
    return [1 << k for k in range(1, max(1, side).bit_length()) if 2 << k <= side]


def default_exponents() -> list[float]:
    """-8 to 8 by quarters."""
    return [k / 4 for k in range(-32, 33)]


def _finest(boxes: list[int]) -> dict[int, list[int]]:
    """The box sizes by the finest over 1 that divides them."""
    out: dict[int, list[int]] = {}
    for b in boxes:
        out.setdefault(min((a for a in boxes if 1 < a <= b and b % a == 0), default=1), []).append(b)
    return out


def moments(field: DataFrame, box_sizes: list[int] | None = None, q_values: list[float] | None = None) -> DataFrame:
    """(field_id, box, q, ln_scale, log_z, alpha_num, f_num): log moments of box masses, incomplete edge boxes and empty boxes left out.

    Masses of coarse boxes are summed from those of the finest ones that divide them, so that cells are read and moved for those only.
    Without ``box_sizes`` each field takes the powers of two from 2 to half its shorter side; without ``q_values`` those from
    -8 to 8 by quarters. Masses that are negative or not finite are an error.
    """
    shape = field.groupBy("field_id").agg((F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"))
    side = F.least("ny", "nx")
    own = box_sizes is None
    boxes = default_boxes(shape.agg(F.max(side)).first()[0] or 0) if own else sorted({int(b) for b in box_sizes if b > 0})
    qs = default_exponents() if q_values is None else sorted({float(q) for q in q_values if math.isfinite(q)})
    if len(boxes) < 2 or not qs:
        raise ValueError("two box sizes and an exponent are needed")
    cells = checked(field).join(shape, "field_id").select("field_id", "ny", "nx", F.col("y").alias("by"), F.col("x").alias("bx"), F.col("mass").alias("m"))
    place = lambda size: (F.floor(F.col("by") / size), F.floor(F.col("bx") / size))
    mass = None
    for finest, group in _finest(boxes).items():
        by, bx = place(F.lit(finest))
        fine = cells.groupBy("field_id", "ny", "nx", by.alias("by"), bx.alias("bx")).agg(F.sum("m").alias("m")).filter("m > 0")
        coarse = fine.withColumn("box", F.explode(F.array(*map(F.lit, group))))
        by, bx = place(F.col("box") / finest)
        whole = ((by + 1) * F.col("box") <= F.col("ny")) & ((bx + 1) * F.col("box") <= F.col("nx"))
        whole = whole & (2 * F.col("box") <= side) if own else whole
        part = coarse.filter(whole).groupBy("field_id", "box", by.alias("by"), bx.alias("bx")).agg(F.sum("m").alias("m"))
        mass = part if mass is None else mass.unionByName(part)
    used = mass.groupBy("field_id", "box").agg(F.sum("m").alias("used"))
    p = mass.join(used, ["field_id", "box"]).select("field_id", "box", F.log(F.col("m") / F.col("used")).alias("lp"))
    terms = p.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    # sums of p^q relative to its largest term, so that high exponents don't underflow
    top = terms.groupBy("field_id", "box", "q").agg(F.max(F.col("q") * F.col("lp")).alias("top"))
    w = F.exp(F.col("q") * F.col("lp") - F.col("top"))
    sums = terms.join(top, ["field_id", "box", "q"]).groupBy("field_id", "box", "q", "top").agg(
        F.sum(w).alias("z"), F.sum(w * F.col("lp")).alias("wl"), F.sum(F.exp("lp") * F.col("lp")).alias("shannon")
    )
    log_z = F.col("top") + F.log("z")
    alpha = F.col("wl") / F.col("z")
    return sums.select("field_id", "box", "q", F.log(F.col("box").cast("double")).alias("ln_scale"), log_z.alias("log_z"), alpha.alias("alpha_num"), (F.col("q") * alpha - log_z).alias("f_num"), "shannon")


def spectrum(field: DataFrame, box_sizes: list[int] | None = None, q_values: list[float] | None = None) -> DataFrame:
    """(field_id, q, tau, d_q, alpha, f_alpha, r2): slopes over ln box size; D_q by the entropy at q = 1."""
    return fits(moments(field, box_sizes, q_values)).drop("r2_tau")


def fits(m: DataFrame) -> DataFrame:
    """The spectrum of ``moments``, with r2_tau, the fit of the log moments themselves."""
    at_one = F.abs(F.col("q") - 1) <= NEAR_ONE
    y = F.when(at_one, F.col("shannon")).otherwise(F.col("log_z"))
    found = m.groupBy("field_id", "q").agg(
        F.regr_slope("log_z", "ln_scale").alias("tau"),
        F.regr_slope(y, F.col("ln_scale")).alias("slope"),
        F.regr_slope("alpha_num", "ln_scale").alias("alpha"),
        F.regr_slope("f_num", "ln_scale").alias("f_alpha"),
        F.regr_r2(y, F.col("ln_scale")).alias("r2"),
        F.regr_r2("log_z", "ln_scale").alias("r2_tau"),
    )
    d_q = F.when(at_one, F.col("slope")).otherwise(F.try_divide("slope", F.col("q") - 1))
    return found.select("field_id", "q", "tau", d_q.alias("d_q"), "alpha", "f_alpha", F.coalesce("r2", F.lit(1.0)).alias("r2"), F.coalesce("r2_tau", F.lit(1.0)).alias("r2_tau"))


def local_multifractality(field: DataFrame, tile: int | tuple[int, int], box_sizes: list[int] | None = None, q_values: list[float] | None = None) -> DataFrame:
    """(field_id, ty, tx, phi, delta, mean, r2_tau) of each whole tile, of ``tile`` cells a side or (rows, columns): the spread D_0 - D_2, the
    range and the mean of its masses, and the median fit of the log moments over ``q_values``.

    Cells without a row have no mass. Tiles without any have no phi and no fit (NaN). Without ``box_sizes``: the powers of two from 2 to
    half the shorter side of a tile.
    """
    rows, columns = (tile, tile) if isinstance(tile, int) else tile
    if rows < 1 or columns < 1:
        raise ValueError("a tile has one row and column at least")
    boxes = default_boxes(min(rows, columns)) if box_sizes is None else box_sizes
    qs = default_exponents() if q_values is None else [float(q) for q in q_values]
    shape = field.groupBy("field_id").agg((F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"))
    ty, tx = F.floor(F.col("y") / rows), F.floor(F.col("x") / columns)
    cells = checked(field).join(shape, "field_id").filter(((ty + 1) * rows <= F.col("ny")) & ((tx + 1) * columns <= F.col("nx")))
    key = F.concat_ws("\x1f", F.col("field_id").cast("string"), ty.cast("string"), tx.cast("string"))
    own = cells.select(key.alias("key"), "field_id", ty.alias("ty"), tx.alias("tx"), (F.col("y") % rows).alias("y"), (F.col("x") % columns).alias("x"), "mass")
    least = F.when(F.count("*") < rows * columns, F.least(F.min("mass"), F.lit(0.0))).otherwise(F.min("mass"))
    corner = own.groupBy("key", "field_id", "ty", "tx").agg(F.sum("mass").alias("total"), (F.greatest(F.max("mass"), least) - least).alias("delta"), (F.sum("mass") / (rows * columns)).alias("mean"))
    # every tile keeps its full shape, whichever cells have mass
    padded = own.select(F.col("key").alias("field_id"), "y", "x", "mass").unionByName(
        corner.select(F.col("key").alias("field_id"), F.lit(rows - 1).cast("long").alias("y"), F.lit(columns - 1).cast("long").alias("x"), F.lit(0.0).alias("mass"))
    )
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("d_q")))
    middle = F.percentile(F.when(F.col("q").isin(qs), F.col("r2_tau")), 0.5)
    d = fits(moments(padded, boxes, [*qs, 0.0, 2.0])).groupBy("field_id").agg((at(0.0) - at(2.0)).alias("phi"), middle.alias("r2_tau"))
    out = corner.join(d.withColumnRenamed("field_id", "key"), "key", "left")
    nan = F.lit(float("nan"))
    return out.select("field_id", "ty", "tx", F.coalesce("phi", nan).alias("phi"), "delta", "mean", F.coalesce("r2_tau", nan).alias("r2_tau"))


def tile_scaling(tiles: DataFrame) -> DataFrame:
    """(field_id, n, slope, intercept, r2): phi of ``local_multifractality`` against the logarithm of the tiles' range, by least squares over
    the n tiles that have both; fewer than three give no line."""
    good = ~F.isnan("phi") & (F.col("delta") > 0)
    x, y = F.when(good, F.log("delta")), F.when(good, F.col("phi"))
    fit = tiles.groupBy("field_id").agg(F.count(y).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    return fit.select("field_id", "n", *(F.when(F.col("n") >= 3, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")))


def gridded(points: DataFrame, x: str, y: str, bins: int, key: str = "field_id") -> DataFrame:
    """(key, y, x, mass): points counted on a bins x bins grid of their own range; a constant axis counts as 0.5 of it."""
    whole = Window.partitionBy(key)
    unit = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(whole), F.max(c).over(whole) - F.min(c).over(whole)), F.lit(0.5))
    cell = lambda c: F.least(F.floor(unit(c) * bins), F.lit(bins - 1)).cast("long")
    return points.select(key, cell(y).alias("y"), cell(x).alias("x")).groupBy(key, "y", "x").agg(F.count("*").cast("double").alias("mass"))
