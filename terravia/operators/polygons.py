"""Polygons on the grid of a raster.

A polygon is a set of rings (poly, ring, vidx, x, y) in cells, x along the columns and y down the rows; the cell
(row, col) has its middle at (col + 0.5, row + 0.5). A cell belongs to a polygon if a line from its middle to
the left crosses the polygon's edges an odd number of times: rings inside rings are holes, the order of
their vertices does not matter, and of two polygons with a common edge a middle on it belongs to one. An edge crosses the rows whose middle
lies from its upper end, included, to its lower, excluded; level edges cross none. Rings are closed
on their own; of a ring of fewer than three vertices nothing is left.

Edges are dealt to the rows that they cross, crossings are ordered along each row of each polygon, and each odd one
begins a run of cells that the next one ends. So rows made are the crossings and the
cells that are filled, whatever the extent of the polygons, and only rows of the raster are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring_edges(rings: DataFrame) -> DataFrame:
    """poly, x, y, x1, y1: each vertex with the next one of its ring, the last with the first."""
    ring = Window.partitionBy("poly", "ring").orderBy("vidx")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)).alias(f"{c}1")
    finite = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))  # NaN is the largest
    return rings.where(finite).select("poly", "x", "y", after("x"), after("y"))


def crossings(rings: DataFrame, row0: int, row1: int) -> DataFrame:
    """poly, row, x: where edges cross the middles of the rows from row0 to row1, excluded."""
    edges = ring_edges(rings).where("y <> y1")
    top, bottom = F.least("y", "y1"), F.greatest("y", "y1")
    first = F.greatest(F.ceil(top - 0.5), F.lit(row0).cast("long"))
    last = F.least(F.ceil(bottom - 0.5) - 1, F.lit(row1 - 1).cast("long"))
    met = edges.withColumns({"first": first, "last": last}).where("first <= last").withColumn("row", F.explode(F.sequence("first", "last")))
    # from the upper end, so that an edge crosses at the same place whichever way it is drawn
    down = F.col("y") < F.col("y1")
    xa, ya, xb, yb = (F.when(down, F.col(a)).otherwise(F.col(b)) for a, b in (("x", "x1"), ("y", "y1"), ("x1", "x"), ("y1", "y")))
    return met.select("poly", "row", (xa + (F.col("row") + 0.5 - ya) * (xb - xa) / (yb - ya)).alias("x"))


def runs(rings: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """poly, row, first, last: the runs of cells of each polygon inside a raster, ends included."""
    along = Window.partitionBy("poly", "row").orderBy("x")
    paired = crossings(rings, row0, row1).select("poly", "row", "x", F.lead("x").over(along).alias("to"), F.row_number().over(along).alias("nth")).where("nth % 2 = 1")
    first = F.greatest(F.ceil(F.col("x") - 0.5), F.lit(col0).cast("long"))
    last = F.least(F.ceil(F.col("to") - 0.5) - 1, F.lit(col1 - 1).cast("long"))
    return paired.select("poly", "row", first.alias("first"), last.alias("last")).where("first <= last")


def covered_cells(rings: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """row, col: each cell of a raster that some polygon holds, once. Runs that overlap are one before they become cells."""
    along = Window.partitionBy("row").orderBy("first", "last")
    reach = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = runs(rings, row0, row1, col0, col1).select("row", "first", "last", reach.alias("reach"))
    own = fresh.select("row", F.greatest(F.col("first"), F.coalesce(F.col("reach") + 1, F.col("first"))).alias("first"), "last").where("first <= last")
    return own.select("row", F.explode(F.sequence("first", "last")).alias("col"))


def mask(cells: DataFrame, rings: DataFrame, into: str = "water") -> DataFrame:
    """cells with `into`: whether some polygon holds the cell."""
    low_r, high_r, low_c, high_c = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if low_r is None:
        return cells.withColumn(into, F.lit(False))
    held = covered_cells(rings, low_r, high_r + 1, low_c, high_c + 1).withColumn(into, F.lit(True))
    return cells.drop(into).join(held, ["row", "col"], "left").withColumn(into, F.coalesce(F.col(into), F.lit(False)))
