"""A grid for joins of points and boxes, in which crowded cells are split.

Everyone's home is one cell of any fixed grid. Here points are counted in small cells, the counts are added up level by level, and
a cell with over `most` points is cut in four, down to DEPTH times. What of a point's cells is crowded tells at which level it is
placed; a box is laid over the same cells. Points that cannot be told apart by place (one spot with over `most` of them)
are dealt over several copies of their last cell, and boxes are sent to each. So both sides meet by an equality join on cells
that hold `most` points at most.

The crowded cells are all that both sides need to know, and of each level there are no more than points / most:
with most = points / CELLS, at the least LEAST, they are a table of bounded size, which is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravia.shared import kept

DEPTH, CELLS, LEAST = 10, 4096, 1000
KEY = ["level", "cx", "cy", "copy"]


def _cell(c: Column, cell_m: float, level: int) -> Column:
    return F.floor(c / (cell_m / (1 << level))).cast("long")


@dataclass(frozen=True)
class SplitGrid:
    """crowded: level, cx, cy, n; levels: how many levels have any."""

    cell_m: float
    most: int
    levels: int
    crowded: DataFrame

    def _split(self, level: int) -> DataFrame:
        found = self.crowded.where(F.col("level") == level).select(F.col("cx").alias("s_cx"), F.col("cy").alias("s_cy"), F.col("n").alias("s_n"))
        return F.broadcast(found)

    def place(self, points: DataFrame) -> DataFrame:
        """points (x, y) with level, cx, cy, copy of the cell that each is in."""
        out = points.withColumns({"level": F.lit(0), "cx": _cell(F.col("x"), self.cell_m, 0), "cy": _cell(F.col("y"), self.cell_m, 0), "copy": F.lit(0).cast("long")})
        for k in range(self.levels):
            met = out.join(self._split(k), (F.col("level") == k) & (F.col("cx") == F.col("s_cx")) & (F.col("cy") == F.col("s_cy")), "left")
            deeper = F.col("s_n").isNotNull()
            if k == DEPTH:
                copies = F.ceil(F.col("s_n") / self.most)
                out = met.withColumn("copy", F.when(deeper, F.pmod(F.monotonically_increasing_id(), copies)).otherwise(F.col("copy")))
            else:
                # all at once: a cell's two numbers change together
                out = met.withColumns({"level": F.when(deeper, k + 1).otherwise(F.col("level")), "cx": F.when(deeper, _cell(F.col("x"), self.cell_m, k + 1)).otherwise(F.col("cx")), "cy": F.when(deeper, _cell(F.col("y"), self.cell_m, k + 1)).otherwise(F.col("cy"))})
            out = out.drop("s_cx", "s_cy", "s_n")
        return out

    def cover(self, boxes: DataFrame) -> DataFrame:
        """boxes (min_x, min_y, max_x, max_y) once for each cell that they reach into."""
        span = lambda a, b: F.explode(F.sequence(_cell(F.col(a), self.cell_m, 0), _cell(F.col(b), self.cell_m, 0)))
        out = boxes.withColumn("level", F.lit(0)).withColumn("cx", span("min_x", "max_x")).withColumn("cy", span("min_y", "max_y")).withColumn("copy", F.lit(0).cast("long"))
        for k in range(self.levels):
            met = out.join(self._split(k), (F.col("level") == k) & (F.col("cx") == F.col("s_cx")) & (F.col("cy") == F.col("s_cy")), "left")
            deeper = F.col("s_n").isNotNull()
            if k == DEPTH:
                out = met.withColumn("copy", F.explode(F.when(deeper, F.sequence(F.lit(0).cast("long"), F.ceil(F.col("s_n") / self.most) - 1)).otherwise(F.array("copy"))))
            else:
                child = F.struct((F.col("cx") * 2).alias("x"), (F.col("cy") * 2).alias("y"))
                four = [F.struct((child["x"] + i).alias("cx"), (child["y"] + j).alias("cy")) for i in (0, 1) for j in (0, 1)]
                low = lambda c: _cell(F.col(c), self.cell_m, k + 1)  # noqa: E731, B023
                reached = F.filter(F.array(*four), lambda q: q["cx"].between(low("min_x"), low("max_x")) & q["cy"].between(low("min_y"), low("max_y")))
                each = met.withColumn("q", F.explode(F.when(deeper, reached).otherwise(F.array(F.struct("cx", "cy")))))
                out = each.withColumns({"level": F.when(deeper, k + 1).otherwise(F.col("level")), "cx": F.col("q.cx"), "cy": F.col("q.cy")}).drop("q")
            out = out.drop("s_cx", "s_cy", "s_n")
        return out


def split_grid(points: DataFrame, cell_m: float, most: int | None = None) -> SplitGrid:
    """The grid of points (x, y), beginning with cells of cell_m."""
    fine = kept(points.select(_cell(F.col("x"), cell_m, DEPTH).alias("cx"), _cell(F.col("y"), cell_m, DEPTH).alias("cy")).groupBy("cx", "cy").agg(F.count("*").alias("n")))
    if most is None:
        most = max(LEAST, (fine.agg(F.sum("n")).first()[0] or 0) // CELLS)
    up = lambda c, k: F.floor(F.col(c) / (1 << (DEPTH - k))).cast("long")
    every = fine.select("n", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), up("cx", k).alias("cx"), up("cy", k).alias("cy")) for k in range(DEPTH + 1)))).alias("c"))
    crowded = kept(every.groupBy("c.level", "c.cx", "c.cy").agg(F.sum("n").alias("n")).where(F.col("n") > most))
    deepest = crowded.agg(F.max("level")).first()[0]
    return SplitGrid(cell_m, most, 0 if deepest is None else deepest + 1, crowded)


def met(points: DataFrame, boxes: DataFrame, cell_m: float, most: int | None = None) -> DataFrame:
    """points (x, y and others) with the columns of each box (min_x .. max_y and others) that holds them, bounds included. Names must not clash."""
    grid = split_grid(points, cell_m, most)
    joined = grid.place(points).join(grid.cover(boxes), KEY)
    held = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    return joined.where(held).drop(*KEY, "min_x", "min_y", "max_x", "max_y")
