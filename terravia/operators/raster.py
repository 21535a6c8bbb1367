"""Operators on rasters in long form: row, col, v (null where there is no data).

Neighbours come from windows along a row or along a column, so each operator shuffles
once by row and once by column at most; no window spans the whole raster. Tables of
stops and classes are literals of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil, cos, floor, pi, radians, sin, tan

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along_row() -> Window:
    return Window.partitionBy("row").orderBy("col")


def along_col() -> Window:
    return Window.partitionBy("col").orderBy("row")



def _difference(over: Window, at: str, v: str = "v") -> Column:
    """Central difference, one-sided at the ends, 0 for a single cell."""
    before, after = F.lag(v).over(over), F.lead(v).over(over)
    first, last = F.lag(at).over(over).isNull(), F.lead(at).over(over).isNull()
    return F.when(first & last, 0.0).when(first, after - F.col(v)).when(last, F.col(v) - before).otherwise((after - before) / 2)


def gradient(cells: DataFrame, v: str = "v") -> DataFrame:
    """dx along columns and dy along rows, per cell."""
    return cells.withColumn("dx", _difference(along_row(), "col", v)).withColumn("dy", _difference(along_col(), "row", v))


def slope_aspect(cells: DataFrame, res_m: float, z_factor: float = 1.0) -> DataFrame:
    """slope, counted from the vertical (level ground has half pi), and aspect, the bearing of the way down.

    Ground that only falls along rows lies on the cut between -pi and pi; the sign of its dx, a zero, says on which side, while Spark's atan2 drops it.
    """
    g = gradient(cells)
    zx, zy = F.col("dx") * (z_factor / res_m), F.col("dy") * (z_factor / res_m)
    on_cut = (zx == 0) & (zy < 0)
    side = F.when(zx.cast("string") == "-0.0", pi).otherwise(-pi)
    return g.withColumn("slope", F.lit(pi / 2) - F.atan(F.hypot(zx, zy))).withColumn("aspect", F.when(on_cut, side).otherwise(F.atan2(-zx, zy)))


def lambert(azimuth: float, altitude: float) -> Column:
    """Shade of a sloped cell, from its slope and aspect columns; null next to a cell without data."""
    alt, az = radians(altitude), radians(azimuth)
    lit = sin(alt) * F.sin("slope") + cos(alt) * F.cos("slope") * F.cos(F.lit(az) - F.col("aspect"))
    return F.when(lit.isNotNull(), F.least(F.greatest(lit, F.lit(0.0)), F.lit(1.0)))


def hillshade(cells: DataFrame, res_m: float, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    return slope_aspect(cells, res_m, z_factor).withColumn("shade", lambert(azimuth, altitude))


# The turn from the sun's bearing and the weight of each light.
LIGHTS = ((0.0, 1.0), (-45.0, 0.5), (45.0, 0.5), (-90.0, 0.25), (90.0, 0.25))


def many_lights(azimuth: float, altitude: float) -> Column:
    """Shade of a sloped cell by the sun and, weaker, from four directions beside and across it."""
    return sum((lambert(azimuth + turn, altitude) * w for turn, w in LIGHTS), F.lit(0.0)) / sum(w for _, w in LIGHTS)


def multidirectional(cells: DataFrame, res_m: float, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    return slope_aspect(cells, res_m, z_factor).withColumn("shade", many_lights(azimuth, altitude))


def cast_shadow(cells: DataFrame, res_m: float, azimuth: float = 270, altitude: float = 45.0, ramp_m: float = 40.0) -> DataFrame:
    """depth below the running horizon of the sun, and shadow (0 to 1) from it.

    Light runs along digital lines: each cell lies on one line, and a line has one cell for
    each step of the axis that the light follows more. The horizon falls by `drop` a step,
    so it is the running maximum of v + j * drop less j * drop.
    """
    across, down = round(-sin(radians(azimuth)), 12), round(cos(radians(azimuth)), 12)
    along, other, step, lean = ("col", "row", across, down / across) if abs(across) >= abs(down) else ("row", "col", down, across / down)
    drop = tan(radians(altitude)) * res_m * (1 + lean * lean) ** 0.5
    with_line = cells.withColumns({"__line": F.col(other) - F.rint(F.col(along) * lean), "__j": F.col(along) if step > 0 else -F.col(along)})
    over = Window.partitionBy("__line").orderBy("__j").rowsBetween(Window.unboundedPreceding, 0)
    horizon = F.max(F.col("v") + F.col("__j") * drop).over(over) - F.col("__j") * drop
    deep = with_line.withColumn("depth", horizon - F.col("v"))
    return deep.withColumn("shadow", F.least(F.greatest(F.col("depth") / ramp_m, F.lit(0.0)), F.lit(1.0))).drop("__line", "__j")


def painter(cells: DataFrame, shear: float) -> DataFrame:
    """target, col, winner: where rows shifted up by their height land, the later (southern) row on top.

    A cell covers the rows from its own target to just before the next row's.
    """
    target = F.rint(F.col("row") - shear * F.col("v")).cast("long")
    placed = cells.withColumn("lo", target)
    nxt = F.lead("lo").over(along_col())
    spans = placed.withColumn("hi", F.greatest(F.col("lo"), F.coalesce(nxt, F.col("lo") + 1) - 1))
    return spans.select("col", "row", F.explode(F.sequence("lo", "hi")).alias("target")).groupBy("target", "col").agg(F.max("row").alias("winner"))


def contours(cells: DataFrame, interval: float) -> DataFrame:
    """level and its distance in cells; every fifth level is an index line; flat ground has no distance."""
    scaled = gradient(cells.withColumn("u", F.col("v") / interval), "u")
    level = F.rint("u")
    steep = F.hypot("dx", "dy")
    return scaled.select("row", "col", level.cast("long").alias("level"), F.when(steep > 1e-6, F.abs(F.col("u") - level) / steep).alias("dist"), (F.pmod(level.cast("long"), F.lit(5)) == 0).alias("index_line"))


def contour_interval(range_m: Column, ground_m_per_in: Column, share: float = 0.02, most_lines: int = 40) -> Column:
    """The finest usual interval that neither the scale nor the relief forbids."""
    usual = [5, 10, 20, 25, 50, 100, 200, 250, 500, 1000]  # fixed values: metres
    good = F.filter(F.array(*map(F.lit, usual)), lambda iv: (iv >= share * ground_m_per_in) & (range_m / iv <= most_lines))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(2000))


def box_mean(cells: DataFrame, radius: int, v: str = "v", into: str = "mean") -> DataFrame:
    """Mean over a square of 2 * radius + 1 cells, cut at the edges: one pass by row, one by column."""
    r, c = along_row().rowsBetween(-radius, radius), along_col().rowsBetween(-radius, radius)
    sums = cells.withColumns({"__s": F.sum(v).over(r), "__n": F.count(v).over(r)})
    return sums.withColumn(into, F.sum("__s").over(c) / F.sum("__n").over(c)).drop("__s", "__n")


def _weighted_around(cells: DataFrame, key: str, at: str, names: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """cells with the named columns (numbers, none null) as sums over the cells before and after along the key, by the weights of their distance.

    Lines pass through in order, so that no more than a batch and the cells around it is held.
    """
    reach = len(weights) - 1

    def sums(cells: pa.Table, begin: int, end: int) -> pa.Table:
        """The cells from begin to end, summed; those around are there."""
        first = max(0, begin - reach)
        near = cells.slice(first, end + reach - first)
        before, after = reach - (begin - first), max(0, end + reach - first - near.num_rows)
        line = np.pad(near[key].to_numpy(), (before, after))
        on = np.pad(np.ones(near.num_rows, dtype=bool), (before, after))
        values = {c: np.pad(near[c].to_numpy(), (before, after)) for c in names}
        total = {c: np.zeros(end - begin) for c in names}
        for k in range(-reach, reach + 1):
            there = slice(reach - k, reach - k + end - begin)
            same = on[there] & (line[there] == line[reach : reach + end - begin])
            for c in names:
                total[c] += np.where(same, values[c][there], 0.0) * weights[abs(k)]
        out = cells.slice(begin, end - begin)
        for c in names:
            out = out.set_column(out.schema.get_field_index(c), c, pa.array(total[c]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            ready = held.num_rows - reach
            if ready > done:
                yield from sums(held, done, ready).to_batches()
                left = max(0, ready - reach)
                held, done = held.slice(left), ready - left
        if held is not None and held.num_rows > done:
            yield from sums(held, done, held.num_rows).to_batches()

    return cells.repartition(key).sortWithinPartitions(key, at).mapInArrow(run, cells.schema)


def gaussian(cells: DataFrame, sigma: float, into: str = "blurred") -> DataFrame:
    """Separable Gaussian, normalised over the cells that have data."""
    reach = max(1, round(3 * sigma))
    weights = [2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(reach + 1)]
    both = cells.withColumns({"__n": F.coalesce("v", F.lit(0.0)).cast("double"), "__d": F.col("v").isNotNull().cast("double")})
    for key, at in (("row", "col"), ("col", "row")):
        both = _weighted_around(both, key, at, ["__n", "__d"], weights)
    return both.withColumn(into, F.when(F.col("__d") > 0, F.col("__n") / F.col("__d"))).drop("__n", "__d")


# Radii in cells of the working grid, with their weights.
SKY_RADII = ((1, 0.5), (4, 0.3), (16, 0.2))


def sky_occlusion(cells: DataFrame, res_m: float, radii: Sequence[tuple[int, float]] = SKY_RADII) -> DataFrame:
    """How deep a cell lies below the mean around it, over several radii."""
    out, total = cells, F.lit(0.0)
    for radius, weight in radii:
        out = box_mean(out, radius, into=f"__m{radius}")
        deep = (F.col(f"__m{radius}") - F.col("v")) / (radius * res_m * 0.15)
        total = total + weight * F.least(F.greatest(deep, F.lit(0.0)), F.lit(1.0))
    return out.withColumn("occlusion", total).drop(*(f"__m{r}" for r, _ in radii))


def _last(place: Column, key: str, at: str, down: bool = False) -> Column:
    """The last place that is not null up to a cell, from the one end or the other. Frames grow from their start: one that ends last would be run through for every cell."""
    order = Window.partitionBy(key).orderBy(F.desc(at) if down else F.asc(at)).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(place, ignorenulls=True).over(order)


def _nearest_columns(cols: np.ndarray, heights: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted column the index of the best place, by (column distance)^2 + height, then row, then column. Columns ascend.

    Only places that are on the lower envelope of their parabolas anywhere can be best; those that
    touch it in one point are kept for the sake of ties.
    """
    hull: list[int] = []
    begins: list[float] = []  # where each one gets as low as the one before

    def meets(a: int, b: int) -> float:
        ca, cb = int(cols[a]), int(cols[b])
        return (cb * cb + int(heights[b]) - ca * ca - int(heights[a])) / (2 * (cb - ca))

    for i in range(len(cols)):
        at = -np.inf
        while hull and (at := meets(hull[-1], i)) < begins[-1]:
            hull.pop()
            begins.pop()
            at = -np.inf
        hull.append(i)
        begins.append(at)
    places, starts = np.array(hull), np.array(begins)
    last = np.searchsorted(starts, wanted, side="right") - 1
    best = places[last]
    for k in np.flatnonzero(starts[last] == wanted):
        tied, low = [best[k]], last[k]
        while low > 0 and starts[low] == wanted[k]:
            low -= 1
            tied.append(places[low])
        best[k] = min(tied, key=lambda i: (rows[i], cols[i]))
    return best


#: How many cells to either side are looked at before a row goes to its envelope.
NEAR = 64
_FAR = np.iinfo(np.int64).max


def _nearest_in_rows(row: np.ndarray, col: np.ndarray, place: np.ndarray, some: np.ndarray) -> np.ndarray:
    """For each cell of whole rows, in their order, the index of the cell whose place is best, -1 in a row without any. place: the row of the nearest datum in the cell's column, where there is some.

    All rows are searched at once, a cell further to either side each time, for the cells whose best could still be beaten from there;
    a row with one that NEAR cells do not settle is searched by its envelope.
    """
    n = len(row)
    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[begins, n])
    first = np.repeat(begins, sizes)
    last = np.repeat(begins + sizes - 1, sizes)
    high = np.where(some, (place - row) ** 2, _FAR)
    best, d2 = np.where(some, np.arange(n), -1), high.copy()

    def open_at(k: int, cells: np.ndarray) -> np.ndarray:
        return cells[(d2[cells] >= k * k) & ((cells - k >= first[cells]) | (cells + k <= last[cells]))]

    left = np.arange(n)
    for k in range(1, NEAR + 1):
        left = open_at(k, left)
        if not len(left):
            return best
        for step in (-k, k):
            at = left[(left + step >= first[left]) & (left + step <= last[left])]
            at = at[some[at + step]]
            other, old = at + step, best[at]
            far = (col[other] - col[at]) ** 2 + high[other]
            before = (place[other] < place[old]) | ((place[other] == place[old]) & (col[other] < col[old]))
            won = (far < d2[at]) | ((far == d2[at]) & before)
            best[at[won]], d2[at[won]] = other[won], far[won]
    for begin in np.unique(first[open_at(NEAR + 1, left)]):
        cells = slice(begin, last[begin] + 1)
        known = begin + np.flatnonzero(some[cells])
        if len(known):
            best[cells] = known[_nearest_columns(col[known], high[known], place[known], col[cells])]
    return best


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, cut between rows of the raster."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch["row"].to_numpy()
        cut = int(np.searchsorted(rows, rows[-1]))
        if held and (cut or held[-1]["row"][-1].as_py() != rows[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def nearest_data(cells: DataFrame, *carried: str) -> DataFrame:
    """row, col, nearest, d2 and the carried columns of every cell: the value of the nearest cell that has one, by squared distance, then smaller row, then column; null if there is none.

    First the nearest along each column; then, along each row, cells to either side and, where those do not settle
    it, the lower envelope of the parabolas over its columns, in time linear in the row's length. Many rows of the raster are
    searched at a time; a row of the raster is held whole.
    """
    up, under = (_last(F.when(F.col("v").isNotNull(), F.struct(F.col("row").alias("p"), "v")), "col", "row", d) for d in (False, True))
    first = cells.select("row", "col", *carried, up.alias("a"), under.alias("b"))
    upper = F.col("b").isNull() | (F.col("row") - F.col("a.p") <= F.col("b.p") - F.col("row"))
    near = F.when(upper, F.col("a")).otherwise(F.col("b"))
    flat = first.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *carried, near["p"].cast("long").alias("p"), near["v"].alias("w"))
    kinds = dict(cells.dtypes)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_rows(batches):
            row, col = part["row"].to_numpy(), part["col"].to_numpy()
            some = part["p"].is_valid().to_numpy()
            place = pc.fill_null(part["p"], 0).to_numpy()
            best = _nearest_in_rows(row, col, place, some)
            d2 = (col[best] - col) ** 2 + (place[best] - row) ** 2
            none = best < 0
            found = part.select(["row", "col", *carried]).append_column("nearest", part["w"].take(pa.array(best, mask=none))).append_column("d2", pa.array(d2, mask=none))
            yield from found.to_batches()

    schema = ", ".join(["row long", "col long", *(f"`{c}` {kinds[c]}" for c in carried), f"nearest {kinds['v']}", "d2 long"])
    done = flat.repartition("row").sortWithinPartitions("row", "col").mapInArrow(fill, schema)
    return done.select("row", "col", "nearest", "d2", *carried)


def fill_nodata(cells: DataFrame) -> DataFrame:
    """Every cell with filled: its own value or that of the nearest cell that has one; 0 where none has."""
    return nearest_data(cells).select("row", "col", F.coalesce("nearest", F.lit(0.0)).alias("filled"))


def ramp(t: Column, stops: Sequence[tuple[float, tuple[int, int, int]]]) -> Column:
    """struct r, g, b between the stops, rounded half to even; a missing t counts as 0."""
    u = F.least(F.greatest(F.coalesce(F.nanvl(t, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))

    def channel(k: int) -> Column:
        out = F.lit(float(stops[-1][1][k]))
        for (a, ca), (b, cb) in reversed(list(zip(stops, stops[1:], strict=False))):
            out = F.when(u <= b, ca[k] + (cb[k] - ca[k]) * ((u - a) / (b - a))).otherwise(out)
        return F.rint(out).cast("int")

    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def class_tint(cells: DataFrame, tints: dict[int, tuple[int, int, int]], code: str = "code") -> DataFrame:
    """cells with weight 1 and a tint where the class has one, else weight 0."""
    table = F.create_map(*(x for c, rgb in tints.items() for x in (F.lit(c), F.struct(*(F.lit(v).alias(n) for n, v in zip("rgb", rgb, strict=True))))))
    return cells.withColumn("tint", table[F.col(code)]).withColumn("weight", F.col("tint").isNotNull().cast("int"))


def blurred_tint(cells: DataFrame, sigma: float) -> DataFrame:
    """cells (tint, weight as of class_tint) with both blurred: a tint is the mean of the tints around by weight, and the weight the share of them, so classes fade into each other and do not bleed into ground that has none."""
    out = cells
    for c in "rgb":
        # where the weight is 0 there is no tint to spread
        part = out.withColumn("v", F.when(F.col("weight") > 0, F.col(f"tint.{c}") * F.col("weight")).otherwise(0.0))
        out = gaussian(part.drop(f"__{c}"), sigma, f"__{c}").drop("v")
    out = gaussian(out.withColumn("v", F.col("weight").cast("double")), sigma, "__w").drop("v")
    tint = F.struct(*((F.col(f"__{c}") / (F.col("__w") + 1e-6)).alias(c) for c in "rgb"))
    return out.withColumns({"tint": tint, "weight": F.least(F.greatest(F.col("__w"), F.lit(0.0)), F.lit(1.0))}).drop("__r", "__g", "__b", "__w")


def sample_nearest(points: DataFrame, cells: DataFrame, row: Column, col: Column) -> DataFrame:
    """points with the v of the cell they fall in, null outside the raster."""
    keyed = points.withColumns({"row": F.floor(row).cast("long"), "col": F.floor(col).cast("long")})
    return keyed.join(cells.select("row", "col", "v"), ["row", "col"], "left")


def sample_bilinear(points: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """key, z: weighted mean of the four cells around (fr, fc), over those that have data."""
    corners = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    spread = points.select(key, "fr", "fc", corners.alias("k"))
    r, c = F.floor("fr") + F.col("k.a"), F.floor("fc") + F.col("k.b")
    weight = (1 - F.abs(F.col("fr") - r)) * (1 - F.abs(F.col("fc") - c))
    met = spread.select(key, r.cast("long").alias("row"), c.cast("long").alias("col"), weight.alias("w")).join(cells.where("v IS NOT NULL"), ["row", "col"])
    return met.groupBy(key).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("v")).alias("swv")).select(key, F.when(F.col("sw") > 0, F.col("swv") / F.col("sw")).alias("z"))


def read_back(cells: DataFrame, grid: DataFrame, factor: int, names: Sequence[str]) -> DataFrame:
    """cells with the named columns of a grid of blocks of factor x factor of them, read between its cells as by sample_bilinear.

    The cells between the same four of the grid share one row of what these hold, so each cell is joined once.
    """
    corners = [(a, b) for a in (0, 1) for b in (0, 1)]
    spread = grid.select("row", "col", *names, F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in corners))).alias("k"))
    placed = spread.select((F.col("row") - F.col("k.a")).alias("__r"), (F.col("col") - F.col("k.b")).alias("__c"), "k", *names)
    at = lambda name, a, b: f"__{name}{a}{b}"
    held = [F.max(F.when((F.col("k.a") == a) & (F.col("k.b") == b), F.col(name))).alias(at(name, a, b)) for name in names for a, b in corners]
    squares = placed.groupBy("__r", "__c").agg(*held)
    met = cells.withColumns({f: (F.col(c) + 0.5) / factor - 0.5 for c, f in (("row", "__fr"), ("col", "__fc"))})
    met = met.withColumns({c: F.floor(f).cast("long") for c, f in (("__r", "__fr"), ("__c", "__fc"))}).join(squares, ["__r", "__c"], "left")
    # weights, sums and means one after the other: each is worked out once a cell
    near = {f"__{f}{a}": 1 - F.abs(F.col(f"__f{f}") - (F.col(f"__{f}") + a)) for f in "rc" for a in (0, 1)}
    met = met.withColumns(near).withColumns({f"__w{a}{b}": F.col(f"__r{a}") * F.col(f"__c{b}") for a, b in corners})
    some = lambda name, k, x: F.when(F.col(at(name, *k)).isNotNull(), x).otherwise(0.0)
    w = {k: F.col(f"__w{k[0]}{k[1]}") for k in corners}
    met = met.withColumns({f"__s{name}": sum((some(name, k, w[k]) for k in corners), F.lit(0.0)) for name in names})
    met = met.withColumns({f"__t{name}": sum((some(name, k, w[k] * F.col(at(name, *k))) for k in corners), F.lit(0.0)) for name in names})
    return met.select(*cells.columns, *(F.when(F.col(f"__s{name}") > 0, F.col(f"__t{name}") / F.col(f"__s{name}")).alias(name) for name in names))


def window(cells: DataFrame, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """The cells of a rectangle, its ends excluded; the predicate reaches the scan."""
    return cells.where((F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1))


def coarsen(cells: DataFrame, factor: int) -> DataFrame:
    """Mean of the data in blocks of factor x factor cells."""
    block = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    return cells.groupBy(block("row"), block("col")).agg(F.avg("v").alias("v"), F.count("v").alias("n"))


def order_statistics(values: DataFrame, ranks: Sequence[int], bins: int = 4096) -> list[float]:
    """The values (column v, none of them null) of these ranks, from 0. Counts over ever narrower ranges: what a task or the driver holds is bounded by the bins and ranks."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    #: By rank: the range that its value lies in, and how many values are below the range.
    at = dict.fromkeys(ranks, (low, high, 0))
    while any(lo < hi for lo, hi, _ in at.values()):
        open_ = sorted({span for span in at.values() if span[0] < span[1]})
        spans = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi, _) in enumerate(open_)))
        inside = values.select("v", F.explode(F.filter(spans, lambda s: F.col("v").between(s["lo"], s["hi"]))).alias("s"))
        # halves first, so that a range of all numbers does not overflow
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("s.lo") / 2) / (F.col("s.hi") / 2 - F.col("s.lo") / 2) * bins))
        counts = inside.groupBy(F.col("s.i").alias("i"), bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for rank, span in at.items():
            if span not in open_:
                continue
            below = span[2]
            for r in sorted((r for r in counts if r["i"] == open_.index(span)), key=lambda r: r["b"]):
                if rank < below + r["n"]:
                    at[rank] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]
    return [at[r][0] for r in ranks]


def percentiles(cells: DataFrame, shares: Sequence[float]) -> DataFrame:
    """One row, p0, p1 ...: exact, interpolated, over the data; null if there is none."""
    values = cells.where("v IS NOT NULL").select("v")
    n = values.count()
    schema = ", ".join(f"p{i} double" for i in range(len(shares)))
    if not n:
        return cells.sparkSession.createDataFrame([(None,) * len(shares)], schema)
    places = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in places for r in (floor(p), ceil(p))})
    found = dict(zip(ranks, order_statistics(values, ranks), strict=True))
    row = tuple(float(found[floor(p)] + (found[ceil(p)] - found[floor(p)]) * (p - floor(p))) for p in places)
    return cells.sparkSession.createDataFrame([row], schema)


def best_block_window(cells: DataFrame, block: int, high: int, wide: int) -> DataFrame:
    """block_row, block_col, total: the window of high x wide blocks with the largest sum; ties to the first."""
    blocks = cells.groupBy(F.floor(F.col("row") / block).cast("long").alias("row"), F.floor(F.col("col") / block).cast("long").alias("col")).agg(F.sum("v").alias("v"))
    across = blocks.withColumns({"s": F.sum("v").over(along_row().rowsBetween(0, wide - 1)), "n": F.count("*").over(along_row().rowsBetween(0, wide - 1))}).where(F.col("n") == wide)
    down = across.withColumns({"t": F.sum("s").over(along_col().rowsBetween(0, high - 1)), "m": F.count("*").over(along_col().rowsBetween(0, high - 1))}).where(F.col("m") == high)
    return down.orderBy(F.desc("t"), "row", "col").limit(1).select(F.col("row").alias("block_row"), F.col("col").alias("block_col"), F.col("t").alias("total"))


def sparse(cells: DataFrame) -> DataFrame:
    """Only the cells that hold something."""
    return cells.where("v <> 0")


Pass = Callable[[DataFrame], DataFrame]


class PassRegistry:
    """Named raster passes in stages; a pass registered again under its name takes the old one's place."""

    STAGES = ("colour", "light", "finish", "grade")

    def __init__(self) -> None:
        self._passes: dict[str, dict[str, tuple[Pass, Callable[[dict], bool]]]] = {s: {} for s in self.STAGES}

    def register(self, stage: str, name: str, run: Pass, enabled: Callable[[dict], bool] = lambda knobs: True) -> None:
        self._passes[stage][name] = (run, enabled)

    def unregister(self, stage: str, name: str) -> None:
        self._passes[stage].pop(name, None)

    def names(self, stage: str) -> list[str]:
        return list(self._passes[stage])

    def apply(self, cells: DataFrame, knobs: dict) -> DataFrame:
        for stage in self.STAGES:
            for run, enabled in self._passes[stage].values():
                if enabled(knobs):
                    cells = cells.transform(run)
        return cells

