"""Operators that relate points, places and regions."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravia.operators.assets import first_of_each
from terravia.operators.splitgrid import met
from terravia.shared import Scratch, kept

SPACING_M = 6000.0
#: Cells of the grid on which points meet regions; a region of ordinary size reaches into some tens.
REGION_CELL_M = 20000.0
CARRY_M = 6000.0
SAME_PLACE_M = 400.0
#: Pairs of a point and a place that a round of the search for the nearest compares, for each point on average.
MEET = 16


def distance2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def inside(x: Column, y: Column, r: str = "") -> Column:
    """Closed bounds; r is a prefix of the region's columns."""
    return x.between(F.col(f"{r}min_x"), F.col(f"{r}max_x")) & y.between(F.col(f"{r}min_y"), F.col(f"{r}max_y"))


def matched(points: DataFrame, regions: DataFrame, cell_m: float = REGION_CELL_M) -> DataFrame:
    """points with each region that they lie in. They meet by an equality join on the cells of a grid, crowded ones split."""
    return met(points, regions.select("region_id", "min_x", "min_y", "max_x", "max_y"), cell_m)


def in_bounds(points: DataFrame, regions: DataFrame) -> DataFrame:
    """region_id, n: vertices inside each region, 0 included."""
    hits = matched(points.select("x", "y"), regions).groupBy("region_id").agg(F.count("*").alias("n"))
    return regions.select("region_id").join(hits, "region_id", "left").select("region_id", F.coalesce("n", F.lit(0)).alias("n"))


def best_region(points: DataFrame, regions: DataFrame) -> DataFrame:
    """The region with the most vertices; ties go to the smaller id, and no vertex means no region."""
    return in_bounds(points, regions).where("n > 0").orderBy(F.desc("n"), "region_id").limit(1)


def outside(points: DataFrame, regions: DataFrame) -> DataFrame:
    """region_id, tracks_outside: tracks with a vertex strictly outside, told from those that lie inside whole."""
    every = points.groupBy("track_id").agg(F.min("x").alias("x"), F.max("x").alias("x1"), F.min("y").alias("y"), F.max("y").alias("y1"))
    whole = matched(every, regions).join(regions.select("region_id", "max_x", "max_y"), "region_id").where("x1 <= max_x AND y1 <= max_y").groupBy("region_id").agg(F.count("*").alias("n"))
    total = every.agg(F.count("*").alias("total"))
    return regions.select("region_id").join(whole, "region_id", "left").join(F.broadcast(total)).select("region_id", (F.col("total") - F.coalesce("n", F.lit(0))).alias("tracks_outside"))  # one row


def routed(points: DataFrame, wanted: DataFrame, regions: DataFrame) -> DataFrame:
    """upload, region_id, how, error: where each upload belongs. points: upload, x, y; wanted: upload, session (a region it is bound to), asked (a region that was named).

    A session's region stays; a named one stays if a vertex lies in it, else the region
    with the most vertices takes its place; without either that region is taken. Where no
    vertex lies in what remains, or a region is unknown, the row says why it is refused.
    """
    hits = matched(points.select("upload", "x", "y"), regions).groupBy("upload", "region_id").agg(F.count("*").alias("n"))
    best = hits.groupBy("upload").agg(F.min(F.struct(-F.col("n"), "region_id")).alias("b")).select("upload", F.col("b.region_id").alias("best"))
    known = lambda name: regions.select(F.col("region_id").alias(name), F.lit(True).alias(f"{name}_known"))
    held = lambda name: hits.select("upload", F.col("region_id").alias(name), F.col("n").alias(f"{name}_n"))
    rows = wanted.join(best, "upload", "left")
    for name in ("session", "asked"):
        rows = rows.join(known(name), name, "left").join(held(name), ["upload", name], "left")
    by_session, by_name = F.col("session").isNotNull(), F.col("session").isNull() & F.col("asked").isNotNull()
    error = (
        F.when(by_session & F.col("session_known").isNull(), "unknown_region")
        .when(by_session & F.col("session_n").isNull(), "outside_session_region")
        .when(by_name & F.col("asked_known").isNull(), "unknown_region")
        .when(~by_session & F.col("best").isNull(), "outside_all_regions")
    )
    how = F.when(by_session, "session").when(by_name & F.col("asked_n").isNotNull(), "asked").when(by_name, "recovered").otherwise("best")
    region = F.when(by_session, F.col("session")).when(by_name & F.col("asked_n").isNotNull(), F.col("asked")).otherwise(F.col("best"))
    return rows.select("upload", F.when(error.isNull(), region).alias("region_id"), F.when(error.isNull(), how).alias("how"), error.alias("error"))


def hotspots(cells: DataFrame, bounds: tuple[float, float, float, float], cell_m: float = 1000.0, most: int = 7, spacing_m: float = SPACING_M) -> DataFrame:
    """gy, gx, visits, x, y of the busiest cells that stand spacing_m apart, greedily by visits, then larger cell.

    A place rules out the cells within its circle only, so of the ordered cells no more
    than `most` circles full can matter: a top-k of that many goes to the fold, however
    many cells there are.
    """
    min_x, _, max_x, max_y = bounds
    nx = max(1, int((max_x - min_x) / cell_m))
    circle = (2 * ceil(spacing_m / cell_m) + 1) ** 2
    cell = (F.col("gy") * nx + F.col("gx")).alias("cell")
    centred = cells.where("visits >= 1").select("gy", "gx", "visits", cell, (min_x + (F.col("gx") + 0.5) * cell_m).alias("x"), (max_y - (F.col("gy") + 0.5) * cell_m).alias("y"))
    first = centred.orderBy(F.desc("visits"), F.desc("cell")).limit(most * circle)
    ordered = first.groupBy().agg(F.reverse(F.sort_array(F.collect_list(F.struct("visits", "cell", "gy", "gx", "x", "y")))).alias("c"))
    apart = lambda acc, s: ~F.exists(acc, lambda a: distance2(a["x"], a["y"], s["x"], s["y"]) < spacing_m * spacing_m)
    chosen = F.aggregate("c", F.slice("c", 1, 0), lambda acc, s: F.when((F.size(acc) < most) & apart(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
    return ordered.select(F.posexplode(chosen).alias("rank", "s")).select((F.col("rank") + 1).alias("rank"), "s.gy", "s.gx", "s.visits", "s.x", "s.y")


def _radius(points: DataFrame, spots: DataFrame, widest: float, least: float, pairs: int) -> float:
    """The widest of widest, widest / 2, widest / 4 ... at which points and spots that meet on a grid make no more pairs; least at least."""
    radius = widest
    while radius / 2 >= least:
        cell = lambda c: F.floor(F.col(c) / (2 * radius))  # noqa: E731, B023
        counted = lambda rows, x, y, n: rows.groupBy(cell(x).alias("cx"), cell(y).alias("cy")).agg(F.count("*").cast("double").alias(n))  # noqa: E731, B023
        met_now = counted(points, "x", "y", "n").join(counted(spots, "px", "py", "m"), ["cx", "cy"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0.0
        # a place reaches into four cells of twice the radius
        if 4 * met_now <= pairs:
            break
        halvings = max(1, ceil(log2(4 * met_now / pairs) / 2))
        radius = max(radius / 2**halvings, widest / 2 ** floor(log2(widest / least)))
    return radius


def nearest(points: DataFrame, places: DataFrame, within_m: float) -> DataFrame:
    """id, place, dist_m: each point's nearest place within the radius, ties to the smaller place.

    In rounds of growing radius, the last of which is within_m: a point that has places within a radius has its nearest among them, and
    leaves. A round takes the widest radius at which there are no more than MEET pairs for each point, and at
    least twice the one before; so what is compared grows with the points, not with their square.
    """
    scratch = Scratch(points.sparkSession, "nearest")
    # of places on one spot the smallest is the nearest
    spots = scratch.put("spots", places.groupBy(F.col("x").alias("px"), F.col("y").alias("py")).agg(F.min("place").alias("place")))
    left = scratch.put("left", points.select("id", "x", "y"))
    n_left, n_spots = left.count(), spots.count()
    pairs = MEET * max(1, n_left)
    radius = within_m / 2**40
    while True:
        radius = _radius(left, spots, within_m, 2 * radius, pairs)
        cell = lambda c: F.floor(c / (2 * radius))  # noqa: E731, B023
        inside_one = lambda rows, x, y: rows.withColumns({"cx": cell(F.col(x)), "cy": cell(F.col(y))})  # noqa: E731, B023
        reached = lambda c: F.explode(F.sequence(cell(F.col(c) - radius * 1.0001), cell(F.col(c) + radius * 1.0001)))  # noqa: E731, B023
        all_within = lambda rows, x, y: rows.withColumn("cx", reached(x)).withColumn("cy", reached(y))  # noqa: E731, B023
        # the smaller side goes to all cells within reach
        one, many = (inside_one, all_within) if n_spots <= n_left else (all_within, inside_one)
        near = one(left, "x", "y").join(many(spots, "px", "py"), ["cx", "cy"]).withColumn("d2", distance2(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).where(F.col("d2") <= radius * radius)
        first = near.groupBy("id").agg(F.min(F.struct("d2", "place")).alias("m")).select("id", "m.place", F.sqrt("m.d2").alias("dist_m"))
        done = scratch.put("done", first)
        scratch.append("found", done)
        if radius >= within_m:
            break
        left = scratch.put("left", left.join(done.select(F.col("id").alias("done_id")), F.col("id").eqNullSafe(F.col("done_id")), "left_anti"))
        n_left = left.count()
    scratch.clear()
    return scratch.appended("found", first)


def carry_annotations(old: DataFrame, new: DataFrame, key: str, within_m: float = CARRY_M) -> DataFrame:
    """key, x, y, label of the new spots, to which the labels of old ones have moved.

    In order of old.nth each labelled spot gives its label to the nearest spot of the list
    if that is within reach and has none, and else joins the list itself. Both lists are a
    handful of spots a key (a session), so the fold runs inside its row.
    """
    spot = F.struct("x", "y", "label")
    olds = old.where(F.col("label").isNotNull() & (F.col("label") != "")).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", spot.alias("s")))), lambda r: r["s"]).alias("olds"))
    news = new.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", spot.alias("s")))), lambda r: r["s"]).alias("news"))
    both = news.join(olds, key, "full")
    none = F.slice(F.coalesce("news", "olds"), 1, 0)

    def step(acc: Column, o: Column) -> Column:
        near = F.array_min(F.transform(acc, lambda s, i: F.struct(distance2(s["x"], s["y"], o["x"], o["y"]).alias("d2"), i.alias("i"))))
        takes = near.isNotNull() & (near["d2"] <= within_m * within_m) & (F.coalesce(F.get(acc, near["i"])["label"], F.lit("")) == "")
        given = F.transform(acc, lambda s, i: F.when(i == near["i"], F.struct(s["x"].alias("x"), s["y"].alias("y"), o["label"].alias("label"))).otherwise(s))
        return F.when(F.coalesce(takes, F.lit(False)), given).otherwise(F.concat(acc, F.array(o)))

    merged = F.aggregate(F.coalesce("olds", none), F.coalesce("news", none), step)
    return both.select(key, F.posexplode(merged).alias("pos", "s")).select(key, "pos", "s.x", "s.y", "s.label")


def merge_waypoints(spots: DataFrame, waypoints: DataFrame, key: str, apart_m: float = SAME_PLACE_M) -> DataFrame:
    """key, pos, x, y: the spots, then in order the waypoints that have no spot of the growing list within apart_m."""
    listed = lambda df, name: df.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "x", "y"))), lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"))).alias(name))
    both = listed(spots, "spots").join(listed(waypoints, "more"), key, "full")
    none = F.slice(F.coalesce("spots", "more"), 1, 0)
    close = lambda acc, w: F.exists(acc, lambda s: distance2(s["x"], s["y"], w["x"], w["y"]) < apart_m * apart_m)
    merged = F.aggregate(F.coalesce("more", none), F.coalesce("spots", none), lambda acc, w: F.when(close(acc, w), acc).otherwise(F.concat(acc, F.array(w))))
    return both.select(key, F.posexplode(merged).alias("pos", "s")).select(key, "pos", "s.x", "s.y")


def farthest_points(pool: DataFrame, bounds: tuple[float, float, float, float], n: int, inset: float = 0.12) -> DataFrame:
    """nth, id, x, y: from the smallest id on, each time the point farthest from the chosen ones, cells of a 3 x 3 grid once each first.

    One aggregate a round over the points inside, which are written once; a row a round reaches the driver.
    """
    w, s, e, nb = bounds
    dx, dy = inset * (e - w), inset * (nb - s)
    w, s, e, nb = w + dx, s + dy, e - dx, nb - dy
    inner = pool.where(F.col("x").between(w, e) & F.col("y").between(s, nb))
    third = lambda c, a, b: F.least(F.lit(2), F.greatest(F.lit(0), (3 * (F.col(c) - a) / (b - a)).cast("int")))
    celled = kept(inner.withColumn("cell", third("x", w, e) * 3 + third("y", s, nb)))
    chosen: list = []
    while len(chosen) < n:
        if not chosen:
            best = celled.agg(F.min_by(F.struct("id", "x", "y", "cell"), "id").alias("b")).first()["b"]
        else:
            gap = reduce(F.least, [distance2(F.col("x"), F.col("y"), F.lit(c["x"]), F.lit(c["y"])) for c in chosen]) if len(chosen) > 1 else distance2(F.col("x"), F.col("y"), F.lit(chosen[0]["x"]), F.lit(chosen[0]["y"]))
            fresh = ~F.col("cell").isin([c["cell"] for c in chosen])
            rest = celled.where(~F.col("id").isin([c["id"] for c in chosen]))
            best = rest.agg(F.max_by(F.struct("id", "x", "y", "cell"), F.struct(fresh, gap, -F.col("id"))).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append(best)
    rows = [(i, c["id"], c["x"], c["y"]) for i, c in enumerate(chosen, 1)]
    return pool.sparkSession.createDataFrame(rows, f"nth int, id {pool.schema['id'].dataType.simpleString()}, x double, y double")


def trailheads(points: DataFrame, goal: tuple[float, float], centre: tuple[float, float], target_m: float, least_m: float = 1000.0, near: int = 25, keep: int = 5) -> DataFrame:
    """Of the points beyond least_m of the goal, the `near` closest to the target distance; of these the `keep` closest to the centre."""
    d = F.sqrt(distance2(F.col("x"), F.col("y"), F.lit(goal[0]), F.lit(goal[1])))
    first = points.withColumn("d", d).where(F.col("d") > least_m).orderBy(F.abs(F.col("d") - target_m), "id").limit(near)
    return first.orderBy(distance2(F.col("x"), F.col("y"), F.lit(centre[0]), F.lit(centre[1])), "id").limit(keep)


def label_order(labels: DataFrame, reserve: dict[str, int], cap: int, group: str) -> DataFrame:
    """labels with nth by group: the reserved kinds' best first (at most a third of the cap), then all by rank."""
    room, left = dict.fromkeys(sorted(reserve), 0), cap // 3
    while left and any(room[k] < reserve[k] for k in room):
        for k in room:
            if left and room[k] < reserve[k]:
                room[k], left = room[k] + 1, left - 1
    best = Window.partitionBy(group, "kind").orderBy(F.desc("rank"), "name")
    quota = F.coalesce(F.create_map(*(F.lit(x) for kv in room.items() for x in kv))[F.col("kind")], F.lit(0))
    first = labels.withColumn("held", F.row_number().over(best) <= quota)
    return first.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("held"), F.desc("rank"), "name")))


def place_labels(ordered: DataFrame, group: str, cap: int) -> DataFrame:
    """group, name, x, y, w, h of the labels whose boxes, taken by nth, meet none that is placed; at most cap a group.

    A group is a sheet, with as many candidates as its map has names.
    """
    one = ordered.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("nth", "name", "x", "y", "w", "h"))).alias("c"))
    meets = lambda a, b: (F.abs(a["x"] - b["x"]) * 2 < a["w"] + b["w"]) & (F.abs(a["y"] - b["y"]) * 2 < a["h"] + b["h"])
    placed = F.aggregate("c", F.slice("c", 1, 0), lambda acc, b: F.when((F.size(acc) >= cap) | F.exists(acc, lambda a: meets(a, b)), acc).otherwise(F.concat(acc, F.array(b))))
    return one.select(group, F.explode(placed).alias("p")).select(group, "p.*")


def first_feasible(candidates: DataFrame, key: str) -> DataFrame:
    """The first slot of the first pass that fits. candidates: key, slot, avoids, fits."""
    pass_ = F.when(F.col("avoids"), 0).otherwise(1)
    return candidates.where("fits").groupBy(key).agg(F.min(F.struct(pass_.alias("pass"), "slot")).alias("s")).select(key, "s.pass", "s.slot")


def label_candidates(features: DataFrame, width: float, height: float, ranks: dict[str, int], curved: tuple[str, ...] = ("range", "valley"), lines: tuple[str, ...] = ("river",)) -> DataFrame:
    """id, kind, name, rank, x, y, n, along: where the names of features would stand. features: id, kind, name, vidx, x, y in pixels of the sheet.

    A feature counts as far as its vertices are on the sheet, and stands at their middle;
    curved kinds of two such vertices at least may be written along them. Of the features
    of a line kind that share a name the one with the most vertices on the sheet stands
    for all, at its middle vertex; the smaller id on ties. Unknown kinds and blank names give nothing.
    """
    rank = F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv))[F.col("kind")]
    named = features.withColumns({"name": F.trim(F.coalesce("name", F.lit(""))), "rank": rank}).where((F.col("name") != "") & F.col("rank").isNotNull())
    inside_ = named.where(F.col("x").between(0, width) & F.col("y").between(0, height))
    whole = inside_.groupBy("id", "kind", "name", "rank").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("vidx", "x", "y"))).alias("v"))
    is_line = F.col("kind").isin(*lines)
    middle = F.get("v", F.floor(F.col("n") / 2).cast("int"))
    placed = whole.select(
        "id", "kind", "name", "rank", F.when(is_line, middle["x"]).otherwise(F.col("x")).alias("x"), F.when(is_line, middle["y"]).otherwise(F.col("y")).alias("y"), "n",
        (F.col("kind").isin(*curved) & (F.col("n") >= 2)).alias("along"),
    )
    longest = placed.where(is_line).groupBy("kind", "name").agg(F.min(F.struct(-F.col("n"), "id")).alias("m")).select("kind", "name", F.col("m.id").alias("id"))
    return placed.where(~is_line).unionByName(placed.where(is_line).join(longest, ["kind", "name", "id"], "left_semi").select(placed.columns))


def longest_runs(features: DataFrame, width: float, height: float) -> DataFrame:
    """name, id, first, n, x, y: of the features that share a name, the longest run of successive vertices on the sheet, and its middle vertex.

    features: id, name, vidx, x, y in pixels of the sheet. A feature that leaves the sheet and comes back has several runs. Of equal runs that of the
    smaller id, then the earlier, is taken; blank names give nothing.
    """
    named = features.withColumn("name", F.trim(F.coalesce("name", F.lit("")))).where("name <> ''")
    on = F.coalesce(F.col("x").between(0, width) & F.col("y").between(0, height), F.lit(False))
    order = Window.partitionBy("id").orderBy("vidx")
    # where the sheet is entered an island begins; the running sum of the beginnings tells islands apart
    enters = (on & ~F.coalesce(F.lag(on).over(order), F.lit(False))).cast("int")
    islands = named.withColumns({"on": on, "island": F.sum(enters).over(order)}).where("on")
    placed = islands.withColumns({"place": F.row_number().over(Window.partitionBy("id", "island").orderBy("vidx")), "n": F.count("*").over(Window.partitionBy("id", "island"))})
    middle = placed.where(F.col("place") == F.floor(F.col("n") / 2) + 1).select("name", "id", "island", "n", "x", "y")
    starts = placed.where("place = 1").select("id", "island", F.col("vidx").alias("first"))
    best = middle.join(starts, ["id", "island"]).groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("less"), "id", "first", "n", "x", "y")).alias("m"))
    return best.select("name", "m.id", "m.first", "m.n", "m.x", "m.y")


# The sheet that furniture is sized for (square inches) and how far it may shrink or grow; inches of the lower left corner that title and compass take,
# of the height profile's inset and of the clear air above the corner's stack, and of the keyline's inset; the profile's width in its heights.
SHEET_IN2, FURNITURE_SCALE = 18.0 * 24.0, (0.75, 2.0)
CORNER_IN, PROFILE_INSET_IN, PROFILE_GAP_IN, KEYLINE_IN, PROFILE_ASPECT = (3.4, 2.5), 0.35, 0.16, 0.25, 3.4


def furniture_scale(print_w: Column, print_h: Column, knob: Column) -> Column:
    """How much larger than on the standard sheet furniture is drawn: by the side, within bounds, times the owner's choice."""
    return F.least(F.greatest(F.sqrt(print_w * print_h / SHEET_IN2), F.lit(FURNITURE_SCALE[0])), F.lit(FURNITURE_SCALE[1])) * knob


def profile_rect(trim: tuple[Column, Column, Column, Column], dpi: Column, scale: Column, height_in: Column, stack_top: Column) -> tuple[Column, Column, Column, Column]:
    """The height profile's rectangle: above the furniture in the corner (whose top is given), no higher than the keyline allows."""
    x0, y0, x1, y1 = trim
    unit = dpi * scale
    inset, gap = F.rint(PROFILE_INSET_IN * unit), F.rint(PROFILE_GAP_IN * unit)
    base = F.least(y1 - inset, stack_top - gap)
    ceiling = y0 + F.rint(KEYLINE_IN * dpi) + F.greatest(F.lit(1.0), F.rint(0.05 * unit))
    high = F.greatest(F.lit(1.0), F.least(F.greatest(F.lit(1.0), F.rint(height_in * dpi * scale)), base - ceiling))
    return x0 + inset, base - high, x0 + inset + F.least(x1 - x0 - 2 * inset, F.rint(high * PROFILE_ASPECT)), base


def keep_outs(sheets: DataFrame, key: str) -> DataFrame:
    """key, part, x0, y0, x1, y1: the rectangles that names must keep out of.

    sheets: key, width, height (pixels of the sheet), trim (pixels that are cut off on each side), dpi, print_w, print_h (inches), furniture (the owner's scale), has_title,
    has_compass, top_clear, bottom_clear (shares of the height), has_profile, profile_in, and stack_top (where the furniture in the lower left corner
    ends, null where there is none). The corner is kept for title or compass; the clear bands span the whole sheet.
    """
    c = F.col
    box = lambda part, has, x0, y0, x1, y1: F.when(has, F.struct(F.lit(part).alias("part"), *(v.cast("double").alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1")))))
    scale = furniture_scale(c("print_w"), c("print_h"), c("furniture"))
    left, top, right, bottom = c("trim"), c("trim"), c("width") - c("trim"), c("height") - c("trim")
    zero = F.lit(0.0)
    px0, py0, px1, py1 = profile_rect((left, top, right, bottom), c("dpi"), scale, c("profile_in"), F.coalesce(c("stack_top"), bottom))
    boxes = F.array(
        box("corner", c("has_title") | c("has_compass"), left, bottom - F.rint(CORNER_IN[1] * scale * c("dpi")), left + F.rint(CORNER_IN[0] * scale * c("dpi")), bottom),
        box("top", c("top_clear") > 0, zero, zero, c("width"), F.rint(c("top_clear") * c("height"))),
        box("bottom", c("bottom_clear") > 0, zero, c("height") - F.rint(c("bottom_clear") * c("height")), c("width"), c("height")),
        box("profile", c("has_profile"), px0, py0, px1, py1),
    )
    return sheets.select(key, F.explode(F.filter(boxes, lambda b: b.isNotNull())).alias("b")).select(key, "b.*")


def occurrences(spots: DataFrame, names: DataFrame) -> DataFrame:
    """spots whose label is among the names, with weight: how often it occurs there."""
    return spots.drop("weight").join(names.groupBy(F.col("name").alias("label")).agg(F.count("*").alias("weight")), "label")


def annotated(spots: DataFrame, group: str, labels: tuple[str, ...], icons: tuple[str, ...]) -> DataFrame:
    """spots (nth, label, icon) whose missing labels and icons are filled in turn from the lists."""
    place = F.row_number().over(Window.partitionBy(group).orderBy("nth")) - 1
    turn = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col("__k"), F.lit(len(values))) + 1).cast("int"))
    fill = lambda c, values: F.when(F.coalesce(F.col(c), F.lit("")) == "", turn(values)).otherwise(F.col(c))
    return spots.withColumn("__k", place).withColumns({"label": fill("label", labels), "icon": fill("icon", icons)}).drop("__k")


def best_of_name(rows: DataFrame, name: str, rank: str, order: str) -> DataFrame:
    """The row of each name with the highest rank, the first of equals."""
    return first_of_each(rows.withColumn("__rank", -F.col(rank)), [name], ["__rank", order]).drop("__rank")


def destinations(features: DataFrame, vertices: DataFrame, within_m: float = 2000.0) -> DataFrame:
    """name, rank, node, dist_m: named features that lie by the network, at their nearest vertex, one of each name. features: seq, name, rank, x, y; vertices: node, x, y."""
    near = nearest(features.select(F.col("seq").alias("id"), "x", "y"), vertices.select(F.col("node").alias("place"), "x", "y"), within_m)
    met = features.join(near, F.col("seq") == F.col("id")).select("seq", "name", "rank", F.col("place").alias("node"), "dist_m")
    return best_of_name(met, "name", "rank", "seq").select("name", "rank", "node", "dist_m")


def in_first_order(rows: DataFrame, key: str, place: str) -> DataFrame:
    """key, place: each key once, where it first stands."""
    return rows.groupBy(key).agg(F.min(place).alias(place))
